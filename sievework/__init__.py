"""Evidence analytics on Spark: declarative operators over collected records."""
