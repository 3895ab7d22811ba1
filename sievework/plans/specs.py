"""Specifications that the catalog's keyword queries use; configuration, not code."""

# Terms of each specification, of both sides of each conflict, names to look for, and terms of labels.
SPECS = {
    "supply_tight": ("memory contracts", "accelerator supply", "wafer starts"),
    "hiring_up": ("hiring plans", "open positions"),
    "pricing_down": ("spot pricing", "contract prices"),
    "never": ("a phrase that no row holds",),
}
CONFLICTS = {
    "availability_pressure": (("shortage", "tight supply", "scarce", "constrained", "capacity constraint"), ("oversupply", "surplus", "glut", "excess inventory", "inventory correction")),
    "directional_growth": (("growth", "rising", "increase", "accelerating", "strong demand"), ("decline", "falling", "decrease", "weak demand", "slowdown")),
    "movement": (("rebounded", "accelerated", "improved", "doubled"), ("slipped", "stalled", "weakened", "flattened")),
}
ENTITIES = ("Galnar", "Nelopa", "Wilprydre", "Rusmor", "Kelzor", "nobody at all")
LABELS = {
    "hardware": ("memory contracts", "wafer starts", "accelerator supply", "gpu", "fab"),
    "work": ("hiring plans", "salary bands", "remote roles", "job boards", "jd"),
    "evidence": ("claim review", "evidence scoring", "duplicate handling", "source diversity"),
}
# Both sides of each claim, nodes of the matrix with side and least number of rows, and names by side.
CLAIMS = {
    "prices_up": (("accelerated", "doubled", "rebounded"), ("slipped", "weakened", "stalled")),
    "supply_short": (("memory contracts", "wafer starts"), ("inventory days",)),
    "unheard": (("a phrase that no row holds",), ("another such phrase",)),
}
MATRIX = {
    "serving_demand": ("demand", ("model serving", "inference capacity"), 3), "hiring_demand": ("demand", ("hiring plans", "open positions"), 2),
    "wafer_limit": ("constraint", ("wafer starts",), 0), "power_limit": ("constraint", ("a phrase that no row holds",), 1), "pricing": ("supply", ("spot pricing",), 100000000),
}
SIDES = {"demand": ("Galnar", "Nelopa", "Rusmor"), "supply": ("Wilprydre", "Kelzor", "nobody at all")}
