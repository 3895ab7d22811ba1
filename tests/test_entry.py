import re
from pathlib import Path

import __spark_entry__
from sievework import session

ROOT = Path(__file__).parents[1]


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_training_data_operators():
    for p in (ROOT / "sievework").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"sievework\.llm|from sievework import llm", p.read_text()), p


def test_package_is_shipped_once(spark):
    session.ship(spark)
    n = len(list(spark.sparkContext._jsc.sc().listFiles().mkString(" ").split()))
    session.ship(spark)
    assert len(list(spark.sparkContext._jsc.sc().listFiles().mkString(" ").split())) == n >= 1


def test_files_reach_python_workers(spark):
    from pyspark import SparkFiles

    name = session.put_file(spark, "probe", b"abc")
    assert open(SparkFiles.get(name), "rb").read() == b"abc"
    got = spark.range(1).mapInPandas(lambda bs: (b.assign(id=len(open(SparkFiles.get(name), "rb").read())) for b in bs), "id bigint").first()["id"]
    assert got == 3


def test_scratch_tables_are_deleted_after_use(spark):
    with session.scratch_tables():
        t = session.materialise(spark.range(5), "probe")
        path = session._WRITTEN[id(t)][1]
        assert t.count() == 5 and session.exists(spark, path)
    assert not session.exists(spark, path)


def test_queries_of_the_core_without_the_libraries_of_the_rest(monkeypatch):
    monkeypatch.setitem(__import__("sys").modules, "sievework.llm.queries", None)
    assert len(__spark_entry__.queries()) == len(__spark_entry__.catalog.QUERIES)
