from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.operators import instants as I

SITES = [("a.example", "America/New_York", "mdy"), ("b.example", "Europe/Berlin", "dmy"), ("n.example", None, "dmy"), ("u.example", "UTC", "ymd")]

CASES = [
    ("2025-10-09 22:10:42", "u.example", "2025-10-09T22:10:42.000000Z"),
    ("2025-10-09 22:10:42", "a.example", "2025-10-10T02:10:42.000000Z"),
    ("2025-10-09 22:10:42", "n.example", None),
    ("2024-01-21T05:00:58.428514788-05:00", "n.example", "2024-01-21T10:00:58.428514Z"),
    ("2025-05-06T12:44:21.788-07", "a.example", "2025-05-06T19:44:21.788000Z"),
    ("2024/02/05 10:29:45 UTC-05:00", "b.example", "2024-02-05T15:29:45.000000Z"),
    ("Wed, 24 Jan 2024 01:43:49 +0530", "b.example", "2024-01-23T20:13:49.000000Z"),
    ("03/10/2024 04:09 AM", "a.example", "2024-03-10T08:09:00.000000Z"),
    ("03/10/2024 04:09", "b.example", "2024-10-03T02:09:00.000000Z"),
    ("12/31/2024 12:05 AM", "a.example", "2024-12-31T05:05:00.000000Z"),
    ("14. November 2025, 03:40 Uhr", "b.example", "2025-11-14T02:40:00.000000Z"),
    ("31 mars 2024 à 2h16", "b.example", "2024-03-31T01:16:00.000000Z"),
    ("30 de marzo de 2025, 23:19", "u.example", "2025-03-30T23:19:00.000000Z"),
    ("Jun 10, 2024 20:55", "u.example", "2024-06-10T20:55:00.000000Z"),
    ("October 18, 2024 12:22 AM UTC", "a.example", "2024-10-18T00:22:00.000000Z"),
    ("2024-07-15 05:23:00 PDT", "a.example", "2024-07-15T12:23:00.000000Z"),
    ("2024-10-19T08:53:45[Asia/Kolkata]", "n.example", "2024-10-19T03:23:45.000000Z"),
    ("20240124T003850Z", "a.example", "2024-01-24T00:38:50.000000Z"),
    ("1770333089", "n.example", "2026-02-05T23:11:29.000000Z"),
    ("1709701037159", "n.example", "2024-03-06T04:57:17.159000Z"),
    ("1775845079833570", "n.example", "2026-04-10T18:17:59.833570Z"),
    (" \t2025-09-08 18:26:55z\n", "n.example", "2025-09-08T18:26:55.000000Z"),
    # skipped by the clock change: the offset before it; twice: the first
    ("2024-03-10 02:30:00", "a.example", "2024-03-10T07:30:00.000000Z"),
    ("2024-11-03 01:30:00", "a.example", "2024-11-03T05:30:00.000000Z"),
    ("2025-02-30T10:00:00Z", "u.example", None), ("25:61", "u.example", None), ("2024-13-05 08:00", "u.example", None), ("0000-00-00 00:00:00", "u.example", None),
    ("20260129", "u.example", None), ("2024-11-22", "u.example", None), ("April 30, 2024", "u.example", None), ("2026-W18", "u.example", None),
    ("yesterday", "u.example", None), ("-", "u.example", None), ("", "u.example", None), (None, "u.example", None), ("x" * 100_000, "u.example", None),
    ("2024-10-19T08:53:45[No/Where]", "n.example", None), ("2025-10-09 22:10:42", "unknown.example", None),
]


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(SITES, "host string, time_zone string, date_order string")


def run(spark, sites, path, cases):
    v = spark.createDataFrame([(i, r, h) for i, (r, h, *_) in enumerate(cases)], "ordinal bigint, raw string, host string")
    out = I.normalise_instants(spark, v, sites, path).withColumn("t", I.instant_text(F.col("micros")))
    return {r["ordinal"]: r["t"] for r in out.collect()}


def test_forms(spark, sites, tmp_path):
    got = run(spark, sites, str(tmp_path / "d"), CASES)
    assert {i: got[i] for i in got} == {i: c[2] for i, c in enumerate(CASES)}


def test_dictionary_grows_and_parses_once(spark, sites, tmp_path):
    path = str(tmp_path / "d")
    run(spark, sites, path, CASES)
    d = I.InstantDictionary(spark, path)
    n = d.read().count()
    run(spark, sites, path, CASES + CASES)
    assert d.read().count() == n == len({(r, h) for r, h, _ in CASES if r and r.strip()})
    last = max((tmp_path / "d").iterdir(), key=lambda p: p.stat().st_mtime)
    assert spark.read.parquet(str(last)).count() == 0  # the second run had nothing new to parse
    (tmp_path / "d" / "half").mkdir()  # an update that died is not read
    assert I.InstantDictionary(spark, path).read().count() == n


def test_empty_table_and_clashing_names(spark, sites, tmp_path):
    v = spark.createDataFrame([], "ordinal bigint, raw string, host string, time_zone string, date_order string, zone string")
    assert I.normalise_instants(spark, v, sites, str(tmp_path / "e")).count() == 0
    v = spark.createDataFrame([(1, "2025-10-09 22:10:42", "u.example", "x", "y", "z")], v.schema)
    assert I.normalise_instants(spark, v, sites, str(tmp_path / "f")).collect()[0]["micros"] == 1760047842000000


@settings(max_examples=5, deadline=None)
@given(st.lists(st.datetimes(datetime(2000, 1, 1), datetime(2035, 1, 1)), min_size=1, max_size=20))
def test_iso_round_trip(spark, tmp_path_factory, times):
    sites = spark.createDataFrame(SITES, "host string, time_zone string, date_order string")
    cases = [(t.isoformat(timespec="microseconds") + "+00:00", "a.example") for t in times]
    got = run(spark, sites, str(tmp_path_factory.mktemp("d") / "x"), cases)
    assert [got[i] for i in range(len(times))] == [t.replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ") for t in times]
