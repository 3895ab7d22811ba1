"""Records of executed requests: counts, costs, failures, reconciliation with the plan, and a fingerprint of a run's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import netloc


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("n_records"))


def reconcile(planned: DataFrame, records: DataFrame, failures: tuple[str, ...]) -> DataFrame:
    """query_id, n_records, outcome: failed only if all records failed, skipped without any, else executed. Records are reduced to one row for each query before the join."""
    done = records.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("status").isin(*failures)).alias("bad"))
    outcome = F.when(F.col("n").isNull(), "skipped").when(F.col("bad"), "failed").otherwise("executed")
    return planned.join(done, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_records"), outcome.alias("outcome"))


def fingerprint(rows: DataFrame, parts: list[Column]) -> DataFrame:
    """n_rows, fingerprint: of the multiset of rows, whatever their order. Row hashes are added up, so no task sees all rows."""
    line = F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("\u0001")) for p in parts]), 256)
    piece = [F.conv(F.substring(line, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    sums = rows.select(*[p.alias(f"p{i}") for i, p in enumerate(piece)]).agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(f"p{i}"), F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)])
    return sums.select("n_rows", F.sha2(F.concat_ws("|", "n_rows", *[f"s{i}" for i in range(5)]), 256).alias("fingerprint"))


#: Outcomes that count as success, as failure, and reasons that lie in the network.
SUCCESS = ("ok", "warning", "cache_hit")
FAILURE = ("failed", "rate_limit", "retry_exhausted", "robots_denied", "timeout")
NETWORK_REASONS = ("dns_resolution_failed", "network_timeout", "network_unavailable", "tls_failure")


def merged(*passes: DataFrame) -> DataFrame:
    """All records of several passes, with the pass they came from, counted from 1; columns that a pass lacks are null."""
    out = None
    for i, p in enumerate(passes, 1):
        tagged = p.withColumn("pass", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def request_totals(records: DataFrame) -> DataFrame:
    """status, n_records, n_requests of all passes: records by status, null as 'unknown'."""
    return records.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n_records"))


def checked(records: DataFrame, key: str) -> DataFrame:
    """key, outcome: 'checked' if any record of it succeeded, else 'failed'; records without a key are left out."""
    ok = F.bool_or(F.coalesce(F.col("status").isin(*SUCCESS), F.lit(False)))
    return records.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.when(ok, "checked").otherwise("failed").alias("outcome"))


def failures(planned: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """key, reason, causes: planned keys none of whose records got through: for reasons of the network, if any is named, else for lack of sources."""
    got = records.groupBy(key).agg(F.bool_and(F.col("status").isin(*FAILURE)).alias("bad"), F.array_sort(F.collect_set(F.when(F.col("failure_reason").isin(*NETWORK_REASONS), F.col("failure_reason")))).alias("causes"))
    none = F.array().cast("array<string>")
    lost = planned.select(key).distinct().join(got, key, "left").where(F.coalesce("bad", F.lit(True)))
    causes = F.coalesce("causes", none)
    return lost.select(key, F.when(F.size(causes) > 0, "infrastructure_unavailable").otherwise("no_executable_sources").alias("reason"), causes.alias("causes"))


def challenge_totals(challenges: DataFrame) -> DataFrame:
    """total, completed, pending_human_actions, advisory_coverage_gaps over all challenges; null flags are false, but blocking is true."""
    flag = lambda c, default=False: F.coalesce(F.col(c), F.lit(default))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    done = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("pending")) == "completed"
    return challenges.agg(
        F.count(F.lit(1)).alias("total"), n(done).alias("completed"),
        n(flag("human_action_required") & flag("blocking", True) & ~done).alias("pending_human_actions"), n(flag("coverage_missing") & ~flag("blocking", True) & ~done).alias("advisory_coverage_gaps"),
    )


def costs(records: DataFrame, connector: str, enabled: bool, budget: int) -> DataFrame:
    """allowed, attempted, completed, stop_reason of a paid connector's calls. What a record itself counted holds; else failed and timed-out ones count their attempts."""
    own = F.col("paid_calls_attempted").isNotNull()
    tried = F.when(own, F.col("paid_calls_attempted")).when(F.col("status").isin("failed", "timeout"), F.coalesce("attempts", F.lit(0))).otherwise(0)
    said = F.min(F.when(F.coalesce("stop_reason", F.lit("")) != "", F.struct("ordinal", "stop_reason")))["stop_reason"]
    t = records.where(F.col("connector") == connector).agg(F.coalesce(F.sum(tried), F.lit(0)).cast("bigint").alias("attempted"), F.coalesce(F.sum(F.when(own, F.coalesce("paid_calls_completed", F.lit(0)))), F.lit(0)).cast("bigint").alias("completed"), said.alias("said"))
    on = enabled and budget > 0
    reason = F.when(F.lit(not on), "paid_discovery_disabled").when((F.col("attempted") > 0) & (F.col("completed") > 0), "paid_call_completed").when(F.col("attempted") > 0, "paid_call_failed").otherwise(F.coalesce("said", F.lit("paid_discovery_not_needed")))
    return t.select(F.lit(budget if on else 0).cast("bigint").alias("allowed"), "attempted", "completed", reason.alias("stop_reason"))


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, that of over."""
    return over.unionByName(base.join(over.select(key), key, "left_anti"), allowMissingColumns=True)


def request_key(*parts: Column) -> Column:
    """Key of a request for caches: equal for equal parts, in the order given; nulls differ from empty texts."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def retry_delay(attempt: Column, base: float, cap: float, jitter: Column) -> Column:
    """Seconds before an attempt: base doubled for each one before, at most cap, times a half to one by the jitter (0 to 1), to 3 digits."""
    doubled = F.least(F.lit(max(0.0, cap)), F.lit(max(0.0, base)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
    return F.round(doubled * (0.5 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), jitter))), 3)


def first_host(*urls: Column) -> Column:
    """The host of the first of several URLs that has one, in lower case without port; '' without any."""
    return F.coalesce(*[F.nullif(F.regexp_replace(F.regexp_replace(netloc(u), "^.*@", ""), r":\d*$", ""), F.lit("")) for u in urls], F.lit(""))


def readiness(checks: DataFrame) -> DataFrame:
    """check_count, available_count, required_failure_count, optional_missing_count of capability checks (available, required)."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    there, must = F.coalesce("available", F.lit(False)), F.coalesce("required", F.lit(False))
    return checks.agg(F.count(F.lit(1)).alias("check_count"), n(there).alias("available_count"), n(must & ~there).alias("required_failure_count"), n(~must & ~there).alias("optional_missing_count"))
