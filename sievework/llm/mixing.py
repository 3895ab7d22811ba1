"""A mixture of sources at target shares of all tokens, with a cap on how often a document is used.

The tokens of each source are added up (partial sums before the shuffle, so that a source with a third of all rows
is no single task). A source's rate is how often its documents are used on average: share x total / tokens, at most
max_repeats. Without a total, the largest one is taken at which no cap binds, so that all shares are met; with one,
what capped sources leave over goes to the others in proportion to their shares. A document is then emitted
floor(rate) times, and once more if a hash of the seed and its key falls below the rate's fraction.

Defined results: sources without a target and documents without tokens are left out; a target source without
tokens has the actual share 0 and the shares of the others are those of what remains. Negative and null shares count
as 0, null caps as 0. An empty table of documents gives no documents and actual shares of null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rates are worked out at the driver, so the sources of a mixture are bounded; more are an error.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Rate:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    rate: float


def rates(tokens: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> list[Rate]:
    """Rates of the target sources; see the module's description."""
    share = {s: max(0.0, w or 0.0) for s, w, _ in targets}
    cap = {s: max(0, m or 0) for s, _, m in targets}
    have = {s: tokens.get(s, 0) for s in share}
    live = [s for s in share if share[s] > 0 and have[s] > 0 and cap[s] > 0]
    rate = dict.fromkeys(share, 0.0)
    if total is None and live:
        size = min(cap[s] * have[s] / share[s] for s in live)
        rate |= {s: share[s] * size / have[s] for s in live}
    elif live:
        left, free = float(total), set(live)
        while free:
            weight = sum(share[s] for s in free)
            full = {s for s in free if share[s] / weight * left >= cap[s] * have[s]}
            if not full:
                rate |= {s: share[s] / weight * left / have[s] for s in free}
                break
            for s in sorted(full):
                rate[s] = float(cap[s])
                left -= cap[s] * have[s]
            free -= full
    return [Rate(s, share[s], cap[s], have[s], min(rate[s], float(cap[s]))) for s in share]


def mix(counted: DataFrame, key: str, source: str, targets: DataFrame, total: float | None = None, seed: int = 1) -> tuple[DataFrame, list[Rate]]:
    """counted: documents with n_tokens. The chosen documents (key, source, n_tokens, repeats) and the rates.

    targets: source, target_share, max_repeats, one row for each source of the mixture; it is read by the driver.
    """
    wanted = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()]
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"a mixture has at most {MOST_SOURCES} sources")
    names = [w[0] for w in wanted]
    sums = counted.where(F.col(source).isin(names)).groupBy(F.col(source).alias("s")).agg(F.sum("n_tokens").alias("n")).collect()  # a row for each target
    found = rates({r["s"]: r["n"] for r in sums}, wanted, total)
    rate = F.try_element_at(F.create_map(*[F.lit(x) for r in found for x in (r.source, r.rate)]), F.col(source)) if found else F.lit(0.0)
    uniform = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    repeats = (F.floor("rate") + F.when(uniform < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    chosen = counted.where("n_tokens > 0").withColumn("rate", rate).where("rate > 0").withColumn("repeats", repeats).where("repeats > 0")
    return chosen.select(key, source, "n_tokens", "repeats"), found


def emit(chosen: DataFrame) -> DataFrame:
    """One row for each use of a chosen document, with copy, counted from 1."""
    return chosen.select("*", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"))


def shares(chosen: DataFrame, source: str, found: list[Rate]) -> DataFrame:
    """source, target_share, max_repeats, tokens, rate, binding, used_tokens, actual_share: one row for each target.

    binding: whether the source is used as often as its cap allows, which limits the whole mixture where no total is given.
    """
    spark = chosen.sparkSession
    used = chosen.groupBy(F.col(source).alias("source")).agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"))
    table = spark.createDataFrame([(r.source, r.target_share, r.max_repeats, r.tokens, r.rate, r.rate > 0 and r.rate >= r.max_repeats) for r in found], "source string, target_share double, max_repeats int, tokens bigint, rate double, binding boolean")
    whole = F.sum("used_tokens").over(Window.partitionBy())  # over a row for each target
    joined = table.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    return joined.select("source", "target_share", "max_repeats", "tokens", "rate", "binding", "used_tokens", F.try_divide("used_tokens", whole).alias("actual_share"))
