"""Records that share most of their content but for small edits: all pairs above a similarity, by generalised pigeonhole.

A text is the binary vector of its distinct word shingles; two texts of n and m shingles have a Jaccard similarity of
at least t just if their vectors differ in at most H = n + m - 2a places, a = ceil(t (n + m) / (1 + t)).
The dimensions are cut into partitions, and each partition gets a threshold of its own: -1 (never probed) or
size - 1 (probed: the pair is a candidate if the partition's bits agree in at least one place). By the pigeonhole
principle no pair is lost while the probed partitions of a text hold more bits than it may miss.

* Partitions: each shingle is one. Grouping correlated bits, all shingles around the same rare word in one partition, was
  measured and left: such a partition is probed by its word, and words recur far more often than shingles (the figures
  are in the README).
* Allocation: the cost of a partition is its estimated number of candidates, its gain the bits it covers. All gains
  being one bit, the dynamic program over (partitions, bits still to cover) is solved by taking partitions in ascending
  order of cost, in allocate(); the test holds it against the general program. The order is the same for all texts, so
  that two texts that share enough bits both probe the cheapest one that they share.
* Estimates: all shingles of all texts are counted into 2**COUNTER_BITS counters and their words into 2**WORD_BITS,
  whose logarithms are broadcast (a fixed 20 MB). A counter holds at least the true count, and a shingle occurs no more
  often than its rarest word: the smaller bound counts, which stays sharp when a corpus is large enough to fill the
  counters of the shingles. A shingle counted once has no partner and is never sent. The estimates decide only what a
  probe costs, never what is found.
* Hot partitions: a shingle whose estimate exceeds Settings.hot is split. Each of its rows goes to one of k parts by the
  hash of its key, and a second copy of it to all k, so that each pair meets in just one part and no task holds them all.
* Verification: probes carry the sizes, positions and a 126-bit parity code of the vector. The codes of two vectors
  differ in at most as many places as the vectors; candidates beyond H are dropped in the join. What is left is
  verified on the 64-bit hashes of the shingles themselves.

Texts with the same words in the same order are one class; links are found between classes and expanded at the end, if wanted.

Defined results: null and empty texts and those of fewer than Settings.least_words words take no part. Keys must be unique and not
null. Ties in size are probed in the order of the keys, each pair once. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import discard, materialise

COUNTER_BITS, WORD_BITS = 24, 22
_CHUNK = 1 << 15
#: Texts that are worked on at once.
_SLICE = 4096


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8
    least_words: int = 5
    hot: int = 4096


#: As the list of true cases of evidence rows defines it.
FOUND = Settings(3, 0.6, 30)


@dataclass(frozen=True)
class Found:
    """members: key, class_id. links: class_a < class_b, shared, united."""

    members: DataFrame
    links: DataFrame


_COST, _TIE = np.uint64(44), np.uint64((1 << 44) - 1)


def ordered(owner: np.ndarray, cost: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The distinct bits of all texts, each as text (12 bits), cost (8 bits) and tie (44 bits) in one integer, in this order."""
    return _unique(np.sort((owner.astype(np.uint64) << np.uint64(52)) | (cost.astype(np.uint64) << _COST) | (tie & _TIE)))


def allocate(which: np.ndarray, start: np.ndarray, miss: np.ndarray) -> np.ndarray:
    """Which partitions to probe so that they cover more bits than a text may miss, at the least cost.

    which: the text of each bit as ordered() gives them; start: the first bit of each text; miss: how many bits of a text
    a partner may lack.
    """
    return np.arange(len(which)) - start[which] <= miss[which]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(texts: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts, words between single blanks: the hash of each shingle in order, its text, the hashes of its words, and those of all words."""
    found = pc.split_pattern(texts, " ")
    count = pc.list_value_length(found).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(count >= max(s.least_words, s.shingle))
    each = found.take(pa.array(kept)).flatten().dictionary_encode()
    known = np.fromiter(map(_hashes.__getitem__, each.dictionary.to_pylist()), np.uint64, len(each.dictionary))  # each word of the slice once
    flat = known[each.indices.to_numpy(zero_copy_only=False)]
    owner = np.repeat(kept.astype(np.int64), count[kept])
    n = max(0, len(flat) - s.shingle + 1)
    words = np.lib.stride_tricks.sliding_window_view(flat, s.shingle) if n else np.empty((0, s.shingle), np.uint64)
    gram = _mix(words[:, 0])
    for k in range(1, s.shingle):
        gram = _mix(gram + words[:, k] * np.uint64(0x9E3779B97F4A7C15))
    whole = owner[:n] == owner[s.shingle - 1 :]
    return gram[whole], owner[:n][whole], words[whole], flat


def _unique(values: np.ndarray) -> np.ndarray:
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return values[first]


def shingles(texts: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of up to 2**12 texts and the text of each, in the order of texts and hashes."""
    gram, owner, _, _ = _grams(texts, s)
    order = np.argsort((owner.astype(np.uint64) << np.uint64(52)) | (gram >> np.uint64(12)))
    gram, owner = gram[order], owner[order]
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[first], owner[first]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most 2**12 texts, whatever the session's batches are."""
    for b in batches:
        for i in range(0, b.num_rows, _SLICE):
            yield b.slice(i, _SLICE)


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def _packed(total: np.ndarray) -> bytes:
    """Counts in as few bytes each as they need, the number of which comes first."""
    kind = np.uint8 if total.max() < 1 << 8 else np.uint16 if total.max() < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(total.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), {1: np.uint8, 2: np.uint16, 4: np.uint32}[data[0]])


def _count(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Chunks of the counters of the shingles, and after them of those of the words."""
    total = np.zeros((1 << COUNTER_BITS) + (1 << WORD_BITS), np.uint32)
    places: list[np.ndarray] = []

    def add() -> None:
        # sorted first, so that the counters are visited in order and each once
        at = np.sort(np.concatenate(places))
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        total[at[first]] += np.diff(np.append(first, len(at))).astype(np.uint32)
        places.clear()

    for b in _slices(batches):
        gram, owner, _, words = _grams(b["text"], s)
        each = _unique(np.sort((owner.astype(np.uint64) << np.uint64(52)) | (gram >> np.uint64(12))))  # once a text
        places += [_place(each, COUNTER_BITS).astype(np.uint32), ((1 << COUNTER_BITS) + _place(_mix(words), WORD_BITS)).astype(np.uint32)]
        if sum(map(len, places)) > 1 << 22:
            add()
    if sum(map(len, places)):
        add()
    parts = [(i, _packed(total[i : i + _CHUNK])) for i in range(0, len(total), _CHUNK) if total[i : i + _CHUNK].any()]
    if parts:
        # the salt spreads the partial counts of one chunk over up to 64 groups, which are added first
        salt = int(total[:64].sum()) % 64
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["chunk", "salt", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, chunk, salt = np.zeros(_CHUNK, np.uint64), 0, 0
    for b in batches:
        for c, s, x in zip(b["chunk"].to_pylist(), b["salt"].to_pylist(), b["counts"].to_pylist()):
            chunk, salt = c, s
            total += _unpacked(x)
    total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([salt], pa.int32()), pa.array([_packed(total)], pa.binary())], ["chunk", "salt", "counts"])


def counters(texts: DataFrame, s: Settings) -> np.ndarray:
    """Of each counter, first those of the shingles, 0 for none, 1 for one, else 1 + 8 times the binary logarithm of its count, in a byte."""
    schema = "chunk int, salt int, counts binary"
    part = texts.select("text").mapInArrow(partial(_count, s=s), schema)
    for keys in (["chunk", "salt"], ["chunk"]):
        part = part.groupBy(*keys).applyInArrow(_add_group, schema)
    out = np.zeros((1 << COUNTER_BITS) + (1 << WORD_BITS), np.uint8)
    for r in part.collect():  # at most len(out) / _CHUNK rows
        n = _unpacked(bytes(r["counts"]))
        out[r["chunk"] : r["chunk"] + len(n)] = np.where(n == 0, 0, np.minimum(255, 1 + np.round(8 * np.log2(np.maximum(n, 1)))))
    return out


def _add_group(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _add(group)


def need(n, m, t):
    """Least number of shingles that sets of n and m share at a similarity of t."""
    return np.ceil(np.round(t * (n + m) / (1 + t), 9))


def _probes(batches: Iterator[pa.RecordBatch], s: Settings, counts) -> Iterator[pa.RecordBatch]:
    """What each text probes: shingle (with its part, if it is hot), key, size, position and side in one integer, parity code."""
    table = counts.value
    for b in _slices(batches):
        gram, owner, words, _ = _grams(b["text"], s)
        if not len(gram):
            continue
        rarest = table[(1 << COUNTER_BITS) + _place(_mix(words), WORD_BITS)].min(axis=1)
        bits = ordered(owner, np.minimum(table[_place(gram >> np.uint64(12), COUNTER_BITS)], rarest), _mix(gram))
        owner, cost, gram = (bits >> np.uint64(52)).astype(np.int64), (bits >> _COST) & np.uint64(255), bits & np.uint64((1 << 52) - 1)
        ids, start, size = np.unique(owner, return_index=True, return_counts=True)
        which = np.repeat(np.arange(len(ids)), size)
        # a partner has at least t times as many shingles, so at most size - ceil(t size) of these are missing in it
        probed = allocate(which, start, size - np.ceil(np.round(s.similarity * size, 9)))
        bit = bits & np.uint64(127)
        bit = np.where(bit > 125, bit - np.uint64(64), bit)
        one = np.uint64(1) << (bit % np.uint64(63))
        high = np.bitwise_xor.reduceat(np.where(bit < 63, one, np.uint64(0)), start).view(np.int64)
        low = np.bitwise_xor.reduceat(np.where(bit >= 63, one, np.uint64(0)), start).view(np.int64)
        keep = probed & (cost > 1)  # a bound of one: no other text has the shingle
        place, gram, w, cost = (np.arange(len(gram)) - start[which])[keep], gram[keep], which[keep], cost[keep]
        parts = np.maximum(1, np.ceil(2.0 ** ((cost.astype(np.float64) - 1) / 8) / s.hot)).astype(np.int64)
        hot = np.flatnonzero(parts > 1)
        side = np.zeros(len(gram), np.int64)
        if len(hot):
            own = _mix(b["key"].take(pa.array(ids[w[hot]])).to_numpy(zero_copy_only=False).view(np.uint64)) % parts[hot].astype(np.uint64)
            side[hot] = 1
            again = np.repeat(hot, parts[hot])
            part = np.arange(len(again)) - np.repeat(np.cumsum(parts[hot]) - parts[hot], parts[hot])
            salted = _mix(gram[again] + (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            gram = np.concatenate([gram, salted])
            gram[hot] = _mix(gram[hot] + (own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            place, w, side = np.concatenate([place, place[again]]), np.concatenate([w, w[again]]), np.concatenate([side, np.full(len(again), 2)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram.view(np.int64)), b["key"].take(pa.array(ids[w])), pa.array(size[w] << 32 | place << 2 | side), pa.array(high[w]), pa.array(low[w])],
            ["shingle", "key", "at", "high", "low"],
        )


def _sets(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        gram, owner = shingles(b["text"], s)
        ids, start = np.unique(owner, return_index=True)
        yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(ids)), pa.array([x.tobytes() for x in np.split(gram, start[1:])] if len(ids) else [], pa.binary())], ["key", "set"])


def _verify(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Candidates whose sets are alike enough, with the number of shingles in both and in either.

    All pairs of a slice are counted in one sort of (pair, 52 bits of the hash). Hashes that agree in these bits alone
    could lift a pair over the threshold by one, so pairs right at it are counted again on all 64 bits.
    """
    for b in _slices(batches):
        sets = [[np.frombuffer(x, np.uint64) for x in b[c].to_pylist()] for c in ("set_a", "set_b")]
        n = b.num_rows
        if not n:
            continue
        size = np.array([[len(x) for x in side] for side in sets], np.int64)
        pair = np.concatenate([np.repeat(np.arange(n, dtype=np.uint64), s) for s in size])
        both = np.sort((pair << np.uint64(52)) | (np.concatenate([*sets[0], *sets[1]]) >> np.uint64(12)))
        twice = both[1:][both[1:] == both[:-1]] >> np.uint64(52)
        shared, total = np.bincount(twice.astype(np.int64), minlength=n), size.sum(axis=0)
        least = need(total, 0, t)
        for i in np.flatnonzero(shared == least):
            shared[i] = len(np.intersect1d(sets[0][i], sets[1][i], assume_unique=True))
        ok = pa.array(shared >= least)
        yield pa.RecordBatch.from_arrays([c.filter(ok) for c in (b["class_a"], b["class_b"], pa.array(shared.astype(np.int32)), pa.array((total - shared).astype(np.int32)))], ["class_a", "class_b", "shared", "united"])


def links(texts: DataFrame, key: str, text: str, s: Settings = Settings()) -> Found:
    """All links of similarity s.similarity or more between classes of texts with the same shingles."""
    spark = texts.sparkSession
    rows = texts.where(F.col(text) != "").select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    # written before it is filtered: a filter on the words would be evaluated on the raw texts, once for each mention
    worded = rows.withColumn("plain", F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")))
    texts_written = materialise(worded.select("key", F.col("plain").alias("text"), F.unhex(F.md5(F.col("plain").cast("binary"))).alias("digest")), "near-texts")
    count = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    marks = texts_written.where((F.col("text") != "") & (count >= max(s.least_words, s.shingle)))
    members = materialise(marks.select("key", "digest").join(marks.groupBy("digest").agg(F.min("key").alias("class_id")), "digest").select("key", "class_id"), "near-members")
    single = materialise(marks.select("key", "text").join(members.where("key = class_id").select("key"), "key", "left_semi"), "near-classes")
    discard(texts_written)
    counts = spark.sparkContext.broadcast(counters(single, s))  # a fixed 20 MB
    probes = single.mapInArrow(partial(_probes, s=s, counts=counts), "shingle bigint, key bigint, at bigint, high bigint, low bigint")
    a, b = probes.alias("a"), probes.alias("b")
    t = Fraction(s.similarity).limit_denominator(1_000_000)
    p, q = t.numerator, t.denominator
    size = lambda x: F.shiftright(F.col(f"{x}.at"), 32)
    after = lambda x: size(x) - F.shiftright(F.col(f"{x}.at").bitwiseAND(F.lit((1 << 32) - 1)), 2)
    both_sizes = size("a") + size("b")
    least = F.expr(f"((shiftright(a.at, 32) + shiftright(b.at, 32)) * {p}L + {p + q - 1}L) div {p + q}L")  # in integers: ceil(t (n + m) / (1 + t))
    sides = F.col("a.at").bitwiseAND(F.lit(3)) + F.lit(4) * F.col("b.at").bitwiseAND(F.lit(3))
    candidates = a.join(b, F.col("a.shingle") == F.col("b.shingle")).where(
        # of a hot shingle, the rows of one part against those that went to all
        ((sides == 0) | (sides == 9))
        & ((size("a") < size("b")) | ((size("a") == size("b")) & (F.col("a.key") < F.col("b.key"))))
        & (size("b") * p <= size("a") * q)
        & (after("a") >= least) & (after("b") >= least)
        & (F.bit_count(F.col("a.high").bitwiseXOR(F.col("b.high"))) + F.bit_count(F.col("a.low").bitwiseXOR(F.col("b.low"))) <= both_sizes - 2 * least)
    )
    pairs = materialise(candidates.select(F.least("a.key", "b.key").alias("class_a"), F.greatest("a.key", "b.key").alias("class_b")).distinct(), "near-candidates")
    asked = pairs.select(F.explode(F.array("class_a", "class_b")).alias("key")).distinct()
    sets = single.join(asked, "key", "left_semi").mapInArrow(partial(_sets, s=s), "key bigint, set binary")
    both = (
        pairs.join(sets.select(F.col("key").alias("class_a"), F.col("set").alias("set_a")), "class_a")
        .join(sets.select(F.col("key").alias("class_b"), F.col("set").alias("set_b")), "class_b")
    )
    return Found(members, both.mapInArrow(partial(_verify, t=s.similarity), "class_a bigint, class_b bigint, shared int, united int"))


def expand(found: Found) -> DataFrame:
    """Pairs of keys: all members of linked classes, and the members of one class among each other."""
    m = found.members
    x = m.select(F.col("key").alias("x"), F.col("class_id").alias("class_a"))
    y = m.select(F.col("key").alias("y"), F.col("class_id").alias("class_b"))
    across = found.links.select("class_a", "class_b").join(x, "class_a").join(y, "class_b").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    within = x.join(y, (F.col("class_a") == F.col("class_b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("key_a"), F.col("y").alias("key_b"))
    return across.unionByName(within)


def linked(found: Found) -> DataFrame:
    """key, class_id, n_links: each row with the class of its text and how many other classes that is linked to. No pair of rows is formed."""
    ends = found.links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return found.members.join(ends, "class_id", "left").select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their hashes, by which a round that changed nothing is known."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("class_a", "class_b").cast("decimal(38,0)"))).first())


def groups(found: Found) -> DataFrame:
    """key, group_id: connected classes of links; group_id is the smallest key of the group.

    Alternating large-star and small-star steps over written tables until nothing changes.
    """
    spark = found.members.sparkSession
    edges = materialise(found.links.select("class_a", "class_b"), "near-edges")
    known = _state(edges)
    while True:
        both = edges.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")).unionByName(edges.select(F.col("class_b").alias("u"), F.col("class_a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("class_a"), F.col("v").alias("class_b")).distinct()
        large = materialise(large, "near-large")
        down = large.select(F.col("class_b").alias("u"), F.col("class_a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("class_a"), F.explode(F.array("u", "v")).alias("class_b")).where("class_a < class_b").distinct()
        new = materialise(small, "near-edges")
        discard(large)
        if (state := _state(new)) == known:
            break
        known = state
        discard(edges)
        edges = new
    roots = edges.groupBy(F.col("class_b").alias("class_id")).agg(F.min("class_a").alias("root"))
    m = found.members.join(roots, "class_id", "left").select("key", F.coalesce("root", "class_id").alias("group_id"))
    return m
