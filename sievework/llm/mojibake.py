"""Texts that were decoded with the wrong character table.

1. Twins: lines that hold other than ASCII characters are grouped by what is left of them without these. In each
   group every variant is held against the group's most frequent one: their non-ASCII runs, which stand between the
   same ASCII characters, are aligned in order. Lines of which little is left have many neighbours that are no twins;
   they also meet the line that has the same bytes under another table. Characters whose bytes hold ASCII ones
   (Shift_JIS, GB18030, Big5) meet by what each run between digits, signs and spaces would be read as.
2. Inference: a transformation is a pair of codecs, the one the bytes were written in and the one they were read
   with, once or twice. It explains an aligned pair of lines if it turns each run of the one that differs into that
   of the other. Transformations that explain lines of at least min_support groups are learned.
3. Application: each learned transformation is undone on the words of all documents. What comes out is taken for
   the original if it is far likelier than the word as it stands, under counts of which character follows which
   over all documents (hashed into a table of fixed size). Replacement signs count as garbled beyond recovery.

A garbled word that stands alone between quotes is the subject of its text, not damage, unless more of the text is garbled.

Defined results: null and empty texts are no case and stay as they are. Keys must be unique and not null.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import materialise

# Codecs that texts are written in, and those they are wrongly read with.
WRITTEN = ("utf-8", "cp1252", "cp1251", "koi8_r", "cp866", "mac_roman", "mac_cyrillic", "iso8859_5", "cp850", "cp437", "cp1250", "cp932", "euc_jp", "gb18030", "big5", "euc_kr")
READ = ("cp1252", "latin-1", "cp1251", "koi8_r", "cp437", "mac_roman", "cp866", "cp850", "cp1250", "iso8859_5", "cp1253")
#: All transformations that are tried: (written, read) once, and UTF-8 read as a Western table twice.
CHAINS = tuple((a, b, 1) for a, b in product(WRITTEN, READ) if a != b) + tuple(("utf-8", b, 2) for b in ("cp1252", "latin-1"))
BITS = 20
#: Codecs with ASCII bytes within a character, and what is written in them.
SPLIT = ("cp932", "gb18030", "big5")
_EAST = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{FF01}-\x{FF9F}]"
#: Lines of which fewer ASCII characters are left also meet by their bytes.
FEW = 8

_RUN = re.compile(r"[^\x21-\x7e]+")
# words end at ASCII white space alone: other spaces are often one byte of a garbled character
_WORD = re.compile(r"[^ \t-\r]+")


def words(text: str) -> list[str]:
    """The words of a text that hold other than ASCII characters."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split() if not w.isascii()]


@lru_cache
def _table(codec: str) -> tuple[dict[int, int], str]:
    """Of a one-byte codec: code point to byte, and the characters of all bytes; bytes without a character are C1 controls."""
    back = ""
    for i in range(256):
        try:
            back += bytes([i]).decode(codec)
        except UnicodeDecodeError:
            back += chr(i)
    return {ord(c): i for i, c in reversed([*enumerate(back)])}, back


def _read(data: bytes, codec: str) -> str:
    return codecs.charmap_decode(data, "strict", _table(codec)[1])[0]


def _unread(text: str, codec: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _table(codec)[0])[0]
    except UnicodeEncodeError:
        return None


def garble(text: str, chain: tuple[str, str, int]) -> str | None:
    a, b, times = chain
    for _ in range(times):
        try:
            text = _read(text.encode(a), b)
        except UnicodeEncodeError:
            return None
    return text


def restore(text: str, chain: tuple[str, str, int]) -> str | None:
    """What a garbled text was before, or None if the transformation cannot have made it."""
    a, b, times = chain
    for _ in range(times):
        data = _unread(text, b)
        if data is None:
            return None
        try:
            text = data.decode(a)
        except UnicodeDecodeError:
            return None
    return text


def _runs(line: str) -> dict[int, str]:
    """What stands between the ASCII characters of a line, by how many of these are before it."""
    out, n, end = {}, 0, 0
    for m in _RUN.finditer(line):
        n, end = n + m.start() - end, m.end()
        run = m[0].strip()
        if run:
            out[n] = run
    return out


def explains(clean: str, garbled: str) -> list[int]:
    """The transformations, as indexes of CHAINS, that turn each non-ASCII run of clean that differs into that of garbled."""
    x, y = _runs(clean), _runs(garbled)
    differ = [n for n in x.keys() | y.keys() if x.get(n) != y.get(n)]
    if not differ or any(n not in x or n not in y for n in differ):
        return []
    first = differ[0]
    unread = {b: _unread(y[first], b) for b in READ}
    written = {data: [] for data in unread.values() if data is not None}
    for a in WRITTEN:
        data = _written(x[first], a)
        if data in written:
            written[data].append(a)
    likely = [i for i, (a, b, times) in enumerate(CHAINS) if times == 2 or unread[b] is not None and a in written[unread[b]]]
    return [i for i in likely if all(garble(x[n], CHAINS[i]) == y[n] for n in differ)]


def _written(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def _digest(data: bytes) -> bytes:
    return hashlib.md5(data).digest()


def by_bytes(line: str) -> list[tuple[bytes, int, int, bool]]:
    """Digest of the bytes of a line under each codec, the codec, how often it was read, and whether as written (or as read)."""
    out = []
    for i, a in enumerate(WRITTEN):
        data = _written(line, a)
        if data is not None:
            out.append((_digest(data), i, 0, True))
    for i, b in enumerate(READ):
        data = _unread(line, b)
        if data is None:
            continue
        out.append((_digest(data), i, 1, False))
        once = restore(line, ("utf-8", b, 1)) if ("utf-8", b, 2) in CHAINS else None
        data = None if once is None else _unread(once, b)
        if data is not None:
            out.append((_digest(data), i, 2, False))
    return out


def readings(run: str) -> list[tuple[bytes, int]]:
    """Digest of what a run is read as by each transformation that splits characters, and the transformation."""
    out = []
    for i, c in enumerate(CHAINS):
        if c[0] in SPLIT:
            g = garble(run, c)
            if g is not None and g != run:
                out.append((_digest(g.encode()), i))
    return out


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct lines with other than ASCII characters, the digest of their remaining characters, the group they count for, and in how many documents each occurs."""
    line = docs.where(F.col(text).rlike(r"[^\x{0}-\x{7F}]")).select(F.explode(F.array_distinct(F.split(F.col(text), r"\n+|(?<=[.!?])\s+|(?<=。)\s*"))).alias("line"))
    bare = F.regexp_replace("line", r"[^\x{21}-\x{7E}]+", "")
    each = line.where(F.col("line").rlike(r"[^\x{0}-\x{7F}]")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    few = F.length("__bare") < FEW
    return each.withColumn("__bare", bare).select("line", "n", digest(F.col("__bare")).alias("bare"), few.alias("few"), F.when(few, digest(F.col("line"))).otherwise(digest(F.col("__bare"))).alias("group"))


def _aligned(each: DataFrame) -> DataFrame:
    """chain and group of lines that are explained by the most frequent line with the same remainder."""
    best = each.groupBy("bare").agg(F.max_by(F.struct("line", F.col("group").alias("of")), F.struct("n", "line")).alias("best"), F.count(F.lit(1)).alias("variants")).where("variants > 1")
    twins = each.join(best.select("bare", F.col("best.line").alias("clean"), F.col("best.of").alias("of")), "bare").where("line <> clean").select("line", "clean", "group", "of")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for x, y, g, of in zip(b["line"], b["clean"], b["group"], b["of"]):
                got += [(i, g) for i in explains(x, y)] + [(i, of) for i in explains(y, x)]
            yield pd.DataFrame(got, columns=["chain", "group"])

    return twins.mapInPandas(run, "chain int, group binary")


def _same_bytes(each: DataFrame) -> DataFrame:
    """chain and group of lines with few ASCII characters that have the bytes of another line under another codec."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(*k, g) for x, g in zip(b["line"], b["group"]) for k in by_bytes(x)], columns=["bytes", "codec", "times", "written", "group"])

    known = each.where("few").mapInPandas(run, "bytes binary, codec int, times int, written boolean, group binary")
    one, other = known.where("written").select("bytes", F.col("codec").alias("a"), "group"), known.where("not written").select("bytes", F.col("codec").alias("b"), "times", F.col("group").alias("read"))
    number = {(WRITTEN.index(a), READ.index(b), t): i for i, (a, b, t) in enumerate(CHAINS)}
    chain = F.create_map(*[F.lit(x) for (a, b, t), i in number.items() for x in ((a * 100 + b) * 10 + t, i)])
    met = one.join(other, "bytes").where(F.col("group") != F.col("read"))
    return met.select(F.try_element_at(chain, (F.col("a") * 100 + F.col("b")) * 10 + F.col("times")).alias("chain"), "group").where("chain is not null")


def _same_reading(each: DataFrame) -> DataFrame:
    """chain and group of runs between digits, signs and spaces that a codec with ASCII bytes within characters turns into others."""
    runs = each.select("group", F.explode(F.array_distinct(F.split("line", r"[\x{20}-\x{3F}]+"))).alias("run")).where(F.col("run").rlike(r"[^\x{0}-\x{7F}].*[^\x{0}-\x{7F}]"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(*k, g) for x, g in zip(b["run"], b["group"]) for k in readings(x)], columns=["reading", "chain", "group"])

    east = runs.where(F.col("run").rlike(_EAST)).groupBy("run").agg(F.min("group").alias("group"))
    west = runs.where(~F.col("run").rlike(_EAST)).select("run").distinct().select(F.unhex(F.md5(F.col("run").cast("binary"))).alias("reading"))
    return east.mapInPandas(run, "reading binary, chain int, group binary").join(west, "reading", "left_semi").select("chain", "group")


def learn(docs: DataFrame, key: str, text: str, min_support: int = 2) -> list[tuple[str, str, int]]:
    """The transformations that explain twin lines, most supported first."""
    each = materialise(lines(docs, key, text), "twin-lines")
    found = _aligned(each).unionByName(_same_bytes(each)).unionByName(_same_reading(each))
    support = found.groupBy("chain").agg(F.count_distinct("group").alias("n")).where(F.col("n") >= min_support).collect()  # at most one row for each of CHAINS
    return [CHAINS[r["chain"]] for r in sorted(support, key=lambda r: (-r["n"], r["chain"]))]


def _hash(a, b):
    return ((a * 0x9E3779B1 + b) * 0x85EBCA6B >> 7) & ((1 << BITS) - 1)


def _pairs(word: str) -> list[int]:
    """Hashes of each character with the one before it, if one of them is not ASCII."""
    p = [32, *map(ord, word), 32]
    return [_hash(a, b) for a, b in zip(p, p[1:]) if a > 126 or b > 126]


def _all_pairs(texts: list[str]) -> np.ndarray:
    """_pairs of all words of all texts, in one pass over their code points."""
    p = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    p = np.where((p >= 9) & (p <= 13), 32, p)
    a, b = p[:-1], p[1:]
    wide = (a > 126) | (b > 126)
    return _hash(a[wide].astype(np.uint64), b[wide].astype(np.uint64)).astype(np.int64)


def follow_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How often a character follows another, for pairs with a non-ASCII one, over all documents: natural logarithm of 1 + count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            total += np.bincount(_all_pairs(b["text"].tolist()), minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at.astype(np.int32), "n": total[at]})

    part = docs.where(F.col(text).rlike(r"[^\x{0}-\x{7F}]")).select(F.col(text).alias("text")).mapInPandas(run, "pair int, n bigint")
    got = part.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most 2**BITS rows
    out = np.zeros(1 << BITS, np.float32)
    out[got["pair"].to_numpy()] = np.log1p(got["n"].to_numpy(np.float64))
    return out


def _likely(word: str, counts: np.ndarray) -> float:
    """Mean log count of the pairs of a word; a word of ASCII alone is as likely as words get."""
    p = _pairs(word) if len(word) < 40 else _all_pairs([word])
    return float(counts[p].mean()) if len(p) else 9.0


_CONTROL = re.compile(r"[\x80-\x9f]")
_ALONE = re.compile(r"^([^\w\s]*[“”\"«»„‘’'])([^\x00-\x7f]+)([“”\"«»„‘’'][^\w\s]*)$")


class Judge:
    """Decides of a word whether it is garbled, and what it was."""

    def __init__(self, chains: list[tuple[str, str, int]], counts: np.ndarray, margin: float = 2.5, weak: float = -1.0):
        self.counts, self.margin, self.weak, self.known = counts, margin, weak, {}
        self.most = max(9.0, float(counts.max()))
        self.by_read: dict[str, list[tuple[str, str, int]]] = {}
        for c in chains:
            self.by_read.setdefault(c[1], []).append(c)

    def word(self, w: str) -> tuple[bool, str | None]:
        if len(w) > 64:  # long words hardly come again
            return self._word(w)
        if w not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[w] = self._word(w)
        return self.known[w]

    def _word(self, w: str) -> tuple[bool, str | None]:
        if "�" in w:
            return True, None
        have = best = _likely(w, self.counts)
        to = None
        for b, chains in self.by_read.items():
            data = _unread(w, b)  # once for all codecs the bytes may have been written in
            if data is None:
                continue
            for c in chains:
                # text that happens to be valid UTF-8 when undone is strong evidence by itself
                handicap = self.weak if c[0] == "utf-8" else self.margin
                if self.most - handicap <= best:
                    continue  # no word is likely enough
                try:
                    u = data.decode(c[0])
                except UnicodeDecodeError:
                    continue
                if c[2] == 2:
                    u = restore(u, (*c[:2], 1))
                if u is not None and u != w and not _CONTROL.search(u) and "�" not in u:
                    score = _likely(u, self.counts) - handicap
                    if score > best:
                        best, to = score, u
        if to is not None:
            return True, to
        return bool(_CONTROL.search(w)), None

    def text(self, text: str) -> tuple[bool, str]:
        """Whether the text is garbled, and the text with its garbled words restored where that is possible.

        Words that stand alone between quotes do not make a text garbled; in one that is they are restored like all others.
        """
        each = words(text)
        quoted = {w: m for w in each if (m := _ALONE.match(w))}
        bad = {w: to for w in each if w not in quoted and (found := self.word(w))[0] for to in found[1:]}
        if not bad:
            return False, text
        for w, m in quoted.items():
            found, to = self.word(m[2])
            if found and to is not None:
                bad[w] = m[1] + to + m[3]
        return True, _WORD.sub(lambda m: bad.get(m[0]) or m[0], text)


def judge(docs: DataFrame, key: str, text: str, chains: list[tuple[str, str, int]], counts: np.ndarray) -> DataFrame:
    """Garbled documents: key, restored."""
    shared = docs.sparkSession.sparkContext.broadcast((chains, counts))  # 2**BITS floats
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        j = Judge(*kept.value)
        for b in batches:
            got = [(k, *j.text(t)) for k, t in zip(b["key"], b["text"])]
            yield pd.DataFrame([(k, r) for k, bad, r in got if bad], columns=[key, "restored"])

    wide = docs.where(F.col(text).rlike(r"[^\x{0}-\x{7F}]")).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return wide.mapInPandas(partial(run, kept=shared), f"`{key}` {kind}, restored string")


def garbled(docs: DataFrame, key: str, text: str, min_support: int = 2) -> DataFrame:
    """Garbled documents, key and restored, by transformations learned from the documents themselves."""
    return judge(docs, key, text, learn(docs, key, text, min_support), follow_counts(docs, text))
