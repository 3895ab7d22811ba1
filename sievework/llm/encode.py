"""Token ids of whole texts by a public byte-level BPE vocabulary.

The words of all texts are counted, and the lexicon_words most frequent ones are compiled into a minimal acyclic
transducer: an automaton whose states share suffixes and whose edges carry how many words lie before them, so that
a walk over the bytes of a word sums up to the word's number, and the number leads to its ids. The automaton is a
few flat arrays in one file, which Spark hands to each executor and which every Python worker maps into memory.
Words that the lexicon lacks are merged exactly, by rank, with a heap, so that a word of any length takes
n log n steps.

Defined results: null and empty texts have no ids (an empty list). The text is taken as it is; strings that look
like special tokens are ordinary text. Keys may repeat; rows come out as often as they come in.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import discard, materialise, put_file

#: Folder of the public vocabularies; a parameter of all that reads them.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of this vocabulary cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = regex.compile(PATTERN)
# the same cuts by the faster library: for texts of ASCII alone, and for those without the code points that it reads otherwise
_ASCII_WORD = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_PLAIN_WORD = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache
def _differs() -> np.ndarray:
    """Of all code points, whether the two libraries take them for other kinds of characters: by rule, each is asked."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    out = np.zeros(len(every), bool)
    for one, other in ((r"\p{L}+", r"[^\W\d_]+"), (r"\p{N}+", r"\d+"), (r"\s+", r"\s+")):
        mine = np.zeros(len(every), bool)
        for found in (regex.finditer(one, every), re.finditer(other, every)):
            for m in found:
                mine[m.start() : m.end()] ^= True
        out |= mine
    return out


def split(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_WORD.findall(text)
    return (_WORD if _differs()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any() else _PLAIN_WORD).findall(text)


_NONE = 1 << 60


def read_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the pair of neighbours of the lowest rank is merged, the leftmost first, until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n <= 32:  # a short word has few pairs; looking at all of them each time is quicker than a heap
        parts = [word[i : i + 1] for i in range(n)]
        at = [ranks.get(word[i : i + 2], _NONE) for i in range(n - 1)]
        while at and (r := min(at)) != _NONE:
            i = at.index(r)
            parts[i] += parts.pop(i + 1)
            del at[i]
            if i:
                at[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
            if i < len(at):
                at[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        return [ranks[p] for p in parts]
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def push(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Lexicon:
    """Minimal acyclic automaton over byte strings that numbers its words, with a list of ids for each number."""

    NAMES = ("first", "label", "target", "skip", "final", "offset", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> "Lexicon":
        """Words are added in sorted order; each finished state is replaced by an equal one if there is any."""
        order = sorted(words)
        # a state under construction is [final, {label: state or number}]; a finished one is its number
        done: dict[tuple, int] = {}
        states: list[tuple] = []
        size: list[int] = []

        def finish(s: list) -> int:
            key = (s[0], tuple(s[1].items()))
            if key not in done:
                done[key] = len(states)
                states.append(key)
                size.append(int(s[0]) + sum(size[t] for _, t in key[1]))
            return done[key]

        path: list[list] = [[False, {}]]
        last = b""
        for w in order:
            common = len(os.path.commonprefix([last, w]))
            while len(path) > common + 1:
                s = path.pop()
                path[-1][1][last[len(path) - 1]] = finish(s)
            for _ in w[common:]:
                path.append([False, {}])
            path[-1][0] = True
            last = w
        while len(path) > 1:
            s = path.pop()
            path[-1][1][last[len(path) - 1]] = finish(s)
        root = finish(path[0])
        first, label, target, skip, final = [0], [], [], [], []
        for fin, edges in states:
            before = int(fin)
            for c, t in edges:
                label.append(c)
                target.append(t)
                skip.append(before)
                before += size[t]
            first.append(len(label))
            final.append(fin)
        lists = [words[w] for w in order]
        return cls({
            "first": np.array([root, *first], np.uint32), "label": np.array(label, np.uint8), "target": np.array(target, np.uint32), "skip": np.array(skip, np.uint32),
            "final": np.array(final, np.uint8), "offset": np.cumsum([0, *map(len, lists)]).astype(np.uint32), "ids": np.array(list(chain.from_iterable(lists)), np.int32),
        })

    def data(self) -> bytes:
        """The arrays as one file, each after the lengths of all and on a multiple of 8 bytes."""
        parts = [getattr(self, k) for k in self.NAMES]
        head = np.array([len(p) for p in parts], np.uint64)
        return head.tobytes() + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)

    @classmethod
    def map(cls, path: str) -> "Lexicon":
        raw = np.memmap(path, np.uint8, "r")
        head, at, arrays = raw[: 8 * len(cls.NAMES)].view(np.uint64), 8 * len(cls.NAMES), {}
        for k, n, t in zip(cls.NAMES, head, (np.uint32, np.uint8, np.uint32, np.uint32, np.uint8, np.uint32, np.int32)):
            size = int(n) * np.dtype(t).itemsize
            arrays[k] = raw[at : at + size].view(t)
            at += size + (-size % 8)
        return cls(arrays)

    def find(self, word: bytes) -> list[int] | None:
        """Ids of a word, or None if it is not in the lexicon."""
        first, label, target, skip, final = self._views()
        state, number = first[0], 0
        for c in word:
            k = label.find(c, first[state + 1], first[state + 2])
            if k < 0:
                return None
            number += skip[k]
            state = target[k]
        return self.ids[self.offset[number] : self.offset[number + 1]].tolist() if final[state] else None

    def _views(self):
        """The arrays in a form that single elements are read from quickly; the numbers stay in the mapped file, the labels are a few bytes an edge."""
        if not hasattr(self, "_seen"):
            self._seen = memoryview(self.first), self.label.tobytes(), memoryview(self.target), memoryview(self.skip), memoryview(self.final)
        return self._seen


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """word, n: how often each word occurs in all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(split(t))
            if len(seen) > 200_000:  # a bounded table; what is known so far is handed on
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen = Counter()
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    part = docs.where(F.col(text) != "").select(F.col(text).alias("text")).mapInPandas(run, "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, text: str, lexicon_words: int = 50_000, folder: str = TOKENIZERS, name: str = VOCABULARY) -> tuple[str, str]:
    """Build the lexicon of the most frequent words; the names of its file and of the vocabulary's, as handed to executors."""
    spark = docs.sparkSession
    words = materialise(count_words(docs, text).where("n > 1 and length(word) <= 64"), "word-counts")
    # by sixteenths of the binary logarithm of the count: all words of the classes that fit, and of the next one a share by hash, so that
    # no more than about lexicon_words rows reach the driver, and no task sorts or sends others
    size = F.floor(16 * F.log2("n"))
    sizes = {r["b"]: r["m"] for r in words.groupBy(size.alias("b")).agg(F.count(F.lit(1)).alias("m")).collect()}  # at most 16 x 63 classes
    left, least, share = lexicon_words, max(sizes, default=0) + 1, 0.0
    for b in sorted(sizes, reverse=True):
        if sizes[b] > left:
            share = left / sizes[b]
            break
        left, least = left - sizes[b], b
    place = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    frequent = words.where((size >= least) | ((size >= (b if share else least)) & (place < share))).select("word").collect()
    discard(words)
    ranks = read_ranks(folder, name)
    lexicon = Lexicon.build({(w := r["word"].encode()): merge(w, ranks) for r in frequent})
    return put_file(spark, "lexicon", lexicon.data()), put_file(spark, "ranks", open(os.path.join(folder, name), "rb").read())


@lru_cache(2)
def _loaded(lexicon: str, vocabulary: str) -> tuple[Lexicon, dict[bytes, int]]:
    return Lexicon.map(SparkFiles.get(lexicon)), read_ranks(SparkFiles.getRootDirectory(), vocabulary)


class _Ids(dict):
    """Numbers of words whose ids are known, from the lexicon or else merged; forgets all when it has grown large."""

    MOST = 200_000

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int]):
        super().__init__()
        self.lexicon, self.ranks, self.flat, self.ends = lexicon, ranks, [], [0]

    def __missing__(self, word: str) -> int:
        data = word.encode()
        ids = self.lexicon.find(data)
        self.flat += merge(data, self.ranks) if ids is None else ids
        self.ends.append(len(self.flat))
        n = self[word] = len(self.ends) - 2
        return n

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each word has."""
        if len(self) > self.MOST:
            self.clear()
            self.flat, self.ends = [], [0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        ends = np.array(self.ends, np.int64)
        start, size = ends[at], ends[at + 1] - ends[at]
        where = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.array(self.flat, np.int32)[where], size


@lru_cache(2)
def _known(lexicon: str, vocabulary: str) -> _Ids:
    return _Ids(*_loaded(lexicon, vocabulary))


def _encode(batches: Iterator[pa.RecordBatch], lexicon: str, vocabulary: str, counts: bool) -> Iterator[pa.RecordBatch]:
    known = _known(lexicon, vocabulary)
    for whole in batches:
        for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
            words = [split(t) if t else [] for t in b["text"].to_pylist()]
            ids, size = known.ids(list(chain.from_iterable(words)))
            ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, words)])]
            out = pa.array(np.diff(ends)) if counts else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[b[k] for k in keep], out], [*keep, "n_tokens" if counts else "ids"])


def encode(docs: DataFrame, keep: list[str], text: str, counts: bool = False, lexicon_words: int = 50_000, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Rows with the columns keep and ids, or n_tokens instead of ids."""
    lexicon, vocabulary = compile_lexicon(docs, text, lexicon_words, folder, name)
    rows = docs.select(*keep, F.col(text).alias("text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text") + (", n_tokens bigint" if counts else ", ids array<int>")
    return rows.mapInArrow(partial(_encode, lexicon=lexicon, vocabulary=vocabulary, counts=counts), schema)
