"""The main body of web pages, without navigation, notices, sidebars and footers.

A linear-chain conditional random field over a page's leaf blocks in document order: each block is main content or
furniture. Features are the block's text (hashed words and word pairs, length, terminators, separators, digits,
case), its place on the page, and its relation to the nearest heading above it, which is all that the blocks keep of
their ancestors in the document tree. The field is trained here by stochastic gradient on the exact likelihood
(forward-backward), on pages that the labelling functions below can label wholly, and decoded by Viterbi.

Training reads at most max_pages pages, those with the smallest hashes of their keys; all pages are decoded.

Defined results: a page whose blocks are null or empty has no blocks. A null or blank block text is furniture.
Blocks keep their order; block_index counts from 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.sampling import smallest_hashes

BITS = 16
_SIDE = 1 << BITS

# Phrases that furniture opens with or holds, for the labels of the training pages.
FURNITURE = re.compile(
    r"^(?:©|\(c\) \d{4}|copyright\b|skip to|menu\b|back to top|haut de page|nach oben|zum seitenanfang|volver arriba|voltar ao topo|наверх|share (?:this|on)|follow \w+|advertisement|anzeige$|publicité|publicidad|реклама|sponsored|related:|read next|next article|previous article|most read|trending now|you may also like|download our app|filter by|sort by|already a member|version \d+|page \d+ of|tags?:|sign (?:in|up)\b|subscribe\b|log in)"
    r"|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos|todos os direitos|все права защищены|reproduction only with"
    r"|use of cookies|we use cookies|use cookies to|cookies, um|verwenden cookies|utilis\w+ des cookies|usamos cookies|utilizamos cookies|файлы cookie|store small files|guarda datos en|guarda dados no|хранит данные на|conservent des données sur|speicher[tn]\w* daten|privacy choices|remember your preferences|keeps data for|accept all|alle akzeptieren|tout accepter|aceptar tod|aceitar tod"
    r"|unsubscribe at any time|join the discussion|newsletter\. |report a problem|copy link|results per page|free stories|more stories this|usual networks",
    re.IGNORECASE,
)
_SEPARATED = re.compile(r"\s*[|/›»•·>]\s*")
_ENDED = re.compile(r"[.!?。！？…][\"”»“’')\]]*$")
_WORD = re.compile(r"\w+|[^\w\s]")
_DIGITS = re.compile(r"\d+")


def label(blocks: list[tuple[str, str]]) -> list[int] | None:
    """1 main, 0 furniture for each (heading, text) of a page, or None if a block's kind is unclear."""
    first = next((i for i, (h, t) in enumerate(blocks) if h and h == t), None)
    if first is None:
        return None
    out = []
    for i, (h, t) in enumerate(blocks):
        parts = [p for p in _SEPARATED.split(t) if p]
        if not t.strip() or i < first or FURNITURE.search(t):
            out.append(0)
        elif h == t:
            out.append(1)
        elif _ENDED.search(t) and (len(parts) <= 2 or len(t.split()) >= 12):
            out.append(1)
        elif "|" in t and len(parts) in (2, 3, 4) and any(c.isdigit() for c in t):
            out.append(1)
        elif len(parts) >= 3 or len(t.split()) <= 8:
            out.append(0)
        else:
            return None
    return out


def _bucket(n: int) -> int:
    return min(9, int(n).bit_length())


def _text_features(text: str) -> tuple[int, ...]:
    """Features of a block's text; those of short texts, which furniture repeats, are kept."""
    return _short_features(text) if len(text) <= 400 else _whole_features(text)


def _whole_features(text: str) -> tuple[int, ...]:
    words = _WORD.findall(_DIGITS.sub("0", text.lower()))
    out = {zlib.crc32(w.encode("utf-8", "surrogatepass")) % _SIDE for w in words}
    out |= {zlib.crc32((a + " " + b).encode("utf-8", "surrogatepass")) % _SIDE for a, b in zip(words, words[1:])}
    if words:
        out |= {zlib.crc32(("first " + words[0]).encode("utf-8", "surrogatepass")) % _SIDE, zlib.crc32(("last " + words[-1]).encode("utf-8", "surrogatepass")) % _SIDE}
    caps = [w for w in text.split() if w[:1].isalpha()]
    shape = (
        _bucket(len(words)), 10 + bool(_ENDED.search(text)), 12 + min(4, len(_SEPARATED.findall(text))),
        17 + any(c.isdigit() for c in text), 19 + (sum(w[0].isupper() for w in caps) * 4 // max(1, len(caps))),
        24 + min(3, text.count(". ")), 28 + ("|" in text) * (1 + any(c.isdigit() for c in text)),
    )
    return tuple(sorted(out)) + tuple(_SIDE + s for s in shape)


_short_features = lru_cache(50_000)(_whole_features)

#: Place features follow those of the text.
_PLACE, SIZE = _SIDE + 40, _SIDE + 80


def features(blocks: list[tuple[str, str]]) -> list[tuple[int, ...]]:
    n, out = len(blocks), []
    titles = [i for i, (h, t) in enumerate(blocks) if h and h == t]
    first = titles[0] if titles else n
    for i, (h, t) in enumerate(blocks):
        relation = 0 if not h else 1 if h == t else 2
        place = (_PLACE + relation, _PLACE + 3 + (i > first) + (i > (titles[-1] if titles else n)), _PLACE + 6 + min(4, i), _PLACE + 11 + min(4, n - 1 - i), _PLACE + 16 + relation * 3 + (0 if i == 0 else 1 if blocks[i - 1][0] == h else 2), _PLACE + 25 + (not titles))
        out.append(_text_features(t) + place)
    return out


class Field:
    """Weights of main against furniture for each feature, and of each step from label to label."""

    def __init__(self):
        self.w, self.step = np.zeros(SIZE), np.zeros((2, 2))

    def _pages(self, pages: list[list[tuple[int, ...]]]):
        lengths = np.array([len(p) for p in pages])
        flat = [f for p in pages for b in p for f in b]
        owner = np.repeat(np.arange(lengths.sum()), [len(b) for p in pages for b in p])
        return lengths, np.array(flat, np.int64), owner

    def scores(self, pages: list[list[tuple[int, ...]]]) -> np.ndarray:
        lengths, flat, owner = self._pages(pages)
        return np.bincount(owner, self.w[flat], lengths.sum())

    def train(self, pages: list[list[tuple[int, ...]]], labels: list[list[int]], epochs: int = 6, l2: float = 1e-4, rate: float = 0.2) -> "Field":
        g2, s2 = np.full(SIZE, 1e-2), np.full((2, 2), 1e-2)
        order = np.random.default_rng(3)
        for _ in range(epochs):
            for part in np.array_split(order.permutation(len(pages)), max(1, len(pages) // 32)):
                some = [pages[i] for i in part]
                lengths, flat, owner = self._pages(some)
                y = np.concatenate([np.array(labels[i]) for i in part])
                e = np.bincount(owner, self.w[flat], lengths.sum())
                p, pair = self._marginals(e, lengths)
                d = p - y
                u, inv = np.unique(flat, return_inverse=True)
                g = np.bincount(inv, d[owner], len(u)) / len(part) + l2 * self.w[u]
                g2[u] += g * g
                self.w[u] -= rate * g / np.sqrt(g2[u])
                starts = np.cumsum(lengths) - lengths
                inner = np.ones(len(y), bool)
                inner[starts] = False
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
                gs = (pair - seen) / len(part) + l2 * self.step
                s2 += gs * gs
                self.step -= rate * gs / np.sqrt(s2)
        return self

    def _marginals(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of main for each block, and the expected number of each step, by forward-backward over all pages at once."""
        n, most = len(lengths), int(lengths.max())
        pad = np.zeros((n, most))
        at = np.repeat(np.arange(n), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        pad[at] = e
        score = np.stack([np.zeros_like(pad), pad], axis=2)
        live = np.arange(most)[None, :] < lengths[:, None]
        fwd, bwd = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fwd[:, 0] = score[:, 0]
        for j in range(1, most):
            fwd[:, j] = np.logaddexp(fwd[:, j - 1, 0, None] + self.step[0], fwd[:, j - 1, 1, None] + self.step[1]) + score[:, j]
        for j in range(most - 2, -1, -1):
            nxt = bwd[:, j + 1] + score[:, j + 1]
            new = np.logaddexp(self.step[:, 0] + nxt[:, 0, None], self.step[:, 1] + nxt[:, 1, None])
            bwd[:, j] = np.where(live[:, j + 1, None], new, 0.0)
        both = fwd + bwd
        p = 1 / (1 + np.exp(np.clip(both[..., 0] - both[..., 1], -50, 50)))
        total = np.logaddexp(both[:, 0, 0], both[:, 0, 1])
        pair = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                x = fwd[:, :-1, a] + self.step[a, b] + score[:, 1:, b] + bwd[:, 1:, b] - total[:, None]
                pair[a, b] = np.exp(np.minimum(x, 0))[live[:, 1:]].sum()
        return p[at], pair

    def decode(self, pages: list[list[tuple[int, ...]]]) -> list[list[int]]:
        """The likeliest labels of each page, by Viterbi."""
        e, out, at = self.scores(pages), [], 0
        (s00, s01), (s10, s11) = self.step.tolist()
        for p in pages:
            a, b, back = 0.0, 0.0, []
            for i, x in enumerate(e[at : at + len(p)].tolist()):
                if i == 0:
                    a, b = 0.0, x
                    continue
                na, fa = (a + s00, 0) if a + s00 >= b + s10 else (b + s10, 1)
                nb, fb = (a + s01, 0) if a + s01 >= b + s11 else (b + s11, 1)
                a, b = na, nb + x
                back.append((fa, fb))
            path = [int(b > a)]
            for f in reversed(back):
                path.append(f[path[-1]])
            out.append(path[::-1] if p else [])
            at += len(p)
        return out


def _blocks(cell) -> list[tuple[str, str]]:
    return [(b["heading"] or "", b["text"] or "") if b is not None else ("", "") for b in cell]


def fit(pages: DataFrame, key: str, blocks: str, max_pages: int = 2000) -> Field:
    some = smallest_hashes(pages.select(key, blocks), key, max_pages, F.size(blocks) > 0)
    known = [(b, y) for b in map(_blocks, some[blocks]) if (y := label(b)) is not None]
    return Field().train([features(b) for b, _ in known], [y for _, y in known]) if known else Field()


def split(pages: DataFrame, key: str, blocks: str, field: Field) -> DataFrame:
    """key, main and rest: of each page with blocks, the indexes of its main blocks and of its furniture."""
    shared = pages.sparkSession.sparkContext.broadcast(field)  # SIZE weights
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = [_blocks(c) for c in b["blocks"]]
            found = [[int(y and bool(t.strip())) for y, (_, t) in zip(ys, c)] for ys, c in zip(shared.value.decode([features(c) for c in cells]), cells)]
            yield pd.DataFrame({key: b["key"], "main": [[i for i, y in enumerate(f) if y] for f in found], "rest": [[i for i, y in enumerate(f) if not y] for f in found]})

    return pages.where(F.size(blocks) > 0).select(F.col(key).alias("key"), F.col(blocks).alias("blocks")).mapInPandas(run, f"`{key}` {kind}, main array<int>, rest array<int>")
