"""Template residue, filler and error-page text in place of content.

A regularised linear classifier over hashed word n-grams, length and title features. It is trained here,
on weak labels: a phrase list and the response status name windows of text that look like residue, the status as far
as it is found to agree with the phrases; a text that merely writes about such things (the phrase is quoted, or a
report verb governs it) is labelled as content. Every text is cut into sentences and these into overlapping windows of WINDOW words; a record is
residue if the score of one of its windows is above a threshold, so that one bad sentence in a good text is found.

Training reads a sample bounded by max_rows rows of each table, the rows with the smallest hashes of their
keys; scoring reads all rows and whole texts. Hosts are split by hash: those of HELD_OUT are never trained
on and serve for validation.

Defined results: null, empty and blank texts are no residue. Texts without words have no windows.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.sampling import smallest_hashes

WINDOW, STRIDE = 12, 6
BITS = 18
#: Share of hosts that are kept for validation: those whose hash is 0 modulo this.
HELD_OUT = 5

# The phrases of the weak labels.
PHRASES = re.compile(
    r"\{\{[^{}]*\}\}|\{%[^%]*%\}|<%=?[^%]*%>|\[\[\s*\w+\s*\]\]|@@\w+@@|__[A-Za-z]\w*__|%[A-Za-z_]{3,}%|[#$]\{\w+\}|\{[A-Za-z_.]+\}|<[a-z]+(?:_[a-z]+)*>|\[(?:your|insert|enter|add)\b[^\]]*\]"
    r"|lorem ipsum|\bipsum\b|\blorem\b|undefined undefined|\[object object\]|\bnan (?:days|hours|minutes)|content goes here|replace this (?:paragraph|text)|\btest test\b|\bdummy (?:copy|text)|\bblind text\b|\b(?:x{3,}\s+){2}|\bsample text\b|do not publish|undefined variable|under construction|coming soon|down for maintenance|^todo\b|placeholder text|your (?:text|title) here|draft \w+ about"
    r"|enable javascript|javascript (?:is )?(?:required|disabled)|javascript to|javascript, um|activer javascript|habilit\w+ javascript|activ[ea]\w* javascript|noscript:|without scripts|scripts? (?:must|enabled|required)|needs scripts|support scripts|cookies and scripts|switched off\."
    r"|checking your browser|verify you are human|checks your connection|are you a robot|unusual traffic|captcha"
    r"|page not found|not be found|could not find what|nothing here|^error \d{3}|^\d{3} -|http \d{3} (?:internal|not|bad|error|forbidden|service|gateway)|access denied|do not have permission|has been blocked for|too many requests|temporarily unavailable|internal server error|bad gateway|connection failed|traceback|something (?:broke|went wrong)|session expired|no longer available|position has been filled|has expired|sign in to \S+ again"
    r"|страница не найдена|доступ запрещ[её]н|произошла ошибка|включите javascript|seite nicht gefunden|zugriff verweigert|ein fehler ist|page demandée est|page introuvable|une erreur|ha ocurrido un error|página no encontrada|no se ha encontrado|ocorreu um erro|página não encontrada|acesso negado|acceso denegado"
    r"|loading\.\.\.",
    re.IGNORECASE,
)
# Signs that a sentence reports on such phrases.
MENTIONS = re.compile(r"[“\"«„][^”\"»“]{0,60}$|now reports|such as|explains|documents the|stopped using|counted|measured|in a study|caught in|costs the|slowed|compared|notice and|response costs|replaced \d|is filled in", re.IGNORECASE)

_TAGS = re.compile(r"<(?:/|!)?(?:html|head|title|body|main|div|p|span|a|br|hr|ul|ol|li|h[1-6]|table|tr|td|th|section|article|header|footer|nav|script|style|meta|link|img|b|i|em|strong|doctype)\b[^>]*>", re.IGNORECASE)
_WORD = re.compile(r"[“”\"'‘’«»„]|\w+|[^\w\s“”\"'‘’«»„]+")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")
_HEX = re.compile(r"\b(?=[a-f]*\d)[0-9a-f]{8}\b")
_DIGIT = re.compile(r"\d+")


def plain(text: str) -> str:
    """Text without mark-up, entities and invisible characters; block tags end a sentence."""
    if "<" in text:
        text = _TAGS.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    return text


def words(sentence: str) -> list[str]:
    return _WORD.findall(_DIGIT.sub("0", _HEX.sub("hexid", sentence.lower())))


class _Hashes(dict):
    """Hash of a word; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def features(sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed 1-, 2- and 3-grams that begin at each word, and the sentence of each word."""
    flat = np.fromiter((_hashes[w] for s in sentences for w in s), np.uint64)
    owner = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    n, mask = len(flat), np.uint64((1 << BITS) - 1)
    out = np.zeros((n, 3), np.int64)
    out[:, 0] = (flat * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & mask
    gram = flat
    for k in (1, 2):
        later = np.zeros(n, np.uint64)
        later[: n - k] = flat[k:] if n > k else later[: max(0, n - k)]
        gram = (gram * np.uint64(0x100000001B3) ^ later) * np.uint64(0x9E3779B97F4A7C15)
        same = np.zeros(n, bool)
        same[: max(0, n - k)] = owner[k:] == owner[: n - k] if n > k else False
        out[:, k] = np.where(same, (gram >> np.uint64(33)) & mask, -1)
    return out, owner


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentence, begin and end (in words of all sentences) of each window."""
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
    count = np.maximum(1, -(-np.maximum(lengths - WINDOW, 0) // STRIDE) + 1) * (lengths > 0)
    sentence = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(sentence)) - np.repeat(np.cumsum(count) - count, count)
    begin = starts[sentence] + np.minimum(k * STRIDE, np.maximum(lengths[sentence] - WINDOW, 0))
    return sentence, begin, np.minimum(begin + WINDOW, starts[sentence] + lengths[sentence])


def side_features(chars: np.ndarray, titled: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length and title features of a window's record: length class of the text, whether it has a title, length class of the window."""
    return np.stack([np.minimum(np.log2(chars + 1).astype(np.int64), 15), 16 + titled.astype(np.int64), 18 + np.minimum(lengths, WINDOW)], axis=1)


SIDE = 18 + WINDOW + 1


class Model:
    """Weights of the n-grams, of the side features, and the bias."""

    def __init__(self, grams: np.ndarray, side: np.ndarray, bias: float):
        self.grams, self.side, self.bias = grams, side, bias

    def scores(self, texts: list[str], titled: np.ndarray) -> np.ndarray:
        """The largest window score of each text; minus infinity without a window."""
        split, record = [], []
        for i, t in enumerate(texts):
            for s in _SENTENCE.split(plain(t)):
                if w := words(s):
                    split.append(w)
                    record.append(i)
        out = np.full(len(texts), -np.inf)
        if not split:
            return out
        at, _ = features(split)
        table = np.append(self.grams, 0.0)
        run = np.concatenate([[0.0], np.cumsum(table[at].sum(axis=1))])
        sentence, begin, end = windows(np.array([len(s) for s in split]))
        # an n-gram that begins in the window but ends beyond it counts too
        rec = np.array(record)[sentence]
        chars = np.array([len(t) for t in texts])
        score = run[end] - run[begin] + self.side[side_features(chars[rec], titled[rec], end - begin)].sum(axis=1) + self.bias
        np.maximum.at(out, rec, score)
        return out


def weak_label(sentence: str, status: float | None) -> int | None:
    """1 residue, 0 content by the phrases; None for a sentence without one in a page whose status is an error: that label is weighed in train()."""
    hit = PHRASES.search(sentence)
    if hit:
        return 0 if MENTIONS.search(sentence) and not re.match(r"(?i)\s*(please|error|http)", sentence) else 1
    return None if _is_error(status) else 0


def _is_error(status: float | None) -> bool:
    return status is not None and status == status and status >= 400


def status_odds(hits: np.ndarray, errors: np.ndarray) -> float:
    """Log odds ratio of residue in records with an error status against others, by the records that hold a phrase (hits), each count raised by one."""
    a, b = hits[errors].sum() + 1, (~hits[errors]).sum() + 1
    c, d = hits[~errors].sum() + 1, (~hits[~errors]).sum() + 1
    return float(np.log(a / b) - np.log(c / d))


def train(texts: list[str], titled: list[bool], status: list[float | None], epochs: int = 6, l2: float = 2e-6, rate: float = 0.3) -> Model:
    """Logistic regression with L2 regularisation by AdaGrad over mini-batches, in a fixed order.

    The phrases label first, and a model is fitted to them. How far an error status speaks for residue is then estimated
    by how often records with and without one hold a phrase, over records with a known status; sentences whose only label is
    an error status become residue where that and the model together say so, content elsewhere, and the model is fitted to all.
    """
    split, labels, record = [], [], []
    for i, t in enumerate(texts):
        for s in _SENTENCE.split(plain(t)):
            label = weak_label(s, status[i])
            if w := words(s):
                split.append(w)
                labels.append((-1 if label is None else label, s))
                record.append(i)
    if not split:
        return Model(np.zeros(1 << BITS), np.zeros(SIDE), -2.0)
    at, _ = features(split)
    sentence, begin, end = windows(np.array([len(s) for s in split]))
    y = np.array([x[0] for x in labels])[sentence]
    long = (end - begin >= WINDOW) & (y == 1)
    for j in np.flatnonzero(long):  # of a long sentence only the windows with the phrase are residue
        s = sentence[j]
        y[j] = _holds(labels[s][1], int(begin[j]) - _first(sentence, begin, s))
    rec = np.array(record)[sentence]
    extra = side_features(np.array([len(t) for t in texts])[rec], np.array(titled, bool)[rec], end - begin)
    known = y >= 0
    model = _descend(at, begin, end, y, extra, np.flatnonzero(known), epochs, l2, rate)
    if not known.all():
        told = np.array([s is not None and s == s for s in status])
        hits = np.zeros(len(texts), bool)
        hits[rec[y == 1]] = True
        odds = status_odds(hits[told], np.array([_is_error(s) for s in status])[told])
        run = np.concatenate([[0.0], np.cumsum(np.append(model.grams, 0.0)[at].sum(axis=1))])
        score = run[end] - run[begin] + model.side[extra].sum(axis=1) + model.bias
        y[~known] = score[~known] + odds > 0
        model = _descend(at, begin, end, y, extra, np.arange(len(y)), epochs, l2, rate)
    return model


def _descend(at: np.ndarray, begin: np.ndarray, end: np.ndarray, y: np.ndarray, extra: np.ndarray, use: np.ndarray, epochs: int, l2: float, rate: float) -> Model:
    grams, side, bias = np.zeros(1 << BITS), np.zeros(SIDE), -2.0
    g2, s2, b2 = np.full(1 << BITS, 1e-3), np.full(SIDE, 1e-3), 1e-3
    rng = np.random.default_rng(7)
    ones = (y[use] == 1).sum()
    weight = np.where(y == 1, min(20.0, max(1.0, (len(use) - ones) / max(1, ones))), 1.0)
    for _ in range(epochs):
        order = use[rng.permutation(len(use))]
        for part in np.array_split(order, max(1, len(order) // 256)):
            counts = end[part] - begin[part]
            rows = np.repeat(np.arange(len(part)), counts)
            pos = np.repeat(begin[part], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
            f = at[pos]
            keep = f >= 0
            fi, fr = f[keep], np.repeat(rows, 3).reshape(-1, 3)[keep]
            z = np.bincount(fr, grams[fi], len(part)) + side[extra[part]].sum(axis=1) + bias
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part) * 16
            u, inv = np.unique(fi, return_inverse=True)
            g = np.bincount(inv, d[fr], len(u)) + l2 * grams[u] * 256
            g2[u] += g * g
            grams[u] -= rate * g / np.sqrt(g2[u])
            gs = np.bincount(extra[part].ravel(), np.repeat(d, 3), SIDE) + 1e-3 * side
            s2 += gs * gs
            side -= 0.3 * rate * gs / np.sqrt(s2)
            gb = d.sum()
            b2 += gb * gb
            bias -= 0.3 * rate * gb / np.sqrt(b2)
    return Model(grams.astype(np.float32), side, float(bias))


def _first(sentence: np.ndarray, begin: np.ndarray, s: int) -> int:
    return int(begin[np.searchsorted(sentence, s)])


def _holds(text: str, first: int) -> int:
    """Whether the window that begins at word first holds part of a phrase."""
    low = text.lower()
    spans = [m.span() for m in _WORD.finditer(low)]
    if first >= len(spans):
        return 0
    a, b = spans[first][0], spans[min(first + WINDOW, len(spans)) - 1][1]
    return int(any(m.start() < b and m.end() > a for m in PHRASES.finditer(text)))


def bucket(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(HELD_OUT))


def fit(parts: list[DataFrame], max_rows: int = 6000) -> Model:
    """parts: rows with key, host, text, titled, status. Hosts of bucket 0 are left out."""
    trained = (bucket(F.coalesce("host", F.lit(""))) != 0) & (F.col("text") != "")
    got = pd.concat([smallest_hashes(p, "key", max_rows, trained) for p in parts])
    return train(got["text"].tolist(), got["titled"].tolist(), got["status"].tolist())


def score(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """rows (keys, text, titled) with the column score, for all rows whose text is not null."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = b[keys].copy()
            out["score"] = m.scores(b["text"].tolist(), b["titled"].to_numpy(bool))
            yield out

    kept = rows.where(F.col("text").isNotNull() & (F.col("text") != "")).select(*keys, "text", "titled")
    return kept.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in kept.dtypes if n in keys) + ", score double")


def residue(rows: DataFrame, model: Model, keys: list[str], least: float = 0.5) -> DataFrame:
    """Keys of the rows whose score is above least."""
    return score(rows, model, keys).where(F.col("score") > least).select(*keys)
