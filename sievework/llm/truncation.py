"""Texts that were cut at a field limit or in mid-transfer, and how often each source cuts.

A stack automaton reads the whole text once: it pushes opening quotes, brackets and tags and pops their
closers, and looks at how the text stops. Evidence that a text was cut:

* marker: it ends with a sign of omission (an ellipsis, [...], (continued) and the like);
* broken: it ends within a character (replacement sign), an entity, an escape or a tag;
* open: a quote or bracket opened in the last sentence, or a tag, is never closed;
* dangling: its last word needs another one (an abbreviation such as "No.", a bare version number);
* unended: its last sentence has no terminator, though one before it has;
* torn: its last word has no terminator, occurs nowhere else in the table and begins a word that does;
* bare: it is one sentence without a terminator. This is weighed against the source's baseline: where most
  records of a source end bare, a bare end alone says nothing. Texts with other evidence have no part in the
  baseline; a source of which they are a quarter of the bare ones or more cuts, and has none. Sources of few
  texts have the baseline of the table.

Closing lines (a label with a list or address, a dash with name and date, a remark in brackets) and complete
notices of broken pages need no terminator.

Defined results: null, empty and blank texts are no case. A null source has a baseline of its own.
Repeated rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.residue import PHRASES
from sievework.session import materialise

# How texts are marked as cut, terminators, pairs of quotes and brackets, and abbreviations that want a word after them.
_MARKER = re.compile(r"(?:…|\.\.\.|\[(?:…|\.\.\.|\+\d+[^\]]*)\]|\((?:continued|cont\.?|more|to be continued|fortsetzung folgt|suite|continúa|continua|продолжение следует)\)|\b(?:read more|weiterlesen|lire la suite|leer más|leia mais|читать далее)|»{2}|→)\s*$", re.IGNORECASE)
_BROKEN = re.compile(r"(?:�+|&(?:#x?[0-9a-fA-F]*|[A-Za-z]{1,8})|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9A-F]?(?<=\S%)(?<=[0-9A-F]{2}%)|<)\s*$")
_TAG_START = re.compile(r"</?[A-Za-z]")
_DANGLING = re.compile(r"(?:^|[\s(])(?:No|Nos|Nr|Fig|Figs|Sec|Sect|Ch|Chap|Eq|Tab|Vol|pp|p|approx|ca|cf|vs|e\.g|i\.e|z\.B|d\.h|p\.ej|p\.ex|т\.е|напр|см|incl|excl|esp|Dr|Mr|Mrs|Ms|Prof|St|bzw|ggf|Art|Abs|the U\.S|the U\.K|the E\.U)\.\s*$")
_NUMBER = re.compile(r"(?i)(?:\b(?:version|v|near|of|at|by|about|approximately|section|release)|[$€£])\s*\d[\d,]*\.\s*$")
_CLOSING = re.compile(
    r"^(?:[^\W\d_][\w-]*(?: [\w-]+)?: .*[\w/]|[—–] [^\W\d_].*, \d{1,2}\.? [^\W\d_]+(?: \d{4})?|https?://\S+|.*\((?:updated|aktualisiert|actualizado|atualizado|mis à jour|обновлено|edited|ends)\))$",
    re.IGNORECASE | re.DOTALL,
)
_BREAK = re.compile(r"(?<=[.!?。])[”\"»]?\s+")
_HASH = re.compile(r"\b(?=[a-f]*\d)[0-9a-f]{8}\)?$", re.IGNORECASE)
_HOLE = re.compile(r"(?:\}|>|\]|@@|__|%|NaN|undefined)$")
_OPENER = re.compile(r"[“„«(\[{「『（\"<]")
_OPEN = {"“": "”“", "„": "“”", "«": "»", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）"}
# Elements that need an end tag; a tag that a text only writes about has no content at its end.
_TAG = r"</?(?:a|abbr|article|b|blockquote|button|code|div|em|figure|font|form|h[1-6]|i|label|main|ol|pre|q|script|section|small|span|strong|style|sub|sup|table|u|ul)(?:\s[^<>]*)?>"
_SIGNS = re.compile(rf"[“”„«»()\[\]{{}}「」『』（）\"]|(?<=[.!?])\s|(?i:{_TAG}(?![ ,.;:)]|$)|(?=</){_TAG})")


def _open_at_end(text: str) -> bool:
    """Whether something opened in the last sentence is still open at the end.

    A sentence that ends outside of quotes takes what it left open with it, as writers forget closers. Elements
    may hold many sentences, so tags stay open.
    """
    stack: list[str] = []
    tags: list[str] = []
    straight = False
    for m in _SIGNS.finditer(text):
        c = m[0]
        if len(c) > 1:
            name = re.split(r"[\s>]", c.strip("</").lower(), maxsplit=1)[0]
            if c[1] != "/":
                tags.append(name)
            elif name in tags:
                while tags.pop() != name:
                    pass
        elif c == '"':
            straight = not straight
        elif stack and c in _OPEN[stack[-1]]:
            stack.pop()
        elif c in _OPEN:
            stack.append(c)
        elif c.isspace() and not {"“", "„", "«"} & set(stack):
            stack.clear()
    return bool(stack or tags) or straight


_CLOSERS = "”\"»“’)]）」』 \t\r\n\x0b\x0c\x85\xa0\u3000"


def _last_sentence(end: str) -> str:
    """The text after the last break between sentences, however far back that is: sought in windows that double."""
    size = 512
    while True:
        start, at = max(0, len(end) - size), None
        for m in _BREAK.finditer(end, start):
            at = m.end()
        if at is not None or start == 0:
            return end[at or 0 :]
        size *= 2


def _last_words(end: str) -> str:
    """The end of a text that marks of omission, abbreviations, entities and escapes can fill, never cut within a word or a bracket."""
    start = max(0, len(end) - 60)
    if end.endswith("]"):
        start = min(start, max(0, end.rfind("[")))
    while start and not end[start - 1].isspace():
        start -= 1
    return end[start:]


def _in_tag(end: str) -> bool:
    """Whether the text ends within a tag, however long."""
    at = end.rfind("<")
    return at >= 0 and ">" not in end[at:] and bool(_TAG_START.match(end, at))


def evidence(text: str) -> str | None:
    """The first kind of evidence that the text was cut, or None."""
    # how a text stops is read from its end; what it leaves open is followed from its beginning
    end = text.rstrip()
    if not end:
        return None
    tail = _last_words(end)
    closed = end.rstrip(_CLOSERS)
    if closed and closed[-1] in ".!?。！？．｡؟":
        if end[-1] == "." and end[-3:] == "..." or end[-1] in "…)]":
            if _MARKER.search(tail):
                return "marker"
        if _DANGLING.search(tail) or _NUMBER.search(tail):
            return "dangling"
        if _in_tag(end):
            return "broken"
        return "open" if _OPENER.search(end) and _open_at_end(end) else None
    last = _last_sentence(end)
    if _HASH.search(last) or PHRASES.search(last) and _HOLE.search(last):
        return None
    if _MARKER.search(tail):
        return "marker"
    if _BROKEN.search(tail) or _in_tag(end):
        return "broken"
    return None if _CLOSING.search(last) else "bare"


_SENTENCE = re.compile(r"[^\W\d_]{2}[”\"»)]?[.!?][”\"»)]?\s|[。！？]")
_WORD = r"[\p{L}\p{M}]+"


def firm_evidence(text: str) -> str | None:
    """As evidence, but of bare texts those that are cut whatever their source does are told apart."""
    kind = evidence(text)
    if kind != "bare":
        return kind
    if _OPENER.search(text) and _open_at_end(text.rstrip()):
        return "open"
    return "unended" if _SENTENCE.search(text) else "bare"


def torn_words(texts: DataFrame, lasts: DataFrame) -> DataFrame:
    """Of the words in column last those that occur in no text but at its bare end, and begin one that does."""
    inner = F.split(F.regexp_replace(F.lower("text"), _WORD + r"\s*$", ""), r"[^\p{L}\p{M}]+")
    words = texts.select(F.explode(F.array_distinct(inner)).alias("word")).distinct()
    starts = words.where(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substr("word", F.lit(1), n))).alias("last"))
    return lasts.join(words, F.col("last") == F.col("word"), "left_anti").join(starts, "last", "left_semi")


def judge(rows: DataFrame, keys: list[str], source: str, text: str, most_bare: float = 0.5, least_texts: int = 20) -> DataFrame:
    """All rows with a filled text: keys, source, and cut, whether the text was cut.

    most_bare: a source of which a larger share ends bare is taken to write so.
    least_texts: a source with fewer texts that are whole or bare is judged by those of all sources.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*keys, F.col(source).alias("source")).dtypes) + ", evidence string, last string"
    final = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f])+$")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[*keys, "source"]].copy()
            out["evidence"] = [firm_evidence(t) for t in b["text"]]
            out["last"] = [m[0].lower() if e == "bare" and (m := final.search(t.rstrip())) else None for e, t in zip(out["evidence"], b["text"])]
            yield out

    filled = rows.where(F.trim(text) != "").select(*keys, F.col(source).alias("source"), F.col(text).alias("text"))
    judged = materialise(filled.mapInPandas(run, schema), "cut-evidence")
    torn = torn_words(filled, judged.where("last is not null").select("last").distinct()).select(F.col("last").alias("__torn"))
    judged = judged.join(torn, F.col("last") == F.col("__torn"), "left").withColumn("evidence", F.when(F.col("__torn").isNotNull(), "torn").otherwise(F.col("evidence"))).drop("last", "__torn")

    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    kinds = judged.groupBy(F.col("source").alias("__source")).agg(count(F.col("evidence") == "bare").alias("bare"), count(F.col("evidence").isNull()).alias("whole"), count(F.col("evidence").isin("torn", "open", "unended")).alias("firm"))
    pooled = kinds.agg(F.struct(*[F.sum(c).alias(f"all_{c}") for c in ("bare", "whole", "firm")])).scalar()
    writes = lambda p: (F.col(f"{p}bare") > most_bare * (F.col(f"{p}bare") + F.col(f"{p}whole"))) & (4 * F.col(f"{p}firm") < F.col(f"{p}bare"))
    own = F.col("bare") + F.col("whole") >= least_texts
    baseline = kinds.withColumn("__all", pooled).select("*", "__all.*").select("__source", F.when(own, writes("")).otherwise(writes("all_")).alias("__bare"))
    cut = F.coalesce((F.col("evidence") != "bare") | ((F.col("evidence") == "bare") & ~F.col("__bare")), F.lit(False))
    return judged.join(baseline, F.col("source").eqNullSafe(F.col("__source"))).select(*keys, "source", cut.alias("cut"))


def rates(judged: DataFrame) -> DataFrame:
    """source, n_texts, n_cut, share_cut."""
    n_cut = F.sum(F.when(F.col("cut"), 1).otherwise(0))
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), n_cut.alias("n_cut"), (n_cut / F.count(F.lit(1))).alias("share_cut"))
