"""One form for texts that look the same but are stored in other characters.

A fixed table, built by rule from the Unicode character database and the look-alike letters below,
says what each code point, and each base letter with combining marks, becomes. Texts are cut into
positioned units: code points that the table may change, base letters with their marks, and the runs
between them, which stay as they are. The units are exploded, joined with the table (broadcast: its
size is bounded by Unicode, not by the data), stacks of marks that the table lacks are put into the
order of their combining classes, and the text is rebuilt from its units and composed (NFC), so that
bases with a mark of their own, kana and jamo meet their composed forms. Texts without any code point
that the table changes are passed through and never exploded.

Kept apart, as the difference shows: accents, letter case, digits, superscripts, fractions, circled
and mathematical letters, kinds of dashes and quotes. White space of any width becomes a space;
line breaks and tabs stay. Invisible format characters are dropped.

Defined results: null stays null and '' stays ''. Text ids must be unique and not null.
Conjoining Hangul jamo become syllables.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import materialise

# Letters of other scripts that look like a Latin letter, each before the letter it looks like.
LOOK_ALIKES = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw ѵv АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX ҮY ԚQ ԜW ԌG "  # Cyrillic
    "οo νv ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϳj ϲc ϹC "  # Greek
    "օo ոn սu հh ցg զq ՍU ՕO ՏS ɡg ‐- ‑- "  # Armenian, Latin, hyphens
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "  # Lisu
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ"  # Cherokee
)
#: Scripts whose letters are only taken for Latin ones in words that hold Latin letters too, where a text is to be read.
_MIXED = r"(?=.*[A-Za-z])(?=.*[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsLisu}\p{IsCherokee}])"


def _like() -> dict[str, str]:
    return {pair[0]: pair[1] for pair in LOOK_ALIKES.split()}


def _plain(ch: str) -> str:
    """Canonical and such compatibility decompositions as look the same."""
    kind, _, rest = unicodedata.decomposition(ch).rpartition(">")
    if kind in ("<wide", "<narrow", "<noBreak"):
        return unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))
    if kind == "<compat" or kind == "<initial" or kind == "<medial" or kind == "<final" or kind == "<isolated":
        to = unicodedata.normalize("NFKD", ch)
        return to if to == " " or all(unicodedata.category(c)[0] == "L" for c in to) and unicodedata.category(ch)[0] in "LN" else ch
    return unicodedata.normalize("NFD", ch)


@lru_cache
def tables(alike: bool = True) -> tuple[dict[str, str], dict[str, int]]:
    """What each unit becomes, and the combining classes of the marks; look-alikes stay unless alike is set."""
    like, single, marks = _like() if alike else {}, {}, {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category in ("Cn", "Co"):
            continue
        if category == "Cf":
            continue
        if unicodedata.combining(ch):
            marks[ch] = unicodedata.combining(ch)
        elif category == "Zs":
            single[ch] = " "
        else:
            to = unicodedata.normalize("NFC", "".join(like.get(c, c) for c in _plain(ch)))
            if to != ch:
                single[ch] = to
    units = dict(single)
    back: dict[str, list[str]] = {}
    for a, b in [*like.items(), *((c, to) for c, to in single.items() if len(to) == 1 and 0xFF00 < ord(c) < 0xFF5F)]:
        back.setdefault(b, []).append(a)
    for cp in range(0xC0, 0x2000):
        whole = unicodedata.normalize("NFD", chr(cp))
        if len(whole) > 1 and not unicodedata.combining(whole[0]) and all(map(unicodedata.combining, whole[1:])):
            to = single.get(chr(cp), unicodedata.normalize("NFC", whole))
            spellings = {whole, *(unicodedata.normalize("NFC", whole[: i + 1]) + whole[i + 1 :] for i in range(len(whole)))}
            if len(whole) == 3:
                swapped = whole[0] + whole[2] + whole[1]
                spellings |= {swapped, unicodedata.normalize("NFC", swapped[:2]) + swapped[2]} if unicodedata.normalize("NFC", swapped) == unicodedata.normalize("NFC", whole) else set()
            for s in spellings:
                for base in (s[0], *back.get(s[0], [])):
                    if len(s) > 1:
                        units.setdefault(base + s[1:], to)
    return units, marks


#: Format characters, variation selectors and fillers: invisible, so dropped.
DROPPED = r"\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}"
MARK = r"\p{Mn}"


@lru_cache
def _still(alike: bool = True, least: int = 4) -> str:
    """Runs of at least so many code points that the table keeps, as a class of a Java pattern.

    The class need not hold all of them, as a code point that is looked up in vain stays as it is;
    it holds few runs, because Java tests them one after another.
    """
    units, _ = tables(alike)
    runs, first = [r"\x{0}-\x{7F}"], None
    for cp in range(0x80, 0x530):
        if chr(cp) in units or unicodedata.category(chr(cp)) in ("Mn", "Cf"):
            if first is not None and cp - first >= least:
                runs.append(rf"\x{{{first:X}}}-\x{{{cp - 1:X}}}")
            first = None
        elif first is None:
            first = cp
    return "".join(runs) + r"\x{2012}-\x{2029}\x{20AC}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def readable_form(texts: DataFrame, key: list[str], text: str, into: str = "clean") -> DataFrame:
    """As common_form, but for reading: look-alikes become Latin letters only in words that hold Latin ones, so that other scripts stay what they are."""
    whole = common_form(texts, key, text, into, alike=False)
    pairs = _like()
    word = lambda w: F.when(w.rlike(_MIXED), F.translate(w, "".join(pairs), "".join(pairs.values()))).otherwise(w)
    mixed = F.array_join(F.transform(F.split(into, r"(?<=[\s\p{P}])|(?=[\s\p{P}])"), word), "")
    # the cheap test on neighbours spares texts without such a word, which are nearly all
    return whole.withColumn(into, F.when(F.col(into).rlike(r"[A-Za-z][^\x{0}-\x{36F}]|[^\x{0}-\x{36F}][A-Za-z]"), mixed).otherwise(F.col(into)))


def common_form(texts: DataFrame, key: list[str], text: str, into: str = "form", keep: list[str] = (), alike: bool = True) -> DataFrame:
    """The one form of column text, in column into, with the columns key and keep.

    key: columns that tell the rows apart; keep: other small columns, which travel with each unit; alike: whether
    look-alikes are one, as comparisons want it.
    """
    spark = texts.sparkSession
    (units, marks), still = tables(alike), _still(alike)
    # the cheap class goes first: only code points beyond ASCII are held against the long ones
    touched = F.coalesce(F.col(text).rlike(rf"[^\x{{0}}-\x{{7F}}](?<=[{DROPPED}]|[^{still}])"), F.lit(False))
    calm = texts.where(~touched).select(*key, *keep, F.col(text).alias(into))
    moving = texts.where(touched).select(*key, *keep, F.regexp_replace(text, rf"(?:(?=[^\x{{0}}-\x{{7F}}])[{DROPPED}])+", "").alias(into))
    pattern = rf"[^{MARK}]{MARK}+|[\x{{0}}-\x{{7F}}]+(?!{MARK})|(?:(?=[^\x{{0}}-\x{{7F}}])[{still}])+(?!{MARK})|[^{MARK}]|{MARK}"
    each = moving.repartition(*key).select(*key, *keep, F.posexplode(F.regexp_extract_all(F.col(into), F.lit(pattern), F.lit(0))).alias("__pos", "__unit"))
    table = F.broadcast(spark.createDataFrame(list(units.items()), "__from string, __to string"))
    bases = F.broadcast(spark.createDataFrame([(k, v) for k, v in units.items() if len(k) == 1], "__base string, __base_to string"))
    classes = F.map_from_arrays(F.split(F.lit(" ".join(marks)), " "), F.split(F.lit(" ".join(map(str, marks.values()))), " ").cast("array<int>"))
    stack = F.col("__to").isNull() & F.col("__unit").rlike(f"{MARK}$")
    tail = F.transform(F.split(F.substring("__unit", 2, 1_000_000), ""), lambda c, i: F.struct(F.try_element_at(classes, c).alias("n"), i, c.alias("c")))
    ordered = F.when(F.forall(tail, lambda m: m["n"].isNotNull()), F.array_join(F.transform(F.array_sort(tail), lambda m: m["c"]), "")).otherwise(F.substring("__unit", 2, 1_000_000))
    done = (
        each.join(table, F.col("__unit") == F.col("__from"), "left")
        .join(bases, F.when(stack, F.substring("__unit", 1, 1)) == F.col("__base"), "left")
        .select(*key, *keep, "__pos", F.when(stack, F.concat(F.coalesce("__base_to", F.substring("__unit", 1, 1)), ordered)).otherwise(F.coalesce("__to", "__unit")).alias("__unit"))
    )
    whole = done.groupBy(*key).agg(*[F.first(c).alias(c) for c in keep], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__unit"))), lambda u: u["__unit"]), "").alias(into))
    return calm.unionByName(whole.withColumn(into, F.pandas_udf(_composed, "string")(into)))


def same_looks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of rows with the same form but other strings: key_a < key_b.

    Forms and strings are compared by their MD5 digests. They are written to the shared folder once;
    only forms that have more than one string are then joined.
    """
    digest = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    filled = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, text).withColumn("__text", digest(text))
    rows = materialise(common_form(filled, [key], text, "__form", ["__text"]).select(key, "__text", digest("__form").alias("__form")), "forms")
    varied = rows.groupBy("__form").agg(F.min("__text").alias("a"), F.max("__text").alias("b")).where("a <> b").select("__form")
    left = rows.join(varied, "__form", "left_semi")
    right = left.select(F.col(key).alias("key_b"), F.col("__form").alias("__form_b"), F.col("__text").alias("__text_b"))
    return left.join(right, (F.col("__form") == F.col("__form_b")) & (F.col("__text") != F.col("__text_b")) & (F.col(key) < F.col("key_b"))).select(F.col(key).alias("key_a"), "key_b")
