"""Timestamps of mixed forms, precisions and zones, brought to one instant in UTC.

Raw strings are first reduced to the distinct (value, zone of the source, date order of the
source). Each distinct value is parsed once, by expressions that stay in the JVM, and the
outcome is kept in a dictionary table that later runs extend; rows get their instant by a join.

Defined results: a null, empty or blank value, a value without a time of day, a day or time that
does not exist, an unknown zone name, and a wall time whose source has no known zone give null.
A wall time that occurs twice means the first; one that is skipped is read with the offset that
was in force before. Digits beyond microseconds are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import children, shared_dir

# Month names by language, as they are written in dates.
MONTHS = {
    1: "jan january januar jänner janvier janv enero ene janeiro января январь янв",
    2: "feb february februar février fevrier févr fevr febrero fevereiro fev февраля февраль фев",
    3: "mar march märz maerz mrz mars marzo março marco марта март мар",
    4: "apr april avril avr abril abr апреля апрель апр",
    5: "may mai mayo maio мая май",
    6: "jun june juni juin junio junho июня июнь июн",
    7: "jul july juli juillet juil julio julho июля июль июл",
    8: "aug august août aout agosto ago августа август авг",
    9: "sep sept september septembre septiembre setembro set сентября сентябрь сен",
    10: "oct october oktober okt octobre octubre outubro out октября октябрь окт",
    11: "nov november novembre noviembre novembro ноября ноябрь ноя",
    12: "dec december dezember dez décembre decembre déc diciembre dic dezembro декабря декабрь дек",
}
# Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "brt": -180,
}

_ZONE = r"((?:UTC|GMT)?[+\-−]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5})?\s*(?:\[([A-Za-z0-9_+\-/]+)\])?"
_CLOCK = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(?:Uhr)?\s*([AaPp]\.?[Mm]\.?(?![A-Za-z]))?\s*"
_AT = r",?(?:\s+(?:à|at|um|às|as|a\s+las|в))?\s+"
#: name, pattern, and the pattern's groups in the order: year, month or its name, day, hour, minute, second, fraction, half of day, offset, zone.
_FORMS = (
    ("year_first", rf"(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]|{_AT}){_CLOCK}{_ZONE}", "1 2 3 4 5 6 7 8 9 10"),
    ("compact", rf"(\d{{4}})(\d{{2}})(\d{{2}})T?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?()\s*{_ZONE}", "1 2 3 4 5 6 7 8 9 10"),
    ("month_day_numbers", rf"(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_AT}{_CLOCK}{_ZONE}", "3 1 2 4 5 6 7 8 9 10"),
    ("day_month_numbers", rf"(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_AT}{_CLOCK}{_ZONE}", "3 2 1 4 5 6 7 8 9 10"),
    ("day_name", rf"(?:[\p{{L}}]+\.?,?\s+)?(\d{{1,2}})\.?(?:\s+de)?[\s-]+([\p{{L}}]+)\.?(?:\s+de)?,?[\s-]+(\d{{4}}){_AT}{_CLOCK}{_ZONE}", "3 2 1 4 5 6 7 8 9 10"),
    ("name_day", rf"(?:[\p{{L}}]+\.?,?\s+)?([\p{{L}}]+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_AT}{_CLOCK}{_ZONE}", "3 1 2 4 5 6 7 8 9 10"),
)
_FIELDS = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "offset", "zone")
#: Version of the forms above; a dictionary of another version is never read.
VERSION = 1


def _zones(spark: SparkSession) -> list[str]:
    return sorted(str(z) for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def _fields(raw: Column, order: Column) -> Column:
    """The parts of a value, as an array of strings in the order of _FIELDS; null if no form fits."""
    out = F.lit(None).cast("array<string>")
    for name, pattern, groups in reversed(_FORMS):
        fits = raw.rlike(f"^{pattern}$")
        if name == "month_day_numbers":
            fits &= order.eqNullSafe("mdy")
        parts = F.split(F.regexp_replace(raw, f"^{pattern}$", "|".join(f"${g}" for g in groups.split())), r"\|", -1)
        out = F.when(fits, parts).otherwise(out)
    return out


def with_instant(spark: SparkSession, values: DataFrame) -> DataFrame:
    """values (raw, zone, date_order) with micros: microseconds since 1970 in UTC, or null if raw denotes no instant.

    The steps are columns of their own, so that each pattern runs once for a value.
    """
    number = lambda k: F.col("p")[_FIELDS.index(k)].try_cast("int")
    part = lambda k: F.col("p")[_FIELDS.index(k)]
    month = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for s in names.split() for x in (s, n)])
    east = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    epoch = r"^(\d{10})(?:\.?(\d{3}|\d{6}|\d{9}))?$"
    half = F.lower(F.substring(part("half"), 1, 1))
    hour = F.when(half == "", number("hour")).when(number("hour").between(1, 12), number("hour") % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.when(part("second") == "", F.lit(0)).otherwise(number("second"))
    micro = F.when(part("fraction") == "", F.lit(0)).otherwise(F.rpad(F.substring(part("fraction"), 1, 6), 6, "0").try_cast("int"))
    offset = F.regexp_replace(F.lower(part("offset")), "^(utc|gmt)(?=.)", "")
    digits = F.regexp_replace(offset, "[^0-9]", "")
    hours = F.when(F.length(digits) <= 2, digits).otherwise(F.regexp_replace(digits, "..$", "")).try_cast("int")
    minutes = F.when(F.length(digits) <= 2, F.lit("0")).otherwise(F.regexp_extract(digits, "(..)$", 1)).try_cast("int")
    wall = F.try_make_timestamp(
        number("year"), F.coalesce(number("month"), F.try_element_at(month, F.lower(part("month")))), number("day"), hour, number("minute"),
        F.when(second < 60, second).cast("decimal(8,6)"), F.lit("UTC"),
    )
    return (
        values.withColumn("text", F.regexp_replace("raw", r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
        .withColumn("p", _fields(F.col("text"), F.col("date_order")))
        .withColumn("wall", F.unix_micros(wall) + micro)
        .withColumn("hours", hours).withColumn("minutes", minutes).withColumn("offset", offset)
        .withColumn("named", F.when(part("zone") != "", part("zone")).otherwise(F.col("zone")))
        .withColumn("named", F.when(F.col("named").isin(_zones(spark)), F.col("named")))
        .withColumn("east", F.when(F.col("hours").isNull(), F.try_element_at(east, F.col("offset"))).when(F.col("hours").between(0, 18) & F.col("minutes").between(0, 59), (F.col("hours") * 60 + F.col("minutes")) * F.when(F.col("offset").startswith("+"), 1).otherwise(-1)))
        .withColumn("micros",
            F.when(F.col("text").rlike(epoch), F.regexp_extract("text", epoch, 1).try_cast("long") * 1_000_000 + F.rpad(F.regexp_extract("text", epoch, 2), 6, "0").substr(1, 6).try_cast("long"))
            .when(F.col("offset") != "", F.col("wall") - F.col("east").cast("long") * 60_000_000)
            .when(F.col("named").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("wall"), F.coalesce("named", F.lit("UTC"))))))
        .drop("text", "p", "wall", "hours", "minutes", "offset", "named", "east")
    )


def instant_text(micros: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.ffffffZ of microseconds since 1970, whatever the session's zone."""
    s = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(micros.cast("decimal(20,0)") / 1000000).cast("decimal(18,6)"))
    t = s.cast("string")
    return F.concat(t.substr(1, 10), F.lit("T"), t.substr(12, 8), F.lit("."), F.rpad(t.substr(21, 6), 6, "0"), F.lit("Z"))


class InstantDictionary:
    """Distinct (raw, zone, date_order) with their instants, kept as a table that only grows.

    Each update adds one batch, written as a folder of its own, so that an update which dies
    halfway leaves nothing that is read. path defaults to a folder in the shared folder of the
    cluster; give another one to keep the dictionary longer than that folder lives.
    """

    SCHEMA = "raw string, zone string, date_order string, micros bigint"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/sievework/instants-v{VERSION}"

    def read(self) -> DataFrame:
        done = [p for p in children(self.spark, self.path) if children_done(self.spark, p)]
        if not done:
            return self.spark.createDataFrame([], self.SCHEMA)
        kept = self.spark.read.schema(self.SCHEMA).parquet(*done)
        # updates at the same time may have parsed the same value; parsing is a function of the key
        return kept.groupBy("raw", "zone", "date_order").agg(F.max("micros").alias("micros"))

    def update(self, values: DataFrame) -> "InstantDictionary":
        """Parse what the dictionary lacks. values: columns raw, zone, date_order, repeats allowed."""
        new = values.where(F.col("raw").isNotNull()).select("raw", F.coalesce("zone", F.lit("")).alias("zone"), F.coalesce("date_order", F.lit("")).alias("date_order")).distinct()
        if children(self.spark, self.path):
            new = new.join(self.read(), ["raw", "zone", "date_order"], "left_anti")
        with_instant(self.spark, new).write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        return self

    def join(self, rows: DataFrame, raw: str, zone: str, order: str, into: str) -> DataFrame:
        """rows with the instant of column raw, as microseconds, in column into; all rows stay."""
        d = self.read().select(*[F.col(c).alias(f"__{c}") for c in ("raw", "zone", "date_order", "micros")])
        on = (F.col(raw) == F.col("__raw")) & (F.coalesce(F.col(zone), F.lit("")) == F.col("__zone")) & (F.coalesce(F.col(order), F.lit("")) == F.col("__date_order"))
        return rows.join(d, on, "left").withColumn(into, F.col("__micros")).drop("__raw", "__zone", "__date_order", "__micros")


def children_done(spark: SparkSession, path: str) -> bool:
    from sievework.session import exists

    return exists(spark, f"{path}/_SUCCESS")


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, or ''."""
    return F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#\s]+)", 1)


def pages_values(pages: DataFrame) -> DataFrame:
    """One row for each filled date field of FetchedPage rows: tbl, ordinal, field_name, raw, host."""
    fields = ("published_at", "updated_at", "observed_at")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields]))
    return pages.select("ordinal", "host", each.alias("v")).select(F.lit("fetched_pages").alias("tbl"), "ordinal", "v.field_name", "v.raw", "host")


def b1_values(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("b1_rows").alias("tbl"), "ordinal", F.lit("published_at").alias("field_name"), F.col("published_at").alias("raw"), host_of(F.col("url")).alias("host"))


def normalise_instants(spark: SparkSession, values: DataFrame, sites: DataFrame, path: str | None = None) -> DataFrame:
    """values (raw, host and any others) with the column micros: the instant in UTC or null.

    A host that sites lacks has no zone. sites must hold one row for each host.
    """
    place = sites.select(F.col("host").alias("__host"), F.col("time_zone").alias("__tz"), F.col("date_order").alias("__order"))
    placed = values.join(place, F.col("host") == F.col("__host"), "left").drop("__host")
    filled = placed.where(F.trim("raw") != "")
    dictionary = InstantDictionary(spark, path).update(filled.select("raw", F.col("__tz").alias("zone"), F.col("__order").alias("date_order")))
    return dictionary.join(placed, "raw", "__tz", "__order", "micros").drop("__tz", "__order")
