"""Date functions: strict forms only, null for all else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"20\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])|20\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"


_CLOCK = r"(?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?"
#: An ISO date, alone or with a time of day and an offset.
ISO = rf"^\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]{_CLOCK}(?:Z|[+-]{_CLOCK})?)?$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def iso_date(c: Column) -> Column:
    """The date that an ISO date or date-time begins with, in its own offset; with any '/' in it null."""
    plain = stripped(c)
    return F.when(plain.rlike(ISO.replace("$", r"\z")), F.try_to_date(F.substring(plain, 1, 10), "yyyy-MM-dd"))


def utc_date(c: Column) -> Column:
    """The date in UTC of an ISO date or date-time; without an offset it is taken as UTC. Null for all else."""
    # the colons, minutes and seconds that ISO lets writers leave out, which the cast wants
    clock = F.replace(F.replace(stripped(c), F.lit(" "), F.lit("T")), F.lit(","), F.lit("."))
    for found, to in (
        (r"(T.*[+-]\d{2})(\d{2})$", "$1:$2"), (r"^(.{10}T\d{2})(\d{2})", "$1:$2"), (r"^(.{10}T\d{2}:\d{2})(\d{2})", "$1:$2"),
        (r"^(.{10}T\d{2})(?=Z|[+-]|$)", "$1:00"), (r"^(.{10}T\d{2}:\d{2})(?=Z|[+-]|$)", "$1:00"),
    ):
        clock = F.regexp_replace(clock, found, to)
    return F.when(iso_date(c).isNotNull(), F.to_date(clock.try_cast("timestamp")))


def leading_date(c: Column) -> Column:
    """The date in a text's first ten characters, else its date in UTC."""
    plain = stripped(c)
    head = F.substring(plain, 1, 10)
    return F.coalesce(F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(head, "yyyy-MM-dd")), utc_date(plain))


def valid_until(day: Column, days: int) -> Column:
    """The last day on which what was found on day is taken to hold."""
    return F.date_add(day, days)


def recency(c: Column, as_of: Column) -> Column:
    """8, 6, 4 or 2 points up to 30, 180, 365 or 730 days before as_of; 0 before that and without a date. Later dates have no age."""
    days = F.datediff(as_of, utc_date(c))
    age = F.when(days.isNotNull(), F.greatest(F.lit(0), days))
    return F.when(age <= 30, 8.0).when(age <= 180, 6.0).when(age <= 365, 4.0).when(age <= 730, 2.0).otherwise(0.0)


def latest_date(c: Column) -> Column:
    """The latest valid date written in a URL or text, as yyyy-MM-dd, yyyy/MM/dd or eight digits on their own."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?<!\d)({_DATE})(?!\d)"), F.lit(1))
    return F.array_max(F.transform(found, lambda d: F.try_to_date(F.regexp_replace(d, "[-/]", ""), "yyyyMMdd")))


def snowflake_millis(ident: Column) -> Column:
    """Milliseconds since 1970 at which a snowflake id was made, for ids of more than 64 bits too; null where a bigint cannot hold them."""
    # of more than 27 digits no milliseconds fit; the quotient has 8 decimals, enough for none to be rounded up to a whole
    return (F.floor(ident.try_cast("decimal(27,0)") / F.lit(4194304)) + F.lit(1288834974657)).try_cast("bigint")


def status_id(url: Column) -> Column:
    """The digits of the snowflake id in the address of a post on X or Twitter; null for other addresses."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://(?:[^/?#@]*@)?(?:www\.)?(?:x|twitter)\.com/[^?#]*?/status/(\d+)", 1), F.lit(""))


def snowflake_instant(ident: Column) -> Column:
    """Instant that a snowflake id was made; null past the range of timestamps."""
    made = snowflake_millis(ident)
    return F.when(made.between(-9223372036854775, 9223372036854775), F.timestamp_millis(made))


def status_url_instant(url: Column) -> Column:
    """Instant of a post on X or Twitter by the snowflake id in its address; null for other addresses, and past the range of timestamps."""
    return snowflake_instant(status_id(url))


def freshness(as_of: Column, window_days: Column, *dates: Column) -> tuple[Column, Column]:
    """status and age in days: of the first of dates that is a date, against the day as_of.

    Without a window 'not_applicable', without a date 'undated', before as_of 'future_dated', else 'fresh' up to and
    with the window's last day, then 'stale'.
    """
    day = F.coalesce(*[iso_date(d) for d in dates])
    age = F.when(window_days.isNotNull(), F.datediff(iso_date(as_of), day))
    status = F.when(window_days.isNull(), "not_applicable").when(age.isNull(), "undated").when(age < 0, "future_dated").when(age <= window_days, "fresh").otherwise("stale")
    return status, age
