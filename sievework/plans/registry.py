"""Where queries and their SQL are registered, and what the SQL sides share."""

from __future__ import annotations

#: White space, and the parts of an URL, in the dialect of the SQL side.
SP = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]+"
URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SP}', ' ', 'g'))"


def normal(c: str) -> str:
    return f"lower({squeeze(c)})"


def part(c: str, i: int) -> str:
    return f"regexp_extract(trim(coalesce({c}, '')), '{URL}', {i})"


def base(c: str) -> str:
    return f"(CASE WHEN {part(c, 1)} <> '' THEN lower({part(c, 1)}) || ':' ELSE '' END || CASE WHEN {part(c, 2)} <> '' THEN '//' || lower({part(c, 2)}) ELSE '' END)"


def page(c: str) -> str:
    return f"({base(c)} || regexp_replace({part(c, 3)}, '/+$', ''))"


def host(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({part(c, 2)}), '^.*@', ''), ':.*$', ''), '^www\.', '')"


def slug(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9.\-]+', '-', 'g'), '^-+|-+$', '', 'g')"


def tokens(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9][a-z0-9.+#_\-]*'))"


KEY = f"""CASE WHEN coalesce(url, '') <> '' THEN 'url:' || {page('url')}
 WHEN {normal('title')} || '|' || left({normal('text')}, 240) <> '|' THEN 'text:' || left(sha1({normal('title')} || '|' || left({normal('text')}, 240)), 16)
 ELSE 'row:' || lpad(ordinal::VARCHAR, greatest(4, length(ordinal::VARCHAR))::INTEGER, '0') END"""
KEYED = f"k AS (SELECT *, {KEY} AS copy_key FROM false_positive_evidence)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
