"""Text, URL and hash functions: Column to Column, without Python in the row path."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, spelled so that Java's and RE2's patterns agree.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]+"
#: A token: begins with an ASCII letter or digit; other letters split tokens.
TOKEN = r"[a-z0-9][a-z0-9.+#_\-]*"


def filled(*cols: Column) -> Column:
    """The first column that is neither null nor '', else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces and stripped; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def normal(c: Column) -> Column:
    """As squeeze, in lower case."""
    return F.lower(squeeze(c))


def tokens(c: Column) -> Column:
    """The distinct tokens of a text, in order of first occurrence; of null or '' none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1)))


def content_hash(c: Column) -> Column:
    return F.sha2(normal(c), 256)


_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), _URL, i)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def host(url: Column) -> Column:
    """Lower-case host without credentials, port and a leading www."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), ":.*$", ""), r"^www\.", "")


def _base(url: Column) -> Column:
    return F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""), F.when(netloc(url) != "", F.concat(F.lit("//"), netloc(url))).otherwise(""))


def canonical_page(url: Column) -> Column:
    """Scheme and host in lower case, no query, fragment or trailing slashes; the root path is empty."""
    return F.concat(_base(url), F.regexp_replace(path(url), "/+$", ""))


def canonical_resource(url: Column) -> Column:
    """As canonical_page, but repeated slashes collapse, the query stays and the root path is '/'."""
    p = F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), "/$", "")
    return F.concat(_base(url), F.when(p == "", "/").otherwise(p), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))


def canonical_posting(url: Column) -> Column:
    """Scheme, host and path without trailing slashes; the root path, and an empty URL, are '/'."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.concat(_base(url), F.when(p == "", "/").otherwise(p))


def copy_key(url: Column, title: Column, text: Column, ordinal: Column) -> Column:
    """Key under which rows are copies: canonical URL, else the hash of title and the text's first 240 characters, else the row."""
    body = F.concat(normal(title), F.lit("|"), F.substring(normal(text), 1, 240))
    return (
        F.when(filled(url) != "", F.concat(F.lit("url:"), canonical_page(url)))
        .when(body != "|", F.concat(F.lit("text:"), F.substring(F.sha1(body), 1, 16)))
        .otherwise(F.format_string("row:%04d", ordinal))
    )


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9.\-]+", "-"), "^-+|-+$", "")


def origin_key(url: Column, publisher: Column, row_id: Column, family: Column | None = None, organization: Column | None = None) -> Column:
    """Who stands behind a row: its family, organization or publisher, else the code repository, else the host, else the row itself."""
    h, parts = host(url), F.filter(F.split(path(url), "/"), lambda p: p != "")
    repo = h.isin("github.com", "gitlab.com") & (F.size(parts) >= 2)
    named = [("family:", family), ("organization:", organization), ("publisher:", publisher)]
    return F.coalesce(
        *[F.when(filled(c) != "", F.concat(F.lit(label), slug(c))) for label, c in named if c is not None],
        F.when(repo, F.concat(F.lit("repo:"), h, F.lit("/"), slug(F.get(parts, F.lit(0))), F.lit("/"), slug(F.get(parts, F.lit(1))))),
        F.when(h != "", F.concat(F.lit("host:"), h)),
        F.concat(F.lit("row:"), slug(filled(row_id, F.lit("unknown")))),
    )


def bare_netloc(url: Column) -> Column:
    """The authority of a URL in lower case, with port, without a leading www."""
    return F.regexp_replace(netloc(url), r"^www\.", "")


def poster_key(url: Column, author: Column, publisher: Column) -> Column:
    """Who stands behind a row of a target: on boards where people post, board and author, else the host, else the canonical URL."""
    h, who = bare_netloc(url), F.regexp_replace(F.regexp_replace(F.lower(filled(author, publisher)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    board = h.isin("x.com", "twitter.com", "reddit.com") & (who != "")
    return F.when(board, F.concat(h, F.lit(":"), who)).when(h != "", h).otherwise(canonical_resource(url))


def family_key(url: Column, family: Column, publisher: Column, row_id: Column) -> Column:
    """What a preview shows one row of: a family or publisher, else a host, else the row."""
    name, h = F.lower(squeeze(filled(family, publisher))), bare_netloc(url)
    return F.when(name != "", F.concat(F.lit("publisher:"), name)).when(h != "", F.concat(F.lit("host:"), h)).otherwise(F.concat(F.lit("row:"), row_id.cast("string")))


_HOSTPORT = r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)(?::(\d*))?$"


def public_url(url: Column) -> Column:
    """Origin and path of a web address, without query, fragment and a default port; '' for other addresses and those with credentials."""
    h, port = F.rtrim(F.regexp_extract(netloc(url), _HOSTPORT, 1), F.lit(".")), F.regexp_extract(netloc(url), _HOSTPORT, 2)
    usual = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443")) | (port == "")
    named = F.concat(scheme(url), F.lit("://"), h, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))
    usable = scheme(url).isin("http", "https") & (h != "") & ~F.contains(netloc(url), F.lit("@"))
    return F.when(usable, F.concat(named, F.when(path(url) == "", "/").otherwise(path(url)))).otherwise("")


def shown_url(url: Column) -> Column:
    """A URL as warnings may show it: without credentials, query and fragment."""
    h, port = F.regexp_extract(netloc(url), _HOSTPORT, 1), F.regexp_extract(netloc(url), _HOSTPORT, 2)
    where = F.concat(h, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""))
    return F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""), F.when(where != "", F.concat(F.lit("//"), where)).otherwise(""), path(url))


def quoted(c: Column) -> Column:
    """A text as a value in a query string: blanks as '+', all but letters, digits and _.-~ in percent form."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


# Words that say nothing in a search for repositories.
REPOSITORY_WORDS = r"(?i)\b(?:github|open source|repo|repositories)\b"


def repository_query(c: Column) -> Column:
    """A search without hash signs and the words of REPOSITORY_WORDS; as it was if nothing is left."""
    left = squeeze(F.regexp_replace(F.regexp_replace(c, r"#(?=\w)", ""), REPOSITORY_WORDS, " "))
    return F.when(left == "", c).otherwise(left)


def with_terms(query: Column, *terms: str) -> Column:
    """A query with those of the terms that it does not hold."""
    flat = normal(query)
    return F.trim(F.array_join(F.array_compact(F.array(query, *[F.when(~F.contains(flat, F.lit(" ".join(t.lower().split()))), F.lit(t)) for t in terms])), " "))


def without_words(query: Column, words: tuple[str, ...]) -> Column:
    """The words of a query but for those listed; as it was if nothing is left."""
    kept = F.filter(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"([\p{L}\p{N}_.+#\-]+)"), F.lit(1)), lambda w: ~F.lower(w).isin(*words))
    return F.when(F.size(kept) == 0, query).otherwise(F.array_join(kept, " "))


def found_urls(c: Column) -> Column:
    """URLs written in a text, first occurrences in order, without closing punctuation."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(https?://[^\s<>\"'()\[\]]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def linked_urls(c: Column) -> Column:
    """(title, url) of the addresses in a text: Markdown links with their titles first, then bare ones titled by their host; each address once.

    Full stops and commas at the end of an address do not belong to it.
    """
    text = F.coalesce(c, F.lit(""))
    marked = F.regexp_extract_all(text, F.lit(r"(\[[^\]]+\]\(https?://[^\s)]+\))"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\])]+)"), F.lit(1))
    clean = lambda u: F.regexp_replace(u, r"[.,]+$", "")
    titled = F.transform(marked, lambda m: F.struct(F.substring(squeeze(F.regexp_extract(m, r"^\[([^\]]+)\]", 1)), 1, 300).alias("title"), clean(F.regexp_extract(m, r"\]\((.*)\)$", 1)).alias("url")))
    plain = F.transform(bare, lambda u: F.struct(F.regexp_extract(u, "^https?://([^/?#]*)", 1).alias("title"), clean(u).alias("url")))
    every = F.filter(F.concat(titled, plain), lambda x: F.regexp_extract(x["url"], "^https?://([^/?#]+)", 1) != "")
    order = F.array_distinct(F.transform(every, lambda x: x["url"]))
    return F.transform(order, lambda u: F.struct(F.get(F.filter(every, lambda x: x["url"] == u), F.lit(0))["title"].alias("title"), u.alias("url")))


def holds_term(text: Column, term: str) -> Column:
    """Whether a normalised text holds a term; terms of up to four ASCII characters only as whole words."""
    t = term.lower()
    if len(t) <= 4 and t.isascii():
        return text.rlike(rf"(?<![a-z0-9])\Q{t}\E(?![a-z0-9])")
    return F.contains(text, F.lit(t))


def facet_slug(c: Column) -> Column:
    """Lower case, runs of other than letters and digits as '_'; 'facet' for nothing."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("facet"))


def compact(c: Column, most: int = 120) -> Column:
    return F.substring(squeeze(c), 1, most)


# What stands between the sides of a comparison, and words at the end of a side that name no side.
BETWEEN, GENERIC_ENDS = ("versus", "vs.", "vs", "compared to"), ("inference engine", "inference engines", "framework", "frameworks", "project", "projects", "repositories", "comparison")


def comparison_sides(c: Column) -> Column:
    """The sides of a comparison in their order, each once and without a closing generic word; none if nothing is compared."""
    # each word between sides becomes a mark that no text holds, on a text with single blanks
    mark, flat = "\u0001", squeeze(c)
    for word in BETWEEN:
        flat = F.regexp_replace(flat, rf"(?i) \Q{word}\E(?= )", mark)
    ends = "|".join(rf"\Q{w}\E" for w in GENERIC_ENDS)
    sides = F.transform(F.split(flat, mark), lambda x: F.regexp_replace(F.regexp_replace(x, rf"(?i) (?:{ends})\s*$", ""), r"^[\s,:;-]+|[\s,:;-]+$", ""))
    return F.when(F.contains(flat, F.lit(mark)), F.array_distinct(F.filter(sides, lambda x: x != ""))).otherwise(F.array().cast("array<string>"))


def path_reference(path: Column) -> Column:
    """A file's name and a hash of its whole path, which tells files apart without showing where they are."""
    return F.concat(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1), F.lit("#"), F.substring(F.sha2(path, 256), 1, 12))


def run_slug(c: Column) -> Column:
    """Lower case, runs of other than letters and digits as '-', up to 64 characters; 'research-run' for nothing."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 64), F.lit("")), F.lit("research-run"))


def company_slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def without_tags(c: Column) -> Column:
    """A text without mark-up: tags become spaces, character references their characters, white space single blanks.

    Only texts with an ampersand go to Python.
    """
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    references = F.pandas_udf(lambda texts: texts.map(html.unescape, na_action="ignore"), "string")
    return squeeze(F.coalesce(references(F.when(F.contains(bare, F.lit("&")), bare)), bare))
