"""Text functions over columns, with explicit character classes so that dialects of regular expressions do not matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track visitors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "yclid", "mc_cid", "mc_eid", "ref", "source", "from")


def collapse(text: Column) -> Column:
    """No-break spaces become spaces, runs of white space one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, " ", " "), "[ \\t\\r\\n\\f]+", " "))


def normal_title(text: Column) -> Column:
    """Lower case; letters, digits, _, - and / of any script stay, all else becomes a space."""
    return collapse(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s\-/]", " "))


def token_set(text: Column, least: int = 3) -> Column:
    """Distinct tokens of a-z and 0-9 in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{%d,}" % least), 0))


def token_estimate(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def preview(text: Column, n: int = 280) -> Column:
    return F.trim(F.translate(F.substring(text, 1, n), "\n", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def signal(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(text, "[^A-Za-z0-9]+", "_")), "^_+|_+$", "")


def decimal_of(text: Column) -> Column:
    """A decimal of all digits, signs and points of a text, a comma being a point; null if that is no number."""
    return F.regexp_replace(F.regexp_replace(text, ",", "."), r"[^0-9.\-]", "").try_cast("decimal(18,2)")


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)), r"^www\.", "")


def normal_url(url: Column) -> Column:
    """Lower-case scheme and host without www., no fragment, no tracking parameters, no slash at the end but the root's."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    scheme, rest = F.lower(F.regexp_extract(base, "^([A-Za-z]+)://", 1)), F.regexp_extract(base, "^[A-Za-z]+://[^/]*(.*)$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*TRACKING)), "&")
    bare = F.regexp_replace(rest, "/+$", "")
    path = F.when(bare == "", "/").otherwise(bare)
    return F.concat(scheme, F.lit("://"), host_of(url), path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def stripped_html(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags become spaces, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    return collapse(F.regexp_replace(t, "<[^>]+>", " "))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def is_private(url: Column) -> Column:
    """Whether a url names this machine, a private network or no web address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    net = host.rlike(r"^(10\.[0-9]{1,3}|192\.168|172\.(1[6-9]|2[0-9]|3[01]))\.[0-9]{1,3}\.[0-9]{1,3}")
    return host.isin("localhost", "127.0.0.1", "[::1]", "0.0.0.0") | net | scheme.isin("file", "ftp", "chrome", "about")
