"""Names, identifiers and small parsers as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def place_name(x) -> Column:
    """A place name to compare by: lower case, & as and, no parentheses or apostrophes, saint and mount shortened."""
    s = F.regexp_replace(F.lower(_c(x)), "&", " and ")
    for pattern, to in ((r"\([^)]*\)", " "), ("['’.]", ""), (r"\bsaint\b", "st"), (r"\bmount\b", "mt"), (r"[^a-z0-9/-]+", " ")):
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def name_candidates(x) -> Column:
    """The names that a place may go by: the whole, its parts around - and /, each also without city at the end."""
    whole = place_name(x)
    parts = F.concat(F.array(whole), F.transform(F.split(whole, "[-/]+"), F.trim))
    return F.filter(F.array_distinct(F.concat(parts, F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s(city|town|village)$", ""))))), lambda p: p != "")


def canonical_id(x) -> Column:
    return F.upper(F.regexp_replace(_c(x), "[^A-Za-z0-9]", ""))


@F.pandas_udf(StringType())
def folded(x: pd.Series) -> pd.Series:
    """Lower case without accents, by compatibility decomposition."""
    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().strip())


def variable_name(x, most: int = 28) -> Column:
    """A legal column name: letters, digits and _, a v before a digit, at most so long."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(s.rlike("^[0-9]"), F.concat(F.lit("v"), s)).otherwise(s), 1, most)


def without_suffix(x) -> Column:
    """A census place name without its kind at the end."""
    return F.trim(F.regexp_replace(_c(x), r"\s+(city|town|village|borough|CDP|municipality|urban county|consolidated government)(\s*\(balance\))?$", ""))


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title(x) -> Column:
    return F.initcap(F.lower(_c(x)))


def decoded(x) -> Column:
    """XML and HTML text with the five named entities decoded, &amp; last."""
    s = _c(x)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def clean(x, most: int) -> Column:
    """Text with runs of white space as one space, cut to a length; null if nothing is left."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(_c(x), r"\s+", " ")), 1, most), F.lit(""))


def column_index(x) -> Column:
    """Zero-based column of a spreadsheet reference such as BC7."""
    letters = F.regexp_extract(F.upper(_c(x)), "^([A-Z]+)", 1)
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def byte_prefix(x, most: int) -> Column:
    """The longest prefix of at most so many UTF-8 bytes that ends at a character."""
    s, n = _c(x), F.length(_c(x))
    ends = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(F.octet_length(F.substring(s, F.lit(1), i)) <= most, i).otherwise(0))
    return F.substring(s, F.lit(1), F.array_max(ends))


def fnv1a(x) -> Column:
    """32-bit FNV-1a of a text's characters as a long."""
    codes = F.transform(F.filter(F.split(_c(x), ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c.cast("long")) * 16777619, F.lit(1 << 32)))


def index_list(x) -> Column:
    """"0:12.1,2:2.3" as an array of (idx, pct)."""
    pairs = F.filter(F.split(_c(x), ","), lambda p: p.contains(":"))
    return F.transform(pairs, lambda p: F.struct(F.element_at(F.split(p, ":"), 1).cast("int").alias("idx"), F.element_at(F.split(p, ":"), 2).cast("double").alias("pct")))


def label_path(x) -> Column:
    """The last part of a label A!!B!!C."""
    return F.element_at(F.split(_c(x), "!!"), -1)


def tokens_match(x, wanted: str) -> Column:
    """Whether a semicolon list holds a value, whatever the case and blanks."""
    return F.exists(F.split(_c(x), ";"), lambda t: F.upper(F.trim(t)) == wanted.upper())


def duration(seconds) -> Column:
    """45 s, 12 min, 2 h 5 min."""
    s = F.round(_c(seconds)).cast("long")
    m = F.round(s / 60).cast("long")
    hours = F.concat(F.floor(m / 60).cast("string"), F.lit(" h"), F.when(m % 60 > 0, F.concat(F.lit(" "), (m % 60).cast("string"), F.lit(" min"))).otherwise(""))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).otherwise(hours)


def distance_label(metres) -> Column:
    m = _c(metres)
    return F.when(m < 1000, F.concat((F.round(m / 10) * 10).cast("long").cast("string"), F.lit(" m"))).otherwise(F.concat(F.format_number(m / 1000, 1), F.lit(" km")))


def coordinates(x) -> Column:
    """(lat, lon) of a text such as "48.85, 2.35"; null if it is anything else or off the globe."""
    m = lambda k: F.regexp_extract(F.trim(_c(x)), r"^([+-]?\d{1,2}(?:\.\d+)?)\s*[, ]\s*([+-]?\d{1,3}(?:\.\d+)?)$", k).try_cast("double")
    lat, lon = m(1), m(2)
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def public_host(url) -> Column:
    """Whether a URL is http(s) and its host is neither local nor a private or reserved IPv4 address."""
    u = F.lower(_c(url))
    host = F.regexp_extract(u, r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    octets = F.transform(F.split(host, r"\."), lambda o: o.try_cast("int"))
    ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b = F.element_at(octets, 1), F.try_element_at(octets, F.lit(2))
    private = (a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | F.exists(octets, lambda o: o > 255))
    return F.coalesce((host != "") & ~host.isin("localhost") & ~host.rlike(r"\.(local|internal|localhost)$") & F.when(ip, ~private).otherwise(host.contains(".")), F.lit(False))


#: Kinds of streets as they are written.
_STREETS = r"(ST|AVE|AV|BLVD|RD|DR|PL|CT|PKWY|LN)"


def street_address(x) -> Column:
    """(number, dir, name, type) of an address such as 211 W. Polk St.; null if it is none."""
    s = F.upper(F.trim(F.regexp_replace(_c(x), r"\s+", " ")))
    pattern = rf"^(\d+) (?:([NSEW])\.? )?(.+?) {_STREETS}\.?$"
    part = lambda k: F.regexp_extract(s, pattern, k)
    return F.when(s.rlike(pattern), F.struct(part(1).try_cast("int").alias("number"), F.nullif(part(2), F.lit("")).alias("dir"), part(3).alias("name"), F.when(part(4) == "AV", "AVE").otherwise(part(4)).alias("type")))


def street_corner(x) -> Column:
    """(a, b): the two names of a corner such as 12th & State sts. or 28th St. and Maplewood Av.; null if it is none."""
    s = F.upper(F.trim(F.regexp_replace(_c(x), r"\s+", " ")))
    parts = F.split(s, r" (?:&|AND) ")
    name = lambda p: F.trim(F.regexp_replace(p, rf" {_STREETS}S?\.?$", ""))
    return F.when((F.size(parts) == 2) & ~s.rlike(r"^\d+ [A-Z]"), F.struct(name(parts[0]).alias("a"), name(parts[1]).alias("b")))


def crime_place(x) -> Column:
    """The place that a case description names as that of the crime: the last address or corner, no residence or station."""
    place = r"((?:\d+ (?:[NSEW]\. )?[A-Z][\w ]*? (?:St|Av|Ave)\.|\d+\w{2} St\. and [A-Z]\w+ (?:St|Av|Ave)\.))(?! Station)"
    cleaned = F.regexp_replace(F.regexp_replace(_c(x), r"(?:, )?of \d+ [^,]*,", ","), r"(?:[NSEW]\. )?\d+\w{2} St\. Station", "")
    return F.try_element_at(F.regexp_extract_all(cleaned, F.lit(place), 1), F.lit(-1))


def id_after(x, prefix: str) -> Column:
    """The number that follows a prefix at the end of a text."""
    import re

    return F.regexp_extract(_c(x), rf"{re.escape(prefix)}0*([0-9]+)$", 1).try_cast("long")
