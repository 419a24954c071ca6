"""Text features: entropy, encodings, domain parts, lexicon hits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two-part public suffixes.
MULTI_SUFFIX = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.jp", "com.au", "net.au",
    "co.nz", "com.br", "co.in", "com.cn", "com.tr", "co.za", "com.mx",
]


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator. The optimizer cannot copy them into later filters
    and projections, so an expensive text expression runs once per row."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(packed)).alias("_once")).select(*[F.col(f"`{c}`") for c in df.columns], "_once.*")


def entropy(s: Column) -> Column:
    """Shannon entropy in bits per character; 0 for empty text."""
    n = F.length(s).cast("double")
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    share = lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / n
    total = F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit(0.0)).otherwise(total)


def encoded_label(s: Column) -> Column:
    """hex, base32 (upper case only) or base64 for a label of 16 or more characters."""
    return (F.when(s.rlike(r"^[0-9a-fA-F]{16,}$"), "hex")
            .when(s.rlike(r"^[A-Z2-7=]{16,}$") & s.rlike("[A-Z]"), "base32")
            .when(s.rlike(r"^[A-Za-z0-9+/=_\-]{16,}$"), "base64"))


def encoded_label_any_case(s: Column, min_b32: int = 16, min_b64: int = 16) -> Column:
    """The packet variant: base32 is tested on the upper-cased text."""
    return (F.when(F.upper(s).rlike(r"^[A-Z2-7]{%d,}$" % min_b32), "base32")
            .when(s.rlike(r"^[0-9a-fA-F]{%d,}$" % min_b32), "hex")
            .when(s.rlike(r"^[A-Za-z0-9+/]{%d,}={0,2}$" % min_b64), "base64"))


def digit_ratio(s: Column) -> Column:
    digits = F.length(s) - F.length(F.regexp_replace(s, r"\p{Nd}", ""))
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit(0.0)).otherwise(digits / F.length(s))


def consonant_run(s: Column) -> Column:
    """Length of the longest run of consonants."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}&&[^aeiou]]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def bare_host(fqdn: Column) -> Column:
    return F.lower(F.regexp_replace(fqdn, r"^\.+|\.+$", ""))


_REGISTERED = (r"(?:^|\.)([^.]+\.(?:" + "|".join(x.replace(".", r"\.") for x in MULTI_SUFFIX)
               + r")|[^.]*\.[^.]*|[^.]*)$")


def registered_domain(fqdn: Column) -> Column:
    """Last two labels, or three under a two-part suffix; NULL for empty input."""
    return F.when(fqdn != "", F.regexp_extract(bare_host(fqdn), _REGISTERED, 1))


def subdomain_part(fqdn: Column) -> Column:
    """What stands in front of the registered domain."""
    return F.coalesce(F.regexp_replace(bare_host(fqdn), _REGISTERED, ""), F.lit(""))


def longest_label(fqdn: Column) -> Column:
    labels = F.split(F.regexp_replace(fqdn, r"^\.+|\.+$", ""), r"\.", -1)
    return F.coalesce(F.array_max(F.transform(labels, F.length)), F.lit(0))


def literal(word: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", word)


def has_suffix(domain: Column, suffixes) -> Column:
    """Equal to one of the suffixes or below it."""
    if not suffixes:
        return F.lit(False)
    return F.coalesce(domain.rlike(r"(?:^|\.)(?:" + "|".join(literal(s) for s in suffixes) + r")$"), F.lit(False))


def hits(text: Column, words) -> Column:
    """The words contained in the lower-cased text, in list order. The text is bound once."""
    listed = F.array(*[F.lit(w.lower()) for w in words])
    found = F.transform(F.array(F.lower(text)), lambda t: F.filter(listed, lambda w: F.contains(t, w)))
    return F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<string>"))


def first_hit(text: Column, words) -> Column:
    return F.get(hits(text, words), F.lit(0))


def any_hit(text: Column, words) -> Column:
    """One of the words is contained in the lower-cased text."""
    return F.coalesce(F.lower(text).rlike("|".join(literal(w.lower()) for w in words)), F.lit(False))


def count_within(low: Column, words) -> Column:
    """How many of the words a text holds that is in lower case already. Plain searches, as hits() leaves generated code."""
    return sum((F.coalesce(low.contains(w.lower()).cast("int"), F.lit(0)) for w in words), F.lit(0))


def any_within(low: Column, words) -> Column:
    """One of the words is contained in a text that is in lower case already."""
    found = F.lit(False)
    for w in reversed(words):
        found = low.contains(w.lower()) | found
    return F.coalesce(found, F.lit(False))


def human_bytes(n: Column) -> Column:
    """1536 -> 1.5KB."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.format_string("%.1fPB", n / float(1024 ** 5))
    for i in reversed(range(len(units))):
        out = F.when(F.abs(n) < float(1024 ** (i + 1)),
                     F.format_string("%.1f" + units[i], n / float(1024 ** i))).otherwise(out)
    return out


def off_hours(hour: Column, start: int = 20, end: int = 6) -> Column:
    return (hour >= start) | (hour < end)
