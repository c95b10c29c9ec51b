"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Field names and entry types a raw entry is stripped of before matching.
FIELDS = "text title author year journal volume pages doi eprint archiveprefix primaryclass month number publisher abstract address url urldate issn keywords copyright language".split()
TYPES = "article misc book inproceedings unpublished techreport".split()


def fingerprint(c: Column) -> Column:
    """md5 of the ASCII letters and digits in lower case."""
    return F.md5(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))


def content_hash(kind: Column, content: Column) -> Column:
    """md5 of `type:content`, the content without white space at its ends."""
    return F.md5(F.concat(kind, F.lit(":"), F.regexp_replace(content, r"^\s+|\s+$", "")))


def normalize_basic(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def tokens(c: Column) -> Column:
    """Distinct words in lower case, punctuation deleted."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\p{M}_\s]", ""), r"\s+")
    return F.array_distinct(F.filter(words, lambda x: x != ""))


def year(c: Column) -> Column:
    """First 19xx or 20xx that stands alone, else null."""
    return F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def year4(c: Column) -> Column:
    """The first four characters, if they are digits."""
    return F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit("")).cast("int")


def year_diff(a: Column, b: Column) -> Column:
    """Distance of two years, 10 at most; -1 if one is missing."""
    d = F.abs(year4(a) - year4(b))
    return F.when(d.isNull(), -1).otherwise(F.least(d, F.lit(10)))  # least() alone would pass over a null


def normalize_id(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[.\-/]", "")


def id_match(a: Column, b: Column) -> Column:
    """1 for the same id, 0.8 if one contains the other, else 0; of the letters and digits."""
    x, y = (F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "") for c in (a, b))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.8).otherwise(0.0)


def clean_for_match(c: Column) -> Column:
    """A raw entry without field names, entry types and delimiters, for matching."""
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, "(?:" + "|".join(FIELDS) + r")\s*=", " ")
    t = F.regexp_replace(t, "@(?:" + "|".join(TYPES) + ")", " ")
    t = F.regexp_replace(t, r"[{}\"'\\=,:;()\[\]]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def entry_title(c: Column) -> Column:
    """The title field of an entry, '' if there is none; booktitle is not it."""
    return F.trim(F.regexp_extract(c, r"(?is)(?:^|[,{\s])title\s*=\s*[{\"]+(.*?)[}\"]+\s*(?:,|\}|$)", 1))


def entry_authors(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?is)(?:^|[,{\s])author\s*=\s*[{\"]+(.*?)[}\"]+\s*(?:,|\}|$)", 1))


def title_is_valid(c: Column) -> Column:
    """At least 5 characters and two words; no bare id, DOI, address or file."""
    return (F.length(c) >= 5) & ~c.rlike(r"^\d{4}\.\d{4,5}$") & ~F.lower(c).rlike(r"doi|https?:|\\href|\\path") & (F.size(F.split(F.trim(c), r"\s+")) >= 2)


def parse_method(c: Column) -> Column:
    return (
        F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "empty").when(F.trim(c).startswith("@"), "bibtex_struct").when(c.contains("\\newblock"), "flat_text").otherwise("regex_fallback")
    )


def cited_keys(c: Column) -> Column:
    """Distinct keys cited by any command of the cite family, in their order."""
    found = F.regexp_extract_all(c, F.lit(r"\\(?:no)?cite[a-zA-Z]*\s*(?:\[[^\]]*\]\s*)*\{([^}]+)\}"), 1)
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(found, lambda s: F.split(s, ","))), lambda x: F.trim(x)), lambda x: x != ""))


def noise(c: Column) -> Column:
    """How many characters are left of LaTeX: braces, dollars and backslashes."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^{}$\\]", ""))


def clean_list(c: Column) -> Column:
    """Trimmed, blanks dropped, each kept at its first place."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


def seed_key(c: Column, seed: int = 42) -> Column:
    """A number that orders rows at random, the same for the same seed and id, in Spark and in SQL."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string"))), 1, 8), 16, 10).cast("bigint")
