"""Duplicates hidden by formatting: canonical form, 128-bit hash, counts by key, collision check.

Every step is a built-in expression, but for letters in decomposed form, which Python composes. The canonical form of
a record keeps the letters and digits of each of its fields; fields are sorted, so their order does not count. Counting
is a hash aggregate, which combines on the map side: a record with a third of all rows as copies reaches the shuffle as
one row per map task.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from quillspark.session import keep

#: White space of any kind; `\\s` alone leaves out the no-break space and others.
SPACE = r"[\s\p{Z}\x{0085}\x{200B}\x{FEFF}]"
ENTRY = rf"^{SPACE}*@{SPACE}*\w+{SPACE}*[{{(]"
MARK = "\u0001"
#: Characters of texts that may be written in composed and in decomposed form beside each other; first what is quick to tell.
BEYOND_LATIN, DECOMPOSED = r"[^\x00-\u02FF\u2000-\u206F]", r"[\p{M}\u1100-\u11FF\u2126\u212A\u212B\uF900-\uFAFF]"


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def lowered(c: Column) -> Column:
    """Lower case, sharp s as ss, long and final s as s; numbers without their thousands commas."""
    s = F.replace(F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ſ"), F.lit("s")), F.lit("ς"), F.lit("σ"))
    return F.regexp_replace(s, r",(?<=\p{N},)(?=\p{N}{3}(?!\p{N}))", "")


def letters(c: Column) -> Column:
    """Letters and digits only, but that a mark stays between two numbers, for `1(23)` is not `12(3)`."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", MARK), rf"{MARK}(?:(?<!\p{{N}}{MARK})|(?!\p{{N}}))", "")


def canonical(text: Column) -> Column:
    """The text's fields, each as its letters and digits in lower case, sorted.

    `@type{key, name = value, ...}` splits at the commas before `name =`; the key stays in front. Anything else splits
    at `\\newblock`. A null text gives null, a text without letters and digits ''.
    """
    text = lowered(text)
    head = F.regexp_extract(text, rf"^{SPACE}*@{SPACE}*(\w+)", 1)
    body = F.regexp_replace(text, ENTRY, "")
    cut = F.split(F.regexp_replace(body, rf",{SPACE}*([a-z][a-z0-9_-]*){SPACE}*=", MARK + "$1="), MARK)
    fields = F.array_sort(F.transform(F.slice(cut, F.lit(2), F.size(cut)), letters))
    entry = F.concat_ws("|", F.concat(F.lit("@"), head), letters(cut[0]), F.array_join(fields, "|"))
    parts = F.array_sort(F.filter(F.transform(F.split(text, r"\\newblock\b"), letters), lambda x: x != ""))
    return F.when(text.rlike(ENTRY), entry).otherwise(F.array_join(parts, "|"))


def composed(records: DataFrame, text: str) -> DataFrame:
    """The records with their texts' letters in composed form. Only texts with decomposed ones (few as a rule) pass through Python."""
    odd = F.col(text).rlike(BEYOND_LATIN) & F.col(text).rlike(DECOMPOSED)
    return records.filter(~odd).unionByName(records.filter(odd).withColumn(text, _composed(text)))


def keyed(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """(id, h 128-bit hash, x second hash) of every record with letters or digits in it."""
    return (
        composed(records.select(F.col(record_id).alias("id"), F.col(text).alias("t")), "t")
        .select("id", canonical(F.col("t")).alias("c"))
        .filter(F.col("c") != "")
        .select("id", F.unhex(F.md5("c")).alias("h"), F.xxhash64("c").alias("x"))
    )


def copy_groups(rows: DataFrame) -> DataFrame:
    """(h, x, first_id, copies, collided) per canonical form, of keyed() rows. Two forms under one h differ in x: they stay two groups, and both are marked as collided."""
    g = rows.groupBy("h", "x").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    clash = g.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", F.lit(True).alias("collided"))
    return g.join(clash, "h", "left").withColumn("collided", F.coalesce("collided", F.lit(False)))


def count_copies(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """One row per distinct record: first_id (its smallest id), copies, collided. Null texts, and texts without letters and digits, are no records."""
    return copy_groups(keyed(records, record_id, text)).select("first_id", "copies", "collided")


def copy_pairs(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """(first_id, copy_id) for every copy but the first of each record; a row per copy, never all pairs.

    The rows go back to their groups over the hash; a group that holds more than 50,000 rows is met in slices, by
    the id, so that no task gets it whole.
    """
    rows = keep(keyed(records, record_id, text), "copies")
    slice_rows = 50_000
    groups = rows.groupBy("h", "x").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    groups = keep(groups, "groups")
    cool = groups.filter(F.col("copies") <= slice_rows).select("h", "x", "first_id")
    hot = groups.filter(F.col("copies") > slice_rows)
    out = rows.join(cool, ["h", "x"])
    if not hot.isEmpty():
        # at most rows / 50,000 hot groups; each is repeated once a slice, so this side has about rows / 50,000 rows
        slices = hot.agg(F.max(F.ceil(F.col("copies") / slice_rows))).first()[0]
        right = hot.select("h", "x", "first_id", F.explode(F.sequence(F.lit(0), F.lit(int(slices) - 1))).alias("s"))
        left = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(int(slices))).cast("int"))
        out = out.unionByName(left.join(right, ["h", "x", "s"]).select(*rows.columns, "first_id"))
    return out.filter(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("copy_id"))
