"""Counts that describe the quality of pairs and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def data_quality(p: DataFrame) -> DataFrame:
    """Blank titles, ids and years, empty and repeated author lists, in one pass."""
    blank = lambda c: F.count_if(F.trim(F.coalesce(c, F.lit(""))) == "")
    none = lambda c: F.count_if(F.coalesce(F.col(c).isNull() | (F.size(c) == 0), F.lit(True)))
    return p.agg(
        F.count("*").alias("n_rows"), blank("bib_title").alias("blank_bib_title"), blank("cand_title").alias("blank_cand_title"), none("bib_authors").alias("no_bib_authors"), none("cand_authors").alias("no_cand_authors"),
        blank("bib_id").alias("no_bib_id"), blank("bib_year").alias("no_bib_year"), F.count_if(F.col("bib_authors").isNotNull() & (F.size("bib_authors") != F.size(F.array_distinct("bib_authors")))).alias("repeated_authors"),
    )


def id_status(p: DataFrame) -> DataFrame:
    i, c = (F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "") for x in ("bib_id", "cand_id"))
    s = F.when(i == "", "Missing Extracted ID").when(i == c, "Exact Match").when(i.contains(c) | c.contains(i), "Partial Match").otherwise("Mismatch")
    return p.groupBy(s.alias("status")).agg(F.count("*").alias("n"))


def first_files(docs: DataFrame, n: int = 10) -> DataFrame:
    """The first n merged files of each paper, in order."""
    f = docs.select("paper_id", "version", F.explode("metadata.merged_files").alias("file")).distinct()
    return f.withColumn("n", F.row_number().over(W.partitionBy("paper_id").orderBy("version", "file"))).filter(F.col("n") <= n).drop("n")
