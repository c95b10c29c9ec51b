"""Readers of the artefacts papers come with, and of what the engine itself writes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Folders that hold no sources.
SKIPPED = (".git", "images", "figures", "__pycache__", "node_modules", "media")
BIB_LIMIT = 5 * 1024 * 1024

GROUND_TRUTH = "struct<id:string,title:string,authors:array<string>,submission_date:string,match_score:double>"
LABELS = f"key string, content string, ground_truth {GROUND_TRUTH}, source_paper_id string"
CANDIDATE = "struct<title:string,authors:array<string>,submission_date:string,submissionDate:string,year:string>"


def _decode(c: Column) -> Column:
    """UTF-8 with broken bytes left out."""
    @F.pandas_udf("string")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: x.decode("utf-8", "ignore") if x is not None else None)

    return run(c)


def raw_files(spark: SparkSession, folder: str, pattern: str = "*.{tex,bib,bbl}") -> DataFrame:
    """(paper_id, version, rel_path, file_name, ext, size, content) of `<folder>/<paper>/tex/<version>/**`. Bibliographies over 5 MiB are not read: the size is checked in the scan."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    path = r"/([^/]+)/tex/([^/]+)/(.+)$"
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    d = d.filter(~(F.col("path").endswith(".bib") & (F.col("length") > BIB_LIMIT)))
    d = d.filter(~F.col("path").rlike("/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))
    d = d.select(F.regexp_extract("path", path, 1).alias("paper_id"), F.regexp_extract("path", path, 2).alias("version"), F.regexp_extract("path", path, 3).alias("rel_path"), ext.alias("ext"), F.col("length").alias("size"), _decode(F.col("content")).alias("content"))
    return d.filter("paper_id <> ''").withColumn("file_name", F.element_at(F.split("rel_path", "/"), -1))


def papers(files: DataFrame) -> DataFrame:
    return files.select("paper_id").distinct()


def versions(files: DataFrame, numeric: bool = True) -> DataFrame:
    """(paper_id, version, ver_ord): versions in their order, by number (v2 before v10) or by letters."""
    from pyspark.sql import Window as W

    number = F.coalesce(F.try_to_number(F.regexp_extract("version", r"(\d+)$", 1), F.lit("999999")), F.lit(0))
    order = [number, F.col("version")] if numeric else [F.col("version")]
    return files.select("paper_id", "version").distinct().withColumn("ver_ord", F.row_number().over(W.partitionBy("paper_id").orderBy(*order)))


def labels(spark: SparkSession, *paths: str) -> DataFrame:
    """Label records of JSON arrays; files that can't be read give no rows. `source_file` is the file's name."""
    d = spark.read.schema(LABELS + ", _corrupt_record string").json(list(paths), multiLine=True, mode="PERMISSIVE", recursiveFileLookup=True)
    return d.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).filter("_corrupt_record is null and key is not null").drop("_corrupt_record")


def candidates(spark: SparkSession, paths: list[str], paper_pattern: str = r"/([^/]+)/references\.json$") -> DataFrame:
    """(paper_id, cand_id, title, authors, year) of references.json files; lower case, trimmed; either spelling of the date, else the year. Authors given as one string are one author."""
    d = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), paper_pattern, 1).alias("paper_id"), F.from_json("value", f"map<string,{CANDIDATE}>").alias("m"), F.from_json("value", "map<string,struct<authors:string>>").alias("plain"))
    d = d.filter("m is not null").select("paper_id", "plain", F.explode("m").alias("cand_id", "c"))
    one = F.element_at("plain", F.col("cand_id"))["authors"]
    authors = F.coalesce(F.col("c.authors"), F.when(one.isNotNull() & ~one.startswith("["), F.array(one)), F.array().cast("array<string>"))
    clean = lambda c: F.lower(F.trim(c))
    return d.select("paper_id", "cand_id", clean(F.coalesce("c.title", F.lit(""))).alias("title"), F.transform(authors, clean).alias("authors"), F.substring(F.coalesce("c.submission_date", "c.submissionDate", "c.year", F.lit("")), 1, 4).alias("year"))


def candidates_of(spark: SparkSession, paths: list[str], patterns: list[str]) -> DataFrame:
    """candidates() from several places, each with its pattern of the paper's id; a paper's are those of the first place that has it. Places without files give none."""
    out = None
    for path, pattern in zip(paths, patterns):
        if not _exists(spark, path):
            continue
        c = candidates(spark, [path], pattern)
        out = c if out is None else out.unionByName(c.join(out.select("paper_id").distinct(), "paper_id", "left_anti"))
    return spark.createDataFrame([], "paper_id string, cand_id string, title string, authors array<string>, year string") if out is None else out


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def metadata(spark: SparkSession, folder: str, names: tuple[str, ...] = ("metadata.json", "references.json")) -> DataFrame:
    """(paper_id, file_name, value) of the metadata files beside each paper's sources, as they are."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(names) + "}").load(f"{folder}/*")
    return d.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("paper_id"), F.regexp_extract("path", r"/([^/]+)$", 1).alias("file_name"), _decode(F.col("content")).alias("value"))


def refs_bib(spark: SparkSession, paths: list[str], paper_pattern: str = r"/([^/]+)/refs\.bib$") -> DataFrame:
    """(paper_id, key, raw_text) of exported references: the text field, else title and author."""
    from quillspark.operators.references import bib_entries

    d = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), paper_pattern, 1).alias("paper_id"), F.col("value").alias("content"))
    e = bib_entries(d, "content", "paper_id")
    text = F.coalesce(F.nullif(F.try_element_at("fields", F.lit("text")), F.lit("")), F.concat_ws(" ", F.try_element_at("fields", F.lit("title")), F.try_element_at("fields", F.lit("author"))))
    return e.select("paper_id", "key", text.alias("raw_text"))


def hierarchies(spark: SparkSession, paths: list[str], paper_pattern: str = r"/([^/]+)/hierarchy\.json$") -> DataFrame:
    """(paper_id, version_num, child_id, parent_id) of exported hierarchies."""
    d = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), paper_pattern, 1).alias("paper_id"), F.from_json("value", "hierarchy map<string,map<string,string>>").alias("h"))
    d = d.select("paper_id", F.explode("h.hierarchy").alias("version_num", "m"))
    return d.select("paper_id", "version_num", F.explode("m").alias("child_id", "parent_id"))


def dataset(spark: SparkSession, folder: str, partitions: tuple[str, ...] = ("train", "validation", "test"), files: tuple[str, ...] = ("manual.json", "auto.json")) -> DataFrame:
    """Labelled records of a data set folder with partition and source file; records without truth or authors left out, one of each key, authors cleaned, year from the date."""
    from quillspark.functions.text import clean_list

    d = labels(spark, *[f"{folder}/{p}" for p in partitions]).withColumn("partition", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    d = d.filter(F.col("source_file").isin(*files) & F.col("ground_truth").isNotNull() & (F.size("ground_truth.authors") > 0)).dropDuplicates(["partition", "source_file", "source_paper_id", "key"])
    return d.withColumns({"gt_authors": clean_list(F.col("ground_truth.authors")), "gt_year": F.substring("ground_truth.submission_date", 1, 4)})


def predictions(spark: SparkSession, paths: list[str], paper_pattern: str = r"/([^/]+)/pred\.json$") -> DataFrame:
    schema = T.StructType.fromDDL("partition string, groundtruth map<string,string>, prediction map<string,array<string>>")
    return spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), paper_pattern, 1).alias("paper_id"), F.from_json("value", schema).alias("p")).select("paper_id", "p.*")
