"""Writers: canonical references, hierarchies, labels, splits, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.operators.references import to_bib


def refs_bib(canonical: DataFrame, folder: str) -> None:
    """One text per paper, entries in the order of their numbers, partitioned by paper."""
    n = F.try_to_number(F.substring("canonical_key", 5, 12), F.lit("999999999999"))
    entry = F.struct(n.alias("n"), to_bib(F.col("canonical_key"), F.col("raw_text")).alias("e"))
    text = canonical.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), "").alias("value"))
    text.write.mode("overwrite").partitionBy("paper_id").text(folder)


def hierarchy_json(edges: DataFrame, elements: DataFrame, folder: str) -> None:
    """{"hierarchy": {version: {child: parent}}, "elements": {id: text}} per paper, partitioned by paper."""
    v = edges.groupBy("paper_id", "version_num").agg(F.map_from_entries(F.collect_list(F.struct("child_id", "parent_id"))).alias("m"))
    h = v.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("version_num", "m"))).alias("hierarchy"))
    e = elements.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("element_id", "content"))).alias("elements"))
    j = h.join(e, "paper_id", "left").select("paper_id", F.to_json(F.struct("hierarchy", "elements")).alias("value"))
    j.write.mode("overwrite").partitionBy("paper_id").text(folder)


def metadata(files: DataFrame, folder: str) -> None:
    """Metadata files (paper_id, file_name, value) as they are, partitioned by paper and name."""
    files.write.mode("overwrite").partitionBy("paper_id", "file_name").option("lineSep", "\n").text(folder)


def cleaned_samples(rows: DataFrame, folder: str) -> None:
    """Cleaned records twice: as JSON lines to read, and as Parquet to work with."""
    rows.write.mode("overwrite").json(f"{folder}/json")
    rows.write.mode("overwrite").parquet(f"{folder}/parquet")


def labels_json(labels: DataFrame, folder: str) -> None:
    """Label records of each paper as one JSON array, scores with four digits, partitioned by paper; papers without a match have no file."""
    s = F.col("ground_truth").withField("match_score", F.round("ground_truth.match_score", 4))
    j = labels.withColumn("ground_truth", s).groupBy(F.col("source_paper_id").alias("paper")).agg(F.to_json(F.collect_list(F.struct(*labels.columns))).alias("value"))
    j.write.mode("overwrite").partitionBy("paper").text(folder)


def references_json(candidates: DataFrame, folder: str) -> None:
    """{cand_id: {title, authors, year}} of each paper's candidates, partitioned by paper."""
    m = F.map_from_entries(F.collect_list(F.struct("cand_id", F.struct("title", "authors", "year"))))
    candidates.groupBy("paper_id").agg(F.to_json(m).alias("value")).write.mode("overwrite").partitionBy("paper_id").text(folder)


def splits(rows: DataFrame, folder: str) -> None:
    """Records by partition and source (manual, auto)."""
    rows.write.mode("overwrite").partitionBy("partition", "source_type").json(folder)


def merged(manual: DataFrame, auto: DataFrame) -> DataFrame:
    """Manual records, then automatic ones, told apart by source_type."""
    return manual.withColumns({"source_type": F.lit("manual"), "src_ord": F.lit(0)}).unionByName(auto.withColumns({"source_type": F.lit("auto"), "src_ord": F.lit(1)}), allowMissingColumns=True)


def predictions_json(ranked: DataFrame, truth: DataFrame, folder: str) -> None:
    """{partition, groundtruth {key: id}, prediction {key: [ids]}} per paper. ranked: paper_id, partition, key, rank, cand_id; truth: paper_id, key, true_id."""
    p = ranked.groupBy("paper_id", "partition", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))), lambda x: x["cand_id"]).alias("ids"))
    p = p.groupBy("paper_id", "partition").agg(F.map_from_entries(F.collect_list(F.struct("key", "ids"))).alias("prediction"))
    t = truth.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "true_id"))).alias("groundtruth"))
    j = p.join(t, "paper_id", "left").select("paper_id", F.to_json(F.struct("partition", "groundtruth", "prediction")).alias("value"))
    j.write.mode("overwrite").partitionBy("paper_id").text(folder)


def package(predicted: DataFrame, artefacts: DataFrame, folder: str, dry_run: bool = False) -> tuple[int, int]:
    """Copies artefact texts (paper_id, file_name, value) of papers that have predictions, all but labels.json; (copied, skipped)."""
    known = artefacts.join(predicted.select("paper_id").distinct(), "paper_id", "left_semi").filter("file_name <> 'labels.json'")
    copied, total = known.count(), artefacts.count()
    if not dry_run:
        known.write.mode("overwrite").partitionBy("paper_id", "file_name").text(folder)
    return copied, total - copied
