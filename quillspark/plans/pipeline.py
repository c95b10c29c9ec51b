"""The whole run: sources to references, trees and labels; with its command line."""

from __future__ import annotations

import argparse
import logging
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark import sources
from quillspark.functions import text as T
from quillspark.operators import dataset as D, hierarchy as H, latex as L, matching as M, references as R
from quillspark.plans.timing import Phases
from quillspark.session import get_spark, keep
from quillspark.sources import sinks

KEYS = ["paper_id", "version"]


@dataclass(frozen=True)
class Config:
    """Folders and thresholds of a run."""

    raw: str = "data_raw"
    output: str = "data_output"
    threshold: float = M.THRESHOLD
    year_tolerance: int = M.YEARS
    top: int = M.TOP

    def validate(self) -> None:
        if not 0 <= self.threshold <= 1 or self.year_tolerance < 0 or self.top < 1:
            raise ValueError(f"out of range: {asdict(self)}")


def extract_references(files: DataFrame, flat: DataFrame) -> DataFrame:
    """(paper_id, version, ord, key, raw_text, type, source): files first, in the order of their names, then what is embedded; the first of a key counts, and only cited keys are kept."""
    top = files.filter(~F.col("rel_path").contains("/"))
    bib = R.bib_entries(top.filter("ext = 'bib'"), "content", *KEYS, "file_name")
    fields = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = {"), e["value"], F.lit("}"))), ",\n")
    a = bib.select(*KEYS, F.lit(0).alias("prio"), F.col("file_name").alias("source"), F.col("entry_no").alias("no"), "key", F.concat(F.lit("@"), "entry_type", F.lit("{"), "key", F.lit(",\n"), fields, F.lit("\n}")).alias("raw_text"), F.concat(F.lit("bib_"), "entry_type").alias("type"))
    b = R.bibitems(top.filter("ext = 'bbl'"), F.col("content"), *KEYS, "file_name").select(*KEYS, F.lit(0).alias("prio"), F.col("file_name").alias("source"), F.col("item_no").alias("no"), "key", "raw_text", F.lit("bibitem").alias("type"))
    c = R.bibitems(flat, R.embedded_bibliography(F.col("content")), *KEYS).select(*KEYS, F.lit(1).alias("prio"), F.lit("embedded_block").alias("source"), F.col("item_no").alias("no"), "key", "raw_text", F.lit("bibitem").alias("type"))
    first = a.unionByName(b).unionByName(c).groupBy(*KEYS, "key").agg(F.min(F.struct("prio", "source", "no", "raw_text", "type")).alias("m"))
    refs = first.select(*KEYS, "key", "m.raw_text", "m.type", "m.source", F.struct("m.prio", "m.source", "m.no").alias("ord"))
    cited = flat.select(*KEYS, F.explode(T.cited_keys(F.col("content"))).alias("key")).distinct()
    return R.used_refs(refs, cited, KEYS).withColumn("ref_id", F.col("key"))


def select_papers(files: DataFrame, yymm: str | None = None, first: int | None = None, last: int | None = None, limit: int | None = None) -> DataFrame:
    """The files of papers whose id begins with `yymm`, of those from `first` to `last` in order, and of `limit` of these at random."""
    if yymm is None and first is None and limit is None:
        return files
    chosen = D.prefix_slice(files, "paper_id", yymm or "", first or 0, last)
    if limit is not None:
        chosen = D.random_limit(chosen, "paper_id", limit)
    return files.join(chosen, "paper_id", "left_semi")


def process(spark: SparkSession, config: Config, papers: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of a run: files, flat, refs, canonical, key_map, headers, blocks, edges, elements. `papers`: files already chosen.

    References are taken from the sources as they are; the trees are built from sources without bibliographies.
    """
    config.validate()
    files = keep(sources.raw_files(spark, config.raw) if papers is None else papers, "files")
    tex = files.filter("ext = 'tex'")
    roots = keep(L.choose_root(L.root_scores(files, KEYS), KEYS), "roots")
    flat = keep(L.flatten(tex, roots, KEYS), "flat")
    refs = keep(extract_references(files, flat), "refs")
    maps = R.key_map(refs)
    body = keep(R.rewrite(L.flatten(tex, roots, KEYS, remove_references=True), maps, KEYS, "content"), "body")
    heads = L.header_parents(L.headers(body.filter("content is not null"), KEYS), KEYS)
    edges, elements = H.hierarchy(keep(H.assemble(body, KEYS), "nodes"))
    return {"files": files, "flat": flat, "refs": refs, "canonical": R.canonical_refs(refs), "key_map": maps, "headers": heads, "blocks": L.blocks(heads, [*KEYS, "pos"]), "edges": edges, "elements": elements}


def label(refs: DataFrame, candidates: DataFrame, config: Config) -> DataFrame:
    """Label records of canonical references that match a candidate of their paper."""
    q = refs.select("paper_id", F.col("canonical_key").alias("query"), F.col("raw_text").alias("text"), T.entry_title(F.col("raw_text")).alias("title"))
    c = candidates.select("paper_id", "cand_id", "title", F.array_join("authors", " ").alias("authors"), "year")
    m = M.match(q, c, ["paper_id"], config.threshold, config.year_tolerance, config.top)
    j = m.join(q.select("paper_id", "query", "text"), ["paper_id", "query"]).join(candidates, ["paper_id", "cand_id"])
    truth = F.struct(F.col("cand_id").alias("id"), "title", "authors", F.col("year").alias("submission_date"), F.col("score").alias("match_score"))
    return j.select(F.col("query").alias("key"), F.col("text").alias("content"), truth.alias("ground_truth"), F.col("paper_id").alias("source_paper_id"))


def run_matching(spark: SparkSession, config: Config, canonical: DataFrame | None = None) -> int:
    """Matches canonical references (of this run, or those exported before) to the candidates of their papers, writes the labels and returns how many papers have some. A paper's candidates are those beside its results, else those beside its sources."""
    if canonical is None:
        canonical = sources.refs_bib(spark, [f"{config.output}/refs_bib/*/*"], r"paper_id=([^/]+)/").withColumnRenamed("key", "canonical_key")
    found = sources.candidates_of(spark, [f"{config.output}/metadata/*/file_name=references.json/*", f"{config.raw}/*/references.json"], [r"paper_id=([^/]+)/", r"/([^/]+)/references\.json$"])
    out = keep(label(canonical, found, config), "labels")
    sinks.labels_json(out, f"{config.output}/labels")
    return out.select("source_paper_id").distinct().count()


def run(spark: SparkSession, config: Config, matching: bool = True, papers: DataFrame | None = None) -> dict[str, int]:
    """Runs all steps, writes their results and returns how many papers were processed and matched."""
    time = Phases()
    with time.phase("process"):
        t = process(spark, config, papers)
        stats = {"processed": t["flat"].select("paper_id").distinct().count(), "matched": 0}
    with time.phase("write"):
        sinks.refs_bib(t["canonical"], f"{config.output}/refs_bib")
        sinks.hierarchy_json(t["edges"], t["elements"], f"{config.output}/hierarchy")
        t["headers"].write.mode("overwrite").parquet(f"{config.output}/headers")
        t["blocks"].write.mode("overwrite").parquet(f"{config.output}/blocks")
        sinks.metadata(sources.metadata(spark, config.raw), f"{config.output}/metadata")
    if matching:
        with time.phase("match"):
            stats["matched"] = run_matching(spark, config, t["canonical"])
    logging.info("%s", stats)
    for phase, seconds, share, _ in time.report():
        logging.info("%s: %s s, %s %%", phase, seconds, share)
    return stats


def merge(spark: SparkSession, folder: str, output: str) -> dict[str, int]:
    """Manual and automatic labels of a data set's partitions as one data set; how many records of each kind."""
    d = sources.dataset(spark, folder).withColumn("source_type", F.regexp_replace("source_file", r"\.json$", ""))
    sinks.splits(d, output)
    return {r["source_type"]: r["count"] for r in d.groupBy("source_type").count().collect()}


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Sources to references, trees and labels.")
    p.add_argument("--raw", "-r", default=Config.raw)
    p.add_argument("--output", "-o", default=Config.output)
    p.add_argument("--matching-only", action="store_true", help="match what was exported before")
    p.add_argument("--no-matching", action="store_true")
    p.add_argument("--merge", action="store_true", help="merge the labels of --input to --output-dataset")
    p.add_argument("--input", default="dataset")
    p.add_argument("--output-dataset", default="dataset_merged")
    p.add_argument("--yymm", help="papers whose id begins so")
    p.add_argument("--limit", type=int, help="so many papers at random")
    p.add_argument("--range", type=int, nargs=2, metavar=("A", "B"), help="papers A to B in order")
    p.add_argument("--parallel", "-p", action="store_true", help="on all cores (the default but with --workers)")
    p.add_argument("--workers", "-w", type=int, help="cores of a local session")
    p.add_argument("--threshold", type=float, default=Config.threshold)
    p.add_argument("--log", help="also write the log to this file")
    return p


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s", handlers=[logging.StreamHandler(), *([logging.FileHandler(a.log)] if a.log else [])])
    spark = get_spark("pipeline", a.workers or "*")
    config = Config(a.raw, a.output, a.threshold)
    if a.merge:
        print(merge(spark, a.input, a.output_dataset))
    elif a.matching_only:
        config.validate()
        print({"processed": 0, "matched": run_matching(spark, config)})
    else:
        first, last = a.range or (None, None)
        papers = select_papers(sources.raw_files(spark, config.raw), a.yymm, first, last, a.limit)
        print(run(spark, config, not a.no_matching, papers))


if __name__ == "__main__":
    main()
