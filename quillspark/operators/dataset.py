"""Data sets for learning: slices, samples, splits, candidate pools, positive and negative pairs, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quillspark.functions.text import seed_key
from quillspark.operators.ordering import row_numbers
from quillspark.session import keep


def prefix_slice(df: DataFrame, col: str, prefix: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Distinct values of `col` that begin with `prefix`, in order, from start to stop."""
    d = df.select(col).distinct().filter(F.col(col).startswith(prefix)).orderBy(col)
    return d.offset(start).limit(stop - start) if stop is not None else d.offset(start)


def random_limit(df: DataFrame, col: str, n: int, seed: int = 42) -> DataFrame:
    return df.select(col).distinct().orderBy(seed_key(F.col(col), seed), col).limit(n)


def papers_all_entries(refs: DataFrame, paper: str = "paper_id", text: str = "raw_text") -> DataFrame:
    """Papers all of whose references are written as entries."""
    return refs.groupBy(paper).agg(F.bool_and(F.coalesce(F.col(text).rlike(r"^\s*@\w+\s*\{"), F.lit(False))).alias("ok")).filter("ok").select(paper)


def having_at_least(df: DataFrame, paper: str, n: int) -> DataFrame:
    return df.groupBy(paper).agg(F.count("*").alias("n_refs")).filter(F.col("n_refs") >= n)


def split_papers(papers: DataFrame, paper: str, manual: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(paper, partition): all papers but the manual ones, at random 80/10/10; fewer than ten all train.

    Numbering goes by hash buckets, whose counts are summed up, so that no task gets all papers.
    """
    p = papers.select(paper).distinct()
    if manual is not None:
        p = p.join(manual.select(paper), paper, "left_anti")
    p = p.withColumn("k", seed_key(F.col(paper), seed)).withColumn("b", F.floor(F.col("k") / 4194304).cast("int"))
    sizes = p.groupBy("b").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.sum("c").over(W.orderBy("b")) - F.col("c")).withColumn("n", F.sum("c").over(W.partitionBy()))
    r = p.join(before, "b").withColumn("r", F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("k", paper)))
    part = F.when(F.col("n") < 10, "train").when(F.col("r") <= F.floor(F.col("n") * 0.8), "train").when(F.col("r") <= F.floor(F.col("n") * 0.9), "validation").otherwise("test")
    return r.select(paper, part.alias("partition"))


def manual_pick(papers: DataFrame, paper: str, counts: tuple[tuple[str, int], ...] = (("train", 3), ("validation", 1), ("test", 1)), seed: int = 42) -> DataFrame:
    """(paper, partition): the first papers of a random order, as many as `counts` says for each partition in turn. Only those few rows are numbered."""
    total = sum(n for _, n in counts)
    picked = papers.select(paper).distinct().orderBy(seed_key(F.col(paper), seed), paper).limit(total)
    r = picked.withColumn("r", F.row_number().over(W.orderBy(seed_key(F.col(paper), seed), paper)))
    part, upto = F.when(F.lit(False), ""), 0
    for name, n in counts:
        upto += n
        part = part.when(F.col("r") <= upto, name)
    return r.select(paper, part.alias("partition"))


def one_paper_each(parts: DataFrame, sizes: DataFrame, paper: str, least: int = 20, held_out: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """(partition, paper): for each held-out partition its last paper with at least `least` references (`sizes`: paper, n_refs), else its first."""
    j = parts.filter(F.col("partition").isin(*held_out)).join(sizes, paper, "left")
    return j.groupBy("partition").agg(F.coalesce(F.max(F.when(F.col("n_refs") >= least, F.col(paper))), F.min(paper)).alias(paper))


def by_partition(rows: DataFrame, parts: DataFrame, paper: str, names: tuple[str, ...]) -> DataFrame:
    """The rows of papers in the partitions named, with `partition`."""
    return rows.join(parts.filter(F.col("partition").isin(*names)), paper)


def positives(labels: DataFrame) -> DataFrame:
    """A pair of each label record with its own true candidate: query, paper, cand_id, label 1."""
    return labels.select("query", "paper", F.col("true_id").alias("cand_id"), F.lit(1).alias("label"))


def hard_negatives(labels: DataFrame, n: int = 2, seed: int = 42) -> DataFrame:
    """Up to n other candidates of the same paper for each query, at random; never the true one.

    The distinct candidates of a paper stand in a random order; a query takes those that follow its own, from a place
    that its hash gives: a join by position of n + 1 rows for each record, which finds n others wherever there are any.
    """
    own = labels.filter("true_id is not null").select("query", "paper", "true_id")
    pool = own.select("paper", "true_id").distinct().withColumn("k", seed_key(F.col("true_id"), seed))
    pool = keep(row_numbers(pool, ["paper"], ["k", "true_id"], "r"), "pool")
    size = pool.groupBy("paper").agg(F.count("*").alias("n"))
    a = own.join(size, "paper").withColumn("first", F.pmod(seed_key(F.col("query"), seed), F.col("n")))
    a = a.select("query", "paper", "true_id", "n", "first", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("s")).filter("s < n").withColumn("r", F.pmod(F.col("first") + F.col("s"), F.col("n")))
    c = a.join(pool.select("paper", "r", F.col("true_id").alias("cand_id")), ["paper", "r"]).filter(F.col("cand_id") != F.col("true_id"))
    rank = F.row_number().over(W.partitionBy("query").orderBy("s"))
    return c.withColumn("rank", rank).filter(F.col("rank") <= n).select("query", "paper", "cand_id", F.lit(0).alias("label"))


def easy_negatives(labels: DataFrame, hard: DataFrame, total: int = 4, attempts: int = 50, seed: int = 42) -> DataFrame:
    """Fills each query up to `total` negatives with candidates of other papers, drawn by position in a random order, at most `attempts` draws."""
    p = labels.filter("true_id is not null").withColumn("k", seed_key(F.col("query"), seed + 1)).withColumn("b", F.floor(F.col("k") / 4194304).cast("int"))
    sizes = p.groupBy("b").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.sum("c").over(W.orderBy("b")) - F.col("c")).withColumn("n", F.sum("c").over(W.partitionBy()))
    pool = p.join(before, "b").select((F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("k", "query")) - 1).alias("at"), F.col("true_id").alias("cand_id"), F.col("paper").alias("other"), "n")
    need = labels.join(hard.groupBy("query").agg(F.count("*").alias("h")), "query", "left").withColumn("need", total - F.coalesce("h", F.lit(0)))
    n = pool.agg(F.max("n").alias("n"))
    found = None
    need = need.crossJoin(F.broadcast(n))
    lo = 0
    while lo < attempts:  # a few draws at first; only queries that still miss some draw again
        hi = min(attempts, lo + (total + 2 if not lo else 4 * lo))
        draws = need.select("query", "paper", "true_id", "need", "n", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("a"))
        draws = draws.withColumn("at", F.pmod(seed_key(F.concat_ws("-", F.col("query").cast("string"), F.col("a").cast("string")), seed), F.col("n")))
        got = draws.join(pool.drop("n"), "at").filter((F.col("other") != F.col("paper")) & (F.col("cand_id") != F.col("true_id"))).select("query", "paper", "need", "a", "cand_id")
        found = keep(got if found is None else found.unionByName(got), "negatives")
        have = found.groupBy("query").agg(F.count("*").alias("have"))
        need = keep(need.join(have, "query", "left").filter(F.coalesce("have", F.lit(0)) < F.col("need")).drop("have"), "need")
        lo = hi
        if need.isEmpty():
            break
    rank = F.row_number().over(W.partitionBy("query").orderBy("a"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= F.col("need")).select("query", "paper", "cand_id", F.lit(0).alias("label"))


def folds(df: DataFrame, row: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """df with `fold`: within each label the rows are dealt to k folds in a random order."""
    b = df.withColumn("_k", seed_key(F.col(row), seed)).withColumn("_b", F.floor(F.col("_k") / 4194304).cast("int"))
    sizes = b.groupBy(label, "_b").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.sum("_c").over(W.partitionBy(label).orderBy("_b")) - F.col("_c")).drop("_c")
    r = b.join(before, [label, "_b"]).withColumn("_r", F.col("_before") + F.row_number().over(W.partitionBy(label, "_b").orderBy("_k", row)) - 1)
    return r.withColumn("fold", F.pmod("_r", F.lit(k)).cast("int")).drop("_k", "_b", "_before", "_r")
