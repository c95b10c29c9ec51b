import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import copies, splits


def test_copies(spark):
    rows = [
        (1, "@article{K1, title = {A b: c}, year = {1999},}"), (2, '@Article{k1,\n year="1999", title="a B - C"}'), (3, "@article{k1, title={A b c}, year={1998}}"), (4, "@article{k2, title={A b c}, year={1999}}"),
        (5, r"One. \newblock Two"), (6, r"TWO \newblock one;"), (7, None), (8, " .,; "), (9, "Two one"), (10, "x" * 100_000), (11, "X" * 100_000 + "."),
    ]
    df = spark.createDataFrame(rows, "ref_id bigint, raw_text string").withColumns({"h": F.lit(1), "first_id": F.lit(2)})
    assert {tuple(r) for r in copies.copy_pairs(df, "ref_id", "raw_text").collect()} == {(1, 2), (5, 6), (10, 11)}
    counts = {r.first_id: r.copies for r in copies.count_copies(df, "ref_id", "raw_text").collect()}
    assert counts == {1: 2, 3: 1, 4: 1, 5: 2, 9: 1, 10: 2}
    assert copies.copy_pairs(df.limit(0), "ref_id", "raw_text").count() == 0


def test_copies_by_characters(spark):
    rows = [
        (1, "@article{k1,\n\u00a0\u00a0 title\u00a0=\u00a0{Caf\u00e9 Stra\u00dfe},\n\u00a0year = 1999}"), (2, "@ARTICLE{K1, year = {1999}, title = {CAFE\u0301 STRASSE}}"), (3, "@article{k1, title = {Cafe Strasse}, year = 1999}"),
        (4, "A. Author, Title, 1(23):4--5"), (5, "A. Author, Title, 12(3):4--5"), (6, "a author title 1 23: 4-5"), (7, "Vol 1,000 of 2,345,678"), (8, "vol. 1000, of 2345678"),
    ]
    df = spark.createDataFrame(rows, "ref_id bigint, raw_text string")
    assert {tuple(r) for r in copies.copy_pairs(df, "ref_id", "raw_text").collect()} == {(1, 2), (4, 6), (7, 8)}


def test_hot_copies(spark):
    df = spark.range(120_000).select(F.col("id").alias("ref_id"), F.when(F.col("id") % 2 == 0, "Same, text!").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("raw_text"))
    got = copies.copy_pairs(df, "ref_id", "raw_text")
    assert got.agg(F.count("*"), F.min("first_id"), F.max("first_id"), F.countDistinct("copy_id")).first() == (59_999, 0, 0, 59_999)


def test_collisions_stay_apart(spark):
    rows = spark.createDataFrame([(1, b"h", 1), (2, b"h", 2), (3, b"h", 1)], "id bigint, h binary, x bigint")
    assert {(r.first_id, r.copies, r.collided) for r in copies.copy_groups(rows).collect()} == {(1, 2, True), (2, 1, True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_spanning_forest(spark, seed):
    r = random.Random(seed)
    edges = [(f"v{r.randint(0, 60)}", f"v{r.randint(0, 60)}", str(r.randint(0, 9))) for _ in range(45)]
    forest, roots = splits.boruvka(spark.createDataFrame(edges, "u string, v string, w string"))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v, _ in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    looped = {u for u, v, _ in edges if u == v}
    want = {v: find(v) for v in up if v not in looped or any(v in e[:2] and e[0] != e[1] for e in edges)}
    got = {x.vertex: x.root for x in roots.collect()}
    assert got == want
    assert forest.count() == len(got) - len(set(got.values()))


def test_related(spark):
    rows = [(1, "ref_1", "2301-00001"), (2, "ref_1", "arXiv:2301.00001v2"), (3, "Smith 2001", "2302.00001"), (4, "smith2001", " 2303-00001/"), (5, "ref_1", None), (6, None, None), (7, "", "2303-00001"), (8, "REF-2", "2301-00002"), (9, " ", "")]
    df = spark.createDataFrame(rows, "label_id bigint, key string, source_paper_id string").withColumn("root", F.lit("x"))
    groups, _ = splits.related(df)
    assert {tuple(r) for r in splits.group_pairs(groups).collect()} == {(1, 2), (3, 4), (3, 7)}
    groups, forest = splits.related(df.limit(0))
    assert groups.count() == 0 and forest.count() == 0


def test_deal_few_uneven_groups(spark):
    groups = spark.createDataFrame([(i, "big" if i < 98 else f"g{i % 31}") for i in range(613)], "id bigint, root string")
    got = splits.deal_splits(groups)
    n = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert got.count() == 613 and abs(n["train"] / 613 - 0.8) < 0.03 and abs(n["validation"] / 613 - 0.1) < 0.03
    assert got.groupBy("root").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] == 1
    small = splits.deal_splits(groups, large=5)
    assert small.count() == 613 and splits.deal_splits(groups.limit(0)).count() == 0


def test_deal(spark):
    groups = spark.createDataFrame([(i, f"g{i // 3 if i < 300 else i}") for i in range(1300)], "id bigint, root string")
    got = splits.deal_splits(groups)
    assert got.groupBy("root").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] == 1
    n = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert abs(n["train"] - 1040) <= 12 and abs(n["test"] - 130) <= 12 and sum(n.values()) == 1300
