import json

from pyspark.sql import functions as F

from quillspark import sources
from quillspark.plans import pipeline
from quillspark.session import drop_kept, keep, spread
from quillspark.sources import sinks


def test_data_set_is_merged_and_read_again(spark, tmp_path):
    record = lambda key, authors=("A B",): {"key": key, "content": "c", "ground_truth": {"id": "1", "title": "t", "authors": [*authors], "submission_date": "2001-02-03", "match_score": 1.0}, "source_paper_id": "p"}
    for part, name, records in (("train", "manual", [record("k1", (" A B ", "A B", ""))]), ("train", "auto", [record("k2"), record("k2"), record("k3", ())]), ("test", "auto", [record("k4")]), ("other", "auto", [record("k5")])):
        (tmp_path / "in" / part).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / part / f"{name}.json").write_text(json.dumps(records))
    (tmp_path / "in" / "validation").mkdir()
    (tmp_path / "in" / "validation" / "auto.json").write_text("not json [")
    d = {r.key: r for r in sources.dataset(spark, str(tmp_path / "in")).collect()}
    assert set(d) == {"k1", "k2", "k4"} and d["k1"].gt_authors == ["A B"] and d["k1"].gt_year == "2001" and d["k4"].partition == "test"
    assert pipeline.merge(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {"manual": 1, "auto": 2}
    assert {(r.partition, r.source_type) for r in spark.read.json(str(tmp_path / "out")).collect()} == {("train", "manual"), ("train", "auto"), ("test", "auto")}


def test_cleaned_samples_and_candidates_of_two_places(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["x", None]), (2, None)], "i int, a array<string>")
    sinks.cleaned_samples(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "parquet")).count() == spark.read.json(str(tmp_path / "s" / "json")).count() == 2
    for place, paper, title in (("a", "p1", "From A"), ("b", "p1", "From B"), ("b", "p2", "Only B")):
        (tmp_path / place / paper).mkdir(parents=True)
        (tmp_path / place / paper / "references.json").write_text(json.dumps({"1": {"title": title}}))
    pattern = r"/([^/]+)/references\.json$"
    places = [f"{tmp_path}/{x}/*/references.json" for x in ("gone", "a", "b")]
    got = {r.paper_id: r.title for r in sources.candidates_of(spark, places, [pattern] * 3).collect()}
    assert got == {"p1": "from a", "p2": "only b"}
    assert sources.candidates_of(spark, places[:1], [pattern]).count() == 0


def test_spread_and_dropped_tables(spark):
    df = spark.range(100).coalesce(1)
    assert spread(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(df, "id").count() == 100
    k = keep(df.withColumn("x", F.col("id") * 2), "t")
    files = k.inputFiles()
    drop_kept(k)
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
