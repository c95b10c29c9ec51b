import math
from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import dataset as D, matching as M, ranking as K
from quillspark.plans import model, reference_queries
from quillspark.streaming import first_seen


def test_match(spark):
    q = spark.createDataFrame([("p", 1, "Deep nets for small data 2001", "Deep nets for small data"), ("p", 2, "graphs of shallow water waves 2010", ""), ("p", 3, "nothing alike", "")], "paper_id string, query int, text string, title string")
    c = spark.createDataFrame([("p", "a", "deep nets for small data", "X", "1990"), ("p", "b", "Shallow water waves, graphs", "Y", "2001"), ("p", "c", "Shallow water waves graphs again", "Z", "2010"), ("p", "d", "unrelated title", "Z", "2010")], "paper_id string, cand_id string, title string, authors string, year string")
    got = {r["query"]: r.cand_id for r in M.match(q, c, ["paper_id"], threshold=0.3).collect()}
    assert got == {"1": "a", "2": "c"}


def test_sets(spark):
    labels = spark.createDataFrame([(i, f"p{i % 3}", f"c{i}") for i in range(12)], "query int, paper string, true_id string")
    hard = D.hard_negatives(labels)
    easy = D.easy_negatives(labels, hard)
    truth = {i: (f"p{i % 3}", f"c{i}") for i in range(12)}
    paper = {f"c{i}": f"p{i % 3}" for i in range(12)}
    h = hard.collect()
    assert len(h) == 24 and all(r.cand_id != truth[r["query"]][1] and paper[r.cand_id] == r.paper for r in h)
    e = easy.collect()
    assert len(e) == 24 and all(paper[r.cand_id] != r.paper for r in e)
    f = D.folds(labels.withColumn("label", F.col("query") % 2), "query", "label", 3).groupBy("label", "fold").count().collect()
    assert all(r["count"] == 2 for r in f) and len(f) == 6
    parts = {r.partition: r["count"] for r in D.split_papers(labels.withColumn("paper_id", F.col("true_id")), "paper_id").groupBy("partition").count().collect()}
    assert parts == {"train": 9, "validation": 1, "test": 2}


def test_ranking(spark):
    s = spark.createDataFrame([(q, f"c{i}", float(i)) for q in (1, 2, 3) for i in range(7)], "key int, cand_id string, score double")
    top = K.top_k(s, ["key"], "score", "cand_id")
    assert top.count() == 15
    truth = spark.createDataFrame([(1, "c6"), (2, "c3"), (3, "zz")], "key int, true_id string")
    rr = {r.key: r.rr for r in K.reciprocal_rank(top, truth, ["key"]).collect()}
    assert rr == {1: 1.0, 2: 0.25, 3: 0.0}
    lab = spark.createDataFrame([(1, "p", "k", "a"), (2, "p", "k", "b"), (3, "p", " ", "c"), (4, None, "k", "d")], "label_id int, paper string, key string, true_id string")
    assert [tuple(r) for r in K.ground_truth(lab).collect()] == [("p", "k", "b")]


def test_pool_ranking(spark, tmp_path):
    rows, n = [], 0
    for paper in range(12):
        titles = [f"{a}{paper} of {b} waves" for a, b in zip(("deep", "shallow", "cold", "warm", "late", "early", "thin"), ("red", "blue", "grey", "pink", "black", "white", "green"))]
        for i, t in enumerate(titles):
            for j, label in ((i, 1), ((i + 1) % 7, 0)) if i else ((1, 0), (2, 0)):
                rows.append((n, f"p{paper}", paper * 10 + i, t, ["A B"], "", "2001", f"c{paper}_{j}", titles[j], ["A B"], "2001", label))
                n += 1
        rows.append((n, f"p{paper}", paper * 10 + 9, "nothing alike", ["C"], "", "1990", f"c{paper}_0", titles[0], ["A B"], "2001", None))
        n += 1
    cols = "pair_id bigint, paper_id string, bib_no bigint, bib_title string, bib_authors array<string>, bib_id string, bib_year string, cand_id string, cand_title string, cand_authors array<string>, cand_year string, label int"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/pairs.parquet")
    top = reference_queries.rank_pool_top5(spark, str(tmp_path)).collect()
    assert len(top) == 12 * 8 * 5
    # the right candidate of the first record stands only in another record's row
    assert {r.cand_id for r in top if r["rank"] == 1 and r.bib_no % 10 == 0} == {f"c{p}_0" for p in range(12)}
    assert {r.partition: (r.n_queries, r.mrr) for r in reference_queries.mrr_pool(spark, str(tmp_path)).collect()} == {"train": (54, 1.0), "validation": (6, 1.0), "test": (12, 1.0)}


def test_model(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 2), 1.0, i % 2, i % 5) for i in range(60)], "f double, g double, label int, fold int")
    m = model.cross_validate(df, ["f", "g"], ("decision_tree",)).first()
    assert m.accuracy == m.f1 == m.auc == 1.0
    name, chosen = model.best_model(model.cross_validate(df, ["f", "g"], ("decision_tree", "logistic_regression"), k=2), df, ["f", "g"])
    assert name in ("decision_tree", "logistic_regression") and chosen.transform(df).count() == df.count()
    t = model.train(df, ["f", "g"])
    t.write().overwrite().save(f"{tmp_path}/m")
    assert model.coefficients(t, ["f", "g"])[0][0] == "f"
    assert model.score(t, df.drop("label")).filter("f = 1").first().score > 0.9
    assert K.correlations(df, ["f", "g"], "label").filter("feature = 'g'").first().corr is None


def test_classifiers_of_the_survey(spark, monkeypatch):
    made = model.classifiers(40)
    assert (made["boosted_trees"][0].getMaxIter(), made["boosted_trees"][0].getMaxDepth(), made["logistic_regression"][-1].getRegParam()) == (100, 6, 1 / 40)
    df = spark.createDataFrame([(float(i % 2), i % 2, i % 5) for i in range(40)], "f double, label int, fold int")
    asked = []
    train = model.train
    monkeypatch.setattr(model, "train", lambda d, features, name: asked.append(name) or train(d, features, "logistic_regression"))
    assert {r.model for r in model.cross_validate(df, ["f"], k=1).collect()} == {"boosted_trees", "decision_tree", "logistic_regression"} == set(asked)


def test_stream(spark, tmp_path):
    rows = [("p", "Ref one", "2024-01-01 00:00:00"), ("p", "ref ONE!", "2024-01-01 05:00:00"), ("q", "Ref one", "2024-01-01 06:00:00")]
    df = spark.createDataFrame(rows, "paper_id string, raw_text string, extracted_at string").withColumn("extracted_at", F.to_timestamp("extracted_at"))
    df.write.parquet(f"{tmp_path}/in")
    q = first_seen(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2


def scoped_cosine(rows, min_df):
    """By the definition: rows of scope, pair_id and two titles that are clean."""
    cut = lambda t: Counter(w[i : i + n] for w in (f" {x} " for x in t.split()) for n in (2, 3, 4) for i in range(max(len(w) - n + 1, 1)))
    out = []
    for scope, pair_id, a, b in rows:
        titles = {t: cut(t) for r in rows if r[0] == scope for t in r[2:] if t}
        df = Counter(x for t in titles.values() for x in t)
        w = {t: {x: k * (math.log((1 + len(titles)) / (1 + df[x])) + 1) for x, k in c.items() if df[x] >= min_df} for t, c in titles.items()}
        dot = sum(v * w[b].get(x, 0) for x, v in w[a].items()) if a and b and scope is not None else 0
        out.append((pair_id, round(dot and dot / math.sqrt(sum(v * v for v in w[a].values()) * sum(v * v for v in w[b].values())), 6)))
    return sorted(out, key=str)


def titled_pairs(spark):
    rows = [(f"p{i % 4}" if i % 11 else None, i if i != 39 else None, f"a {'wave' if i % 3 else 'waves é'} no {i % 7}", f"the waves of {i % 5} é {'x' * (i % 2 * 40)}".strip()) for i in range(40)]
    rows += [("p1", 40, "", "late waves"), ("p1", 41, "", ""), ("p2", 42, "same waves", "same waves"), ("p3", 42, "again 42", "twice 42"), ("lone", 43, "one of its own", "another")]
    return rows, spark.createDataFrame([(s, i, f"  {a.upper()}" if a else None, b) for s, i, a, b in rows], "paper_id string, pair_id bigint, bib_title string, cand_title string").repartition(3)


def test_titles_of_a_paper_are_held_and_large_papers_in_parts(spark, monkeypatch):
    rows, p = titled_pairs(spark)
    for min_df in (1, 2):
        want = scoped_cosine(rows, min_df)
        held = M.title_cosine(p, ["paper_id"], min_df)
        assert sorted(map(tuple, held.collect()), key=str) == want
        plan = held._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan  # no row for each piece of each title
        with monkeypatch.context() as m:
            m.setattr(M, "HELD", 300)
            both = M.title_cosine(p, ["paper_id"], min_df)
            plan = both._jdf.queryExecution().optimizedPlan().toString()
            assert "Generate" not in plan and "CoGroup" in plan
            assert sorted(map(tuple, both.collect()), key=str) == want


def test_titles_of_a_single_pair(spark, monkeypatch):
    rows, p = titled_pairs(spark)
    own = [(i, *r[1:]) for r in rows for i in [r[1]]]
    for min_df in (1, 2, 3):
        want = scoped_cosine(own, min_df)  # the two pairs 42 are one scope
        got = M.title_cosine(p, ["pair_id"], min_df)
        assert sorted(map(tuple, got.collect()), key=str) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
    monkeypatch.setattr(M, "HELD", 90)
    assert sorted(map(tuple, M.title_cosine(p, ["pair_id"], 1).collect()), key=str) == scoped_cosine(own, 1)
