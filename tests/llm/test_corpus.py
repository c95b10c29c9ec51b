import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import leakage, packing, quality

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lan", "mir", "sol", "tun", "ver", "zad")]


def text(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


def fewest(sizes, capacity):
    """The least number of containers, by trying everything."""
    best, s = len(sizes), sorted(sizes, reverse=True)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(s):
            best = len(room)
            return
        for k in {x: k for k, x in enumerate(room) if x >= s[i]}.values():
            place(i + 1, [*room[:k], room[k] - s[i], *room[k + 1 :]])
        place(i + 1, [*room, capacity - s[i]])

    place(0, [])
    return best


def test_leaks(spark):
    items = spark.createDataFrame([(i, text(i)) for i in range(8)] + [(8, None), (9, "")], "item_id bigint, text string")
    w = [text(i).split() for i in range(8)]
    changed = list(w[2][10:50])
    for k in (5, 14, 23, 32):
        changed[k] = "other"
    docs = [
        (1, text(100) + " " + text(0) + " " + text(101)), (2, text(102).upper() + "\n" + ", ".join(w[1][20:50]) + "."), (3, text(103) + " " + " ".join(changed)), (4, " ".join(w[3][:15]) + " " + text(104)),
        (5, text(105)), (6, None), (7, ""), (8, text(106, 5000) + " " + text(4) + " " + text(107, 5000)), (9, " ".join(sorted(w[5]))), (10, text(0)), (10, text(0)),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    got = {tuple(r) for r in leakage.find_leaks(df, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (8, 4), (10, 0)}
    in_blocks = {tuple(r) for r in leakage.find_leaks(df, "doc_id", "text", items, "item_id", "text", block_items=1).collect()}
    assert in_blocks == got
    assert leakage.find_leaks(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leakage.find_leaks(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_leaks_changed_as_much_as_may_be(spark):
    w = [text(200 + i).split() for i in range(6)]
    frame = "on the {} of march we took {} pages of the {} in the old hall at the {} sea for the first"
    fill = lambda k: frame.format(*[f"name{k}x{j}" for j in range(4)])
    items = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(w)] + [(6, "Zeta qux nine"), (7, f"{text(300, 20)} {fill(0)} three of them {text(301, 20)}")], "item_id bigint, text string")
    docs = [(0, text(400) + " zeta, QUX nine. " + text(401)), (1, "zeta qux nine"), (2, "zeta qux eight nine and others")]
    for i, x in enumerate(w):
        y = x[20:45]
        for k in (3, 9, 15, 21):
            y[k] = f"other{k}"
        docs.append((10 + i, f"{text(500 + i)} {' '.join(y)} {text(600 + i)}"))
        docs.append((20 + i, " ".join(f"new{k}" if k % 6 == 0 else v for k, v in enumerate(x))))
    docs += [(100 + k, f"{text(700 + k)} {fill(k)} {text(800 + k)}") for k in range(1, 12)]
    docs.append((99, f"{text(900)} {fill(99)} three of them {text(901)}"))
    got = {tuple(r) for r in leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(0, 6), (1, 6)} | {(10 + i, i) for i in range(6)} | {(20 + i, i) for i in range(6)}


def test_subsequence():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 6, (200, 25)), rng.integers(0, 6, (200, 50))
    assert leakage.common_subsequences(a, b).tolist() == [leakage.common_subsequence(x, y) for x, y in zip(a.tolist(), b.tolist())]
    numbers = np.unique(rng.integers(1, 1 << 62, 3000).astype(np.uint64))
    asked = np.r_[numbers[::3], rng.integers(1, 1 << 62, 500).astype(np.uint64), np.uint64(0)]
    assert leakage.Lookup(numbers)(asked).tolist() == leakage._local(asked, numbers).tolist()
    assert leakage.common_subsequence([1, 2, 3, 4], [2, 9, 4, 1]) == 2 and leakage.common_subsequence([], [1]) == 0


@pytest.mark.parametrize("seed", range(6))
def test_containers(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 100, 300).tolist()
    bins = packing.complete(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(packing.best_fit(sizes, 100)) and packing.lower_bound(sizes, 100) <= len(bins) <= packing.lower_bound(sizes, 100) + 2
    rng = np.random.default_rng(7)
    beaten = 0
    for _ in range(60):
        few = rng.integers(20, 51, int(rng.integers(6, 10))).tolist()
        best = fewest(few, 100)
        assert len(packing.complete(few, 100)) == best, few
        beaten += len(packing.best_fit(few, 100)) > best
    hard = rng.integers(500, 901, 600).tolist()
    assert len(packing.complete(hard, 2048)) < len(packing.best_fit(hard, 2048)) and sorted(i for x in packing.complete(hard, 2048) for i in x) == list(range(600))
    assert packing.complete([], 10) == [] and len(packing.complete([10, 10], 10)) == 2


def test_pack(spark):
    pytest.importorskip("tiktoken")
    rows = [(1, "word " * 10), (2, None), (3, ""), (4, "word " * 100), (5, "a"), (6, "word " * 32)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("container", F.lit(1))
    got = packing.pack(df, "doc_id", "text", capacity=32).toPandas()
    assert got.groupby("container").n_tokens.sum().max() <= 32
    total = {r.id: r.tokens for r in packing.count_tokens(df, "doc_id", "text").collect()}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == total and set(total) == {1, 4, 5, 6}
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


def test_quality(spark):
    docs = quality.labelled_documents(1200, seed=99)
    rules = quality.learn(spark)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)] + [(-1, None), (-2, " \n ")], "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    got = {r.doc_id: r.kind for r in quality.classify(df, "doc_id", "text", rules=rules).collect()}
    assert set(got) == {i for i, (_, t) in enumerate(docs) if t.strip()}
    right = np.mean([got[i] == k for i, (k, t) in enumerate(docs) if i in got])
    assert right > 0.93, right
    assert quality.classify(df.limit(0), "doc_id", "text", rules=rules).count() == 0


def test_statistics(spark):
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    df = spark.createDataFrame([(1, "The cat sat.\nthe dog"), (2, "x" * 200_000)], "doc_id bigint, text string")
    s = {r.id: r for r in quality.statistics(df, "doc_id", "text", common).collect()}
    assert s[1].words == 5 and s[1].lines == 2 and s[1].ends == 0.5 and s[1].common == 0.4 and s[2].words == 1


def test_words_of_other_scripts(spark):
    common = spark.createDataFrame([("en", f"a{i:05d}") for i in range(6000)] + [("en", "zzz")], "lang string, word string")
    texts = ["Новый метод — очень быстрый, ДА!", "नई विधि है।", "結果は良い。Ab 3", "zzz ٣٤ a|b|c", "?!"]
    s = {r.id: r for r in quality.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id", "text", common).collect()}
    assert [s[i].words for i in range(5)] == [5, 3, 7, 5, 0]
    assert s[0].mean_word == 24 / 5 and s[0].upper == 3 / 24 and s[1].mean_word == 8 / 3 and s[2].mean_word == 8 / 7 and s[4].mean_word == 0
    assert s[3].digits == 2 / 12 and s[3].bars == 1 and s[3].common > 0 and s[0].commas == 1 / 5


def test_rules():
    x = {"a": np.arange(90.0), "b": np.zeros(90)}
    y = np.array(["junk"] * 30 + ["prose"] * 60, object)
    rules = quality.induce_rules(x, y)
    assert rules and (quality.predict(rules, x, 90) == y).mean() > 0.95
    assert quality.rules_sql([]) == "'prose'" and "CASE WHEN a <=" in quality.rules_sql(rules)
