import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import forest

SCHEMA = "t string, c string, p string, o bigint"


def brute(rows):
    trees = {}
    for t, c, p, _ in rows:
        if c is None:
            continue
        p = p if p and p.strip() else None
        k = trees.setdefault(t, {})
        if c not in k or k[c] is None or (p is not None and p < k[c]):
            k[c] = p
    out = set()
    for t, k in trees.items():
        for c in k:
            x, path, seen = c, [c], set()
            while x in k and k[x] is not None:
                if x in seen:
                    path = None
                    break
                seen.add(x)
                x = k[x]
                path.append(x)
            out.add((t, c, "" if path is None else x, -1 if path is None else len(path) - 1, None if path is None else tuple(path[::-1])))
    return out


@pytest.mark.parametrize("size", [50_000, 7, 3])
def test_against_walks(spark, size):
    r = random.Random(size)
    rows = []
    for t in ("a", None):
        for i in range(40):
            p = r.choice([None, "", " "]) if r.random() < 0.05 else f"n{r.randint(max(0, i - 6), max(0, i - 1) if r.random() > 0.1 else i + 1)}"
            rows += [(t, f"n{i}", p, len(rows))] * r.choice([1, 1, 2])
    rows.append(("a", None, "n1", 99))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clashing"))
    got = {(x.t, x.c, x.root_id, x.depth, tuple(x.path) if x.path is not None else None) for x in forest.resolve_forest(df, ["t"], "c", "p", "o", True, size).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("near", [True, False])
def test_levels(spark, monkeypatch, near):
    """Long chains over many fragments: solved level by level where parents are near in the order of rows, by doubling where they are anywhere."""
    used = []
    for name in ("_solve", "_doubling"):
        monkeypatch.setattr(forest, name, lambda *a, f=getattr(forest, name), n=name: used.append(n) or f(*a))
    monkeypatch.setattr(forest, "WIDER", 4)
    monkeypatch.setattr(forest, "PATH_ENTRIES", 50)
    r = random.Random(5)
    rows = [("a", f"n{i}", "" if not i else f"n{i - 1 if r.random() < 0.9 else max(0, i - r.randint(1, 3))}", i) for i in range(150)]
    rows += [("a", f"c{i}", f"c{(i + 1) % 9}", 150 + i) for i in range(9)] + [("a", "below", "c3", 159), ("b", "n1", "n0", 160), ("b", "x" * 5000, "n1", 161)]
    if not near:
        order = list(range(len(rows)))
        r.shuffle(order)
        rows = [(t, c, p, o) for (t, c, p, _), o in zip(rows, order)]
    got = {(x.t, x.c, x.root_id, x.depth, tuple(x.path) if x.path is not None else None) for x in forest.resolve_forest(spark.createDataFrame(rows, SCHEMA), ["t"], "c", "p", "o", True, 6).collect()}
    assert got == brute(rows)
    assert used.count("_solve") > 1 if near else "_doubling" in used, used


def test_empty_and_descendants(spark):
    assert forest.resolve_forest(spark.createDataFrame([], SCHEMA), ["t"], "c", "p", "o").count() == 0
    df = spark.createDataFrame([("a", "x", "r", 1), ("a", "y", "x", 2), ("a", "z", "z", 3)], SCHEMA)
    p = forest.resolve_forest(df, ["t"], "c", "p", "o", with_path=True)
    assert {tuple(x) for x in forest.descendants(p, ["t"], "c").collect()} == {("a", "r", "x", 1), ("a", "r", "y", 2), ("a", "x", "y", 1)}
    with pytest.raises(ValueError):
        forest.resolve_forest(df, ["no"], "c", "p", "o")
