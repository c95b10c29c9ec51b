from pyspark.sql import functions as F

from quillspark.llm import linkage, names


def test_names(spark):
    groups = [
        ["Joseph Leila Tumrarodi", "J. L. Tumrarodi", "Tumrarodi JL", "Joe Tumrarodi", "tumrarodi, joseph", "Joseph  Tumrarodi.", "Joseph Leila TUMRARODI", "Joseph Tumrraodi"],
        ["Elif Tumrarodi", "Tumrarodi, E."], ["Susanna Gosfómina", "Susanna Gosf{\\'o}mina", "S. Gosfomina"], ["The Vevlalati Collaboration", "Collaboration, Vevlalati", "Vevlalati collaboration", "Vevlalati Collab."],
        ["Rebecca van Camzosoza", "van Camzosoza, R."], ["Hui-Min Lanzoliko", "H.-M. Lanzoliko", "Lanzoliko HM", "Lanzoliko Hui-Min"], ["Li Wei", "Wei, L."],
    ]
    rows = [(n,) for g in groups for n in g] + [("et al.",), ("others",), (None,), (" ",), ("and others",), ("Elif Tumrarodi",)]
    linked = names.link_names(spark.createDataFrame(rows, "name string").withColumn("entity", F.lit("x")))
    got = {(r.name_a, r.name_b) for r in names.name_pairs(linked).collect()}
    want = {(a, b) for g in groups for a in g for b in g if a < b}
    assert got - want == set() and len(want - got) <= 2, (want - got, got - want)
    assert names.link_names(spark.createDataFrame([], "name string")).count() == 0


def test_name_parts():
    assert names.parse("et al.") is None and names.parse("Others") is None and names.parse("123") is None
    assert names.one_slip("abcd", "abdc") and names.one_slip("abc", "abxc") and not names.one_slip("abcd", "badc")
    assert names.jaro_winkler("martha", "marhta") == 0.9611111111111111


def test_name_blocks():
    assert names.phonetic("王") != names.phonetic("伟") and names.phonetic("Петров".lower()) != names.phonetic("павлов")
    r = __import__("random").Random(3)
    words = ["tumrarodi", "kerratima", "li", "wang", "овсов"]
    for _ in range(300):  # whatever differs by one slip shares a key
        a = r.choice(words)
        i = r.randrange(len(a))
        b = r.choice([a[:i] + a[i + 1 :], a[:i] + "x" + a[i:], a[:i] + "x" + a[i + 1 :], a[:i] + a[i : i + 2][::-1] + a[i + 2 :]])
        if b and names.one_slip(a, b):
            assert set(names.block_keys(a, ["anna"])) & set(names.block_keys(b, ["anna"])), (a, b)
            assert set(names.block_keys("bell", [a])) & set(names.block_keys("bell", [b])) or min(len(a), len(b)) < 2, (a, b)
    assert names.block_keys("wang", []) == []


def test_a_family_of_many(spark):
    """Everybody is called Wang: written-out names don't meet each other, and initials go to the one spelt in most ways."""
    given = [a + b for a in ("ba", "do", "fe", "gu", "ki") for b in ("lan", "mir", "sol", "tun", "ver", "zad", "bek", "dor")]
    rows = [(f"{g.title()} Wang",) for g in given] + [(f"Wang, {g.title()}",) for g in given[:20]] + [("Wang, B.",)]
    got = {r.name: r.entity for r in names.link_names(spark.createDataFrame(rows, "name string")).collect()}
    assert len({got[f"{g.title()} Wang"] for g in given}) == len(given) and all(got[f"Wang, {g.title()}"] == got[f"{g.title()} Wang"] for g in given[:20])
    assert got["Wang, B."] in {got[f"{g.title()} Wang"] for g in given if g[0] == "b"}


def test_works(spark):
    rows = [
        (1, "Deep {Nets} for Small Data (preprint)", ["Ann Bell", "C. Dorn"], "2001", "x1", "Deep nets for small data", ["Ann Bell", "Carl Dorn"], "2001"),
        (2, "Deep nets for small data, Part II", ["Ann Bell", "Carl Dorn"], "2003", "x2", "Deep nets for small data: Part 2", ["A. Bell", "C. Dorn"], "2003"),
        (3, "Comment on Deep nets for small data", ["Eve Fox"], "2002", "x3", "Erratum: Deep nets for small data", ["Ann Bell", "Carl Dorn"], "2002"),
        (4, "Deep nets for small data", ["Gil Hunt"], "2010", "x4", "Something else entirely here", ["Ivy Jones"], "1990"),
        (5, "Deep nfts for smlal data", ["Bell, A.", "et al."], None, "x1", "Deep nets for small data", ["Ann Bell", "Carl Dorn"], "2001"), (6, None, [], None, None, None, None, None), (7, "", None, "", "x4", "Something else entirely here", ["Ivy Jones"], "1990"),
    ]
    df = spark.createDataFrame(rows, "bib_no bigint, bib_title string, bib_authors array<string>, bib_year string, cand_id string, cand_title string, cand_authors array<string>, cand_year string").withColumn("s", F.lit(1))
    got = {(r.bib_no, r.cand_id) for r in linkage.link_works(df).collect()}
    assert got == {(1, "x1"), (2, "x2"), (5, "x1")}
    assert linkage.link_works(df.limit(0)).count() == 0


def test_titles():
    assert linkage.title_parts("Erratum: On X: Part II (in press)") == (["on", "x"], ["erratum"], [2])
    assert linkage.title_parts(None) == ([], [], [])
