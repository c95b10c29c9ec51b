"""Splits that keep related records together.

Records hang on the papers they cite from and the entries they cite. Papers are the vertices; each cited entry ties
all papers it occurs in to the first of them. Borůvka rounds contract the graph: every component takes its smallest
edge to another one, the chosen edges are kept as a spanning forest, a table that says why records are together, and
the components they join become one. The roots are stratified by the size of their group and dealt to the splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.session import drop_kept, keep


def paper_form(c: Column) -> Column:
    """One form of a paper id: without address, `arXiv:`, version, punctuation, spaces and case. Blank gives null."""
    s = F.regexp_replace(F.lower(c), r"[\s\u00a0]+", "")
    s = F.regexp_replace(s, r"^https?://(www\.)?[^/]*/(abs|pdf)/", "")
    s = F.regexp_replace(s, r"^arxiv[:.]?", "")
    s = F.regexp_replace(s, r"(\.pdf)?/*$", "")
    s = F.regexp_replace(s, r"(?<=\d)v\d+$", "")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}]+", "")
    return F.when(s != "", s)


def key_form(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return F.when(s != "", s)


def boruvka(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v, w string): the forest (u, v, w), and (vertex, root) of every vertex, root being the smallest vertex of its component.

    Each round the components at least halve, but for those that are finished. Edges must not be few per vertex:
    parallel edges and loops are dropped on the way. Ties in w go to the smaller edge (the order is w, u, v).
    """
    e = edges.filter(F.col("u") != F.col("v")).select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w"
    ).groupBy("u", "v").agg(F.min("w").alias("w"))
    first = keep(e, "edges")
    # live edges: ends a, b of the components, and the edge itself
    live = first.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("w", "u", "v").alias("e"))
    comp, forest = None, None
    vertices = first.select(F.col("u").alias("vertex")).union(first.select(F.col("v"))).distinct()
    comp = vertices.select("vertex", F.col("vertex").alias("root"))
    chosen_from: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        best = both.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.e").alias("e"))
        best = keep(best, "best")
        chosen_from.append(best)
        chosen = best.select("e.*").distinct().select("u", "v", "w")
        forest = chosen if forest is None else forest.unionByName(chosen)
        # hooks: a -> b; of two that chose the same edge the smaller is the root
        back = best.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("mutual"))
        hook = best.join(back, ["a", "b"], "left").select(
            "a", F.when(F.col("mutual") & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("up")
        )
        hook = keep(hook, "hook")
        while True:  # pointer doubling, to the root of each tree of hooks
            top = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
            step = keep(hook.join(top, "up").select("a", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "hook")
            drop_kept(hook)
            hook = step.select("a", "up")
            if step.filter("moved").isEmpty():
                break
        ra = hook.select(F.col("a"), F.col("up").alias("ra"))
        rb = hook.select(F.col("a").alias("b"), F.col("up").alias("rb"))
        old = (live, comp) if len(chosen_from) > 1 else ()
        live = live.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "e")
        live = keep(
            live.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "e").groupBy("a", "b").agg(F.min("e").alias("e")),
            "live",
        )
        comp = keep(
            comp.join(hook.select(F.col("a").alias("root"), F.col("up").alias("new")), "root", "left").select("vertex", F.coalesce("new", "root").alias("root")), "comp"
        )
        for d in (hook, *old):
            drop_kept(d)
    if forest is None:
        forest = first.select("u", "v", "w").limit(0)
    small = comp.groupBy("root").agg(F.min("vertex").alias("least"))
    forest = keep(forest, "forest")
    for d in chosen_from:
        drop_kept(d)
    return forest, comp.join(small, "root").select("vertex", F.col("least").alias("root"))


def related(records: DataFrame, record_id: str = "label_id", paper: str = "source_paper_id", key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(id, vertex, root) of every record, and the spanning forest. Records with the same root stay together.

    The same paper, in whatever form, ties; so does the same key, up to case, spaces and punctuation, unless it is
    `ref_<n>`, which is local to its paper. Null and blank values tie nothing: a record without a paper is a
    vertex of its own. Repeated rows and columns not named are of no effect.
    """
    k = key_form(F.col(key))
    r = records.select(
        F.col(record_id).alias("id"),
        F.coalesce(F.concat(F.lit("p"), paper_form(F.col(paper))), F.concat(F.lit("r"), F.col(record_id).cast("string"))).alias("vertex"),
        F.when(~k.rlike(r"^ref\d+$"), k).alias("k"),
    )
    r = keep(r, "records")
    on = r.filter(F.col("k").isNotNull()).select("k", "vertex").distinct()
    hub = on.groupBy("k").agg(F.min("vertex").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    edges = on.join(hub, "k").select(F.col("hub").alias("u"), F.col("vertex").alias("v"), F.col("k").alias("w"))
    forest, roots = boruvka(edges)
    out = r.join(roots, "vertex", "left").select("id", "vertex", F.coalesce("root", "vertex").alias("root"))
    return out, forest


def group_pairs(groups: DataFrame) -> DataFrame:
    """(first_id, other_id): each member of a group but the smallest beside the smallest."""
    g = keep(groups, "groups")
    first = g.groupBy("root").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("root", "first_id")
    return g.join(first, "root").filter(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("other_id"))


def deal_splits(groups: DataFrame, shares: tuple[tuple[str, int], ...] = (("train", 8), ("validation", 1), ("test", 1)), buckets: int = 1024, large: int = 1000) -> DataFrame:
    """(id, root, split): groups dealt so that the records, not the groups, come in the given shares.

    Groups that hold at least one record in `large` (so there are at most `large` of them, whatever the data) go one by
    one, the largest first, to the split that lacks most. The others are stratified by size (bands by powers of two);
    each band is dealt systematically: in the order of their hash the groups that cover a split's share of what is
    still lacking go to it. That needs no global sort: records are counted by band and hash bucket, the counts (at
    most 64 x buckets rows) are summed up, and each bucket goes on from there. No records give no rows.
    """
    from pyspark.sql import Window

    total = sum(n for _, n in shares)
    size = keep(groups.groupBy("root").agg(F.count("*").alias("size")).withColumn("hash", F.xxhash64("root")), "sizes")
    records = size.agg(F.sum("size")).first()[0] or 0
    lacks = {name: records * n / total for name, n in shares}
    is_large = F.col("size") * large >= records
    dealt: list[tuple[str, str]] = []
    for r in size.filter(is_large).orderBy(F.desc("size"), "hash", "root").limit(large).collect():
        name = max(lacks, key=lambda x: lacks[x])
        lacks[name] -= r["size"]
        dealt.append((r["root"], name))
    rest = size.filter(~is_large).withColumn("band", F.floor(F.log2("size")).cast("int")).withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
    counts = rest.groupBy("band", "bucket").agg(F.sum("size").alias("n"))
    band = Window.partitionBy("band")
    before = counts.withColumn("before", F.sum("n").over(band.orderBy("bucket")) - F.col("n")).withColumn("all", F.sum("n").over(band))
    own = F.sum("size").over(Window.partitionBy("band", "bucket").orderBy("hash", "root")) - F.col("size") / 2
    at = rest.join(before.select("band", "bucket", "before", "all"), ["band", "bucket"]).withColumn("at", (F.col("before") + own) / F.col("all"))
    still = {name: max(0.0, x) for name, x in lacks.items()}
    whole = sum(still.values()) or 1.0
    split, upto = F.when(F.lit(False), ""), 0.0
    for name, _ in shares[:-1]:
        upto += still[name] / whole
        split = split.when(F.col("at") < upto, name)
    small = at.select("root", split.otherwise(shares[-1][0]).alias("split"))
    first = groups.sparkSession.createDataFrame(dealt, f"root {dict(groups.dtypes)['root']}, split string")
    # the large groups hold many records each: they meet a side of at most `large` rows
    out = groups.join(F.broadcast(first), "root").unionByName(groups.join(F.broadcast(first), "root", "left_anti").join(small, "root"))
    return out.select("id", "root", "split")
