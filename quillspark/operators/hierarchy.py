"""Content trees: blocks hung under their headers, one id for equal content, edges by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import text as T
from quillspark.operators import latex as L


def version_number(c: Column) -> Column:
    """What stands behind the last `v` of a version's name."""
    return F.element_at(F.split(c, "v"), -1)


def body_of_root(c: Column) -> Column:
    """The text before the first header without what the preamble nodes hold."""
    t = F.regexp_replace(c, r"(?s)^.*\\begin\{document\}", "")
    t = F.regexp_replace(t, r"(?s)\\begin\{abstract\}.*?\\end\{abstract\}", "")
    return F.regexp_replace(t, r"\\(?:title|author|abstract|date)\s*(?:\[[^\]]*\])?\{(?:[^{}]|\{[^{}]*\})*\}|\\(?:documentclass|usepackage)(?:\[[^\]]*\])?\{[^}]*\}", "")


def clean_block(kind: Column, c: Column) -> Column:
    return F.when(kind == "equation", L.clean_equation(c)).when(kind == "figure", L.clean_figure(c)).otherwise(L.clean_latex(c))


def assemble(docs: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, node_id, parent_id, ord, node_type, title, level, content): one tree per document.

    Headers hang under the nearest header of a smaller level, blocks under the header before them and before its
    sub-headers, list items under their list; title, authors and abstract, if there, hang first under the document.
    `ord` orders a document's nodes as they stand. The document has no parent. Null contents have no nodes.
    """
    heads = L.header_parents(L.headers(docs.filter(F.col(content).isNotNull()), keys, content), keys)
    at = F.concat_ws("-", *keys)
    head_id = lambda pos: F.concat(at, F.lit("-h"), pos.cast("string"))
    order = lambda pos, kind, n: F.struct(pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), n.cast("int").alias("n"))
    none, level = F.lit(None).cast("string"), F.lit(99)
    a = heads.select(*keys, head_id(F.col("pos")).alias("node_id"), F.when(F.col("pos") > 0, head_id(F.col("parent_pos"))).alias("parent_id"), order(F.col("pos"), 0, F.lit(0)).alias("ord"), F.col("type").alias("node_type"), L.clean_latex(F.col("title")).alias("title"), "level", none.alias("content"))
    p = L.preamble(docs.filter(F.col(content).isNotNull()), keys, content)
    parts = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), L.clean_latex(F.col(c)).alias("t")) for i, (k, c) in enumerate((("title", "title"), ("author", "authors"), ("abstract", "abstract")))]), lambda x: x["t"] != ""))
    b = p.select(*keys, parts.alias("x")).select(
        *keys, F.concat(at, F.lit("-"), "x.k").alias("node_id"), head_id(F.lit(0)).alias("parent_id"), order(F.lit(0), 1, F.col("x.i")).alias("ord"), F.col("x.k").alias("node_type"),
        F.when(F.col("x.k") == "abstract", "Abstract").otherwise(F.col("x.t")).alias("title"), level.alias("level"), F.when(F.col("x.k") != "abstract", F.col("x.t")).alias("content"),
    )
    said = L.blocks(p.select(*keys, F.lit(0).alias("pos"), F.col("abstract").alias("raw_content")), [*keys, "pos"])
    texts = heads.select(*keys, "pos", F.when(F.col("pos") == 0, body_of_root(F.col("raw_content"))).otherwise(F.col("raw_content")).alias("raw_content"))
    blocks = L.blocks(texts, [*keys, "pos"])

    def hung(d: DataFrame, kind: int, base: Column) -> DataFrame:
        own = lambda n: F.concat(base, F.lit("-b"), n.cast("string"))
        c = F.when(F.col("type") != "list", clean_block(F.col("type"), F.col("content")))
        return d.select(*keys, own(F.col("block_no")).alias("node_id"), F.when(F.col("parent_no") >= 0, own(F.col("parent_no"))).otherwise(base).alias("parent_id"), order(F.col("pos"), kind, F.col("block_no")).alias("ord"), F.col("type").alias("node_type"), "title", level.alias("level"), c.alias("content"))

    return a.unionByName(b).unionByName(hung(said, 2, F.concat(at, F.lit("-abstract")))).unionByName(hung(blocks, 3, head_id(F.col("pos"))))


def last_edges(rows: DataFrame, keys: list[str], child: str = "child_id", parent: str = "parent_id", order: str = "edge_no") -> DataFrame:
    """(keys, child, parent): of several rows of a child the last counts; rows without a parent are no edges."""
    return rows.filter(F.trim(parent) != "").groupBy(*keys, child).agg(F.max_by(parent, order).alias(parent))


def roots(edges: DataFrame, keys: list[str], child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """(keys, root_id): parents that are nobody's child."""
    up = edges.select(*keys, F.col(parent).alias("root_id")).distinct()
    return up.join(edges.select(*keys, F.col(child).alias("root_id")), [*keys, "root_id"], "left_anti")


def unified_ids(nodes: DataFrame, paper: str, node: str, kind: str, content: str, order: list[str]) -> DataFrame:
    """nodes with `content_hash` and `unified_id`: of a paper's nodes of one kind with one content the id of the first in `order`. Nodes without content keep their ids and have no hash."""
    n = nodes.withColumn("content_hash", F.when(F.trim(F.coalesce(content, F.lit(""))) != "", T.content_hash(F.col(kind), F.col(content))))
    first = n.filter("content_hash is not null").groupBy(paper, "content_hash").agg(F.min_by(node, F.struct(*order)).alias("_first"))
    return n.join(first, [paper, "content_hash"], "left").withColumn("unified_id", F.coalesce("_first", node)).drop("_first")


def unified_edges(edges: DataFrame, ids: DataFrame, keys: list[str], paper: str, child: str, parent: str, order: list[str]) -> DataFrame:
    """(keys, child_id, parent_id) by unified ids (`ids`: paper, node, unified_id): of several rows of a child the last in `order` counts; rows without a parent are no edges."""
    e = edges.filter(F.trim(parent) != "")
    one = ids.select(paper, F.col("node").alias(child), F.col("unified_id").alias("_c"))
    up = ids.select(paper, F.col("node").alias(parent), F.col("unified_id").alias("_p"))
    e = e.join(one, [paper, child], "left").join(up, [paper, parent], "left")
    e = e.select(*keys, F.coalesce("_c", child).alias("child_id"), F.coalesce("_p", parent).alias("parent_id"), F.struct(*order).alias("_o"))
    return e.groupBy(*keys, "child_id").agg(F.max_by("parent_id", "_o").alias("parent_id"))


def hierarchy(nodes: DataFrame, paper: str = "paper_id", version: str = "version") -> tuple[DataFrame, DataFrame]:
    """(edges, elements) of assembled trees: edges (paper_id, version_num, child_id, parent_id), elements (paper_id, element_id, node_type, title, level, content), one row per unified id with a text; a node without content goes by its title."""
    n = nodes.select("*", version_number(F.col(version)).alias("version_num"))
    number = F.coalesce(F.try_to_number("version_num", F.lit("999999")), F.lit(0))
    u = unified_ids(n.withColumn("_v", number), paper, "node_id", "node_type", "content", ["_v", version, "ord"])
    ids = u.select(F.col(paper).alias("paper_id"), F.col("node_id").alias("node"), "unified_id")
    edges = unified_edges(u.select(F.col(paper).alias("paper_id"), "version_num", F.col("node_id").alias("child"), F.col("parent_id").alias("parent"), "ord"), ids, ["paper_id", "version_num"], "paper_id", "child", "parent", ["ord"])
    text = F.coalesce(F.when(F.trim("content") != "", F.col("content")), F.col("title"))
    kept = u.filter((F.col("unified_id") == F.col("node_id")) & (F.coalesce(text, F.lit("")) != ""))
    return edges, kept.select(F.col(paper).alias("paper_id"), F.col("node_id").alias("element_id"), "node_type", "title", "level", text.alias("content"))


def preview(nodes: DataFrame, n: int = 200, width: int = 80) -> list[str]:
    """The first n nodes of an assembled document as lines, indented by their depth, to look at."""
    depth: dict[str, int] = {}
    lines = []
    for r in nodes.orderBy("ord").select("node_id", "parent_id", "node_type", "title", "content").limit(n).collect():
        depth[r.node_id] = depth.get(r.parent_id, -1) + 1
        text = " ".join((r.content or r.title or "").split())
        lines.append("  " * depth[r.node_id] + f"[{r.node_type}] " + (text if len(text) <= width else text[:width] + "..."))
    return lines
