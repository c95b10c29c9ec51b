"""Parent-child rows of unknown depth to full hierarchies.

Rows are cut into fragments of bounded size (tree, block of row numbers). Each fragment contracts its own parent
chains, by pointer doubling in arrays, to its exits: the ids it points to and does not hold. The exits form a
smaller forest with weighted links, which is solved in the same way, one level up; its answers are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.session import drop_kept, keep

ROOT, EXIT, CYCLE = 0, 1, 2

#: Rows of one fragment, at most. It bounds what a task holds of one tree.
FRAGMENT_ROWS = 50_000
#: How much wider blocks of row numbers are on each next level.
WIDER = 16
#: Entries of the paths that a task holds before it hands them on.
PATH_ENTRIES = 500_000


def _contract(child: np.ndarray, parent: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of one fragment or several (ids told apart by tree): position of the last row of the chain, links up to and including that row's own, and whether the chain never ends."""
    n = len(child)
    up = pd.Index(child).get_indexer(parent)
    last = up < 0
    at = np.where(last, np.arange(n), up)
    far = np.where(last, 0, weight)
    for _ in range(max(1, int(n).bit_length() + 1)):
        if last[at].all():
            break
        far = far + np.where(last, 0, far[at])
        at = at[at]
    return at, far, ~last[at]


def _solver(with_path: bool):
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        d = pd.concat(parts, ignore_index=True)
        del parts
        tree, node, parent = (d[c].to_numpy(object) for c in ("_tree", "_node", "_parent"))
        has = pd.notna(parent)
        # ids as numbers, so that one long id makes no other longer
        codes, known = pd.factorize(np.concatenate([node, np.where(has, parent, "")]))
        base = pd.factorize(tree)[0].astype("int64") * len(known)
        own = base + codes[: len(d)]
        above = np.where(has, base + codes[len(d) :], -1)
        w = d["_weight"].to_numpy("int64")
        at, far, endless = _contract(own, above, w)
        end_parent, end_has = parent[at], has[at]
        out = pd.DataFrame({"_tree": tree, "_node": node})
        state = np.where(endless, CYCLE, np.where(end_has, EXIT, ROOT))
        out["_state"] = state.astype("int32")
        # at an exit the link to it counts too; at a root the chain stops at the node itself
        out["_end"] = np.where(state == EXIT, end_parent, np.where(state == ROOT, node[at], None))
        out["_far"] = np.where(state == EXIT, far + w[at], far)
        if not with_path:
            yield out
            return
        up = pd.Index(own).get_indexer(above)
        steps = d["_path"].tolist()
        # paths are as long as the trees are deep: they are made and handed on piece by piece
        made: list[list] = []
        first = held = 0
        for i in range(len(d)):
            chain, j = [], -1 if endless[i] else i
            while j >= 0:
                chain.append(steps[j])
                j = up[j]
            made.append([x for k in reversed(chain) for x in k])
            held += len(made[-1]) + 1
            if held > PATH_ENTRIES or i == len(d) - 1:
                piece = out.iloc[first : i + 1].copy()
                piece["_path"] = made
                yield piece
                made, first, held = [], i + 1, 0

    return solve


def _parts(rows: int) -> int:
    return max(1, -(-rows // (4 * FRAGMENT_ROWS)))


def _local(links: DataFrame, fragment: list, with_path: bool, parts: int) -> DataFrame:
    schema = "_tree string, _node string, _state int, _end string, _far bigint" + (", _path array<string>" if with_path else "")
    return links.repartition(parts, *fragment).mapInPandas(_solver(with_path), schema)


def _doubling(q: DataFrame, with_path: bool) -> DataFrame:
    """Distributed pointer doubling over solved rows (tree, node, state, end, far): for a quotient tree too big for one task."""
    rounds = 0
    while True:
        open_rows = q.filter(F.col("_state") == EXIT)
        b = q.select("_tree", F.col("_node").alias("_end"), F.col("_state").alias("_s2"), F.col("_end").alias("_e2"), F.col("_far").alias("_f2"), *([F.col("_path").alias("_p2")] if with_path else []))
        j = open_rows.join(b, ["_tree", "_end"], "left")
        moved = j.select(
            "_tree", "_node",
            F.coalesce("_s2", F.lit(ROOT)).alias("_state"),
            F.when(F.col("_s2").isNull(), F.col("_end")).otherwise(F.col("_e2")).alias("_end"),
            (F.col("_far") + F.coalesce("_f2", F.lit(0))).alias("_far"),
            *([F.when(F.col("_s2").isNull(), F.concat(F.array("_end"), "_path")).otherwise(F.concat("_p2", "_path")).alias("_path")] if with_path else []),
        )
        done = keep(q.filter(F.col("_state") != EXIT).unionByName(moved), "doubling")
        drop_kept(q)
        q = done
        rounds += 1
        left = q.filter(F.col("_state") == EXIT).count()
        if not left:
            return q
        if 2**rounds > 4 * q.count():  # every chain would have ended by now
            return q.withColumn("_state", F.when(F.col("_state") == EXIT, CYCLE).otherwise(F.col("_state")))


def resolve_forest(
    links: DataFrame, tree: list[str], child: str, parent: str, order: str, with_path: bool = False, fragment_rows: int = FRAGMENT_ROWS
) -> DataFrame:
    """One row per distinct child of each tree: root_id, depth and, on request, path (array from the root to the node).

    A child without a parent (null or blank) is its own root, depth 0; an id that has no row as a child is a root
    too. A node whose chain never ends (a cycle above it) gets root_id '' and depth -1, and a null path. Repeated
    rows count once; of different parents of one child the smallest non-blank counts. Rows with a null child are
    no nodes. Null tree columns are a value like any other. Other columns are ignored. An empty table gives none.
    """
    for c in tree:
        if c not in links.columns:
            raise ValueError(f"no column {c}")
    key = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in tree])
    blank = F.when(F.trim(F.regexp_replace(F.col(parent), r"\s+", " ")) != "", F.col(parent))
    nodes = (
        links.filter(F.col(child).isNotNull())
        .groupBy(*tree, F.col(child).alias("_node"))
        .agg(F.min(blank).alias("_parent"), F.min(order).alias("_at"))
        .select(*tree, key.alias("_tree"), "_node", "_parent", "_at", F.lit(1).cast("bigint").alias("_weight"), *([F.array("_node").alias("_path")] if with_path else []))
    )
    nodes = keep(nodes, "nodes")
    ids = nodes.select("_tree", "_node", *tree)
    done = _solve(nodes.drop(*tree), with_path, fragment_rows, 0)
    out = ids.join(done.select("_tree", "_node", "_state", "_end", "_far", *(["_path"] if with_path else [])), ["_tree", "_node"])
    good = F.col("_state") == ROOT
    return out.select(
        *tree,
        F.col("_node").alias(child),
        F.when(good, F.col("_end")).otherwise(F.lit("")).alias("root_id"),
        F.when(good, F.col("_far")).otherwise(F.lit(-1)).cast("int").alias("depth"),
        *([F.when(good, F.col("_path")).alias("path")] if with_path else []),
    )


def _solve(rows: DataFrame, with_path: bool, fragment_rows: int, level: int) -> DataFrame:
    """(tree, node, state, end, far, path) of linked rows (tree, node, parent, weight, at, path): each fragment contracts to its exits, the quotient of the exits is solved in the same way with wider fragments, and its answers are joined back."""
    session = rows.sparkSession
    path = ["_path"] if with_path else []
    cols = ["_tree", "_node", "_parent", "_weight", *path]
    n = rows.count()
    # the quotient of a tree holds few rows of each block, so blocks may be wider level by level
    fragment = F.floor(F.coalesce(F.col("_at"), F.lit(0)) / (fragment_rows * WIDER**level))
    local = keep(_local(rows.select(*cols, fragment.alias("_frag")), ["_tree", "_frag"], with_path, max(_parts(n), session.sparkContext.defaultParallelism)), "local")
    exits = local.filter(F.col("_state") == EXIT).select("_tree", F.col("_end").alias("_node")).distinct()
    # The quotient: what each exit's own fragment says of it. An exit that no fragment holds is a root itself.
    known = exits.join(local, ["_tree", "_node"], "left").join(rows.select("_tree", "_node", "_at"), ["_tree", "_node"], "left")
    quotient = keep(
        known.select(
            "_tree", "_node", "_at",
            F.when(F.col("_state") == EXIT, F.col("_end")).alias("_parent"),
            F.col("_far").alias("_weight"),
            F.coalesce("_state", F.lit(ROOT)).alias("_was"),
            F.when(F.col("_state") == ROOT, F.col("_end")).when(F.col("_state").isNull(), F.col("_node")).alias("_root"),
            F.coalesce("_far", F.lit(0)).alias("_rest"),
            *([F.coalesce("_path", F.array("_node")).alias("_path")] if with_path else []),
        ),
        "quotient",
    )
    inner = quotient.filter(F.col("_was") == EXIT)
    ends = quotient.filter(F.col("_was") != EXIT).select("_tree", "_node", F.col("_was").alias("_state"), F.col("_root").alias("_end"), F.col("_rest").alias("_far"), *path)
    left = inner.count()
    largest = inner.groupBy("_tree", F.floor(F.coalesce(F.col("_at"), F.lit(0)) / (fragment_rows * WIDER ** (level + 1)))).count().agg(F.max("count")).first()[0] or 0
    if not left:
        solved = ends
    elif (inner.groupBy("_tree").count().agg(F.max("count")).first()[0] or 0) <= fragment_rows:
        up = _local(inner.select(*cols), ["_tree"], with_path, max(1, min(64, _parts(left))))
        solved = ends.unionByName(_attach(up, ends, with_path))
    elif largest <= fragment_rows and 2 * left <= n:
        # known ends take part as roots of their own, and are put in for them afterwards
        stops = quotient.filter(F.col("_was") != EXIT).select("_tree", "_node", "_at", F.lit(None).cast("string").alias("_parent"), F.lit(1).cast("bigint").alias("_weight"), *([F.array().cast("array<string>").alias("_path")] if with_path else []))
        up = _solve(keep(inner.select("_at", *cols).unionByName(stops), "level"), with_path, fragment_rows, level + 1)
        up = up.join(inner.select("_tree", "_node"), ["_tree", "_node"], "left_semi")
        # what lies beyond the quotient is a root already; such an end is taken off the path, for _attach puts it on
        beyond = F.col("_state") == ROOT
        up = up.select("_tree", "_node", F.when(beyond, EXIT).otherwise(F.col("_state")).alias("_state"), "_end", "_far", *([_without_end(beyond).alias("_path")] if with_path else []))
        solved = ends.unionByName(_attach(up, ends, with_path))
    else:  # rows in no order at all: a block's quotient doesn't fit a task
        up = inner.select("_tree", "_node", F.lit(EXIT).alias("_state"), F.col("_parent").alias("_end"), F.col("_weight").alias("_far"), *path)
        solved = _doubling(keep(up.unionByName(ends), "up"), with_path)
    return _attach(local, solved, with_path)


def _without_end(beyond: Column) -> Column:
    return F.when(beyond & (F.try_element_at("_path", F.lit(1)) == F.col("_end")), F.slice("_path", F.lit(2), F.size("_path"))).otherwise(F.col("_path"))


def _attach(rows: DataFrame, ends: DataFrame, with_path: bool) -> DataFrame:
    """Rows that stop at an exit take over what is known of it; an exit not known is a root."""
    e = ends.select("_tree", F.col("_node").alias("_end"), F.col("_state").alias("_s2"), F.col("_end").alias("_e2"), F.col("_far").alias("_f2"), *([F.col("_path").alias("_p2")] if with_path else []))
    stop = rows.filter(F.col("_state") == EXIT).join(e, ["_tree", "_end"], "left")
    moved = stop.select(
        "_tree", "_node",
        F.coalesce("_s2", F.lit(ROOT)).alias("_state"),
        F.when(F.col("_s2").isNull(), F.col("_end")).otherwise(F.col("_e2")).alias("_end"),
        (F.col("_far") + F.coalesce("_f2", F.lit(0))).alias("_far"),
        *([F.when(F.col("_s2").isNull(), F.concat(F.array("_end"), "_path")).otherwise(F.concat("_p2", "_path")).alias("_path")] if with_path else []),
    )
    return rows.filter(F.col("_state") != EXIT).unionByName(moved.select(rows.columns))


def descendants(paths: DataFrame, tree: list[str], child: str) -> DataFrame:
    """(tree, ancestor_id, descendant, distance) of every node on a path to a root, from resolve_forest(with_path=True)."""
    p = paths.filter(F.col("path").isNotNull())
    return p.select(*tree, F.posexplode("path").alias("_i", "ancestor_id"), F.col(child).alias("descendant_id"), "depth").filter(F.col("_i") < F.col("depth")).select(
        *tree, "ancestor_id", "descendant_id", (F.col("depth") - F.col("_i")).alias("distance")
    )
