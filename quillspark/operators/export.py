"""Content trees as text: Markdown, HTML and LaTeX."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def ordered_nodes(hierarchy: DataFrame, elements: DataFrame) -> DataFrame:
    """(paper_id, version_num, edge_no, child_id, parent_id, node_type, title, level, content): a version's nodes with their texts."""
    h = hierarchy.groupBy("paper_id", "version_num", "child_id").agg(F.min("edge_no").alias("edge_no"), F.max_by("parent_id", "edge_no").alias("parent_id"))
    e = elements.groupBy("paper_id", "element_id").agg(F.min_by(F.struct("node_type", "title", "level", "content"), "element_no").alias("e"))
    return h.join(e.withColumnRenamed("element_id", "child_id"), ["paper_id", "child_id"], "left").select("paper_id", "version_num", "edge_no", "child_id", "parent_id", "e.*")


def _markdown(kind: str, title: str, level: int, text: str, inner: str) -> str:
    if kind in ("list", "document"):
        return inner
    if kind == "list_item":
        return f"- {text or title}\n{inner}"
    if kind == "equation":
        return f"$$\n{text}\n$$\n\n{inner}"
    if kind == "figure":
        return "".join(f"> {x}\n" for x in text.split("\n")) + "\n" + inner
    if kind == "sentence":
        return f"{text or title}\n\n{inner}"
    return f"{'#' * max(1, min(6, level or 1))} {title}\n\n{text + chr(10) * 2 if text else ''}{inner}"


def _html(kind: str, title: str, level: int, text: str, inner: str) -> str:
    t, x = html.escape(title), html.escape(text)
    if kind == "list":
        return f"<ul>{inner}</ul>\n"
    if kind == "document":
        return inner
    if kind == "list_item":
        return f"<li>{x or t}{inner}</li>\n"
    if kind == "equation":
        return f'<div class="equation">{x}</div>\n{inner}'
    if kind == "figure":
        return f"<figure><pre>{x}</pre></figure>\n{inner}"
    if kind == "sentence":
        return f"<p>{x or t}</p>\n{inner}"
    n = max(1, min(6, level or 1))
    return f"<section><h{n}>{t}</h{n}>{f'<p>{x}</p>' if x else ''}{inner}</section>\n"


def _latex(kind: str, title: str, level: int, text: str, inner: str) -> str:
    if kind in ("title", "author"):
        return ""
    if kind == "list":
        return f"\\begin{{itemize}}\n{inner}\\end{{itemize}}\n"
    if kind == "document":
        return f"\\begin{{document}}\n{inner}\\end{{document}}\n"
    if kind == "list_item":
        return f"\\item {text or title}\n{inner}"
    if kind in ("equation", "figure"):
        return f"{text}\n{inner}"
    if kind == "sentence":
        return f"{text or title}\n{inner}"
    return f"\\{kind}{{{title}}}\n{text + chr(10) if text else ''}{inner}"


#: What shows formulas in an HTML page.
MATH = "https://cdn.jsdelivr.net/npm/mathjax@3/es5/tex-mml-chtml.js"
_WRITERS = {"markdown": _markdown, "html": _html, "latex": _latex}


def export(nodes: DataFrame, form: str) -> DataFrame:
    """(paper_id, version_num, text): one document per version, nodes in the order of their rows. A version is one group; a document's nodes fit one task. A cycle, which no root leads to, is cut at its first row and follows the rest."""
    write = _WRITERS[form]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("edge_no")
        below: dict[str, list] = {}
        rows = {}
        for r in pdf.itertuples(index=False):
            rows[r.child_id] = r
            below.setdefault((r.parent_id or "").strip(), []).append(r.child_id)
        roots = [p for p in below if p not in rows]
        made: dict[str, str] = {}
        tops = [c for top in roots for c in below[top]]
        first = set(tops)
        for top in (*tops, *rows):
            if top in made:
                continue
            if top not in first:
                tops.append(top)
            stack = [(top, False)]
            while stack:
                c, done = stack.pop()
                if done:
                    r = rows[c]
                    level = int(r.level) if r.level is not None and r.level == r.level else 0
                    made[c] = write(r.node_type or "sentence", r.title or "", level, r.content or "", "".join(made.get(k, "") for k in below.get(c, ())))
                elif c not in made:
                    made[c] = ""
                    stack.append((c, True))
                    stack.extend((k, False) for k in reversed(below.get(c, ())))
        body = "".join(made.get(c, "") for c in tops)
        if form == "html":
            body = f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{html.escape(str(pdf['paper_id'].iloc[0]))}</title><script async src=\"{MATH}\"></script></head><body>\n{body}</body></html>\n"
        return pd.DataFrame({"paper_id": [pdf["paper_id"].iloc[0]], "version_num": [pdf["version_num"].iloc[0]], "text": [body]})

    return nodes.groupBy("paper_id", "version_num").applyInPandas(run, "paper_id string, version_num string, text string")


def nodes_and_edges(nodes: DataFrame) -> DataFrame:
    """(paper_id, version_num, json): nodes, edges and their numbers as one JSON text per version."""
    n = F.transform(F.array_sort(F.collect_list(F.struct("edge_no", F.struct(F.col("child_id").alias("id"), F.col("node_type").alias("type"), "title", "level", "content").alias("node")))), lambda x: x["node"])
    e = F.transform(F.array_sort(F.collect_list(F.struct("edge_no", F.struct(F.col("parent_id").alias("from"), F.col("child_id").alias("to")).alias("edge")))), lambda x: x["edge"])
    g = nodes.groupBy("paper_id", "version_num").agg(n.alias("nodes"), e.alias("edges"))
    return g.select("paper_id", "version_num", F.to_json(F.struct("nodes", "edges", F.struct(F.size("nodes").alias("total_nodes"), F.size("edges").alias("total_edges")).alias("metadata"))).alias("json"))
