"""LaTeX sources: include graph, root choice, flattening, cleaning, header tree, content blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Header levels, what cleaning deletes or unwraps, names of root files, and below the weights of their scores.
LEVELS = {"part": 1, "chapter": 2, "section": 3, "subsection": 4, "subsubsection": 5, "paragraph": 6, "subparagraph": 7}
DROP_WITH_ARGUMENT = "footnote todo comment note thanks label cite ref eqref bibliographystyle input include bibliography acknowledgments".split()
LAYOUT = "centering newpage clearpage tableofcontents noindent hfill vfill break pagebreak FloatBarrier newline maketitle nocite hbadness preprint".split()
LIGHT = "centering hfill vfill noindent small tiny large".split()
FIGURE = "centering hfill vfill noindent".split()
UNWRAP = "textbf textit emph textsc text mathrm mathbf section subsection subsubsection paragraph subparagraph".split()
CANONICAL_ROOTS = ("main.tex", "ms.tex", "paper.tex", "article.tex")
INCLUDE = r"\\(?:input|include|subfile)(?:\[[^\]]*\])?\s*(?:\{([^}]+)\}|\s+([^\s{}\\%]+))"


def include_edges(files: DataFrame, keys: list[str], path: str = "rel_path", content: str = "content") -> DataFrame:
    """(keys, parent, child) of every include that resolves, by base name, to a file of the same version."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    target = F.explode(F.regexp_extract_all(content, F.lit(r"\\(?:input|include|subfile)(?:\[[^\]]*\])?\{([^}]+)\}"), 1))
    refs = files.select(*keys, F.col(path).alias("parent"), target.alias("t")).withColumn("t", F.trim("t"))
    refs = refs.withColumn("base", F.when(F.col("t").rlike(r"\.tex$"), name(F.col("t"))).otherwise(F.concat(name(F.col("t")), F.lit(".tex"))))
    known = files.groupBy(*keys, name(F.col(path)).alias("base")).agg(F.max(path).alias("child"))
    return refs.join(known, [*keys, "base"]).select(*keys, "parent", "child").distinct()


def root_scores(files: DataFrame, keys: list[str], path: str = "rel_path", content: str = "content") -> DataFrame:
    """(keys, path, score, length) of each .tex file: how much it looks like the root of its version."""
    c = F.regexp_replace(F.col(content), r"%[^\n]*", "")
    base = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(base, r"\.tex$", "")
    incoming = include_edges(files, keys, path, content).groupBy(*keys, F.col("child").alias(path)).agg(F.count("*").alias("incoming"))
    names = files.groupBy(*keys).agg(F.collect_set(base).alias("names"))
    d = files.filter(F.col(path).rlike(r"\.tex$")).join(incoming, [*keys, path], "left").join(names, keys)
    add = lambda cond, n: F.when(cond, n).otherwise(0)
    has = lambda ext: F.array_contains("names", F.concat(stem, F.lit(ext)))
    includes = F.size(F.regexp_extract_all(c, F.lit(r"\\(input|include|subfile)\b"), 1))
    score = (
        20 + add(c.contains("\\begin{document}"), 20) - 50 * F.coalesce("incoming", F.lit(0)) + add(has(".bbl"), 60) + add(has(".bib"), 20) + add(has(".log"), 30)
        + add(c.contains("\\bibliography") | c.contains("\\begin{thebibliography}"), 15) + add(c.contains("\\maketitle"), 10) + add(c.contains("\\begin{abstract}"), 10)
        + F.least(3 * includes, F.lit(30)) + add(F.lower(base).isin(*CANONICAL_ROOTS), 10) - add(F.lower(base).rlike("response|reply|letter"), 50)
        - add(c.contains("\\documentclass{beamer}"), 50) - add(c.contains("\\documentclass{standalone}"), 20) - add(c.contains("\\documentclass{letter}"), 50)
    )
    score = score - F.when(F.lower(base).rlike("template|sample|example") & (score < 60), 10).otherwise(0)
    return d.select(*keys, F.col(path).alias("path"), F.when(c.contains("\\documentclass"), score).otherwise(-1000).cast("int").alias("score"), F.length(content).alias("length"))


def choose_root(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, root): the best score above -100. Of two nearly equal a canonical name goes first, then a far longer file."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), F.desc("length"), "path"))
    top = scores.filter("score > -100").withColumn("r", rank).filter("r <= 2").groupBy(*keys).agg(
        *[F.max(F.when(F.col("r") == i, F.struct("path", "score", "length"))).alias(f"t{i}") for i in (1, 2)]
    )
    plain = lambda t: F.lower(F.element_at(F.split(F.col(f"{t}.path"), "/"), -1)).isin(*CANONICAL_ROOTS)
    close = F.col("t2").isNotNull() & (F.col("t1.score") - F.col("t2.score") < 5)
    second = close & ((~plain("t1") & plain("t2")) | (~plain("t1") & ~plain("t2") & (F.col("t2.length") > 1.5 * F.col("t1.length"))))
    return top.select(*keys, F.when(second, F.col("t2.path")).otherwise(F.col("t1.path")).alias("root"))


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!\\)%[^\n]*", "")


def flatten_files(files: dict[str, str], root: str, remove_references: bool = False) -> tuple[str, list[str], list[str]]:
    """(text, merged files, missing files) of a root with its includes in place, each between markers. A file is expanded once; a second include leaves a note."""
    by_base = {p.rsplit("/", 1)[-1]: p for p in sorted(files)}
    merged: list[str] = []
    missing: list[str] = []
    seen = {root}

    def expand(path: str) -> str:
        text = re.sub(r"(?<!\\)%[^\n]*", "", files[path])
        if remove_references:
            text = re.sub(r"\\bibliography\{[^}]*\}|\\printbibliography|\\begin\{thebibliography\}.*?\\end\{thebibliography\}", "", text, flags=re.S)
        folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""

        def put(m: re.Match) -> str:
            name = (m[1] or m[2]).strip()
            full = name if name.endswith(".tex") else name + ".tex"
            at = next((p for p in (full, folder + full, by_base.get(full.rsplit("/", 1)[-1])) if p in files), None)
            if at is None:
                missing.append(name)
                return f"\n% <WARNING: File not found: {name}>\n"
            if at in seen:
                return f"\n% <WARNING: Circular dependency: {name}>\n"
            seen.add(at)
            merged.append(at)
            return f"\n% <BEGIN_FILE: {at}>\n{expand(at)}\n% <END_FILE: {at}>\n"

        return re.sub(INCLUDE, put, text)

    return expand(root), merged, missing


def flatten(files: DataFrame, roots: DataFrame, keys: list[str], path: str = "rel_path", content: str = "content", remove_references: bool = False) -> DataFrame:
    """One flattened document per version: keys, root_file_path, metadata, content. A version's sources are one group; they are small."""
    kinds = dict(files.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", root_file_path string, metadata struct<total_length:int,merged_count:int,merged_files:array<string>,missing_files:array<string>,remove_references:boolean>, content string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root = pdf["root"].iloc[0]
        text, merged, missing = flatten_files(dict(zip(pdf[path], pdf[content].fillna(""))), root, remove_references)
        meta = {"total_length": len(text), "merged_count": len(merged), "merged_files": merged, "missing_files": missing, "remove_references": remove_references}
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "root_file_path": root, "metadata": meta, "content": text}])

    return files.select(*keys, path, content).join(roots, keys).groupBy(*keys).applyInPandas(run, schema)


def clean_latex(c: Column) -> Column:
    """Text of a fragment: comments, layout and commands with their arguments deleted, formatting unwrapped, inline math kept as it is."""
    nested = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)^.*?\\begin\{document\}", "")
    t = strip_comments(F.regexp_replace(t, r"\\end\{document\}", ""))
    outside = lambda p: rf"(\$[^$]+\$|\\\([^)]+\\\))|{p}"
    for _ in range(3):  # the first argument stays
        t = F.regexp_replace(t, outside(r"\\texorpdfstring\s*" + nested + r"\s*" + nested), "$1$2")
    t = F.regexp_replace(t, outside(r"\\(?:" + "|".join(DROP_WITH_ARGUMENT) + r")(?:\[[^\]]*\])?\{[^}]*\}"), "$1")
    t = F.regexp_replace(t, outside(r"\\(?:" + "|".join(LAYOUT) + r")\b"), "$1")
    t = F.regexp_replace(t, r"\\(?:begin|end)\{abstract\}", "")
    for _ in range(5):
        t = F.regexp_replace(t, outside(r"\\(?:" + "|".join(UNWRAP) + r")(?:\[[^\]]*\])?" + nested), "$1$2")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def light_clean(c: Column) -> Column:
    """Layout commands and the options of figures and tables deleted."""
    t = F.regexp_replace(c, r"\\(?:" + "|".join(LIGHT) + ")", "")
    return F.trim(F.regexp_replace(t, r"\\begin\{(figure|table)\}\[[^\]]*\]", r"\\begin{$1}"))


def clean_equation(c: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(c, r"\$\$|\\\[|\\\]|\\(?:begin|end)\{equation\*?\}", ""), r"\\label\{[^}]*\}|\\nonumber|\\notag", "")
    return F.concat(F.lit("\\begin{equation}\n"), F.trim(F.regexp_replace(body, r"\s+", " ")), F.lit("\n\\end{equation}"))


def clean_figure(c: Column) -> Column:
    """A figure or table without options, layout and labels; captions cleaned like text. Line ends stay."""
    t = F.regexp_replace(c, r"(?i)(\\begin\{(?:figure|table)\*?\})\[[^\]]*\]", "$1")
    t = F.regexp_replace(t, r"\\(?:" + "|".join(FIGURE) + r")", "")
    t = F.regexp_replace(t, r"\\label\{(?:[^{}]|\{[^{}]*\})*\}", "")
    caption = r"(?s)(\\caption(?:\[[^\]]*\])?\{)((?:[^{}]|\{[^{}]*\})*)\}"
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(caption), 0))
    t = F.aggregate(found, t, lambda acc, m: F.replace(acc, m, F.concat(F.regexp_extract(m, caption, 1), clean_latex(F.regexp_extract(m, caption, 2)), F.lit("}"))))
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def inline_math(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\$[^$]+\$|\\\([^)]*\\\)"), 0)


_HEADER = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)(\*?)\s*\{", re.I)


def find_headers(text: str | None) -> list[tuple[str, bool, str, str]]:
    """(command, starred, title, text up to the next header); the first row ('document', ...) holds what stands before any header."""
    s = text or ""
    out: list[tuple[str, bool, str, str]] = []
    at, head = 0, ("document", False, "Root")
    while m := _HEADER.search(s, at):
        depth, i = 1, m.end()
        while i < len(s) and depth:
            depth += (s[i] == "{") - (s[i] == "}")
            i += 1
        out.append((*head, s[at : m.start()]))
        head = (m[1].lower(), m[2] == "*", s[m.end() : i - 1 if not depth else i])
        at = i
    out.append((*head, s[at:]))
    return out


def headers(docs: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, pos, type, starred, title, level, raw_content) of each document's headers, in order; pos 0 is the document."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pos int, type string, starred boolean, title string, level int, raw_content string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r[:-1], i, t, st, title, LEVELS.get(t, 0), raw) for r in b.itertuples(index=False) for i, (t, st, title, raw) in enumerate(find_headers(r[-1]))]
            yield pd.DataFrame(rows, columns=[*keys, "pos", "type", "starred", "title", "level", "raw_content"])

    return docs.select(*keys, F.col(content)).mapInPandas(run, schema)


def header_parents(h: DataFrame, keys: list[str]) -> DataFrame:
    """h with parent_pos: the nearest header before it of a smaller level, else the document; null for the document."""
    w = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    seen = [F.last(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(w) for k in range(8)]
    at = [F.when(F.col("level") > k, F.coalesce(s, F.lit(-1))).otherwise(-1) for k, s in enumerate(seen)]
    return h.withColumn("parent_pos", F.when(F.col("pos") > 0, F.greatest(*at)))


_BLOCKS = re.compile(
    r"(?P<math>\\begin\{equation\*?\}.*?\\end\{equation\*?\}|\\\[.*?\\\]|\$\$.*?\$\$)|(?P<figure>\\begin\{(?:figure|table)\*?\}.*?\\end\{(?:figure|table)\*?\})|(?P<list>\\begin\{(?P<kind>itemize|enumerate)\}(?P<body>.*?)\\end\{(?P=kind)\})",
    re.S | re.I,
)
_MARK = re.compile(r"%\s*<(?:BEGIN_FILE|END_FILE|WARNING)[^>]*>")
_SENTENCE = re.compile(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=[.?!])\s+(?=[A-Z(])")


def sentences(text: str) -> list[str]:
    return [x.strip() for x in _SENTENCE.split(re.sub(r"\s+", " ", text).strip()) if x.strip()]


def content_blocks(text: str | None) -> list[tuple[str, str, str, int]]:
    """(type, title, content, parent) in order; parent is the row of the list an item belongs to, else -1. Include markers are no text."""
    s = _MARK.sub("", text or "")
    out: list[tuple[str, str, str, int]] = []

    def running(t: str) -> None:
        for x in sentences(t):
            out.append(("sentence", x[:30] + ("..." if len(x) > 30 else ""), x, -1))

    at = 0
    for m in _BLOCKS.finditer(s):
        running(s[at : m.start()])
        if m["math"]:
            out.append(("equation", "Equation Block", m["math"].strip(), -1))
        elif m["figure"]:
            out.append(("figure", "Figure/Table", m["figure"].strip(), -1))
        else:
            parent = len(out)
            out.append(("list", f"List ({m['kind'].lower()})", "", -1))
            for item in re.split(r"\\item\b\s*", re.sub(r"^\s*\[[^\]]*\]", "", m["body"]))[1:]:
                x = re.sub(r"\s+", " ", item).strip()
                if x:
                    out.append(("list_item", x[:30] + ("..." if len(x) > 30 else ""), x, parent))
        at = m.end()
    running(s[at:])
    return out


def blocks(h: DataFrame, keys: list[str], raw: str = "raw_content") -> DataFrame:
    """(keys, block_no, type, title, content, parent_no) of the text under each header."""
    kinds = dict(h.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block_no int, type string, title string, content string, parent_no int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r[:-1], i, *x) for r in b.itertuples(index=False) for i, x in enumerate(content_blocks(r[-1]))]
            yield pd.DataFrame(rows, columns=[*keys, "block_no", "type", "title", "content", "parent_no"])

    return h.select(*keys, F.col(raw)).mapInPandas(run, schema)


def preamble(docs: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, title, authors, abstract) of each source."""
    nested = r"((?:[^{}]|\{[^{}]*\})*)"
    c = F.col(content)
    env = F.regexp_extract(c, r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", 1)
    return docs.select(
        *keys,
        F.trim(F.regexp_extract(c, r"\\title\s*(?:\[[^\]]*\])?\{" + nested + r"\}", 1)).alias("title"),
        F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\\author\s*(?:\[[^\]]*\])?\{" + nested + r"\}"), 1), lambda x: F.trim(x)), ", ").alias("authors"),
        F.trim(F.when(env != "", env).otherwise(F.regexp_extract(c, r"\\abstract\s*\{" + nested + r"\}", 1))).alias("abstract"),
    )
