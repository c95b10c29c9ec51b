"""Reference records: extraction, canonical pool, key maps, citation rewriting."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import text as T
from quillspark.operators.ordering import row_numbers


def fingerprints(refs: DataFrame) -> DataFrame:
    return refs.withColumn("fingerprint", T.fingerprint(F.coalesce("raw_text", F.lit(""))))


def canonical_refs(refs: DataFrame, paper: str = "paper_id", version: str = "version", order: str = "ord", row: str = "ref_id") -> DataFrame:
    """(paper, fingerprint, canonical_key ref_<n> in first-seen order, raw_text): of equal references the longest text, the first of those."""
    seen = F.struct(version, F.col(order), F.col(row))
    f = fingerprints(refs)
    g = f.groupBy(paper, "fingerprint").agg(
        F.min(seen).alias("first"),
        F.min(F.struct((-F.length(F.coalesce("raw_text", F.lit("")))).alias("n"), F.col(version), F.col(order), F.col(row), "raw_text")).alias("best"),
    )
    g = row_numbers(g, [paper], ["first"], "number")
    return g.select(paper, "fingerprint", F.concat(F.lit("ref_"), F.col("number").cast("string")).alias("canonical_key"), F.col("best.raw_text").alias("raw_text"))


def key_map(refs: DataFrame, paper: str = "paper_id", version: str = "version", order: str = "ord", row: str = "ref_id") -> DataFrame:
    """(paper, version, old_key, new_key) where they differ; the last record of a key counts."""
    c = canonical_refs(refs, paper, version, order, row).select(paper, "fingerprint", "canonical_key")
    j = fingerprints(refs).filter(F.col("key").isNotNull()).join(c, [paper, "fingerprint"]).filter(F.col("key") != F.col("canonical_key"))
    return j.groupBy(paper, version, F.col("key").alias("old_key")).agg(F.max(F.struct(F.col(order), F.col(row), "canonical_key")).alias("m")).select(paper, version, "old_key", F.col("m.canonical_key").alias("new_key"))


def bibitems(docs: DataFrame, text: Column, *keys: str) -> DataFrame:
    """One row per \\bibitem of a text: item_no, key, raw_text; the first of a key counts."""
    part = F.posexplode(F.split(text, r"(?i)\\bibitem(?![a-zA-Z])"))
    d = docs.select(*keys, part.alias("item_no", "p")).filter("item_no > 0")
    head = r"(?s)^\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}\s*(.*)$"
    d = d.select(*keys, "item_no", F.trim(F.regexp_extract("p", head, 1)).alias("key"), F.trim(F.regexp_replace(F.split(F.regexp_extract("p", head, 2), r"\\end\{", 2)[0], r"\s+", " ")).alias("raw_text")).filter("key <> ''")
    return d.withColumn("rn", F.row_number().over(W.partitionBy(*keys, "key").orderBy("item_no"))).filter("rn = 1").drop("rn")


def embedded_bibliography(c: Column) -> Column:
    """The first thebibliography environment; without one the whole text if it has a \\bibitem; else ''."""
    block = F.regexp_extract(c, r"(?is)\\begin\{thebibliography\}(.*?)\\end\{thebibliography\}", 1)
    return F.when(block != "", block).when(c.contains("\\bibitem"), c).otherwise("")


def used_refs(refs: DataFrame, cited: DataFrame, on: list[str]) -> DataFrame:
    """References whose key is cited (`cited`: on + key). Where nothing or `*` is cited all are kept."""
    some = cited.groupBy(*on).agg(F.max(F.when(F.col("key") == "*", 1).otherwise(0)).alias("all"))
    keep_all = refs.join(some.filter("all = 0").select(*on), on, "left_anti")
    return keep_all.unionByName(refs.join(some.filter("all = 0").select(*on), on, "left_semi").join(cited, [*on, "key"], "left_semi"))


_CITE = re.compile(r"(\\(?:no)?cite[a-zA-Z]*\s*(?:\[[^\]]*\]\s*)*\{)([^}]+)(\})")


def rewrite_citations(text: str | None, new: dict[str, str]) -> str | None:
    """Keys inside cite commands replaced, unknown keys left as they are."""
    if text is None:
        return None
    return _CITE.sub(lambda m: m[1] + ", ".join(new.get(k.strip(), k.strip()) for k in m[2].split(",")) + m[3], text)


def rewrite(docs: DataFrame, maps: DataFrame, on: list[str], text: str) -> DataFrame:
    """docs with `text` rewritten by the key maps (on + old_key, new_key). A version's map goes with its documents as one value."""
    m = maps.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("old_key", "new_key"))).alias("_map"))

    @F.pandas_udf("string")
    def run(t: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([rewrite_citations(x, dict(y) if y is not None else {}) for x, y in zip(t, k)])

    return docs.join(m, on, "left").withColumn(text, run(text, "_map")).drop("_map")


_HEAD = re.compile(r"@\s*([A-Za-z]+)\s*[{(]\s*([^,\s{}()]*)\s*,?", re.S)
_FIELD = re.compile(r"\s*,?\s*([A-Za-z][\w:-]*)\s*=\s*")


def parse_bib(text: str | None, strings: dict[str, str] | None = None) -> list[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of every entry: nested braces, quotes, `#` joins, string macros; the first of a key counts. Broken entries end at the next `@`."""
    out: list[tuple[str, str, dict[str, str]]] = []
    macros = {m: m.capitalize() for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()} | (strings or {})
    seen: set[str] = set()
    s, pos = text or "", 0
    while m := _HEAD.search(s, pos):
        kind, key, at = m[1].lower(), m[2], m.end()
        if kind in ("comment", "preamble"):
            pos = m.start() + 1
            continue
        if kind == "string":
            at = s.index(m[0], m.start()) + len(m[0]) - len(m[2]) - (m[0].endswith(","))
            at = m.start(2)
        fields: dict[str, str] = {}
        while f := _FIELD.match(s, at):
            value, at = _value(s, f.end(), macros)
            fields.setdefault(f[1].lower(), value)
        pos = max(at, m.end() if kind != "string" else at, m.start() + 1)
        if kind == "string":
            macros |= fields
        elif key not in seen:
            seen.add(key)
            out.append((kind, key, fields))
    return out


def _value(s: str, at: int, macros: dict[str, str]) -> tuple[str, int]:
    parts = []
    while at < len(s):
        c = s[at]
        if c == "{":
            depth, i = 0, at
            while i < len(s):
                depth += (s[i] == "{") - (s[i] == "}")
                if not depth:
                    break
                i += 1
            parts.append(s[at + 1 : i])
            at = i + 1
        elif c == '"':
            depth, i = 0, at + 1
            while i < len(s) and (s[i] != '"' or depth):
                depth += (s[i] == "{") - (s[i] == "}")
                i += 1
            parts.append(s[at + 1 : i])
            at = i + 1
        else:
            m = re.compile(r"[^\s,#}()]+").match(s, at)
            if not m:
                break
            parts.append(macros.get(m[0].lower(), m[0]))
            at = m.end()
        j = re.compile(r"\s*#\s*").match(s, at)
        if not j:
            break
        at = j.end()
    return re.sub(r"\s+", " ", "".join(parts)).strip(), at


def bib_entries(files: DataFrame, content: str, *keys: str) -> DataFrame:
    """One row per entry of each text: keys, entry_no, entry_type, key, fields map."""
    kinds = dict(files.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "entry_no int, entry_type string, key string, fields map<string,string>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r[:-1], i, *e) for r in b.itertuples(index=False) for i, e in enumerate(parse_bib(r[-1]))]
            yield pd.DataFrame(rows, columns=[*keys, "entry_no", "entry_type", "key", "fields"])

    return files.select(*keys, F.col(content)).mapInPandas(run, schema)


def to_bib(key: Column, raw: Column) -> Column:
    """One entry of an exported reference file."""
    return F.concat(F.lit("@misc{"), key, F.lit(",\n  text = {"), F.coalesce(raw, F.lit("")), F.lit("}\n}\n\n"))


# LaTeX accents by the mark they set, and letters and signs by their commands.
_MARKS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331"}
_SIGNS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "&": "&", "%": "%", "$": "$", "#": "#", "_": "_"}
_ACCENT = re.compile(r"\\(?:([`'^~\"=.])\s*|([uvHckrdb])(?:\s+|(?=\{)))\{?(?:\\([ij])(?![A-Za-z])\s*|([A-Za-z]))\}?")
_SIGN = re.compile(r"\\(?:(ss|ae|AE|oe|OE|aa|AA|[oOlLij])(?![A-Za-z])(?:\s+|\{\})?|([&%$#_]))")


def latex_to_unicode(text: str | None) -> str | None:
    """Accents, letters and signs written as commands, as characters; other commands go, braces too, spaces run together."""
    if text is None or not ("\\" in text or "{" in text or "}" in text or "~" in text):
        return text if text is None else " ".join(text.split())
    s = _ACCENT.sub(lambda m: (m[3] or m[4]) + _MARKS[m[1] or m[2]], text)
    s = _SIGN.sub(lambda m: _SIGNS[m[1] or m[2]], s)
    s = re.sub(r"\\[A-Za-z]+\s*", "", s).replace("~", " ")
    return " ".join(unicodedata.normalize("NFC", s.replace("{", "").replace("}", "")).split())


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        d["title"] = d["title"].map(latex_to_unicode)
        d["authors"] = [None if a is None else [latex_to_unicode(x) for x in a] for a in d["authors"]]
        yield d


def parse_references(refs: DataFrame, row: str, raw: str) -> DataFrame:
    """(row, title, authors, year, extracted_id, method) of raw references, accents as characters. Only references with commands pass through Python."""
    d = refs.select(row, F.col(raw).alias("_raw"), smart_parse(F.col(raw)).alias("p")).select(row, "_raw", "p.*")
    odd = F.coalesce(F.array_join(F.concat(F.array("title"), "authors"), " ").rlike(r"[\\~]"), F.lit(False))
    d = d.drop("_raw")
    return d.filter(~odd).unionByName(d.filter(odd).mapInPandas(_decoded, d.schema))


def inference_queries(bib: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """bib with title, authors, year, extracted_id and method of its exported references, each written out as an entry without its `@`, which leaves it to blocks and patterns."""
    entry = F.concat(F.lit("misc{"), F.coalesce(key, F.lit("")), F.lit(", text = {"), F.coalesce(text, F.lit("")), F.lit("}}"))
    return bib.withColumn("_p", smart_parse(entry)).select(*bib.columns, "_p.*")


def smart_parse(c: Column) -> Column:
    """Struct (title, authors, year, extracted_id, method) of a raw reference: by entry fields, by blocks, or by patterns; the first that gives a valid title."""
    t = F.coalesce(c, F.lit(""))
    blocks = F.split(t, r"\\newblock\b")
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[{}]", ""), r"[\s\p{Z}]+", " "))
    people = lambda x, by: F.filter(F.transform(F.split(tidy(x), by), lambda y: F.trim(y)), lambda y: y != "")
    valid = lambda x: F.when(T.title_is_valid(x), x)
    is_entry, is_flat = F.trim(t).startswith("@"), F.size(blocks) > 1
    title_e, authors_e = T.entry_title(t), T.entry_authors(t)
    pattern = lambda name: F.regexp_extract(t, rf"(?is){name}\s*=\s*[{{\"](.*?)[}}\"]", 1)
    by_entry = F.when(is_entry, valid(tidy(title_e)))
    by_block = F.when(is_flat, valid(tidy(blocks[1])))
    title = F.coalesce(by_entry, by_block, valid(tidy(pattern("title"))), F.lit(""))
    people_e = F.when(is_entry & (authors_e != ""), people(authors_e, r"\s+and\s+"))
    people_b = F.when(is_flat, people(F.regexp_replace(tidy(blocks[0]), r"\.$", ""), r",\s*"))
    people_p = F.when(pattern("author") != "", people(pattern("author"), r"\s+and\s+"))
    authors = F.when(by_entry.isNotNull(), F.coalesce(people_e, F.array().cast("array<string>"))).otherwise(F.coalesce(people_b, people_e, people_p, F.array().cast("array<string>")))
    ident = F.when(is_entry, F.coalesce(F.nullif(F.regexp_extract(t, r"(?i)\beprint\s*=\s*[{\"]([^}\"]+)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(?i)\bdoi\s*=\s*[{\"]([^}\"]+)", 1), F.lit(""))))
    field_year = F.nullif(F.regexp_extract(t, r"(?i)year\s*=\s*[{\"]?\s*([12]\d{3})", 1), F.lit(""))
    stands = lambda x: F.nullif(F.regexp_extract(x, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    last_year = F.when(is_flat, stands(F.element_at(blocks, -1)))
    # where blocks gave the title the last of them is all that is searched for a year
    any_year = F.when(by_entry.isNull() & by_block.isNull(), stands(t))
    return F.struct(
        title.alias("title"),
        authors.alias("authors"),
        F.coalesce(field_year, last_year, any_year, F.lit("")).alias("year"),
        T.normalize_id(F.coalesce(ident, F.lit(""))).alias("extracted_id"),
        T.parse_method(c).alias("method"),
    )
