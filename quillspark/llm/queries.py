"""The queries of this package, by the name under which the driver runs them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import copies, leakage, linkage, markup, names, packing, quality, sentences, splits
from quillspark.session import table


_TEXTS = (("elements", "element_no", "content", False), ("flat_docs", "doc_no", "content", True), ("refs_bib", "bib_no", "text", False))


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, row, text, whole in _TEXTS:
        c = markup.clean_texts(table(spark, d, name), row, text, whole).select(F.lit(name).alias("tab"), F.col(row).alias("row_no"), "clean", "families")
        out = c if out is None else out.unionByName(c)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("tab", "row_no", F.explode("families").alias("family"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("tab", "row_no", F.col("clean").alias("clean_text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link_works(table(spark, d, "pairs")).select("bib_no", "cand_id")


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link_works(table(spark, d, "pairs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "elements"), "element_no", "raw_content", "lang")


def _author_names(spark: SparkSession, d: str) -> DataFrame:
    pairs, labels = table(spark, d, "pairs"), table(spark, d, "labels")
    name = lambda df, c: df.select(F.explode(c).alias("name"))
    return name(pairs, "bib_authors").union(name(pairs, "cand_authors")).union(name(labels, "ground_truth.authors"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(names.link_names(_author_names(spark, d)))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(_author_names(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_pairs(table(spark, d, "refs"), "ref_id", "raw_text").select(F.col("first_id").alias("ref_id_a"), F.col("copy_id").alias("ref_id_b"))


def p5_copy_counts(spark: SparkSession, d: str) -> DataFrame:
    return copies.count_copies(table(spark, d, "refs"), "ref_id", "raw_text").select(F.col("first_id").alias("ref_id"), F.col("copies").alias("n_copies"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    groups, _ = splits.related(table(spark, d, "labels"))
    return splits.group_pairs(groups).select(F.col("first_id").alias("label_id_a"), F.col("other_id").alias("label_id_b"))


def p7_splits(spark: SparkSession, d: str) -> DataFrame:
    groups, _ = splits.related(table(spark, d, "labels"))
    return splits.deal_splits(groups).select(F.col("id").alias("label_id"), "split")


def p7_forest(spark: SparkSession, d: str) -> DataFrame:
    """Why records stay together: the papers that the spanning forest ties, and the key that ties them."""
    _, forest = splits.related(table(spark, d, "labels"))
    return forest.select(F.col("u").alias("paper_a"), F.col("v").alias("paper_b"), F.col("w").alias("key"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = quality.classify(table(spark, d, "documents"), "doc_id", "text")
    return kinds.filter("kind <> 'prose'").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = quality.statistics(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words"))
    return s.select(F.col("id").alias("doc_id"), *quality.FEATURES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p2_found": p2_found,
    "p2_links": p2_links,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_entities": p4_entities,
    "p5_found": p5_found,
    "p5_copy_counts": p5_copy_counts,
    "p7_found": p7_found,
    "p7_splits": p7_splits,
    "p7_forest": p7_forest,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}

# Spaces are made plain and letters composed before anything else; a number's own comma goes, then a mark stays between
# two numbers, then all that is no letter or digit goes.
_LETTERS = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(lower(x), 'ß', 'ss'), 'ſ', 's'), 'ς', 'σ'),"
    r" '(\pN),(\pN{3})([^\pN]|$)', '\1\2\3', 'g'), '(\pN),(\pN{3})([^\pN]|$)', '\1\2\3', 'g'), '(\pN)[^\pL\pM\pN]+(\pN)', '\1' || chr(1) || '\2', 'g'),"
    r" '(\pN)[^\pL\pM\pN\x01]+(\pN)', '\1' || chr(1) || '\2', 'g'), '[^\pL\pM\pN\x01]+', '', 'g')"
)
_CANON = rf"""
plain AS (SELECT ref_id, nfc_normalize(trim(regexp_replace(raw_text, '[\s\pZ]+', ' ', 'g'))) AS t FROM refs WHERE raw_text IS NOT NULL),
entries AS (SELECT ref_id, lower(regexp_extract(t, '^@ ?(\w+)', 1)) AS kind,
         string_split(regexp_replace(regexp_replace(t, '^@ ?\w+ ?[{{(]', ''), ', ?([A-Za-z][A-Za-z0-9_-]*) ?=', chr(2) || '\1=', 'g'), chr(2)) AS cut
       FROM plain WHERE regexp_matches(t, '^@ ?\w+ ?[{{(]')),
parts AS (SELECT ref_id, '@' || kind AS p, 0 AS fixed FROM entries
  UNION ALL SELECT ref_id, (SELECT {_LETTERS} FROM (SELECT cut[1] AS x)), 1 FROM entries
  UNION ALL SELECT ref_id, {_LETTERS}, 2 FROM (SELECT ref_id, unnest(cut[2:]) AS x FROM entries)
  UNION ALL SELECT ref_id, p, 2 FROM (SELECT ref_id, {_LETTERS} AS p FROM (SELECT ref_id, unnest(string_split_regex(t, '\\newblock\b')) AS x FROM plain
    WHERE NOT regexp_matches(t, '^@ ?\w+ ?[{{(]'))) WHERE p <> ''),
c1 AS (SELECT ref_id, string_agg(p, '|' ORDER BY fixed, p) AS c FROM parts GROUP BY ref_id)"""

SQL: dict[str, str] = {
    "p5_found": f"WITH {_CANON}, g AS (SELECT c, min(ref_id) AS a FROM c1 WHERE c <> '' GROUP BY c) SELECT a AS ref_id_a, ref_id AS ref_id_b FROM c1 JOIN g USING (c) WHERE ref_id <> a",
    "p5_copy_counts": f"WITH {_CANON} SELECT min(ref_id) AS ref_id, count(*) AS n_copies FROM c1 WHERE c <> '' GROUP BY c",
    "p7_found": r"""
WITH RECURSIVE r AS (
  SELECT label_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(source_paper_id), '[\s\x{00a0}]+', '', 'g'), '^arxiv[:.]?', ''), '(\.pdf)?/*$', ''), '(\d)v\d+$', '\1'), '[^\p{L}\p{N}]+', '', 'g'), '') AS p,
         nullif(regexp_replace(lower(key), '[^\p{L}\p{N}]+', '', 'g'), '') AS k FROM labels),
n AS (SELECT label_id, coalesce('p' || p, 'r' || label_id) AS v, CASE WHEN NOT regexp_matches(k, '^ref\d+$') THEN k END AS k FROM r),
e AS (SELECT DISTINCT x.v AS a, y.v AS b FROM n x JOIN n y ON x.k = y.k),
reach(a, b) AS (SELECT v, v FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
root AS (SELECT a AS v, min(b) AS root FROM reach GROUP BY a),
g AS (SELECT label_id, root, min(label_id) OVER (PARTITION BY root) AS first FROM n JOIN root USING (v))
SELECT first AS label_id_a, label_id AS label_id_b FROM g WHERE label_id <> first""",
}
