"""Queries of the engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillspark.functions import similarity as S, text as T
from quillspark.operators import dataset as D, export as X, hierarchy as H, latex as L, matching as M, quality as Q, ranking as K, references as R
from quillspark import sources
from quillspark.session import shared_dir, table
from quillspark.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FP = "md5(regexp_replace(lower(coalesce(raw_text, '')), '[^a-z0-9]', '', 'g'))"
_CANON = f"""
f AS (SELECT *, {_FP} AS fingerprint FROM refs),
g AS (SELECT paper_id, fingerprint, row_number() OVER (PARTITION BY paper_id ORDER BY version, ord, ref_id) AS pos,
        row_number() OVER (PARTITION BY paper_id, fingerprint ORDER BY version, ord, ref_id) AS n,
        first_value(raw_text) OVER (PARTITION BY paper_id, fingerprint ORDER BY length(coalesce(raw_text, '')) DESC, version, ord, ref_id) AS raw_text FROM f),
c AS (SELECT paper_id, fingerprint, 'ref_' || (row_number() OVER (PARTITION BY paper_id ORDER BY pos) - 1) AS canonical_key, raw_text FROM g WHERE n = 1)"""


@query(f"WITH {_CANON} SELECT * FROM c")
def ref_fingerprint_dedup(spark: SparkSession, d: str) -> DataFrame:
    return R.canonical_refs(table(spark, d, "refs"))


@query(f"""WITH {_CANON}, j AS (SELECT f.paper_id, f.version, f.key AS old_key, c.canonical_key AS new_key,
  row_number() OVER (PARTITION BY f.paper_id, f.version, f.key ORDER BY f.ord DESC, f.ref_id DESC, c.canonical_key DESC) AS n
  FROM f JOIN c USING (paper_id, fingerprint) WHERE f.key IS NOT NULL AND f.key <> c.canonical_key)
SELECT paper_id, version, old_key, new_key FROM j WHERE n = 1""")
def citation_key_map(spark: SparkSession, d: str) -> DataFrame:
    return R.key_map(table(spark, d, "refs"))


@query(f"WITH {_CANON} SELECT paper_id, canonical_key, '@misc{{' || canonical_key || ',' || chr(10) || '  text = {{' || coalesce(raw_text, '') || '}}' || chr(10) || '}}' || chr(10) || chr(10) AS entry FROM c")
def refs_bib_export(spark: SparkSession, d: str) -> DataFrame:
    return R.canonical_refs(table(spark, d, "refs")).select("paper_id", "canonical_key", R.to_bib(F.col("canonical_key"), F.col("raw_text")).alias("entry"))


@query(r"""WITH h AS (SELECT *, CASE WHEN trim(coalesce(content, '')) = '' THEN NULL ELSE md5(node_type || ':' || regexp_replace(content, '^\s+|\s+$', '', 'g')) END AS content_hash FROM elements)
SELECT element_id, content_hash, CASE WHEN content_hash IS NULL THEN element_id ELSE first_value(element_id) OVER (PARTITION BY paper_id, content_hash ORDER BY element_no) END AS unified_id,
  CASE WHEN content_hash IS NULL THEN title ELSE content END AS element_text FROM h""")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    u = H.unified_ids(table(spark, d, "elements"), "paper_id", "element_id", "node_type", "content", ["element_no"])
    return u.select("element_id", "content_hash", "unified_id", F.when(F.col("content_hash").isNull(), F.col("title")).otherwise(F.col("content")).alias("element_text"))


_UNIFIED = r"""h AS (SELECT *, CASE WHEN trim(coalesce(content, '')) = '' THEN NULL ELSE md5(node_type || ':' || regexp_replace(content, '^\s+|\s+$', '', 'g')) END AS content_hash FROM elements),
u AS (SELECT DISTINCT paper_id, element_id AS node, CASE WHEN content_hash IS NULL THEN element_id ELSE first_value(element_id) OVER (PARTITION BY paper_id, content_hash ORDER BY element_no) END AS unified_id FROM h)"""


@query(f"""WITH {_UNIFIED}
SELECT paper_id, version_num, child_id, arg_max(parent_id, edge_no) AS parent_id FROM (
  SELECT x.paper_id, x.version_num, x.edge_no, coalesce(c.unified_id, x.child_id) AS child_id, coalesce(p.unified_id, x.parent_id) AS parent_id FROM hierarchy x
  LEFT JOIN u c ON c.paper_id = x.paper_id AND c.node = x.child_id LEFT JOIN u p ON p.paper_id = x.paper_id AND p.node = x.parent_id WHERE trim(x.parent_id) <> '') GROUP BY ALL""")
def unified_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between unified nodes; of several rows of a child the last counts."""
    u = H.unified_ids(table(spark, d, "elements"), "paper_id", "element_id", "node_type", "content", ["element_no"])
    ids = u.select("paper_id", F.col("element_id").alias("node"), "unified_id").distinct()
    return H.unified_edges(table(spark, d, "hierarchy"), ids, ["paper_id", "version_num"], "paper_id", "child_id", "parent_id", ["edge_no"])


@query("""WITH r AS (SELECT paper_id, version_num, child_id, parent_id, row_number() OVER (PARTITION BY paper_id, version_num, child_id ORDER BY edge_no DESC) AS n FROM hierarchy WHERE trim(parent_id) <> '')
SELECT paper_id, version_num, child_id, parent_id FROM r WHERE n = 1""")
def hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    return H.last_edges(table(spark, d, "hierarchy"), ["paper_id", "version_num"])


@query("""WITH e AS (SELECT paper_id, version_num, child_id, arg_max(parent_id, edge_no) AS parent_id FROM hierarchy WHERE trim(parent_id) <> '' GROUP BY ALL)
SELECT DISTINCT paper_id, version_num, parent_id AS root_id FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.paper_id = e.paper_id AND x.version_num = e.version_num AND x.child_id = e.parent_id)""")
def tree_roots(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that are nobody's child."""
    return H.roots(hierarchy_edges(spark, d), ["paper_id", "version_num"])


@query("SELECT paper_id, version_num, count(*) AS total_edges, count(DISTINCT child_id) AS total_children, count(DISTINCT parent_id) AS total_parents FROM hierarchy GROUP BY ALL")
def tree_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hierarchy").groupBy("paper_id", "version_num").agg(F.count("*").alias("total_edges"), F.countDistinct("child_id").alias("total_children"), F.countDistinct("parent_id").alias("total_parents"))


@query("SELECT element_id, substr(regexp_replace(coalesce(content, title, ''), '\\n', ' ', 'g'), 1, 80) || CASE WHEN length(coalesce(content, title, '')) > 80 THEN '...' ELSE '' END AS preview FROM elements")
def node_preview(spark: SparkSession, d: str) -> DataFrame:
    c = F.coalesce("content", "title", F.lit(""))
    return table(spark, d, "elements").select("element_id", F.concat(F.substring(F.regexp_replace(c, "\n", " "), 1, 80), F.when(F.length(c) > 80, "...").otherwise("")).alias("preview"))


@query(r"""SELECT ref_id, CAST(nullif(regexp_extract(raw_text, '\b((?:19|20)\d{2})\b', 1), '') AS INTEGER) AS year,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(raw_text, '')), '(?:text|title|author|year|journal|volume|pages|doi|eprint|archiveprefix|primaryclass|month|number|publisher|abstract|address|url|urldate|issn|keywords|copyright|language)\s*=', ' ', 'g'), '@(?:article|misc|book|inproceedings|unpublished|techreport)', ' ', 'g'), '[{}"''\\=,:;()\[\]]', ' ', 'g'), '\s+', ' ', 'g')) AS clean_text FROM refs""")
def reference_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").select("ref_id", T.year(F.col("raw_text")).alias("year"), T.clean_for_match(F.col("raw_text")).alias("clean_text"))


@query(r"""SELECT ref_id, trim(regexp_extract(raw_text, '(?is)(?:^|[,{\s])title\s*=\s*[{"]+(.*?)[}"]+\s*(?:,|\}|$)', 1)) AS title, trim(regexp_extract(raw_text, '(?is)(?:^|[,{\s])author\s*=\s*[{"]+(.*?)[}"]+\s*(?:,|\}|$)', 1)) AS authors FROM refs""")
def bibtex_fast_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").select("ref_id", T.entry_title(F.col("raw_text")).alias("title"), T.entry_authors(F.col("raw_text")).alias("authors"))


_TIDY = r"trim(regexp_replace(regexp_replace({}, '[{{}}]', '', 'g'), '[\s\pZ]+', ' ', 'g'))"
_VALID = r"CASE WHEN length({0}) >= 5 AND NOT regexp_matches({0}, '^\d{{4}}\.\d{{4,5}}$') AND NOT regexp_matches(lower({0}), 'doi|https?:|\\href|\\path') AND len(string_split_regex(trim({0}), '\s+')) >= 2 THEN {0} END"
_PEOPLE = r"list_filter(list_transform(string_split_regex({}, '{}'), lambda x: trim(x)), lambda x: x <> '')"


def _smart_sql(tab: str, row: str, text: str) -> str:
    return rf"""WITH t AS (SELECT {row}, coalesce({text}, '') AS t, string_split_regex(coalesce({text}, ''), '\\newblock\b') AS b FROM {tab}),
e AS (SELECT *, starts_with(trim(t), '@') AS is_entry, len(b) > 1 AS is_flat, trim(regexp_extract(t, '(?is)(?:^|[,{{\s])title\s*=\s*[{{"]+(.*?)[}}"]+\s*(?:,|\}}|$)', 1)) AS te, trim(regexp_extract(t, '(?is)(?:^|[,{{\s])author\s*=\s*[{{"]+(.*?)[}}"]+\s*(?:,|\}}|$)', 1)) AS ae,
  regexp_extract(t, '(?is)title\s*=\s*[{{"](.*?)[}}"]', 1) AS tp, regexp_extract(t, '(?is)author\s*=\s*[{{"](.*?)[}}"]', 1) AS ap FROM t),
k AS (SELECT *, {_TIDY.format("te")} AS t1, {_TIDY.format("b[2]")} AS t2, {_TIDY.format("tp")} AS t3 FROM e),
v AS (SELECT *, CASE WHEN is_entry THEN {_VALID.format("t1")} END AS by_entry, CASE WHEN is_flat THEN {_VALID.format("t2")} END AS by_block, {_VALID.format("t3")} AS by_pattern,
  CASE WHEN is_entry AND ae <> '' THEN {_PEOPLE.format(_TIDY.format("ae"), r"\s+and\s+")} END AS pe, CASE WHEN is_flat THEN {_PEOPLE.format("regexp_replace(" + _TIDY.format("b[1]") + ", '[.]$', '')", r",\s*")} END AS pb,
  CASE WHEN ap <> '' THEN {_PEOPLE.format(_TIDY.format("ap"), r"\s+and\s+")} END AS pp FROM k)
SELECT {row}, coalesce(by_entry, by_block, by_pattern, '') AS title, CASE WHEN by_entry IS NOT NULL THEN coalesce(pe, []) ELSE coalesce(pb, pe, pp, []) END AS authors,
  coalesce(nullif(regexp_extract(t, '(?i)year\s*=\s*[{{"]?\s*([12]\d{{3}})', 1), ''), CASE WHEN is_flat THEN nullif(regexp_extract(b[-1], '\b((?:19|20)\d{{2}})\b', 1), '') END,
    CASE WHEN by_entry IS NULL AND by_block IS NULL THEN nullif(regexp_extract(t, '\b((?:19|20)\d{{2}})\b', 1), '') END, '') AS year,
  regexp_replace(lower(CASE WHEN is_entry THEN coalesce(nullif(regexp_extract(t, '(?i)\beprint\s*=\s*[{{"]([^}}"]+)', 1), ''), nullif(regexp_extract(t, '(?i)\bdoi\s*=\s*[{{"]([^}}"]+)', 1), ''), '') ELSE '' END), '[.\-/]', '', 'g') AS extracted_id,
  CASE WHEN trim(t) = '' THEN 'empty' WHEN ltrim(t) LIKE '@%' THEN 'bibtex_struct' WHEN contains(t, '\newblock') THEN 'flat_text' ELSE 'regex_fallback' END AS method FROM v"""


@query(_smart_sql("refs", "ref_id", "raw_text"))
def bibtex_smart_parse(spark: SparkSession, d: str) -> DataFrame:
    return R.parse_references(table(spark, d, "refs"), "ref_id", "raw_text")


@query(_smart_sql("refs_bib", "bib_no", "'misc{' || coalesce(key, '') || ', text = {' || coalesce(text, '') || '}}'"))
def inference_queries(spark: SparkSession, d: str) -> DataFrame:
    return R.inference_queries(table(spark, d, "refs_bib")).select("bib_no", "title", "authors", "year", "extracted_id", "method")


@query(r"""WITH e AS (SELECT ref_id, raw_text, lower(regexp_extract(raw_text, '@\s*([A-Za-z]+)\s*[{(]', 1)) AS entry_type, regexp_extract(raw_text, '@\s*[A-Za-z]+\s*[{(]\s*([^,\s{}()]*)', 1) AS key FROM refs WHERE regexp_matches(raw_text, '@\s*[A-Za-z]+\s*[{(]')),
x AS (SELECT ref_id, entry_type, key, unnest(regexp_extract_all(raw_text, '(?s),[\s\pZ]*[A-Za-z][\w:-]*[\s\pZ]*=[\s\pZ]*(?:\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|"(?:[^"{}]|\{[^{}]*\})*"|[^\s,#}()"]+)')) AS f FROM e),
y AS (SELECT ref_id, entry_type, key, lower(regexp_extract(f, ',[\s\pZ]*([A-Za-z][\w:-]*)[\s\pZ]*=', 1)) AS field, regexp_replace(f, '(?s)^,[\s\pZ]*[A-Za-z][\w:-]*[\s\pZ]*=[\s\pZ]*', '') AS v FROM x)
SELECT ref_id, entry_type, key, field, trim(regexp_replace(CASE WHEN v[1] IN ('{', '"') THEN v[2:-2] ELSE v END, '[\s\pZ]+', ' ', 'g')) AS value FROM y""")
def bib_entry_fields(spark: SparkSession, d: str) -> DataFrame:
    return R.bib_entries(table(spark, d, "refs").filter("raw_text is not null"), "raw_text", "ref_id").select("ref_id", "entry_type", "key", F.explode("fields").alias("field", "value"))


@query(r"""SELECT CASE WHEN trim(coalesce(raw_text, '')) = '' THEN 'empty' WHEN ltrim(raw_text) LIKE '@%' THEN 'bibtex_struct' WHEN contains(raw_text, '\newblock') THEN 'flat_text' ELSE 'regex_fallback' END AS method, count(*) AS n FROM refs GROUP BY ALL""")
def parse_method_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").groupBy(T.parse_method(F.col("raw_text")).alias("method")).agg(F.count("*").alias("n"))


@query(r"""SELECT label_id, regexp_replace(lower(coalesce(ground_truth.id, '')), '[.\-/]', '', 'g') AS norm_id, list_sort(list_distinct(list_filter(list_transform(ground_truth.authors, lambda x: trim(x)), lambda x: x <> ''))) AS authors,
 len(ground_truth.authors) <> len(list_distinct(ground_truth.authors)) AS repeats FROM labels""")
def label_ids_and_authors(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("ground_truth.authors")
    return table(spark, d, "labels").select("label_id", T.normalize_id(F.col("ground_truth.id")).alias("norm_id"), F.array_sort(T.clean_list(a)).alias("authors"), F.when(a.isNotNull(), F.size(a) != F.size(F.array_distinct(a))).alias("repeats"))


_TOK = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g'), '\s+'), lambda x: x <> ''))"
_FEATURES = rf"""
n AS (SELECT *, lower(trim(coalesce(bib_title, ''), ' ')) AS qt, lower(trim(coalesce(cand_title, ''), ' ')) AS ct, {_TOK.format("array_to_string(bib_authors, ' ')")} AS qa, {_TOK.format("array_to_string(cand_authors, ' ')")} AS ca,
  regexp_replace(lower(coalesce(bib_id, '')), '[^a-z0-9]', '', 'g') AS qi, regexp_replace(lower(coalesce(cand_id, '')), '[^a-z0-9]', '', 'g') AS ci,
  TRY_CAST(nullif(regexp_extract(bib_year, '^(\d{{4}})', 1), '') AS INTEGER) AS qy, TRY_CAST(nullif(regexp_extract(cand_year, '^(\d{{4}})', 1), '') AS INTEGER) AS cy,
  substr(string_split_regex(lower(trim(coalesce(bib_authors[1], ''), ' ')), '\s+')[1], 1, 3) AS fa, substr(string_split_regex(lower(trim(coalesce(cand_authors[1], ''), ' ')), '\s+')[1], 1, 3) AS fc FROM pairs),
m AS (SELECT *, {_TOK.format("qt")} AS qw, {_TOK.format("ct")} AS cw FROM n),
features AS (SELECT *,
  CASE WHEN qi = '' OR ci = '' THEN 0.0 WHEN qi = ci THEN 1.0 WHEN contains(qi, ci) OR contains(ci, qi) THEN 0.8 ELSE 0.0 END::DOUBLE AS feat_id_match,
  CASE WHEN qt <> '' AND ct <> '' AND (contains(qt, ct) OR contains(ct, qt)) THEN 1.0 ELSE 0.0 END::DOUBLE AS feat_title_contain,
  abs(length(qt) - length(ct))::DOUBLE / greatest(length(qt), length(ct), 1) AS feat_title_len_diff,
  CASE WHEN len(qw) + len(cw) = 0 THEN 0.0 ELSE len(list_intersect(qw, cw))::DOUBLE / (len(qw) + len(cw) - len(list_intersect(qw, cw))) END AS feat_title_jaccard,
  CASE WHEN qt = '' OR ct = '' THEN 0.0 ELSE 1 - levenshtein(qt, ct)::DOUBLE / greatest(length(qt), length(ct)) END AS feat_title_edit,
  CASE WHEN len(qa) + len(ca) = 0 THEN 0.0 ELSE len(list_intersect(qa, ca))::DOUBLE / (len(qa) + len(ca) - len(list_intersect(qa, ca))) END AS feat_auth_jaccard,
  len(list_intersect(qa, ca))::DOUBLE AS feat_auth_overlap,
  CASE WHEN fa <> '' AND fa = fc THEN 1.0 ELSE 0.0 END::DOUBLE AS feat_first_auth_match,
  (CASE WHEN qy IS NULL OR cy IS NULL THEN -1 ELSE least(abs(qy - cy), 10) END)::DOUBLE AS feat_year_diff,
  CASE WHEN qy = cy THEN 1.0 ELSE 0.0 END::DOUBLE AS feat_year_match FROM m)"""
_NAMES = ["feat_id_match", "feat_title_contain", "feat_title_len_diff", "feat_title_jaccard", "feat_title_edit", "feat_auth_jaccard", "feat_auth_overlap", "feat_first_auth_match", "feat_year_diff", "feat_year_match"]


@query(f"WITH {_FEATURES} SELECT pair_id, " + ", ".join(f"round({x}, 9) AS {x}" for x in _NAMES) + " FROM features")
def pair_features(spark: SparkSession, d: str) -> DataFrame:
    return M.pair_features(table(spark, d, "pairs")).select("pair_id", *[F.round(x, 9).alias(x) for x in _NAMES])


@query()
def fuzzy_features(spark: SparkSession, d: str) -> DataFrame:
    return M.fuzzy_features(table(spark, d, "pairs")).select("pair_id", "feat_title_fuzzy", "feat_title_sort", "feat_title_partial", "feat_auth_token_sort")


_GRAMS = """list_concat(list_transform(range(1, greatest(length(w) - 1, 1) + 1), lambda i: substr(w, i, 2)), list_transform(range(1, greatest(length(w) - 2, 1) + 1), lambda i: substr(w, i, 3)), list_transform(range(1, greatest(length(w) - 3, 1) + 1), lambda i: substr(w, i, 4)))"""
_CHARS = rf"""
t AS (SELECT DISTINCT lower(trim(bib_title, ' ')) AS t FROM pairs WHERE trim(bib_title, ' ') <> '' UNION SELECT DISTINCT lower(trim(cand_title, ' ')) FROM pairs WHERE trim(cand_title, ' ') <> ''),
w AS (SELECT t, ' ' || unnest(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) || ' ' AS w FROM t),
g AS (SELECT t, unnest({_GRAMS}) AS term FROM w),
tf AS (SELECT t, term, count(*) AS tf FROM g GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= 2),
v AS (SELECT t, term, tf * (ln((1 + (SELECT count(*) FROM t)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
u AS (SELECT t, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM v),
p AS (SELECT pair_id, lower(trim(coalesce(bib_title, ''), ' ')) AS a, lower(trim(coalesce(cand_title, ''), ' ')) AS b FROM pairs),
q AS (SELECT DISTINCT a, b FROM p),
dot AS (SELECT a, b, sum(x.w * y.w) AS dot FROM q JOIN u x ON x.t = a JOIN u y ON y.t = b AND y.term = x.term GROUP BY ALL)"""


@query(f"WITH {_CHARS} SELECT pair_id, round(coalesce(dot, 0), 6) AS feat_title_tfidf_cosine FROM p LEFT JOIN dot USING (a, b)")
def title_tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    return M.title_cosine(table(spark, d, "pairs"))


def _scoped_sql(scope: str, min_df: int) -> str:
    """The cosine of titles fitted on each scope's own distinct titles."""
    return rf"""WITH p AS (SELECT pair_id, {scope} AS g, lower(trim(coalesce(bib_title, ''), ' ')) AS a, lower(trim(coalesce(cand_title, ''), ' ')) AS b FROM pairs),
t AS (SELECT g, a AS t FROM p WHERE a <> '' UNION SELECT g, b FROM p WHERE b <> ''),
w AS (SELECT g, t, ' ' || unnest(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) || ' ' AS w FROM t),
s AS (SELECT g, t, unnest({_GRAMS}) AS term FROM w),
tf AS (SELECT g, t, term, count(*) AS tf FROM s GROUP BY ALL), n AS (SELECT g, count(*) AS n FROM t GROUP BY ALL),
df AS (SELECT g, term, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= {min_df}),
v AS (SELECT g, t, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (g, term) JOIN n USING (g)),
u AS (SELECT g, t, term, w / sqrt(sum(w * w) OVER (PARTITION BY g, t)) AS w FROM v),
q AS (SELECT DISTINCT g, a, b FROM p),
dot AS (SELECT q.g, a, b, sum(x.w * y.w) AS dot FROM q JOIN u x ON x.g = q.g AND x.t = a JOIN u y ON y.g = q.g AND y.t = b AND y.term = x.term GROUP BY ALL)
SELECT pair_id, round(coalesce(dot, 0), 6) AS feat_title_tfidf_cosine FROM p LEFT JOIN dot USING (g, a, b)"""


@query(_scoped_sql("paper_id", 1))
def title_tfidf_by_paper(spark: SparkSession, d: str) -> DataFrame:
    return M.title_cosine(table(spark, d, "pairs"), ["paper_id"], min_df=1)


@query(_scoped_sql("pair_id", 1))
def title_tfidf_single(spark: SparkSession, d: str) -> DataFrame:
    return M.title_cosine(table(spark, d, "pairs"), ["pair_id"], min_df=1)


@query(f"WITH {_FEATURES}, {_CHARS} SELECT f.pair_id, round(coalesce(dot, 0), 6) AS feat_title_tfidf_cosine, " + ", ".join(f"round({x}, 9) AS {x}" for x in K.SELECTED[1:]) + " FROM features f JOIN p ON p.pair_id = f.pair_id LEFT JOIN dot ON dot.a = p.a AND dot.b = p.b")
def selected_features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs")
    return M.pair_features(p).select("pair_id", *[F.round(x, 9).alias(x) for x in K.SELECTED[1:]]).join(M.title_cosine(p), "pair_id")


def _queries_and_candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One pool of candidates per paper, as `pairs` has them; queries are the bibliography records."""
    p = table(spark, d, "pairs")
    q = p.filter("trim(bib_title) <> ''").groupBy("paper_id", F.col("bib_no").cast("string").alias("query")).agg(F.min("bib_title").alias("title"), F.min(F.concat_ws(" ", "bib_title", "bib_year")).alias("text"))
    c = p.groupBy("paper_id", "cand_id").agg(F.min("cand_title").alias("title"), F.min(F.array_join(F.coalesce("cand_authors", F.array().cast("array<string>")), " ")).alias("authors"), F.min("cand_year").alias("year"))
    return q, c


_CM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '(?:text|title|author|year|journal|volume|pages|doi|eprint|archiveprefix|primaryclass|month|number|publisher|abstract|address|url|urldate|issn|keywords|copyright|language)\s*=', ' ', 'g'), '[{{}}\"''\\=,:;()\[\]]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH q AS (SELECT paper_id, bib_no, {_CM.format('min(bib_title)')} AS t FROM pairs WHERE trim(bib_title, ' ') <> '' GROUP BY ALL),
c0 AS (SELECT paper_id, cand_id, {_CM.format('min(cand_title)')} AS t FROM pairs GROUP BY ALL), c AS (SELECT paper_id, t, max(cand_id) AS cand_id FROM c0 WHERE length(t) > 5 GROUP BY ALL)
SELECT paper_id, CAST(bib_no AS VARCHAR) AS query, cand_id FROM q JOIN c USING (paper_id, t)""")
def exact_title_join(spark: SparkSession, d: str) -> DataFrame:
    q, c = _queries_and_candidates(spark, d)
    return M.exact_titles(q, c, ["paper_id"])


def _match_sql() -> str:
    stop = ", ".join(f"'{x}'" for x in M.STOP)
    clean = lambda c: _CM.format(f"coalesce({c}, '')")
    words = rf"list_filter(string_split_regex(lower(x), '[^\pL\pN_]+'), lambda y: length(y) >= 2 AND y NOT IN ({stop}))"
    terms = lambda src, key: f"SELECT paper_id, {key}, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[CAST(i AS INTEGER)] || ' ' || w[CAST(i AS INTEGER) + 1]))) AS term FROM (SELECT paper_id, {key}, {words} AS w FROM {src})"
    return rf"""WITH q0 AS (SELECT paper_id, CAST(bib_no AS VARCHAR) AS query, min(bib_title) AS title, min(concat_ws(' ', bib_title, bib_year)) AS text FROM pairs WHERE trim(bib_title, ' ') <> '' GROUP BY paper_id, bib_no),
c0 AS (SELECT paper_id, cand_id, min(cand_title) AS title, min(array_to_string(coalesce(cand_authors, []), ' ')) AS authors, min(cand_year) AS year FROM pairs GROUP BY ALL),
ct AS (SELECT paper_id, t, max(cand_id) AS cand_id FROM (SELECT paper_id, cand_id, {clean("title")} AS t FROM c0) WHERE length(t) > 5 GROUP BY ALL),
exact AS (SELECT q0.paper_id, query, ct.cand_id FROM q0 JOIN ct ON ct.paper_id = q0.paper_id AND ct.t = {clean("q0.title")}),
q AS (SELECT paper_id, query, text, {clean("text")} AS x FROM q0 WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.paper_id = q0.paper_id AND e.query = q0.query)),
c AS (SELECT paper_id, cand_id, concat_ws(' ', {clean("title")}, {clean("title")}, {clean("authors")}, year) AS x FROM c0),
tc AS (SELECT paper_id, cand_id, term, count(*) AS tf FROM ({terms("c", "cand_id")}) GROUP BY ALL),
tq AS (SELECT paper_id, query, term, count(*) AS tf FROM ({terms("q", "query")}) GROUP BY ALL),
n AS (SELECT paper_id, count(*) AS n FROM c GROUP BY ALL),
idf AS (SELECT paper_id, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tc JOIN n USING (paper_id) GROUP BY paper_id, term, n),
wc AS (SELECT paper_id, cand_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY paper_id, cand_id)) AS w FROM tc JOIN idf USING (paper_id, term)),
wq AS (SELECT paper_id, query, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY paper_id, query)) AS w FROM tq JOIN idf USING (paper_id, term)),
cos AS (SELECT paper_id, query, cand_id, round(sum(wq.w * wc.w), 9) AS score FROM wq JOIN wc USING (paper_id, term) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY paper_id, query ORDER BY score DESC, cand_id) AS r FROM cos),
ok AS (SELECT top.*, row_number() OVER (PARTITION BY top.paper_id, top.query ORDER BY r) AS k FROM top JOIN q USING (paper_id, query) JOIN c0 USING (paper_id, cand_id) WHERE r <= {M.TOP} AND score >= {M.THRESHOLD}
  AND coalesce(abs(CAST(nullif(regexp_extract(q.text, '\b((?:19|20)\d{{2}})\b', 1), '') AS INTEGER) - CAST(nullif(regexp_extract(c0.year, '\b((?:19|20)\d{{2}})\b', 1), '') AS INTEGER)), 0) <= {M.YEARS})
SELECT paper_id, query, cand_id, 1.0::DOUBLE AS score FROM exact UNION ALL SELECT paper_id, query, cand_id, score FROM ok WHERE k = 1"""


@query(_match_sql())
def tfidf_match_top3(spark: SparkSession, d: str) -> DataFrame:
    q, c = _queries_and_candidates(spark, d)
    return M.match(q, c, ["paper_id"])


_KEY = "('0x' || substr(md5('{}:' || {}), 1, 8))::BIGINT"


@query("SELECT DISTINCT paper_id FROM refs WHERE paper_id LIKE '23%' ORDER BY 1 LIMIT 10 OFFSET 3")
def range_slice(spark: SparkSession, d: str) -> DataFrame:
    return D.prefix_slice(table(spark, d, "refs"), "paper_id", "23", 3, 13)


@query(f"SELECT paper_id FROM (SELECT DISTINCT paper_id FROM refs) ORDER BY {_KEY.format(42, 'paper_id')}, paper_id LIMIT 20")
def random_limit(spark: SparkSession, d: str) -> DataFrame:
    return D.random_limit(table(spark, d, "refs"), "paper_id", 20)


@query(r"SELECT paper_id FROM refs GROUP BY 1 HAVING bool_and(coalesce(regexp_matches(raw_text, '^\s*@\w+\s*\{'), false))")
def papers_all_entries(spark: SparkSession, d: str) -> DataFrame:
    return D.papers_all_entries(table(spark, d, "refs"))


@query("SELECT paper_id, count(*) AS n_refs FROM refs GROUP BY 1 HAVING count(*) >= 20")
def having_min_refs(spark: SparkSession, d: str) -> DataFrame:
    return D.having_at_least(table(spark, d, "refs"), "paper_id", 20)


@query(f"""WITH p AS (SELECT paper_id, row_number() OVER (ORDER BY {_KEY.format(42, 'paper_id')}, paper_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT paper_id FROM refs))
SELECT paper_id, CASE WHEN n < 10 OR r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'validation' ELSE 'test' END AS partition FROM p""")
def paper_split(spark: SparkSession, d: str) -> DataFrame:
    return D.split_papers(table(spark, d, "refs"), "paper_id")


_SPLIT = f"""pa AS (SELECT paper_id, row_number() OVER (ORDER BY {_KEY.format(42, 'paper_id')}, paper_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT paper_id FROM refs)),
parts AS (SELECT paper_id, CASE WHEN n < 10 OR r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'validation' ELSE 'test' END AS partition FROM pa)"""


@query(f"""WITH b AS (SELECT paper_id FROM refs GROUP BY 1 HAVING count(*) >= 20), r AS (SELECT paper_id, row_number() OVER (ORDER BY {_KEY.format(42, 'paper_id')}, paper_id) AS r FROM b)
SELECT paper_id, CASE WHEN r <= 3 THEN 'train' WHEN r = 4 THEN 'validation' ELSE 'test' END AS partition FROM r WHERE r <= 5""")
def manual_papers(spark: SparkSession, d: str) -> DataFrame:
    return D.manual_pick(D.having_at_least(table(spark, d, "refs"), "paper_id", 20), "paper_id")


@query(f"""WITH {_SPLIT}, s AS (SELECT paper_id, count(*) AS n_refs FROM refs GROUP BY 1)
SELECT partition, coalesce(max(CASE WHEN n_refs >= 20 THEN paper_id END), min(paper_id)) AS paper_id FROM parts JOIN s USING (paper_id) WHERE partition <> 'train' GROUP BY 1""")
def held_out_papers(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "refs")
    return D.one_paper_each(D.split_papers(r, "paper_id"), D.having_at_least(r, "paper_id", 1), "paper_id")


@query(f"WITH {_SPLIT} SELECT pair_id, partition FROM pairs JOIN parts USING (paper_id) WHERE partition IN ('validation', 'test')")
def pairs_by_partition(spark: SparkSession, d: str) -> DataFrame:
    return D.by_partition(table(spark, d, "pairs"), D.split_papers(table(spark, d, "refs"), "paper_id"), "paper_id", ("validation", "test")).select("pair_id", "partition")


@query("SELECT pair_id, bib_title FROM pairs WHERE regexp_matches(bib_title, '(?i)spectral') ORDER BY pair_id LIMIT 1")
def row_pick(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs").filter(F.col("bib_title").rlike("(?i)spectral")).select("pair_id", "bib_title").orderBy("pair_id").limit(1)


@query("SELECT string_split(element_id, '-')[1] AS prefix, count(*) AS total_nodes, count(DISTINCT element_id) AS nodes FROM elements GROUP BY ALL")
def node_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").groupBy(F.split("element_id", "-")[0].alias("prefix")).agg(F.count("*").alias("total_nodes"), F.countDistinct("element_id").alias("nodes"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("label_id").alias("query"), F.coalesce(F.trim("source_paper_id"), F.lit("")).alias("paper"), F.col("ground_truth.id").alias("true_id"))


@query(f"""WITH x AS (SELECT label_id AS query, coalesce(trim(source_paper_id, ' '), '') AS paper, ground_truth.id AS true_id FROM labels),
hp AS (SELECT paper, true_id, row_number() OVER (PARTITION BY paper ORDER BY {_KEY.format(42, 'true_id')}, true_id) - 1 AS r, count(*) OVER (PARTITION BY paper) AS n FROM (SELECT DISTINCT paper, true_id FROM x WHERE true_id IS NOT NULL)),
hd AS (SELECT query, paper, true_id, s, ({_KEY.format(42, 'query')} % n + s) % n AS r FROM x JOIN (SELECT DISTINCT paper, n FROM hp) USING (paper), (SELECT unnest(range(3)) AS s) WHERE true_id IS NOT NULL AND s < n),
h AS (SELECT * FROM (SELECT query, hp.true_id AS cand_id, row_number() OVER (PARTITION BY query ORDER BY s) AS k FROM hd JOIN hp ON hp.paper = hd.paper AND hp.r = hd.r WHERE hp.true_id <> hd.true_id) WHERE k <= 2),
pool AS (SELECT row_number() OVER (ORDER BY {_KEY.format(43, 'query')}, query) - 1 AS place, true_id AS cand_id, paper AS other, count(*) OVER () AS n FROM x WHERE true_id IS NOT NULL),
need AS (SELECT x.*, 4 - coalesce(c, 0) AS need FROM x LEFT JOIN (SELECT query, count(*) AS c FROM h GROUP BY 1) USING (query)),
dr AS (SELECT query, paper, true_id, need, a, {_KEY.format(42, "query || '-' || a")} % (SELECT max(n) FROM pool) AS place FROM need, (SELECT unnest(range(50)) AS a)),
e AS (SELECT query, cand_id, need, row_number() OVER (PARTITION BY query ORDER BY a) AS k FROM dr JOIN pool USING (place) WHERE other <> paper AND cand_id <> true_id)
SELECT query AS label_id, true_id AS cand_id, 1 AS label FROM x UNION ALL SELECT query, cand_id, 0 FROM h UNION ALL SELECT query, cand_id, 0 FROM e WHERE k <= need""")
def augmented_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = _labels(spark, d)
    hard = D.hard_negatives(x)
    return D.positives(x).unionByName(hard).unionByName(D.easy_negatives(x, hard)).select(F.col("query").alias("label_id"), "cand_id", "label")


@query(f"""SELECT pair_id, CAST((row_number() OVER (PARTITION BY label ORDER BY {_KEY.format(42, 'pair_id')}, pair_id) - 1) % 5 AS INTEGER) AS fold FROM pairs WHERE label IS NOT NULL""")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return D.folds(table(spark, d, "pairs").filter("label is not null"), "pair_id", "label").select("pair_id", "fold")


_RANKED = f"{_FEATURES}, s AS (SELECT bib_no, cand_id, max(round(0.7 * feat_title_jaccard + 0.3 * feat_auth_jaccard, 6)) AS score FROM features GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY bib_no ORDER BY score DESC, cand_id) AS INTEGER) AS rank FROM s)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    f = M.pair_features(table(spark, d, "pairs"))
    s = f.groupBy("bib_no", "cand_id").agg(F.max(F.round(0.7 * F.col("feat_title_jaccard") + 0.3 * F.col("feat_auth_jaccard"), 6)).alias("score"))
    return K.top_k(s, ["bib_no"], "score", "cand_id")


@query(f"WITH {_RANKED} SELECT bib_no, cand_id, score, rank FROM r WHERE rank <= 5")
def rank_top5(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)


@query(f"""WITH {_RANKED}, t AS (SELECT DISTINCT bib_no, cand_id FROM pairs WHERE label = 1), h AS (SELECT t.bib_no, coalesce(1.0 / min(rank), 0) AS rr FROM t LEFT JOIN r ON r.bib_no = t.bib_no AND r.cand_id = t.cand_id AND rank <= 5 GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(rr), 6) AS mrr FROM h""")
def mean_reciprocal_rank(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "pairs").filter("label = 1").select("bib_no", F.col("cand_id").alias("true_id")).distinct()
    return K.reciprocal_rank(_ranked(spark, d), truth, ["bib_no"]).agg(F.count("*").alias("n_queries"), F.round(F.avg("rr"), 6).alias("mrr"))


def _pool_ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The 5 best of all candidates of a record's paper, by the classifier trained on the papers of the train partition; and the partitions."""
    from quillspark.plans import model

    p = table(spark, d, "pairs")
    parts = D.split_papers(p, "paper_id")
    names = [x for x in _NAMES if x != "feat_year_diff"]
    known = M.pair_features(p.join(parts.filter("partition = 'train'"), "paper_id").filter("label is not null"))
    scored = model.score(model.train(known, names), M.pair_features(M.candidate_pool(p)))
    return K.top_k(scored.select("paper_id", "bib_no", "cand_id", "score"), ["paper_id", "bib_no"], "score", "cand_id"), parts


@query()
def rank_pool_top5(spark: SparkSession, d: str) -> DataFrame:
    return _pool_ranked(spark, d)[0]


@query()
def mrr_pool(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank of the labelled records by partition; the model has seen the labels of `train`."""
    ranked, parts = _pool_ranked(spark, d)
    truth = table(spark, d, "pairs").filter("label = 1").select("paper_id", "bib_no", F.col("cand_id").alias("true_id")).distinct()
    rr = K.reciprocal_rank(ranked, truth, ["paper_id", "bib_no"]).join(parts, "paper_id")
    return rr.groupBy("partition").agg(F.count("*").alias("n_queries"), F.round(F.avg("rr"), 6).alias("mrr"))


@query("""SELECT source_paper_id AS paper, key, arg_max(ground_truth.id, label_id) AS true_id FROM labels WHERE trim(source_paper_id, ' ') <> '' AND trim(key, ' ') <> '' AND trim(ground_truth.id, ' ') <> '' GROUP BY ALL""")
def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").select("label_id", F.col("source_paper_id").alias("paper"), "key", F.col("ground_truth.id").alias("true_id"))
    return K.ground_truth(x)


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY paper_id, cand_id ORDER BY pair_id) AS n FROM pairs) SELECT paper_id, cand_id, cand_title, cand_year FROM x WHERE n = 1""")
def first_candidates(spark: SparkSession, d: str) -> DataFrame:
    return M.first_candidates(table(spark, d, "pairs"), ["cand_title", "cand_year"])


@query(f"WITH {_FEATURES}, l AS (SELECT * FROM features WHERE label IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{x}' AS feature, CASE WHEN isfinite(corr({x}, label)) THEN round(corr({x}, label), 6) END AS corr FROM l" for x in _NAMES))
def feature_label_correlation(spark: SparkSession, d: str) -> DataFrame:
    return K.correlations(M.pair_features(table(spark, d, "pairs")).filter("label is not null"), _NAMES, "label")


@query(f"WITH {_FEATURES}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM features" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]) + ") SELECT feature_a, feature_b, round(corr, 6) AS corr FROM c WHERE isfinite(corr) AND abs(round(corr, 6)) > 0.7")
def collinear_features(spark: SparkSession, d: str) -> DataFrame:
    return K.collinear(M.pair_features(table(spark, d, "pairs")), _NAMES, 0.7)


@query("""SELECT count(*) AS n_rows, count(*) FILTER (trim(coalesce(bib_title, ''), ' ') = '') AS blank_bib_title, count(*) FILTER (trim(coalesce(cand_title, ''), ' ') = '') AS blank_cand_title,
 count(*) FILTER (coalesce(len(bib_authors), 0) = 0) AS no_bib_authors, count(*) FILTER (coalesce(len(cand_authors), 0) = 0) AS no_cand_authors, count(*) FILTER (trim(coalesce(bib_id, ''), ' ') = '') AS no_bib_id,
 count(*) FILTER (trim(coalesce(bib_year, ''), ' ') = '') AS no_bib_year, count(*) FILTER (len(bib_authors) <> len(list_distinct(bib_authors))) AS repeated_authors FROM pairs""")
def data_quality_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.data_quality(table(spark, d, "pairs"))


@query(r"""SELECT CASE WHEN i = '' THEN 'Missing Extracted ID' WHEN i = c THEN 'Exact Match' WHEN contains(i, c) OR contains(c, i) THEN 'Partial Match' ELSE 'Mismatch' END AS status, count(*) AS n
FROM (SELECT regexp_replace(lower(coalesce(bib_id, '')), '[^a-z0-9]', '', 'g') AS i, regexp_replace(lower(coalesce(cand_id, '')), '[^a-z0-9]', '', 'g') AS c FROM pairs) GROUP BY ALL""")
def id_match_status(spark: SparkSession, d: str) -> DataFrame:
    return Q.id_status(table(spark, d, "pairs"))


@query(r"""SELECT pair_id, len(string_split_regex(trim(bib_title, ' '), '\s+')) AS bib_words, len(string_split_regex(trim(cand_title, ' '), '\s+')) AS cand_words, length(regexp_replace(coalesce(bib_title, ''), '[^{}$\\]', '', 'g')) AS noise FROM pairs WHERE trim(bib_title, ' ') <> '' AND trim(cand_title, ' ') <> ''""")
def title_statistics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").filter("trim(bib_title) <> '' and trim(cand_title) <> ''")
    n = lambda c: F.size(F.split(F.trim(c), r"\s+")).cast("bigint")
    return p.select("pair_id", n("bib_title").alias("bib_words"), n("cand_title").alias("cand_words"), T.noise(F.col("bib_title")).cast("bigint").alias("noise"))


@query(f"WITH {_FEATURES} SELECT CAST(floor(feat_title_jaccard * 10) AS INTEGER) AS bucket, count(*) AS n FROM features GROUP BY ALL")
def similarity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return M.pair_features(table(spark, d, "pairs")).groupBy(F.floor(F.col("feat_title_jaccard") * 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {_FEATURES} SELECT round(avg(feat_title_edit) * 100, 4) AS mean_title_similarity, round(avg(feat_auth_jaccard) * 100, 4) AS mean_author_jaccard, round(avg(CASE WHEN feat_id_match = 1 THEN 1.0 ELSE 0.0 END) * 100, 4) AS exact_id_rate FROM features WHERE label = 1")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    f = M.pair_features(table(spark, d, "pairs")).filter("label = 1")
    return f.agg(F.round(F.avg("feat_title_edit") * 100, 4).alias("mean_title_similarity"), F.round(F.avg("feat_auth_jaccard") * 100, 4).alias("mean_author_jaccard"), F.round(F.avg(F.when(F.col("feat_id_match") == 1, 1.0).otherwise(0.0)) * 100, 4).alias("exact_id_rate"))


@query("SELECT pair_id, len(string_split_regex(bib_title, '\\s+')) - len(string_split_regex(cand_title, '\\s+')) AS len_diff FROM pairs WHERE len(string_split_regex(bib_title, '\\s+')) - len(string_split_regex(cand_title, '\\s+')) < -5 ORDER BY 2, 1 LIMIT 3")
def short_title_outliers(spark: SparkSession, d: str) -> DataFrame:
    diff = (F.size(F.split("bib_title", r"\s+")) - F.size(F.split("cand_title", r"\s+"))).cast("bigint")
    return table(spark, d, "pairs").filter("bib_title is not null and cand_title is not null").select("pair_id", diff.alias("len_diff")).filter("len_diff < -5").orderBy("len_diff", "pair_id").limit(3)


@query("SELECT coalesce(type, 'total') AS type, count(*) AS n, count(DISTINCT paper_id) AS papers FROM refs WHERE type IS NOT NULL GROUP BY ROLLUP (type)")
def refs_per_type_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "refs").filter("type is not null").rollup("type").agg(F.count("*").alias("n"), F.countDistinct("paper_id").alias("papers"))
    return r.select(F.coalesce("type", F.lit("total")).alias("type"), "n", "papers")


@query("""WITH f AS (SELECT paper_id, version, unnest(metadata.merged_files) AS file FROM flat_docs), g AS (SELECT DISTINCT * FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY version, file) AS n FROM g) SELECT paper_id, version, file FROM r WHERE n <= 10""")
def folder_explorer(spark: SparkSession, d: str) -> DataFrame:
    return Q.first_files(table(spark, d, "flat_docs"))


_CITED = r"""list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(content, '\\(?:no)?cite[a-zA-Z]*\s*(?:\[[^\]]*\]\s*)*\{([^}]+)\}', 1), lambda s: string_split(s, ','))), lambda x: trim(x, ' ')), lambda x: x <> ''))"""


@query(f"SELECT doc_no, unnest({_CITED}) AS key FROM flat_docs")
def cited_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "flat_docs").filter("content is not null").select("doc_no", F.explode(T.cited_keys(F.col("content"))).alias("key"))


@query(f"""WITH c AS (SELECT DISTINCT paper_id, version, unnest({_CITED}) AS key FROM flat_docs), s AS (SELECT paper_id, version, bool_or(key = '*') AS everything FROM c GROUP BY ALL)
SELECT ref_id FROM refs r LEFT JOIN s USING (paper_id, version) WHERE s.everything IS NULL OR s.everything OR EXISTS (SELECT 1 FROM c WHERE c.paper_id = r.paper_id AND c.version = r.version AND c.key = r.key)""")
def used_key_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "flat_docs").filter("content is not null")
    cited = docs.select("paper_id", "version", F.explode(T.cited_keys(F.col("content"))).alias("key")).distinct()
    return R.used_refs(table(spark, d, "refs"), cited, ["paper_id", "version"]).select("ref_id")


_FILES = r"""doc AS (SELECT paper_id, version, arg_min(content, doc_no) AS content FROM flat_docs WHERE content IS NOT NULL GROUP BY ALL),
files AS (SELECT paper_id, version, 'main.tex' AS rel_path, '\documentclass{article}' || chr(10) || '\begin{document}' || chr(10) || '\maketitle \input{text/body} \include{gone}' || chr(10) || '\end{document}' AS content FROM doc
  UNION ALL SELECT paper_id, version, 'text/body.tex', content FROM doc
  UNION ALL SELECT paper_id, version, 'response.tex', '\documentclass{article}\begin{document}Thanks.\end{document}' FROM doc
  UNION ALL SELECT paper_id, version, 'main.bbl', '' FROM doc)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A source of four files for each flattened document: a root that includes its text and a file that is not there, a reply, and a bibliography."""
    doc = table(spark, d, "flat_docs").filter("content is not null").groupBy("paper_id", "version").agg(F.min_by("content", "doc_no").alias("content"))
    one = lambda path, text: F.struct(F.lit(path).alias("rel_path"), text.alias("content"))
    main = F.lit("\\documentclass{article}\n\\begin{document}\n\\maketitle \\input{text/body} \\include{gone}\n\\end{document}")
    reply = F.lit("\\documentclass{article}\\begin{document}Thanks.\\end{document}")
    files = F.array(one("main.tex", main), one("text/body.tex", F.col("content")), one("response.tex", reply), one("main.bbl", F.lit("")))
    return doc.select("paper_id", "version", F.explode(files).alias("f")).select("paper_id", "version", "f.*")


_V = ["paper_id", "version"]


@query(rf"""WITH {_FILES}, i AS (SELECT paper_id, version, rel_path AS parent, trim(unnest(regexp_extract_all(content, '\\(?:input|include|subfile)(?:\[[^\]]*\])?\{{([^}}]+)\}}', 1)), ' ') AS t FROM files),
b AS (SELECT *, CASE WHEN regexp_matches(t, '\.tex$') THEN string_split(t, '/')[-1] ELSE string_split(t, '/')[-1] || '.tex' END AS base FROM i)
SELECT DISTINCT b.paper_id, b.version, parent, max(f.rel_path) AS child FROM b JOIN files f ON f.paper_id = b.paper_id AND f.version = b.version AND string_split(f.rel_path, '/')[-1] = base GROUP BY b.paper_id, b.version, parent, base""")
def include_edges(spark: SparkSession, d: str) -> DataFrame:
    return L.include_edges(_files(spark, d), _V)


@query(rf"""WITH {_FILES}, c AS (SELECT *, regexp_replace(content, '%[^\n]*', '', 'g') AS c, lower(string_split(rel_path, '/')[-1]) AS base FROM files WHERE rel_path LIKE '%.tex')
SELECT paper_id, version, rel_path AS path, CASE WHEN NOT contains(c, '\documentclass') THEN -1000 ELSE CAST(20 + CASE WHEN contains(c, '\begin{{document}}') THEN 20 ELSE 0 END - CASE WHEN base = 'body.tex' THEN 50 ELSE 0 END + CASE WHEN base = 'main.tex' THEN 60 ELSE 0 END
  + CASE WHEN contains(c, '\bibliography') OR contains(c, '\begin{{thebibliography}}') THEN 15 ELSE 0 END + CASE WHEN contains(c, '\maketitle') THEN 10 ELSE 0 END + CASE WHEN contains(c, '\begin{{abstract}}') THEN 10 ELSE 0 END
  + least(3 * len(regexp_extract_all(c, '\\(?:input|include|subfile)\b')), 30) + CASE WHEN base = 'main.tex' THEN 10 ELSE 0 END - CASE WHEN base = 'response.tex' THEN 50 ELSE 0 END
  - CASE WHEN contains(c, '\documentclass{{beamer}}') THEN 50 WHEN contains(c, '\documentclass{{standalone}}') THEN 20 WHEN contains(c, '\documentclass{{letter}}') THEN 50 ELSE 0 END AS INTEGER) END AS score FROM c""")
def root_scores(spark: SparkSession, d: str) -> DataFrame:
    return L.root_scores(_files(spark, d), _V).drop("length")


@query(f"WITH {_FILES} SELECT paper_id, version, 'main.tex' AS root FROM doc")
def root_choice(spark: SparkSession, d: str) -> DataFrame:
    return L.choose_root(L.root_scores(_files(spark, d), _V), _V)


@query(rf"""WITH {_FILES}, s AS (SELECT paper_id, version, regexp_replace(content, '(^|[^\\])%[^\n]*', '\1', 'g') AS c FROM doc)
SELECT paper_id, version, 'main.tex' AS root_file_path, 1 AS merged_count, CAST(1 + len(regexp_extract_all(c, '\\(?:input|include|subfile)(?:\[[^\]]*\])?\s*(?:\{{[^}}]+\}}|\s+[^\s{{}}\\%]+)')) AS INTEGER) AS n_missing,
  '\documentclass{{article}}' || chr(10) || '\begin{{document}}' || chr(10) || '\maketitle ' || chr(10) || '% <BEGIN_FILE: text/body.tex>' || chr(10) ||
  regexp_replace(c, '\\(?:input|include|subfile)(?:\[[^\]]*\])?\s*(?:\{{\s*([^}}]+?)\s*\}}|\s+([^\s{{}}\\%]+))', chr(10) || '% <WARNING: File not found: \1\2>' || chr(10), 'g') ||
  chr(10) || '% <END_FILE: text/body.tex>' || chr(10) || ' ' || chr(10) || '% <WARNING: File not found: gone>' || chr(10) || chr(10) || '\end{{document}}' AS content FROM s""")
def flatten_sources(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    flat = L.flatten(f.filter("rel_path like '%.tex'"), L.choose_root(L.root_scores(f, _V), _V), _V)
    return flat.select("paper_id", "version", "root_file_path", F.col("metadata.merged_count").alias("merged_count"), F.size("metadata.missing_files").alias("n_missing"), "content")


_CMD = r"\\(?:no)?cite[a-zA-Z]*\s*(?:\[[^\]]*\]\s*)*\{[^}]+\}"


@query(rf"""WITH {_CANON}, j AS (SELECT f.paper_id, f.version, f.key AS old_key, c.canonical_key AS new_key, row_number() OVER (PARTITION BY f.paper_id, f.version, f.key ORDER BY f.ord DESC, f.ref_id DESC, c.canonical_key DESC) AS n
  FROM f JOIN c USING (paper_id, fingerprint) WHERE f.key IS NOT NULL AND f.key <> c.canonical_key),
m AS (SELECT paper_id, version, old_key, new_key FROM j WHERE n = 1),
x AS (SELECT DISTINCT doc_no, paper_id, version, unnest(regexp_extract_all(content, '{_CMD}')) AS cmd FROM flat_docs),
k AS (SELECT doc_no, cmd, unnest(range(1, len(string_split(regexp_extract(cmd, '\{{([^}}]+)\}}$', 1), ',')) + 1)) AS i, trim(unnest(string_split(regexp_extract(cmd, '\{{([^}}]+)\}}$', 1), ',')), ' ') AS key, paper_id, version FROM x),
y AS (SELECT doc_no, cmd, regexp_extract(cmd, '(?s)^(.*\{{)[^}}]+\}}$', 1) || string_agg(coalesce(new_key, key), ', ' ORDER BY i) || '}}' AS becomes FROM k LEFT JOIN m ON m.paper_id = k.paper_id AND m.version = k.version AND m.old_key = k.key GROUP BY doc_no, cmd),
z AS (SELECT doc_no, list(struct_pack(cmd := cmd, becomes := becomes)) AS l FROM y WHERE cmd <> becomes GROUP BY doc_no)
SELECT doc_no, CASE WHEN l IS NULL THEN content ELSE list_reduce(list_prepend(content, list_transform(l, lambda e: e.cmd || chr(1) || e.becomes)), lambda a, e: replace(a, string_split(e, chr(1))[1], string_split(e, chr(1))[2])) END AS content FROM flat_docs LEFT JOIN z USING (doc_no)""")
def citation_rewrite(spark: SparkSession, d: str) -> DataFrame:
    maps = R.key_map(table(spark, d, "refs"))
    return R.rewrite(table(spark, d, "flat_docs"), maps, ["paper_id", "version"], "content").select("doc_no", "content")


@query(r"""WITH r AS (SELECT paper_id, version, trim(key, ' ') AS key, trim(regexp_replace(raw_text, '\s+', ' ', 'g'), ' ') AS raw_text, row_number() OVER (PARTITION BY paper_id, version, trim(key, ' ') ORDER BY ord, ref_id) AS n FROM refs WHERE type = 'bibitem' AND key IS NOT NULL AND raw_text IS NOT NULL)
SELECT paper_id, version, key, raw_text FROM r WHERE n = 1 AND key <> ''""")
def bibitem_split(spark: SparkSession, d: str) -> DataFrame:
    """Printed references of a version, written out as one bibliography and split again."""
    r = table(spark, d, "refs").filter("type = 'bibitem' and key is not null and raw_text is not null")
    block = r.groupBy("paper_id", "version").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref_id", "key", "raw_text"))), lambda x: F.concat(F.lit("\\bibitem{"), x["key"], F.lit("} "), x["raw_text"])), "\n").alias("block"))
    return R.bibitems(block, F.col("block"), "paper_id", "version").select("paper_id", "version", "key", "raw_text")


_BALANCED = r"(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*"
_LEVEL = "CASE lower({}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.LEVELS.items()) + " ELSE 0 END"


@query(rf"""WITH x AS (SELECT doc_no, regexp_extract_all(content, '(?is)\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\s*\{{{_BALANCED}\}}') AS m FROM flat_docs),
h AS (SELECT doc_no, unnest(range(1, len(m) + 1)) AS pos, unnest(m) AS m FROM x),
n AS (SELECT doc_no, CAST(pos AS INTEGER) AS pos, lower(regexp_extract(m, '\\([A-Za-z]+)', 1)) AS type, regexp_extract(m, '(?s)^\\[A-Za-z]+\*?\s*\{{(.*)\}}$', 1) AS title FROM h
  UNION ALL SELECT doc_no, 0, 'document', 'Root' FROM flat_docs),
l AS (SELECT *, CAST({_LEVEL.format("type")} AS INTEGER) AS level FROM n)
SELECT doc_no, pos, CASE WHEN pos > 0 THEN coalesce((SELECT max(u.pos) FROM l u WHERE u.doc_no = l.doc_no AND u.pos < l.pos AND u.level < l.level), 0) END AS parent_pos, type, title, level FROM l""")
def header_tree(spark: SparkSession, d: str) -> DataFrame:
    return L.header_parents(L.headers(table(spark, d, "flat_docs"), ["doc_no"]), ["doc_no"]).select("doc_no", "pos", "parent_pos", "type", "title", "level")


@query()
def content_blocks(spark: SparkSession, d: str) -> DataFrame:
    return L.blocks(L.headers(table(spark, d, "flat_docs"), ["doc_no"]), ["doc_no", "pos"])


_NEST = r"((?:[^{}]|\{[^{}]*\})*)"


@query(rf"""WITH p AS (SELECT doc_no, content, regexp_extract(content, '(?s)\\begin\{{abstract\}}(.*?)\\end\{{abstract\}}', 1) AS env FROM flat_docs)
SELECT doc_no, trim(regexp_extract(content, '(?s)\\title\s*(?:\[[^\]]*\])?\{{{_NEST}\}}', 1), ' ') AS title, array_to_string(list_transform(regexp_extract_all(content, '(?s)\\author\s*(?:\[[^\]]*\])?\{{{_NEST}\}}', 1), lambda x: trim(x, ' ')), ', ') AS authors,
  trim(CASE WHEN env <> '' THEN env ELSE regexp_extract(content, '(?s)\\abstract\s*\{{{_NEST}\}}', 1) END, ' ') AS abstract FROM p""")
def preamble(spark: SparkSession, d: str) -> DataFrame:
    return L.preamble(table(spark, d, "flat_docs"), ["doc_no"])


def _latex_sql(c: str) -> str:
    """The cleaning of a LaTeX fragment as SQL; where a word must end, the letter after it is put back, which takes a second pass for neighbours."""
    keep = r"(\$[^$]+\$|\\\([^)]+\\\))|"
    t = rf"regexp_replace(regexp_replace(coalesce({c}, ''), '(?s)^.*?\\begin\{{document\}}', ''), '\\end\{{document\}}', '', 'g')"
    t = rf"regexp_replace({t}, '(^|[^\\])%[^\n]*', '\1', 'g')"
    for _ in range(3):
        t = rf"regexp_replace({t}, '{keep}\\texorpdfstring\s*\{{{_NEST}\}}\s*\{{{_NEST}\}}', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '{keep}\\(?:{'|'.join(L.DROP_WITH_ARGUMENT)})(?:\[[^\]]*\])?\{{[^}}]*\}}', '\1', 'g')"
    t = rf"regexp_replace({t}, '{keep}\\(?:{'|'.join(L.LAYOUT)})\b', '\1', 'g')"
    t = rf"regexp_replace({t}, '\\(?:begin|end)\{{abstract\}}', '', 'g')"
    for _ in range(5):
        t = rf"regexp_replace({t}, '{keep}\\(?:{'|'.join(L.UNWRAP)})(?:\[[^\]]*\])?\{{{_NEST}\}}', '\1\2', 'g')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'), ' ')"


@query(f"SELECT element_no, {_latex_sql('content')} AS clean FROM elements WHERE content IS NOT NULL")
def latex_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").filter("content is not null").select("element_no", L.clean_latex(F.col("content")).alias("clean"))


@query(r"""SELECT element_no, '\begin{equation}' || chr(10) || trim(regexp_replace(regexp_replace(regexp_replace(content, '\$\$|\\\[|\\\]|\\(?:begin|end)\{equation\*?\}', '', 'g'), '\\label\{[^}]*\}|\\nonumber|\\notag', '', 'g'), '\s+', ' ', 'g')) || chr(10) || '\end{equation}' AS equation FROM elements WHERE node_type = 'equation'""")
def equation_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").filter("node_type = 'equation'").select("element_no", L.clean_equation(F.col("content")).alias("equation"))


@query(rf"""WITH a AS (SELECT element_no, regexp_replace(regexp_replace(regexp_replace(content, '(?i)(\\begin\{{(?:figure|table)\*?\}})\[[^\]]*\]', '\1', 'g'), '\\(?:{'|'.join(L.FIGURE)})', '', 'g'), '\\label\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}}', '', 'g') AS t FROM elements WHERE content IS NOT NULL),
b AS (SELECT element_no, t, regexp_extract(t, '(?s)\\caption(?:\[[^\]]*\])?\{{{_NEST}\}}') AS m FROM a)
SELECT element_no, regexp_replace(CASE WHEN m = '' THEN t ELSE replace(t, m, regexp_extract(m, '(?s)^(\\caption(?:\[[^\]]*\])?\{{)', 1) || {_latex_sql("regexp_extract(m, '(?s)^" + chr(92) * 2 + "caption(?:" + chr(92) + "[[^" + chr(92) + "]]*" + chr(92) + "])?" + chr(92) + "{(.*)" + chr(92) + "}$', 1)")} || '}}') END, '^\s+|\s+$', '', 'g') AS figure FROM b""")
def figure_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").filter("content is not null").select("element_no", L.clean_figure(F.col("content")).alias("figure"))


@query(rf"SELECT element_no, trim(regexp_replace(regexp_replace(content, '\\(?:{'|'.join(L.LIGHT)})', '', 'g'), '\\begin\{{(figure|table)\}}\[[^\]]*\]', '\\begin{{\1}}', 'g'), ' ') AS light FROM elements WHERE content IS NOT NULL")
def light_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").filter("content is not null").select("element_no", L.light_clean(F.col("content")).alias("light"))


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return os.path.join(shared_dir(spark), f"written-{uuid.uuid4().hex}")


_PAPER = r"paper(?:_id)?=([^/]+)/"


@query("SELECT label_id, key, content, ground_truth.id AS true_id, round(ground_truth.match_score, 4) AS match_score, source_paper_id FROM labels WHERE key IS NOT NULL")
def labels_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    sinks.labels_json(table(spark, d, "labels").select("label_id", "key", "content", "ground_truth", "source_paper_id"), at)
    back = spark.read.schema(f"label_id bigint, {sources.LABELS}").json(at, multiLine=True, recursiveFileLookup=True)
    return back.filter("key is not null").select("label_id", "key", "content", F.col("ground_truth.id").alias("true_id"), F.col("ground_truth.match_score").alias("match_score"), "source_paper_id")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY paper_id, cand_id ORDER BY pair_id) AS n FROM pairs)
SELECT paper_id, cand_id, lower(trim(coalesce(cand_title, ''), ' ')) AS title, list_transform(coalesce(cand_authors, []), lambda a: lower(trim(a, ' '))) AS authors, substr(coalesce(cand_year, ''), 1, 4) AS year FROM x WHERE n = 1""")
def candidates_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    c = M.first_candidates(table(spark, d, "pairs"), ["cand_title", "cand_authors", "cand_year"]).withColumnsRenamed({"cand_title": "title", "cand_authors": "authors", "cand_year": "year"})
    sinks.references_json(c, at)
    return sources.candidates(spark, [f"{at}/*/*"], _PAPER)


@query("""WITH r AS (SELECT paper_id, version_num, child_id, parent_id, row_number() OVER (PARTITION BY paper_id, version_num, child_id ORDER BY edge_no DESC) AS n FROM hierarchy WHERE trim(parent_id) <> '')
SELECT paper_id, version_num, child_id, parent_id FROM r WHERE n = 1""")
def hierarchy_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    e = table(spark, d, "elements").groupBy("paper_id", "element_id").agg(F.min_by("content", "element_no").alias("content"))
    sinks.hierarchy_json(hierarchy_edges(spark, d), e, at)
    return sources.hierarchies(spark, [f"{at}/*/*"], _PAPER)


@query("""WITH x AS (SELECT DISTINCT paper_id, bib_no, cand_id FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, bib_no ORDER BY cand_id) AS n FROM x)
SELECT paper_id, 'test' AS partition, CAST(bib_no AS VARCHAR) AS key, CAST(n AS INTEGER) AS rank, cand_id FROM r WHERE n <= 5""")
def predictions_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    p = table(spark, d, "pairs")
    one = p.select("paper_id", F.col("bib_no").cast("string").alias("key"), "cand_id").distinct().withColumn("score", F.lit(1.0))
    ranked = K.top_k(one, ["paper_id", "key"], "score", "cand_id").withColumn("partition", F.lit("test"))
    truth = p.filter("label = 1").groupBy("paper_id", F.col("bib_no").cast("string").alias("key")).agg(F.min("cand_id").alias("true_id"))
    sinks.predictions_json(ranked, truth, at)
    back = sources.predictions(spark, [f"{at}/*/*"], _PAPER)
    return back.select("paper_id", "partition", F.explode("prediction").alias("key", "ids")).select("paper_id", "partition", "key", F.posexplode("ids").alias("rank", "cand_id")).withColumn("rank", F.col("rank") + 1)


@query()
def hierarchy_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Trees assembled from the flattened sources: the edges between unified nodes and the texts of the nodes."""
    docs = table(spark, d, "flat_docs").filter("content is not null").groupBy("paper_id", "version").agg(F.min_by("content", "doc_no").alias("content"))
    edges, elements = H.hierarchy(H.assemble(docs, ["paper_id", "version"]))
    return edges.join(elements.select("paper_id", F.col("element_id").alias("child_id"), "node_type", "content"), ["paper_id", "child_id"], "left")


@query(r"""SELECT element_no, len(regexp_extract_all(content, '\$[^$]+\$|\\\([^)]*\\\)')) AS n_math FROM elements WHERE content IS NOT NULL""")
def inline_math_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").filter("content is not null").select("element_no", F.size(L.inline_math(F.col("content"))).cast("bigint").alias("n_math"))


@query()
def markdown_export(spark: SparkSession, d: str) -> DataFrame:
    return X.export(X.ordered_nodes(table(spark, d, "hierarchy"), table(spark, d, "elements")), "markdown")


@query()
def html_export(spark: SparkSession, d: str) -> DataFrame:
    return X.export(X.ordered_nodes(table(spark, d, "hierarchy"), table(spark, d, "elements")), "html")


@query()
def latex_export(spark: SparkSession, d: str) -> DataFrame:
    return X.export(X.ordered_nodes(table(spark, d, "hierarchy"), table(spark, d, "elements")), "latex")


@query()
def classifier_cv_metrics(spark: SparkSession, d: str) -> DataFrame:
    from quillspark.plans import model

    f = M.pair_features(table(spark, d, "pairs")).filter("label is not null")
    return model.cross_validate(D.folds(f, "pair_id", "label"), [x for x in _NAMES if x != "feat_year_diff"])
