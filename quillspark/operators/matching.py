"""Matching references to candidates: exact titles first, then TF-IDF cosine with a year check; pair features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import similarity as S, text as T
from quillspark.session import deal, keep, spread

#: English function words left out of the terms (a fixed list of our own).
STOP = "a about after all also an and any are as at be been between both but by can could do does each for from had has have how if in into is it its may more most no nor not of on or other our over such than that the their these this those to under via was we were what when where which while who will with would".split()
THRESHOLD, YEARS, TOP = 0.55, 2, 3


def word_terms(c: Column, stop: list[str] = STOP) -> Column:
    """Words of two letters or more that are no stop words, and pairs of neighbours."""
    w = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: (F.length(x) >= 2) & ~x.isin(*stop))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.try_element_at(w, i), F.try_element_at(w, i + 1)))
    return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def char_terms(c: Column) -> Column:
    """Pieces of 2 to 4 characters inside words, a space at either end of a word."""
    words = F.transform(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))

    def pieces(w: Column) -> Column:
        def cut(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))

        return F.concat(cut(2), cut(3), cut(4))

    return F.flatten(F.transform(words, pieces))


def tfidf(docs: DataFrame, scope: list[str], doc: str, terms: Column, fit: DataFrame | None = None, min_df: int = 1) -> DataFrame:
    """(scope, doc, term, weight): TF-IDF with idf = ln((1+n)/(1+df)) + 1, at length 1, fitted per scope on `fit` (or docs), whose vocabulary alone counts."""
    def counts(d: DataFrame) -> DataFrame:
        return d.select(*scope, doc, F.explode(terms).alias("term")).groupBy(*scope, doc, "term").agg(F.count("*").alias("tf"))

    tf = counts(docs)
    base = tf if fit is None else counts(fit)
    n = (docs if fit is None else fit).groupBy(*scope).agg(F.countDistinct(doc).alias("n")) if scope else (docs if fit is None else fit).agg(F.countDistinct(doc).alias("n"))
    df = base.groupBy(*scope, "term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    idf = (df.join(n, scope) if scope else df.crossJoin(F.broadcast(n))).select(*scope, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, [*scope, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(*scope, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, [*scope, doc]).select(*scope, doc, "term", (F.col("w") / F.col("norm")).alias("weight"))


def exact_titles(queries: DataFrame, cands: DataFrame, on: list[str]) -> DataFrame:
    """(on, query, cand_id): clean titles over 5 characters that are the same; the last candidate of a title counts."""
    c = cands.withColumn("t", T.clean_for_match("title")).filter(F.length("t") > 5).groupBy(*on, "t").agg(F.max("cand_id").alias("cand_id"))
    return queries.withColumn("t", T.clean_for_match("title")).join(c, [*on, "t"]).select(*on, "query", "cand_id")


def match(queries: DataFrame, cands: DataFrame, on: list[str], threshold: float = THRESHOLD, years: int = YEARS, top: int = TOP, stop: list[str] = STOP) -> DataFrame:
    """(on, query, cand_id, score): the exact title, score 1; else of the `top` candidates by cosine the first that
    reaches the threshold and, where both years are known, lies within `years`.

    queries: on, query, text, title; cands: on, cand_id, title, authors (string), year. `stop`: words that are no
    terms. Ties go to the smaller cand_id.
    """
    queries, cands = keep(queries, "queries"), keep(cands, "cands")
    exact = exact_titles(queries, cands, on)
    rest = queries.join(exact.select(*on, "query"), [*on, "query"], "left_anti")
    doc = F.concat_ws(" ", T.clean_for_match("title"), T.clean_for_match("title"), T.clean_for_match("authors"), F.col("year").cast("string"))
    c = cands.select(*on, F.concat(F.lit("c"), F.col("cand_id")).alias("doc"), doc.alias("x"))
    q = rest.select(*on, F.concat(F.lit("q"), F.col("query").cast("string")).alias("doc"), T.clean_for_match("text").alias("x"))
    c = keep(c, "docs")
    wc = tfidf(c, on, "doc", word_terms(F.col("x"), stop))
    wq = tfidf(q, on, "doc", word_terms(F.col("x"), stop), fit=c)
    cos = wq.select(*on, F.col("doc").alias("q"), "term", F.col("weight").alias("a")).join(wc.select(*on, F.col("doc").alias("c"), "term", F.col("weight").alias("b")), [*on, "term"]).groupBy(*on, "q", "c").agg(F.round(F.sum(F.col("a") * F.col("b")), 9).alias("score"))
    rank = F.row_number().over(W.partitionBy(*on, "q").orderBy(F.desc("score"), "c"))
    best = cos.withColumn("rank", rank).filter(F.col("rank") <= top)
    best = best.select(*on, F.substring("q", 2, 1000).alias("query"), F.substring("c", 2, 1000).alias("cand_id"), "score", "rank")
    yq = rest.select(*on, F.col("query").cast("string").alias("query"), T.year(F.col("text")).alias("yq"))
    yc = cands.select(*on, F.col("cand_id"), T.year(F.col("year").cast("string")).alias("yc"))
    ok = best.join(yq, [*on, "query"]).join(yc, [*on, "cand_id"]).filter((F.col("score") >= threshold) & (F.abs(F.col("yq") - F.col("yc")).isNull() | (F.abs(F.col("yq") - F.col("yc")) <= years)))
    first = ok.groupBy(*on, "query").agg(F.min(F.struct("rank", "cand_id", "score")).alias("m")).select(*on, "query", F.col("m.cand_id").alias("cand_id"), F.col("m.score").alias("score"))
    return exact.select(*on, F.col("query").cast("string").alias("query"), "cand_id", F.lit(1.0).alias("score")).unionByName(first)


def pair_features(p: DataFrame) -> DataFrame:
    """Pairs with the features that built-in expressions give; each is a column of its own, so unused ones are pruned."""
    qt, ct = T.normalize_basic(F.col("bib_title")), T.normalize_basic(F.col("cand_title"))
    words = lambda c: T.tokens(F.array_join(F.coalesce(c, F.array().cast("array<string>")), " "))
    qa, ca = words(F.col("bib_authors")), words(F.col("cand_authors"))
    first = lambda c: F.substring(F.element_at(F.split(F.lower(F.trim(F.coalesce(F.try_element_at(c, F.lit(1)), F.lit("")))), r"\s+"), 1), 1, 3)
    fa, fc = first(F.col("bib_authors")), first(F.col("cand_authors"))
    diff = T.year_diff(F.col("bib_year"), F.col("cand_year"))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return p.withColumns({
        "feat_id_match": T.id_match(F.col("bib_id"), F.col("cand_id")),
        "feat_title_contain": one((qt != "") & (ct != "") & (qt.contains(ct) | ct.contains(qt))),
        "feat_title_len_diff": F.abs(F.length(qt) - F.length(ct)) / F.greatest(F.length(qt), F.length(ct), F.lit(1)),
        "feat_title_jaccard": S.jaccard(T.tokens(qt), T.tokens(ct)),
        "feat_title_edit": S.edit_ratio(qt, ct),
        "feat_auth_jaccard": S.jaccard(qa, ca),
        "feat_auth_overlap": F.size(F.array_intersect(qa, ca)).cast("double"),
        "feat_first_auth_match": one((fa != "") & (fa == fc)),
        "feat_year_diff": diff.cast("double"),
        "feat_year_match": one(diff == 0),
    })


def first_candidates(p: DataFrame, columns: list[str], on: tuple[str, ...] = ("paper_id", "cand_id"), order: str = "pair_id") -> DataFrame:
    """One row per candidate of a paper, with `columns` as its first row has them."""
    return p.groupBy(*on).agg(F.min_by(F.struct(*columns), order).alias("m")).select(*on, "m.*")


def candidate_pool(p: DataFrame) -> DataFrame:
    """Every bibliography record with every candidate of its paper; of a record's or candidate's rows the first counts."""
    first = lambda key, side: first_candidates(p, side, ("paper_id", key))
    q = first("bib_no", ["bib_title", "bib_authors", "bib_id", "bib_year"])
    return q.join(first("cand_id", ["cand_title", "cand_authors", "cand_year"]), "paper_id")


def fuzzy_features(p: DataFrame) -> DataFrame:
    """The features that need block matching: title ratio, ratio of sorted words, best partial ratio, and sorted authors."""
    join = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    return spread(p, "pair_id").withColumns({
        "feat_title_fuzzy": S.fuzzy(T.normalize_basic(F.col("bib_title")), T.normalize_basic(F.col("cand_title"))),
        "feat_title_sort": S.fuzzy_sorted(F.col("bib_title"), F.col("cand_title")),
        "feat_title_partial": S.fuzzy_partial(T.normalize_basic(F.col("bib_title")), T.normalize_basic(F.col("cand_title"))),
        "feat_auth_token_sort": S.fuzzy_sorted(join(F.col("bib_authors")), join(F.col("cand_authors"))),
    })


def all_features(p: DataFrame, scope: list[str] | None = None, min_df: int = 2) -> DataFrame:
    """Pairs with all features: the built-in ones, the block ratios and the TF-IDF cosine of the batch, of each scope, or (scope `pair_id`, min_df 1) of the pair alone."""
    return fuzzy_features(pair_features(p)).join(title_cosine(p, scope, min_df), "pair_id")


#: Characters of titles, A_PAIR more a pair, up to which the titles of a scope are held at once.
HELD, A_PAIR = 500_000, 20


def title_cosine(p: DataFrame, scope: list[str] | None = None, min_df: int = 2) -> DataFrame:
    """(pair_id, feat_title_tfidf_cosine): cosine of character pieces, fitted on the distinct titles of the batch, or of each scope; 0 where nothing is shared."""
    scope = scope or []
    title = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    pairs = p.select(*dict.fromkeys([*scope, "pair_id"]), title("bib_title").alias("a"), title("cand_title").alias("b"))
    if not scope:
        dots = _dots_joined(pairs, scope, min_df)
    else:
        size = F.sum(F.length("a") + F.length("b") + A_PAIR)
        large = pairs.dropna(subset=scope).groupBy(*scope).agg(size.alias("size")).filter(F.col("size") > HELD).select(*scope, F.ceil(F.col("size") / HELD).alias("parts"))
        if large.isEmpty():
            dots = _dots_held(pairs, scope, min_df)
        else:
            large = keep(large, "large")
            dots = _dots_held(pairs.join(large, scope, "left_anti"), scope, min_df).unionByName(_dots_in_parts(pairs.join(large, scope), scope, min_df))
    return dots.select("pair_id", F.round(F.coalesce("dot", F.lit(0.0)), 6).alias("feat_title_tfidf_cosine"))


def _dots_joined(pairs: DataFrame, scope: list[str], min_df: int) -> DataFrame:
    """(pair_id, dot), titles and their pieces joined as tables: for scopes of any size."""
    titles = pairs.select(*scope, F.col("a").alias("t")).unionByName(pairs.select(*scope, F.col("b").alias("t"))).filter("t <> ''").distinct()
    w = tfidf(titles, scope, "t", char_terms(F.col("t")), min_df=min_df)
    distinct = pairs.select(*scope, "a", "b").distinct()
    wa = distinct.join(w.withColumnsRenamed({"t": "a", "weight": "x"}), [*scope, "a"])
    dot = wa.join(w.withColumnsRenamed({"t": "b", "weight": "y"}), [*scope, "b", "term"]).groupBy(*scope, "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return pairs.join(dot, [*scope, "a", "b"], "left").select("pair_id", "dot")


def _dots_held(pairs: DataFrame, scope: list[str], min_df: int) -> DataFrame:
    """(pair_id, dot), a scope at a time, whose titles are held at once: nothing but the pairs is shuffled. A pair with no scope has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, ids, dots, kind = None, [], [], [], None

        def end() -> None:
            dots.extend([None] * len(group) if now is None or None in now else S.cosines(group, min_df))
            group.clear()

        def batch() -> pa.RecordBatch:
            n = len(dots)
            out = pa.RecordBatch.from_arrays([pa.array(ids[:n], kind), pa.array(dots, pa.float64())], ["pair_id", "dot"])
            del ids[:n]
            dots.clear()
            return out

        for b in batches:
            kind = b.schema.field("pair_id").type
            for key, pair_id, x, y in zip(zip(*(b.column(c).to_pylist() for c in scope)), *(b.column(c).to_pylist() for c in ("pair_id", "a", "b"))):
                if key != now or None in key:
                    end()
                    now = key
                group.append((x, y))
                ids.append(pair_id)
            if dots:
                yield batch()
        end()
        if dots:
            yield batch()

    no_scope = F.when(F.greatest(*[F.col(c).isNull() for c in scope], F.lit(False)), F.hash("pair_id"))  # else they all meet in one task
    return deal(pairs, *scope, no_scope).sortWithinPartitions(*scope).mapInArrow(run, f"pair_id {dict(pairs.dtypes)['pair_id']}, dot double")


def _dots_in_parts(pairs: DataFrame, scope: list[str], min_df: int) -> DataFrame:
    """(pair_id, dot) of scopes too large to be held: distinct pairs in `parts` parts, to each of which go the counts of its own pieces."""
    pairs = keep(pairs, "pairs")
    part = lambda *c: F.pmod(F.xxhash64(*c), F.col("parts")).alias("part")
    key = [*scope, "part"]
    types = ", ".join(f"{c} {t}" for c, t in pairs.select(*scope).dtypes)

    def counts(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = Counter(x for t in pdf["t"] for x in S.pieces(t))
        return pd.DataFrame({**{name: [v] * len(c) for name, v in zip(scope, k)}, "term": list(c), "n": list(c.values())})

    def own(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = list({x for t in {*pdf["a"], *pdf["b"]} for x in S.pieces(t)})
        return pd.DataFrame({**{name: [v] * len(c) for name, v in zip(key, k)}, "term": c})

    def dots(k: tuple, pdf: pd.DataFrame, df: pd.DataFrame) -> pd.DataFrame:
        fitted = (int(df["total"].iloc[0]) if len(df) else 1, dict(zip(df["term"], df["df"].tolist())))
        return pdf[[*scope, "a", "b"]].assign(dot=S.cosines(list(zip(pdf["a"], pdf["b"])), min_df, fitted))

    titles = pairs.select(*scope, "parts", F.col("a").alias("t")).unionByName(pairs.select(*scope, "parts", F.col("b").alias("t"))).filter("t <> ''").distinct()
    df = titles.select(*scope, part("t"), "t").groupBy(*key).applyInPandas(counts, f"{types}, term string, n bigint").groupBy(*scope, "term").agg(F.sum("n").alias("df")).filter("df > 1")
    fit = df.join(titles.groupBy(*scope).agg(F.count("*").alias("total")), scope)
    two = keep(pairs.filter("a <> '' and b <> ''").select(*scope, part("a", "b"), "a", "b").distinct(), "two")
    needed = two.groupBy(*key).applyInPandas(own, f"{types}, part bigint, term string").join(fit, [*scope, "term"])
    dot = two.groupBy(*key).cogroup(needed.groupBy(*key)).applyInPandas(dots, f"{types}, a string, b string, dot double")
    return pairs.join(dot, [*scope, "a", "b"], "left").select("pair_id", "dot")
