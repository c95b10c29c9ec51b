"""Collective linkage of records that share no key: bibliography records and candidates of cited works.

The candidate graph joins records that share attributes rare in the corpus, each edge weighted by the rarity of what
it shares. Meta-blocking prunes the edges that are weak for both their ends. The rest are compared field by field,
and the scores are refined by their neighbours: an edge gains from other edges that equate the same pairs of
authors, and loses against a better edge of the same record, round by round until nothing moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.names import fold, one_slip, parse, same_given
from quillspark.session import drop_kept, keep

# Words too common in titles to tell works apart, notes about the form of a work, and kinds of follow-up.
_STOP = frozenset("a an and the of in on for with via to from by at as is its without under beyond into over does help meets".split())
_NOTE = regex.compile(r"(?i)[\s,;:.\-–(\[]*\b(?:preprint|in press|to appear|submitted|forthcoming|accepted|extended(?: version| abstract)?|ext\.? version|full version|short version|early access|online first|working paper|technical report|revised(?: version)?|draft|poster|arxiv(?::?\s*\d{4}\.\d{4,5})?)\b[\s)\].,;]*$")
_FOLLOW = regex.compile(r"(?i)^\W*(erratum|errata|corrigend(?:um|a)|corrections?|addend(?:um|a)|retraction|comments?|remarks?|notes?|replies|reply|response|rebuttal|discussion)\b\s*(?:(?:on|to|for|of)\b\s*:?|[:\-–])\s*")
_PART = regex.compile(r"(?i)(?:[\s,;:(\[\-–]+(?:part|pt\.?|vol(?:ume|\.)?|chapter|episode|no\.?)\s*([ivx]+|\d{1,2}|one|two|three|four|second|third)|[\s,;:(\-–]+([ivx]{2,4}|\d))\W*$")
_NUMBER = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "one": 1, "two": 2, "three": 3, "four": 4, "second": 2, "third": 3}
_KIND = {"errata": "erratum", "corrigendum": "erratum", "corrigenda": "erratum", "correction": "erratum", "corrections": "erratum", "comments": "comment", "remark": "comment", "remarks": "comment", "note": "comment", "notes": "comment", "replies": "reply", "response": "reply", "rebuttal": "reply", "addenda": "addendum"}


def title_parts(title: str | None) -> tuple[list[str], list[str], list[int]]:
    """Words of the bare title, the kinds of follow-up it names and its part numbers (of a part of a part: several), outermost first."""
    t = regex.sub(r"[{}$]|\\[a-zA-Z]+", "", fold(title or ""))
    t = regex.sub(r"(?<=\p{L})-(?=\p{Ll}{1,3}\b)(?<=\p{Ll}{3}-)", "-", t)
    kinds: list[str] = []
    while m := _FOLLOW.match(t):
        k = m[1].lower()
        kinds.append(_KIND.get(k, k))
        t = t[m.end() :]
    parts: list[int] = []
    while True:
        u = _NOTE.sub("", t)
        if m := _PART.search(u):
            p = (m[1] or m[2]).lower()
            parts.append(int(p) if p.isdigit() else _NUMBER.get(p, 0))
            u = u[: m.start()]
        if u == t or not u.strip():
            break
        t = u
    words = regex.findall(r"[\p{L}\p{N}]+", t.lower().replace("&", " and "))
    return words, kinds, parts


def _people(authors) -> tuple[list[tuple[str, list[str]]], bool]:
    """Parsed authors, and whether the list is cut (et al., others)."""
    out, cut = [], False
    for a in authors if authors is not None else ():
        if a is None or not str(a).strip():
            continue
        p = parse(a)
        if p is None:
            cut = True
        elif p["kind"] == "open":
            g = p["given"]
            out.append((g[-1].replace("-", ""), [w for x in g[:-1] for w in x.split("-")]))
        else:
            out.append((p["family"].replace("-", ""), p["given"]))
    return out, cut


def _turned(p: tuple[str, list[str]]) -> tuple[str, list[str]] | None:
    return (p[1][0], p[1][1:] + [p[0]]) if p[1] and len(p[1][0]) > 2 else None


def _one_person(a: tuple[str, list[str]], b: tuple[str, list[str]]) -> bool:
    for x in (a, _turned(a)):
        if x is None:
            continue
        if x[0] == b[0] or len(x[0]) > 4 and one_slip(x[0], b[0]):
            if not x[1] or not b[1] or same_given(x[1][0], b[1][0]) or x[0] == b[0] and x[1][0][0] == b[1][0][0]:
                return True
            if x[0] == b[0] and len(x[0]) > 4 and one_slip(x[1][0], b[1][0]):
                return True
    return False


def parse_work(title: str | None, authors, year: str | None, near: int = 0) -> dict:
    """What a record says, parsed once: words of the title, kinds and parts of a follow-up, authors as `family|given given`, year, its attributes (the year with `near` years around it) and the keys under which it can meet others."""
    words, kinds, parts = title_parts(title)
    people = _people(authors)[0]
    y = regex.search(r"\d{4}", year or "")
    content = [w for w in words if w not in _STOP]
    years = [f"y{int(y[0]) + d}" for d in range(-near, near + 1)] if y else []
    families = {p[0] for p in people} | {t[0] for p in people if (t := _turned(p)) and len(p[1]) == 1}
    return {
        "words": words, "follows": "/".join(kinds) + "/" + "/".join(map(str, parts)), "people": ["|".join((f, " ".join(g))) for f, g in people], "y": int(y[0]) if y else None,
        "attributes": sorted({f"t{w}" for w in content} | {f"f{f}" for f in families} | set(years)), "keys": _keys(content, sorted({p[0] for p in people}), sorted(families), years),
    }


def _keys(content: list[str], families: list[str], either: list[str], years: list[str]) -> list[str]:
    """Pairs of attributes: words that follow each other in the title or stand one word apart, an author and a word, two authors, an author and a year. A title of one word is a key of its own."""
    pairs = {*zip(content, content[1:]), *zip(content, content[2:])}
    keys = {_joined(f"t{a}", f"t{b}") for a, b in pairs if a != b}
    keys |= {_joined(f"f{f}", f"t{w}") for f in either for w in content}
    keys |= {_joined(f"f{f}", f"f{g}") for i, f in enumerate(families) for g in families[i + 1 :]}
    keys |= {_joined(f"f{f}", y) for f in families for y in years}
    if len(set(content)) == 1:
        keys.add(f"t{content[0]}")
    return sorted(keys)


def _joined(*attributes: str) -> str:
    return "\x1f".join(sorted(attributes))


def _soft_overlap(a: list[str], b: list[str]) -> tuple[float, float]:
    """Shares of a's and of b's words that have a partner, a slip allowed; long words that were cut or joined count too."""
    left = list(b)
    hit = 0.0
    miss = []
    for w in a:
        if w in left:
            left.remove(w)
            hit += 1
        else:
            miss.append(w)
    for w in miss:
        m = next((x for x in left if len(w) > 3 and len(x) > 3 and one_slip(w, x)), None)
        if m:
            left.remove(m)
            hit += 0.95
    return hit / max(1, len(a)), hit / max(1, len(b))


def _person(p: str) -> tuple[str, list[str]]:
    family, _, given = p.partition("|")
    return family, given.split()


def compare_works(bt, ba, by, ct, ca, cy) -> float:
    """Score from 0 to 1 that a record and a candidate, given by title, authors and year, are one work."""
    b, c = parse_work(bt, ba, by), parse_work(ct, ca, cy)
    return compare_parsed(b["words"], b["follows"], [_person(p) for p in b["people"]], b["y"], c["words"], c["follows"], [_person(p) for p in c["people"]], c["y"])


def compare_parsed(bw, bk, bpeople, b_year, cw, ck, cpeople, c_year) -> float:
    """Score from 0 to 1 that a record and a candidate are one work, of their words, follow-ups, people and years; 0 where a field rules it out."""
    if bw and cw and bk != ck:
        return 0.0
    if bw and cw and len(bw) + len(cw) > 6:
        # fewer than a third of the longer title's words in the shorter one, even with every slip allowed for
        if min(len(bw), len(cw)) < 0.28 * max(len(bw), len(cw)) and "".join(bw) != "".join(cw):
            return 0.0
    people = None
    if bpeople and cpeople:
        left, hit = list(cpeople), 0
        for p in bpeople:
            m = next((q for q in left if _one_person(p, q) or _one_person(q, p)), None)
            if m:
                left.remove(m)
                hit += 1
        people = hit / min(len(bpeople), len(cpeople))
        if people < 0.5:
            return 0.0
    gap = abs(b_year - c_year) if b_year is not None and c_year is not None else None
    when = 0.6 if gap is None else (1.0, 0.85, 0.7, 0.3)[min(gap, 3)]
    if not bw or not cw:
        if people is None or people < 0.99 or gap is None or gap > 1:
            return 0.0
        return 0.4 + 0.1 * when + 0.15 * min(3, len(bpeople)) / 3
    pa, pb = _soft_overlap(bw, cw)
    glued_b, glued_c = "".join(bw), "".join(cw)
    if pa < 0.99 or pb < 0.99:
        if glued_b == glued_c or abs(len(glued_b) - len(glued_c)) <= 1 and one_slip(glued_b, glued_c):
            pa = pb = 1.0
    content_b, content_c = [w for w in bw if w not in _STOP], [w for w in cw if w not in _STOP]
    ca_, cb_ = _soft_overlap(content_b, content_c)
    title = 0.5 * max(ca_, cb_) + 0.3 * min(pa, pb) + 0.2 * max(pa, pb)
    if pa >= 0.99 and pb >= 0.99:
        title = 1.0
    elif not (max(pa, pb) >= 0.8 and min(pa, pb) >= 0.3):
        return 0.0
    if people is None:
        return 0.0 if title < 0.85 or gap is not None and gap > 2 else 0.55 * title + 0.2 * when + 0.05
    if people < 0.5 or (people < 0.99 and min(len(bpeople), len(cpeople)) < 3 and title < 0.9):
        return 0.0
    if gap is not None and gap > 2 and (title < 0.95 or people < 0.99):
        return 0.0
    return 0.5 * title + 0.35 * people + 0.15 * when


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(bib_no, cand_id, base, gap, people) of pairs that may be one work; `people`: the pairs of author spellings that it equates."""
    person = lru_cache(100_000)(_person)
    for d in batches:
        rows = []
        for i, j, bw, bk, ba, by, cw, ck, ca, cy in zip(d["bib_no"], d["cand_id"], d["bw"], d["bk"], d["ba"], d["by"], d["cw"], d["ck"], d["ca"], d["cy"]):
            by, cy = (None if y is None or y != y else int(y) for y in (by, cy))
            bp, cp = [person(p) for p in ba], [person(p) for p in ca]
            base = compare_parsed(list(bw), bk, bp, by, list(cw), ck, cp, cy)
            if base > 0:
                equal = sorted({f"{x}\u001f{y}" for x, p in zip(ba, bp) for y, q in zip(ca, cp) if _one_person(p, q)})
                rows.append((i, j, base, 5 if by is None or cy is None else abs(by - cy), equal))
        out = pd.DataFrame(rows, columns=["bib_no", "cand_id", "base", "gap", "people"])
        yield out.astype({"bib_no": d["bib_no"].dtype, "cand_id": d["cand_id"].dtype, "base": "float64", "gap": "int32"})


def _parsed(records: DataFrame, record_id: str, near: int) -> DataFrame:
    schema = f"{record_id} {dict(records.dtypes)[record_id]}, words array<string>, follows string, people array<string>, y int, attributes array<string>, keys array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = pd.DataFrame([parse_work(t, a, y, near) for t, a, y in zip(d["title"], d["authors"], d["year"])], columns=["words", "follows", "people", "y", "attributes", "keys"])
            out["y"] = out["y"].astype("Int32")
            out.insert(0, record_id, d[record_id].to_numpy())
            yield out

    return records.mapInPandas(run, schema)


def _met(bibs: DataFrame, cands: DataFrame, n_cands: int, common: int) -> DataFrame:
    """(bib_no, cand_id, w) that share a key which at most `common` candidates have, or that common keys lead to; w: the sum of what these keys weigh by their rarity.

    A key that more candidates have is joined by each further attribute of its record, and so on, until it is rare or
    the record has no attribute left; no pair that agrees in more than one common key alone is lost on the way.
    """
    kb, kc = keep(bibs.select("bib_no", F.explode("keys").alias("k")), "bibkeys"), keep(cands.select("cand_id", F.explode("keys").alias("k")), "candkeys")
    parts = F.split("k", "\x1f")
    rest = F.array_except("attributes", parts)
    weight = F.log(F.lit(1.0 + n_cands) / F.col("n"))
    out = []
    while True:
        n = keep(kc.groupBy("k").agg(F.count("*").alias("n")).join(kb.select("k").distinct(), "k"), "keys")
        pairs = kb.join(n.filter(F.col("n") <= common), "k").join(kc, "k").groupBy("bib_no", "cand_id").agg(F.sum(weight).alias("w"))
        often = n.filter(F.col("n") > common)
        if often.isEmpty():
            out.append(keep(pairs, "pairs"))
            break
        b = kb.join(often, "k").join(bibs.select("bib_no", "attributes"), "bib_no").withColumn("rest", rest)
        c = kc.join(often, "k").join(cands.select("cand_id", "attributes"), "cand_id").withColumn("rest", rest)
        # nothing is left to tell such a record by: it meets those of the same key that are as bare
        bare = b.filter(F.size("rest") == 0).select("k", "n", "bib_no").join(c.filter(F.size("rest") == 0).select("k", "cand_id"), "k").select("bib_no", "cand_id", weight.alias("w"))
        out.append(keep(pairs.unionByName(bare), "pairs"))
        longer = F.array_join(F.array_sort(F.concat(parts, F.array("more"))), "\x1f")
        grow = lambda d, i: d.select(i, "k", F.explode("rest").alias("more")).select(i, longer.alias("k")).distinct()
        next_b, next_c = keep(grow(b, "bib_no"), "bibkeys"), keep(grow(c, "cand_id"), "candkeys")
        for d in (kb, kc, n):
            drop_kept(d)
        kb, kc = next_b, next_c
    met = keep(reduce(DataFrame.unionByName, out).groupBy("bib_no", "cand_id").agg(F.sum("w").alias("w")), "met")
    for d in (kb, kc, n, *out):
        drop_kept(d)
    return met


def link_works(pairs: DataFrame, common: int = 16, lasting: float = 0.3, accept: float = 0.6) -> DataFrame:
    """(bib_no, cand_id, confidence): the candidate each bibliography record is, where there is one.

    Every record and every candidate that occurs in `pairs` takes part, in whatever rows; several rows of one are
    one, with its smallest title, authors and year. Records meet over all their keys (word pairs, authors with words
    and with years, pairs of authors); keys that more than `common` candidates have meet with a further attribute. Edges weigh what
    the keys they share do by their rarity; those under `lasting` of the best weight at both their ends are
    pruned. Scores are refined until no edge moves any more. Null ids are nobody; null and blank fields match
    nothing. Ties go to the nearer year, then to the smaller cand_id.
    """
    one = lambda c: F.min(c)
    bibs = pairs.filter("bib_no is not null").groupBy("bib_no").agg(one("bib_title").alias("title"), one("bib_authors").alias("authors"), one("bib_year").alias("year"))
    cands = pairs.filter("cand_id is not null").groupBy("cand_id").agg(one("cand_title").alias("title"), one("cand_authors").alias("authors"), one("cand_year").alias("year"))
    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bibs, cands = keep(_parsed(bibs.repartition(parts, "bib_no"), "bib_no", 2), "bibs"), keep(_parsed(cands.repartition(parts, "cand_id"), "cand_id", 0), "cands")
    met = _met(bibs, cands, cands.count(), common)
    top_b = met.groupBy("bib_no").agg(F.max("w").alias("wb"))
    top_c = met.groupBy("cand_id").agg(F.max("w").alias("wc"))
    pruned = met.join(top_b, "bib_no").join(top_c, "cand_id").filter((F.col("w") >= lasting * F.col("wb")) | (F.col("w") >= lasting * F.col("wc"))).select("bib_no", "cand_id")
    b = bibs.select("bib_no", F.col("words").alias("bw"), F.col("follows").alias("bk"), F.col("people").alias("ba"), F.col("y").alias("by"))
    c = cands.select("cand_id", F.col("words").alias("cw"), F.col("follows").alias("ck"), F.col("people").alias("ca"), F.col("y").alias("cy"))
    full = keep(pruned, "pruned").join(b, "bib_no").join(c, "cand_id")
    types = f"bib_no {dict(pairs.dtypes)['bib_no']}, cand_id {dict(pairs.dtypes)['cand_id']}"
    found = keep(full.repartition(parts).mapInPandas(_judged, f"{types}, base double, gap int, people array<string>"), "found")
    ties = keep(found.select("bib_no", "cand_id", F.explode("people").alias("p")), "ties")
    score = found.select("bib_no", "cand_id", "base", "gap", F.col("base").alias("s"), F.lit(False).alias("beaten"))
    while True:
        best = score.groupBy("bib_no").agg(F.max("s").alias("best"))
        # what other edges say of the same pairs of authors, this edge's own word left out
        said = ties.join(score.select("bib_no", "cand_id", "s"), ["bib_no", "cand_id"])
        total = said.groupBy("p").agg(F.sum("s").alias("total"))
        near = said.join(total, "p").groupBy("bib_no", "cand_id").agg(F.avg((F.col("total") - F.col("s")) / (1 + F.col("total") - F.col("s"))).alias("near"))
        new = score.join(best, "bib_no").join(near, ["bib_no", "cand_id"], "left")
        # an edge once beaten stays so: with each round fewer can change, so the rounds end
        beaten = F.col("beaten") | (F.col("s") < 0.98 * F.col("best"))
        value = F.least(F.lit(1.0), F.col("base") * F.when(beaten, 0.8).otherwise(1.0) + 0.08 * F.coalesce("near", F.lit(0.0)) * F.col("base"))
        new = keep(new.select("bib_no", "cand_id", "base", "gap", value.alias("s"), beaten.alias("beaten"), ((beaten != F.col("beaten")) | (F.abs(value - F.col("s")) >= 0.005)).alias("moved")), "scores")
        moved = not new.filter("moved").isEmpty()
        if "moved" in score.columns:
            drop_kept(score)
        score = new
        if not moved:
            break
    first = score.groupBy("bib_no").agg(F.min(F.struct((-F.col("s")).alias("s"), "gap", "cand_id")).alias("f"))
    return first.select("bib_no", F.col("f.cand_id").alias("cand_id"), F.round(-F.col("f.s"), 4).alias("confidence")).filter(F.col("confidence") >= accept)
