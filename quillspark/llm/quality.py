"""Per-document text statistics, and learned rules that tell prose from lists, tables and junk.

The statistics are built-in expressions. An ordered rule list is induced from labelled documents by incremental
reduced-error pruning: conditions are added by information gain on two thirds of the rows, the rule is pruned on the
last third, and what it covers is set aside. The thresholds are written out as one SQL CASE expression, which Spark
applies to all documents.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.session import spread

#: Labelled documents to learn from, at most; they are made by a rule, see labelled_documents().
LABELLED = 3600

END = r"[.!?。！？।؟…]"
_WIDE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\u30fc"
#: A word: a run of letters, marks and digits, or one character of a script without spaces.
WORD = rf"[{_WIDE}&&[\p{{L}}\p{{M}}\p{{N}}]]|[\p{{L}}\p{{M}}\p{{N}}&&[^{_WIDE}]]+"


def _count(pattern: str) -> Column:
    """Matches of a pattern that starts where few do; its matches are counted, not kept."""
    return F.regexp_count("t", F.lit(pattern)).cast("double")


def _kept(drop: str) -> Column:
    return F.length(F.regexp_replace("t", drop, "")).cast("double")


def _times(what: str) -> Column:
    """How often a fixed string occurs: by plain replacement, which is far cheaper than a pattern."""
    return ((F.col("chars") - F.length(F.replace(F.col("t"), F.lit(what), F.lit("")))) / len(what)).cast("double")


def statistics(df: DataFrame, row_id: str, text: str, common: DataFrame | None = None) -> DataFrame:
    """One row per document with a text that is not blank: counts and shares, each a double.

    words (runs of letters, marks and digits; each character of a script without spaces is one), mean_word (letters,
    marks and digits a word), lines, line_len, symbols, digits, upper (capitals among the letters), ends (lines ending in punctuation), marks (sentence ends a
    word), starts (lines that begin like list items), cells (separators a line, of the kind that is most frequent:
    tabs, bars, ampersands, gaps, commas without a space), bars (share of lines with two or more separators), short (lines up to 60 characters), long (share of
    characters in longer lines that hold no separator), commas, rich (distinct words by the root of all),
    distinct_lines, odd (broken encodings and glyph codes), hex (machine words), tex (command lines), leaders (lines
    that end in a number), common (share of common words). Null and blank texts have no row. `common` holds the
    frequent words (lang, word); it is small and fixed. Those that end in _rule are cheaper stand-ins for the rules only:
    words by white space and bytes, word length over all characters, ASCII digits, rates by such words. The columns are separate expressions: those not asked for
    cost nothing.
    """
    words = sorted({r["word"].lower() for r in common.select("word").distinct().collect() if r["word"]}) if common is not None else []
    clean = F.trim(F.replace(F.replace(F.replace(F.col("_text"), F.lit("\r"), F.lit("\n")), F.lit("\n\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n")), F.lit(" \n\t"))
    d = spread(df.select(F.col(row_id).alias("id"), F.col(text).alias("_text")), "id").filter(F.col("_text").rlike(r"\S")).select("id", clean.alias("t"))
    d = d.withColumns({"chars": F.length("t").cast("double"), "bytes": F.octet_length("t").cast("double"), "w": F.split("t", r"\s+"), "l": F.split("t", "\n")})
    n_words = _count(WORD)
    by_bytes = F.size("w").cast("double") + (F.col("bytes") - F.col("chars")) / 8
    a_word = lambda x: F.coalesce(F.try_divide(x, n_words), F.lit(0.0))
    marks = _count(rf"{END}[\"'”’»」』)\]]*(?:\s|$)|[。！？]")
    commas = _times(", ") + _times("，") + _times("、")
    odd = _times("(cid:") + _times(" ? ") + _count(r"[ÃÂÄÅá�][\u0080-¿º»]")
    hexes = _count(r"\b(?=[a-z]*\d)(?=\d*[a-z])[0-9a-z]{9,}\b")
    lines = F.size("l").cast("double")
    spaced = F.size("w").cast("double")
    listed = F.array(*[F.lit(x) for x in words]) if words else None
    known = F.size(F.filter("w", lambda x: F.array_contains(listed, F.regexp_replace(F.lower(x), r"[^\p{L}\p{M}']+", "")))) if words else F.lit(0)
    return d.select(
        "id",
        n_words.alias("words"),
        a_word(_kept(r"[^\p{L}\p{M}\p{N}]+")).alias("mean_word"),
        (F.col("chars") / by_bytes).alias("mean_word_rule"),
        lines.alias("lines"),
        (F.col("chars") / lines).alias("line_len"),
        (_kept(r"[\p{L}\p{M}\p{N}\s]+") / F.col("chars")).alias("symbols"),
        (_kept(r"[^\p{Nd}]+") / F.col("chars")).alias("digits"),
        (_kept("[^0-9]+") / F.col("chars")).alias("digits_rule"),
        F.coalesce(F.try_divide(_kept(r"[^\p{Lu}]+"), _kept(r"[^\p{L}\p{M}]+")), F.lit(0.0)).alias("upper"),
        (_count(rf"{END}[\"'”’»」』)\]]*[ \t]*(?:\n|$)") / lines).alias("ends"),
        a_word(marks).alias("marks"),
        (marks / by_bytes).alias("marks_rule"),
        (_count(r"(?m)^[ \t]*(?:[-*•‣◦▪–]|\\item|\(?\d{1,3}[.)\]]|\[\d{1,4}\]|\d{1,2}(?:\.\d{1,3})+)[ \t]") / lines).alias("starts"),
        (F.greatest(_times("\t"), _times("|"), _times("&"), _times("  ") / 2, _times(",") - _times(", ")) / lines).alias("cells"),
        (_count(r"(?m)^(?:[^\t\n]*\t[^\n]*|[^|\n]*\|[^|\n]*\|[^\n]*|[^&\n]*&[^&\n]*&[^\n]*|[^\n]*\S {2,}\S+ {2,}\S[^\n]*|[^,\s]*,[^,\s]*,[^\s]*)$") / lines).alias("bars"),
        (_count(r"(?m)^[^\n]{0,60}$") / lines).alias("short"),
        (_kept(r"(?m)^(?:[^\n]{0,60}|[^\n\t|]{0,60}[\t|][^\n]*)$") / F.col("chars")).alias("long"),
        a_word(commas).alias("commas"),
        (commas / by_bytes).alias("commas_rule"),
        F.when(F.col("chars") > 25 * spaced, F.size(F.array_distinct(F.split("t", ""))) / F.sqrt(F.col("chars") / 2)).otherwise(F.size(F.array_distinct("w")) / F.sqrt(spaced)).alias("rich"),
        (F.size(F.array_distinct("l")) / lines).alias("distinct_lines"),
        a_word(odd).alias("odd"),
        (odd / by_bytes).alias("odd_rule"),
        a_word(hexes).alias("hex"),
        (hexes / by_bytes).alias("hex_rule"),
        (_count(r"(?m)^\s*(?:\\[A-Za-z@]+(?:\s+\S+){0,3}(?:\\[A-Za-z]+)?|\W{2,8})\s*$") / lines).alias("tex"),
        (_count(r"(?m)\d$") / lines).alias("leaders"),
        (known / spaced).alias("common"),
    )


FEATURES = ["words", "mean_word", "lines", "line_len", "symbols", "digits", "upper", "ends", "marks", "starts", "cells", "bars", "short", "long", "commas", "rich", "distinct_lines", "odd", "hex", "tex", "leaders", "common"]
#: What rules may be learned from: statistics that hang on length or language alone would only fit the labelled documents.
RULE_ONLY = ("mean_word", "digits", "marks", "commas", "odd", "hex")
LEARNED = [f"{f}_rule" if f in RULE_ONLY else f for f in FEATURES if f not in ("words", "upper", "bars", "common")]
KINDS = ("junk", "table", "list")


@lru_cache(4)
def labelled_documents(n: int = LABELLED, seed: int = 7) -> tuple[tuple[str, str], ...]:
    """(kind, text) of n documents made by a seeded rule: prose in several languages and layouts, also with a short list or table in it, and lists, tables and junk of the usual sorts."""
    r = random.Random(seed)
    syl = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4))) + r.choice(["", "", "n", "s", "r"])
    pool = [word() for _ in range(600)]
    tongues = [
        ("the a of in with for and to on that this each our is was by from", ""), ("der die das und in mit von den im ist nicht", ""), ("le la les de des et dans en pour sur", ""),
        ("el la los de y en con para por que", ""), ("и в на не что это для по", "абдефгиклмнопрстувз"), ("và của trong là một các cho với", ""), ("في من على هذا", "ابدهفجيكلمنوبرستوفز"), ("में का है से", "अबदएफगइकलमनओपरसतउवज"),
    ]
    latin = "abdefgiklmnoprstuvz"
    han = [chr(0x4E00 + 7 * i) for i in range(400)]
    thai = [chr(0x0E01 + i) for i in range(40)]
    nouns, verbs, adjs = pool[:300], pool[300:400], pool[400:]
    doc: dict = {}

    def new_document() -> None:
        """Each document has its own few words, its language and how often it uses function words: what is said of texts in general must not hang on these."""
        k = r.choice([6, 12, 25, 60, 200])
        doc["n"], doc["v"], doc["a"] = r.sample(pool, k), r.sample(pool, max(3, k // 3)), r.sample(pool, max(3, k // 2))
        lex, script = tongues[0] if r.random() < 0.6 else r.choice(tongues)
        doc["f"], doc["script"] = lex.split(), script
        doc["p"] = r.choice([0.0, 0.1, 0.3, 0.6, 0.9])
        doc["wide"] = r.random() < 0.15
        doc["max"] = r.choice([3, 5, 8])
        if r.random() < 0.15:
            doc["n"] = [w.capitalize() for w in doc["n"]]

    def sentence() -> str:
        if doc["wide"]:
            s = "".join(r.choice(han[:40] if r.random() < 0.7 else han) for _ in range(r.randint(6, 26)))
            if r.random() < 0.2:
                s = r.choice([f"「{s}。」{s[:4]}{r.randint(1, 99)}{s[4:9]}", f"“{s}？”{s[:6]}"])
            return s + (f"（{r.randint(1, 99)}.{r.randint(0, 9)}）" if r.random() < 0.45 else "") + r.choice("。。。。！？")
        out = []
        for _ in range(r.randint(2, doc["max"])):
            if r.random() < doc["p"]:
                out.append(r.choice(doc["f"]))
            out += [r.choice(doc["a"]), r.choice(doc["n"])] if r.random() < 0.5 else [r.choice(doc["n"]), r.choice(doc["v"])]
            if r.random() < 0.15:
                out[-1] += ","
            if r.random() < 0.12:
                out.append(f"{r.randint(1, 99)}" + r.choice(["", "%", ".5", ",307"]))
        s = " ".join(out)
        if doc["script"]:
            s = s.translate(str.maketrans(latin, doc["script"]))
        if r.random() < 0.12:
            s = f"{s[: len(s) // 2]} {r.choice(['(see Fig. 3)', 'e.g. Table 1', 'at 9.30 a.m.', 'z. B. Nr. 7', 'cf. Sec. 2.4', '$x_2 < 3$', '(12.8)'])} {s[len(s) // 2 :]}"
        s = s[0].upper() + s[1:] + r.choices([".", "?", "!", "…", "。" if doc["script"] == "" else "."], [88, 4, 3, 4, 1])[0]
        if r.random() < 0.05:
            s = s[:-1] + r.choice([" ?", " !", " ?"])
        return f'"{s}"' if r.random() < 0.04 else s

    def thai_text(k: int) -> str:
        return " ".join("".join(r.choice(thai) for _ in range(r.randint(15, 40))) for _ in range(k))

    def title() -> str:
        return f"{r.choice(adjs)} {r.choice(nouns)}".capitalize()

    def paragraphs(k: int) -> str:
        mode = r.random()
        if mode < 0.03:
            return thai_text(r.randint(1, 12))
        joint = r.choice(["\n\n", "\n\n", "\n"])
        wraps, gap = r.random() < 0.3, r.choice([" "] * 7 + ["  "])
        out = []
        for _ in range(k):
            if mode < 0.1:
                p = "".join("".join(r.choice(han) for _ in range(r.randint(8, 26))) + "。" for _ in range(r.randint(1, 6)))
            else:
                p = gap.join(sentence() for _ in range(r.randint(1, 7)))
            if wraps:
                width, line, wrapped = r.randint(38, 80), "", []
                for w in p.split(" "):
                    if len(line) + len(w) > width:
                        wrapped.append(line)
                        line = w
                    else:
                        line = f"{line} {w}".strip()
                p = "\n".join([*wrapped, line])
            out.append(p)
        if len(out) > 2 and r.random() < 0.25:
            out += r.sample(out, r.randint(1, 2))  # prose repeats itself too
        return joint.join(out)

    cell = lambda: r.choice([str(r.randint(1, 99)), str(r.randint(1000, 99999)), f"{r.randint(10, 99)},{r.randint(100, 999)}", f"{r.randint(0, 99)}.{r.randint(0, 99)}", f"{r.randint(1, 99)},{r.randint(100, 999)}", f"{r.randint(1, 99)}%", "n/a", "-", "", r.choice(adjs)])

    def table(rows: int, cols: int) -> str:
        grid = [[r.choice(nouns) for _ in range(cols)]] + [[r.choice(nouns), *(cell() for _ in range(cols - 1))] for _ in range(rows)]
        style = r.randint(0, 5)
        if style == 0:
            return "\n".join("\t".join(x) for x in grid)
        if style == 1:
            return "\n".join(["| " + " | ".join(grid[0]) + " |", "|" + "---|" * cols, *("| " + " | ".join(x) + " |" for x in grid[1:])])
        if style == 2:
            return "\n".join(",".join(y.replace(",", "") for y in x) for x in grid)
        if style == 3:
            return "\\begin{tabular}{" + "l" + "r" * (cols - 1) + "}\n" + "\n".join(" & ".join(x).replace("%", "\\%") + " \\\\" for x in grid) + "\n\\end{tabular}"
        if style == 4:
            return "\n".join("".join(y.ljust(r.choice([14, 14, 14]) if c < cols - 1 else 0) for c, y in enumerate(x)) for x in grid)
        return "<table>" + "\n".join("<tr>" + "".join(f"<td>{y}</td>" for y in x) + "</tr>" for x in grid) + "</table>"

    def items(k: int) -> str:
        style = r.randint(0, 8)
        nouns, adjs = doc["n"], doc["a"]
        if style == 0:
            return "\n".join(f"{r.choice('-*')} {r.choice(adjs)} {r.choice(nouns)}" for _ in range(k))
        if style == 1:
            return "\n".join(f"• {r.choice(nouns)} {r.choice(nouns)}; {r.choice(nouns)}" for _ in range(k))
        if style == 2:
            return "\n".join(f"{i}. {title()} {r.choice(['for', 'of'])} {r.choice(nouns)}" for i in range(1, k + 1))
        if style == 3:
            return "\n".join(f"[{i}] {r.choice('ABCDEFG')}. {word().capitalize()}. {' '.join(title() for _ in range(r.randint(1, 6)))} of {r.choice(nouns)}, {r.randint(1980, 2024)}." for i in range(1, k + 1))
        if style == 4:
            return "\n".join(f"{title()} {'.' * r.randint(8, 40)} {i * 3}" for i in range(1, k + 1))
        if style == 5:
            return "\n".join(f"{'  ' * (i % 3)}{i // 3 + 1}.{i % 3 + 1} {title()}" for i in range(k))
        if style == 6:
            return "\n".join(f"{r.choice(nouns)}, {r.randint(1, 200)}, {r.randint(200, 400)}" if r.random() < 0.5 else f"{r.choice(adjs)} {r.choice(nouns)}" for _ in range(k))
        if style == 7:
            return "\n".join(f"\\item {title()} {r.choice(nouns)}" for _ in range(k))
        return "\n".join(f"{r.choice(nouns)}: {r.choice(adjs)} {r.choice(nouns)}" for _ in range(k))

    def junk(k: int) -> str:
        style = r.randint(0, 9)
        if style == 9:
            few = r.sample("abcdefghilmnoprstuv", 10) + [" "] * r.randint(2, 7) + ["."]
            return "".join(r.choice(few) for _ in range(10 * k))
        if style == 0:
            return " ".join("".join(r.choice("0123456789abcdef") for _ in range(12)) for _ in range(k))
        if style == 1:
            return "".join(r.choice(["(cid:%d)" % r.randint(1, 90), "(cid:%d)" % r.randint(1, 90), "a", "b", "x", " ", "\n"]) for _ in range(4 * k))
        if style == 2:
            return "".join(r.choice("!#$%&()*+-/:;<=>?@[]^_{|}~ ") for _ in range(10 * k))
        if style == 3:
            p = " ".join(sentence() for _ in range(3 + k // 8))
            return " ? ".join(p.replace("a", "á").replace("o", "ö").encode().decode("latin-1").split(" "))
        if style == 4:
            return "\n".join(r.choice(["Home", "Log in", "Menu", "404", "PDF", "Share | Print", "Next page >>", "Loading...", "Back to top", "Cookie settings", "Sign up", "Search", "Previous", "Subscribe now"]) for _ in range(k))
        if style == 5:
            p = " ".join(r.choice(nouns) for _ in range(r.randint(1, 3)))
            return r.choice([" ", " ", "\n"]).join([p] * k)
        if style == 6:
            return "\n".join(r.choice(["%%%%%%", "\\relax", "&&&", "}}{", "$$$", "\\hbox to 3pt", "\\csname x\\endcsname", "\\@ifnextchar"]) for _ in range(k))
        if style == 7:
            return ", ".join(f"{r.choice(adjs)} {r.choice(nouns)}" for _ in range(k))
        s = sentence()
        return " ".join([s] * k)

    out = []
    for i in range(n):
        kind = ("prose", "list", "table", "junk", "prose", "prose")[i % 6]
        new_document()
        head = r.choice(["", "", title() + "\n\n", title() + "\n", title() + ":\n"])
        if kind == "prose":
            text = paragraphs(r.choice([1, 1, 1, 2, 3, 5, 8]))
            if r.random() < 0.3:
                insert = table(r.randint(2, 4), r.randint(2, 4)) if r.random() < 0.5 else items(r.randint(2, 5))
                lead = " ".join(sentence() for _ in range(r.randint(4, 8)))
                text = r.choice([f"{lead}\n\n{insert}\n\n{text}", f"{lead} {text}\n\n{insert}"])
            if r.random() < 0.1:
                text = f"<p>{text}</p>"
        elif kind == "list":
            text = items(r.choice([r.randint(4, 10), r.randint(8, 40)]))
        elif kind == "table":
            text = table(r.randint(4, 30), r.randint(3, 7))
        else:
            text = junk(r.choice([r.randint(4, 10), r.randint(8, 60)]))
        out.append((kind, head + text))
    return tuple(out)


Rule = tuple[str, tuple[tuple[str, str, float], ...]]


def _covers(x: dict[str, np.ndarray], conditions, n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for f, op, v in conditions:
        hit &= x[f] <= v if op == "<=" else x[f] >= v
    return hit


def induce_rules(x: dict[str, np.ndarray], y: np.ndarray, kinds: tuple[str, ...] = KINDS, seed: int = 1) -> list[Rule]:
    """Ordered rules (kind, conditions); what none covers is the default. Each kind is learned against all kinds after it."""
    rng = np.random.default_rng(seed)
    names = sorted(x)
    live = np.ones(len(y), bool)
    rules: list[Rule] = []
    for kind in kinds:
        while (live & (y == kind)).any():
            at = np.flatnonzero(live)
            at = at[rng.permutation(len(at))]
            cut = 2 * len(at) // 3
            grow, prune = at[:cut], at[cut:]
            gx = {f: x[f][grow] for f in names}
            good = y[grow] == kind
            hit = np.ones(len(grow), bool)
            conditions: list[tuple[str, str, float]] = []
            while (hit & ~good).any() and (hit & good).any() and len(conditions) < 6:
                p0, n0 = (hit & good).sum(), (hit & ~good).sum()
                base = np.log2(p0 / (p0 + n0))
                best = (1e-9, None)
                for f in names:
                    v = gx[f][hit]
                    g = good[hit]
                    order = np.argsort(v, kind="stable")
                    v, g = v[order], g[order]
                    p, n = np.cumsum(g), np.cumsum(~g)
                    ends = np.flatnonzero(np.r_[v[1:] != v[:-1], False])
                    if not len(ends):
                        continue
                    middle = (v[ends] + v[ends + 1]) / 2
                    for op, pp, nn in (("<=", p[ends], n[ends]), (">=", p[-1] - p[ends], n[-1] - n[ends])):
                        with np.errstate(divide="ignore", invalid="ignore"):
                            gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1)
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], (f, op, float(middle[k])))
                if best[1] is None:
                    break
                conditions.append(best[1])
                hit &= _covers(gx, conditions[-1:], len(grow))
            px = {f: x[f][prune] for f in names}
            good_p = y[prune] == kind

            def worth(c) -> float:
                h = _covers(px, c, len(prune))
                p, n = (h & good_p).sum(), (h & ~good_p).sum()
                return (p - n) / (p + n) if p + n else -1.0

            while len(conditions) > 1 and max(worth(conditions[:k]) for k in range(1, len(conditions))) >= worth(conditions):
                conditions = conditions[: max(range(1, len(conditions)), key=lambda k: (worth(conditions[:k]), -k))]
            if not conditions or worth(conditions) <= 0.4:
                break
            covered = live & _covers(x, conditions, len(y))
            if not (covered & (y == kind)).any():
                break
            rules.append((kind, tuple(conditions)))
            live &= ~covered
    return rules


def rules_sql(rules: list[Rule], default: str = "prose") -> str:
    """The rule list as one CASE expression over the statistics."""
    when = " ".join("WHEN " + " AND ".join(f"{f} {op} {v!r}D" for f, op, v in c) + f" THEN '{kind}'" for kind, c in rules)
    return f"CASE {when} ELSE '{default}' END" if rules else f"'{default}'"


def predict(rules: list[Rule], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.full(n, "prose", object)
    for kind, c in reversed(rules):
        out[_covers(x, c, n)] = kind
    return out


def learn(spark: SparkSession, n: int = LABELLED, tries: int = 8) -> list[Rule]:
    """Rules from n labelled documents, whose statistics come to the driver.

    A third of the documents is held out. Pruning hangs on how the rows happen to be cut, so the rules are induced
    for several cuts, and those that do best on the held-out documents are kept.
    """
    docs = labelled_documents(n)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "id bigint, text string").repartition(8)
    got = statistics(df, "id", "text").select("id", *LEARNED).toPandas().sort_values("id")
    y = np.array([docs[i][0] for i in got["id"]])
    held = (got["id"].to_numpy() // 6) % 3 == 0  # kinds go round in sixes
    x = {f: got[f].to_numpy(float) for f in LEARNED}
    on, off = ({f: v[m] for f, v in x.items()} for m in (~held, held))
    made = [induce_rules(on, y[~held], seed=seed) for seed in range(tries)]
    return max(made, key=lambda r: (predict(r, off, int(held.sum())) == y[held]).mean())


def classify(df: DataFrame, row_id: str, text: str, common: DataFrame | None = None, rules: list[Rule] | None = None, with_statistics: bool = False) -> DataFrame:
    """(row_id, kind) of every document whose text is not null or blank, and the statistics on request; kind is prose, list, table or junk.

    The statistics pass through a generator of one row: without it the optimiser would write each statistic's
    expression wherever the CASE names it, and compute it as often.
    """
    rules = learn(df.sparkSession) if rules is None else rules
    names = [*FEATURES, *(f"{f}_rule" for f in RULE_ONLY)] if with_statistics else sorted({f for _, c in rules for f, _, _ in c}) or ["lines"]
    s = statistics(df, row_id, text, common if "common" in names else None)
    one = s.select("id", F.explode(F.array(F.struct(*names))).alias("s")).select("id", "s.*")
    return one.select(F.col("id").alias(row_id), F.expr(rules_sql(rules)).alias("kind"), *(FEATURES if with_statistics else []))
