"""Variant spellings of people's and groups' names.

Names are parsed to a signature (family name, given names), however they are ordered, cut or decorated; spellings
with one signature are linked at once. Signatures are blocked by phonetic codes of the sorted tokens of the family name
(less any one letter, so that one typing error still meets) and by the forms of the given name, compared by
Jaro-Winkler with a table of short names, and the accepted pairs are clustered by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.splits import boruvka
from quillspark.session import keep

# Short names by the names they stand for.
NICKNAMES: dict[str, str] = {
    "alexander": "alex sasha xander al", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "charles": "charlie chuck chas", "christopher": "chris kit", "daniel": "dan danny",
    "edward": "ed eddie ted ned", "elizabeth": "liz beth lizzie betty eliza lisa", "francesca": "fran francie", "francis": "frank fran", "frederick": "fred freddy freddie", "gregory": "greg", "james": "jim jimmy jamie",
    "jennifer": "jen jenny", "jonathan": "jon jonny", "john": "jack johnny", "joseph": "joe joey jo", "katherine": "kate kathy katie kat", "catherine": "cate cathy", "lawrence": "larry", "margaret": "maggie meg peggy marge greta", "matthew": "matt",
    "michael": "mike mick mikey", "nicholas": "nick nicky", "patricia": "pat patty trish", "patrick": "pat paddy", "peter": "pete", "philippa": "pippa", "rebecca": "becky becca", "richard": "rick dick rich", "robert": "bob rob bobby",
    "samuel": "sam sammy", "stephen": "steve", "steven": "steve", "stefan": "stef", "susanna": "sue susie suzy", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky tori vic", "viktor": "vik", "william": "bill will billy liam", "rafael": "rafa", "dmitri": "dima", "zainab": "zai", "alexandra": "alex sandra", "barbara": "barb", "deborah": "deb debbie", "donald": "don", "kenneth": "ken", "leonard": "len leo", "raymond": "ray", "ronald": "ron", "vincent": "vince", "walter": "walt", "jacob": "jake", "joshua": "josh", "nathaniel": "nate", "zachary": "zach", "abigail": "abby", "christina": "tina", "jessica": "jess", "natalie": "nat", "pamela": "pam", "sandra": "sandy", "teresa": "terry",
}
_FORMAL: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _FORMAL.setdefault(_s, set()).add(_full)
# Particles of family names, words of groups, and what stands for unnamed authors.
PARTICLES = frozenset("van von de der den del della di da dos du la le el al bin ibn ten ter zu st".split())
GROUPS = {"collaboration": "collaboration", "collab": "collaboration", "consortium": "consortium", "consort": "consortium", "group": "group", "working group": "group", "wg": "group", "team": "team", "project": "project", "network": "network", "society": "society", "committee": "committee", "initiative": "initiative", "alliance": "alliance", "task force": "task force"}
NOBODY = regex.compile(r"(?i)^[\W_]*(?:(?:and|und|et|y|и)\s+)?(?:et\.?\s*al|others?|u\.?\s*a|others? et al|anonymous|n\.?\s*n)\.?[\W_]*$")
_SUFFIX = regex.compile(r"(?i)(?:,\s*|\s+)(?:jr|sr|ii|iii|iv|phd|ph\.d|md|m\.d)\.?$")
_TITLE = regex.compile(r"(?i)^(?:dr|prof|mr|mrs|ms|sir)\.\s+")

_LATEX = regex.compile(r"\{?\\([`'^\"~=.uvHcrkbd])\s*\{?\\?([A-Za-z])\}?\}?")
_ACCENTS = {"`": "̀", "'": "́", "^": "̂", "~": "̃", '"': "̈", "=": "̄", ".": "̇"}


def fold(s: str) -> str:
    """Lower case without accents, LaTeX braces and doubled spaces."""
    s = _LATEX.sub(lambda m: m[2], s).replace("{", "").replace("}", "")
    s = s.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("đ", "d").replace("æ", "ae").replace("ı", "i")
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return regex.sub(r"\s+", " ", s).strip()


def parse(name: str) -> dict | None:
    """Parts of one name: kind `group`, `sure` (it is plain which part is the family name) or `open`; None if it names nobody.

    `open` names are two or more written-out words without a comma; whether the first or the last is the family
    name is settled by how the words are used elsewhere.
    """
    if NOBODY.match(name):
        return None
    s = _SUFFIX.sub("", _TITLE.sub("", fold(name).strip(" ;,")))
    s = s.strip(" ;,")
    if not regex.search(r"\p{L}", s):
        return None
    low = regex.sub(r"[^\p{L}\p{N}\s]", " ", s.lower()).split()
    if low and low[0] == "the":
        low = low[1:]
    text = " ".join(low)
    for word, kind in sorted(GROUPS.items(), key=lambda x: -len(x[0])):
        if regex.search(rf"\b{word}\b", text) and len(low) > len(word.split()):
            rest = regex.sub(rf"\b{word}\b", " ", text).split()
            rest = [w for w in rest if w not in ("for", "of", "on", "the")]
            if rest:
                return {"kind": "group", "family": " ".join(sorted(rest)), "given": [kind]}

    def words(part: str) -> list[str]:
        return [w for w in regex.split(r"[\s.\-–‐]+", part) if regex.search(r"\p{L}", w)]

    def given(parts: list[str]) -> list[str]:
        out = []
        for w in parts:
            w = regex.sub(r"[^\p{L}]", "", w)
            if 1 < len(w) <= 3 and (w.isupper() or _initials(w)):
                out += list(w.lower())
            elif w:
                out.append(w.lower())
        return out

    clean = lambda ws: [regex.sub(r"[^\p{L}'’]", "", w).lower().replace("’", "'") for w in ws]
    if "," in s:
        left, _, right = s.partition(",")
        fam = [w for w in clean(left.split()) if w not in PARTICLES]
        gv = given([w for w in words(right) if w.lower() not in PARTICLES])
        if fam:
            return {"kind": "sure", "family": " ".join(fam), "given": gv}
    parts = [p for p in s.split() if regex.search(r"\p{L}", p)]
    core = [p for p in parts if p.lower().strip(".") not in PARTICLES or len(parts) == 1]
    if not core:
        core = parts
    if len(core) == 1:
        return {"kind": "sure", "family": clean(core)[0], "given": []}
    cut = next((i for i, p in enumerate(parts) if p.lower() in PARTICLES), None)
    if cut and cut < len(parts) - 1:  # given names, particle, family name
        fam = [w for w in clean(parts[cut:]) if w not in PARTICLES]
        return {"kind": "sure", "family": " ".join(fam), "given": given([w for p in parts[:cut] for w in words(p)])}
    if cut == 0 and len(core) > 1:  # particle and family name come first, or all there is
        initials = [p for p in core[1:] if _initials(p)]
        if initials:
            return {"kind": "sure", "family": clean(core[:1])[0], "given": given([w for p in core[1:] for w in words(p)])}
    last, first = core[-1], core[0]
    if _initials(last) and not _initials(first):
        k = next(i for i, p in enumerate(core) if i and _initials(p))
        return {"kind": "sure", "family": " ".join(clean(core[:k])), "given": given([w for p in core[k:] for w in words(p)])}
    if _initials(first) or any(p.isupper() and len(p) > 3 for p in core[-1:]) and not first.isupper():
        return {"kind": "sure", "family": clean([last])[0], "given": given([w for p in core[:-1] for w in words(p)])}
    if len(first) > 3 and first.isupper() and not last.isupper():
        return {"kind": "sure", "family": clean([first])[0], "given": given([w for p in core[1:] for w in words(p)])}
    return {"kind": "open", "family": "", "given": ["-".join(words(p)).lower() for p in core]}


def _initials(p: str) -> bool:
    """`J`, `J.`, `J.-L.`, `JD`, and `Ej` or `EjV`, which stand for the parts of a hyphenated name."""
    if regex.fullmatch(r"\p{Lu}[b-df-hj-np-tv-xz]\p{Lu}?|\p{Lu}\p{Ll}\p{Lu}", p):
        return True
    return bool(regex.fullmatch(r"(?:\p{Lu}\.?-?){1,3}", p)) and (len(p.replace(".", "").replace("-", "")) <= 3) and (p.endswith(".") or len(p) <= 3)


# Groups of letters that sound alike.
_SOUND = {c: k for k, letters in {"1": "bp", "2": "fvw", "3": "dt", "4": "cgkqx", "5": "szj", "6": "l", "7": "mn", "8": "r"}.items() for c in letters}


def phonetic(word: str) -> str:
    """Consonant sounds in their order; a vowel at the start counts as 0, vowels elsewhere as nothing, doubled letters as one. Letters of other scripts stand for themselves."""
    w = regex.sub(r"(.)\1+", r"\1", regex.sub(r"[^\p{L}]", "", word).replace("ph", "f").replace("ck", "k"))
    return "".join(("0" if i == 0 else "") if c in "aeiouy" else _SOUND.get(c, "" if c in "hw" else c) for i, c in enumerate(w))


def one_less(word: str) -> list[str]:
    """The word, and the word less any one letter: two words that differ by one slip share one of these."""
    return sorted({word} | {word[:i] + word[i + 1 :] for i in range(len(word))})


def block_keys(family: str, given: list[str]) -> list[str]:
    """Keys under which written-out names meet: the family name with the forms of the first given name (its long forms, and less any one letter); and, with the first initial, the phonetic code of the tokens of the family name in order, less any one letter."""
    if len(given) == 0:
        return []
    tokens = "".join(sorted(family.split()))
    out = {f"={family}={g}" for g in {*one_less(given[0]), *_FORMAL.get(given[0], ())}} if len(given[0]) > 1 else set()
    for f in {given[0][0]} | {x[0] for x in _FORMAL.get(given[0], ())}:
        out |= {f"{f}:{phonetic(v)}:{v}" for v in one_less(tokens)}
    return sorted(out)


@lru_cache(200_000)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(hits, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    lead = 0
    while lead < min(4, len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    return jaro + lead * 0.1 * (1 - jaro)


def one_slip(a: str, b: str) -> bool:
    """Whether one letter added, lost, changed or swapped with its neighbour makes a of b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def same_given(a: str, b: str) -> int:
    """2 the same, 1 the same with a slip, 0 not the same: of two given names, either of which may be an initial or a short form."""
    if a == b:
        return 2
    if len(a) == 1 or len(b) == 1:
        return 2 if a[0] == b[0] else 0
    if a in _FORMAL.get(b, ()) or b in _FORMAL.get(a, ()) or _FORMAL.get(a, set()) & _FORMAL.get(b, set()):
        return 2
    if min(len(a), len(b)) >= 2 and one_slip(a, b) and (min(len(a), len(b)) <= 3 or jaro_winkler(a, b) >= 0.75):
        return 1
    return 0


def _slip_of(x: int, y: int) -> bool:
    """Whether a form seen x times can be a typing error of one seen y times, or the other way round."""
    return min(x, y) <= max(2, max(x, y) / 8)


def compare(fa: str, ga: list[str], sa: int, ca: list[int], fb: str, gb: list[str], sb: int, cb: list[int]) -> str | None:
    """`strong` or `weak` if two signatures (family, given, how often each is seen) can be one person, else None.

    One slip in all is allowed, and only against a form that is seen far more rarely, as typing errors are: two
    names in common use that differ by a letter are two names. `weak` means that an initial stands against a
    written-out first name.
    """
    slips = 0
    if fa != fb:
        if not _slip_of(sa, sb) or min(len(fa), len(fb)) < 4 or not one_slip(fa, fb) or jaro_winkler(fa, fb) < 0.85:
            return None
        slips = 1
    if not len(ga) or not len(gb):
        return None if len(ga) or len(gb) else ("strong" if fa == fb else None)
    for x, y, p, q in zip(ga, gb, ca, cb):
        s = same_given(x, y)
        if not s or s == 1 and not _slip_of(p, q):
            return None
        slips += s == 1
    if slips > 1:
        return None
    return "weak" if (len(ga[0]) == 1) != (len(gb[0]) == 1) else "strong"


def _signatures(names: DataFrame) -> DataFrame:
    """(name, family, given) of distinct names that name somebody."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, p["kind"], p["family"], p["given"]) for n in b["name"] if n is not None and (p := parse(n))]
            yield pd.DataFrame(rows, columns=["name", "kind", "family", "given"])

    parsed = keep(names.mapInPandas(run, "name string, kind string, family string, given array<string>"), "parsed")
    sure = parsed.filter("kind = 'sure'")
    # How often a word is a family name and how often a given name, over all distinct names.
    uses = (
        sure.select(F.col("family").alias("w"), F.lit(1).alias("f"), F.lit(0).alias("g"))
        .unionByName(sure.select(F.explode("given").alias("w"), F.lit(0).alias("f"), F.lit(1).alias("g")).filter("length(w) > 1"))
        .unionByName(parsed.filter("kind = 'open'").select(F.try_element_at("given", F.lit(-1)).alias("w"), F.lit(1).alias("f"), F.lit(0).alias("g")))
        .unionByName(parsed.filter("kind = 'open'").select(F.try_element_at("given", F.lit(1)).alias("w"), F.lit(0).alias("f"), F.lit(1).alias("g")))
    )
    share = uses.groupBy("w").agg((F.sum("f") / (F.sum("f") + F.sum("g"))).alias("share"))
    o = parsed.filter("kind = 'open'").withColumns({"first": F.try_element_at("given", F.lit(1)), "last": F.try_element_at("given", F.lit(-1))})
    o = o.join(share.withColumnsRenamed({"w": "first", "share": "s1"}), "first").join(share.withColumnsRenamed({"w": "last", "share": "s2"}), "last")
    turned = F.col("s1") > F.col("s2")
    n = F.size("given")
    hyphen = lambda c: F.flatten(F.transform(c, lambda x: F.split(x, "-")))
    settled = o.select(
        "name",
        F.regexp_replace(F.when(turned, F.col("first")).otherwise(F.col("last")), "-", "").alias("family"),
        hyphen(F.when(turned, F.slice("given", 2, n - 1)).otherwise(F.slice("given", 1, n - 1))).alias("given"),
    )
    whole = parsed.filter("kind <> 'open'").select("name", F.regexp_replace("family", "-", "").alias("family"), "given")
    return settled.unionByName(whole)


def link_names(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, entity) of every distinct name that names somebody; spellings of one person or group share the entity.

    Nulls, blank names and `et al.`, `others` and the like are left out. A form with an initial goes with the
    written-out name it fits; where it fits several persons, with the one that is spelt in most ways, then the first.
    """
    distinct = names.select(F.col(name).alias("name")).filter(F.col("name").isNotNull() & (F.trim("name") != "")).distinct()
    sig = _signatures(distinct).withColumn("sig", F.concat_ws("|", "family", F.array_join("given", " ")))
    sig = keep(sig, "signatures")
    nodes = keep(sig.groupBy("sig").agg(F.first("family").alias("family"), F.first("given").alias("given"), F.count("*").alias("spellings")), "nodes")
    seen = nodes.groupBy("family").agg(F.sum("spellings").alias("seen"))
    given_seen = nodes.select("sig", F.posexplode("given").alias("i", "g"))
    given_seen = given_seen.join(given_seen.groupBy("g").agg(F.count("*").alias("n")), "g").groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("c"))
    nodes = keep(nodes.join(seen, "family").join(given_seen, "sig", "left").withColumn("counts", F.transform(F.coalesce("c", F.array().cast("array<struct<i:int,n:bigint>>")), lambda x: x["n"])).drop("c"), "nodes")
    cols = ("sig", "family", "given", "seen", "counts")

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            d["key"] = [block_keys(f, g) for f, g in zip(d["family"], d["given"])]
            yield d

    kinds = dict(nodes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in cols)
    blocks = keep(nodes.select(*cols).mapInPandas(met, schema + ", key array<string>").select(*cols, F.explode("key").alias("key")), "blocks")
    side = lambda d, x: d.select("key", *[F.col(c).alias(f"{c}_{x}") for c in cols])
    pairs = side(blocks, "a").join(side(blocks, "b"), "key").filter(F.col("sig_a") < F.col("sig_b"))
    # initials meet all that begin so under their family name; written-out names don't meet each other there
    first = F.try_element_at("given", F.lit(1))
    begins = nodes.filter(first.isNotNull()).select(*cols, F.concat_ws("=", "family", F.substring(first, 1, 1)).alias("key"), (F.length(first) == 1).alias("short"))
    with_initial = side(begins.filter("short"), "a").join(side(begins, "b"), "key").filter(F.col("sig_a") != F.col("sig_b"))
    low, high = F.col("sig_a") < F.col("sig_b"), lambda c: (F.col(c + "_a"), F.col(c + "_b"))
    with_initial = with_initial.select("key", *[F.when(low, high(c)[0]).otherwise(high(c)[1]).alias(c + "_a") for c in cols], *[F.when(low, high(c)[1]).otherwise(high(c)[0]).alias(c + "_b") for c in cols])
    pairs = pairs.unionByName(with_initial).dropDuplicates(["sig_a", "sig_b"])
    given = [f"{c}_{x}" for x in "ab" for c in cols[1:]]

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            links = [compare(*x) for x in zip(*(d[c] for c in given))]
            yield pd.DataFrame([(a, b, x) for a, b, x in zip(d["sig_a"], d["sig_b"], links) if x], columns=["sig_a", "sig_b", "link"])

    edges = pairs.select("sig_a", "sig_b", *given).mapInPandas(judged, "sig_a string, sig_b string, link string")
    edges = keep(edges, "links")
    _, strong = boruvka(edges.filter("link = 'strong'").select(F.col("sig_a").alias("u"), F.col("sig_b").alias("v"), F.lit("").alias("w")))
    part = keep(nodes.join(strong.withColumnsRenamed({"vertex": "sig"}), "sig", "left").select("sig", F.coalesce("root", "sig").alias("part"), "spellings", "given"), "parts")
    size = part.groupBy("part").agg(F.sum("spellings").alias("spellings"))
    at = part.select("sig", "part")
    short = F.length(F.try_element_at("given", F.lit(1))) == 1
    weak = edges.filter("link = 'weak'")
    weak = weak.select("sig_a", "sig_b").unionByName(weak.select(F.col("sig_b").alias("sig_a"), F.col("sig_a").alias("sig_b")))
    weak = weak.join(part.filter(short).select(F.col("sig").alias("sig_a"), F.col("part").alias("small")), "sig_a").join(at.withColumnsRenamed({"sig": "sig_b", "part": "full"}), "sig_b")
    chosen = (
        weak.select("small", "full").distinct().join(size.withColumnRenamed("part", "full"), "full")
        .groupBy("small").agg(F.min(F.struct((-F.col("spellings")).alias("n"), "full")).alias("m")).select("small", F.col("m.full").alias("full"))
    )
    entity = at.join(chosen, at["part"] == chosen["small"], "left").select("sig", F.coalesce("full", "part").alias("entity"))
    return sig.join(entity, "sig").select("name", "entity")


def name_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b in code point order: all pairs of distinct spellings of one entity."""
    a = linked.select("entity", F.col("name").alias("name_a"))
    b = linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
