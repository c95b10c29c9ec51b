"""Sentence units of texts in any script.

The boundaries follow the character-property rules of Unicode's sentence segmentation (classes STerm, ATerm, Close,
Sp, Lower, Upper, OLetter), with what those rules leave to tailoring: abbreviations by language, quotations and
brackets (nothing inside a closed pair ends the sentence around it), list lines, hard line wraps, and scripts that
separate sentences by white space only.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from quillspark.session import spread

# Abbreviations. `title` stands before a name, `number` before a number or a letter, `never` ends no
# sentence, `maybe` ends one when a capital follows.
ABBREVIATIONS: dict[str, dict[str, str]] = {
    "en": {
        "title": "Dr Prof Mr Mrs Ms St Sr Jr Rev Hon Gen Col Capt Lt Sgt Gov Sen Rep Mt Ft",
        "number": "No no Nos Fig fig Figs figs Sec sec Secs Eq eq Eqs eqs Thm thm Vol vol pp p Ch ch Chap chap Ref ref Refs refs Tab App Def Lem Cor Prop Ex Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec art ver",
        "never": "approx vs cf e.g i.e viz resp al ca",
        "maybe": "etc Inc Ltd Co Corp a.m p.m U.S U.K U.N Ph.D B.C A.D",
    },
    "de": {"title": "Dr Prof Hr Fr Frau St Dipl Ing", "number": "Nr Abb Kap S Bd Tab Gl Abs Art Anm Jh Aufl Jan Feb Apr Jun Jul Aug Sept Okt Nov Dez", "never": "bzw vgl ca z d h z.B d.h u.a i.d.R evtl ggf sog inkl exkl B", "maybe": "usw etc u.s.w"},
    "fr": {"title": "M MM Mme Mlle Dr Pr Me St Ste", "number": "p pp fig chap vol art éd n no sect env", "never": "env cf c.-à-d p.ex av apr réf", "maybe": "etc"},
    "es": {"title": "Dr Dra Sr Sra Srta D Dª Ud Uds Prof Profa", "number": "p pp pág págs fig figs cap vol art núm n", "never": "aprox p.ej ej p cf vs", "maybe": "etc EE.UU UU EE"},
    "ru": {"title": "Проф проф Др д-р акад доц г-н г-жа", "number": "рис стр гл табл разд ур № п", "never": "т е т.е т.к ок см См напр прим ср", "maybe": "др т.д т.п пр г гг ед"},
    "vi": {"title": "TS GS PGS ThS TP BS KS Ông Bà", "number": "tr hình bảng mục chương", "never": "vd", "maybe": "v.v"},
    "ar": {"title": "د أ م", "number": "ص ج", "never": "", "maybe": "إلخ"},
    "hi": {"title": "डॉ श्री प्रो", "number": "पृ", "never": "", "maybe": ""},
}
GERMAN_MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())

_KINDS = ("title", "number", "never", "maybe")
_LATIN = ("en", "de", "fr", "es", "vi")
#: Labels of language are null or wrong in places, so a word is looked up in the lists of its script.
_BY_KIND = {k: frozenset(w for lists in ABBREVIATIONS.values() for w in lists[k].split()) for k in _KINDS}
_OWN = {lang: {k: frozenset(lists[k].split()) for k in _KINDS} for lang, lists in ABBREVIATIONS.items()}

SPACED_OUT = r"\p{Thai}\p{Lao}"
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}ー々]")
_UNIT = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…‥｡]+")
_CLOSE = regex.compile(r"[\s ]?[»]|[)\]}’”“\"'」』】〉》）］｝»›]")
_ITEM = regex.compile(r"[^\S\n]*(?:[-*•‣◦▪–·]|\\item|\(?\d{1,3}\)|\(?[a-zA-Z]\))(?:[^\S\n]+|\[[^\]\n]*\][^\S\n]*)\S")
_NUMBERED = regex.compile(r"[^\S\n]*\d{1,3}\.[^\S\n]+\S")
_BLANK = regex.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+| ")
_THAI_GAP = regex.compile(rf"(?<=[{SPACED_OUT}?!.ฯๆ”\"»)])\s+(?=[“\"(«]?[{SPACED_OUT}])|(?<=[{SPACED_OUT}])\s+(?=[“\"(«]?[\p{{Lu}}\p{{Han}}\p{{Hiragana}}\p{{Katakana}}])")
_LETTER = regex.compile(r"\p{L}")
_PREVIOUS = regex.compile(r"(?:[^\s()\[\]{}«»“”\"„,;:/~]|(?<=\w)-(?=\w))+$")
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“”", "‹": "›"}
_CLOSERS = {c for v in _PAIRS.values() for c in v}
_MARKS = regex.compile(r"[()\[\]{}（）［］「」『』【】《》〈〉«»“”„‹›\"]")


def _enclosed(s: str) -> tuple[list[int], list[int]]:
    """Outermost closed pairs of quotes and brackets, as (starts, ends)."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _MARKS.finditer(s):
        c, i = m[0], m.start()
        if c == '"':
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if at is not None:
                found.append((stack[at][1], i))
                del stack[at:]
            elif i + 1 < len(s) and not s[i + 1].isspace():
                stack.append((c, i))
            continue
        if c in _CLOSERS:
            at = next((k for k in range(len(stack) - 1, -1, -1) if c in _PAIRS.get(stack[k][0], "")), None)
            if at is not None:
                found.append((stack[at][1], i))
                del stack[at:]
                continue
        if c in _PAIRS:
            stack.append((c, i))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return [a for a, _ in outer], [b for _, b in outer]


def _holds_back(s: str, dot: int, nxt: int, lang: str | None) -> bool:
    """Whether the full stop at `dot` belongs to an abbreviation, so that what starts at `nxt` goes on with the sentence."""
    m = _PREVIOUS.search(s, max(0, dot - 24), dot)
    word = m[0] if m else ""
    word = word.lstrip("'’*_-")
    c = s[nxt]
    rest = s[nxt:]
    if not word:
        return False
    if word.isdigit():
        if len(word) <= 2:
            follow = regex.match(r"\p{L}+", rest)
            if follow and follow[0] in GERMAN_MONTHS:
                return True
        return False
    own = _OWN.get((lang or "")[:2].lower())
    tail = word.rsplit(".", 1)[-1]

    def among(kind: str) -> bool:
        return word in _BY_KIND[kind] or (own is not None and tail in own[kind] and len(tail) > 1)

    first = regex.search(r"[\p{L}\p{N}]", rest[:4])
    numeric = bool(first and first[0].isdigit()) or bool(regex.match(r"[(\[]?(?:\p{Lu}\b|[IVXL]+\b|\\ref|\$)", rest))
    if among("maybe"):
        return not (c.isupper() or not c.isalpha() or bool(_LETTER.match(c)) and not c.islower()) if word not in ("EE", "т", "г", "гг") else word == "EE" or not c.isupper()
    if among("title") and (c.isupper() or regex.match(r"\p{Lo}", c)):
        return True
    if among("never"):
        return True
    if among("number") and numeric:
        return True
    if len(tail) == 1 and tail.isupper() and len(word) <= 6 and (len(word) == 1 or "." in word or "-" in word):
        return True  # initials
    return "." in word and len(word) <= 6 and all(len(p) <= 1 for p in word.split(".")) and not c.isupper()


def _breaks(s: str, lang: str | None) -> list[int]:
    """Ends of sentences inside one block, the block's own end not included."""
    starts, ends = _enclosed(s)

    def inside(i: int) -> bool:
        k = bisect.bisect_left(starts, i) - 1
        return k >= 0 and i < ends[k]

    out: list[int] = []
    n = len(s)
    begin = 0
    for m in _UNIT.finditer(s):
        a, p = m.start(), m.end()
        term = m[0]
        if a < begin:
            continue
        closers = 0
        quote = False
        opened = None
        while p < n:
            c = _CLOSE.match(s, p)
            if not c:
                break
            mark = c[0][-1]
            if mark in "\"'“" and (c.end() >= n or not s[c.end()].isspace()) and not inside(a) and mark != "“":
                break  # an opening mark of what follows
            k = bisect.bisect_left(ends, c.end() - 1)
            if k < len(ends) and ends[k] == c.end() - 1:
                opened = starts[k]
            elif mark == "“":
                break
            quote |= mark in "\"'”“’»」』›"
            closers += 1
            p = c.end()
        if inside(a) and closers == 0 or inside(p):
            continue
        # more terminators after a closing mark: 。」。 or ?).
        more = _UNIT.match(s, p) if closers else None
        if more:
            continue
        q = p
        while q < n and s[q].isspace():
            q += 1
        if q >= n:
            break
        gap = q > p
        nxt = s[q]
        wide = bool(_WIDE.match(nxt))
        strong = bool(regex.match(r"\p{SB=STerm}", term[-1])) or term[-1] == "｡"
        if closers and opened is not None:
            # what ended is inside a pair; does the sentence around it go on?
            whole = s[begin:opened].strip() == ""
            if nxt.islower() or nxt in "—–-,;:،؛、，；":
                continue
            if wide and not gap and (quote or not whole):
                continue
            if not gap and not nxt.isupper() and not wide:
                continue
            if not quote and not whole and not strong and nxt.islower():
                continue
        elif strong:
            if term[-1] in "!?" and not gap and not (nxt.isupper() or wide or nxt in "¿¡“«\"(" or regex.match(r"\p{Lo}", nxt)):
                continue
            if nxt in "—–,;،、，":
                continue
        else:
            if nxt in ",;:،؛":
                continue
            single = term == "."
            if not gap:
                if not (nxt.isupper() or wide or nxt in "“«¿¡") or closers == 0 and not regex.search(r"\p{Ll}{2,}$|[\d)%]$", s[max(0, a - 3) : a]):
                    continue
                if nxt.isupper() and not regex.match(r"\p{Lu}(?:\p{Ll}|\s)", s[q : q + 2]):
                    continue
                if closers == 0 and regex.search(r"\d$", s[max(0, a - 1) : a]) and not regex.match(r"\p{Lu}\p{Ll}", s[q : q + 2]):
                    continue
                if regex.search(r"(?:https?://|www\.|@|/)\S*$", s[max(0, a - 60) : a]):
                    continue
            first = _LETTER.search(s, q, min(n, q + 40))
            if nxt.islower() or first and first[0].islower() and not regex.search(r"\s", s[q : first.start()]) and not nxt.isalpha():
                continue
            if regex.match(r"[\d\W_]+\p{Ll}", s[q : q + 40]) and nxt.isdigit():
                continue
            if single and closers == 0 and _holds_back(s, a, q, lang):
                continue
        out.append(p)
        begin = p
    if regex.search(rf"[{SPACED_OUT}]", s):
        for m in _THAI_GAP.finditer(s):
            if not inside(m.start()):
                out.append(m.start())
        out = sorted(set(out))
    return out


def sentence_spans(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, 0-based, end exclusive, in code points, without white space at either end."""
    spans: list[tuple[int, int]] = []

    def emit(a: int, b: int) -> None:
        while a < b and (text[a].isspace() or text[a] in "​﻿"):
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in "​﻿"):
            b -= 1
        if a < b:
            spans.append((a, b))

    def block(a: int, b: int) -> None:
        s = text[a:b]
        at = 0
        for p in _breaks(s, lang):
            emit(a + at, a + p)
            at = p
        emit(a + at, b)

    edges = [0]
    for m in _BLANK.finditer(text):
        edges.append(m.end())
    edges.append(len(text))
    for a, b in zip(edges, edges[1:]):
        # list lines are units; what stands between them is running text
        run, pos, listed = a, a, False
        while pos < b:
            e = text.find("\n", pos, b)
            e = b if e < 0 else e + 1
            before = text[run:pos].rstrip()
            item = _ITEM.match(text, pos, e) is not None
            if not item and _NUMBERED.match(text, pos, e):
                item = listed or not before or before[-1] in ":.!?" and not regex.search(r"(?:\b\p{L}{1,4}|\p{N})\.$", before)
            if item:
                block(run, pos)
                emit(pos, e)
                run = e
            listed = item
            pos = e
        block(run, b)
    return spans


def split_sentences(df: DataFrame, row_id: str, text: str, lang: str | None = None) -> DataFrame:
    """(row_id, start_pos, end_pos) of every sentence of every text that is not null; blank texts have none.

    Rows do not depend on each other: no shuffle. `lang` may be null or wrong; it only adds abbreviations.
    """
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang")).filter(F.col("text").isNotNull())
    rows = spread(rows, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, a, e = [], [], []
            for i, t, g in zip(b["id"], b["text"], b["lang"]):
                for x, y in sentence_spans(t, g):
                    ids.append(i)
                    a.append(x)
                    e.append(y)
            yield pd.DataFrame({"id": ids, "start_pos": a, "end_pos": e}).astype({"start_pos": "int32", "end_pos": "int32"})

    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(run, f"id {kind}, start_pos int, end_pos int").withColumnRenamed("id", row_id)
