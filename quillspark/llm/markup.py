"""Markup residue to clean text: HTML, Markdown, wiki and LaTeX, also mixed in one text.

A scanner recognises constructs and feeds a tree builder; the builder closes what the markup leaves open (implied
tags) and drops what is not visible (comments, scripts, labels, preambles, templates); a renderer lays the tree out
as text, with blank lines between blocks, list markers, code as it stands, formulas as their source and table cells
padded to columns. Each construct also names its family, which is how residue is reported.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from quillspark.session import spread

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"
FAMILIES = (HTML, LATEX, MARKDOWN, WIKI)

# The elements of HTML by how they are laid out.
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html main nav p section summary".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol menu dir".split())
_TABLE = frozenset("table thead tbody tfoot tr td th caption colgroup".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style template noscript head iframe object svg".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q ruby rb rp rt s samp small span strike strong sub sup time title tt u var button select option textarea".split())
_TAGS = _BLOCK | _HEADING | _LISTS | _TABLE | _VOID | _HIDDEN | _INLINE | {"li", "pre"}
_WIKI_TAGS = frozenset("ref references nowiki gallery syntaxhighlight".split())
# LaTeX commands whose argument is not shown, and environments by content.
_UNSEEN = frozenset("label ref eqref pageref autoref cref Cref includegraphics bibliographystyle bibliography usepackage documentclass newcommand renewcommand input include vspace hspace setlength pagestyle thispagestyle index hypersetup graphicspath date definecolor color todo".split())
_NO_ARG = frozenset("maketitle centering noindent small tiny large Large LARGE huge Huge normalsize footnotesize scriptsize hfill vfill clearpage newpage pagebreak bigskip medskip smallskip par tableofcontents appendix hline toprule midrule bottomrule printbibliography it em bf sc rm tt sl sf bfseries itshape scshape ttfamily and protect left right quad qquad newline linebreak indent raggedright".split())
_SECTIONS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6, "title": 1, "author": 7, "caption": 7}
_SYMBOLS = {"ldots": "…", "dots": "…", "textellipsis": "…", "textendash": "–", "textemdash": "—", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "i", "j": "j", "S": "§", "P": "¶", "copyright": "©", "pounds": "£", "textbackslash": "\\", "LaTeX": "LaTeX", "TeX": "TeX", "textasciitilde": "~", "textasciicircum": "^"}
_ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a", "b": "\u0331", "d": "\u0323"}
_MATH_ENV = "equation|align|gather|multline|eqnarray|displaymath|math|alignat|flalign"
_CODE_ENV = "verbatim|lstlisting|minted|Verbatim|alltt"

_CONSTRUCTS = rf"""
      (?P<fence>(?m:^)[ \t]*(?P<tick>```+|~~~+)[^\n`]*\n(?P<fbody>.*?)(?:(?m:^)[ \t]*(?P=tick)[ \t]*(?m:$)|\Z))
    | (?P<comment><!--.*?(?:-->|\Z))
    | (?P<tag></?(?P<name>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>(?:\s+[\w:.-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=`]+))?)*)\s*/?>)
    | (?P<doctype><![Dd][Oo][Cc][Tt][Yy][Pp][Ee][^>]*>)
    | (?P<entity>&(?:\#\d{{1,7}}|\#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,30}});)
    | (?P<codeenv>\\begin\{{(?P<cenv>{_CODE_ENV})\*?\}}(?:\[[^\]]*\])?(?:\{{[^}}]*\}})?\n?(?P<cbody>.*?)\\end\{{(?P=cenv)\*?\}})
    | (?P<mathenv>\\begin\{{(?P<menv>{_MATH_ENV})(?P<mstar>\*?)\}}(?P<mbody>.*?)\\end\{{(?P=menv)\*?\}})
    | (?P<display>\\\[(?P<d1>.*?)\\\]|\$\$(?P<d2>[^$]+?)\$\$)
    | (?P<inline>\\\((?P<i1>[^\n]*?)\\\)|(?<![\\$\w])\$(?=[^\s$])(?P<i2>[^$\n]*?[^\s$\\])\$(?![\d$]))
    | (?P<env>\\(?P<edge>begin|end)\s*\{{(?P<ename>[A-Za-z]+)\*?\}}(?:\[[^\]]*\])?)
    | (?P<lquote>``(?P<lq>[^`\n]+?)'')
    | (?P<code>(?<!`)`(?P<ibody>[^`\n]+)`(?!`))
    | (?P<wtable>(?m:^)[ \t]*\{{\|(?P<wbody>.*?)(?:\n[ \t]*\|\}}|\Z))
    | (?P<template>\{{\{{(?:[^{{}}]|\{{\{{[^{{}}]*\}}\}})*\}}\}})
    | (?P<wlink>\[\[(?P<wtext>[^\[\]\n]+)\]\])
    | (?P<mdlink>(?P<bang>!?)\[(?P<ltext>[^\[\]\n]*)\]\((?P<dest>[^()\s]*(?:\([^()\s]*\))?[^()\s]*)(?:\s+"[^"]*")?\))
    | (?P<extlink>\[(?:https?|ftp)://[^\s\]]+(?:\s+(?P<etext>[^\]\n]*))?\])
    | (?P<whead>(?m:^)[ \t]*(?P<eq>={{2,6}})[ \t]*(?P<hbody>[^=\n][^\n]*?)[ \t]*(?P=eq)[ \t]*(?m:$))
    | (?P<wbold>'''(?P<bbody>[^\n]+?)'''|(?<!')''(?!')(?P<itbody>[^\n]+?)(?<!')''(?!'))
    | (?P<magic>__(?:TOC|NOTOC|NOEDITSECTION|FORCETOC)__)
    | (?P<mhead>(?m:^)[ ]{{0,3}}(?P<hash>\#{{1,6}})[ \t]+(?P<mhbody>[^\n]+?)(?:[ \t]+\#+)?[ \t]*(?m:$))
    | (?P<mtable>(?m:^)[ \t]*\|?[^\n|]+\|[^\n]*\n[ \t]*\|?[ \t]*:?-{{2,}}:?[ \t]*(?:\|[ \t]*:?-{{2,}}:?[ \t]*)+\|?[ \t]*(?:\n[^\n]*\|[^\n]*)*)
    | (?P<mbold>(?<![A-Za-z0-9*\\])\*\*(?![\s*])(?P<mb1>[^\n]+?)(?<![\s*])\*\*(?![A-Za-z0-9*])|(?<![\w\\])__(?![\s_])(?P<mb2>[^\n]+?)(?<![\s_])__(?![\w]))
    | (?P<mital>(?<![A-Za-z0-9*\\])\*(?![\s*])(?P<mi1>[^*\n]+?)(?<![\s*])\*(?![A-Za-z0-9*])|(?<![\w\\])_(?![\s_])(?P<mi2>[^_\n]+?)(?<![\s_])_(?!\w))
    | (?P<mstrike>(?<![~\w])~~(?![\s~])(?P<msbody>[^~\n]+?)(?<!\s)~~(?!~))
    | (?P<quoted>(?m:^)[ ]{{0,3}}>[ \t]+(?=\S))
    | (?P<accent>\{{?\\(?P<acc>[`'^"~=.]|[uvHckrbd](?=\{{))\s*(?:\{{\s*\\?(?P<ab>[A-Za-z])\s*\}}|\\?(?P<aa>[A-Za-z]))\}}?)
    | (?P<lcomment>(?<!\\)%[^\n]*\n?)
    | (?P<command>(?<![:\\])\\(?P<cmd>[A-Za-z@]+)(?P<cstar>\*?))
    | (?P<escaped>\\(?P<esc>[%&$\#_{{}}~^\- ,;:!/@]|\\(?:\[[^\]]*\])?))
    | (?P<group>\{{|\}})
    | (?P<tie>(?<=[\w.,:;)\]}}?!])~(?=[\w\\({{\[$]))
    """
_SCAN = regex.compile(_CONSTRUCTS, regex.X | regex.S)
#: The same without bodies that go on to an end mark, for where that mark doesn't come any more.
_SCAN_OPEN = regex.compile("\n".join(x for x in _CONSTRUCTS.split("\n") if not x.lstrip().startswith(("| (?P<codeenv>", "| (?P<mathenv>", "| (?P<display>"))), regex.X | regex.S)
#: Where a construct can begin: at one of these characters, or at a line that begins like one or stands over a table's rule.
_MAY_BEGIN = regex.compile(r"[`~<&\\$\[{}'_*%!]|(?m:^)[ \t]*(?=```|~~~|\{\||={2}|>)|(?m:^)[ ]{0,3}(?=\#)|(?m:^)(?=[^\n|]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-{2})")
_ENV_NAME = regex.compile(rf"\\begin\{{({_CODE_ENV}|{_MATH_ENV})\*?\}}")
_BOLD_END = regex.compile(r"(?<![\s*])\*\*(?![A-Za-z0-9*])")
_OPTION = regex.compile(r"\[(?:[^\[\]\n]|\n(?![ \t]*\n)|\[[^\[\]\n]*\])*+\]")
_FAMILY = {
    "fence": MARKDOWN, "comment": HTML, "tag": HTML, "doctype": HTML, "entity": HTML, "codeenv": LATEX, "mathenv": LATEX, "display": LATEX, "inline": LATEX, "env": LATEX,
    "lquote": LATEX, "code": MARKDOWN, "wtable": WIKI, "template": WIKI, "wlink": WIKI, "mdlink": MARKDOWN, "extlink": WIKI, "whead": WIKI, "wbold": WIKI, "magic": WIKI, "mhead": MARKDOWN,
    "mtable": MARKDOWN, "mbold": MARKDOWN, "mital": MARKDOWN, "mstrike": MARKDOWN, "quoted": MARKDOWN, "accent": LATEX, "lcomment": LATEX, "command": LATEX, "escaped": LATEX, "group": LATEX, "tie": LATEX,
}
_ITEM = regex.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+\S")
_WIKI_ITEM = regex.compile(r"(?m:^)(?P<m>[*#:;]+)[ \t]*(?=\S)")


class _Node:
    __slots__ = ("kind", "kids", "level", "hidden")

    def __init__(self, kind: str, level: int = 0, hidden: bool = False) -> None:
        self.kind, self.kids, self.level, self.hidden = kind, [], level, hidden


#: What the start of a kind closes, innermost first, and the kinds beyond which it does not reach.
_CLOSES = {
    "item": (("para", "item", "heading"), ("list",)), "row": (("para", "cell", "row"), ("table",)), "cell": (("para", "cell"), ("row", "table")), "para": (("para",), ("item", "cell", "block")),
    "heading": (("para", "heading"), ("block", "cell")), "list": (("para", "heading"), ("item", "cell", "block")), "table": (("para", "heading"), ("cell", "block")), "block": (("para", "heading"), ("cell", "item")),
    "code": (("para",), ("item", "cell", "block")), "formula": ((), ()),
}


class _Builder:
    def __init__(self) -> None:
        self.root = _Node("root")
        self.open = [self.root]
        self.names: list[str] = [""]

    def text(self, s: str) -> None:
        if s:
            self.open[-1].kids.append(s)

    def start(self, kind: str, name: str = "", level: int = 0, hidden: bool = False) -> None:
        closes, walls = _CLOSES.get(kind, ((), ()))
        for at in range(len(self.open) - 1, 0, -1):
            k = self.open[at].kind
            if k in walls:
                break
            if k in closes:
                del self.open[at:], self.names[at:]
                if k == kind:
                    break
        if kind == "item" and not any(n.kind == "list" for n in self.open):
            self.start("list", "ul")
        if kind == "row" and not any(n.kind == "table" for n in self.open):
            self.start("table", "table")
        if kind == "cell" and not any(n.kind == "row" for n in self.open):
            self.start("row", "tr")
        node = _Node(kind, level, hidden)
        self.open[-1].kids.append(node)
        if len(self.open) > _DEEP:
            return
        self.open.append(node)
        self.names.append(name or kind)

    def end(self, name: str) -> bool:
        for at in range(len(self.names) - 1, 0, -1):
            if self.names[at] == name:
                del self.open[at:], self.names[at:]
                return True
        return False

    def leaf(self, kind: str, s: str = "", level: int = 0) -> None:
        self.start(kind, level=level)
        self.text(s)
        self.end(kind)


@lru_cache(8)
def _groups(s: str) -> dict[int, int]:
    """Ends of all brace groups of a text, by where they open: one pass, however deep they are."""
    ends: dict[int, int] = {}
    stack: list[int] = []
    for m in _BRACE.finditer(s):
        if m[0] == "{":
            stack.append(m.start())
        elif m[0] == "}" and stack:
            ends[stack.pop()] = m.end()
    return ends


_BRACE = regex.compile(r"\\.|[{}]", regex.S)
#: Elements nested deeper than this are laid out as if they were beside each other; constructs, without regard to their kinds.
_DEEP = 120
_ANY_MARK = regex.compile(r"<!--.*?(?:-->|\Z)|</?[A-Za-z][^<>]*>|\\(?:begin|end)\s*\{[^{}]*\}|\\[A-Za-z@]+\*?|\\(?=[%&$#_{}])|(?<!\\)[{}]|\[\[|\]\]|\*\*|'{2,}", regex.S)


def _balanced(s: str, at: int) -> int:
    """End of the brace group that opens at `at`, or -1."""
    return _groups(s).get(at, -1)


class _Parser:
    def __init__(self, allowed: frozenset[str], whole: str) -> None:
        self.allowed, self.seen, self.b, self.depth = allowed, set(), _Builder(), 0
        #: A source of its own format follows that format's lines too: lists of a wiki, comments of LaTeX.
        self.whole = whole

    def parse(self, s: str) -> None:
        if self.depth > _DEEP:
            self.b.text(html.unescape(_ANY_MARK.sub("", s)))
            return
        self.depth += 1
        try:
            self._parse(s)
        finally:
            self.depth -= 1

    def _parse(self, s: str) -> None:
        at = pos = 0
        last: dict[str, int] = {}

        def comes(mark: str, after: int) -> bool:
            if mark not in last:
                last[mark] = s.rfind(mark)
            return last[mark] >= after

        while True:
            here = _MAY_BEGIN.search(s, pos)
            if here is None:
                break
            pos = here.start()
            scan = _SCAN
            if s.startswith("\\[", pos) and not comes("\\]", pos) or s.startswith("$$", pos) and not comes("$$", pos + 2):
                scan = _SCAN_OPEN
            elif s.startswith("\\begin{", pos) and (e := _ENV_NAME.match(s, pos)) and not comes(f"\\end{{{e[1]}", pos):
                scan = _SCAN_OPEN
            if s.startswith("**", pos):
                if "**" not in last:
                    last["**"] = max((x.start() for x in _BOLD_END.finditer(s)), default=-1)
                if last["**"] <= pos:
                    pos += 1
                    continue
            m = scan.match(s, pos)
            if m is None:
                pos += 1
                continue
            kind = m.lastgroup
            family = _FAMILY[kind]
            if kind == "tag" and m["name"].lower() in _WIKI_TAGS:
                family = WIKI
            if family not in self.allowed:
                pos = m.start() + 1
                continue
            end = self.take(kind, m, s, at)
            if end is None:
                pos = m.start() + 1
                continue
            # the text before it was flushed by take()
            self.seen.add(family)
            at = pos = end
        self.b.text(s[at:])

    def take(self, kind: str, m, s: str, at: int) -> int | None:
        b, end = self.b, m.end()

        def before() -> None:
            self.b.text(s[at : m.start()])

        if kind == "fence":
            before()
            b.leaf("code", m["fbody"].rstrip("\n"))
        elif kind in ("comment", "doctype", "magic"):
            before()
        elif kind == "tag":
            name = m["name"].lower()
            attrs = m["attrs"] or ""
            if name in _WIKI_TAGS:
                before()
                close = s.find(f"</{m['name']}", end)
                if name in ("ref", "references") and not m[0].endswith("/>") and m[0][1] != "/" and close >= 0:
                    return s.index(">", close) + 1
                return end
            if name not in _TAGS or regex.search(r"\s[\w:.-]+(?=\s|$)(?!\s*=)", regex.sub(r"""=\s*(?:"[^"]*"|'[^']*'|\S+)""", "=", attrs)) and not regex.fullmatch(r"(?:\s+(?:hidden|disabled|checked|open|selected|async|defer|nowrap|[\w:.-]+\s*=\s*\S.*?))*", attrs, regex.S):
                return None
            before()
            if m[0].startswith("</"):
                kind_of = "p" if name == "p" else name
                if not b.end(kind_of) and name == "p":
                    b.leaf("para")
                return end
            hidden = name in _HIDDEN or bool(regex.search(r"(?i)\bhidden\b(?!\s*=\s*['\"]?false)|display\s*:\s*none|visibility\s*:\s*hidden", attrs))
            if name in _VOID:
                if name == "br":
                    b.text("\u2028")
                elif name == "hr":
                    b.leaf("para")
                elif name == "img" and (alt := regex.search(r"""(?i)\balt\s*=\s*(?:"([^"]*)"|'([^']*)')""", attrs)):
                    b.text(html.unescape(alt[1] or alt[2] or ""))
                return end
            if name in ("script", "style"):
                close = regex.compile(rf"(?i)</{name}\s*>").search(s, end)
                return close.end() if close else len(s)
            if name == "pre":
                close = regex.compile(r"(?i)</pre\s*>").search(s, end)
                body = s[end : close.start() if close else len(s)]
                b.leaf("code", html.unescape(regex.sub(r"</?[a-zA-Z][^<>]*>", "", body)).strip("\n"))
                return close.end() if close else len(s)
            if name in _HEADING:
                b.start("heading", name, int(name[1]), hidden)
            elif name in _LISTS:
                b.start("list", name, 1 if name == "ol" else 0, hidden)
            elif name in ("li", "dd", "dt"):
                b.start("item", name, 0, hidden)
            elif name == "table":
                b.start("table", name, 0, hidden)
            elif name == "tr":
                b.start("row", name, 0, hidden)
            elif name in ("td", "th"):
                b.start("cell", name, 0, hidden)
            elif name == "p":
                b.start("para", "p", 0, hidden)
            elif name in _BLOCK or name == "caption":
                b.start("block", name, 0, hidden)
            else:
                b.start("span", name, 0, hidden)
        elif kind == "entity":
            body = m[0][1:]
            if not body.startswith("#") and body not in html5:
                return None
            before()
            b.text(html.unescape(m[0]).replace("\u00a0", " "))
        elif kind == "codeenv":
            before()
            b.leaf("code", m["cbody"].rstrip())
        elif kind == "mathenv":
            before()
            b.leaf("formula", _formula(m["mbody"]))
        elif kind == "display":
            before()
            b.leaf("formula", _formula(m["d1"] or m["d2"] or ""))
        elif kind == "inline":
            before()
            b.text((m["i1"] if m["i1"] is not None else m["i2"]).strip())
        elif kind == "env":
            before()
            return self.environment(m, s)
        elif kind == "lquote":
            before()
            b.text("“")
            self.parse(m["lq"])
            b.text("”")
        elif kind == "code":
            before()
            b.text(m["ibody"])
        elif kind == "wtable":
            before()
            self.wiki_table(m["wbody"])
        elif kind == "template":
            before()
        elif kind == "wlink":
            before()
            target, _, shown = m["wtext"].partition("|")
            if not regex.match(r"(?i)\s*(?:category|file|image)\s*:", target):
                self.parse(shown.rsplit("|", 1)[-1] or target)
        elif kind == "mdlink":
            before()
            self.parse(m["ltext"])
        elif kind == "extlink":
            before()
            self.parse(m["etext"] or "")
        elif kind in ("whead", "mhead"):
            before()
            b.start("heading", level=len(m["eq"] or m["hash"]))
            self.parse(m["hbody"] or m["mhbody"])
            b.end("heading")
        elif kind in ("wbold", "mbold", "mital", "mstrike"):
            before()
            self.parse(next(x for x in (m["bbody"], m["itbody"], m["mb1"], m["mb2"], m["mi1"], m["mi2"], m["msbody"]) if x is not None))
        elif kind == "mtable":
            before()
            b.start("table")
            for i, line in enumerate(m[0].strip("\n").split("\n")):
                if i == 1:
                    continue
                b.start("row")
                for cell in line.strip().strip("|").split("|"):
                    b.start("cell")
                    self.parse(cell.strip())
                    b.end("cell")
                b.end("row")
            b.end("table")
        elif kind == "quoted":
            before()
        elif kind == "accent":
            before()
            letter, mark = m["ab"] or m["aa"], _ACCENTS[m["acc"]]
            b.text(unicodedata.normalize("NFC", letter + mark))
            if m[0].startswith("{") != m[0].endswith("}") and m[0].startswith("{"):
                return m.end()
            if m[0].endswith("}") and not m[0].startswith("{") and m["ab"] is None:
                return m.end() - 1
        elif kind == "lcomment":
            if self.whole != LATEX:
                return None
            before()
        elif kind == "command":
            return self.command(m, s, before)
        elif kind == "escaped":
            before()
            e = m["esc"]
            b.text(e if e in "%&$#_{}~^@" else "\u2028" if e[0] == "\\" else " " if e in " ,;:" else "")
        elif kind == "group":
            if m[0] == "}" and self.whole != LATEX:
                return None
            if m[0] == "{" and self.whole != LATEX and _balanced(s, m.start()) < 0:
                return None
            if m[0] == "{" and self.whole != LATEX:
                stop = _balanced(s, m.start())
                before()
                self.parse(s[m.end() : stop - 1])
                return stop
            before()
        elif kind == "tie":
            before()
            b.text(" ")
        return end

    def command(self, m, s: str, before) -> int | None:
        b, name, end = self.b, m["cmd"], m.end()

        def argument(i: int) -> tuple[str, int] | None:
            j = i
            while j < len(s) and s[j] in " \t\n" and j - i < 3:
                j += 1
            if j < len(s) and s[j] == "[":
                if o := _OPTION.match(s, j):
                    j = o.end()
            while j < len(s) and s[j] in " \t":
                j += 1
            if j < len(s) and s[j] == "{":
                stop = _balanced(s, j)
                if stop > 0:
                    return s[j + 1 : stop - 1], stop
            return None

        before()
        if name == "newblock":
            b.text(" ")
            return end
        if name in _SYMBOLS:
            b.text(_SYMBOLS[name])
            return end + (s[end : end + 1] == " ") if not s.startswith("{}", end) else end + 2
        if name == "item":
            if s[end : end + 1] == "[" and 0 <= (k := s.find("]", end)):
                end = k + 1
            b.start("item")
            return end
        if name in _NO_ARG:
            if name in ("par", "and"):
                b.text("\n\n" if name == "par" else ", ")
            return end + (s[end : end + 1] == " ")
        arg = argument(end)
        if name in _UNSEEN:
            while arg:
                end = arg[1]
                arg = argument(end) if s[end : end + 1] in "[{" else None
            return end
        if name.startswith("cite") or name == "nocite":
            if arg:
                b.text(f" [{arg[0]}]" if name != "nocite" else "")
            return arg[1] if arg else end
        if name in _SECTIONS and arg:
            b.start("heading" if _SECTIONS[name] < 7 else "para", level=_SECTIONS[name])
            self.parse(arg[0])
            b.end("heading" if _SECTIONS[name] < 7 else "para")
            return arg[1]
        if name in ("footnote", "thanks") and arg:
            b.text(" (")
            self.parse(arg[0])
            b.text(")")
            return arg[1]
        if name in ("href", "textcolor", "texorpdfstring") and arg:
            second = argument(arg[1]) if name != "texorpdfstring" else None
            self.parse(second[0] if second else arg[0])
            return second[1] if second else (argument(arg[1]) or arg)[1] if name == "texorpdfstring" else arg[1]
        if name in ("url", "path", "texttt", "verb") and arg:
            b.text(arg[0])
            return arg[1]
        if name in ("frac", "dfrac", "sqrt", "hat", "bar", "sum", "alpha", "beta", "theta", "nabla", "le", "ge"):
            b.text(m[0])  # a formula without its delimiters stays as it is
            return end
        if arg:
            self.parse(arg[0])
            return arg[1]
        return end

    def environment(self, m, s: str) -> int:
        b, name, end = self.b, m["ename"], m.end()
        if m["edge"] == "begin":
            if name in ("itemize", "enumerate", "description"):
                b.start("list", name, 1 if name == "enumerate" else 0)
            elif name in ("tabular", "tabularx", "array", "longtable"):
                if s[end : end + 1] == "{":
                    end = max(_balanced(s, end), end)
                close = regex.compile(rf"\\end\s*\{{{name}\*?\}}").search(s, end)
                body = s[end : close.start() if close else len(s)]
                b.start("table", name)
                for line in regex.split(r"\\\\(?:\[[^\]]*\])?", regex.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", body)):
                    if line.strip():
                        b.start("row")
                        for cell in regex.split(r"(?<!\\)&", line):
                            b.start("cell")
                            self.parse(cell.strip())
                            b.end("cell")
                        b.end("row")
                b.end(name)
                return close.end() if close else len(s)
            else:
                if name == "thebibliography" and s[end : end + 1] == "{":
                    end = max(_balanced(s, end), end)
                b.start("block", name)
        else:
            b.end(name)
        return end

    def wiki_table(self, body: str) -> None:
        b = self.b
        b.start("table")
        lines = body.split("\n")[1:]
        b.start("row")
        for line in lines:
            line = line.strip()
            if line.startswith("|-"):
                b.start("row")
            elif line.startswith("|+"):
                self.parse(line[2:].strip())
            elif line[:1] in ("|", "!"):
                for cell in regex.split(r"\|\||!!", line[1:]):
                    if "|" in cell and regex.match(r"[^|\[]*=[^|]*\|", cell):
                        cell = cell.split("|", 1)[1]
                    b.start("cell")
                    self.parse(cell.strip())
                    b.end("cell")
            elif line:
                self.parse(line)
        b.end("table")


def _formula(s: str) -> str:
    return regex.sub(r"\s+", " ", regex.sub(r"\\(?:label\{[^}]*\}|nonumber|notag)", "", s)).strip()


def _width(s: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _inline(node: _Node) -> str:
    out = []
    for k in node.kids:
        if isinstance(k, str):
            out.append(k)
        elif not k.hidden:
            out.append(_inline(k))
    return regex.sub(r"\s+", " ", "".join(out)).strip()


def _render(node: _Node, blocks: list[str], buf: list[str]) -> None:
    def flush() -> None:
        text = "".join(buf)
        buf.clear()
        for part in regex.split(r"\n\s*\n", text):
            lines = []
            for raw in part.split("\n"):
                for piece in raw.split("\u2028"):
                    t = regex.sub(r"[^\S\n]+", " ", piece).strip()
                    if t:
                        indent = regex.match(r" *(?=(?:[-*•]|\d{1,3}[.)]) )", piece)
                        lines.append((indent[0] if indent else "") + t)
            if lines:
                blocks.append("\n".join(lines))

    for k in node.kids:
        if isinstance(k, str):
            buf.append(k)
            continue
        if k.hidden:
            continue
        if k.kind == "span":
            _render(k, blocks, buf)
        elif k.kind in ("heading", "formula"):
            flush()
            if t := _inline(k):
                blocks.append(t)
        elif k.kind == "code":
            flush()
            blocks.append("".join(x for x in k.kids if isinstance(x, str)))
        elif k.kind == "list":
            flush()
            lines, n = [], 0
            for item in k.kids:
                if isinstance(item, str):
                    if item.strip():
                        lines.append(regex.sub(r"\s+", " ", item).strip())
                    continue
                if item.hidden:
                    continue
                inner: list[str] = []
                rest: list[str] = []
                _render(item, inner, rest)
                _tail(rest, inner)
                n += 1
                mark = f"{n}. " if k.level else "- "
                body = "\n".join(inner)
                lines.append(mark + body.replace("\n", "\n" + " " * len(mark)))
            if lines:
                blocks.append("\n".join(lines))
        elif k.kind == "table":
            flush()
            loose: list[str] = []
            rows = [[_inline(c) for c in r.kids if isinstance(c, _Node) and not c.hidden] for r in _rows(k, loose)]
            rows = [r for r in rows if r]
            blocks.extend(x for x in loose if x.strip())
            if rows:
                wide = [max(_width(r[i]) for r in rows if i < len(r)) for i in range(max(map(len, rows)))]
                blocks.append("\n".join("  ".join(c + " " * (wide[i] - _width(c)) for i, c in enumerate(r)).rstrip() for r in rows))
        else:
            flush()
            _render(k, blocks, buf)
            flush()
    if node.kind == "root":
        flush()


def _tail(buf: list[str], blocks: list[str]) -> None:
    root = _Node("root")
    root.kids = list(buf)
    _render(root, blocks, [])


def _rows(table: _Node, loose: list[str]) -> Iterator[_Node]:
    for k in table.kids:
        if isinstance(k, str):
            if k.strip():
                loose.append(k.strip())
        elif k.hidden:
            continue
        elif k.kind == "row":
            yield k
        elif k.kind == "cell":
            row = _Node("row")
            row.kids = [k]
            yield row
        else:
            yield from _rows(k, loose)


def source_format(text: str) -> str | None:
    """The one format a whole source is written in; None for plain text."""
    if regex.search(r"\\documentclass|\\begin\s*\{document\}|\\(?:sub)*section\*?\s*[\[{]", text):
        return LATEX
    if regex.search(r"(?i)<!doctype|<html\b|<body\b|<head\b", text) or len(regex.findall(r"(?i)</(?:p|div|h[1-6]|li|td)>", text)) >= 2:
        return HTML
    if regex.search(r"(?m)^={2,6}[^=\n]+={2,6}[ \t]*$|^\{\||'''[^\n]+'''|\[\[[^\]\n]+\]\]", text):
        return WIKI
    if regex.search(r"(?m)^#{1,6} \S|^```|\[[^\]\n]+\]\([^)\n]+\)|\*\*\S[^\n]*?\S\*\*", text):
        return MARKDOWN
    if regex.search(r"\\begin\s*\{[A-Za-z]+\*?\}", text):
        return LATEX
    return None


def _wiki_lists(text: str) -> str:
    return _WIKI_ITEM.sub(lambda m: ("  " * (len(m["m"]) - 1)) + ("1. " if m["m"][-1] == "#" else "- " if m["m"][-1] == "*" else ""), text)


def clean(text: str | None, whole: bool = False) -> tuple[str | None, list[str]]:
    """(clean text, families of markup found, sorted). `whole`: a source in one format, whose other marks are text.

    Null gives null and no family, a blank text ''.
    """
    if text is None:
        return None, []
    allowed, form = frozenset(FAMILIES), ""
    if whole:
        form = source_format(text) or ""
        allowed = frozenset([form]) if form else frozenset()
    p = _Parser(allowed, form)
    if form == LATEX:
        m = regex.search(r"\\begin\s*\{document\}", text)
        if m:
            head = text[: m.start()]
            shown = "".join(f"\\{c}{{{a}}}\n\n" for c in ("title", "author") if (a := _head_argument(head, c)))
            text = shown + text[m.end() :]
            p.seen.add(LATEX)
        text = regex.sub(r"\\end\s*\{document\}.*\Z", "", text, flags=regex.S)
    elif form == WIKI:
        text = _wiki_lists(text)
    p.parse(text)
    blocks: list[str] = []
    _render(p.b.root, blocks, [])
    return "\n\n".join(blocks), sorted(p.seen)


def _head_argument(head: str, command: str) -> str:
    m = regex.search(rf"\\{command}\s*(?:\[[^\]]*\])?\s*\{{", head)
    stop = _balanced(head, m.end() - 1) if m else -1
    return head[m.end() : stop - 1] if stop > 0 else ""


def clean_texts(df: DataFrame, row_id: str, text: str, whole: bool = False) -> DataFrame:
    """(row_id, clean, families) of every row; null texts stay null and have no family. Row by row; only a small table is spread over the cores first."""
    rows = spread(df.select(F.col(row_id).alias("id"), F.col(text).alias("text")), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [clean(t, whole) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "clean": [x for x, _ in made], "families": [y for _, y in made]})

    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, clean string, families array<string>").withColumnRenamed("id", row_id)
