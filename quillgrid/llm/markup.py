"""Markup residue in text: found, described by wrappers, and converted to clean text.

Method: union-free regular-expression inference. A lexer turns each text into a stream of markup tokens and
text slots, in which repeats are folded. The distinct streams of one host (a paper, a record), whatever marks they use, are
aligned one after the other, in the order of their signs, with the host's wrappers: slots match any text, a token that only one
side has becomes an optional group, a group that one side repeats becomes a repeated group. A stream that can't be aligned
without a union starts a wrapper of its own. What an alignment makes covers both sides group by group, so a wrapper matches all
streams that made it. A host of very many streams is aligned in chunks, whose wrappers are aligned with each other in turn.
The wrappers are then joined back to the texts: texts whose wrapper holds markup are cases, and what the wrapper's
slots match in them is their content. Wrappers depend on the streams alone, not on partitions or batches.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.operators import nested
from quillgrid.session import cut_lineage

# Element names of HTML and MathML, and of wiki extensions.
HTML_NAMES = """a abbr address annotation article aside audio b base bdi bdo big blockquote body br button canvas
caption center cite code col colgroup data dd del details dfn div dl dt em embed fieldset figcaption figure font
footer form frame gallery h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main
map mark math menclose merror mfenced mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle
msub msubsup msup mtable mtd mtext mtr munder munderover meta nav nobr noscript nowiki object ol onlyinclude
option p param picture pre q ref references rp rt ruby s samp script section select semantics small source span
strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u
ul var video wbr""".split()
# Commands of LaTeX text that take no argument, or whose argument may be left out.
BARE_COMMANDS = """item noindent par centering maketitle newpage clearpage pagebreak newline linebreak hline toprule
midrule bottomrule bigskip medskip smallskip hfill vfill ldots dots textellipsis textbackslash textasciitilde
LaTeX TeX itshape bfseries scshape ttfamily sffamily small footnotesize large Large appendix tableofcontents
quad qquad indent protect xspace""".split()

TAG = rf"(?i:</?(?:{'|'.join(sorted(HTML_NAMES, key=len, reverse=True))})(?![\w-])(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=`]+)|\s+(?:hidden|disabled|checked|nowrap|controls|reversed))*\s*/?>)|<!--.*?-->|<!DOCTYPE[^>]*>"
ENTITY = r"&(?:\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"

#: Alternatives in order of preference; the first name is the token's class.
LEXICON = [
    ("formula", r"(?<![\\$])\$(?!\$)(?:[^$\\\n]|\\.)+?(?<!\\)\$(?!\$)"),
    ("tag", TAG),
    ("entity", ENTITY),
    ("display", r"\$\$|(?<!\\)\\[\[\]()](?!\w*\\)"),
    ("fence", r"(?m:^[ \t]*(?:```|~~~)[\w+-]*[ \t]*$)"),
    ("wikitable", r"(?m:^\{\|[^\n]*$|^\|\}|^\|-[^\n]*$|^[|!][^\n]*(?:\|\||!!)[^\n]*$)"),
    ("wikilink", r"\[\[[^\[\]\n]+\]\]"),
    ("template", r"\{\{[^{}]+\}\}"),
    ("wikihead", r"(?m:^(?P<eqs>={2,6})[ \t]*[^=\n][^\n]*?[ \t]*(?P=eqs)[ \t]*$)"),
    ("wikiemph", r"'{2,5}(?=[^'\s])|(?<=[^'\s])'{2,5}"),
    ("wikiurl", r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t][^\]\n]*)?\]"),
    ("magic", r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|NOINDEX)__|(?i:\#REDIRECT\b)"),
    ("image", r"!\[[^\]\n]*\]\([^()\s]*(?:\s+\"[^\"]*\")?\)"),
    ("link", r"\[[^\[\]\n]+\]\([^()\s]+(?:\s+\"[^\"]*\")?\)"),
    ("reflink", r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]|(?m:^\[[^\]\n]+\]:[ \t]*\S+)"),
    ("note", r"\[\^[^\]\s]+\]:?"),
    ("autolink", r"<(?:https?://|mailto:)[^<>\s]+>"),
    ("head", r"(?m:^[ \t]{0,3}\#{1,6}[ \t]+(?=\S))"),
    ("underline", r"(?m:(?<=\n)(?:={3,}|-{3,})[ \t]*$)"),
    ("rule", r"(?m:^[ \t]*(?:\*[ \t]*){3,}$|^[ \t]*(?:_[ \t]*){3,}$|^-{3,}[ \t]*$)"),
    ("quote", r"(?m:^[ \t]{0,3}>+[ \t]+(?=\S))"),
    ("piperow", r"(?m:^[ \t]*\|[^\n]*\|[ \t]*$)|(?m:^[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+$)"),
    ("attribute", r"\{[\#.][A-Za-z][\w:.-]*(?:\s+[\#.][\w:.-]+)*\}"),
    ("task", r"(?m:^[ \t]*[-*+][ \t]+\[[ xX]\][ \t])"),
    ("strike", r"~~(?=\S)[^~\n]+?(?<=\S)~~"),
    ("strong", r"(?<![\w*])(?P<stars>\*{2,3})(?=[^\s*])[^*\n]+?(?<=[^\s*])(?P=stars)(?![\w*])|(?<![\w_])__(?=[^\s_])(?!(?:init|main|name|file|call|repr|str|len|iter|next|enter|exit|new|del|all|doc|dict|class|slots|version|getattr|setattr|eq|hash)__)[^_\n]*[^\s_]__(?![\w_])"),
    ("emph", r"(?<![\w*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_\\/])_(?=[^\s_])[^_\n]*[^\s_]_(?![\w_/])"),
    ("code", r"(?<!`)`(?=[^`\s])[^`\n]*`(?!`)"),
    ("texquote", r"``(?=[^\s`])|(?<=\w)''"),
    ("environment", r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?"),
    ("command", r"~?\\[A-Za-z]+\*?(?:\[[^\]\n]*\])*\{"),
    ("bare", rf"\\(?:{'|'.join(sorted(BARE_COMMANDS, key=len, reverse=True))})(?![A-Za-z\\:/.])"),
    ("escape", r"(?<![\\\w:])\\[%&_#{}$](?!\w*\\)|(?<=\w)\\[%&_#$](?!\w*\\)|(?<!\\)\\\\(?=[ \t]*(?:\n|$))"),
    ("tie", r"(?<=[A-Za-z.])~(?=[\dA-Z\\(])"),
]
LEXER = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in LEXICON), re.S)
INSIDE_FORMULA = re.compile(f"(?P<tag>{TAG})|(?P<entity>{ENTITY})", re.S)
TEX = re.compile(
    rf"(?P<skip>\\\\(?:\[[^\]]*(?:pt|em|ex|mm|cm)\])?)|(?P<tag>{TAG})|(?P<entity>{ENTITY})"
    r"|(?P<number>\\(?:tag\*?|label|nonumber|notag|eqno|leqno|ref|eqref|numberwithin)(?![A-Za-z]))"
    r"|(?P<delimiter>\\[()\[\]]|(?<!\\)\$\$?)"
    r"|(?P<outer>\\(?:begin|end)\{(?:equation|align|gather|multline|eqnarray|flalign|alignat|xalignat|displaymath|math|dmath)\*?\})",
    re.S,
)
#: What a token of each kind must hold, in Java's syntax; the JVM leaves out texts without any.
NEEDED = {
    "tag": [r"<[A-Za-z/!]"],
    "entity": [r"&[#A-Za-z]\w*;"],
    "display": [r"\$\$", r"\\[\[\]()]"],
    "fence": [r"```", r"~~~"],
    "wikitable": [r"^\{\|", r"^\|[}-]", r"^[|!][^\n]*(?:\|\||!!)"],
    "wikilink": [r"\[\["],
    "template": [r"\{\{"],
    "wikihead": [r"^=="],
    "wikiemph": [r"''"],
    "wikiurl": [r"\[(?:https?|ftp):"],
    "magic": [r"__[A-Z]", r"#[rR][eE][dD][iI][rR]"],
    "image": [r"\]\("],
    "link": [r"\]\("],
    "reflink": [r"\]\[", r"^\[[^\]\n]+\]:"],
    "note": [r"\[\^"],
    "autolink": [r"<(?:https?:|mailto:)"],
    "head": [r"^[ \t]{0,3}#{1,6}[ \t]"],
    "underline": [r"^(?:={3}|-{3})"],
    "rule": [r"^[ \t]*(?:\*[ \t]*){3}", r"^[ \t]*(?:_[ \t]*){3}", r"^-{3}"],
    "quote": [r"^[ \t]{0,3}>"],
    "piperow": [r"^[ \t]*\|", r"^[ \t]*:?-{3,}:?[ \t]*\|"],
    "attribute": [r"\{[#.][A-Za-z]"],
    "task": [r"^[ \t]*[-*+][ \t]+\[[ xX]\]"],
    "strike": [r"~~"],
    "strong": [r"\*\*[^\s*]", r"__[^\s_]"],
    "emph": [r"\*(?<![\w*\\]\*)[^\s*]", r"_(?<![\w\\/]_)[^\s_]"],
    "code": [r"`[^`\s]"],
    "texquote": [r"``", r"''"],
    "environment": [r"\\(?:begin|end)"],
    "command": [r"\\[A-Za-z]"],
    "bare": [r"\\[A-Za-z]"],
    "escape": [r"\\[%&_#{}$\\]"],
    "tie": [r"~(?<=[A-Za-z.]~)[\p{Nd}A-Z\\(]"],
}
_ALL = list(dict.fromkeys(x for xs in NEEDED.values() for x in xs))
#: What may stand anywhere, and what must begin a line. Only where the first sign fits are the alternatives tried.
SUSPECT = r"(?=[<&$\\`~\[\]{'_#*])(?:" + "|".join(x for x in _ALL if x[0] != "^") + ")"
SUSPECT_LINE = r"(?m)^(?=[ \t]*[|!=#>*_:+\[{-])(?:" + "|".join(x[1:] for x in _ALL if x[0] == "^") + ")"
#: Where the end of a token that begins before a formula may lie within it.
SUSPECT_END = r"(?m)\]\(|\]\[|^\[[^\]\n]+\]:|^![^\n]*!!"
#: The same for formulas, and for tex fields.
SUSPECT_FORMULA = r"<[A-Za-z/!]|&[#A-Za-z]\w*;"
SUSPECT_TEX = SUSPECT_FORMULA + r"|\$|\\(?:[\[\]()]|tag|label|no|eq|leqno|ref|numberwithin|begin|end)"
FORMULA = r"</?[A-Za-z!]|&[#A-Za-z]\w*;"
SUSPECT_TEX = SUSPECT_FORMULA + r"|\$|\\(?:[\[\]()]|tag|label|no|eq|leqno|ref|numberwithin|begin|end)"
FORMULA = r"(?<![\\$])\$(?!\$)(?:[^$\\\n]|\\.)+?(?<!\\)\$(?!\$)"

TEXT = "·"


def _is_entity(token: str) -> bool:
    return token[1] == "#" or token[1:] in html.entities.html5


@dataclass
class Token:
    kind: str
    start: int
    end: int
    #: How the token looks in a wrapper.
    label: str


def _label(kind: str, token: str) -> str:
    if kind == "tag":
        m = re.match(r"</?[A-Za-z][\w]*", token)
        return m.group().lower() + ">" if m else "<!>"
    if kind in ("environment", "command", "bare"):
        return re.sub(r"\[[^\]]*\]", "", token.strip("~"))
    if kind == "entity":
        return "&;"
    return f"[{kind}]"


def tokens_of_text(text: str) -> list[Token]:
    """Markup tokens of a block's text; formulas, citations, comparisons, paths and identifiers are none."""
    found: list[Token] = []
    for m in LEXER.finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind == "formula":
            found += [
                Token(x.lastgroup, m.start() + x.start(), m.start() + x.end(), _label(x.lastgroup, x.group()))
                for x in INSIDE_FORMULA.finditer(token)
                if x.lastgroup != "entity" or _is_entity(x.group())
            ]
        elif kind != "entity" or _is_entity(token):
            found.append(Token(kind, m.start(), m.end(), _label(kind, token)))
    return found


def tokens_of_tex(tex: str) -> list[Token]:
    """Tokens of a tex field that are no part of its formula."""
    return [
        Token(m.lastgroup, m.start(), m.end(), _label(m.lastgroup, m.group()) if m.lastgroup in ("tag", "entity") else m.group())
        for m in TEX.finditer(tex)
        if m.lastgroup != "skip" and (m.lastgroup != "entity" or _is_entity(m.group()))
    ]


def stream(text: str, tokens: list[Token]) -> tuple[str, ...]:
    """Labels of the tokens, with a slot wherever text stands between them."""
    out, at = [], 0
    for t in tokens:
        if text[at : t.start].strip():
            out.append(TEXT)
        out.append(t.label)
        at = max(at, t.end)
    if text[at:].strip():
        out.append(TEXT)
    return tuple(out)


@dataclass(frozen=True)
class Group:
    """Part of a wrapper: a sequence of labels that stands once, may be missing, or may be repeated."""

    labels: tuple[str, ...]
    optional: bool = False
    repeated: bool = False

    def __str__(self) -> str:
        body = " ".join(self.labels)
        if self.repeated:
            return f"({body})" + ("*" if self.optional else "+")
        return f"({body})?" if self.optional else body


Wrapper = tuple[Group, ...]


def fold_repeats(labels: tuple[str, ...], longest: int = 6) -> Wrapper:
    """Runs of the same sequence become repeated groups, the shortest sequence first."""
    out: list[Group] = []
    i = 0
    while i < len(labels):
        for k in range(1, longest + 1):
            unit = labels[i : i + k]
            n = 1
            while len(unit) == k and labels[i + n * k : i + (n + 1) * k] == unit:
                n += 1
            if n > 1 and unit != (TEXT,):
                out.append(Group(unit, repeated=True))
                i += n * k
                break
        else:
            out.append(Group((labels[i],)))
            i += 1
    return tuple(out)


def align(wrapper: Wrapper, labels: Wrapper, most_gaps: int = 3) -> Wrapper | None:
    """The wrapper that also covers ``labels``, a stream or another wrapper; None if that would need a union.

    Both are walked together. Equal groups stay; groups that differ in repetition only become repeated; a
    group that the other side lacks becomes optional, which is sought for on both sides; two different
    tokens at the same place, with neither found further on, need a union. So the groups of either side stand in the result in
    their order, no less optional or repeated, and all others are optional: it matches whatever either side matches.
    """
    out: list[Group] = []
    i = j = gaps = 0
    while i < len(wrapper) or j < len(labels):
        a = wrapper[i] if i < len(wrapper) else None
        b = labels[j] if j < len(labels) else None
        if a and b and a.labels == b.labels:
            out.append(Group(a.labels, a.optional or b.optional, a.repeated or b.repeated))
            i, j = i + 1, j + 1
            continue
        if a and a.optional and not (b and any(g.labels == b.labels for g in wrapper[i:])):
            out.append(a)
            i += 1
            continue
        if b and b.optional and not (a and any(g.labels == a.labels for g in labels[j:])):
            out.append(b)
            j += 1
            continue
        skip_a = next((k for k in range(i, len(wrapper)) if b and wrapper[k].labels == b.labels), None)
        skip_b = next((k for k in range(j, len(labels)) if a and labels[k].labels == a.labels), None)
        if skip_a is not None and (skip_b is None or skip_a - i <= skip_b - j):
            out += [Group(g.labels, True, g.repeated) for g in wrapper[i:skip_a]]
            gaps, i = gaps + 1, skip_a
        elif skip_b is not None:
            out += [Group(g.labels, True, g.repeated) for g in labels[j:skip_b]]
            gaps, j = gaps + 1, skip_b
        elif a is None or b is None:
            out += [Group(g.labels, True, g.repeated) for g in (*wrapper[i:], *labels[j:])]
            gaps, i, j = gaps + 1, len(wrapper), len(labels)
        elif a.labels == (TEXT,):
            out.append(Group(a.labels, True, a.repeated))
            i += 1
        elif b.labels == (TEXT,):
            out.append(Group(b.labels, True, b.repeated))
            j += 1
        else:
            return None
        if gaps > most_gaps:
            return None
    return tuple(out)


class Matcher:
    """A wrapper as a regular expression over labels, each written as one private-use sign."""

    def __init__(self, wrapper: Wrapper):
        self.signs: dict[str, str] = {}
        parts = []
        for g in wrapper:
            body = "".join(self.signs.setdefault(x, chr(0xF0000 + len(self.signs))) for x in g.labels)
            mark = ("*" if g.optional else "+") if g.repeated else "?" if g.optional else ""
            parts.append(f"(?:{body}){mark}" if mark else body)
        self.pattern = re.compile("".join(parts))

    def slots(self, labels: tuple[str, ...]) -> list[int] | None:
        """Places of the labels that stand in slots of the wrapper; None if the wrapper doesn't match them."""
        if any(x not in self.signs for x in labels):
            return None
        if not self.pattern.fullmatch("".join(self.signs[x] for x in labels)):
            return None
        return [i for i, x in enumerate(labels) if x == TEXT]


def unfolded(wrapper: Wrapper) -> tuple[str, ...]:
    """A stream that folds to these groups: repeated ones twice."""
    return tuple(x for g in wrapper for x in g.labels * (2 if g.repeated else 1))


def written(wrapper: Wrapper) -> str:
    """A line that :func:`read_wrapper` reads again: groups by tabs, labels by blanks, a sign before each group."""
    return "\t".join(" ?+*"[g.optional + 2 * g.repeated] + "\x1f".join(g.labels) for g in wrapper)


def read_wrapper(line: str) -> Wrapper:
    kinds = {" ": (False, False), "?": (True, False), "+": (False, True), "*": (True, True)}
    return tuple(Group(tuple(g[1:].split("\x1f")), *kinds[g[0]]) for g in line.split("\t"))


@dataclass
class Wrappers:
    """The wrappers of one host, grown stream by stream, or from other wrappers of the host."""

    found: list[Wrapper] = field(default_factory=list)
    place: dict[Wrapper, int] = field(default_factory=dict)
    marks: list[set[str]] = field(default_factory=list)

    def add_folded(self, folded: Wrapper) -> int:
        """Place a folded stream or a wrapper; a wrapper takes it only if what it then is matches it."""
        if folded not in self.place:
            marks = {x for g in folded for x in g.labels if x != TEXT}
            for k, wrapper in enumerate(self.found):
                if marks & self.marks[k]:
                    grown = align(wrapper, folded)
                    if grown is not None and Matcher(grown).slots(unfolded(folded)) is not None:
                        self.found[k] = grown
                        self.marks[k] |= marks
                        self.place[folded] = k
                        break
            else:
                self.found.append(folded)
                self.marks.append(marks)
                self.place[folded] = len(self.found) - 1
        return self.place[folded]

    def add(self, labels: tuple[str, ...]) -> int:
        return self.add_folded(fold_repeats(labels))

    def describe(self, k: int) -> str:
        return " ".join(map(str, self.found[k]))


_HEAD = re.compile(r"\\(?:sub)*section\*?\{$|\\(?:chapter|paragraph)\*?\{$")


def clean_text(text: str, tokens: list[Token]) -> str:
    """The text without its markup: headings keep ``#`` marks, list items ``-``, code and formulas their signs."""
    out, at, depth = [], 0, 0
    closing: list[str] = []

    def plain(piece: str) -> str:
        nonlocal depth
        if not closing:
            return piece
        kept = []
        for c in piece:
            if c == "{":
                depth += 1
            elif c == "}" and depth:
                depth -= 1
            elif c == "}" and closing:
                c = closing.pop()
            kept.append(c)
        return "".join(kept)

    for t in tokens:
        if t.start < at:
            continue
        out.append(plain(text[at : t.start]))
        token = text[t.start : t.end]
        at = t.end
        if t.kind == "entity":
            out.append(html.unescape(token).replace("\u00a0", " "))
        elif t.kind == "tag":
            name = t.label.strip("</>")
            if name in ("br", "p", "div", "tr", "ul", "ol", "table", "blockquote", "pre", "section"):
                out.append("\n")
            elif name == "li" and t.label[1] != "/":
                out.append("\n- ")
            elif re.fullmatch(r"h[1-6]", name):
                out.append("\n" + "#" * int(name[1]) + " " if t.label[1] != "/" else "\n")
            elif name in ("td", "th"):
                out.append(" ")
            elif name == "code":
                out.append("`")
        elif t.kind == "wikihead":
            marks = re.match("=+", token).group()
            out.append("#" * len(marks) + " " + token.strip().strip("=").strip())
        elif t.kind == "wikilink":
            target = token[2:-2]
            out.append("" if re.match(r"(?i)(?:file|image|category):", target) else target.split("|")[-1])
        elif t.kind in ("link", "image", "reflink"):
            m = re.match(r"!?\[([^\]]*)\]", token)
            out.append(m.group(1) if m and not token.startswith("[^") and "]:" not in token else "")
        elif t.kind == "wikiurl":
            out.append(token[1:-1].partition(" ")[2])
        elif t.kind in ("strong", "emph", "strike"):
            out.append(token.strip("*_~"))
        elif t.kind == "autolink":
            out.append(token[1:-1])
        elif t.kind in ("code", "fence", "head"):
            out.append(token)
        elif t.kind == "piperow":
            out.append("" if re.fullmatch(r"[\s|:-]+", token) else " ".join(c.strip() for c in token.strip(" |").split("|")))
        elif t.kind == "wikitable" and re.match(r"[|!](?![-}])", token):
            out.append(" ".join(c.strip() for c in re.split(r"\|\||!!|^[|!]", token) if c.strip()))
        elif t.kind == "texquote":
            out.append('"')
        elif t.kind == "tie":
            out.append(" ")
        elif t.kind == "escape":
            out.append(token.strip("\\"))
        elif t.kind == "task":
            out.append("- ")
        elif t.kind == "command":
            if _HEAD.search(token):
                out.append("# ")
                closing.append("\n")
            elif re.match(r"~?\\(?:cite|ref|eqref|label|autoref|pageref|footcite|includegraphics|bibliography|usepackage)", token):
                m = re.compile(r"[^{}]*\}").match(text, at)
                at = m.end() if m else at
            else:
                closing.append("")
        elif t.kind == "bare":
            out.append("- " if token == r"\item" else "")
    out.append(plain(text[at:]))
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", "".join(out))).strip()


def clean_tex(tex: str, tokens: list[Token]) -> str:
    """The formula alone: tags, delimiters, outer environments, numbers and labels dropped, entities resolved."""
    tex = re.sub(r"\\(?:tag\*?|label|ref|eqref)\s*\{[^{}]*\}|\\(?:nonumber|notag)(?![A-Za-z])", "", tex)
    out, at = [], 0
    for t in tokens_of_tex(tex):
        out.append(tex[at : t.start])
        out.append(html.unescape(tex[t.start : t.end]) if t.kind == "entity" else "")
        at = t.end
    out.append(tex[at:])
    return "".join(out).replace("\u00a0", " ").strip()


NAMES = ("source_table", "owner_key", "item_id")
STREAMED = T.StructType(
    [T.StructField(n, T.StringType()) for n in NAMES]
    + [T.StructField("is_tex", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("folded", T.StringType())]
)
WRAPPED = T.StructType([T.StructField(n, T.StringType()) for n in ("source_table", "owner_key", "folded", "wrapper")])
CLEANED = T.StructType([T.StructField(n, T.StringType()) for n in (*NAMES, "wrapper", "clean_text")] + [T.StructField("n_markup", T.IntegerType())])


def _lex(tex: bool, text: str) -> list[Token]:
    return tokens_of_tex(text) if tex else tokens_of_text(text)


def _streams(keep_text: bool):
    """The folded stream of each text; null for a text without markup."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            folded = []
            for tex, text in zip(batch["is_tex"], batch["text"]):
                tokens = _lex(tex, text)
                folded.append(written(fold_repeats(stream(text, tokens))) if tokens else None)
            yield batch.assign(text=batch["text"] if keep_text else None, folded=folded)

    return run


#: Distinct streams, or wrappers, of one host that are aligned at once; more are dealt out by hash.
CHUNK = 2_000
#: Part of a host's wrappers that may be left after a round; if more are left, the next round takes the host's wrappers as they come, at once.
LEFT = 0.9
HOST = ["source_table", "owner_key"]


def _infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wrappers of the groups (host, chunk), whose streams come sorted, one group after the other."""
    group, lines = None, []

    def grown() -> pd.DataFrame:
        wrappers = Wrappers()
        placed = [wrappers.add_folded(read_wrapper(x)) for x in lines]
        shown = [written(x) for x in wrappers.found]
        return pd.DataFrame([(group[0], group[1], x, shown[k]) for x, k in zip(lines, placed)], columns=WRAPPED.names)

    for batch in batches:
        made = []
        for table, owner, chunk, line in zip(*(batch[c] for c in (*HOST, "chunk", "folded"))):
            if (table, owner, chunk) != group:
                if lines:
                    made.append(grown())
                group, lines = (table, owner, chunk), []
            lines.append(line)
        if made:
            yield pd.concat(made)
    if lines:
        yield grown()


def _aligned(lines: DataFrame, hosts: DataFrame) -> DataFrame:
    """(source_table, owner_key, folded, wrapper) of ``lines``, aligned within as many chunks as ``hosts`` names for their host; 1 if none."""
    chunk = F.pmod(F.xxhash64("folded"), F.coalesce("chunks", F.lit(1)).cast("long"))
    dealt = lines.join(hosts.select(*HOST, "chunks"), HOST, "left").withColumn("chunk", chunk)
    keys = [*HOST, "chunk"]
    return dealt.select(*keys, "folded").repartition(*keys).sortWithinPartitions(*keys, "folded").mapInPandas(_infer, WRAPPED)


def infer_wrappers(streamed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(source_table, owner_key, folded, wrapper) of every distinct stream with markup.

    Only distinct streams are shuffled. All streams of a host are aligned with each other: those of a host with more than ``chunk`` are
    dealt out by hash, and then the wrappers of its chunks in their turn, round by round, until one chunk holds them all. So no task
    gathers a large host's streams; all of it follows from the streams.
    """
    lines = cut_lineage(
        streamed.where(F.col("folded").isNotNull()).select("source_table", F.coalesce("owner_key", F.lit("\x00")).alias("owner_key"), "folded").distinct()
    )
    number = F.count(F.lit(1)).alias("n")
    large = cut_lineage(lines.groupBy(*HOST).agg(number).where(F.col("n") > chunk).withColumn("chunks", F.ceil(F.col("n") / chunk)))
    done = _aligned(lines, large)
    if large.isEmpty():
        return done
    done = cut_lineage(done)
    while not large.isEmpty():
        parts = cut_lineage(done.join(large.select(*HOST), HOST, "left_semi").select(*HOST, F.col("wrapper").alias("folded")).distinct())
        left = parts.groupBy(*HOST).agg(number).join(large.select(*HOST, F.col("n").alias("before")), HOST)
        chunks = F.when(F.col("n") > LEFT * F.col("before"), 1).otherwise(F.ceil(F.col("n") / chunk)).alias("chunks")
        dealt = cut_lineage(left.select(*HOST, "n", chunks))
        merged = _aligned(parts, dealt).select(*HOST, F.col("folded").alias("wrapper"), F.col("wrapper").alias("merged"))
        done = cut_lineage(done.join(merged, [*HOST, "wrapper"], "left").select(*HOST, "folded", F.coalesce("merged", "wrapper").alias("wrapper")))
        large = dealt.where("chunks > 1")
    return done


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple[Wrapper, Matcher, str]] = {}
    for batch in batches:
        rows = []
        for table, owner, item, tex, text, line in zip(*(batch[c] for c in (*NAMES, "is_tex", "text", "wrapper"))):
            if line is None:
                rows.append((table, owner, item, TEXT, text, 0))
                continue
            if line not in known:
                if len(known) > 100_000:
                    known.clear()
                wrapper = read_wrapper(line)
                known[line] = (wrapper, Matcher(wrapper), " ".join(map(str, wrapper)))
            wrapper, matcher, shown = known[line]
            tokens = _lex(tex, text)
            labels = stream(text, tokens)
            slots = matcher.slots(labels)
            # What isn't matched by a slot is markup; a text that its wrapper didn't match would have lost its content.
            if slots is None:
                raise ValueError(f"wrapper {shown} doesn't match a text that it was made from")
            rows.append((table, owner, item, shown, (clean_tex if tex else clean_text)(text, tokens), len(labels) - len(slots)))
        yield pd.DataFrame(rows, columns=CLEANED.names)


def _with_wrappers(streamed: DataFrame, wrappers: DataFrame) -> DataFrame:
    owner = F.coalesce("owner_key", F.lit("\x00"))
    named = wrappers.select(F.col("source_table").alias("w_table"), F.col("owner_key").alias("w_owner"), F.col("folded").alias("w_folded"), "wrapper")
    on = (F.col("source_table") == F.col("w_table")) & (owner == F.col("w_owner")) & (F.col("folded") == F.col("w_folded"))
    return streamed.join(named, on, "left").drop("w_table", "w_owner", "w_folded")


def texts_of_library(blocks: DataFrame, equations: DataFrame, ir_documents: DataFrame) -> DataFrame:
    """(source_table, owner_key, item_id, is_tex, text) of everything that may hold residue.

    Code blocks, null texts and texts without any trait that markup must have are left out in the JVM; a
    block of unknown kind is taken as prose.
    """

    def rows(df: DataFrame, source: str, owner: Column, item: Column, tex: bool, text: Column) -> DataFrame:
        return df.select(
            F.lit(source).alias("source_table"),
            owner.cast("string").alias("owner_key"),
            item.cast("string").alias("item_id"),
            F.lit(tex).alias("is_tex"),
            text.alias("text"),
        )

    prose = blocks.where(~F.col("kind").eqNullSafe("code"))
    flat = nested.flatten_documents(ir_documents, "record_id", "doc_json")
    inline = flat.where((F.col("target") == "inline") & F.col("node").contains('"tex"'))
    tex = F.get_json_object("node", "$.tex")
    unlike = F.regexp_replace("text", FORMULA, "·")
    return (
        rows(prose, "blocks", F.col("paper_key"), F.col("id"), False, F.col("text"))
        .unionByName(rows(equations, "equations", F.col("paper_key"), F.col("id"), True, F.col("tex")))
        .unionByName(rows(inline, "ir_documents", F.col("record_id"), F.col("node_path"), True, tex))
        .where(
            F.when(F.col("is_tex"), F.col("text").rlike(SUSPECT_TEX))
            .when(
                F.col("text").contains("$"),
                unlike.rlike(SUSPECT) | unlike.rlike(SUSPECT_LINE) | F.col("text").rlike(SUSPECT_FORMULA) | F.col("text").rlike(SUSPECT_END),
            )
            .otherwise(F.col("text").rlike(SUSPECT) | F.col("text").rlike(SUSPECT_LINE))
        )
    )



def clean_library(texts: DataFrame) -> DataFrame:
    """(source_table, owner_key, item_id, wrapper, clean_text, n_markup) of every text given.

    Texts are lexed where they are read; the distinct streams of a host make its wrappers, which are joined back. Texts without
    markup have the wrapper ``·`` and stay as they are; repeated rows are given as often as they come.
    """
    streamed = cut_lineage(texts.mapInPandas(_streams(True), STREAMED))
    return _with_wrappers(streamed, infer_wrappers(streamed)).mapInPandas(_clean, CLEANED)


def found(blocks: DataFrame, equations: DataFrame, ir_documents: DataFrame) -> DataFrame:
    """(source_table, owner_key, item_id) of the texts whose wrapper holds markup; repeats come out once."""
    texts = texts_of_library(blocks, equations, ir_documents)
    streamed = cut_lineage(texts.mapInPandas(_streams(False), STREAMED).drop("text").where(F.col("folded").isNotNull()).distinct())
    marked = F.exists(F.split("wrapper", "[\t\x1f]"), lambda x: F.regexp_replace(x, "^[ ?+*]", "") != TEXT)
    wrappers = infer_wrappers(streamed).select(*HOST, "folded", marked.alias("wrapper"))
    return _with_wrappers(streamed, wrappers).where("wrapper").select(*NAMES).distinct()
