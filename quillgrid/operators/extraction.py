"""Semi-structured captures to typed blocks: LaTeXML-class HTML, and JSON trees of a page-layout model.

A capture is parsed into a small tree and walked once; each block becomes a row. Both walks are Arrow batches
through ``mapInPandas``, one capture at a time, so memory is bounded by the largest capture of a batch.
"""

from __future__ import annotations

import base64
import binascii
import csv
import hashlib
import html
import io
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.operators.library import TRACKED

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes an open element of the values.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"},
}
SCOPES = {"li": {"ul", "ol"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
BLOCKS = frozenset("address article aside blockquote div dl figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None" = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator["Element"]:
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.walk()

    def first(self, *tags: str) -> "Element | None":
        return next((e for e in self.walk() if e.tag in tags), None)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class TreeBuilder(HTMLParser):
    """A forgiving tree: implied ends of p, li, table parts; unclosed elements end with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        at, stop = self.at, SCOPES.get(tag, set())
        while at.parent is not None and at.tag not in stop:
            if at.tag in closes:
                self.at = at.parent
            at = at.parent
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = self.at
        while at.parent is not None:
            if at.tag == tag:
                self.at = at.parent
                return
            at = at.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse_tree(text: str) -> Element:
    builder = TreeBuilder()
    builder.feed(text)
    builder.close()
    return builder.root


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


#: Formulas that came out of the capture at hand, by identity; counted against those it holds.
_MET: set[int] = set()


def tex_of(node: Element) -> str:
    """LaTeX of a math element: alttext, tex, data-semantic-latex, then its TeX annotation, then its text."""
    _MET.add(id(node))
    for name in ("alttext", "tex", "data-semantic-latex"):
        if node.attrs.get(name):
            return node.attrs[name].strip()
    note = next((e for e in node.walk() if e.tag == "annotation" and "tex" in e.attrs.get("encoding", "").lower()), None)
    return squeeze((note or node).text())


def best_source(srcset: str) -> str | None:
    """The candidate of the greatest weight; the first of equal ones."""
    best = None
    for item in srcset.split(","):
        parts = item.split()
        if parts:
            weight = float(re.sub(r"[^\d.]", "", parts[1]) or 1) if len(parts) > 1 else 1.0
            if best is None or weight > best[0]:
                best = (weight, parts[0])
    return best[1] if best else None


def inline_text(node: Element, skip: tuple[str, ...] = (), markdown: bool = False) -> str:
    """Text of a node's inlines; formulas between ``$``; with ``markdown`` also emphasis, code and links."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag in ("script", "style", "noscript") or any(k in skip for k in c.classes) or c.tag in skip:
            continue
        elif c.tag == "math":
            out.append(f"${tex_of(c)}$")
        elif c.tag == "br":
            out.append(" ")
        elif "ltx_note" in c.classes:
            out.append(f"[^{note_mark(c)}]" if markdown else "")
        elif c.tag == "cite" or "ltx_cite" in c.classes:
            keys = [e.attrs["href"].rpartition("#")[2] for e in c.walk() if e.tag == "a" and "#" in e.attrs.get("href", "")]
            label = squeeze(c.text())
            out.append(f"[{', '.join(('@' if markdown else '') + k for k in keys)}]" if keys else label if label.startswith("[") else f"[{label}]")
        elif c.tag in ("sup", "sub") and markdown:
            inner = inline_text(c, skip, markdown).strip()
            out.append(f"<{c.tag}>{inner}</{c.tag}>" if inner else "")
        else:
            inner = inline_text(c, skip, markdown)
            if markdown and inner.strip():
                if c.tag in ("b", "strong"):
                    inner = f"**{inner.strip()}**"
                elif c.tag in ("i", "em"):
                    inner = f"*{inner.strip()}*"
                elif c.tag == "code":
                    inner = code_span(inner)
                elif c.tag == "a" and c.attrs.get("href", "").startswith("http"):
                    inner = f"[{inner.strip()}]({c.attrs['href']})"
            out.append(inner)
    return "".join(out)


def note_mark(note: Element) -> str:
    """The mark that a note shows, or the number it was given."""
    mark = next((e for e in note.walk() if "ltx_note_mark" in e.classes), None)
    return (squeeze(mark.text()) if mark else "") or note.attrs.get("data-number", "")


def number_notes(root: Element) -> None:
    """Notes without a mark are numbered by their place among all notes."""
    for n, note in enumerate((e for e in root.walk() if "ltx_note" in e.classes), 1):
        note.attrs["data-number"] = str(n)


def alignment(classes: list[str]) -> str | None:
    for name, own in (("center", ("ltx_align_center", "ltx_align_middle")), ("right", ("ltx_align_right",)), ("left", ("ltx_align_left",))):
        if any(c in classes for c in own):
            return name
    return None


def code_span(text: str) -> str:
    run = max((len(r) for r in re.findall("`+", text)), default=0)
    fence = "`" * (run + 1)
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def table_cells(table: Element) -> list[list[dict]]:
    """Rows of cells: text, rowspan, colspan, header, align."""
    rows = []
    for tr in (e for e in table.walk() if e.tag == "tr"):
        cells = [c for c in tr.children if isinstance(c, Element) and c.tag in ("td", "th")]
        if cells:
            span = lambda c, n: int(c.attrs.get(n, "1")) if c.attrs.get(n, "1").isdigit() else 1
            in_head = False
            at = tr.parent
            while at is not None and at is not table:
                in_head |= at.tag == "thead"
                at = at.parent
            rows.append(
                [
                    {"text": squeeze(inline_text(c)), "rowspan": max(span(c, "rowspan"), 1), "colspan": max(span(c, "colspan"), 1), "header": c.tag == "th" or in_head, "align": alignment(c.classes)}
                    for c in cells
                ]
            )
    return rows


def expand_table(rows: list[list[dict]]) -> list[list[str]]:
    """The grid of a table with spans: each cell's text stands in every place that it covers, below the last row too."""
    grid: list[dict[int, str]] = []
    for r, row in enumerate(rows):
        while len(grid) <= r:
            grid.append({})
        column = 0
        for cell in row:
            while column in grid[r]:
                column += 1
            for down in range(cell.get("rowspan", 1)):
                while len(grid) <= r + down:
                    grid.append({})
                for right in range(cell.get("colspan", 1)):
                    grid[r + down].setdefault(column + right, cell["text"])
            column += cell.get("colspan", 1)
    width = max((max(g, default=-1) + 1 for g in grid), default=0)
    return [[g.get(k, "") for k in range(width)] for g in grid]


def table_csv(rows: list[list[dict]]) -> str:
    out = io.StringIO()
    csv.writer(out).writerows(expand_table(rows))
    return out.getvalue()


def table_html(rows: list[list[dict]]) -> str:
    lines = ["<table>"]
    for row in rows:
        cells = ""
        for c in row:
            tag = "th" if c.get("header") else "td"
            spans = "".join(f' {n}="{c[n]}"' for n in ("rowspan", "colspan") if c.get(n, 1) > 1)
            cells += f"<{tag}{spans}>{html.escape(c['text'], quote=False)}</{tag}>"
        lines.append(f"<tr>{cells}</tr>")
    return "\n".join([*lines, "</table>"])


def header_rows(rows: list[list[dict]]) -> int:
    """Rows at the top whose cells are all headers."""
    return next((i for i, row in enumerate(rows) if not all(c.get("header") for c in row)), len(rows))


def has_spans(rows: list[list[dict]]) -> bool:
    """Whether the table has spans, or more than one header row, so that it is no plain grid."""
    return header_rows(rows) > 1 or any(c.get("rowspan", 1) > 1 or c.get("colspan", 1) > 1 for row in rows for c in row)


def table_markdown(rows: list[list[dict]]) -> str:
    """A pipe table if it is rectangular, without spans and with at most one header row; else HTML."""
    if not rows or has_spans(rows) or len({len(r) for r in rows}) != 1:
        return table_html(rows)
    rule = {"center": ":---:", "right": "---:", "left": ":---"}
    cell = lambda c: c["text"].replace("|", "\\|").replace("\n", " ")
    line = lambda row: "| " + " | ".join(map(cell, row)) + " |"
    return "\n".join([line(rows[0]), "|" + "".join(rule.get(c.get("align"), "---") + "|" for c in rows[0]), *map(line, rows[1:])])


BLOCK = T.StructType(
    [T.StructField("ordinal", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("kind", "block_id")]
    + [T.StructField("level", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("label", "text", "markdown", "table_csv", "table_html")]
    + [T.StructField("images", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.IntegerType()) for n in ("n_rows", "n_cols", "header_rows")]
    + [T.StructField("has_spans", T.BooleanType())]
)


class Blocks:
    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.used: set[str] = set()

    def add(self, kind: str, wanted: str | None, text: str = "", markdown: str | None = None, **more) -> None:
        name, n = wanted, 0
        while not name or name in self.used:
            n += 1
            name = f"{kind}-{n}"
        self.used.add(name)
        row = dict.fromkeys(BLOCK.names) | {"kind": kind, "block_id": name, "text": text, "markdown": text if markdown is None else markdown, "images": []}
        self.rows.append(row | more | {"ordinal": len(self.rows)})

    def add_table(self, wanted: str | None, rows: list[list[dict]], label: str | None, caption: str) -> None:
        head = " ".join(x for x in (f"**{label}**" if label else "", caption) if x)
        self.add(
            "table", wanted, squeeze(" ".join([caption, *(c["text"] for r in rows for c in r)])),
            "\n\n".join(x for x in (head, table_markdown(rows)) if x), label=label, table_csv=table_csv(rows), table_html=table_html(rows), header_rows=header_rows(rows), has_spans=has_spans(rows),
            n_rows=len(rows), n_cols=max((len(r) for r in rows), default=0),
        )


def _caption(node: Element | None) -> tuple[str | None, str]:
    """(label, text) of a caption; the label is its ``ltx_tag``, without a colon at the end."""
    if node is None:
        return None, ""
    tag = next((e for e in node.walk() if "ltx_tag" in e.classes), None)
    label = re.sub(r"\s*:\s*$", "", squeeze(tag.text())) if tag else None
    return label or None, squeeze(inline_text(node, skip=("ltx_tag",)))


def _list_lines(node: Element, depth: int = 0) -> list[str]:
    lines = []
    items = [c for c in node.children if isinstance(c, Element) and c.tag == "li"]
    for i, item in enumerate(items):
        mark = f"{i + 1}." if node.tag == "ol" else "-"
        lines.append("  " * depth + f"{mark} {squeeze(inline_text(item, skip=('ul', 'ol', 'ltx_tag')))}")
        for sub in item.children:
            if isinstance(sub, Element) and sub.tag in ("ul", "ol"):
                lines += _list_lines(sub, depth + 1)
    return lines


def _equations(table: Element, out: Blocks) -> None:
    """One block per body of an equation table (or per row); the rows of a body are joined."""
    groups = [e for e in table.walk() if e.tag == "tbody"]
    groups = groups if len(groups) > 1 else [e for e in table.walk() if e.tag == "tr"] or [table]
    for g in groups:
        rows = [e for e in g.walk() if e.tag == "tr"] or [g]
        tex = " \\\\\n".join(x for x in (" ".join(tex_of(m) for m in r.walk() if m.tag == "math") for r in rows) if x)
        number = next((squeeze(e.text()) for e in g.walk() if "ltx_eqn_eqno" in e.classes or "ltx_tag_equation" in e.classes), None)
        if tex:
            tagged = tex if not number or "\\tag" in tex else f"{tex} \\tag{{{number.strip('()')}}}"
            out.add("math", g.attrs.get("id") or table.attrs.get("id"), tex, f"$$\n{tagged}\n$$", label=number)


def main_part(root: Element) -> Element | None:
    """The part of a page that holds the paper."""
    main = None
    for test in (
        lambda e: e.tag == "article" and "ltx_document" in e.classes, lambda e: e.tag == "article", lambda e: e.tag == "main",
        lambda e: e.tag == "div" and "ltx_page_content" in e.classes, lambda e: e.tag == "body",
    ):
        main = next((e for e in root.walk() if test(e)), None)
        if main is not None:
            break
    return main


def page_title(root: Element) -> str | None:
    """The document's own title heading, else the page's title without a bracketed beginning."""
    own = next((e for e in root.walk() if e.tag == "h1" and "ltx_title_document" in e.classes), None)
    if own is not None:
        return squeeze(inline_text(own)) or None
    page = root.first("title")
    return (re.sub(r"^\[[^\]]*\]\s*", "", squeeze(page.text())) or None) if page else None


def source_counts(main: Element) -> dict[str, int]:
    """What a page holds of each counted kind."""
    found = dict.fromkeys(TRACKED, 0)

    def look(node: Element, in_figure: bool) -> None:
        for c in node.children:
            if isinstance(c, Element):
                found["math"] += c.tag == "math" and not in_figure
                found["figures"] += c.tag == "figure" and "ltx_table" not in c.classes
                found["tables"] += c.tag == "table" and "ltx_tabular" in c.classes
                found["bibitems"] += c.tag == "li" and "ltx_bibitem" in c.classes
                found["notes"] += c.tag == "span" and "ltx_role_footnote" in c.classes
                look(c, in_figure or c.tag == "figure")

    look(main, False)
    return found


def mapped_counts(main: Element, rows: list[dict]) -> dict[str, int]:
    """What came out of a page; call it right after its blocks were made."""
    kinds = [r["kind"] for r in rows]
    in_figures = {id(m) for f in main.walk() if f.tag == "figure" for m in f.walk() if m.tag == "math"}
    math = {id(m) for m in main.walk() if m.tag == "math"} - in_figures
    named = {"figures": "figure", "tables": "table", "bibitems": "bibliography", "notes": "footnote"}
    return {"math": len(math & _MET)} | {k: kinds.count(v) for k, v in named.items()}


def html_blocks(text: str | None, base_url: str = "") -> list[dict]:
    """Blocks of a page, in order: heading, paragraph, list, code, math, table, figure, footnote, bibliography."""
    root = parse_tree(text or "")
    return blocks_of(main_part(root), base_url)


def blocks_of(main: Element | None, base_url: str = "") -> list[dict]:
    out = Blocks()
    _MET.clear()
    if main is not None:
        number_notes(main)

    def visit(node: Element) -> None:
        name, classes = node.attrs.get("id"), node.classes
        if node.tag in ("script", "style", "noscript", "nav"):
            return
        if re.fullmatch("h[1-6]", node.tag):
            title = squeeze(inline_text(node))
            if title:
                level = int(node.tag[1])
                out.add("heading", name, title, "#" * level + " " + title, level=level)
        elif node.tag == "table" and any(c.startswith("ltx_eqn") or c.startswith("ltx_equation") for c in classes):
            _equations(node, out)
        elif node.tag == "table":
            rows = table_cells(node)
            if rows:
                out.add_table(name, rows, *_caption(node.first("caption")))
        elif node.tag == "figure" and (table := node.first("table")) is not None and "ltx_figure" not in classes:
            out.add_table(name, table_cells(table), *_caption(node.first("figcaption", "caption")))
        elif node.tag == "figure":
            label, caption = _caption(node.first("figcaption"))
            images = []
            for e in node.walk():
                if e.tag in ("img", "object", "embed"):
                    src = best_source(e.attrs.get("srcset", "")) or e.attrs.get("src") or e.attrs.get("data-src") or e.attrs.get("data")
                    if src:
                        images.append(urljoin(base_url, src))
            if images or caption:
                head = " ".join(x for x in (f"**{label}**" if label else "", caption) if x)
                out.add("figure", name, caption, "\n\n".join([*(f"![{caption}]({i})" for i in images), head]).strip(), label=label, images=images)
        elif node.tag in ("ul", "ol") and "ltx_biblist" in classes or "ltx_bibliography" in classes and node.tag != "section":
            for item in (e for e in node.walk() if e.tag == "li"):
                out.add("bibliography", item.attrs.get("id"), squeeze(inline_text(item, skip=("ltx_tag",))), "", label=_caption(item)[0])
        elif node.tag in ("ul", "ol"):
            lines = _list_lines(node)
            if lines:
                out.add("list", name, "\n".join(lines))
        elif node.tag == "pre" or "ltx_listing" in classes:
            code = node.text().strip("\n")
            language = next((c.partition("-")[2] for e in [node, *node.walk()] for c in e.classes if c.startswith("language-")), "")
            fence = "`" * max(3, max((len(r) for r in re.findall("`+", code)), default=0) + 1)
            out.add("code", name, code, f"{fence}{language}\n{code}\n{fence}")
        elif node.tag == "math":
            out.add("math", name, tex_of(node), f"$$\n{tex_of(node)}\n$$")
        elif node.tag == "p" or not any(e.tag in BLOCKS for e in node.walk()):
            plain = squeeze(inline_text(node))
            if plain:
                out.add("paragraph", name, plain, squeeze(inline_text(node, markdown=True)))
            for note in (e for e in node.walk() if "ltx_note" in e.classes):
                body = next((e for e in note.walk() if "ltx_note_content" in e.classes), note)
                said = squeeze(inline_text(body, skip=("ltx_note_mark",)))
                out.add("footnote", note.attrs.get("id"), said, f"[^{note_mark(note)}]: {said}", label=note_mark(note))
        else:
            loose: list = []

            def flush() -> None:
                holder = Element("p", {})
                holder.children = list(loose)
                loose.clear()
                plain = squeeze(inline_text(holder))
                if plain:
                    out.add("paragraph", None, plain, squeeze(inline_text(holder, markdown=True)))

            for c in node.children:
                if isinstance(c, str) or (c.tag not in BLOCKS and not any(e.tag in BLOCKS for e in c.walk()) and c.tag != "math"):
                    loose.append(c)
                else:
                    flush()
                    visit(c)
            flush()

    if main is not None:
        visit(main) if main.tag == "table" else [visit(main)]
    return out.rows


SKIPPED = frozenset("PageHeader PageFooter".split())
HEADINGS = frozenset("SectionHeader Title".split())
TEXTS = frozenset("Text TextInlineMath Handwriting Form ComplexRegion".split())


def layout_blocks(text: str | None) -> list[dict]:
    """Blocks of a layout model's JSON tree; page headers and footers are passed over, groups keep their captions."""
    out = Blocks()
    try:
        root = json.loads(text or "null")
    except ValueError:
        return []

    def kind_of(n: dict) -> str:
        return str(n.get("block_type") or n.get("type") or "")

    def below(n: dict) -> list[dict]:
        return [c for c in n.get("children") or [] if isinstance(c, dict)]

    def plain(n: dict) -> str:
        own = squeeze(inline_text(parse_tree(re.sub(r"<content-ref[^>]*>(?:</content-ref>)?", "", n.get("html") or ""))))
        return own or squeeze(" ".join(plain(c) for c in below(n)))

    def images(n: dict) -> list[str]:
        found = []
        for name, data in (n.get("images") or {}).items():
            try:
                found.append(f"{name}#{hashlib.sha256(base64.b64decode(data, validate=True)).hexdigest()}")
            except (binascii.Error, TypeError, ValueError):
                continue
        return found + [i for c in below(n) for i in images(c)]

    def table_of(n: dict) -> list[list[dict]]:
        for level in ([n], below(n), [g for c in below(n) for g in below(c)]):
            for m in level:
                if "<table" in (m.get("html") or ""):
                    return table_cells(parse_tree(m["html"]))
        return []

    def visit(n: dict, caption: str = "") -> None:
        kind, name = kind_of(n), n.get("id")
        if kind in SKIPPED:
            return
        label = re.match(r"(?i)\s*((?:figure|fig\.?|table)\s*[0-9IVXivx]+)", caption)
        label = label.group(1) if label else None
        if kind in HEADINGS:
            own = [int(k) for k, v in (n.get("section_hierarchy") or {}).items() if v == name and str(k).isdigit()]
            tag = re.search(r"<h([1-6])", n.get("html") or "")
            level = min(max(own[0], 1), 6) if own else int(tag.group(1)) if tag else 2
            out.add("heading", name, plain(n), "#" * level + " " + plain(n), level=level)
        elif kind in ("Table", "TableOfContents"):
            out.add_table(name, table_of(n), label, caption)
        elif kind in ("Figure", "Picture"):
            out.add("figure", name, caption, label=label, images=images(n))
        elif kind == "Equation":
            math = parse_tree(n.get("html") or "").first("math")
            tex = tex_of(math) if math else plain(n)
            out.add("math", name, tex, f"$$\n{tex}\n$$")
        elif kind == "Code":
            code = parse_tree(n.get("html") or "").text().strip("\n")
            out.add("code", name, code, f"```\n{code}\n```")
        elif kind in ("ListGroup",):
            out.add("list", name, "\n".join(f"- {plain(c)}" for c in below(n)))
        elif kind == "Footnote":
            out.add("footnote", name, plain(n), "")
        elif kind in ("FigureGroup", "PictureGroup", "TableGroup"):
            said = squeeze(" ".join(plain(c) for c in below(n) if kind_of(c) == "Caption"))
            for c in below(n):
                if kind_of(c) != "Caption":
                    visit(c, said)
        elif below(n):
            for c in below(n):
                visit(c)
        elif kind in TEXTS or plain(n):
            if plain(n):
                out.add("paragraph", name, plain(n))

    if isinstance(root, dict):
        visit(root)
    return out.rows


def extract(captures: DataFrame, key: str, content: str, source_kind: str = "html", base_url: str | None = None) -> DataFrame:
    """(key, ordinal, kind, block_id, level, label, text, markdown, table_csv, images, n_rows, n_cols).

    Null, empty and unreadable captures give no rows. ``source_kind`` is ``html`` or ``layout``.
    """
    schema = T.StructType([captures.schema[key], *BLOCK.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, c, b in zip(batch["k"], batch["c"], batch["b"]):
                made = html_blocks(c, b or "") if source_kind == "html" else layout_blocks(c)
                rows += [{key: k} | r for r in made]
            frame = pd.DataFrame(rows, columns=schema.names)
            for c in ("level", "n_rows", "n_cols", "header_rows"):
                frame[c] = pd.array(frame[c], dtype="Int32")
            frame["has_spans"] = pd.array(frame["has_spans"], dtype="boolean")
            yield frame

    base = F.col(base_url) if base_url else F.lit("")
    return captures.select(F.col(key).alias("k"), F.col(content).alias("c"), base.alias("b")).mapInPandas(run, schema)


COVERAGE = "source_counts map<string,int>, mapped_counts map<string,int>, unmapped array<struct<kind:string,missing:int>>"


def page_reports(captures: DataFrame, key: str, content: str) -> DataFrame:
    """(key, title, n_blocks, content_chars, ir_available, source_counts, mapped_counts, unmapped) of each HTML capture.

    What is counted in the page and missing among the blocks stands in ``unmapped``. A null or empty capture has no
    blocks and ``ir_available`` false.
    """
    schema = f"title string, n_blocks long, content_chars long, ir_available boolean, {COVERAGE}"
    schema = T.StructType([captures.schema[key], *T._parse_datatype_string(schema).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["k"], batch["c"]):
                root = parse_tree(text or "")
                main = main_part(root)
                made = blocks_of(main)
                source = source_counts(main) if main is not None else dict.fromkeys(TRACKED, 0)
                mapped = mapped_counts(main, made) if main is not None else dict.fromkeys(TRACKED, 0)
                missing = [{"kind": t, "missing": source[t] - mapped[t]} for t in TRACKED if source[t] > mapped[t]]
                rows.append((k, page_title(root), len(made), sum(len(r["text"] or "") for r in made), main is not None, source, mapped, missing))
            yield pd.DataFrame(rows, columns=schema.names)

    return captures.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(run, schema)


def render(blocks: DataFrame, key: str, column: str = "markdown") -> DataFrame:
    """(key, document): the blocks of each capture in order, parted by blank lines."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col(column).alias("m")))), lambda b: b["m"])
    return blocks.where(F.col(column) != "").groupBy(key).agg(F.concat(F.array_join(parts, "\n\n"), F.lit("\n")).alias("document"))
