import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import bibtex, text, urls
from quillgrid.operators import extraction, library, outline, search
from quillgrid.sources import manifests, records


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "url, kind, value",
    [
        ("https://arxiv.org/abs/2301.00001v2", "arxiv", "2301.00001"),
        ("http://arxiv.org/pdf/2301.00001.pdf#p", "arxiv", "2301.00001"),
        ("https://arxiv.org/abs/hep-th/9901001", "arxiv", "hep-th/9901001"),
        ("https://doi.org/10.1000/AbC", "doi", "10.1000/abc"),
        ("10.1000/AbC", "doi", "10.1000/abc"),
        ("https://link.springer.com/article/10.1007/S1", "doi", "10.1007/S1"),
        ("https://openreview.net/forum?id=Xy", "openreview", "Xy"),
        ("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC123456/", "pmcid", "PMC123456"),
        ("https://www.biorxiv.org/content/10.1101/2020.01.01v2.full.pdf", "biorxiv", "10.1101/2020.01.01"),
        ("https://aclanthology.org/P19-1001.pdf", "acl", "P19-1001"),
        ("HTTPS://user@Ex.org:443/a?utm_x=1&q=2&ref=z#f", "url", "https://ex.org/a?q=2"),
        ("ex.org/a", "url", "ex.org/a"),
        ("not a url", "url", "not a url"),
    ],
)
def test_identity(spark, url, kind, value):
    got = one(spark, urls.paper_identity(F.lit(url)))
    assert (got.kind, got.value) == (kind, value) and len(got.key) == 64


def test_text_functions(spark):
    assert one(spark, text.slug(F.lit("  A b: C!  "))) == "a-b-c-"[:-1]
    assert one(spark, text.slug(F.lit("!!"))) == "paper"
    assert one(spark, text.natural_key(F.lit("fig-10"))) > one(spark, text.natural_key(F.lit("fig-2")))
    assert one(spark, text.balance_braces(F.lit("}a{b"))) == "a{b}"
    assert one(spark, text.strip_markdown(F.lit("# T\n**b** [x](u) ![i](j)\n```py\nc\n```"))) == "T\nb x i\nc\n"
    assert one(spark, text.normal_label(F.lit(" Fig. 2: "))) == "fig. 2"
    assert one(spark, text.caption_label(F.lit("Figure 3. x"))) == "Figure 3"


def test_bibtex(spark):
    rows = [(str(i), "smith", "T") for i in range(30)] + [("z", "smitha", "T")]
    keyed = bibtex.with_unique_keys(spark.createDataFrame(rows, "key string, base string, title string"), "base", ["key"])
    keys = [r.bibkey for r in keyed.collect()]
    assert len(set(keys)) == 31 and "smith" in keys and "smithz" in keys
    entry = one(spark, bibtex.entry(F.lit("k"), F.lit("A {T"), F.array(F.lit("X Y"), F.lit("Z")), F.lit(2020), F.lit(None).cast("string"), F.lit("1"), F.lit(None).cast("string"), F.lit("u")))
    assert entry == "@misc{k,\n  title = {A {T}},\n  author = {X Y and Z},\n  year = {2020},\n  eprint = {1},\n  archivePrefix = {arXiv},\n  url = {u},\n}"


TEXTS = [
    "Zero-shot retrieval of papers. The café index: retrieval again and again.", "Shot zero retrieval", "Nothing here",
    "A long text about ranking and zero shot transfer where the corpus is small. Ranking of corpus items goes on and on for many more words than twelve.",
    "naïve ranking ranking", "corpus corpus corpus retrieval",
]


@pytest.mark.parametrize("query", ["retrieval", "ranking corpus", "zero-shot", "retrieval OR ranking", "ranking NOT corpus", "CAFE", "naive"])
def test_search_against_fts5(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61')")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(TEXTS, 1)))
    words = query.split()
    compiled = " ".join(w if w in ("OR", "NOT", "AND") else f'"{w}"' for w in words)
    want = dict(db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (compiled,)).fetchall())
    docs = spark.createDataFrame(list(enumerate(TEXTS, 1)), "id int, t string")
    got = {r.id: r.score for r in search.search(docs, query, ["id"], "t").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    if "NOT" not in words:
        shown = dict(db.execute("SELECT rowid, snippet(f, 0, '[', ']', ' ... ', 12) FROM f WHERE f MATCH ?", (compiled,)).fetchall())
        assert {r.id: r.snippet for r in search.grep(docs, query, ["id"], "t").collect()} == shown


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert search.search(docs, "  ", ["id"], "t").count() == 0
    assert search.search(docs.where("id > 5"), "a", ["id"], "t").count() == 0
    for bad in ("AND x", "x OR", "NOT x"):
        with pytest.raises(search.QueryError):
            search.parse_query(bad)


def test_outline_against_stack(spark):
    levels = [1, 2, 3, 2, 4, 1, 6, 5, 2]
    rows = [("d", i, v, f"s{i}") for i, v in enumerate(levels)]
    got = outline.heading_parents(spark.createDataFrame(rows, "d string, o int, l int, s string"), "d", "o", "l", "s")
    stack, want = [], {}
    for i, v in enumerate(levels):
        while stack and stack[-1][1] >= v:
            stack.pop()
        want[f"s{i}"] = stack[-1][0] if stack else None
        stack.append((f"s{i}", v))
    assert {r.s: r.parent for r in got.collect()} == want


def test_markdown_sections(spark):
    docs = spark.createDataFrame([("d", "intro\n# One\na\nb\n## Two\n")], "d string, t string")
    got = {r.section_no: (r.section_id, r.level, r.title, r.body) for r in outline.markdown_sections(docs, "d", "t").collect()}
    assert got[0][3] == "intro" and got[1] == ("md-sec-1", 1, "One", "a\nb") and got[2][1:3] == (2, "Two")


def test_merge_upsert_presence(spark):
    a = spark.createDataFrame([("k", None, 1), ("j", "x", None)], "k string, t string, y int")
    b = spark.createDataFrame([("k", "late", 2), ("n", "", 3)], "k string, t string, y int")
    got = {r.k: (r.t, r.y) for r in library.merge_by_precedence([a, b], "k", ["t", "y"]).collect()}
    assert got == {"k": ("late", 1), "j": ("x", None), "n": (None, 3)}
    old = spark.createDataFrame([("k", "t0", "old")], "k string, created_at string, v string")
    new = spark.createDataFrame([("k", "t1", "new"), ("m", "t1", "new")], "k string, created_at string, v string")
    assert {r.k: (r.created_at, r.v) for r in library.upsert(old, new, "k").collect()} == {"k": ("t0", "new"), "m": ("t1", "new")}
    assert {r.k: r.state for r in library.presence(a, b, "k").collect()} == {"j": "missing", "n": "unindexed"}


HTML = """<html><body><nav>x</nav><article class="ltx_document"><h1>Title</h1><p id="p1">One <b>two</b> <math alttext="a+b"><mi>a</mi></math>
<p>Next<ul><li>i<li>j<ul><li>k</ul></ul>
<table class="ltx_equationgroup"><tbody id="e1"><tr><td><math alttext="x=1"></math></td><td class="ltx_eqn_eqno">(1)</td></tr></tbody>
<tbody id="e2"><tr><td><math alttext="y=2"></math></td><td class="ltx_eqn_eqno">(2)</td></tr></tbody></table>
<figure class="ltx_table" id="T1"><figcaption><span class="ltx_tag">Table 1: </span>Cap</figcaption><table><thead><tr><th>a</th><th>b</th></tr></thead>
<tr><td rowspan="2">1</td><td>2</td></tr><tr><td>3</td></tr></table></figure>
<figure class="ltx_figure" id="F1"><img src="a.png" srcset="a.png 1x, b.png 2x"><figcaption><span class="ltx_tag">Figure 1:</span> F</figcaption></figure>
<pre>code
 x</pre></article><script>"</p>"</script></body></html>"""


def test_html_extraction(spark):
    docs = spark.createDataFrame([(1, HTML, "https://h.example/d/"), (2, None, None), (3, "", None)], "id int, h string, u string")
    got = extraction.extract(docs, "id", "h", base_url="u").orderBy("ordinal").collect()
    kinds = [r.kind for r in got]
    assert kinds == ["heading", "paragraph", "paragraph", "list", "math", "math", "table", "figure", "code"]
    assert got[1].text == "One two $a+b$" and got[1].markdown == "One **two** $a+b$"
    assert [r.label for r in got if r.kind == "math"] == ["(1)", "(2)"]
    table, figure = got[6], got[7]
    assert (table.label, table.n_rows, table.n_cols, table.table_csv) == ("Table 1", 3, 2, "a,b\r\n1,2\r\n1,3\r\n")
    assert figure.images == ["https://h.example/d/b.png"] and figure.label == "Figure 1"
    document = extraction.render(extraction.extract(docs, "id", "h", base_url="u"), "id").first().document
    assert document.startswith("# Title\n\nOne **two**")


def test_layout_extraction(spark):
    tree = {"block_type": "Document", "children": [{"block_type": "Page", "children": [
        {"block_type": "PageHeader", "html": "<p>x</p>"}, {"block_type": "SectionHeader", "id": "h", "html": "<h1>T</h1>", "section_hierarchy": {"3": "h"}},
        {"block_type": "Text", "html": "<p>body</p>"},
        {"block_type": "TableGroup", "children": [{"block_type": "Caption", "html": "<p>Table 2: c</p>"}, {"block_type": "Table", "id": "t", "html": "<table><tr><td colspan=2>1</td></tr></table>"}]},
        {"block_type": "FigureGroup", "children": [{"block_type": "Figure", "id": "f", "images": {"a": "aGk=", "b": "!!"}}, {"block_type": "Caption", "html": "<p>Figure 1 c</p>"}]},
        {"block_type": "Equation", "html": "<math>x</math>"},
    ]}]}
    docs = spark.createDataFrame([(1, json.dumps(tree)), (2, "{")], "id int, h string")
    got = extraction.extract(docs, "id", "h", "layout").orderBy("ordinal").collect()
    assert [r.kind for r in got] == ["heading", "paragraph", "table", "figure", "math"]
    assert got[0].level == 3 and got[2].label == "Table 2" and got[2].table_csv == "1,1\r\n" and len(got[3].images) == 1


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(["s|T|https://arxiv.org/abs/2301.00001", {"url": "https://arxiv.org/pdf/2301.00001v2"}, {"title": "no"}, 7]))
    (tmp_path / "m.csv").write_text("title,url\nB,https://b.example/x\n,https://c.example\n")
    (tmp_path / "m.txt").write_text("# note\n\nD|https://d.example\n")
    (tmp_path / "m.py").write_text("PAPERS: list = [Paper('e', 'E', 'https://e.example'), Paper(url='https://f.example', title='F')]\n")
    (tmp_path / "bad.json").write_text("{}")
    got = manifests.collect_inputs(spark, [str(tmp_path / f"m.{x}") for x in ("json", "csv", "txt", "py")], ["https://b.example/x"]).orderBy("part", "ord").collect()
    assert [(r.slug, r.title) for r in got] == [("s", "T"), ("b", "B"), ("paper", "paper"), ("d", "D"), ("e", "E"), ("f", "F")]
    with pytest.raises(ValueError):
        manifests.read_json(spark, str(tmp_path / "bad.json"))
    (tmp_path / "l.md").write_text("# A\n* Good [[paper]](https://arxiv.org/abs/1) [[code]](https://github.com/x)\n* None\n")
    rows = manifests.read_markdown_list(spark, str(tmp_path / "l.md")).orderBy("ord").collect()
    assert (rows[0].title, rows[0].url, rows[0].section) == ("Good", "https://arxiv.org/abs/1", "A") and rows[1].reason == "no link"


def test_records(spark):
    hit = json.dumps({"title": "T", "authors": [{"name": "A"}], "externalIds": {"DOI": "10.1/x"}, "isOpenAccess": True})
    got = one(spark, records.search_record(F.lit(hit)))
    assert got.url == "https://doi.org/10.1/x" and got.authors == ["A"] and got.is_open_access
    assert one(spark, records.search_record(F.lit('{"year": 1}'))) is None
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A  b</title><author><name>X</name></author><published>2020-01-02</published><category term="cs.LG"/></entry></feed>'
    row = one(spark, records.atom_record(F.lit(atom)))
    assert (row.title, row.authors, row.year, row.categories) == ("A b", ["X"], 2020, ["cs.LG"])
    assert one(spark, records.openreview_record(F.lit('{"content": {"title": {"value": "T"}, "authors": "A, B"}}'))).authors == ["A", "B"]
    assert records.read_landing('<meta name="citation_title" content="T"><a href="x.pdf">', "https://h/")[4] == "https://h/x.pdf"


def test_coverage(spark):
    rows = [
        (1, {"figures": 2, "tables": 2}, {"figures": 9, "tables": 1}, 5, 5000, True, 0, 0), (2, {}, {}, 3, 20, True, 0, 0),
        (3, {}, {}, 3, 2000, True, 0, 0), (4, {"figures": 1}, {"figures": 1}, 1, 1, False, 0, 0), (5, {"figures": 20}, {"figures": 20}, 9, 9, True, 20, 18),
    ]
    df = spark.createDataFrame(rows, "id int, source_counts map<string,int>, mapped_counts map<string,int>, n_blocks int, content_chars int, ir_available boolean, images_total int, images_downloaded int")
    got = {r.id: (r.ratio, r.ok) for r in library.coverage_report(df).collect()}
    assert got == {1: (0.75, False), 2: (None, False), 3: (1.0, True), 4: (None, False), 5: (0.95, True)}
