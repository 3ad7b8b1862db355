import json
import threading
import urllib.request
from http.server import ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quillgrid import service
from quillgrid.api import Library, NotFound, connect
from quillgrid.errors import BadRequest, Locked, Unreadable
from quillgrid.functions import bibtex, geometry, text, urls
from quillgrid.operators import bundles, extraction, hierarchy, library, resolving, search
from quillgrid.sources import manifests, records, sinks


def bundle(folder, key, **meta):
    at = folder / key
    (at / "figures").mkdir(parents=True)
    (at / "meta.json").write_text(json.dumps({"key": key, "title": f"Title {key}", "authors": ["A B", "C D"], "year": 2020, "coverage": {"ratio": 1.0, "ok": True}} | meta))
    (at / "paper.md").write_text("lead\n# One\ntext one\n## Two\n\n# Three\nlast\n")
    (at / "figures" / "f.png").write_bytes(b"png")


@pytest.fixture()
def captures(tmp_path):
    bundle(tmp_path / "c", "k1", updated_at="2024-01-02T00:00:00Z")
    bundle(tmp_path / "c", "k2", authors=[], bibtex="@misc{own1, title={X}}")
    (tmp_path / "c" / ".staging").mkdir()
    (tmp_path / "c" / "odd").mkdir()
    (tmp_path / "c" / "odd" / "x.txt").write_text("x")
    return tmp_path / "c"


def test_reindex(spark, captures, tmp_path):
    lib = connect(spark, str(tmp_path / "lib"), str(captures))
    assert {r.key for r in lib.papers().collect()} == {"k1", "k2"} and lib.papers().where("key = 'k1'").first().coverage_ratio == 1.0
    got = {(r.section_id, r.level, r.title, r.char_count) for r in lib.table("sections").where("paper_key = 'k1'").collect()}
    assert got == {("md-sec-1", 1, "One", 8), ("md-sec-2", 2, "Two", 0), ("md-sec-3", 1, "Three", 4)}
    assert [(r.ordinal, r.text) for r in lib.table("blocks").where("paper_key = 'k1'").orderBy("ordinal").collect()] == [(0, "lead"), (1, "text one"), (3, "last")]
    assert {r.rel_path for r in lib.table("files").where("paper_key = 'k1'").collect()} == {"meta.json", "paper.md", "figures/f.png"}
    created = lib.papers().where("key = 'k1'").first().created_at
    lib.annotate("k1", "q", "n")
    bundle(captures, "k3")
    (captures / "k2" / "meta.json").unlink()
    (captures / "k1" / "paper.md").write_text("# New\nonly\n")
    assert lib.reindex(str(captures)) == {"indexed": 2, "pruned": 1}
    assert {r.key for r in lib.papers().collect()} == {"k1", "k3"} and lib.papers().where("key = 'k1'").first().created_at == created
    assert lib.table("blocks").where("paper_key = 'k2'").isEmpty() and [r.text for r in lib.table("blocks").where("paper_key = 'k1'").collect()] == ["only"]
    assert lib.annotations("k1").count() == 1
    lib.drop_papers(lib.spark.createDataFrame([("k1",)], "key string"))
    assert lib.annotations("k1").isEmpty()


def test_bundle_reports(spark, captures):
    meta, files = bundles.scan_meta(spark, str(captures)), bundles.scan_files(spark, str(captures))
    entries = {r.key: json.loads(r.entry) for r in bundles.index_entries(meta).collect()}
    assert entries["k1"]["authors"] == ["A B", "C D"] and "authors" not in entries["k2"] and entries["k2"]["bibtex"].startswith("@misc")
    assert [r.key for r in bundles.needs_metadata(meta).collect()] == ["k2"]
    index = spark.createDataFrame([("k1",), ("gone",)], "key string")
    assert {tuple(r) for r in bundles.state_of(index, meta, files).collect()} == {("gone", "missing"), ("k2", "unindexed"), ("odd", "orphan")}
    images = spark.createDataFrame([("p", "a", True, 5), ("p", "a", True, 5), ("p", "b", False, None)], "paper_key string, src string, ok boolean, bytes long")
    assert tuple(bundles.asset_report(images).first()) == ("p", 3, 2, 1, 1, 5)
    floats = spark.createDataFrame([("p", "F1", 1, None), ("p", "F2", 2, "old")], "paper_key string, id string, pdf_page int, crop_path string")
    crops = spark.createDataFrame([("p", "F1", "c.png")], "paper_key string, id string, path string")
    pages = spark.createDataFrame([("p", "F2", 9)], "paper_key string, id string, page int")
    assert {(r.id, r.pdf_page, r.crop_path) for r in bundles.with_crops(floats, crops, pages).collect()} == {("F1", 1, "c.png"), ("F2", 9, "old")}
    figures = spark.createDataFrame([("p", "b", None, "x", ["i"]), ("p", "a", "L", None, None), ("p", "a", "L", None, None)], "paper_key string, id string, label string, caption string, images array<string>")
    assert [x["id"] for x in json.loads(bundles.figure_manifest(figures).first().manifest)] == ["a", "b"]
    shown = spark.range(1).select(bundles.project_markdown(F.lit("![c](figures/a.png) ![d](http://x)"), F.lit("s"))).first()[0]
    assert shown == "![c](s/figures/a.png) ![d](http://x)"


def test_content_chars(spark):
    doc = {"blocks": [{"text": "ab", "inlines": ["cde", {"kind": "math", "tex": "x"}, {"kind": "emph", "children": [{"text": "fg"}]}], "items": [{"inlines": ["h"]}]}, {"tex": "yy"}]}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, "{"), (3, None)], "record_id long, doc_json string")
    assert [tuple(r) for r in bundles.content_chars(docs, "record_id", "doc_json").collect()] == [(1, 2, 11)]


def test_resolve(spark):
    urls_in = [("a", "https://arxiv.org/abs/2301.00001v2"), ("d", "https://doi.org/10.1/x"), ("g", "https://h.org/page"), ("f", "https://h.org/a.pdf"), ("b", "https://www.biorxiv.org/content/10.1101/1v1"), ("p", "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC7/"), ("m", "https://proceedings.mlr.press/v1/a20.html")]
    ids = urls.with_identity(spark.createDataFrame(urls_in, "key string, url string"), "url", "i").select("key", "i.kind", "i.value", "i.normalized_url", "i.version")
    page = '<script type="application/ld+json">{"@type": "ScholarlyArticle", "headline": "H", "author": [{"name": "N"}], "datePublished": "2021-01-01", "encoding": {"contentUrl": "/p.pdf"}}</script>'
    stored = spark.createDataFrame(
        [("d", "graph", '{"externalIds": {"ArXiv": "2301.9"}, "openAccessPdf": {"url": "http://s/x.pdf"}, "title": "G"}'), ("d", "openalex", '{"title": "", "best_oa_location": {"pdf_url": "http://o/x.pdf"}}'),
         ("d", "unpaywall", '{"best_oa_location": {"url_for_pdf": "http://o/x.pdf"}}'), ("g", "landing", page), ("p", "oa_links", '<r><link format="tgz" href="ftp://n/a.tgz"/></r>'), ("x", "graph", "broken")],
        "key string, provider string, body string",
    )
    got = {r.key: r for r in resolving.resolve(ids, stored).collect()}
    assert [c.url for c in got["a"].candidates] == ["https://arxiv.org/html/2301.00001v2", "https://arxiv.org/pdf/2301.00001v2.pdf"] and [c.priority for c in got["a"].candidates] == [0, 10]
    assert [c.url for c in got["d"].candidates] == ["https://arxiv.org/pdf/2301.9", "http://o/x.pdf", "http://s/x.pdf"] and (got["d"].title, got["d"].status) == ("G", "ok")
    assert [c.url for c in got["g"].candidates] == ["https://h.org/p.pdf"] and (got["g"].title, got["g"].authors, got["g"].year) == ("H", ["N"], 2021)
    assert got["f"].candidates[0].url == "https://h.org/a.pdf" and got["b"].resolver == "preprint"
    assert (got["p"].status, got["p"].notes) == ("metadata_only", ["a full-text package is available", "no PDF found"]) and len(got["m"].candidates) == 2
    tries = spark.createDataFrame([("k", 1, 0.9, False, True), ("k", 2, 0.9, False, True), ("k", 3, 1.0, True, True), ("n", 1, None, None, None)], "key string, n int, ratio double, empty boolean, ir_available boolean")
    assert {(r.key, r.n, r.score) for r in resolving.best_attempt(tries, "key", "n").collect()} == {("k", 2, 0.9), ("n", 1, -1.0)}
    known = spark.createDataFrame([("arxiv", "1"), ("doi", "2")], "kind string, value string").select(resolving.graph_id(F.col("kind"), F.col("value")).alias("g"))
    assert [r.g for r in known.collect()] == ["arXiv:1", "DOI:2"]


def test_index_against_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "zero shot learning of zero-shot things"), (2, "shot zero"), (3, ""), (4, None), (5, "Über learning")], "id long, text string")
    search.write_index(docs, ["id"], "text", str(tmp_path / "i"), buckets=8)
    for query in ("zero", '"zero-shot"', "zero-shot", "learning NOT zero", "uber OR shot", "nothing", ""):
        want = {(r.id, round(r.score, 9)) for r in search.search(docs, query, ["id"], "text").collect()}
        assert {(r.id, round(r.score, 9)) for r in search.search_index(spark, str(tmp_path / "i"), query, ["id"]).collect()} == want, query


def test_transports(spark, captures, tmp_path):
    lib = connect(spark, str(tmp_path / "lib"), str(captures))
    assert {r["key"] for r in service.call(lib, "find", {"query": "c d"})} == {"k1"}
    with pytest.raises(BadRequest):
        service.call(lib, "grep", {"query": "x", "limit": "0"})
    with pytest.raises(NotFound):
        service.call(lib, "none", {})
    assert "own1" in service.call(lib, "export", {}) and "@misc{b2020title," in service.call(lib, "export", {})
    tools = service.handle_line(lib, '{"id": 1, "method": "tools/list"}')["result"]["tools"]
    assert {"grep", "read", "export"} <= {t["name"] for t in tools}
    said = service.handle_line(lib, '{"id": 2, "method": "tools/call", "params": {"name": "read", "arguments": {"key": "k1", "max_chars": "4"}}}')
    assert json.loads(said["result"]["content"][0]["text"])["window"] == "lead" and service.handle_line(lib, '{"method": "x"}') is None
    server = ThreadingHTTPServer(("127.0.0.1", 0), service.handler(lib))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}/api/v1/"
    assert json.load(urllib.request.urlopen(at + "outline?key=k1"))[0]["title"] == "One"
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(at + "read?key=none")
    assert e.value.code == 404
    server.shutdown()


def test_store(spark, tmp_path):
    lib = Library(spark, str(tmp_path))
    lib.replace("t", spark.range(2))
    with lib.store.lock(), pytest.raises(Locked), lib.store.lock(timeout=0.3):
        pass
    lib.change("t", lambda rows: rows.where("id = 1"))
    assert lib.table("t").count() == 1 and not lib.store.exists(".lock")
    (tmp_path / "i.json").write_text('{"a": {"title": "x"}}')
    assert [tuple(r) for r in lib.load_entries(str(tmp_path / "i.json")).collect()] == [("a", '{"title":"x"}')]
    (tmp_path / "i.json").write_text("{")
    assert lib.load_entries(str(tmp_path / "i.json"), tolerant=True).isEmpty()
    with pytest.raises(Unreadable):
        lib.load_entries(str(tmp_path / "i.json"))
    with pytest.raises(BadRequest):
        lib.figure_file("k", "../x")


def test_formats_and_functions(spark, tmp_path):
    sinks.write_json(str(tmp_path / "a" / "b.json"), {"b": 1, "a": 2})
    assert (tmp_path / "a" / "b.json").read_text().index('"a"') < (tmp_path / "a" / "b.json").read_text().index('"b"')
    sinks.manifest_template(str(tmp_path / "m.csv"))
    with pytest.raises(FileExistsError):
        sinks.manifest_template(str(tmp_path / "m.csv"))
    tables = spark.createDataFrame([("ab", "T1", "L", "c", "<t>", "1")], "paper_key string, id string, label string, caption string, table_html string, table_csv string")
    assert sinks.write_sidecars(tables, str(tmp_path / "s")).count() == 1 and spark.read.parquet(str(tmp_path / "s" / "csv")).first().content == "1"
    rows = spark.createDataFrame([('A "q"', ["x", "y"])], "title string, authors array<string>")
    assert sinks.format_papers(rows, "csv").first().line == '"A ""q""",x;y'
    one = lambda c: spark.range(1).select(c).first()[0]
    names = ["f" + "9" * 30, "f1" + "0" * 30, "f007", "f10"]
    keyed = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n")))
    assert [r.n for r in keyed.collect()] == ["f007", "f10", names[0], names[1]]
    assert one(text.utc_stamp(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "2024-01-02T03:04:05Z"
    assert tuple(one(geometry.caption_band(F.array(*map(F.lit, (0.0, 100.0, 50.0, 110.0))), F.lit("table"), F.lit(200.0)))) == (0.0, 30.0, 0.0, 86.0)
    held = spark.createDataFrame([(1, "k", "@a{k, x}"), (2, "k", None), (3, "k", None), (4, "kb", None)], "o int, base string, b string").withColumn("held", bibtex.stored_key(F.col("b")))
    assert [r.bibkey for r in bibtex.with_unique_keys(held, "base", ["o"], "held").orderBy("o").collect()] == ["k", "ka", "kb-2", "kb"]
    (tmp_path / "l.md").write_text("# Papers\n- A b [[pdf]](https://www.biorxiv.org/1) [[paper]](https://arxiv.org/abs/1)\n* A b [[code]](https://arxiv.org/abs/2)\n+ A B. [[x]](https://arxiv.org/abs/3)\n- C [[x]](https://odd.org/1)\n")
    got = {(r.title, r.url, r.slug, r.reason) for r in manifests.read_markdown_list(spark, str(tmp_path / "l.md"), ["papers"]).collect()}
    assert got == {("A b", "https://arxiv.org/abs/1", "a-b", None), ("A b", None, None, "only code/data links"), ("A B", "https://arxiv.org/abs/3", "a-b-2", None), ("C", None, None, "no retrievable source (odd.org)")}
    asked = library.requested_keys(spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a",), ("z",), ("a",)], "key string"))
    assert [r.key for r in asked.collect()] == ["a"]
    cats = spark.createDataFrame([(["x", "y"],), (["x"],), (None,)], "c array<string>")
    assert [tuple(r) for r in library.count_by_category(cats, "c").collect()] == [("x", 2), ("y", 1)]
    near = spark.createDataFrame([(True, 5), (False, 9), (True, None)], "is_open_access boolean, citation_count int")
    assert library.neighbour_filter(near, True, 1).count() == 1


def test_table_spans_and_notes():
    assert extraction.expand_table([[{"text": "a", "rowspan": 3}, {"text": "b"}]]) == [["a", "b"], ["a", ""], ["a", ""]]
    page = '<article><p>a<span class="ltx_note"><span class="ltx_note_content">n1</span></span> b<span class="ltx_note"><sup class="ltx_note_mark">*</sup><span class="ltx_note_content">n2</span></span> x<sup>2</sup></p></article>'
    rows = extraction.html_blocks(page)
    assert rows[0]["markdown"] == "a[^1] b[^*] x<sup>2</sup>" and [(r["label"], r["text"]) for r in rows[1:]] == [("1", "n1"), ("*", "n2")]
    assert extraction.table_markdown([[{"text": "a", "align": "right"}], [{"text": "b"}]]) == "| a |\n|---:|\n| b |"
    assert records.read_landing('<script type="application/ld+json">{</script>', None)[0] is None


def test_deep_hierarchy_without_paths(spark):
    rows = spark.createDataFrame([("t", f"n{i}", f"n{i - 1}" if i else None) for i in range(30)] + [("t", "c1", "c2"), ("t", "c2", "c1"), ("t", "c3", "c1")], "tree string, node string, parent string")
    links = hierarchy.links(rows, "tree", "node", "parent")
    bare, full = hierarchy.build_hierarchy(links, paths=False), hierarchy.build_hierarchy(links)
    assert {r.node for r in bare.spoilt.collect()} == {r.node for r in full.spoilt.collect()} == {"c1", "c2", "c3"}
    assert bare.nodes.count() == 30 and full.nodes.agg(F.max("depth")).first()[0] == 29
    with pytest.raises(ValueError):
        hierarchy.build_hierarchy(links, max_levels=5)
