"""Queries over small fixed cases, for operators whose inputs are captures or records that no table holds.

The expected rows are written down by hand beside the cases; the oracle lists them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import media, text, urls
from quillgrid.operators import extraction, library, resolving
from quillgrid.sources import reference_manager

# (url, kind, value, fingerprint)
IDENTITIES = [
    ("10.1234/Ab.5", "doi", "10.1234/ab.5", "doi:10.1234/ab.5"),
    ("https://arxiv.org/abs/2301.00001v2", "arxiv", "2301.00001", "arxiv:2301.00001"),
    ("https://arxiv.org/pdf/2301.00001.pdf", "arxiv", "2301.00001", "arxiv:2301.00001"),
    ("https://www.arxiv.org/html/cs.CL/0101001#S1", "arxiv", "cs.CL/0101001", "arxiv:cs.cl/0101001"),
    ("https://arxiv.org/list/cs/new", "url", "https://arxiv.org/list/cs/new", "url:https://arxiv.org/list/cs/new"),
    ("http://dx.doi.org/10.1000/XYZ", "doi", "10.1000/xyz", "doi:10.1000/xyz"),
    ("https://openreview.net/forum?id=aBc_1", "openreview", "aBc_1", "openreview:abc_1"),
    ("https://openreview.net/pdf?noteId=n9", "openreview", "n9", "openreview:n9"),
    ("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC123/", "pmcid", "PMC123", "pmcid:pmc123"),
    ("https://www.biorxiv.org/content/10.1101/2020.01.02v3.full.pdf", "biorxiv", "10.1101/2020.01.02", "biorxiv:10.1101/2020.01.02"),
    ("https://aclanthology.org/2020.acl-main.1.pdf", "acl", "2020.acl-main.1", "acl:aclanthology.org2020.acl-main.1"),
    ("https://proceedings.mlr.press/v1/a20.html", "pmlr", "v1/a20", "pmlr:proceedings.mlr.pressv1/a20"),
    ("https://link.springer.com/article/10.1007/S1-2).", "doi", "10.1007/S1-2", "doi:10.1007/S1-2"),
    ("Example.org:8080/a;x=1?utm_source=q&b=1&ref=z", "url", "Example.org:8080/a;x=1?utm_source=q&b=1&ref=z", "url:example.org:8080/a;x=1?utm_source=q&b=1&ref=z"),
    ("HTTP://User@Example.ORG:80/A/b;p?b=%C3%A9+x&flag&utm_id=1#f", "url", "http://example.org/A/b?b=%C3%A9+x&flag=", "url:http://example.org/a/b?b=%c3%a9+x&flag="),
    ("https://example.org:8443", "url", "https://example.org:8443/", "url:https://example.org:8443/"),
]
# (name, file name, url, content type, extension, image name, safe)
MEDIA = [
    (1, "Fig 1(a).JPG", "https://h.org/x/p.JPEG?size=2", None, ".jpeg", "Fig-1-a.jpg", True),
    (2, "été.webp", "https://h.org/image", "image/webp; q=1", ".webp", "été.webp", True),
    (3, "../up.png", "https://h.org/a.unknown", "text/html", ".png", "up.png", False),
    (4, "***", "https://h.org/a.b/c", "application/pdf", ".pdf", "image.png", True),
]
# (url, unsafe)
ADDRESSES = [
    ("https://example.org/a", False), ("ftp://example.org", True), ("http://localhost:80/", True), ("http://127.0.0.1/", True), ("http://10.1.2.3/x", True),
    ("http://172.20.1.1", True), ("http://172.32.1.1", False), ("https://8.8.8.8/", False), ("http://169.254.169.254/latest", True), ("http://[::1]/", True), ("https://", True),
]
# (kind, host, value, landing, pdfs)
VENUES = [
    ("acl", "aclanthology.org", "P1", "https://aclanthology.org/P1/", "https://aclanthology.org/P1.pdf"),
    ("pmlr", "proceedings.mlr.press", "v9/b1", "https://proceedings.mlr.press/v9/b1.html", "https://proceedings.mlr.press/v9/b1/b1.pdf https://proceedings.mlr.press/v9/b1.pdf"),
    ("cvf", "openaccess.thecvf.com", "c/html/x", "https://openaccess.thecvf.com/c/html/x.html", "https://openaccess.thecvf.com/c/papers/x.pdf"),
    ("jmlr", "jmlr.org", "papers/v1/q", "https://jmlr.org/papers/v1/q.html", "https://jmlr.org/papers/v1/q.pdf https://www.jmlr.org/papers/v1/q.pdf"),
    ("neurips", "proceedings.neurips.cc", "p/hash/7-Abstract", "https://proceedings.neurips.cc/p/hash/7-Abstract.html", "https://proceedings.neurips.cc/p/file/7-Paper.pdf https://proceedings.neurips.cc/p/hash/7-Abstract.pdf"),
]
PAGE = """<html><head><title>[2301.1] Page title</title></head><body><article class="ltx_document"><h1 class="ltx_title ltx_title_document">On Tables</h1>
<section><h2 id="S1"><span class="ltx_tag">1 </span>Intro</h2><p id="p1">See <cite class="ltx_cite">[<a href="#bib.bib1">1</a>]</cite> and <math alttext="x^2"><mi>x</mi></math>.<span class="ltx_note ltx_role_footnote"><span class="ltx_note_content">A note</span></span></p>
<figure class="ltx_table" id="T1"><figcaption><span class="ltx_tag">Table 1: </span>Sizes</figcaption><table class="ltx_tabular"><thead><tr><th class="ltx_align_center">a</th><th>b</th></tr></thead><tbody><tr><td rowspan="2">1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table></figure>
<figure class="ltx_figure" id="F1"><img src="i.png"><figcaption><span class="ltx_tag">Figure 1: </span>Seen</figcaption></figure></section>
<section class="ltx_bibliography"><ul class="ltx_biblist"><li class="ltx_bibitem" id="bib.bib1">A. Author. Title.</li></ul></section></article></body></html>"""
# (ordinal, kind, block_id, label, text, n_rows, header_rows, has_spans)
BLOCKS = [
    (0, "heading", "heading-1", None, "On Tables", 0, 0, False),
    (1, "heading", "S1", None, "1 Intro", 0, 0, False),
    (2, "paragraph", "p1", None, "See [bib.bib1] and $x^2$.", 0, 0, False),
    (3, "footnote", "footnote-1", "1", "A note", 0, 0, False),
    (4, "table", "T1", "Table 1", "Sizes a b 1 2 3", 3, 1, True),
    (5, "figure", "F1", "Figure 1", "Seen", 0, 0, False),
    (6, "bibliography", "bib.bib1", None, "A. Author. Title.", 0, 0, False),
]
JOBS = [
    ("j1", "running", 1, 4, 1, 0, "a", True, "2024-01-02", "job j1: running (1/4), 1 ok, now: a"),
    ("j2", "done", 4, 4, 3, 1, None, False, "2024-01-03", "job j2: done (4/4), 3 ok, 1 failed"),
    ("j3", "running", 0, 2, 0, 0, "b", False, "2024-01-01", "job j3: runner exited without finishing (0/2)"),
]
ITEMS = [
    (1, '{"key":"A","data":{"itemType":"journalArticle","title":"T1","DOI":"10.1/x","collections":["C1","C9"],"tags":[{"tag":"t"}]}}'),
    (2, '{"key":"B","data":{"itemType":"preprint","title":"T2","extra":"arXiv:2301.00001 [cs]"}}'),
    (3, '{"key":"C","data":{"itemType":"webpage","title":"T3","url":"https://arxiv.org/abs/2301.00001"}}'),
    (4, '{"key":"D","data":{"itemType":"note","title":"N"}}'),
    (5, '{"key":"E","data":{"itemType":"book","title":"T5"}}'),
    (6, "broken"),
]
ITEM_ROWS = [
    ("A", "T1", "https://doi.org/10.1/x", "Reading;C9", None),
    ("B", "T2", "https://arxiv.org/abs/2301.00001", "", None),
    ("E", "T5", None, "", "no DOI, arXiv id or URL"),
]


def case_identities(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(x[0],) for x in IDENTITIES], "url string")
    return urls.with_identity(rows, "url").select("url", "identity.kind", "identity.value", "identity.fingerprint", F.sha2("identity.fingerprint", 256).alias("key"))


def case_media(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([x[:4] for x in MEDIA], "id int, name string, url string, type string")
    return rows.select(
        "id", media.extension_for(F.col("url"), F.col("type")).alias("extension"), media.safe_image_name(F.col("name")).alias("image_name"), media.safe_member(F.col("name")).alias("safe")
    )


def case_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(x[0],) for x in ADDRESSES], "url string").select("url", media.unsafe_url(F.col("url")).alias("unsafe"))


def case_venues(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([x[:3] for x in VENUES], "kind string, host string, value string")
    return rows.select("kind", resolving.proceedings_pages(F.col("kind"), F.col("host"), F.col("value")).alias("p")).select("kind", "p.landing", F.array_join("p.pdfs", " ").alias("pdfs"))


def _page(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("k", PAGE), ("empty", None)], "key string, html string")


def case_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(_page(spark), "key", "html").select(
        "ordinal", "kind", "block_id", "label", "text", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "header_rows")], F.coalesce("has_spans", F.lit(False)).alias("has_spans")
    )


def case_reports(spark: SparkSession, folder: str) -> DataFrame:
    got = extraction.page_reports(_page(spark), "key", "html")
    count = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    return got.select("key", "title", "ir_available", *[count(f"{s}_counts", k).alias(f"{s}_{k}") for s in ("source", "mapped") for k in library.TRACKED])


def case_jobs(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([x[:9] for x in JOBS], "id string, state string, done int, total int, succeeded int, failed int, current string, runner_alive boolean, started_at string")
    return library.jobs(rows).select("id", "line")


def case_items(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame(ITEMS, "ord int, json string")
    got = reference_manager.read_items(rows, "json", "ord", {"C1": "Reading"})
    return got.select("key", "title", "url", F.array_join("collections", ";").alias("collections"), "reason")


def case_front_matter(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 'A "b"', "k", "u", "x", ["P", "Q"], 2020, None), (2, None, "k2", None, "x", [], None, "V")], "id int, title string, key string, source string, extractor string, authors array<string>, year int, venue string")
    made = text.front_matter(*[F.col(c) for c in ("title", "key", "source", "extractor", "authors")], {"year": F.col("year"), "venue": F.col("venue")})
    return rows.select("id", made.alias("front"))


def _values(rows: list[tuple], names: str) -> str:
    def written(x: object) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(written, r)) + ')' for r in rows)}) t({names})"


QUERIES = {
    f.__name__: f
    for f in (case_identities, case_media, case_addresses, case_venues, case_blocks, case_reports, case_jobs, case_items, case_front_matter)
}

ORACLE = {
    "case_identities": f"SELECT *, sha256(fingerprint) AS key FROM ({_values(IDENTITIES, 'url, kind, value, fingerprint')})",
    "case_media": _values([(x[0], *x[4:]) for x in MEDIA], "id, extension, image_name, safe"),
    "case_addresses": _values(ADDRESSES, "url, unsafe"),
    "case_venues": _values([(x[0], *x[3:]) for x in VENUES], "kind, landing, pdfs"),
    "case_blocks": _values(BLOCKS, "ordinal, kind, block_id, label, text, n_rows, header_rows, has_spans"),
    "case_reports": _values(
        [("k", "On Tables", True, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1), ("empty", None, False, *[0] * 10)],
        "key, title, ir_available, " + ", ".join(f"{s}_{k}" for s in ("source", "mapped") for k in library.TRACKED),
    ),
    "case_jobs": _values([(x[0], x[9]) for x in JOBS], "id, line"),
    "case_items": _values(ITEM_ROWS, "key, title, url, collections, reason"),
    "case_front_matter": "SELECT 1 AS id, concat_ws(chr(10), '---', 'title: \"A \\\"b\\\"\"', 'key: k', 'source: u', 'extractor: x', 'authors: [\"P\", \"Q\"]', 'year: \"2020\"', '---') AS front"
    " UNION ALL SELECT 2, concat_ws(chr(10), '---', 'title: \"\"', 'key: k2', 'source: ', 'extractor: x', 'venue: \"V\"', '---')",
}
