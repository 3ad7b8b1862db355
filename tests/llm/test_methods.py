import random
import string

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgrid.llm import leakage, markup, matching, names, packing, spam

FRAGMENTS = ["a", "b c", " ", "\n", "*", "**", "_", "__", "___", "~~", "`", "``", "```", "$", "$$", "\\(", "\\)", "\\alpha", "\\textbf{x}", "\\item", "\\%", "\\\\", "~", "F.~1", "[", "]", "](", "][", "[[", "]]", "[^1]",
             "[x]:", "http://a.b/c", "[http://a b]", "<b>", "</p>", "<!-- x -->", "<http://a>", "&amp;", "&#39;", "{{t}}", "{#id}", "{|", "|}", "|-", "|", "||", "!", "!!", "==", "===", "'" * 3, "'" * 2, "#", "# h", "> q", "- [x] t", "---", ":--", "#REDIRECT", "__TOC__", "x_1", "(", ")"]


def test_no_token_without_suspicion(spark):
    rng = random.Random(4)
    texts = ["a\n___\nb", "_ _ _", "! a !! b", "[a $b](c) d$"] + ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 9))) for _ in range(6000)]
    blocks = spark.createDataFrame([(i, "p", "paragraph", t) for i, t in enumerate(texts)], "id long, paper_key string, kind string, text string")
    equations = spark.createDataFrame([], "id string, paper_key string, tex string")
    ir = spark.createDataFrame([], "record_id long, doc_json string")
    kept = {int(r.item_id) for r in markup.texts_of_library(blocks, equations, ir).collect()}
    assert not [t for i, t in enumerate(texts) if i not in kept and markup.tokens_of_text(t)]
    assert {0, 1, 2, 3} <= {int(r.item_id) for r in markup.found(blocks, equations, ir).collect()}


def test_wrappers_do_not_depend_on_batches(spark):
    rng = random.Random(5)
    bits = ["<p>x</p>", "<b>y</b>", "&amp;", "**z**", "[l](u)", "plain", "<li>a</li>"]
    rows = [("blocks", f"p{i % 3}", str(i), False, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 6)))) for i in range(200)]
    texts = spark.createDataFrame(rows, "source_table string, owner_key string, item_id string, is_tex boolean, text string")
    got = []
    for size, parts in ((10_000, 1), (1, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got.append(sorted(tuple(r) for r in markup.clean_library(texts.repartition(parts)).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and len(got[0]) == 200
    assert any("?" in r[3] for r in got[0]) and all((r[5] > 0) == (r[3] != markup.TEXT) for r in got[0])
    chunked = markup.infer_wrappers(texts.mapInPandas(markup._streams(True), markup.STREAMED), chunk=2)
    assert {(r.source_table, r.owner_key, r.folded) for r in chunked.collect()} == {(r.source_table, r.owner_key, r.folded) for r in markup.infer_wrappers(texts.mapInPandas(markup._streams(True), markup.STREAMED)).collect()}


def test_wrappers_match_what_made_them():
    rng = random.Random(6)
    w = markup.Wrappers()
    streams = [tuple(rng.choice(["<p>", "</p>", markup.TEXT, "<b>", "</b>", "[link]"]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    for s in streams:
        w.add(s)
    for s in streams:
        assert markup.Matcher(w.found[w.add(s)]).slots(s) == [i for i, x in enumerate(s) if x == markup.TEXT]
    line = markup.written(w.found[0])
    assert markup.read_wrapper(line) == w.found[0]


def test_short_names_chains_and_swaps(spark):
    chain = "konstantinopolisky"
    spellings = [chain[:i] + "x" * (i > 0) + chain[i + (i > 0):] for i in range(len(chain))]
    steps = ["".join("z" if j < i else c for j, c in enumerate(chain)) for i in range(10)]
    rows = [("Anna Lee",)] * 6 + [("Anna Leee",), ("Anna Lew",), ("Igor Ng",), ("Igor Nng",), ("Anna Konigsberg",), ("Anna Konigsbergg",), ("Anna Konigsbegr",)] + [(f"Ruth {s.title()}",) for s in steps]
    got = {tuple(r) for r in names.found(spark.createDataFrame(rows, "name string")).collect()}
    assert ("Anna Lee", "Anna Leee") in got and ("Anna Lee", "Anna Lew") in got and ("Igor Ng", "Igor Nng") in got
    assert ("Anna Konigsberg", "Anna Konigsbergg") in got and ("Anna Konigsbegr", "Anna Konigsberg") in got
    assert len({frozenset(p) for p in got if p[0].startswith("Ruth")}) == 45 and spellings
    none = names.link_names(spark.createDataFrame([("Liz Aho",), ("Elizabeth Aho",)], "name string"), nicknames={})
    assert none.select("entity").distinct().count() == 2


def test_edits_apart(spark):
    pairs = [("abc", "acb", True), ("abcd", "acbd", True), ("abcd", "abdc", True), ("abc", "abcd", True), ("abc", "axc", True), ("ab", "ba", True), ("abcd", "badc", False), ("abc", "cba", False), ("abcd", "adcb", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where(names.edits_apart(F.col("a"), F.col("b"), 1) != F.col("want")).isEmpty()


def test_walks_pass_attributes():
    p = matching.Parameters()
    a = [matching.record_of("paper", "one two three", "10.1/q"), matching.record_of("ref", None, "10.1/q", "four five six")]
    walks = matching.random_walks(a * 3, p)
    assert {k for r in a for k, _ in r} == {"paper.title", "paper.doi", "ref.raw", "ref.doi"}
    assert any({"one", "two", "three"} & set(s) and {"four", "five", "six"} & set(s) for s in walks)
    other = [matching.record_of("paper", "one two three", "10.1/q"), matching.record_of("ref", "four five six", "10.1/q")]
    moved = [matching.random_walks([[(k.replace("ref.", "paper."), v) for k, v in r] for r in other * 3], p), matching.random_walks(other * 3, p)]
    assert moved[0] != moved[1]


@pytest.mark.parametrize("n", [300, 3_000, 30_000])
def test_hyperplanes_alone_meet_noisy_titles(n):
    """Recall of blocking by hyperplanes, without letter stretches, on titles with two slips, against the cosine itself."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(4, 9)))
    vocabulary = [word() for _ in range(1500)]
    titles = [" ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(400)]

    def slip(t):
        for _ in range(2):
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(string.ascii_lowercase) + t[i + 1 :] if t[i] != " " else t
        return t

    p = matching.Parameters()
    inner = matching.train_vectors([matching.record_of("paper", t, None) for t in titles], p)
    encoder = matching.Encoder(inner, np.ones(p.slots, dtype=np.float32), n, p)
    a, b = encoder.vectors(titles), encoder.vectors([slip(t) for t in titles])
    near = (a * b).sum(axis=1) >= p.alike
    met = (encoder.signatures(a) == encoder.signatures(b)).any(axis=1)
    assert near.sum() > 100 and met[near].mean() >= 0.9
    assert matching.tables_for(encoder.bits + 4, p) > encoder.tables


def test_uncalibrated_and_short_titles(spark):
    papers = spark.createDataFrame(
        [("k1", "Ants", None, None), ("k2", "The long history of small gardens in towns", None, None)], "key string, title string, doi string, arxiv_id string"
    ).withColumns({"status": F.lit("indexed"), "updated_at": F.current_timestamp(), "created_at": F.current_timestamp()})
    refs = spark.createDataFrame(
        [("s", "b1", "x", "Ants", None, None), ("s", "b2", "A. Bee. Ant. 2020.", None, None, None), ("s", "b3", None, "The long history of smal gardens in towns", None, None), ("s", "b4", None, "Antsy", None, None)],
        "src_key string, bibkey string, raw string, title string, doi string, arxiv_id string",
    )
    got = {(r.bibkey, r.paper_key, r.confidence) for r in matching.match_references(refs, papers, matching.Parameters(sample=50)).collect()}
    assert got == {("b1", "k1", None), ("b3", "k2", None)}


def test_attention_binds_and_breaches(spark):
    c = packing.Capacity(tokens=100, documents=5, attention=5_000.0)
    sizes = np.array([90, 60, 60, 40, 40, 30, 20, 10, 5, 0, 0, 0, 0, 0, 0])
    where = packing.best_fit(sizes, c)
    for k in set(where.tolist()):
        own = sizes[where == k]
        assert own.sum() <= 100 and len(own) <= 5 and ((own**2).sum() <= 5_000 or len(own) == 1)
    assert (where == where[0]).sum() == 1
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 900)) for i in range(200)] + [(999, "word " * 5000), (None, "x"), (7, None)], "doc_id long, text string")
    packed = packing.pack_documents(docs, group=64)
    assert packing.breaches(docs, packed).isEmpty()
    assert {r.breach for r in packing.breaches(docs, packed.where("doc_id <> 3")).collect()} == {"not assigned once"}
    assert not packing.breaches(docs, packed.withColumn("container", F.lit(1))).isEmpty()


def test_instructions_are_counted_over_all_items(spark):
    line = "choose the right ending of this text now"
    items = spark.createDataFrame([(i, f"{line}\n" + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(4)] + [(9, None)], "item_id long, text string")
    doc = "intro " * 30 + line + " " + " ".join(f"w0x{j}" for j in range(12))
    docs = spark.createDataFrame([(1, doc), (2, " ".join(f"w3x{j}" for j in range(30)))], "doc_id long, text string")
    for block in (1, 2, 100):
        assert [tuple(r) for r in leakage.leaked_items(docs, items, item_block=block).collect()] == [(2, 3)]


def test_spam_groups_and_learned_words(spark):
    rng = random.Random(9)
    texts = [None, "", "x"] + [" ".join(rng.choice(["buy", "cheap", "the", "of", "shoes", "and", "is", "#tag", "http://a.b", "1.5", "sentence."]) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    together = spam.Judge().group(texts)
    for t, got in zip(texts, together):
        assert got == pytest.approx(spam.analyse(t))
    polish = ["zbior danych jest duzy i zostal opisany w pracy ktora jest dostepna na stronie", "autor pisze ze metoda jest prosta i w praktyce dziala na wielu zbiorach"]
    rows = [(i, polish[i % 2] + f" slowo{i}", "pl") for i in range(120)] + [(1000 + i, "buy cheap shoes online now", "en") for i in range(20)] + [(2000 + i, "the cat of the house is in the garden and to the left", "en") for i in range(120)]
    learned = spam.learned_function_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"jest", "i", "w", "na"} <= learned and "cheap" not in learned
    assert spam.learned_function_words(spark.createDataFrame([(1, "a")], "doc_id long, text string")) == frozenset()


def test_no_table_is_broadcast(spark, monkeypatch):
    """Sides of joins grow with the library, so none may be gathered in the driver, small as they are here."""
    papers = spark.createDataFrame([(f"k{i}", f"Notes on the {i} gardens of a town", f"10.1234/{i}", None) for i in range(30)], "key string, title string, doi string, arxiv_id string")
    papers = papers.withColumns({"status": F.lit("indexed"), "updated_at": F.current_timestamp(), "created_at": F.current_timestamp()})
    refs = papers.select(F.lit("s").alias("src_key"), F.col("key").alias("bibkey"), F.lit(None).cast("string").alias("raw"), "title", "doi", "arxiv_id")
    plans, kept = [], matching.cut_lineage

    def noted(df):
        out = kept(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())  # as it ran
        return out

    monkeypatch.setattr(matching, "cut_lineage", noted)
    got = matching.match_references(refs, papers, matching.Parameters(sample=50))
    assert {(r.bibkey, r.paper_key) for r in got.collect()} >= {(f"k{i}", f"k{i}") for i in range(30)}
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and any("SortMergeJoin" in x for x in plans) and not any("Broadcast" in x for x in plans)


def test_walks_vectors_and_calibration_take_all_records(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(7))
    common = [word() for _ in range(40)]
    rows = [(f"k{i}", " ".join([word(), *rng.sample(common, 5), word()]), f"10.1234/{i}", None) for i in range(60)]
    papers = spark.createDataFrame(rows, "key string, title string, doi string, arxiv_id string")
    papers = papers.withColumns({"status": F.lit("indexed"), "updated_at": F.current_timestamp(), "created_at": F.current_timestamp()})
    refs = papers.select(F.lit("s").alias("src_key"), F.col("key").alias("bibkey"), F.lit(None).cast("string").alias("raw"), "title", "doi", "arxiv_id")
    p = matching.Parameters(sample=3)  # far fewer than the records, and than the pairs that a calibration needs
    got = matching.match_references(refs, papers, p).collect()
    assert {(r.bibkey, r.paper_key) for r in got} == {(k, k) for k, *_ in rows} and all(r.confidence > 0.5 for r in got)

    records = matching.graph_records(papers.withColumn("uid", F.xxhash64("key")), refs.withColumn("uid", F.xxhash64("bibkey")))
    walked = sorted(tuple(r) for r in matching.walks(records, p).collect())
    assert walked == sorted(tuple(r) for r in matching.walks(records.repartition(7), p).collect())
    held = {r.uid: [set(a.tokens) for a in r.attributes] for r in records.collect()}
    assert len(held) == 120 and sorted((u, w) for u, w, _ in walked) == sorted((u, w) for u in held for w in (1, 2))
    steps = [(u, s[i : i + 2], i) for u, _, s in walked for i in range(0, p.walk_length, 2)]
    assert all(any(set(two) <= a for u in ([start] if i == 0 else held) for a in held[u]) for start, two, i in steps)
    assert len({u for u, two, i in steps if i and not any(set(two) <= a for a in held[u])}) > 60  # walks leave their record

    monkeypatch.setattr(matching, "spread", lambda inner, n, *_: (inner, n))
    q = matching.Parameters(sample=20, walks=10)  # three shares; a word learns once its neighbours have learnt
    inner, words = matching.vectors_of(records, q)
    assert words == len({t for attributes in held.values() for a in attributes for t in a})
    moved = (inner != matching.seeded(q)[1]).any(axis=1)
    own = lambda title: [moved[xxhash.xxh32_intdigest(f"<{w}>") % q.buckets] for w in (title.split()[0], title.split()[-1])]
    assert np.mean([any(own(title)) for _, title, *_ in rows]) > 0.9


def test_streams_of_a_host_are_aligned_whatever_their_marks(spark):
    pair = ["<p>a</p>", "<p>a <b>b</b> c</p>"]
    rng = random.Random(8)
    bits = ["<i>x</i>", "<b>y</b>", "&amp;", "**z**", "[l](u)", "plain", "<li>a</li><li>b</li>"]
    many = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    rows = [("blocks", o, f"{o}{i}", False, t) for o, texts in (("p", pair), ("q", pair[:1]), ("r", many)) for i, t in enumerate(texts)]
    texts = spark.createDataFrame(rows, "source_table string, owner_key string, item_id string, is_tex boolean, text string")
    cleaned = {r.item_id: r for r in markup.clean_library(texts).collect()}
    assert cleaned["p0"].wrapper == cleaned["p1"].wrapper == "<p> · (<b>)? (·)? (</b>)? (·)? </p>"
    assert cleaned["q0"].wrapper == "<p> · </p>"
    streamed = texts.mapInPandas(markup._streams(True), markup.STREAMED)
    for chunk in (2, 7, markup.CHUNK):
        got = markup.infer_wrappers(streamed, chunk=chunk).where("owner_key = 'r'").collect()
        assert len(got) == len({r.folded for r in got})
        marks = lambda w: {x for g in w for x in g.labels} - {markup.TEXT}
        assert all(markup.Matcher(markup.read_wrapper(r.wrapper)).slots(markup.unfolded(markup.read_wrapper(r.folded))) is not None for r in got)
        ends = [markup.read_wrapper(x) for x in sorted({r.wrapper for r in got})]
        assert len(ends) < len({frozenset(marks(markup.read_wrapper(r.folded))) for r in got})
