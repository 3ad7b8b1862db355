import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrid.llm import leakage, markup, matching, names, packing, spam, splitting

BLOCKS = "id long, paper_key string, section_id string, ordinal int, kind string, text string, span int"


# Splitting


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n,;", max_size=700), st.integers(10, 80), st.integers(0, 9))
def test_pieces_round_trip(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end in pieces) == text
    assert all(end - start <= limit for start, _, end in pieces)
    assert all(0 <= own - start <= overlap for start, own, _ in pieces) and pieces[0][0] == pieces[0][1]


def test_cuts_at_the_strongest_boundary():
    text = "a" * 40 + ". " + "b" * 8 + "\n\n" + "c" * 50
    assert [text[o:e] for _, o, e in splitting.split_text(text, 60, 5)][0].endswith("\n\n")


def test_split_library(spark):
    rows = [(1, "p", "s", 0, "paragraph", "w " * 1500, 0)] * 2 + [(i, "p", "s", i, "paragraph", "x" * 1000, 0) for i in range(2, 12)]
    rows += [(20, "p", "t", 0, "heading", None, 0), (21, "p", None, 0, None, "", 0), (None, "q", "u", 0, "list", "y" * 13000, 0)]
    blocks = spark.createDataFrame(rows, BLOCKS)
    got = {tuple(r) for r in splitting.found(blocks).collect()}
    assert got == {("block", "p", "1"), ("section", "p", "s"), ("block", "q", None), ("section", "q", "u")}
    pieces = splitting.split_library(blocks).toPandas()
    assert pieces.piece_text.str.len().max() <= 2000 and (pieces.n_overlap <= 200).all()
    spans = splitting.section_spans(blocks, splitting.oversized_sections(blocks), 3000).toPandas()
    own = spans[spans.section_id == "s"].sort_values("span")
    assert len(own) > 3 and "".join(own.text).replace("\n\n", "") == "w " * 1500 + "x" * 10000
    assert splitting.found(blocks.where("id < 0")).count() == 0


# Packing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80), st.sampled_from(["norm", "dot"]))
def test_best_fit_holds_every_capacity(sizes, rule):
    c = packing.Capacity(tokens=100, documents=7, attention=9_000.0, rule=rule)
    sizes = [s for s in sizes if s * s <= c.attention]
    where = packing.best_fit(np.array(sizes, dtype=np.int64), c)
    for k in set(where.tolist()):
        own = [s for s, w in zip(sizes, where) if w == k]
        assert sum(own) <= 100 and len(own) <= 7 and sum(s * s for s in own) <= 9_000 + 1e-6


def test_pack_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randint(1, 900)), "c") for i in range(300)] + [(900, "word " * 5000, "c"), (901, None, "c"), (902, "", "c"), (902, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, container string").repartition(3)
    packed = packing.pack_documents(docs, group=128).toPandas()
    assert packed.groupby("container").n_tokens.sum().max() <= 2048 and (packed.groupby("container").size() <= 64).all()
    parts = packed.groupby("doc_id").part.count()
    assert set(parts.index) == {r[0] for r in rows} and (parts[parts.index < 900] == 1).all()
    size = len(packing.encoder(packing.TOKENIZER).encode_ordinary("word " * 5000))
    assert packed[packed.doc_id == 900].n_tokens.sum() == size
    assert packing.pack_documents(docs.where("doc_id < 0")).count() == 0


# Leakage

ITEM = "Pick the best answer.\n" + " ".join(f"word{i}" for i in range(60)) + "\nWhat is it?\nA) one B) two"
ITEMS = [(1, ITEM, "x"), (2, ITEM.replace("word", "term"), "x"), (3, "Pick the best answer.\n" + " ".join(f"zed{i}" for i in range(30)), "x"), (4, None, "x"), (5, "short", "x")]


def stretch(a, b, stem="word"):
    return [f"{stem}{i}" for i in range(a, b)]


def test_leaked_items(spark):
    pad = [f"filler{i}" for i in range(400)]
    changed, added, missing = stretch(10, 30), stretch(10, 30), stretch(10, 31)
    changed[5], changed[12] = "other", "other2"
    added[7:7] = ["plus"]
    added[15:15] = ["more"]
    del missing[9]
    cases = {
        10: pad + stretch(5, 25) + pad, 11: pad[:3] + changed, 12: added + pad, 13: pad + missing, 14: stretch(0, 17) + ["x"] + pad,
        15: pad + stretch(0, 9) + ["q"] + stretch(20, 30), 16: pad, 17: pad + stretch(40, 60, "term"),
    }
    three = stretch(10, 30)
    three[4], three[9], three[14] = "q", "r", "s"
    cases[18] = pad + three
    docs = [(k, " ".join(v), "src") for k, v in cases.items()]
    docs += [(20, "<b>" + "</b> **".join(stretch(5, 30)).upper() + "**", "s"), (21, "wo-\nrd5 " + "\u200b,\n".join(stretch(6, 30)), "s"), (22, None, "s"), (23, "", "s")]
    got = leakage.leaked_items(spark.createDataFrame(docs * 2, "doc_id long, text string, source string"), spark.createDataFrame(ITEMS, "item_id long, text string, task string"))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == [(10, 1), (11, 1), (12, 1), (13, 1), (17, 2), (20, 1), (21, 1)]
    blocks = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(ITEMS[:2], "item_id long, text string, task string"), item_block=1)
    assert sorted(tuple(r) for r in blocks.collect()) == sorted(rows)
    nothing = spark.createDataFrame([], "item_id long, text string, task string")
    assert leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string, source string"), nothing).count() == 0


def test_sketch_recall_against_brute_force():
    rng = random.Random(5)
    bodies = [(i, [f"v{rng.randint(0, 4000)}" for _ in range(80)]) for i in range(40)]
    index = leakage.ItemIndex(bodies)
    hits = 0
    for trial in range(300):
        item, words = bodies[trial % 40]
        at = rng.randint(0, 60)
        own = words[at : at + 20]
        for _ in range(2):
            own[rng.randint(0, 19)] = "changed"
        doc = [f"d{rng.randint(0, 9000)}" for _ in range(rng.randint(0, 300))]
        k = rng.randint(0, len(doc))
        codes = np.array([leakage.word_code(w) for w in doc[:k] + own + doc[k:]], dtype=np.uint64)
        hits += (0, trial % 40) in index.leaks(codes, np.array([0, len(codes)]))
    assert hits >= 299


# Spam

PROSE = "The effect of the method on the results is small, and we think that it was caused by the way in which the samples had been stored before the test. " * 3


@pytest.mark.parametrize(
    "text, is_spam",
    [
        ("cheap essay, term paper, lab coat, " * 30, True), ("cheap essay near Town%d, " * 40 % tuple(range(40)), True),
        ("\n".join(f"https://x.example/{i}" for i in range(30)), True), ("#one #two #three " * 20, True),
        ("Why cheap essay? Because cheap essay is cheap essay. Our cheap essay team offers cheap essay. " * 8, True),
        (PROSE, False), ("", False), (None, False), ("n/a", False),
        ("\n".join(f"* Name{i} (https://l.example/{i}). {s}." for i, s in enumerate(["We compare the two methods and find that they agree on most of it"] * 9)), False),
        ("Contents\n" + "\n".join(f"{i}. Topic{i} and its role in field{i} ... {7 * i}" for i in range(30)), False),
        ("\n".join(f"Name{i} | 0.{i:03d} | {i * 7}" for i in range(40)), False),
    ],
)
def test_spam_share(text, is_spam):
    assert (spam.analyse(text)[0] > 0.5) == is_spam


def test_spam_table(spark):
    docs = spark.createDataFrame([(1, "lab coat, " * 60, 0.1), (1, "lab coat, " * 60, 0.1), (2, None, 0.2), (None, "lab coat, " * 60, 0.2)], "doc_id long, text string, spam_share double")
    assert {r.doc_id for r in spam.found(docs).collect()} == {1, None}
    assert spam.found(docs.where("doc_id > 9")).count() == 0


def test_gaps_and_lags():
    codes = np.array([1, 2, 1, 3, 2, 1])
    assert spam.recurrence_gaps(codes).tolist() == [2, 3, 2, spam.FAR, 3, 3]
    assert spam.autocorrelation(np.tile([1, 2, 3], 8), 6).argmax() + 1 == 3


# Markup


@pytest.mark.parametrize(
    "text, clean",
    [
        ("a <b>c</b> d", "a c d"), ("x&nbsp;y &amp; z", "x y & z"), ("## H\ntext", "## H\ntext"), ("== H ==", "## H"), ("\\section{H} t", "# H\n t"),
        ("see [t](http://u.example) now", "see t now"), ("[[A|b]] c", "b c"), ("''i'' and '''b'''", "i and b"), ("~~old~~ new", "old new"),
        ("by \\citep{k} us", "by us"), ("10\\% of", "10% of"), ("\\textit{a b} c", "a b c"), ("- \\item one", "- - one"), ("H\n=====\nx", "H\n\nx"),
        ("**b** c", "b c"), ("__one__ two", "one two"), ("Title {#sec-1}", "Title"), ("> quoted", "quoted"), ("*a b* c", "a b c"),
    ],
)
def test_residue(text, clean):
    tokens = markup.tokens_of_text(text)
    assert tokens and markup.clean_text(text, tokens) == clean


@pytest.mark.parametrize(
    "text",
    ["a < b and b > 3", "2 * c * n", "0.1*** differ", "C:\\data\\ta held", "hook __init_r__ is", "max_k_size", "R&D as #1", "C# and F#", "like 2^r", "{a, b, 3}",
     "$a_{1} < b$ is", "see [12, 3] and [bib.b1]", "- one\n- two", "parse -> align", "pages 3 | 4", "l'un et l'autre", "$\\begin{cases} a & b \\\\ c & d \\end{cases}$ (1)"],
)
def test_ordinary_signs(text):
    assert not markup.tokens_of_text(text)


@pytest.mark.parametrize(
    "tex, clean",
    [("$$x$$", "x"), ("\\(x\\)", "x"), ("x \\tag{3}", "x"), ("\\begin{align*} x \\nonumber \\end{align*}", "x"), ("x &lt; 3", "x < 3"), ("<mi>x</mi>", "x"),
     ("\\begin{equation} x \\label{eq:a} \\end{equation}", "x")],
)
def test_tex_residue(tex, clean):
    tokens = markup.tokens_of_tex(tex)
    assert tokens and markup.clean_tex(tex, tokens) == clean


@pytest.mark.parametrize("tex", ["\\begin{pmatrix} 1 & a \\\\ b & 2 \\end{pmatrix}", "\\begin{aligned} a \\\\[2pt] b \\end{aligned}", "\\{0, 1\\}^{x} < 3"])
def test_formulas(tex):
    assert not markup.tokens_of_tex(tex)


def test_wrappers():
    w = markup.Wrappers()
    k = w.add(("<p>", "·", "</p>"))
    assert w.add(("<p>", "·", "<b>", "·", "</b>", "</p>")) == k and w.describe(k) == "<p> · (<b>)? (·)? (</b>)? </p>"
    assert w.add(("<p>", "·", "</p>")) == k
    r = markup.Wrappers()
    n = r.add(("<li>", "·", "</li>", "<li>", "·", "</li>"))
    assert r.describe(n) == "(<li> · </li>)+"


def test_found_table(spark):
    blocks = spark.createDataFrame(
        [(1, "p", "s", 0, "code", "<b>x</b>", 0), (2, "p", "s", 1, "list", "- <li>x</li>", 0), (2, "p", "s", 1, "list", "- <li>x</li>", 0), (3, "p", None, 2, None, "a &lt; b", 0), (4, None, None, 3, "paragraph", None, 0), (5, "p", "s", 4, "paragraph", "", 0)],
        BLOCKS,
    )
    equations = spark.createDataFrame([("E1", "p", "\\[ x \\]", "n"), ("E2", "p", "x", "n"), (None, None, None, None)], "id string, paper_key string, tex string, text string")
    doc = '{"blocks": [{"inlines": [{"kind": "math", "tex": "$x$"}, {"kind": "math", "tex": "x"}]}]}'
    ir = spark.createDataFrame([(7, doc), (8, None)], "record_id long, doc_json string")
    got = sorted(tuple(r) for r in markup.found(blocks, equations, ir).collect())
    assert got == [("blocks", "p", "2"), ("blocks", "p", "3"), ("equations", "p", "E1"), ("ir_documents", "7", "/blocks/0/inlines/0")]


# Names

PERSONS = [
    ["Konstantin Petersen", "konstantin petersen", "Petersen, Konstantin", "Petersen Konstantin", "K. Petersen", "Petersen K", "Dr. Konstantin Petersen, PhD", "Kostya Petersen",
     "Konstantin Petresen", "Konstantin\u00a0Petersen", "Konstantin Pétersen", 'Konstantin "Kostya" Petersen', "Kons. Petersen"],
    ["Katarina Petrosyan", "Katarina M. Petrosyan", "Petrosyan, K. M."], ["Ming-Hao Talvela", "M.-H. Talvela", "Ming Hao Talvela"],
    ["The Rosebud Collaboration", "Rosebud collab.", "Rosebud-Collaboration", "on behalf of the Rosebud Collaboration"], ["Konstantin Barlow"], ["Samuel Petersen"],
]


def test_names(spark):
    rows = [(n, "p", "x") for person in PERSONS for n in person] + [("Konstantin Petersen", "p", "x")] * 5
    rows += [(n, "p", "x") for n in ("", None, "N/A", "et al.", "Anonymous")] + [(f"Konstantin {s}", "p", "x") for s in ("Vaara", "Wickham", "Zoltan")] * 2
    authors = spark.createDataFrame(rows, "name string, paper_key string, entity string")
    got = {tuple(r) for r in names.found(authors).collect()}
    want = {(a, b) for person in PERSONS for a in person for b in person if a.encode() < b.encode()}
    assert got == want
    assert names.found(authors.where("name = 'none'")).count() == 0


def test_segment_join_against_brute_force(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 8))) for _ in range(120)})
    keys = spark.createDataFrame([("g", w) for w in words] + [("h", words[0])], "w string, t string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(a, b) for a in words for b in words if a != b and len(a) > 2 and len(b) > 2 and distance(a, b) <= 2}
    assert {(r.a, r.b) for r in names.segment_join(keys, "w", "t").collect()} == want


# Matching


def test_matching(spark):
    topics = ["Sparse Decoding", "Graph Smoothing", "Weak Labelling", "Rank Fusion", "Lattice Search", "Query Rewriting"]
    fields = ["Soil Chemistry", "Snow Physics", "Legal History", "Crystal Growth", "Wind Forecasting"]
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize()
    titles = [f"{word()}: {rng.choice(topics)} for {rng.choice(topics)} in {rng.choice(fields)}" for _ in range(60)]
    from datetime import datetime

    t0, t1 = datetime(2024, 1, 1), datetime(2024, 2, 1)
    papers = [(f"k{i}", t, f"10.9999/x.{i}", None, "indexed", t0, t0, "n") for i, t in enumerate(titles)]
    papers += [("k59", titles[59], None, None, "dropped", t0, t1, "n"), ("kn", None, None, None, "indexed", t0, t0, "n")]
    typo = titles[1].replace("for", "fro", 1)
    refs = [
        ("s", "b0", f"A. Autor. {titles[0]}. In Journal of Tests, 2020.", None, None, None), ("s", "b1", None, typo, None, None),
        ("s", "b2", f"[3] Autor B, Other C. Comments on {titles[2]}. J. Tests. 2020", f"Comments on {titles[2]}", None, None),
        ("s", "b3", f"Autor, “{titles[3]} II,” J. Tests, vol. 3", None, None, None), ("s", "b4", None, titles[4][:32].rsplit(" ", 1)[0] + "...", None, None),
        ("s", "b5", "Autor (2018) J. Tests 3:4", None, "doi:10.9999/X.5.", None), ("s", "b6", f"Given Surname: {titles[6].upper()}. 2021", None, None, None),
        ("s", "b7", "Something else altogether. J. Tests, 2020", None, None, None), ("s", "b59", None, titles[59], None, None), ("s", None, None, None, None, None),
        ("s", "b8", f"A. Autor: {titles[8]}: A Survey. 2020", f"{titles[8]}: A Survey", None, None),
    ]
    r = spark.createDataFrame(refs * 2, "src_key string, bibkey string, raw string, title string, doi string, arxiv_id string")
    p = spark.createDataFrame(papers, "key string, title string, doi string, arxiv_id string, status string, created_at timestamp, updated_at timestamp, raw string")
    small = matching.Parameters(sample=200)
    got = matching.match_references(r, p, small).toPandas()
    assert {(x.bibkey, x.paper_key) for x in got.itertuples()} == {("b0", "k0"), ("b1", "k1"), ("b4", "k4"), ("b5", "k5"), ("b6", "k6")}
    assert len(got) == 5 and got.confidence.isna().all()  # too few pairs of equal identifier to calibrate with
    more = spark.createDataFrame([("s", f"c{i}", None, titles[i], f"10.9999/x.{i}", None) for i in range(10, 40)], r.schema)
    calibrated = matching.match_references(r.unionByName(more), p, small).toPandas()
    assert len(calibrated) == 35 and calibrated.confidence.between(0, 1).all()
    assert matching.match_references(r.where("bibkey = 'none'"), p, small).count() == 0
    assert matching.match_references(r, p.where("key = 'none'"), small).count() == 0


def test_stretches_lose_no_pair():
    rng = random.Random(6)
    p = matching.Parameters()
    for _ in range(3000):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(4, 9))]
        title, ends = "".join(words), np.cumsum([len(w) for w in words]).tolist()
        if len(title) < p.shortest:
            continue
        letters = list(title)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(letters))
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "x"])
        x = "".join(letters)
        if len(x) <= len(title) + 1:
            assert set(matching.span_keys(x, p)) & set(matching.title_keys(title, ends, p)), (title, x)
        cut = rng.choice([e for e in ends]) + rng.randint(-1, 1)
        if matching.BEGINNING <= cut < len(title):
            at = rng.randrange(cut)
            x = title[:at] + "x" + title[at + 1 : cut]
            assert set(matching.span_keys(x, p)) & set(matching.title_keys(title, ends, p)), (title, x)


@pytest.mark.parametrize("size", [150, 2400])
def test_recall_does_not_depend_on_the_number_of_papers(spark, size):
    from datetime import datetime

    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(500)]
    titles = {f"k{i}": " ".join(rng.sample(vocabulary, 9)) for i in range(size)}
    refs = []
    for key in list(titles)[:150]:
        letters = list(titles[key])
        spots = rng.choice([(0, 5), (1, 9), (4, 14)])
        for at in sorted(spots, reverse=True):
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "q"])
        refs.append(("s", key, None, "".join(letters), None, None))
    day = datetime(2024, 1, 1)
    r = spark.createDataFrame(refs, "src_key string, bibkey string, raw string, title string, doi string, arxiv_id string")
    p = spark.createDataFrame(
        [(k, t, None, None, "indexed", day, day) for k, t in titles.items()],
        "key string, title string, doi string, arxiv_id string, status string, created_at timestamp, updated_at timestamp",
    )
    got = {(x.bibkey, x.paper_key) for x in matching.match_references(r, p, matching.Parameters(sample=200)).collect()}
    want = {(k, k) for _, k, _, t, _, _ in refs if len(t.replace(" ", "")) <= len(titles[k].replace(" ", "")) + 1}
    assert want <= got and len(want) > 90


def test_vectors_take_all_words():
    p = matching.Parameters()
    rng = np.random.default_rng(3)
    encoder = matching.Encoder(rng.normal(size=(p.buckets, p.dimensions)).astype(np.float32), np.ones(p.slots, dtype=np.float32), 100, p)
    a, b, c = encoder.vectors(["one two three four five six seven", "one two three four five other words", "oen tow three four five six seven"])
    assert a @ b < 0.95 and a @ c > 0.6
    # Signatures take all words too.
    assert (encoder.signatures(np.stack([a])) != encoder.signatures(np.stack([b]))).any()


def test_a_spoilt_beginning_is_found():
    p = matching.Parameters()
    ends = np.cumsum([len(w) for w in "zarefita and the problem of note retrieval".split()]).tolist()
    title = "zarefitaandtheproblemofnoteretrieval"
    for x in ("zaerfitaandtheproblemofnoteretrieval", "arefitandtheproblemofnoteretrieval", "zarefitaandtheproblemofnoteretreival"):
        assert set(matching.span_keys(x, p)) & set(matching.title_keys(title, ends, p))


def test_spam_at_far_lags_and_lists_without_recurrence():
    sentence = "We offer the cheapest essay that a tired student in your town could ever want to buy from those writers."
    assert spam.analyse(sentence * 12)[0] > 0.5
    long = "The finest garden chairs are now with us and their wooden legs were made by hand for you, while our cushions come from silk out of distant valleys."
    assert spam.analyse(f"{long} " * 9)[0] > 0.5 and spam.analyse(f"{PROSE[:150]} {long}")[0] < 0.5
    distinct = ["".join(c) for c in itertools.product("bdf", "aeiou", "klm", "aou")]
    assert spam.analyse(", ".join(distinct))[0] > 0.5
    assert spam.analyse("; ".join(" ".join(distinct[i : i + 8]) + " in the" for i in range(0, 120, 8)))[0] < 0.5
    held = np.array([False, False, True, False])
    assert spam.stretches_without(held).tolist() == [2, 2, 0, 1]
    codes = np.random.default_rng(1).integers(0, 6, 100)
    want = [spam.autocorrelation(codes[min(s, 70) : min(s, 70) + 30], 15).max() for s in range(0, 100, 30)]
    begin = spam._begins(len(codes), 30)
    assert spam.best_agreements(codes, begin, np.full(len(begin), 30), 15) == pytest.approx(want)


def test_pieces_go_on_over_the_spans_of_a_section(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(5, 300))) for _ in range(40)]
    blocks = spark.createDataFrame([(i, "p", "s", i, "paragraph", t, 0) for i, t in enumerate(texts)], BLOCKS)
    pieces = splitting.split_sections(blocks, span_chars=4_000).toPandas().sort_values("piece")
    assert pieces.span.nunique() > 4 and pieces.piece.tolist() == list(range(len(pieces))) and pieces.span.is_monotonic_increasing
    assert pieces.piece_text.str.len().max() <= 2000 and pieces.n_overlap.iloc[0] == 0 and pieces.n_overlap.iloc[1:].between(1, 200).all()
    own = [t[n:] for t, n in zip(pieces.piece_text, pieces.n_overlap)]
    assert "".join(own) == "\n\n".join(texts)
    assert all(a.endswith(t[:n]) for a, t, n in zip(pieces.piece_text, pieces.piece_text[1:], pieces.n_overlap[1:]))
