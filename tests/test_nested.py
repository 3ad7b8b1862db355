import json

from quillgrid.operators import nested

DOC = {
    "blocks": [
        {"kind": "paragraph", "inlines": [None, "bare", {"kind": "emph", "children": {"kind": "text", "text": "x"}}]},
        {"kind": "list", "items": [{"inlines": {"kind": "text"}, "items": [{"inlines": ["deep"]}]}]},
        {"kind": "table", "table": json.dumps({"rows": [[{"inlines": [{"kind": "math", "tex": "a"}], "colspan": 2}, None]], "caption": "cap"})},
        {"kind": "figure", "figure": {"caption": [json.dumps({"kind": "emph", "children": ["in"]})]}, "meta": {"inlines": ["no"]}},
        "loose",
    ],
    "footnotes": {"inlines": ["f"]},
    "bibliography": [{"inlines": []}, {"inlines": ["[1]"]}],
}
EXPECTED = {
    "/blocks/0/inlines/1", "/blocks/0/inlines/2", "/blocks/0/inlines/2/children/0", "/blocks/1/items/0/inlines/0",
    "/blocks/1/items/0/items/0/inlines/0", "/blocks/2/table/rows/0/0/inlines/0", "/blocks/2/table/caption/0",
    "/blocks/3/figure/caption/0", "/blocks/3/figure/caption/0/children/0", "/footnotes/0/inlines/0", "/bibliography/1/inlines/0",
}


def test_paths_and_tables(spark):
    rows = [(1, "\n" + json.dumps(DOC)), (1, "\n" + json.dumps(DOC)), (2, None), (3, '{"blocks": [{"inl'), (4, "[]"), (5, "")]
    records = spark.createDataFrame(rows, "record_id long, doc_json string")
    got = nested.found(records).collect()
    assert {r.node_path for r in got} == EXPECTED and len(got) == len(EXPECTED)
    for levels in (1, 2):
        flat = nested.flatten_documents(records, "record_id", "doc_json", levels)
        assert {r.node_path for r in nested.inlines(flat, "record_id").collect()} == EXPECTED
    flat = nested.flatten_documents(records, "record_id", "doc_json")
    inline = {r.node_path: r for r in nested.inlines(flat, "record_id").collect()}
    assert inline["/blocks/0/inlines/1"].text == "bare" and inline["/blocks/0/inlines/1"].kind is None
    assert inline["/blocks/2/table/rows/0/0/inlines/0"].parent_path == "/blocks/2/table/rows/0/0"
    cell = nested.cells(flat, "record_id").first()
    assert (cell.row, cell.position, cell.colspan, cell.parent_path) == (0, 0, 2, "/blocks/2")
    assert nested.blocks(flat, "record_id").where("kind = 'list'").count() == 1


def test_empty(spark):
    assert nested.found(spark.createDataFrame([], "record_id long, doc_json string")).count() == 0


def test_deep(spark):
    node = {"kind": "text", "text": "end"}
    for _ in range(40):
        node = {"kind": "emph", "children": [node]}
    records = spark.createDataFrame([(9, json.dumps({"blocks": [{"inlines": [node]}]}))], "record_id long, doc_json string")
    assert nested.found(records).count() == 41
