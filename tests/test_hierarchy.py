import random

from quillgrid.operators import hierarchy as h

SCHEMA = "paper_key string, section_id string, parent_id string, ordinal int, node string"


def build(spark, rows, **more):
    return h.build_hierarchy(h.links(spark.createDataFrame(rows, SCHEMA), "paper_key", "section_id", "parent_id", "ordinal"), **more)


def test_random_forest_against_walk(spark):
    rng = random.Random(3)
    rows, parent = [], {}
    for p in ("p", "q", None):
        for i in range(60):
            up = rng.choice([None, "", "nowhere", *[f"s{j}" for j in range(60)]])
            rows.append((p, f"s{i}", up, i, "x"))
            parent[(p, f"s{i}")] = up
    rows += rows[:10] + [("p", None, "s1", 0, "x")]
    chain = {}
    for k in parent:
        seen, at = [], k
        while at in parent and at not in seen:
            seen.append(at)
            at = (at[0], parent[at])
        chain[k] = None if at in seen else [n for _, n in reversed(seen)]
    got = build(spark, rows)
    assert {(r.tree, r.node) for r in got.spoilt.collect()} == {k for k, c in chain.items() if c is None}
    nodes = {(r.tree, r.node): r for r in got.nodes.collect()}
    assert {k: list(r.path) for k, r in nodes.items()} == {k: c for k, c in chain.items() if c}
    assert all(r.depth == len(r.path) - 1 and r.root == r.path[0] for r in nodes.values())
    pairs = {(r.tree, r.ancestor, r.descendant, r.distance) for r in h.ancestor_pairs(got.nodes).collect()}
    assert pairs == {(t, c[i], n, len(c) - 1 - i) for (t, n), c in chain.items() if c for i in range(len(c) - 1)}


def test_contradiction_and_empty(spark):
    got = build(spark, [("p", "a", None, 1, ""), ("p", "b", "a", 1, ""), ("p", "b", "b", 0, "")])
    assert got.spoilt.count() == 0 and got.nodes.where("node = 'b'").first().depth == 1
    empty = build(spark, [])
    assert empty.nodes.count() == 0 and empty.spoilt.count() == 0
