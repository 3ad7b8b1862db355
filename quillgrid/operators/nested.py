"""Deeply nested documents to flat tables that keep parent–child links.

Method: higher-order SQL projection. Nested ``transform`` calls attach the paths of ancestors and the
positions, ``flatten`` joins the arrays of a level, and ``inline`` emits rows, one table per kind of node.
Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.session import cut_lineage

LEVELS_PER_PASS = 12
ENTRY = "array<struct<target:string,node_path:string,parent_path:string,position:int,node:string>>"
OBJECT = r"^[ \\t\\r\\n]*\\{"
FIELDS = "struct<inlines:string,items:string,table:string,figure:string,children:string>"


# A value of unknown shape is kept as its JSON text; strings are kept as they read. So an object that
# was written as a JSON string needs no case of its own: its text is the object's text.
def _list(v: str) -> str:
    """The entries of a list; a single value is its entry 0; nothing for null."""
    return (
        f"CASE WHEN {v} IS NULL THEN cast(array() AS array<string>)"
        f" WHEN {v} RLIKE '^[ \\\\t\\\\r\\\\n]*\\\\[' THEN coalesce(from_json({v}, 'array<string>'), array({v}))"
        f" ELSE array({v}) END"
    )


def _entries(target: str, parent: str, under: str, values: str) -> str:
    """Entries for the non-null ``values``; null values keep their position for those after them."""
    return (
        f"filter(transform({_list(values)}, (v, i) -> named_struct('target', '{target}',"
        f" 'node_path', concat({under}, '/', i), 'parent_path', {parent}, 'position', i, 'node', v)),"
        f" x -> x.node IS NOT NULL)"
    )


def _under(name: str) -> str:
    return f"concat(e.node_path, '/{name}')"


def _parsed(text: str, fields: str) -> str:
    return f"from_json(CASE WHEN {text} RLIKE '{OBJECT}' THEN {text} END, '{fields}')"


def _is_object(text: Column) -> Column:
    return text.rlike(r"^[ \t\r\n]*\{")


def _expand() -> str:
    """The entries right below an entry ``e``."""
    path = "e.node_path"
    inlines = _entries("inline", path, _under("inlines"), "n.inlines")
    cells = (
        f"flatten(transform({_list('t.rows')}, (r, k) -> "
        + _entries("cell", path, "concat(e.node_path, '/table/rows/', k)", "r")
        + "))"
    )
    table = (
        f"flatten(transform(array({_parsed('n.table', 'struct<rows:string,caption:string>')}), t -> concat({cells}, "
        + _entries("inline", path, _under("table/caption"), "t.caption")
        + ")))"
    )
    figure = (
        f"flatten(transform(array({_parsed('n.figure', 'struct<caption:string>')}), f -> "
        + _entries("inline", path, _under("figure/caption"), "f.caption")
        + "))"
    )
    block = f"concat({inlines}, {_entries('block', path, _under('items'), 'n.items')}, {table}, {figure})"
    children = _entries("inline", path, _under("children"), "n.children")
    return (
        f"flatten(transform(array({_parsed('e.node', FIELDS)}), n -> "
        f"CASE e.target WHEN 'inline' THEN {children} WHEN 'cell' THEN {inlines} ELSE {block} END))"
    )


def _grow(df: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """``df`` has an array ``l0`` of entries; a row per entry of it and of ``levels`` levels below."""
    for i in range(levels):
        df = df.withColumn(f"l{i + 1}", F.expr(f"flatten(transform(l{i}, e -> {_expand()}))"))
    tagged = [
        f"transform(l{i}, e -> named_struct('target', e.target, 'node_path', e.node_path,"
        f" 'parent_path', e.parent_path, 'position', e.position, 'node', e.node, 'level', {i}))"
        for i in range(levels + 1)
    ]
    return df.select(*keep, F.expr(f"inline(concat({', '.join(tagged)}))"))


def flatten_documents(
    records: DataFrame, key: str, doc: str, levels_per_pass: int = LEVELS_PER_PASS
) -> DataFrame:
    """All nodes of all readable records: (key, target, node_path, parent_path, position, node).

    ``target`` is ``block`` (blocks, list items, footnotes, bibliography entries), ``cell`` or ``inline``.
    ``node`` is the node's JSON, or the string itself. ``parent_path`` is the node that holds this one, null
    at the root. A record whose JSON is null, broken off or no object gives no rows; repeated
    records give their rows as often as they are stored. Any depth is followed: a pass unrolls
    ``levels_per_pass`` levels in one projection, and the nodes of its last level start another pass as
    long as there are any. Each pass is checkpointed.
    """
    readable = records.where(F.try_parse_json(F.col(doc)).isNotNull() & _is_object(F.col(doc)))
    names = ("blocks", "footnotes", "bibliography")
    root = F.from_json(F.col(doc), f"struct<{','.join(n + ':string' for n in names)}>")
    none = "cast(null AS string)"
    roots = [_entries("block", none, f"'/{n}'", f"root.{n}") for n in names]
    level = (
        readable.select(F.col(key), root.alias("root"))
        .select(key, F.expr(f"concat({', '.join(roots)})").cast(ENTRY).alias("l0"))
    )
    result: DataFrame | None = None
    while True:
        made = cut_lineage(_grow(level, [key], levels_per_pass))
        part = made.where(F.col("level") < levels_per_pass)
        result = part if result is None else result.unionByName(part)
        last = made.where(F.col("level") == levels_per_pass)
        if last.isEmpty():
            return result.drop("level")
        level = last.select(
            key, F.array(F.struct("target", "node_path", "parent_path", "position", "node")).cast(ENTRY).alias("l0")
        )


def _fields(names: str) -> Column:
    return F.from_json(F.when(_is_object(F.col("node")), F.col("node")), names)


def inlines(flat: DataFrame, key: str) -> DataFrame:
    """(key, node_path, parent_path, position, kind, text, tex, href, label): objects and bare strings.

    A bare string is an inline without kind whose text it is. Verbatim repeats of a record collapse.
    """
    got = flat.where(F.col("target") == "inline").withColumn(
        "o", _fields("kind string, text string, tex string, href string, label string")
    )
    text = F.when(F.col("o").isNull() | ~_is_object(F.col("node")), F.col("node")).otherwise(F.col("o.text"))
    return got.select(
        key, "node_path", "parent_path", "position", "o.kind", text.alias("text"), "o.tex", "o.href", "o.label"
    ).distinct()


def blocks(flat: DataFrame, key: str) -> DataFrame:
    """(key, node_path, parent_path, position, kind, id, level, tex, text, language, ordered)."""
    got = flat.where((F.col("target") == "block") & _is_object(F.col("node"))).withColumn(
        "o",
        _fields("kind string, id string, level int, tex string, text string, language string, ordered boolean"),
    )
    return got.select(key, "node_path", "parent_path", "position", "o.*").distinct()


def cells(flat: DataFrame, key: str) -> DataFrame:
    """(key, node_path, parent_path, row, position, rowspan, colspan, header, align)."""
    got = flat.where((F.col("target") == "cell") & _is_object(F.col("node"))).withColumn(
        "o", _fields("rowspan int, colspan int, header boolean, align string")
    )
    return got.select(
        key,
        "node_path",
        "parent_path",
        F.regexp_extract("node_path", r"/(\d+)/\d+$", 1).cast("int").alias("row"),
        "position",
        F.coalesce("o.rowspan", F.lit(1)).alias("rowspan"),
        F.coalesce("o.colspan", F.lit(1)).alias("colspan"),
        F.coalesce("o.header", F.lit(False)).alias("header"),
        "o.align",
    ).distinct()


def found(records: DataFrame) -> DataFrame:
    """(record_id, node_path) of every inline in a readable record of ``ir_documents``."""
    flat = flatten_documents(records, "record_id", "doc_json")
    return flat.where(F.col("target") == "inline").select("record_id", "node_path").distinct()
