"""Navigation, accessors, source spans, equality: joins and expressions over the node relation.

Of packed trees (trees.py), which stand where the node relation does, the nodes asked about are told by a function of a
node; a node is then found by its place in its document, and nothing is joined, sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .interval import within
from .trees import FIELDS, is_packed, node_at, subtree, unpacked

Nodes = DataFrame | Callable[[Column], Column]  # rows of the node relation, or which nodes of packed trees


def _each(trees: DataFrame, found: Column) -> DataFrame:
    return unpacked(trees.select("doc_id", found.alias("tree")))


def _row(of: Column, n: Column) -> Column:
    return F.struct(of.alias("of"), *[n[c].alias(c) for c in FIELDS])


def _below(of: Callable[[Column], Column], trees: DataFrame, test: Callable[[Column, Column], Column]) -> DataFrame:
    """The children that pass a test of (parent, child), by their parents."""
    found = F.filter("tree", lambda n: n["parent_id"].isNotNull() & of(node_at(n["parent_id"])) & test(node_at(n["parent_id"]), n))
    return _each(trees, F.transform(found, lambda n: _row(n["parent_id"], n)))


def _pairs(a: DataFrame, b: DataFrame, cond) -> DataFrame:
    """(doc_id, of: a node of ``a``, columns of ``b``) of pairs in one document."""
    left = a.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("of"), F.col("parent_id").alias("_p"), F.col("last_desc").alias("_l"))
    return left.join(b, (b["doc_id"] == left["_d"]) & cond(left, b)).drop("_d", "_p", "_l")


def children(of: Nodes, nodes: DataFrame) -> DataFrame:
    if is_packed(nodes):
        return _below(of, nodes, lambda p, n: F.lit(True))
    return _pairs(of, nodes, lambda a, b: b["parent_id"] == a["of"])


def elements(of: Nodes, nodes: DataFrame) -> DataFrame:
    if is_packed(nodes):
        return _below(of, nodes, lambda p, n: n["kind"] == "Element")
    return children(of, nodes.where(F.col("kind") == "Element"))


def child_at(of: Nodes, nodes: DataFrame, position: int) -> DataFrame:
    if is_packed(nodes):
        return _below(of, nodes, lambda p, n: n["child_pos"] == position)
    return children(of, nodes.where(F.col("child_pos") == position))


def parent(of: Nodes, nodes: DataFrame) -> DataFrame:
    if is_packed(nodes):
        return _each(nodes, F.transform(F.filter("tree", lambda n: of(n) & n["parent_id"].isNotNull()), lambda n: _row(n["node_id"], node_at(n["parent_id"]))))
    return _pairs(of, nodes, lambda a, b: b["node_id"] == a["_p"])


def siblings(of: Nodes, nodes: DataFrame) -> DataFrame:
    """The siblings of some nodes, a row a pair. For all nodes of a wide parent that is its square: see sibling_counts()."""
    if is_packed(nodes):
        beside = lambda o: F.filter(subtree(node_at(o["parent_id"])), lambda n: (n["parent_id"] == o["parent_id"]) & (n["node_id"] != o["node_id"]))
        some = F.filter("tree", lambda n: of(n) & n["parent_id"].isNotNull())
        return _each(nodes, F.flatten(F.transform(some, lambda o: F.transform(beside(o), lambda n: _row(o["node_id"], n)))))
    return _pairs(of, nodes, lambda a, b: (b["parent_id"] == a["_p"]) & (b["node_id"] != a["of"]))


def descendants(of: DataFrame, nodes: DataFrame, or_self: bool = False) -> DataFrame:
    spans = of.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("of"), F.col("last_desc").alias("_l"))
    return within(spans, nodes, first="of", or_self=or_self).select("of", *nodes.columns)


def ancestors(of: DataFrame, nodes: DataFrame) -> DataFrame:
    own = [F.col(c).alias(f"_own_{c}") for c in nodes.columns]
    spans = nodes.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col("last_desc").alias("_l"), *own)
    found = within(spans, of.select("doc_id", "node_id"), or_self=False)
    return found.select(F.col("node_id").alias("of"), *[F.col(f"_own_{c}").alias(c) for c in nodes.columns])


def sibling_counts(of: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, siblings): how many each node has, without a row a pair; 0 for what has no parent."""
    kids = nodes.where("parent_id is not null").groupBy(F.col("doc_id").alias("_d"), F.col("parent_id").alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    j = of.join(kids, (of["doc_id"] == kids["_d"]) & (of["parent_id"] == kids["_p"]), "left")
    return j.select("doc_id", "node_id", F.coalesce(F.col("_k") - 1, F.lit(0)).alias("siblings"))


def resume(of: Nodes, nodes: DataFrame) -> DataFrame:
    """Where reading goes on after each node's subtree is skipped: the one node that follows it, if any does."""
    if is_packed(nodes):
        return _each(nodes, F.transform(F.filter("tree", lambda n: of(n) & (n["last_desc"] < F.size("tree"))), lambda n: _row(n["node_id"], node_at(n["last_desc"] + 1))))
    return _pairs(of, nodes, lambda a, b: b["node_id"] == a["_l"] + 1)


def events(nodes: DataFrame) -> DataFrame:
    """(doc_id, seq, event, node_id, kind, tag, value, attrs, depth): a pull reader's steps in order, from 1: "node" for
    each node but the Document, and "end" after what an Element or the Document holds."""
    at = lambda a, b, c, name: F.struct(a.alias("a"), F.lit(b).alias("b"), c.alias("c"), F.lit(name).alias("name"))
    begin, end = at(F.col("node_id"), 0, F.lit(0), "node"), at(F.col("last_desc"), 1, -F.col("depth"), "end")
    both = F.when(F.col("kind") == "Document", F.array(end)).when(F.col("kind") == "Element", F.array(begin, end)).otherwise(F.array(begin))
    rows = nodes.withColumn("_e", F.explode(both))
    order = Window.partitionBy("doc_id").orderBy("_e.a", "_e.b", "_e.c")
    return rows.select("doc_id", F.row_number().over(order).alias("seq"), F.col("_e.name").alias("event"), "node_id", "kind", "tag", "value", "attrs", "depth")


def depth_below(of: Nodes, roots: Nodes, trees: DataFrame | None = None) -> DataFrame:
    """(doc_id, root, node_id, depth): how far each node lies below each of ``roots`` that holds it; 0 for itself. Of packed
    ``trees`` the node's tag comes too."""
    if trees is not None:
        row = lambda r, n: F.struct(r["node_id"].alias("root"), n["node_id"].alias("node_id"), (n["depth"] - r["depth"]).alias("depth"), n["tag"].alias("tag"))
        return _each(trees, F.flatten(F.transform(F.filter("tree", roots), lambda r: F.transform(F.filter(subtree(r), of), lambda n: row(r, n)))))
    spans = roots.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("root"), F.col("last_desc").alias("_l"), F.col("depth").alias("_depth"))
    return within(spans, of, first="root").select("doc_id", "root", "node_id", (F.col("depth") - F.col("_depth")).alias("depth"))


def same_node(a: DataFrame, b: DataFrame) -> Column:
    """Whether rows of two frames are one node: the same place in one document, not merely alike."""
    return (a["doc_id"] == b["doc_id"]) & (a["node_id"] == b["node_id"])


def leaves(nodes: DataFrame) -> DataFrame:
    """The nodes without children: these and no others are their own last descendant."""
    return nodes.where(F.col("last_desc") == F.col("node_id"))


def get(name: str, default: str | None = None, attrs: Column | None = None) -> Column:
    """An attribute's value, or a default."""
    attrs = F.col("attrs") if attrs is None else attrs
    found = F.get(F.filter(attrs, lambda a: a["name"] == name), 0)["value"]
    return F.coalesce(found, F.lit(default)) if default is not None else found


def required(name: str) -> Column:
    """An attribute's value; the job fails where it is missing."""
    return F.coalesce(get(name), F.raise_error(F.lit(f"no attribute {name}")).cast("string"))


def haskey(name: str) -> Column:
    return F.exists("attrs", lambda a: a["name"] == name)


def keys() -> Column:
    return F.transform("attrs", lambda a: a["name"])


def values() -> Column:
    return F.transform("attrs", lambda a: a["value"])


def child_counts(of: Nodes, nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, length): how many children each node has, 0 for none."""
    if is_packed(nodes):
        many = lambda o: F.size(F.filter(subtree(o), lambda n: n["parent_id"] == o["node_id"])).cast("long")
        return _each(nodes, F.transform(F.filter("tree", of), lambda o: F.struct(o["node_id"].alias("node_id"), many(o).alias("length"))))
    kids = nodes.where("parent_id is not null").groupBy(F.col("doc_id").alias("_d"), F.col("parent_id").alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    j = of.join(kids, (of["doc_id"] == kids["_d"]) & (of["node_id"] == kids["_p"]), "left")
    return j.select("doc_id", "node_id", F.coalesce("_k", F.lit(0)).alias("length"))


def last_child(of: Nodes, nodes: DataFrame) -> DataFrame:
    """Each node's last child: the one whose subtree ends where its parent's does."""
    if is_packed(nodes):
        return _below(of, nodes, lambda p, n: n["last_desc"] == p["last_desc"])
    return _pairs(of, nodes, lambda a, b: (b["parent_id"] == a["of"]) & (b["last_desc"] == a["_l"]))


def only_child(of: Nodes, nodes: DataFrame) -> DataFrame:
    """The child of each node that has just one."""
    if is_packed(nodes):
        return _below(of, nodes, lambda p, n: (n["child_pos"] == 1) & (n["last_desc"] == p["last_desc"]))
    return _pairs(of, nodes.where("child_pos = 1"), lambda a, b: (b["parent_id"] == a["of"]) & (b["last_desc"] == a["_l"]))


def each_attribute(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, pos, name, value), a row an attribute, in order."""
    return nodes.select("doc_id", "node_id", F.posexplode("attrs").alias("pos", "_a")).select("doc_id", "node_id", "pos", "_a.name", "_a.value")


def simple_values(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, tag, is_simple, simple_value) of every Element: the value of its only child, if that is Text or
    CData, else null; is_simple also asks that it have no attributes."""
    if is_packed(nodes):
        def simple(n: Column) -> Column:
            first = node_at(n["node_id"] + 1)  # an only child ends where its parent does
            only = F.coalesce((first["parent_id"] == n["node_id"]) & (first["last_desc"] == n["last_desc"]) & first["kind"].isin("Text", "CData"), F.lit(False))
            return F.struct(n["node_id"].alias("node_id"), n["tag"].alias("tag"), (only & (F.size(n["attrs"]) == 0)).alias("is_simple"), F.when(only, first["value"]).alias("simple_value"))

        return _each(nodes, F.transform(F.filter("tree", lambda n: n["kind"] == "Element"), simple))
    kids = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("_p")).agg(F.count(F.lit(1)).alias("_k"), F.first(F.struct("kind", "value")).alias("_c"))
    own = nodes.where(F.col("kind") == "Element")
    j = own.join(kids.withColumnRenamed("doc_id", "_d"), (F.col("_d") == own["doc_id"]) & (F.col("_p") == own["node_id"]), "left")
    only = F.coalesce((F.col("_k") == 1) & F.col("_c.kind").isin("Text", "CData"), F.lit(False))
    return j.select("doc_id", "node_id", "tag", (only & (F.size("attrs") == 0)).alias("is_simple"), F.when(only, F.col("_c.value")).alias("simple_value"))


def require_simple(nodes: DataFrame) -> DataFrame:
    """As simple_values(); the job fails at an Element that isn't simple."""
    rows = simple_values(nodes)
    return rows.withColumn("simple_value", F.when(F.col("is_simple"), F.col("simple_value")).otherwise(F.raise_error(F.lit("simple_value is for simple elements only")).cast("string")))


def _in_source(nodes: DataFrame, docs: DataFrame, make, kind: str) -> DataFrame:
    """(doc_id, node_id, span_start, span_end, of): ``of`` is what ``make`` gives for a source and the spans asked of it.
    A document comes once with all its spans, and is encoded once; the slices cost what they are long."""
    spans = nodes.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(F.struct("node_id", "span_start", "span_end")).alias("_s"))
    j = docs.select("doc_id", "source").join(spans, F.col("doc_id") == F.col("_d"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, starts, ends in batches:
            yield pd.Series([None if s is None else make(s.encode(), a, b) for s, a, b in zip(sources, starts, ends, strict=True)])

    found = F.pandas_udf(run, f"array<{kind}>")("source", F.col("_s.span_start"), F.col("_s.span_end"))
    rows = j.select("doc_id", "_s", found.alias("_f")).select("doc_id", F.explode(F.arrays_zip("_s", "_f")).alias("_x"))
    return rows.select("doc_id", "_x._s.*", F.col("_x._f").alias("of"))


def source_text(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, node_id, source_text): each node as it is written."""
    slices = lambda s, a, b: [s[i:j].decode() for i, j in zip(a, b, strict=True)]
    return _in_source(nodes, docs, slices, "string").select("doc_id", "node_id", F.col("of").alias("source_text"))


def source_span(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, node_id, span_start, span_end, char_start, char_end): bytes and code points, from 0, end excluded."""

    def chars(s, a, b):
        before = np.concatenate(([0], np.cumsum(np.frombuffer(s, np.uint8) & 0xC0 != 0x80)))  # a code point's first byte
        return [[int(before[i]), int(before[j])] for i, j in zip(a, b, strict=True)]

    found = _in_source(nodes, docs, chars, "array<int>")
    return found.select("doc_id", "node_id", "span_start", "span_end", F.col("of")[0].alias("char_start"), F.col("of")[1].alias("char_end"))


def splice(nodes: DataFrame, docs: DataFrame, replacement: str = "") -> DataFrame:
    """(doc_id, node_id, spliced): for each node the whole source with it replaced."""
    put = replacement.encode()
    whole = lambda s, a, b: [(s[:i] + put + s[j:]).decode() for i, j in zip(a, b, strict=True)]
    return _in_source(nodes, docs, whole, "string").select("doc_id", "node_id", F.col("of").alias("spliced"))


def digests(roots: Nodes, nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, digest): equal exactly for structurally equal subtrees. Attributes count without order,
    children with it; null and empty values differ."""
    if is_packed(nodes):
        def line(o: Column, n: Column) -> Column:
            return F.struct((n["node_id"] - o["node_id"]).alias("n"), (n["depth"] - o["depth"]).alias("d"), n["kind"].alias("kind"), n["tag"].alias("tag"), n["value"].alias("value"), F.array_sort(n["attrs"]).alias("a"))

        whole = lambda o: F.sha2(F.to_json(F.struct(F.transform(subtree(o), lambda n: line(o, n)).alias("r")), {"ignoreNullFields": "false"}), 256)
        return _each(nodes, F.transform(F.filter("tree", roots), lambda o: F.struct(o["node_id"].alias("node_id"), whole(o).alias("digest"))))
    spans = roots.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("of"), F.col("last_desc").alias("_l"), F.col("depth").alias("_depth"))
    j = within(spans, nodes, first="of")
    row = F.struct((F.col("node_id") - F.col("of")).alias("n"), (F.col("depth") - F.col("_depth")).alias("d"), "kind", "tag", "value", F.array_sort("attrs").alias("a"))
    canon = j.groupBy("doc_id", "of").agg(F.sha2(F.to_json(F.struct(F.sort_array(F.collect_list(row)).alias("r")), {"ignoreNullFields": "false"}), 256).alias("digest"))
    return canon.select("doc_id", F.col("of").alias("node_id"), "digest")


def print_tree(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, line): an indented line a node; sort by both."""
    label = F.concat_ws(" ", "kind", "tag", F.when(F.length("value") > 0, F.concat(F.lit('"'), F.substring("value", 1, 40), F.lit('"'))))
    return nodes.select("doc_id", "node_id", F.concat(F.expr("repeat('  ', depth - 1)"), label).alias("line"))
