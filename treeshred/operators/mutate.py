"""Changes to the node relation: a new relation each time, with node_ids, positions and intervals made anew."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .interval import within
from .shred import nodes as shred
from .trees import ATTRS, TREE, Batch, in_chunks, ints, is_packed, packed
from .validate import require_valid


def set_attr(nodes: DataFrame, where: Column, name: str, value: Column) -> DataFrame:
    """Sets an attribute of the Elements that ``where`` holds for: in its place if it is there, else last."""
    value = value.cast("string")
    has = F.exists("attrs", lambda a: a["name"] == name)
    replaced = F.transform("attrs", lambda a: F.struct(a["name"].alias("name"), F.when(a["name"] == name, value).otherwise(a["value"]).alias("value")))
    appended = F.concat("attrs", F.array(F.struct(F.lit(name).alias("name"), value.alias("value"))))
    return nodes.withColumn("attrs", F.when((F.col("kind") == "Element") & F.coalesce(where, F.lit(False)), F.when(has, replaced).otherwise(appended)).otherwise(F.col("attrs")))


def _place(a: Column, b: int = 0, c: Column | None = None, d: Column | int = 0) -> Column:
    return F.struct(a.cast("int").alias("a"), F.lit(b).alias("b"), (F.lit(0) if c is None else c).cast("int").alias("c"), F.lit(d).cast("int").alias("d"))


def _renumber(rows: DataFrame) -> DataFrame:
    """Rows with an ``_at`` sort key, in document order, and depths: all else that depends on it is made anew.

    Where an old node's subtree ended is a place in the same order, so one running count gives ids and ends alike."""
    end = _place(F.col("last_desc"), 1, -(F.col("depth") + 1), (1 << 31) - 1)
    events = rows.select("*", F.explode(F.when(F.col("_made"), F.array(F.struct(F.col("_at").alias("at"), F.lit(0).alias("ends")))).otherwise(F.array(F.struct(F.col("_at").alias("at"), F.lit(0).alias("ends")), F.struct(end.alias("at"), F.lit(1).alias("ends"))))).alias("_e"))
    running = Window.partitionBy("doc_id").orderBy("_e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("_id", F.count(F.when(F.col("_e.ends") == 0, 1)).over(running).cast("int"))
    ends = events.where("_e.ends = 1").select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_old"), F.col("_id").alias("_last"))
    up = events.where("_e.ends = 0").drop("_e")
    up = up.join(ends, (F.col("_d") == up["doc_id"]) & (F.col("_old") == up["node_id"]), "left").drop("_d", "_old")
    ids = up.where(~F.col("_made")).select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_old"), F.col("_id").alias("_new"))
    whole = up.join(ids, (F.col("_d") == up["doc_id"]) & (F.col("_old") == up["parent_id"]), "left").withColumn("parent_id", F.coalesce(F.col("_id") - F.col("_up"), "_new"))
    place = Window.partitionBy("doc_id", "parent_id").orderBy("_id")
    none = F.lit(None).cast("int")
    return whole.select("doc_id", F.col("_id").alias("node_id"), "parent_id", F.when(F.col("parent_id").isNotNull(), F.row_number().over(place)).alias("child_pos"), "kind", "tag", "value", "attrs", "depth", F.coalesce("_last", F.col("_id") + F.coalesce("_span", F.lit(0))).cast("int").alias("last_desc"), none.alias("span_start"), none.alias("span_end"))


def _fragment(nodes: DataFrame, kind: str | None, tag: str | None, value: Column | None, attrs: dict | None, xml: str | None) -> Column:
    """What is put in, as an array of nodes in order: one of ``kind``, or all of an XML text. Each knows how far before it
    its parent stands (null for the outermost), its depth from 0, and how many nodes it holds."""
    none = "cast(array() as array<struct<name:string,value:string>>)"
    pairs = lambda some: F.array(*[F.struct(F.lit(k).alias("name"), (v if isinstance(v, Column) else F.lit(v)).cast("string").alias("value")) for k, v in some]) if some else F.expr(none)
    row = lambda n, up, kind, tag, value, attrs, deep, span: F.struct(F.lit(n).alias("n"), F.lit(up).cast("int").alias("up"), F.lit(kind).alias("kind"), F.lit(tag).cast("string").alias("tag"), value.cast("string").alias("value"), attrs.alias("attrs"), F.lit(deep).alias("deep"), F.lit(span).alias("span"))
    if xml is None:
        if kind is None:
            raise ValueError("what is put in needs a kind or an XML text")
        return F.array(row(0, None, kind, tag, F.lit(None) if value is None else value, pairs(list((attrs or {}).items())), 0, 0))
    if kind is not None:
        raise ValueError("what is put in has a kind or an XML text, not both")
    docs = nodes.sparkSession.createDataFrame([(0, xml)], "doc_id long, source string")
    found = shred(require_valid(docs, "lenient")).where("kind <> 'Document'").orderBy("node_id").collect()  # as long as the caller's text
    return F.array(*[row(r.node_id - 2, r.node_id - r.parent_id if r.parent_id > 1 else None, r.kind, r.tag, F.lit(r.value), pairs([(a.name, a.value) for a in r.attrs]), r.depth - 2, r.last_desc - r.node_id) for r in found])


def _new(of: DataFrame, what: Column, parent: Column, depth: Column, at) -> DataFrame:
    rows = of.select("*", F.explode(what).alias("_f"))
    none = lambda name: F.lit(None).cast("int").alias(name)
    return rows.select("doc_id", none("node_id"), F.when(F.col("_f.up").isNull(), parent).cast("int").alias("parent_id"), none("child_pos"), "_f.kind", "_f.tag", "_f.value", "_f.attrs", (depth + F.col("_f.deep")).cast("int").alias("depth"), none("last_desc"), at(F.col("_f.n")).alias("_at"), F.lit(True).alias("_made"), F.col("_f.up").alias("_up"), F.col("_f.span").alias("_span"))


def _old(nodes: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")
    return nodes.drop("span_start", "span_end").withColumn("_at", _place(F.col("node_id"))).withColumn("_made", F.lit(False)).withColumn("_up", none).withColumn("_span", none)


_NEW = f"array<struct<n:int,up:int,kind:string,tag:string,value:string,attrs:{ATTRS},deep:int,span:int>>"


def _in_trees(trees: DataFrame, where: Callable[[Column], Column], how: str, **what) -> DataFrame:
    """Packed trees, changed where they stand: ``where``, and columns in ``what``, are functions of a node. ``how`` is push,
    push_first, replace or remove."""
    of = lambda n: {k: v(n) if callable(v) and not isinstance(v, Column) else {x: y(n) if callable(y) and not isinstance(y, Column) else y for x, y in v.items()} if isinstance(v, dict) else v for k, v in what.items()}
    if how == "remove":
        new = lambda n: F.array().cast(_NEW)
    elif what.get("xml") is not None:
        fixed = _fragment(trees, **what).cast(_NEW)  # lexed once
        new = lambda n: fixed
    else:
        _fragment(trees, **{**what, "value": None, "attrs": None})  # refuses what is neither a kind nor a text
        new = lambda n: _fragment(trees, **of(n)).cast(_NEW)

    def change(tree: pa.Array, put: pa.Array) -> pa.Array:
        counts = np.asarray(pc.fill_null(pc.list_value_length(tree), 0)).astype(np.int64)
        return in_chunks(counts * 64, lambda i, j: _changed(Batch(tree[i:j]), put[i:j].flatten(), how))

    put = trees.select("doc_id", "tree", F.transform("tree", lambda n: F.when(where(n) if how.startswith("push") else where(n) & (n["kind"] != "Document"), new(n))).alias("_put"))
    return put.select("doc_id", F.arrow_udf(change, TREE)("tree", "_put").alias("tree"))


def _changed(b: Batch, put: pa.Array, how: str) -> pa.Array:
    """Trees with what is ``put`` (null where nothing is) at some of their nodes, numbered anew as _renumber() does."""
    n = len(b.doc)
    hit = np.flatnonzero(np.asarray(pc.is_valid(put)))
    old = np.arange(n)
    if how in ("replace", "remove"):
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, b.last[hit] + 1, -1)
        cover = np.cumsum(edge)[:n]
        old, hit = np.flatnonzero(cover == 0), hit[cover[hit] == 1]
    pieces = put.take(pa.array(hit))
    many = np.asarray(pc.list_value_length(pieces)).astype(np.int64)
    new = pieces.flatten()
    at = np.repeat(hit, many)  # the node that each new one is put at
    number = lambda name: np.asarray(pc.fill_null(new.field(name), 0)).astype(np.int64)
    nth, up, deep, span = map(number, ("n", "up", "deep", "span"))
    zero, m = np.zeros(len(old), np.int64), len(at)
    place = {"push": (b.last_desc[at], np.ones(m, int), -(b.depth[at] + 1), nth), "push_first": (b.node_id[at], np.zeros(m, int), np.ones(m, int), nth)}.get(how, (b.node_id[at], np.zeros(m, int), np.zeros(m, int), nth))
    starts, ends = (b.node_id[old], zero, zero, zero), (b.last_desc[old], zero + 1, -(b.depth[old] + 1), zero + (1 << 31) - 1)
    keys = [np.concatenate(x) for x in zip(starts, place, ends, strict=True)]
    doc = np.concatenate((b.doc[old], b.doc[at], b.doc[old]))
    order = np.lexsort((*reversed(keys), doc))
    is_start = order < len(old) + m
    counts = np.bincount(doc[: len(old) + m], minlength=len(b.counts))
    before = (np.cumsum(counts) - counts)[doc[order]]
    running = np.empty(len(order), np.int64)
    running[order] = np.cumsum(is_start) - before
    ids, last_old = running[: len(old) + m], running[len(old) + m :]
    new_id = np.zeros(n + 1, np.int64)  # of old nodes; the last entry is for none
    new_id[old] = ids[: len(old)]
    ids_new = ids[len(old) :]
    over = at if how.startswith("push") else b.up[at]
    parent = np.concatenate((new_id[b.up[old]], np.where(up > 0, ids_new - up, new_id[over])))
    depth = np.concatenate((b.depth[old], b.depth[at] + deep + how.startswith("push")))
    last = np.concatenate((last_old, ids_new + span))
    sequence = order[is_start]
    own = doc[sequence]
    parent, depth, last, ids = parent[sequence], depth[sequence], last[sequence], ids[sequence]
    by_parent = np.lexsort((ids, parent, own))
    p, d = parent[by_parent], own[by_parent]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
    rank = np.arange(len(p))
    pos = np.empty(len(p), np.int64)
    pos[by_parent] = rank - np.maximum.accumulate(np.where(fresh, rank, 0)) + 1
    rows = pa.array(sequence)
    both = lambda name: pa.concat_arrays([b.nodes.field(name).take(pa.array(old)), new.field(name).cast(b.nodes.field(name).type)]).take(rows)
    none = pa.nulls(len(ids), pa.int32())
    return packed(counts, [ints(ids), ints(parent, parent == 0), ints(pos, parent == 0), both("kind"), both("tag"), both("value"), both("attrs"), ints(depth), ints(last), none, none])


def push(nodes: DataFrame, where: Column, kind: str | None = None, tag: str | None = None, value: Column | None = None, attrs: dict | None = None, xml: str | None = None) -> DataFrame:
    """Adds a last child to each node that ``where`` holds for: one of ``kind`` with ``attrs`` (names to columns or texts),
    or the nodes of an XML text, which must nest. Spans are null from then on."""
    if is_packed(nodes):
        return _in_trees(nodes, where, "push", kind=kind, tag=tag, value=value, attrs=attrs, xml=xml)
    what = _fragment(nodes, kind, tag, value, attrs, xml)
    at = lambda n: _place(F.col("last_desc"), 1, -(F.col("depth") + 1), n)
    return _renumber(_old(nodes).unionByName(_new(nodes.where(where), what, F.col("node_id"), F.col("depth") + 1, at)))


def push_first(nodes: DataFrame, where: Column, kind: str | None = None, tag: str | None = None, value: Column | None = None, attrs: dict | None = None, xml: str | None = None) -> DataFrame:
    """Adds a first child, as push() adds a last one."""
    if is_packed(nodes):
        return _in_trees(nodes, where, "push_first", kind=kind, tag=tag, value=value, attrs=attrs, xml=xml)
    what = _fragment(nodes, kind, tag, value, attrs, xml)
    at = lambda n: _place(F.col("node_id"), 0, F.lit(1), n)
    return _renumber(_old(nodes).unionByName(_new(nodes.where(where), what, F.col("node_id"), F.col("depth") + 1, at)))


def _spans(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col("last_desc").alias("_l"))


def remove(nodes: DataFrame, where: Column) -> DataFrame:
    """Takes out the nodes that ``where`` holds for, and all that is in them."""
    if is_packed(nodes):
        return _in_trees(nodes, where, "remove")
    return _renumber(_old(within(_spans(nodes.where(where & (F.col("kind") != "Document"))), nodes, how="left_anti")))


def replace(nodes: DataFrame, where: Column, kind: str | None = None, tag: str | None = None, value: Column | None = None, attrs: dict | None = None, xml: str | None = None) -> DataFrame:
    """Puts what push() would add in the place of each node that ``where`` holds for, and of all that is in it."""
    if is_packed(nodes):
        return _in_trees(nodes, where, "replace", kind=kind, tag=tag, value=value, attrs=attrs, xml=xml)
    what = _fragment(nodes, kind, tag, value, attrs, xml)
    hit = nodes.where(where & (F.col("kind") != "Document"))
    outer = within(_spans(hit), hit, or_self=False, how="left_anti")
    at = lambda n: _place(F.col("node_id"), 0, F.lit(0), n)
    kept = within(_spans(hit), nodes, how="left_anti")
    return _renumber(_old(kept).unionByName(_new(outer, what, F.col("parent_id"), F.col("depth"), at)))
