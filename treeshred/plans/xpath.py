"""XPath expressions compiled to one lazy DataFrame plan over the node relation.

Packed trees (operators.trees) are asked where they stand, whole paths at once and by places in arrays: nothing is joined,
sorted or shuffled. What follows is of the node relation. A path of child steps from the documents, with or without ``//`` before its first name, reads the node relation once: a
node's parent is found by windows, and documents aren't shuffled again. What follows ``..`` or a further ``//`` joins the
relation again for each step: write it to a table, or cache it, for such paths.

The context is an ordered bag (doc_id, ctx_id, node, ord): positions count over the whole context of a call, nothing is
made distinct, and ``ord`` grows by what each step sorts by. Descendants are one range join on the interval of a
subtree; from the document itself they are a filter without any join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.interval import within
from ..operators.trees import ATTRS, Batch, in_chunks, is_packed, offsets, packed, ranges, unpacked

NODE = ["node_id", "parent_id", "kind", "tag", "value", "attrs", "last_desc", "depth"]
_NAME = r"[A-Za-z0-9_\-.:\u0080-\U0010FFFF]+"


@dataclass(frozen=True)
class Step:
    kind: str  # descend, name, any, self, parent, text, node, attribute, or a predicate: nth, last, has, equals
    name: str = ""
    value: str = ""


_RULES = [
    (re.compile(r"//"), lambda m: Step("descend")),
    (re.compile(r"/"), lambda m: None),
    (re.compile(r"\.\."), lambda m: Step("parent")),
    (re.compile(r"\."), lambda m: Step("self")),
    (re.compile(r"\*"), lambda m: Step("any")),
    (re.compile(r"@([A-Za-z0-9_\-:\u0080-\U0010FFFF]+)"), lambda m: Step("attribute", m[1])),
    (re.compile(r"text\(\)"), lambda m: Step("text")),
    (re.compile(r"node\(\)"), lambda m: Step("node")),
    (re.compile(r"\[([^\]]*)\]"), lambda m: _predicate(m[1].strip())),
    (re.compile(_NAME + r"(?=::)"), lambda m: _fail(f"axes are not supported: {m[0]}::")),
    (re.compile(_NAME + r"\("), lambda m: _fail(f"unknown function or unterminated call: {m[0]}")),
    (re.compile(_NAME), lambda m: Step("name", m[0])),
]


def _fail(why: str):
    raise ValueError(why)


def _predicate(body: str) -> Step:
    if re.fullmatch(r"-?\d+", body):
        return Step("nth", value=body)
    if re.fullmatch(r"last\(\s*\)", body):
        return Step("last")
    if m := re.fullmatch(rf"@({_NAME})", body):
        return Step("has", m[1])
    if m := re.fullmatch(rf"@({_NAME})\s*=\s*[\"']([^\"']*)[\"']", body):
        return Step("equals", m[1], m[2])
    raise ValueError(f"unsupported predicate: [{body}]")


def parse(expression: str) -> list[Step]:
    """Steps from left to right; ValueError for what isn't supported."""
    out, at = [], 0
    while at < len(expression):
        if expression[at].isspace():
            at += 1
            continue
        for pattern, make in _RULES:
            if m := pattern.match(expression, at):
                if (step := make(m)) is not None:
                    out.append(step)
                at = m.end()
                break
        else:
            c = expression[at]
            raise ValueError({"[": "unterminated predicate", "@": "attribute without a name"}.get(c, f"unexpected character {c!r}"))
    return out


def documents(nodes: DataFrame) -> DataFrame:
    """The context of a call from each document."""
    return nodes.where(F.col("kind") == "Document").select("doc_id", F.col("node_id").alias("ctx_id"), *NODE, F.array().cast("array<int>").alias("ord"))


def context(rows: DataFrame) -> DataFrame:
    """The context of one call from each row of the node relation."""
    return rows.select("doc_id", F.col("node_id").alias("ctx_id"), *NODE, F.array().cast("array<int>").alias("ord"))


def _test(step: Step, kind: Column, tag: Column) -> Column:
    return {"name": (kind == "Element") & (tag == step.name), "any": kind == "Element", "text": kind == "Text", "node": F.lit(True)}[step.kind]


def _attribute(name: str, attrs: Column) -> Column:
    return F.get(F.filter(attrs, lambda a: a["name"] == name), 0)


def xpath(nodes: DataFrame, expression: str, start: DataFrame | None = None) -> DataFrame:
    """(doc_id, ctx_id, ord, node columns) of what an expression selects, a row each time it does.

    Evaluated from each document, or from each row of ``start`` (see context()). An attribute's row is a Text without
    node_id. Sort by (doc_id, ctx_id, ord) for the order of the result.
    """
    steps = parse(expression)
    if is_packed(nodes):
        if start is not None:
            raise ValueError("packed trees are asked from their documents; unpack them for another context")
        return _in_trees(nodes, steps)
    now = start if start is not None else documents(nodes)
    at_root = start is None  # the context is exactly the documents
    if not steps:
        return now.limit(0)
    tree = nodes.select("doc_id", *NODE)
    k = 0
    if start is None:
        now, k = _single_pass(tree, steps, now)
        at_root = k == 0
    while k < len(steps):
        step, after = steps[k], steps[k + 1] if k + 1 < len(steps) else None
        if step.kind == "descend" and after is not None and after.kind in ("name", "any", "text", "node"):
            # Descendants-or-self, then children: any node within, sorted by its parent first.
            key = lambda p, n: F.array(p, n)
            if at_root:
                found = tree.where(F.col("kind") != "Document").where(_test(after, F.col("kind"), F.col("tag")))
                now = found.select("doc_id", F.lit(1).alias("ctx_id"), *NODE, key(F.col("parent_id"), F.col("node_id")).alias("ord"))
            else:
                c = now.select(F.col("doc_id").alias("_d"), "ctx_id", F.col("node_id").alias("_n"), F.col("last_desc").alias("_l"), F.col("ord").alias("_o"))
                n = tree.where(_test(after, F.col("kind"), F.col("tag")))
                j = within(c, n, or_self=False)
                now = j.select("doc_id", "ctx_id", *NODE, F.concat("_o", key(F.col("parent_id"), F.col("node_id"))).alias("ord"))
            k += 2
        elif step.kind == "descend":
            c = now.select(F.col("doc_id").alias("_d"), "ctx_id", F.col("node_id").alias("_n"), F.col("last_desc").alias("_l"), F.col("ord").alias("_o"))
            j = within(c, tree)
            now = j.select("doc_id", "ctx_id", *NODE, F.concat("_o", F.array("node_id")).alias("ord"))
            k += 1
        else:
            now = _step(step, now, tree)
            k += 1
        at_root = at_root and step.kind == "self"
    return now


_TESTS = ("name", "any", "text", "node")

_FOUND = f"array<struct<ctx_id:int,node_id:int,parent_id:int,kind:string,tag:string,value:string,attrs:{ATTRS},last_desc:int,depth:int,ord:array<int>>>"


def _in_trees(trees: DataFrame, steps: list[Step]) -> DataFrame:
    if not steps:
        return unpacked(trees.select("doc_id", F.array().cast(_FOUND).alias("tree")))

    def find(column: pa.Array) -> pa.Array:
        counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
        return in_chunks(counts * 64, lambda i, j: _found(Batch(column[i:j]), steps))

    return unpacked(trees.select("doc_id", F.arrow_udf(find, _FOUND)("tree").alias("tree")))


def _found(b: Batch, steps: list[Step]) -> pa.Array:
    """What the steps select in a batch: ``at`` are nodes' places, ``key`` what each step sorts by (0 for null). After a
    step to an attribute ``attr`` has its place among the attributes, and there are no nodes."""
    element = b.is_("kind", "Element")
    tests = {"any": lambda s: element, "name": lambda s: element & b.is_("tag", s.name), "text": lambda s: b.is_("kind", "Text"), "node": lambda s: np.ones(len(b.doc), bool)}
    at, attr = b.begin[b.counts > 0], None
    key = np.zeros((len(at), 0), np.int64)
    if any(s.kind in ("attribute", "has", "equals") for s in steps):
        owner, _, names, values = b.attributes()
    by_parent = None

    def below(first: np.ndarray, keep: np.ndarray, keys) -> None:
        nonlocal at, key
        which, nodes = ranges(first, b.last[at] + 1 - first)
        which, nodes = which[keep[nodes]], nodes[keep[nodes]]
        at, key = nodes, np.column_stack([key[which], *[k[nodes] for k in keys]])

    def take(rows: np.ndarray) -> None:
        nonlocal at, key, attr
        at, key = at[rows], key[rows]
        attr = attr[rows] if attr is not None else None

    def holders(step: Step) -> np.ndarray:
        """The attributes that a predicate or step names."""
        named = np.asarray(pc.fill_null(pc.equal(names, step.name), False)).astype(bool)
        return named & np.asarray(pc.fill_null(pc.equal(values, step.value), False)).astype(bool) if step.kind == "equals" else named

    k = 0
    while k < len(steps):
        step, after = steps[k], steps[k + 1] if k + 1 < len(steps) else None
        k += 1
        if step.kind == "self":
            continue
        if step.kind in ("nth", "last"):
            n = 1 if step.kind == "last" else int(step.value)
            order = np.lexsort((*reversed([c if step.kind == "nth" else -c for c in key.T]), b.doc[at]))
            doc = b.doc[at][order]
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc) + 1
            take(np.sort(order[rank == n]))
        elif attr is not None:
            take(np.zeros(0, np.int64))  # an attribute has neither nodes around it nor attributes
        elif step.kind == "descend" and after is not None and after.kind in _TESTS:
            below(at + 1, tests[after.kind](after), (b.parent_id, b.node_id))
            k += 1
        elif step.kind == "descend":
            below(at, np.ones(len(b.doc), bool), (b.node_id,))
        elif step.kind in _TESTS:
            if by_parent is None:
                by_parent = np.argsort(b.up, kind="stable")
                kids = np.bincount(b.up[b.up >= 0], minlength=len(b.doc))
                where = np.cumsum(kids) - kids + np.count_nonzero(b.up < 0)
            which, places = ranges(where[at], kids[at])
            nodes, keep = by_parent[places], tests[step.kind](step)
            which, nodes = which[keep[nodes]], nodes[keep[nodes]]
            at, key = nodes, np.column_stack([key[which], b.node_id[nodes]])
        elif step.kind == "parent":
            take(np.flatnonzero((b.node_id[at] != 1) & (b.up[at] >= 0)))
            at = b.up[at]
        elif step.kind == "attribute":
            some = np.flatnonzero(holders(step))
            first = np.full(len(b.doc), -1)
            first[owner[some[::-1]]] = some[::-1]
            attr = first[at]
            take(np.flatnonzero(attr >= 0))
        else:
            has = np.zeros(len(b.doc), bool)
            has[owner[holders(step)]] = True
            take(np.flatnonzero((has & element)[at]))
    order = np.argsort(b.doc[at], kind="stable")
    take(order)
    rows, field = pa.array(at), b.nodes.field
    none = attr is not None
    number = lambda name: pa.nulls(len(at), pa.int32()) if none else field(name).take(rows)
    kind = pa.array(["Text"] * len(at), pa.string()) if none else field("kind").take(rows)
    tag = pa.nulls(len(at), pa.string()) if none else field("tag").take(rows)
    value = values.take(pa.array(attr)) if none else field("value").take(rows)
    attrs = pa.array([[]] * len(at), field("attrs").type) if none else field("attrs").take(rows)
    flat = key.ravel()
    ords = pa.ListArray.from_arrays(offsets(np.full(len(at), key.shape[1])), pa.array(flat.astype(np.int32), mask=flat == 0))
    columns = [pa.array(np.ones(len(at), np.int32)), number("node_id"), number("parent_id"), kind, tag, value, attrs, number("last_desc"), number("depth"), ords]
    return packed(np.bincount(b.doc[at], minlength=len(b.counts)), columns, ["ctx_id", *NODE, "ord"])


def _holds(step: Step) -> Column:
    own = (lambda a: a["name"] == step.name) if step.kind == "has" else (lambda a: (a["name"] == step.name) & (a["value"] == step.value))
    return (F.col("kind") == "Element") & F.exists("attrs", own)


def _single_pass(tree: DataFrame, steps: list[Step], now: DataFrame) -> tuple[DataFrame, int]:
    """The result of as many first steps as one reading of the tree can give, and their number (0: none can)."""
    begin = 0
    while begin < len(steps) and steps[begin].kind == "self":
        begin += 1
    anywhere = begin + 1 < len(steps) and steps[begin].kind == "descend"
    first = begin + anywhere
    if first >= len(steps) or steps[first].kind not in _TESTS:
        return now, 0
    end = first + 1
    while end < len(steps) and steps[end].kind in (*_TESTS, "self", "has", "equals", "nth", "last"):
        end += 1
    chosen = (_from_anywhere if anywhere else _from_the_top)(tree, steps[first:end])
    return chosen.select("doc_id", F.lit(1).alias("ctx_id"), *NODE, F.col("_o").alias("ord")), end


def _from_the_top(tree: DataFrame, steps: list[Step]) -> DataFrame:
    """A chain of child steps from the documents: a node's depth tells its step, and its parent is the last node chosen
    one level up. All windows share one order."""
    tests = [s for s in steps if s.kind in _TESTS]
    at = lambda k: (F.col("depth") == k + 2) & _test(tests[k], F.col("kind"), F.col("tag"))
    some = at(0)
    for k in range(1, len(tests)):
        some = some | at(k)
    running = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows, k = tree.where(some).withColumn("_m", at(0) & (F.col("parent_id") == 1)), 0
    for step in steps[1:]:
        if step.kind in _TESTS:
            k += 1
            rows = rows.withColumn("_p", F.last(F.when(F.col("_m"), F.col("node_id")), ignorenulls=True).over(running)).withColumn("_m", F.coalesce(at(k) & (F.col("parent_id") == F.col("_p")), F.lit(False)))
        elif step.kind in ("has", "equals"):
            rows = rows.withColumn("_m", F.col("_m") & _holds(step))
        elif step.kind == "nth":
            rows = rows.withColumn("_c", F.count(F.when(F.col("_m"), 1)).over(running)).withColumn("_m", F.col("_m") & (F.col("_c") == int(step.value)))
        elif step.kind == "last":
            rows = rows.withColumn("_c", F.max(F.when(F.col("_m"), F.col("node_id"))).over(Window.partitionBy("doc_id"))).withColumn("_m", F.col("_m") & (F.col("_c") == F.col("node_id")))
    return rows.where("_m").withColumn("_o", F.array("node_id"))


def _from_anywhere(tree: DataFrame, steps: list[Step]) -> DataFrame:
    """``//`` and a test, then child steps. Nodes chosen meet their children in a window over the parent's id, in which
    the parent stands once for itself."""
    tests = [s for s in steps if s.kind in _TESTS]
    passes = lambda s: _test(s, F.col("kind"), F.col("tag"))
    some = passes(tests[0])
    for s in tests[1:]:
        some = some | passes(s)
    rows = tree.where(F.col("kind") != "Document").where(some).withColumn("_o", F.when(passes(tests[0]), F.array("parent_id", "node_id")))
    chosen = F.col("_o").isNotNull()
    for step in steps[1:]:
        if step.kind in _TESTS:
            none = F.lit(None)
            node = F.struct(*NODE)
            child = F.struct(F.col("parent_id").alias("k"), none.cast("array<int>").alias("o"), node.alias("n"))
            parent = F.when(chosen, F.struct(F.col("node_id").alias("k"), F.col("_o").alias("o"), F.when(F.lit(False), node).alias("n")))
            met = rows.select("doc_id", F.explode(F.array_compact(F.array(child, parent))).alias("_e")).select("doc_id", "_e.*")
            met = met.withColumn("_above", F.max("o").over(Window.partitionBy("doc_id", "k"))).where("n is not null").select("doc_id", "n.*", "_above")
            rows = met.withColumn("_o", F.when(passes(step) & F.col("_above").isNotNull(), F.concat("_above", F.array("node_id")))).drop("_above")
        elif step.kind in ("has", "equals"):
            rows = rows.withColumn("_o", F.when(_holds(step), F.col("_o")))
        elif step.kind in ("nth", "last"):
            order = Window.partitionBy("doc_id", chosen).orderBy(F.col("_o") if step.kind == "nth" else F.col("_o").desc())
            rows = rows.withColumn("_c", F.row_number().over(order)).withColumn("_o", F.when(F.col("_c") == (1 if step.kind == "last" else int(step.value)), F.col("_o"))).drop("_c")
    return rows.where(chosen)


def _step(step: Step, now: DataFrame, tree: DataFrame) -> DataFrame:
    if step.kind == "self":
        return now
    if step.kind in ("name", "any", "text", "node"):
        c = now.select(F.col("doc_id").alias("_d"), "ctx_id", F.col("node_id").alias("_n"), F.col("ord").alias("_o"))
        n = tree.where(_test(step, F.col("kind"), F.col("tag")))
        j = c.join(n, (n["doc_id"] == c["_d"]) & (n["parent_id"] == c["_n"]))
        return j.select("doc_id", "ctx_id", *NODE, F.concat("_o", F.array("node_id")).alias("ord"))
    if step.kind == "parent":
        c = now.where("node_id <> ctx_id").select(F.col("doc_id").alias("_d"), "ctx_id", F.col("parent_id").alias("_p"), F.col("ord").alias("_o"))
        j = c.join(tree, (tree["doc_id"] == c["_d"]) & (tree["node_id"] == c["_p"]))
        return j.select("doc_id", "ctx_id", *NODE, F.col("_o").alias("ord"))
    if step.kind == "attribute":
        found = now.withColumn("_a", _attribute(step.name, F.col("attrs"))).where("_a is not null")
        none = F.lit(None).cast("int")
        return found.select("doc_id", "ctx_id", none.alias("node_id"), none.alias("parent_id"), F.lit("Text").alias("kind"), F.lit(None).cast("string").alias("tag"), F.col("_a.value").alias("value"), F.filter("attrs", lambda a: F.lit(False)).alias("attrs"), none.alias("last_desc"), none.alias("depth"), "ord")
    if step.kind in ("has", "equals"):
        return now.where(_holds(step))
    order = Window.partitionBy("doc_id", "ctx_id")
    if step.kind == "last":
        return now.withColumn("_n", F.row_number().over(order.orderBy(F.col("ord").desc()))).where("_n = 1").drop("_n")
    n = int(step.value)
    if n < 1:
        return now.limit(0)
    return now.withColumn("_n", F.row_number().over(order.orderBy("ord"))).where(F.col("_n") == n).drop("_n")
