"""Writing: the node relation back to text, by one ordered aggregate a document."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ENTITIES, escape, escape_attr
from .interval import within
from .nav import get
from .trees import Batch, in_chunks, is_packed, packed, ranges, unpacked
from .validate import is_blank


def serialize(nodes: DataFrame, indent: int = 2) -> DataFrame:
    """(doc_id, xml). Childless elements are empty tags; a single Text child stands in its line; else children have a
    line each and blank text is dropped, unless the element's layout is preserved: by mixed content (text that isn't
    blank, or CDATA, beside other children), or by the nearest xml:space. Preservation holds for what is inside. Of packed trees each is written where it stands."""
    if is_packed(nodes):
        return nodes.select("doc_id", F.arrow_udf(lambda t: _in_parts(t, lambda b: pa.array(_texts(b, np.arange(len(b.doc)), b.doc, len(b.counts), indent), pa.string())), "string")("tree").alias("xml"))
    blank = (F.col("kind") == "Text") & F.col("value").rlike(r"(?U)^\s*$")
    kids = nodes.where("parent_id is not null").groupBy(F.col("doc_id").alias("_d"), F.col("parent_id").alias("_p")).agg(
        F.count(F.lit(1)).alias("kids"),
        F.max(F.col("kind") == "Text").alias("any_text"),
        F.max((F.col("kind") == "CData") | ((F.col("kind") == "Text") & ~blank)).alias("mixed"),
    )
    own = nodes.join(kids, (nodes["doc_id"] == kids["_d"]) & (nodes["node_id"] == kids["_p"]), "left").drop("_d", "_p")
    inline = (F.col("kind") == "Element") & (F.col("kids") == 1) & F.col("any_text")
    own = own.withColumn("kids", F.coalesce("kids", F.lit(0))).withColumn("inline", F.coalesce(inline, F.lit(False))).withColumn("space", get("xml:space"))
    own = own.withColumn("mixed", F.coalesce("mixed", F.lit(False)) & ~F.col("inline") & (F.col("kind") == "Element"))
    # The nearest of the elements around a node, itself included, that says something about layout.
    says = own.where("mixed or (kind = 'Element' and space is not null)").select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col("last_desc").alias("_l"), F.col("depth").alias("_depth"), (F.col("mixed") | (F.col("space") == "preserve")).alias("_keep"))
    branch = own.where("kind = 'Element' and kids > 0").select("doc_id", "node_id")
    near = within(says, branch).groupBy(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n")).agg(F.max_by("_keep", "_depth").alias("keep"))
    laid = own.join(near, (own["doc_id"] == near["_d"]) & (own["node_id"] == near["_n"]), "left").drop("_d", "_n").withColumn("keep", F.coalesce("keep", F.lit(False)) | F.col("inline"))
    parents = laid.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col("keep").alias("in_keep"))
    rows = laid.join(parents, (laid["doc_id"] == parents["_d"]) & (laid["parent_id"] == parents["_n"]), "left").drop("_d", "_n").withColumn("in_keep", F.coalesce("in_keep", F.lit(False)))
    rows = rows.where((F.col("kind") != "Document") & ~(blank & ~F.col("in_keep")))
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), escape_attr(a["value"]), F.lit('"'))), "")
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit(" " * indent), depth - 2)) if indent else F.lit("\n")
    lead = F.when(F.col("in_keep"), F.lit("")).otherwise(line(F.col("depth")))
    value = F.coalesce("value", F.lit(""))
    head = (
        F.when(F.col("kind") == "Text", escape(value))
        .when(F.col("kind") == "CData", F.concat(F.lit("<![CDATA["), value, F.lit("]]>")))
        .when(F.col("kind") == "Comment", F.concat(F.lit("<!--"), value, F.lit("-->")))
        .when(F.col("kind") == "DTD", F.concat(F.lit("<!DOCTYPE "), value, F.lit(">")))
        .when(F.col("kind") == "Declaration", F.concat(F.lit("<?xml"), attrs, F.lit("?>")))
        .when(F.col("kind") == "ProcessingInstruction", F.concat(F.lit("<?"), F.col("tag"), F.when(F.col("value").isNotNull(), F.concat(F.lit(" "), F.col("value"))).otherwise(F.lit("")), F.lit("?>")))
        .otherwise(F.concat(F.lit("<"), F.col("tag"), attrs, F.when(F.col("kids") == 0, F.lit("/>")).otherwise(F.lit(">"))))
    )
    tail = F.concat(F.when(F.col("keep"), F.lit("")).otherwise(line(F.col("depth"))), F.lit("</"), F.col("tag"), F.lit(">"))
    piece = lambda a, b, c, text: F.struct(a.alias("a"), F.lit(b).alias("b"), c.alias("c"), text.alias("text"))
    begin = piece(F.col("node_id"), 0, F.lit(0), F.concat(lead, head))
    both = F.array(begin, piece(F.col("last_desc"), 1, -F.col("depth"), tail))
    pieces = rows.select("doc_id", F.explode(F.when((F.col("kind") == "Element") & (F.col("kids") > 0), both).otherwise(F.array(begin))).alias("e"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["text"]), "")
    found = pieces.groupBy("doc_id").agg(F.regexp_replace(text, "^\n", "").alias("xml"))
    every = nodes.where(F.col("kind") == "Document").select("doc_id")
    return every.join(found, "doc_id", "left").select("doc_id", F.coalesce("xml", F.lit("")).alias("xml"))


def _in_parts(column: pa.Array, make: Callable[[Batch], pa.Array]) -> pa.Array:
    counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return in_chunks(counts * 64, lambda i, j: make(Batch(column[i:j])))


def _escaped(x: str) -> str:
    for entity, char in ENTITIES.items():
        x = x.replace(char, entity)
    return x


def _escaped_attr(x: str) -> str:
    return _escaped(x).replace("\t", "&#9;").replace("\n", "&#10;").replace("\r", "&#13;")


def _texts(b: Batch, at: np.ndarray, own: np.ndarray, many: int, indent: int) -> list[str]:
    """``many`` texts: the nodes at ``at``, in order, of the texts ``own``, each with its top's parent left out."""
    n = len(at)
    first = np.zeros(many, np.int64)
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    first[own[starts]] = starts
    offset = first[own] - at[first[own]]
    up = np.where((b.up[at] >= 0) & (b.up[at] >= at[first[own]]), b.up[at] + offset, -1) if n else at
    is_ = lambda name: b.is_("kind", name)[at]
    element, document, text, cdata = is_("Element"), is_("Document"), is_("Text"), is_("CData")
    tops = np.where(document[first[own]], 1, b.depth[at[first[own]]]) if n else at
    depth = b.depth[at] - tops + np.where(document[first[own]], 1, 2) if n else at
    rows = pa.array(at)
    kind, tag, value = (x.to_pylist() for x in (b.nodes.field("kind").take(rows), b.nodes.field("tag").take(rows), b.nodes.field("value").take(rows)))
    blank = np.zeros(n, bool)
    for i in np.flatnonzero(text).tolist():
        blank[i] = value[i] is None or is_blank(value[i])
    child = up >= 0
    count = lambda of: np.bincount(up[child & of], minlength=n)
    kids = count(np.ones(n, bool))
    inline = element & (kids == 1) & (count(text) > 0)
    mixed = (count(cdata | (text & ~blank)) > 0) & ~inline & element
    row, _, names, values = b.attributes()
    names, values = names.to_pylist(), values.to_pylist()
    attr_n = np.bincount(row, minlength=len(b.doc))
    attr_at = (np.cumsum(attr_n) - attr_n)[at].tolist()
    attr_n = attr_n[at].tolist()
    says, keeps = mixed.copy(), mixed.copy()
    if "xml:space" in names:
        for i in np.flatnonzero(element).tolist():
            for j in range(attr_at[i], attr_at[i] + attr_n[i]):
                if names[j] == "xml:space":
                    says[i] |= values[j] is not None
                    keeps[i] |= values[j] == "preserve"
                    break
    near = np.zeros(n, bool)  # the nearest of the elements around a node, itself included, that says something about layout
    if says.any():
        order = np.argsort(depth, kind="stable")
        for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
            near[level] = np.where(says[level], keeps[level], (up[level] >= 0) & near[up[level]])
    keep = (near & element & (kids > 0)) | inline
    in_keep = child & keep[up]
    shown = ~document & ~(blank & ~in_keep)
    twice = shown & element & (kids > 0)
    line = lambda d: "\n" + " " * (indent * max(d - 2, 0))

    def attrs(i: int) -> str:
        return "".join([f' {names[j]}="{_escaped_attr(values[j])}"' for j in range(attr_at[i], attr_at[i] + attr_n[i]) if names[j] is not None and values[j] is not None])

    begins, ends = np.flatnonzero(shown), np.flatnonzero(twice)
    pieces, kids, deep, held = [], kids.tolist(), depth.tolist(), in_keep.tolist()
    for i in begins.tolist():
        k, v = kind[i], value[i] or ""
        if k == "Element":
            head = None if tag[i] is None else f"<{tag[i]}{attrs(i)}{'>' if kids[i] else '/>'}"
        elif k == "Text":
            head = _escaped(v)
        elif k == "CData":
            head = f"<![CDATA[{v}]]>"
        elif k == "Comment":
            head = f"<!--{v}-->"
        elif k == "DTD":
            head = f"<!DOCTYPE {v}>"
        elif k == "Declaration":
            head = f"<?xml{attrs(i)}?>"
        else:
            head = None if tag[i] is None else f"<?{tag[i]}{'' if value[i] is None else ' ' + v}?>"
        pieces.append("" if head is None else head if held[i] else line(deep[i]) + head)
    kept = keep.tolist()
    pieces += ["" if tag[i] is None else ("" if kept[i] else line(deep[i])) + f"</{tag[i]}>" for i in ends.tolist()]
    both = np.concatenate((begins, ends))
    close = np.repeat((0, 1), (len(begins), len(ends)))
    order = np.lexsort((np.where(close == 1, -depth[both], 0), close, np.where(close == 1, b.last_desc[at][both], b.node_id[at][both]), own[both]))
    bounds = np.searchsorted(own[both][order], np.arange(many + 1)).tolist()
    pieces = [pieces[i] for i in order.tolist()]
    return ["".join(pieces[i:j]).removeprefix("\n") for i, j in zip(bounds, bounds[1:], strict=False)]


def serialize_subtrees(of: DataFrame | Callable[[Column], Column], nodes: DataFrame, indent: int = 2) -> DataFrame:
    """(doc_id, node_id, xml): each node of ``of`` written as if it stood alone; a Document as serialize() does. Of packed
    trees ``of`` tells which nodes, and each is written where it stands."""
    if is_packed(nodes):

        def write(tree: pa.Array, hits: pa.Array) -> pa.Array:
            counts = np.asarray(pc.fill_null(pc.list_value_length(tree), 0)).astype(np.int64)

            def part(i: int, j: int) -> pa.Array:
                b = Batch(tree[i:j])
                tops = np.flatnonzero(np.asarray(pc.fill_null(hits[i:j].flatten(), False)))
                own, at = ranges(tops, b.last[tops] + 1 - tops)
                return packed(np.bincount(b.doc[tops], minlength=j - i), [pa.array(b.node_id[tops].astype(np.int32)), pa.array(_texts(b, at, own, len(tops), indent), pa.string())], ["node_id", "xml"])

            return in_chunks(counts * 64, part)

        hits = nodes.select("doc_id", "tree", F.transform("tree", of).alias("_h"))
        return unpacked(hits.select("doc_id", F.arrow_udf(write, "array<struct<node_id:int,xml:string>>")("tree", "_h").alias("tree")))
    is_doc = F.col("kind") == "Document"
    spans = of.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("of"), F.col("last_desc").alias("_l"), F.col("depth").alias("_depth"), F.when(is_doc, 0).otherwise(1).alias("_more"))
    j = within(spans, nodes, first="of")
    key, shift = F.struct("doc_id", F.col("of").alias("node_id")), F.col("_more") + 1 - F.col("of")
    moved = lambda c: (F.col(c) + shift).alias(c)
    top = F.col("node_id") == F.col("of")
    parent = F.when(top, F.when(F.col("_more") == 1, 1)).otherwise(F.col("parent_id") + shift).cast("int")
    depth = (F.col("depth") - F.col("_depth") + F.col("_more") + 1).alias("depth")
    rows = j.select(key.alias("doc_id"), moved("node_id"), parent.alias("parent_id"), "kind", "tag", "value", "attrs", depth, moved("last_desc"))
    size = (F.col("last_desc") - F.col("node_id") + 2).alias("last_desc")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    around = of.where(~is_doc).select(F.struct("doc_id", "node_id").alias("doc_id"), F.lit(1).alias("node_id"), none("int", "parent_id"), F.lit("Document").alias("kind"), none("string", "tag"), none("string", "value"), F.expr("cast(array() as array<struct<name:string,value:string>>)").alias("attrs"), F.lit(1).alias("depth"), size)
    return serialize(around.unionByName(rows), indent).select("doc_id.doc_id", "doc_id.node_id", "xml")


def write_documents(nodes: DataFrame, path: str, indent: int = 2) -> None:
    """A Parquet table of (doc_id, xml); text files would break documents at their line ends."""
    serialize(nodes, indent).write.mode("overwrite").parquet(path)
