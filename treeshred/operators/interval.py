"""Joins of nodes with the subtrees that hold them.

A subtree is an interval of pre-order ids. A join on the document alone would compare each interval with each of the
document's nodes; here intervals are cut at every BLOCK ids and meet only the nodes of their own blocks. Subtrees nest,
so the cuts add at most depth / BLOCK rows a node, and what is compared grows with the result and the input, not with a
document's square. A large document's blocks are dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 8


def _block(id: Column) -> Column:
    return F.shiftright(id, BLOCK_BITS)


def cut(spans: DataFrame, first: str, last: str) -> DataFrame:
    """Spans, once for each block of ids that they reach into, ``_block``. Null bounds give none."""
    return spans.withColumn("_block", F.explode(F.sequence(_block(F.col(first)), _block(F.col(last)))))


def within(spans: DataFrame, nodes: DataFrame, first: str = "_n", last: str = "_l", or_self: bool = True, how: str = "inner") -> DataFrame:
    """Nodes joined with the spans (_d, first, last, ...) that hold them, a row a pair; nodes alone for a left_anti join.
    Spans name their columns unlike the nodes'."""
    spans = cut(spans, first, last)
    low = nodes["node_id"] >= spans[first] if or_self else nodes["node_id"] > spans[first]
    pairs = nodes.join(spans, (nodes["doc_id"] == spans["_d"]) & (_block(nodes["node_id"]) == spans["_block"]) & low & (nodes["node_id"] <= spans[last]), how)
    return pairs.drop("_d", "_block")
