"""Shredding: documents to the relation of nodes.

(node_id, last_desc) encode a subtree as an interval: what a node contains are the rows of its document with a
node_id in it. The Document is node 1 at depth 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .trees import trees, unpacked

COLUMNS = ["doc_id", "node_id", "parent_id", "child_pos", "kind", "tag", "value", "attrs", "depth", "last_desc", "span_start", "span_end"]


def nodes(docs: DataFrame, decode: bool = True) -> DataFrame:
    """The nodes of (doc_id, source), columns as in COLUMNS. Documents that don't lex or nest give what can be told of
    them (a node after a stray closing tag has no parent and no child_pos); validate() says which these are. Without
    ``decode`` entities stay as they are written. Rows that share a doc_id, or have none, are trees of their own here, but
    navigation finds nodes by doc_id and node_id: number such documents first (sources.documents.numbered).

    Documents are dealt by doc_id first, so that windows and sums over a document's nodes need no other shuffle."""
    return unpacked(trees(docs.select("doc_id", "source").repartition("doc_id"), decode))
