"""The relations as views for spark.sql."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.lex import tokens
from ..operators.nav import each_attribute
from ..operators.shred import nodes


def register(docs: DataFrame, prefix: str = "xml") -> None:
    """Temporary views <prefix>_docs, _nodes, _tokens and _attrs of (doc_id, source)."""
    tree = nodes(docs)
    for name, df in (("docs", docs), ("nodes", tree), ("tokens", tokens(docs)), ("attrs", each_attribute(tree))):
        df.createOrReplaceTempView(f"{prefix}_{name}")
