"""Queries over documents built from the tables, each with the SQL that answers it without any XML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import dtd, nav
from ..operators.build import Markup, declaration, document, element
from ..operators.lex import lexemes, tokens
from ..operators.mutate import push, push_first, remove, replace, set_attr
from ..operators.serialize import serialize, serialize_subtrees
from ..operators.shred import nodes
from ..operators.trees import trees, unpacked
from ..operators.validate import validate
from ..sources.documents import numbered
from .xpath import context, xpath

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_docs(spark: SparkSession, sf: str, prolog: bool = False) -> DataFrame:
    """(doc_id, source): <order id status><cust/><item n flag><part/><qty/></item>*</order> for each order."""
    lines = _table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag").alias("i"))
    items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("items"))
    one = lambda i: element("item", element("part", i["l_partkey"]), element("qty", i["l_quantity"].cast("long")), n=i["l_linenumber"], flag=i["l_returnflag"]).column
    orders = _table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    j = orders.join(items, orders["o_orderkey"] == items["l_orderkey"], "left")
    inner = Markup(F.coalesce(F.array_join(F.transform("items", one), ""), F.lit("")))
    whole = element("order", element("cust", F.col("o_custkey")), inner, id=F.col("o_orderkey"), status=F.col("o_orderstatus"))
    return j.select(F.col("o_orderkey").alias("doc_id"), (document(declaration(version="1.0"), whole) if prolog else whole.column).alias("source"))


def region_docs(spark: SparkSession, sf: str) -> DataFrame:
    """<region name><nation name><customer id seg/>*</nation>*</region>: nested, a document a region."""
    c = _table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("cs"))
    n = _table(spark, sf, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    cust = lambda x: element("customer", id=x["c_custkey"], seg=x["c_mktsegment"]).column
    nation = element("nation", Markup(F.coalesce(F.array_join(F.transform("cs", cust), ""), F.lit(""))), name=F.col("n_name")).column
    ns = n.select("n_regionkey", F.struct("n_nationkey", nation.alias("x")).alias("s")).groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["x"]), "").alias("inner"))
    r = _table(spark, sf, "region").join(ns, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return r.select(F.col("r_regionkey").cast("long").alias("doc_id"), element("region", Markup(F.coalesce("inner", F.lit(""))), name=F.col("r_name")).column.alias("source"))


def _order_trees(spark: SparkSession, sf: str) -> DataFrame:
    """A row a document: what is asked of each stays where the document is, and needs no table of nodes."""
    return trees(order_docs(spark, sf))


def _order_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return unpacked(_order_trees(spark, sf))


def _kept_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Cached, as a node table in use would be, for queries that join it with itself."""
    return _order_nodes(spark, sf).persist()


# The items of each order as SQL sees them, numbered as the documents have them.
_ITEMS = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS many FROM lineitem)"


_ITEM = """'<item n="' || l_linenumber || '" flag="' || l_returnflag || '"><part>' || l_partkey || '</part><qty>' || CAST(l_quantity AS BIGINT) || '</qty></item>'"""
_HEAD = """'<order id="' || o_orderkey || '" status="' || o_orderstatus || '"><cust>' || o_custkey || '</cust>'"""
_DOCS = f"(SELECT o_orderkey, o_orderstatus, {_HEAD} || coalesce(string_agg({_ITEM}, '' ORDER BY pos), '') || '</order>' AS source FROM orders LEFT JOIN {_ITEMS} ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_custkey)"


@_query("xpath_flagship", "SELECT l_orderkey AS doc_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey")
def _flagship(spark, sf):
    found = xpath(_order_trees(spark, sf), "//item[@flag='R']/qty/text()")
    return found.groupBy("doc_id").agg(F.sum(F.col("value").cast("long")).alias("qty"), F.count(F.lit(1)).alias("n"))


@_query("shred_node_counts", "WITH n AS (SELECT count(*) AS o FROM orders), i AS (SELECT count(*) AS c FROM lineitem) SELECT 'Document' AS kind, o AS n FROM n UNION ALL SELECT 'Element', 2 * o + 3 * c FROM n, i UNION ALL SELECT 'Text', o + 2 * c FROM n, i")
def _counts(spark, sf):
    return _order_nodes(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query("lex_token_counts", "WITH n AS (SELECT count(*) AS o FROM orders), i AS (SELECT count(*) AS c FROM lineitem) SELECT 'OPEN_TAG' AS kind, 2 * o + 3 * c AS n FROM n, i UNION ALL SELECT 'CLOSE_TAG', 2 * o + 3 * c FROM n, i UNION ALL SELECT 'TAG_CLOSE', 4 * o + 6 * c FROM n, i UNION ALL SELECT 'TEXT', o + 2 * c FROM n, i UNION ALL SELECT 'ATTR_NAME', 2 * o + 2 * c FROM n, i UNION ALL SELECT 'ATTR_VALUE', 2 * o + 2 * c FROM n, i")
def _tokens(spark, sf):
    return tokens(order_docs(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query("lex_page_comments", r"SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '<!--(?s:.)*?-->')) AS BIGINT) AS comments, true AS complete FROM pages")
def _pages(spark, sf):
    docs = _table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("source"))
    return lexemes(docs).groupBy("doc_id").agg(F.count(F.when(F.col("kind") == "comment", 1)).alias("comments"), F.min("complete").alias("complete"))


@_query("children", f"SELECT o_orderkey AS doc_id, 1 + coalesce(c, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _children(spark, sf):
    return nav.children(lambda n: n["tag"] == "order", _order_trees(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@_query("child_at", f"SELECT l_orderkey AS doc_id, 'item' AS tag, CAST(l_linenumber AS VARCHAR) AS n FROM {_ITEMS} WHERE pos = 1")
def _child_at(spark, sf):
    return nav.child_at(lambda n: n["tag"] == "order", _order_trees(spark, sf), 2).select("doc_id", "tag", nav.get("n").alias("n"))


@_query("attributes_explode", "SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1")
def _attrs(spark, sf):
    return nav.each_attribute(_order_nodes(spark, sf)).where("name = 'flag'").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@_query("attr_get_default", "SELECT o_orderkey AS doc_id, o_orderstatus AS status, 'none' AS missing FROM orders")
def _get(spark, sf):
    return _order_nodes(spark, sf).where("tag = 'order'").select("doc_id", nav.get("status").alias("status"), nav.get("nope", "none").alias("missing"))


@_query("has_attr", "SELECT count(*) AS with_flag, (SELECT count(*) FROM orders) AS with_status FROM lineitem")
def _has(spark, sf):
    return _order_nodes(spark, sf).agg(F.count(F.when(nav.haskey("flag"), 1)).alias("with_flag"), F.count(F.when(nav.haskey("status"), 1)).alias("with_status"))


@_query("parent", "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS n, count(*) AS times FROM lineitem GROUP BY 1, 2")
def _parent(spark, sf):
    return nav.parent(lambda n: n["tag"] == "qty", _order_trees(spark, sf)).select("doc_id", nav.get("n").alias("n")).groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("times"))


@_query("siblings", "SELECT o_orderkey AS doc_id, count(l_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _siblings(spark, sf):
    return nav.siblings(lambda n: n["tag"] == "cust", _order_trees(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@_query("sibling_counts", "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS n, CAST(many AS BIGINT) AS siblings, count(*) AS times FROM " + _ITEMS + " GROUP BY ALL")
def _sibling_counts(spark, sf):
    t = _kept_nodes(spark, sf)
    named = t.where("tag = 'item'").select("doc_id", "node_id", nav.get("n").alias("n"))
    return nav.sibling_counts(t.where("tag = 'item'"), t).join(named, ["doc_id", "node_id"]).groupBy("doc_id", "n", "siblings").agg(F.count(F.lit(1)).alias("times"))


@_query("events", "WITH c AS (SELECT o_orderkey AS doc_id, count(l_orderkey) AS i FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT doc_id, 3 + 5 * i AS nodes, 3 + 3 * i AS ends, 6 + 8 * i AS last FROM c")
def _events(spark, sf):
    found = nav.events(_order_nodes(spark, sf))
    return found.groupBy("doc_id").agg(F.count(F.when(F.col("event") == "node", 1)).alias("nodes"), F.count(F.when(F.col("event") == "end", 1)).alias("ends"), F.max("seq").cast("long").alias("last"))


@_query("depth_below", "SELECT tag, depth, n FROM (SELECT 'order' AS tag, 0 AS depth, count(*) AS n FROM orders UNION ALL SELECT 'cust', 1, count(*) FROM orders UNION ALL SELECT 'item', 1, count(*) FROM lineitem UNION ALL SELECT unnest(['part', 'qty']), 2, count(*) FROM lineitem)")
def _depth_below(spark, sf):
    found = nav.depth_below(lambda n: n["kind"] == "Element", lambda n: n["tag"] == "order", _order_trees(spark, sf))
    return found.groupBy("tag", "depth").agg(F.count(F.lit(1)).alias("n"))


@_query("shred_repeated_ids", f"SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS doc_id, count(*) AS docs, CAST(sum(4 + 5 * i) AS BIGINT) AS nodes, CAST(max(4 + 5 * i) AS INT) AS largest FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS i FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1".replace("4 + 5 * i", "4 + 5 * coalesce(i, 0)"))
def _repeated(spark, sf):
    """Documents that share an id, or have none: each is a tree of its own."""
    docs, orders = order_docs(spark, sf), _table(spark, sf, "orders")
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    shared = docs.join(orders, docs["doc_id"] == orders["o_orderkey"]).select(key.alias("doc_id"), "source")
    whole = unpacked(trees(shared)).where("kind = 'Document'")
    return whole.groupBy("doc_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("last_desc").alias("nodes"), F.max("last_desc").alias("largest"))


@_query("validate_repeated_ids", "SELECT o_custkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'unclosed element' ELSE 'ok' END AS error, count(*) AS n FROM orders GROUP BY ALL")
def _validate_repeated(spark, sf):
    docs, orders = order_docs(spark, sf), _table(spark, sf, "orders")
    source = F.when(F.col("o_orderstatus") == "F", F.regexp_replace("source", "</order>$", "")).otherwise(F.col("source"))
    shared = docs.join(orders, docs["doc_id"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("doc_id"), source.alias("source"))
    return validate(shared).groupBy("doc_id", F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@_query("numbered_ids", f"SELECT count(*) AS docs, count(*) AS ids, (SELECT CAST(sum(l_quantity) AS BIGINT) FROM lineitem) AS qty FROM orders")
def _numbered(spark, sf):
    docs = order_docs(spark, sf).select(F.lit(7).cast("long").alias("doc_id"), "source")
    t = nodes(numbered(docs)).persist()
    qty = nav.children(t.where("tag = 'qty'"), t).agg(F.sum(F.col("value").cast("long")).alias("qty"))
    return t.where("kind = 'Document'").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("doc_id").alias("ids")).join(qty)


@_query("tokens_from", "WITH n AS (SELECT count(*) AS o FROM orders), i AS (SELECT count(*) AS c FROM lineitem) SELECT 'OPEN_TAG' AS kind, o + 3 * c AS n FROM n, i UNION ALL SELECT 'CLOSE_TAG', 2 * o + 3 * c FROM n, i UNION ALL SELECT 'TAG_CLOSE', 3 * o + 6 * c FROM n, i UNION ALL SELECT 'TEXT', o + 2 * c FROM n, i UNION ALL SELECT 'ATTR_NAME', 2 * c FROM n, i UNION ALL SELECT 'ATTR_VALUE', 2 * c FROM n, i")
def _tokens_from(spark, sf):
    return tokens(order_docs(spark, sf), F.instr("source", "<cust>") - 1).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query("serialize_subtrees", f"""SELECT '<item n="' || l_linenumber || '" flag="' || l_returnflag || '">' || chr(10) || '  <part>' || l_partkey || '</part>' || chr(10) || '  <qty>' || CAST(l_quantity AS BIGINT) || '</qty>' || chr(10) || '</item>' AS xml, count(*) AS n FROM lineitem GROUP BY 1""")
def _subtrees(spark, sf):
    return serialize_subtrees(lambda n: n["tag"] == "item", _order_trees(spark, sf)).groupBy("xml").agg(F.count(F.lit(1)).alias("n"))


@_query("depth_histogram", "WITH n AS (SELECT count(*) AS o FROM orders), i AS (SELECT count(*) AS c FROM lineitem) SELECT 1 AS depth, o AS n FROM n UNION ALL SELECT 2, o FROM n UNION ALL SELECT 3, o + c FROM n, i UNION ALL SELECT 4, o + 2 * c FROM n, i UNION ALL SELECT 5, 2 * c FROM i")
def _depth(spark, sf):
    return _order_nodes(spark, sf).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@_query("descendants", "SELECT r_regionkey AS doc_id, n_name AS nation, count(c_custkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _descendants(spark, sf):
    t = nodes(region_docs(spark, sf))
    own = t.where("tag = 'nation'")
    inner = nav.descendants(own, t).groupBy("doc_id", F.col("of").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return own.select("doc_id", "node_id", nav.get("name").alias("nation")).join(inner, ["doc_id", "node_id"], "left").select("doc_id", "nation", F.coalesce("n", F.lit(0)).alias("n"))


@_query("ancestors", "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _ancestors(spark, sf):
    t = nodes(region_docs(spark, sf))
    return nav.ancestors(t.where("tag = 'customer'"), t.where("tag = 'region'")).groupBy(nav.get("name").alias("region")).agg(F.count(F.lit(1)).alias("n"))


@_query("leaves", "SELECT (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) AS n")
def _leaves(spark, sf):
    return nav.leaves(_order_nodes(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@_query("is_simple_value", "SELECT 'qty' AS tag, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS simple_value, count(*) AS n FROM lineitem GROUP BY 2")
def _simple(spark, sf):
    return nav.simple_values(_order_trees(spark, sf)).where("is_simple and tag = 'qty'").groupBy("tag", "simple_value").agg(F.count(F.lit(1)).alias("n"))


def _path(name: str, expression: str, sql: str, columns: Callable[[DataFrame], DataFrame], docs=order_docs):
    @_query(name, sql)
    def run(spark, sf):
        return columns(xpath(trees(docs(spark, sf)), expression))


_per_doc = lambda df: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
_values = lambda df: df.select("doc_id", "value")
_path("xpath_child_path", "/order/item/qty", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1", _per_doc)
_path("xpath_descendant", "//qty", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1", _per_doc)
_path("xpath_wildcard", "/order/*", "SELECT o_orderkey AS doc_id, 1 + count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", _per_doc)
_path("xpath_attr_pred", "//item[@flag='A']", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1", _per_doc)
_path("xpath_has_attr", "//*[@flag]", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1", _per_doc)
_path("xpath_pos", "/order/item[2]/part/text()", f"SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS value FROM {_ITEMS} WHERE pos = 2", _values)
_path("xpath_last", "/order/item[last()]/part/text()", f"SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS value FROM {_ITEMS} WHERE pos = many", _values)
_path("xpath_parent_bag", "//qty/..", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1", _per_doc)
_path("xpath_text", "/order/cust/text()", "SELECT o_orderkey AS doc_id, CAST(o_custkey AS VARCHAR) AS value FROM orders", _values)
_path("xpath_node", "//item/node()", "SELECT l_orderkey AS doc_id, 2 * count(*) AS n FROM lineitem GROUP BY 1", _per_doc)
_path("xpath_attr_step", "/order/@status", "SELECT o_orderkey AS doc_id, o_orderstatus AS value FROM orders", _values)
_path("xpath_chained_pred", "/order/item[@flag='N'][1]/part/text()", f"SELECT l_orderkey AS doc_id, CAST(arg_min(l_partkey, pos) AS VARCHAR) AS value FROM {_ITEMS} WHERE l_returnflag = 'N' GROUP BY 1", _values)
_path("xpath_self_nested", "//nation/./customer[@seg='BUILDING']", "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1", _per_doc, region_docs)


@_query("xpath_from_context", f"SELECT l_orderkey AS doc_id, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1")
def _from_context(spark, sf):
    t = _kept_nodes(spark, sf)
    found = xpath(t, ".//part[1]/text()", context(t.where("tag = 'item'")))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("parts"))


@_query("escape", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped FROM documents")
def _escape(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(scalars.escape(F.col("text")).cast("binary")).alias("escaped"))


@_query("unescape", "SELECT doc_id, md5(text) AS plain FROM documents")
def _unescape(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(scalars.unescape(scalars.escape(F.col("text"))).cast("binary")).alias("plain"))


# Pages cut at their character references: what stands between is unescaped by name, &amp; last, so no text is read twice.
_REF = "&#(?:[0-9]+|x[0-9a-fA-F]+);"
_NAMED = "replace(replace(replace(replace(replace(p, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"
_NUMBER = "CASE WHEN r LIKE '&#x%' THEN TRY_CAST('0x' || r[4:-2] AS BIGINT) ELSE TRY_CAST(r[3:-2] AS BIGINT) END"
_CHAR = f"CASE WHEN ({_NUMBER}) BETWEEN 0 AND 55295 OR ({_NUMBER}) BETWEEN 57344 AND 1114111 THEN chr(CAST(({_NUMBER}) AS INT)) ELSE coalesce(r, '') END"


@_query(
    "unescape_pages",
    f"WITH cut AS (SELECT page_id, unnest(string_split_regex(html, '{_REF}')) AS p, unnest(regexp_extract_all(html, '{_REF}')) AS r, generate_subscripts(string_split_regex(html, '{_REF}'), 1) AS k FROM pages) "
    f"SELECT page_id, md5(string_agg({_NAMED} || {_CHAR}, '' ORDER BY k)) AS plain FROM cut GROUP BY page_id",
)
def _unescape_pages(spark, sf):
    return _table(spark, sf, "pages").select("page_id", F.md5(scalars.unescape(F.col("html")).cast("binary")).alias("plain"))


@_query("attr_ws_normalize", "SELECT doc_id, md5(regexp_replace(text, '\\r\\n|[\\t\\n\\r]', ' ', 'g')) AS value FROM documents")
def _ws(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(scalars.normalize_attr_ws(F.col("text")).cast("binary")).alias("value"))


@_query("wf_structural", "SELECT 'ok' AS error, count(*) AS n FROM orders")
def _wf(spark, sf):
    return validate(order_docs(spark, sf)).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@_query("wf_strict", "SELECT CASE o_orderstatus WHEN 'F' THEN '''--'' in a comment' WHEN 'P' THEN 'reference to a character not allowed in XML' ELSE 'ok' END AS error, count(*) AS n FROM orders GROUP BY 1")
def _strict(spark, sf):
    status = F.regexp_extract("source", 'status="([^"]*)"', 1)
    odd = F.when(status == "F", "<!-- a -- b -->").when(status == "P", "&#0;").otherwise("")
    docs = order_docs(spark, sf, prolog=True).withColumn("source", F.replace("source", F.lit("<cust>"), F.concat(odd, F.lit("<cust>"))))
    return validate(docs, "strict").groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@_query("wf_reject_pages", "SELECT page_id AS doc_id, false AS ok FROM pages")
def _reject(spark, sf):
    docs = _table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("source"))
    return validate(docs, "lenient").select("doc_id", "ok")


@_query("source_text", f"SELECT l_orderkey AS doc_id, md5(string_agg({_ITEM}, '' ORDER BY pos)) AS text FROM {_ITEMS} GROUP BY 1")
def _source(spark, sf):
    docs = order_docs(spark, sf).persist()
    text = nav.source_text(nodes(docs).where("tag = 'item'"), docs)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "source_text"))), lambda x: x["source_text"]), "")
    return text.groupBy("doc_id").agg(F.md5(whole.cast("binary")).alias("text"))


@_query("splice", f"SELECT o_orderkey AS doc_id, md5({_HEAD} || '<x/>' || coalesce(string_agg(CASE WHEN pos > 1 THEN {_ITEM} END, '' ORDER BY pos), '') || '</order>') AS text FROM {_ITEMS} JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus, o_custkey")
def _splice(spark, sf):
    docs = order_docs(spark, sf).persist()
    first = nodes(docs).where("tag = 'item' and child_pos = 2")
    return nav.splice(first, docs, "<x/>").select("doc_id", F.md5(F.col("spliced").cast("binary")).alias("text"))


@_query("structural_digest_dedup", "SELECT times, count(*) AS groups FROM (SELECT count(*) AS times FROM lineitem GROUP BY l_linenumber, l_returnflag, l_partkey, l_quantity) GROUP BY times")
def _digest(spark, sf):
    found = nav.digests(lambda n: n["tag"] == "item", _order_trees(spark, sf)).groupBy("digest").agg(F.count(F.lit(1)).alias("times"))
    return found.groupBy("times").agg(F.count(F.lit(1)).alias("groups"))


@_query("serialize_roundtrip", "SELECT o_orderkey AS doc_id, true AS same FROM orders")
def _roundtrip(spark, sf):
    once = serialize(_order_trees(spark, sf)).withColumnRenamed("xml", "source")
    # The first text goes along under the key of its document, so that the second needs no join with it.
    keyed = once.select(F.struct("doc_id", "source").alias("doc_id"), "source")
    twice = serialize(trees(keyed))
    return twice.select("doc_id.doc_id", (F.col("doc_id.source") == F.col("xml")).alias("same"))


@_query("serialize_layout", "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, '<region name=\"' || r_name || '\">' || chr(10) || string_agg('  <nation name=\"' || n_name || '\"' || coalesce('>' || chr(10) || cs || chr(10) || '  </nation>', '/>'), chr(10) ORDER BY n_nationkey) || chr(10) || '</region>' AS xml FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, string_agg('    <customer id=\"' || c_custkey || '\" seg=\"' || c_mktsegment || '\"/>', chr(10) ORDER BY c_custkey) AS cs FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY r_regionkey, r_name")
def _layout(spark, sf):
    # An element built without children has a closing tag; it is written as an empty one.
    return serialize(nodes(region_docs(spark, sf)))


@_query("set_attribute", "SELECT 'x' AS flag, 'q' || l_linenumber AS extra, 'n,flag,extra' AS keys, count(*) AS n FROM lineitem GROUP BY 2")
def _set(spark, sf):
    item = F.col("tag") == "item"
    t = set_attr(set_attr(_order_nodes(spark, sf), item, "flag", F.lit("x")), item, "extra", F.concat(F.lit("q"), nav.get("n")))
    return t.where("tag = 'item'").groupBy(nav.get("flag").alias("flag"), nav.get("extra").alias("extra"), F.array_join(nav.keys(), ",").alias("keys")).agg(F.count(F.lit(1)).alias("n"))


@_query("push_subtree", f"SELECT o_orderkey AS doc_id, replace(source, '</order>', '<end k=\"v\"><z/>t</end></order>') AS xml FROM {_DOCS}")
def _push_subtree(spark, sf):
    t = push(_order_trees(spark, sf), lambda n: n["tag"] == "order", xml='<end k="v"><z/>t</end>')
    return serialize(t, 0).select("doc_id", F.regexp_replace("xml", "\n", "").alias("xml"))


@_query("replace_with_attributes", f"SELECT o_orderkey AS doc_id, replace(source, '<cust>' || o_custkey || '</cust>', '<who kind=\"cust\" nr=\"3\"/>') AS xml FROM {_DOCS} JOIN orders USING (o_orderkey)")
def _replace_attrs(spark, sf):
    changed = replace(_order_trees(spark, sf), lambda n: n["tag"] == "cust", "Element", "who", attrs={"kind": lambda n: n["tag"], "nr": lambda n: n["node_id"]})
    return serialize(changed, 0).select("doc_id", F.regexp_replace("xml", "\n", "").alias("xml"))


@_query("push_child", "SELECT o_orderkey AS doc_id, CAST(5 + 5 * count(l_orderkey) AS INT) AS at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _push(spark, sf):
    t = unpacked(push(_order_trees(spark, sf), lambda n: n["tag"] == "order", "Element", "end"))
    return t.where("tag = 'end'").select("doc_id", F.col("node_id").alias("at"))


@_query("remove_nodes", "SELECT o_orderkey AS doc_id, 4 AS last_desc FROM orders")
def _remove(spark, sf):
    return unpacked(remove(_order_trees(spark, sf), lambda n: n["tag"] == "item")).where("kind = 'Document'").select("doc_id", "last_desc")


@_query("dtd_decls", "SELECT n_name AS name, 'value of ' || n_name AS value, CAST(n_regionkey AS BIGINT) AS doc_id FROM nation")
def _dtd(spark, sf):
    entity = F.concat(F.lit('<!ENTITY e'), F.col("n_nationkey"), F.lit(' "value of '), F.col("n_name"), F.lit('">'))
    subset = _table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(entity)), "\n").alias("x"))
    docs = subset.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("<!DOCTYPE r ["), F.col("x"), F.lit("]><r/>")).alias("source"))
    found = nodes(docs).where("kind = 'DTD'").select("doc_id", F.explode(dtd.parse_dtd(F.col("value"))["entities"]).alias("e"))
    return found.select(F.substring("e.value", 10, 100).alias("name"), F.col("e.value").alias("value"), "doc_id")


@_query("elements", "SELECT o_orderkey AS doc_id, 1 + count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _elements(spark, sf):
    return nav.elements(lambda n: n["tag"] == "order", _order_trees(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@_query("child_counts", "SELECT o_orderkey AS doc_id, 1 + count(l_orderkey) AS length FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _child_counts(spark, sf):
    return nav.child_counts(lambda n: n["tag"] == "order", _order_trees(spark, sf)).select("doc_id", "length")


@_query("last_child", f"SELECT o_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS n FROM orders LEFT JOIN {_ITEMS} ON l_orderkey = o_orderkey WHERE pos = many OR pos IS NULL")
def _last_child(spark, sf):
    return nav.last_child(lambda n: n["tag"] == "order", _order_trees(spark, sf)).select("doc_id", nav.get("n").alias("n"))


@_query("only_child", "SELECT o_orderkey AS doc_id, CAST(o_custkey AS VARCHAR) AS value FROM orders")
def _only_child(spark, sf):
    return nav.only_child(lambda n: n["tag"] == "cust", _order_trees(spark, sf)).select("doc_id", "value")


@_query("skip_element", f"SELECT l_orderkey AS doc_id, 'item' AS tag, CAST(l_linenumber AS VARCHAR) AS n FROM {_ITEMS} WHERE pos = 1")
def _skip(spark, sf):
    return nav.resume(lambda n: n["tag"] == "cust", _order_trees(spark, sf)).select("doc_id", "tag", nav.get("n").alias("n"))


@_query("attribute_keys", "WITH o AS (SELECT count(*) AS n FROM orders), i AS (SELECT count(*) AS n FROM lineitem) SELECT 'id,status' AS keys, n FROM o UNION ALL SELECT 'n,flag', n FROM i UNION ALL SELECT '', o.n + 2 * i.n FROM o, i")
def _keys(spark, sf):
    t = _order_nodes(spark, sf).where("kind = 'Element'")
    return t.groupBy(F.array_join(nav.keys(), ",").alias("keys")).agg(F.count(F.lit(1)).alias("n"))


@_query("attribute_tokens", """SELECT '"' || v || '"' AS raw, count(*) AS n FROM (SELECT l_returnflag AS v FROM lineitem UNION ALL SELECT CAST(l_linenumber AS VARCHAR) FROM lineitem UNION ALL SELECT o_orderstatus FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders) GROUP BY 1""")
def _attribute_tokens(spark, sf):
    return tokens(order_docs(spark, sf)).where("kind = 'ATTR_VALUE'").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


_path("xpath_nested_descendant", "//nation//customer", "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", _per_doc, region_docs)
_path("xpath_descendant_or_self", "/region/nation//", "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, count(DISTINCT n_nationkey) + count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1", _per_doc, region_docs)

_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@_query("source_span", f"SELECT doc_id, CAST(length({_ESCAPED}) AS BIGINT) AS chars, CAST(strlen({_ESCAPED}) AS BIGINT) AS bytes FROM documents WHERE text <> ''")
def _span(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", element("d", F.col("text")).column.alias("source"))
    spans = nav.source_span(nodes(docs).where("kind = 'Text'"), docs)
    return spans.select("doc_id", (F.col("char_end") - F.col("char_start")).cast("long").alias("chars"), (F.col("span_end") - F.col("span_start")).cast("long").alias("bytes"))


@_query("wf_errors", f"SELECT CASE o_orderstatus WHEN 'F' THEN 'unclosed element' WHEN 'P' THEN 'more than one root element' ELSE 'ok' END AS error, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN CAST(length(source) AS BIGINT) END AS at, count(*) AS n FROM {_DOCS} GROUP BY ALL")
def _wf_errors(spark, sf):
    docs, status = order_docs(spark, sf), F.regexp_extract("source", 'status="([^"]*)"', 1)
    broken = F.when(status == "F", F.regexp_replace("source", "</order>$", "")).when(status == "P", F.concat("source", F.lit("<x/>"))).otherwise(F.col("source"))
    return validate(docs.select("doc_id", broken.alias("source"))).groupBy(F.coalesce("error", F.lit("ok")).alias("error"), F.col("at").cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n"))


@_query("push_first_child", "SELECT o_orderkey AS doc_id, 3 AS at, CAST(5 + 5 * count(l_orderkey) AS INT) AS last_desc FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _push_first(spark, sf):
    t = unpacked(push_first(_order_trees(spark, sf), lambda n: n["tag"] == "order", "Element", "begin"))
    return t.groupBy("doc_id").agg(F.max(F.when(F.col("tag") == "begin", F.col("node_id"))).alias("at"), F.max("last_desc").alias("last_desc"))


@_query("replace_nodes", "SELECT o_orderkey AS doc_id, count(l_orderkey) AS n, CAST(4 + count(l_orderkey) AS INT) AS last_desc FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _replace(spark, sf):
    t = unpacked(replace(_order_trees(spark, sf), lambda n: n["tag"] == "item", "Comment", value=F.lit("gone")))
    return t.groupBy("doc_id").agg(F.count(F.when(F.col("kind") == "Comment", 1)).alias("n"), F.max("last_desc").alias("last_desc"))


def _declared(spark: SparkSession, sf: str, declaration: Column, field: str) -> DataFrame:
    """(doc_id, e): what parse_dtd finds under ``field`` in a document a region, with a declaration a nation."""
    subset = _table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(declaration)), "\n").alias("x"))
    docs = subset.select("doc_id", F.concat(F.lit("<!DOCTYPE r ["), F.col("x"), F.lit("]><r/>")).alias("source"))
    return nodes(docs).where("kind = 'DTD'").select("doc_id", F.explode(dtd.parse_dtd(F.col("value"))[field]).alias("e"))


@_query("dtd_elements", "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'e' || n_nationkey AS name, '(a,(b|c' || n_nationkey || ')*)' AS content FROM nation")
def _dtd_elements(spark, sf):
    key = F.col("n_nationkey").cast("string")
    return _declared(spark, sf, F.concat(F.lit("<!ELEMENT e"), key, F.lit(" (a,(b|c"), key, F.lit(")*)>")), "elements").select("doc_id", "e.name", "e.content")


@_query("dtd_attributes", "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'e' || n_nationkey AS element, name, type, standard FROM nation, (VALUES ('id', 'ID', '#REQUIRED'), ('k', '(x|y)', '\"x\"')) AS a(name, type, standard)")
def _dtd_attributes(spark, sf):
    found = _declared(spark, sf, F.concat(F.lit("<!ATTLIST e"), F.col("n_nationkey").cast("string"), F.lit(' id ID #REQUIRED k (x|y) "x">')), "attributes")
    return found.select("doc_id", "e.element", "e.name", "e.type", F.col("e.default").alias("standard"))


@_query("dtd_reads_on", "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'e' || n_nationkey AS name, '(#PCDATA)' AS content FROM nation")
def _dtd_reads_on(spark, sf):
    """Text that is no declaration is stepped over."""
    return _declared(spark, sf, F.concat(F.lit("<!ELEMENT e"), F.col("n_nationkey").cast("string"), F.lit(" (#PCDATA)> stray <!OTHER x>")), "elements").select("doc_id", "e.name", "e.content")


@_query("dtd_notations", "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'n' || n_nationkey AS name, 'SYSTEM \"' || n_name || '\"' AS external_id FROM nation")
def _dtd_notations(spark, sf):
    found = _declared(spark, sf, F.concat(F.lit("<!NOTATION n"), F.col("n_nationkey").cast("string"), F.lit(' SYSTEM "'), F.col("n_name"), F.lit('">')), "notations")
    return found.select("doc_id", "e.name", "e.external_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
