"""Lexing: documents to lexemes (whole tags, comments, runs of text) and to tokens, by one regular expression.

Lexemes tile a document that lexes; where they don't, the document has a lexical error. Quantifiers are possessive, so
long tags need no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUOTED = r""""[^"]*+"|'[^']*+'"""
_SUBSET = rf"\[(?:<!--(?s:.)*?-->|[^\]\"'<]++|{_QUOTED}|<)*+\]"
LEXEME = "|".join(
    [
        r"<!--(?s:.)*?-->",
        r"<!\[CDATA\[(?s:.)*?\]\]>",
        r"<\?(?s:.)*?\?>",
        rf"<!(?!--|\[)(?:<!--(?s:.)*?-->|[^\[\]<>\"']++|{_QUOTED}|{_SUBSET})*+>",
        r"</[^<>]*+>",
        rf"<(?![!?/])(?:[^>\"']++|{_QUOTED})*+>",
        r"[^<]++",
    ]
)
NAME_CHARS = r"[A-Za-z0-9_\-.:\x{80}-\x{10FFFF}]"
ATTRIBUTE = rf"({NAME_CHARS}++)[ \t\r\n]*+=[ \t\r\n]*+({_QUOTED})"
# What may stand between a tag's name and its end.
TAG = rf"^<{NAME_CHARS}*+(?:[ \t\r\n]*+{ATTRIBUTE.replace('(' + NAME_CHARS, NAME_CHARS).replace('++)[', '++[')})*+[ \t\r\n]*+/?>$"


def lexeme_kind(raw: Column) -> Column:
    return (
        F.when(~raw.startswith("<"), "text")
        .when(raw.startswith("<!--"), "comment")
        .when(raw.startswith("<![CDATA["), "cdata")
        .when(raw.startswith("<!"), "doctype")
        .when(raw.rlike(rf"^<\?xml(?!{NAME_CHARS})"), "declaration")
        .when(raw.startswith("<?"), "pi")
        .when(raw.startswith("</"), "close")
        .when(raw.endswith("/>"), "empty")
        .otherwise("open")
    )


def lexemes(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_no, seq, raw, kind, size, complete): lexemes in order from 1; seq 0 stands for the document itself.

    Documents are dealt by doc_id before they are taken apart, so the windows that follow need no other shuffle. doc_no
    tells rows apart that share a doc_id, or have none: each row is a document of its own. It holds for one run only.
    complete: whether the lexemes tile the source. A null source has only its document row and isn't complete.
    """
    parts = F.regexp_extract_all(F.coalesce("source", F.lit("")), F.lit(f"({LEXEME})"), F.lit(0))
    cut = docs.select("doc_id", "source").repartition("doc_id").withColumn("doc_no", F.monotonically_increasing_id()).withColumn("_parts", parts)
    whole = F.aggregate("_parts", F.lit(0), lambda n, p: n + F.octet_length(p)) == F.octet_length(F.coalesce("source", F.lit("")))
    rows = cut.withColumn("complete", whole & F.col("source").isNotNull()).select("doc_id", "doc_no", "complete", F.posexplode(F.concat(F.array(F.lit("")), F.col("_parts"))).alias("seq", "raw"))
    return rows.select("doc_id", "doc_no", "seq", "raw", F.when(F.col("seq") == 0, "document").otherwise(lexeme_kind(F.col("raw"))).alias("kind"), F.octet_length("raw").alias("size"), "complete")


def attributes(raw: Column) -> Column:
    """A tag's attributes as (name, value with its quotes), in order."""
    found = F.regexp_extract_all(raw, F.lit(ATTRIBUTE), F.lit(0))
    pair = lambda a: F.struct(F.regexp_extract(a, rf"^({NAME_CHARS}++)", 1).alias("name"), F.regexp_extract(a, rf"=[ \t\r\n]*+({_QUOTED})$", 1).alias("value"))
    return F.when(F.contains(raw, F.lit("=")), F.transform(found, pair)).otherwise(F.expr("cast(array() as array<struct<name:string,value:string>>)"))


def tag_name(raw: Column) -> Column:
    return F.regexp_extract(raw, rf"^</?({NAME_CHARS}*+)", 1)


def pi_target(raw: Column) -> Column:
    return F.regexp_extract(raw, rf"^<\?({NAME_CHARS}*+)", 1)


def tokens(docs: DataFrame, start: Column | int = 0) -> DataFrame:
    """(doc_id, seq, part, kind, raw, has_entities): the tokens of each lexeme, from the byte ``start`` (from 0) on, which
    should be where one begins; a start at or beyond the end gives none."""
    if not isinstance(start, int) or start:
        tail = F.decode(F.substring(F.encode("source", "UTF-8"), F.lit(start) + 1, F.octet_length("source")), "UTF-8")
        docs = docs.select("doc_id", tail.alias("source"))
    t = lambda kind, raw: F.struct(F.lit(kind).alias("kind"), raw.alias("raw"))
    raw = F.col("raw")
    attrs = F.flatten(F.transform(attributes(raw), lambda a: F.array(t("ATTR_NAME", a["name"]), t("ATTR_VALUE", a["value"]))))
    inner = lambda a, b: F.substring(raw, F.lit(a + 1), F.length(raw) - a - b)
    bodies = {
        "text": F.array(t("TEXT", raw)),
        "comment": F.array(t("COMMENT_OPEN", F.lit("<!--")), t("COMMENT_CONTENT", inner(4, 3)), t("COMMENT_CLOSE", F.lit("-->"))),
        "cdata": F.array(t("CDATA_OPEN", F.lit("<![CDATA[")), t("CDATA_CONTENT", inner(9, 3)), t("CDATA_CLOSE", F.lit("]]>"))),
        "doctype": F.array(t("DOCTYPE_OPEN", F.regexp_extract(raw, rf"^(<!{NAME_CHARS}*+)", 1)), t("DOCTYPE_CONTENT", F.regexp_replace(raw, rf"^<!{NAME_CHARS}*+|>$", "")), t("DOCTYPE_CLOSE", F.lit(">"))),
        "declaration": F.concat(F.array(t("XML_DECL_OPEN", F.lit("<?xml"))), attrs, F.array(t("XML_DECL_CLOSE", F.lit("?>")))),
        "pi": F.array(t("PI_OPEN", F.concat(F.lit("<?"), pi_target(raw))), t("PI_CONTENT", F.regexp_replace(raw, rf"^<\?{NAME_CHARS}*+|\?>$", "")), t("PI_CLOSE", F.lit("?>"))),
        "close": F.array(t("CLOSE_TAG", F.concat(F.lit("</"), tag_name(raw))), t("TAG_CLOSE", F.lit(">"))),
        "empty": F.concat(F.array(t("OPEN_TAG", F.concat(F.lit("<"), tag_name(raw)))), attrs, F.array(t("SELF_CLOSE", F.lit("/>")))),
        "open": F.concat(F.array(t("OPEN_TAG", F.concat(F.lit("<"), tag_name(raw)))), attrs, F.array(t("TAG_CLOSE", F.lit(">")))),
    }
    which = F.lit(None)
    for kind, parts in bodies.items():
        which = F.when(F.col("kind") == kind, parts).otherwise(which)
    rows = lexemes(docs).where("seq > 0").select("doc_id", "seq", F.posexplode(which).alias("part", "_t"))
    entity = F.col("_t.kind").isin("TEXT", "ATTR_VALUE") & F.contains(F.col("_t.raw"), F.lit("&"))
    return rows.select("doc_id", "seq", "part", "_t.kind", "_t.raw", entity.alias("has_entities"))
