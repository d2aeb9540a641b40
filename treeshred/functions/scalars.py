"""Column expressions on strings: escaping, entities, attribute white space, names and characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of XML 1.0.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
ILLEGAL_CHAR = r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
NAME_START = r"[A-Za-z_:\x{80}-\x{10FFFF}]"
NAME = NAME_START + r"[A-Za-z0-9_\-.:\x{80}-\x{10FFFF}]*"


def escape(x: Column) -> Column:
    """The five predefined characters as entities; not idempotent."""
    for entity, char in ENTITIES.items():
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def escape_attr(x: Column) -> Column:
    """As escape(), and tab, line feed and carriage return as references, which attribute normalisation would lose."""
    x = escape(x)
    for char, ref in (("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        x = F.replace(x, F.lit(char), F.lit(ref))
    return x


def _code_point(ref: Column) -> Column:
    """The number in a character reference, null if it is no Unicode scalar value."""
    digits = F.regexp_extract(ref, "^&#x?0*([0-9a-fA-F]{1,8});$", 1)
    base = F.when(F.substring(ref, 3, 1) == "x", 16).otherwise(10)
    value = F.call_function("conv", F.nullif(digits, F.lit("")), base, F.lit(10)).cast("long")
    return F.when(value.between(0, 0xD7FF) | value.between(0xE000, 0x10FFFF), value)


def _decoded(part: Column) -> Column:
    code = _code_point(part)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    out = F.when(part.rlike("^&#(x[0-9a-fA-F]+|[0-9]+);$"), F.coalesce(char, part))
    for entity, plain in ENTITIES.items():
        out = out.when(part == entity, F.lit(plain))
    return out.otherwise(part)


def unescape(x: Column) -> Column:
    """Predefined entities and character references, in one pass; all else stays, custom entities too."""
    parts = F.regexp_extract_all(x, F.lit("&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);|[^&]++|&"), F.lit(0))
    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(parts, _decoded), "")).otherwise(x)


def normalize_attr_ws(x: Column) -> Column:
    """A CRLF, and else each tab, line feed and carriage return, as one blank."""
    return F.regexp_replace(x, r"\r\n|[\t\n\r]", " ")


def is_name(x: Column) -> Column:
    return x.rlike(f"^{NAME}$")


def has_illegal_char(x: Column) -> Column:
    return x.rlike(ILLEGAL_CHAR)


def has_illegal_reference(x: Column) -> Column:
    """A character reference to what is no XML character."""
    refs = F.regexp_extract_all(x, F.lit("&#(?:[0-9]+|x[0-9a-fA-F]+);"), F.lit(0))

    def bad(ref: Column) -> Column:
        code = _code_point(ref)
        return code.isNull() | ((code < 32) & ~code.isin(9, 10, 13)) | code.isin(0xFFFE, 0xFFFF)

    return F.contains(x, F.lit("&#")) & F.exists(refs, bad)
