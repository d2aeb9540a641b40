"""Builders: XML text from columns; children and attributes are escaped, markup is passed as Markup."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import escape, escape_attr

_NAME = re.compile(r"[A-Za-z_:\u0080-\U0010FFFF][A-Za-z0-9_\-.:\u0080-\U0010FFFF]*")


def _named(name: str, what: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no name for {what}")
    return name


class Markup:
    """A column that is XML already."""

    def __init__(self, column: Column):
        self.column = column


class Element(Markup):
    """An element that can be called with more children and attributes, for one that has them too."""

    def __init__(self, tag: str, children: tuple, attrs: dict):
        self.tag, self.children, self.attrs = _named(tag, "an element"), children, attrs
        head = F.concat(F.lit(f"<{tag}"), *_attrs(attrs))
        super().__init__(F.concat(head, F.lit(">"), *[_child(c) for c in children], F.lit(f"</{tag}>")) if children else F.concat(head, F.lit("/>")))

    def __call__(self, *children, **attrs) -> Element:
        return Element(self.tag, (*self.children, *children), {**self.attrs, **attrs})


def _child(x) -> Column:
    if isinstance(x, Markup):
        return x.column
    return escape((x if isinstance(x, Column) else F.lit(str(x))).cast("string"))


def _refuse(x: Column, mark: str, what: str) -> Column:
    return F.when(F.contains(x, F.lit(mark)), F.raise_error(F.lit(f"{mark} in {what}")).cast("string")).otherwise(x)


def text(x) -> Markup:
    return Markup(_child(x))


def comment(x: Column) -> Markup:
    return Markup(F.concat(F.lit("<!--"), _refuse(x, "-->", "a comment"), F.lit("-->")))


def cdata(x: Column) -> Markup:
    return Markup(F.concat(F.lit("<![CDATA["), _refuse(x, "]]>", "CDATA"), F.lit("]]>")))


def processing_instruction(target: str, content: Column | None = None) -> Markup:
    return Markup(F.concat(F.lit(f"<?{_named(target, 'a processing instruction')}"), F.lit("") if content is None else F.concat(F.lit(" "), _refuse(content, "?>", "a processing instruction")), F.lit("?>")))


def declaration(**attrs) -> Markup:
    return Markup(F.concat(F.lit("<?xml"), *_attrs(attrs), F.lit("?>")))


def dtd(value: str) -> Markup:
    return Markup(F.lit(f"<!DOCTYPE {value}>"))


def _attrs(attrs: dict) -> list[Column]:
    return [F.concat(F.lit(f' {_named(k, "an attribute")}="'), escape_attr((v if isinstance(v, Column) else F.lit(str(v))).cast("string")), F.lit('"')) for k, v in attrs.items()]


def element(tag: str, *children, **attrs) -> Element:
    return Element(tag, children, attrs)


def document(*children: Markup) -> Column:
    """Only markup may stand at the top."""
    if not all(isinstance(c, Markup) for c in children):
        raise ValueError("a document holds markup only")
    return F.concat(*[c.column for c in children])


class _Builder:
    """h("tag", ...) or h.tag(...)."""

    def __call__(self, tag: str, *children, **attrs) -> Markup:
        return element(tag, *children, **attrs)

    def __getattr__(self, tag: str):
        return lambda *children, **attrs: element(tag, *children, **attrs)


h = _Builder()
