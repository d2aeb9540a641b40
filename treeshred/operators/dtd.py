"""Document type declarations to structs, by a vectorised function: content models nest, which no regular expression
follows. Not validating; entity values stay as they are written."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = (
    "root string, system_id string, public_id string, elements array<struct<name:string,content:string>>, "
    "attributes array<struct<element:string,name:string,type:string,default:string>>, "
    "entities array<struct<name:string,value:string,external_id:string,parameter:boolean>>, "
    "notations array<struct<name:string,external_id:string>>, error string"
)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[\w.:\-\u0080-\U0010FFFF]+")
_SKIP = re.compile(r"\s+|<!--.*?-->|<\?.*?\?>|%[^;\s]*;", re.S)


class _Reader:
    """A position in the text of a declaration."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> None:
        if m := _SPACE.match(self.text, self.at):
            self.at = m.end()

    def has(self, word: str) -> bool:
        self.space()
        if self.text.startswith(word, self.at):
            self.at += len(word)
            return True
        return False

    def name(self) -> str:
        self.space()
        m = _NAME.match(self.text, self.at)
        if not m:
            if self.text.startswith("%", self.at):
                raise ValueError("parameter entity references are not supported here")
            raise ValueError(f"a name is missing at {self.at}")
        self.at = m.end()
        return m[0]

    def quoted(self) -> str:
        self.space()
        mark = self.text[self.at : self.at + 1]
        end = self.text.find(mark, self.at + 1) if mark in ('"', "'") and mark else -1
        if end < 0:
            raise ValueError(f"a quoted value is missing at {self.at}")
        out, self.at = self.text[self.at + 1 : end], end + 1
        return out

    def parens(self) -> str:
        begin, depth = self.at, 0
        for i in range(begin, len(self.text)):
            depth += {"(": 1, ")": -1}.get(self.text[i], 0)
            if depth == 0:
                self.at = i + 1
                return self.text[begin : i + 1]
        raise ValueError("a parenthesis isn't closed")

    def external(self) -> tuple[str | None, str | None] | None:
        """(public, system) of PUBLIC or SYSTEM, if one stands here."""
        if self.has("SYSTEM"):
            return None, self.quoted()
        if self.has("PUBLIC"):
            public = self.quoted()
            self.space()
            return public, self.quoted() if self.text[self.at : self.at + 1] in ('"', "'") else None
        return None

    def rest(self) -> str:
        """Up to the declaration's end, quotes respected."""
        begin = self.at
        while self.at < len(self.text) and self.text[self.at] != ">":
            if self.text[self.at] in "\"'":
                self.quoted()
            else:
                self.at += 1
        out = self.text[begin : self.at]
        self.at += 1
        return out.strip()


def _external_text(e: tuple[str | None, str | None]) -> str:
    public, system = e
    return f'SYSTEM "{system}"' if public is None else f'PUBLIC "{public}"' + (f' "{system}"' if system is not None else "")


def _attlist(r: _Reader, out: dict) -> None:
    element = r.name()
    while not r.has(">"):
        name = r.name()
        r.space()
        if r.text.startswith("(", r.at):
            kind = r.parens()
        else:
            kind = r.name()
            if kind == "NOTATION":
                r.space()
                kind = f"NOTATION {r.parens()}"
        if r.has("#FIXED"):
            default = f'#FIXED "{r.quoted()}"'
        elif r.has("#"):
            default = "#" + r.name()
        else:
            default = f'"{r.quoted()}"'
        out["attributes"].append({"element": element, "name": name, "type": kind, "default": default})


def _entity(r: _Reader, out: dict) -> None:
    parameter = r.has("%")
    name = r.name()
    external = r.external()
    value = None if external else r.quoted()
    r.rest()
    out["entities"].append({"name": name, "value": value, "external_id": _external_text(external) if external else None, "parameter": parameter})


def parse(value: str | None) -> dict:
    """What a DTD node's value declares; ``error`` tells where a declaration broke off, which ends
    reading, or else where the first text stands that is none and was stepped over."""
    out: dict = {"root": None, "system_id": None, "public_id": None, "elements": [], "attributes": [], "entities": [], "notations": [], "error": None}
    if value is None:
        return out
    r = _Reader(value)
    try:
        out["root"] = r.name()
        if external := r.external():
            out["public_id"], out["system_id"] = external
        if not r.has("["):
            return out
        while r.at < len(r.text):
            if m := _SKIP.match(r.text, r.at):
                r.at = m.end()
            elif r.has("]"):
                break
            elif r.has("<!ELEMENT"):
                name = r.name()
                out["elements"].append({"name": name, "content": r.rest()})
            elif r.has("<!ATTLIST"):
                _attlist(r, out)
            elif r.has("<!ENTITY"):
                _entity(r, out)
            elif r.has("<!NOTATION"):
                name = r.name()
                external = r.external()
                r.rest()
                out["notations"].append({"name": name, "external_id": _external_text(external) if external else None})
            else:  # stepped over; what follows is read
                out["error"] = out["error"] or f"no declaration is known at {r.at}"
                r.at += 1
    except ValueError as e:
        out["error"] = str(e)
    return out


def _parse_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for values in batches:
        yield pd.DataFrame([parse(v) for v in values], columns=["root", "system_id", "public_id", "elements", "attributes", "entities", "notations", "error"])


def parse_dtd(value: Column) -> Column:
    """The value of a DTD node as a struct of its declarations."""
    return F.pandas_udf(_parse_all, SCHEMA)(value)
