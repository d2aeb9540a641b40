"""Packed trees: a document and all its nodes as one row, (doc_id, tree), so that nothing is sorted or shuffled by node.

Documents are lexed by one regular expression each, and all else is made for a whole Arrow batch of them at once, by
arrays over all its lexemes. A node's row in ``tree`` is its node_id, so a parent, a subtree or what follows it is found
by its place. Operators take packed trees where they take a node relation; then ``where`` is a function of a node.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ENTITIES
from .lex import ATTRIBUTE, LEXEME, NAME_CHARS

ATTRS = "array<struct<name:string,value:string>>"
NODE = f"node_id:int,parent_id:int,child_pos:int,kind:string,tag:string,value:string,attrs:{ATTRS},depth:int,last_desc:int,span_start:int,span_end:int"
TREE = f"array<struct<{NODE}>>"
FIELDS = [f.split(":")[0] for f in "node_id:,parent_id:,child_pos:,kind:,tag:,value:,attrs:,depth:,last_desc:,span_start:,span_end:".split(",")]
CHUNK = 1 << 20  # bytes of sources, and about as many nodes' fields, that are taken apart at once

DOCUMENT, TEXT, COMMENT, CDATA, DOCTYPE, DECLARATION, PI, OPEN, EMPTY, CLOSE = range(10)
_KINDS = pa.array(["Document", "Text", "Comment", "CData", "DTD", "Declaration", "ProcessingInstruction", "Element", "Element"])


def python_regex(java: str) -> str:
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", java)


_LEX = re.compile(python_regex(LEXEME))
_ATTR = re.compile(python_regex(ATTRIBUTE))
_NAME = re.compile(python_regex(rf"</?({NAME_CHARS}*+)"))
_DECL = re.compile(python_regex(rf"<\?xml(?!{NAME_CHARS})"))
_PI_TARGET = re.compile(python_regex(rf"<\?({NAME_CHARS}*+)"))
_DTD_HEAD = re.compile(python_regex(rf"<!{NAME_CHARS}*+"))
_REF = re.compile("&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);")
_WS = re.compile(r"\r\n|[\t\n\r]")


def code_point(ref: str) -> int | None:
    """The number in a character reference, None if it is no Unicode scalar value."""
    hexed = ref[2] == "x"
    digits = ref[3 if hexed else 2 : -1].lstrip("0") or "0"
    value = int(digits, 16 if hexed else 10) if len(digits) <= 8 else -1
    return value if 0 <= value <= 0xD7FF or 0xE000 <= value <= 0x10FFFF else None


def _decoded(m: re.Match) -> str:
    ref = m[0]
    if ref[1] != "#":
        return ENTITIES[ref]
    code = code_point(ref)
    return ref if code is None else chr(code)


def unescape(x: str) -> str:
    return _REF.sub(_decoded, x) if "&" in x else x


def attributes(raw: str) -> list[tuple[str, str]]:
    return _ATTR.findall(raw) if "=" in raw else []


def _kind(p: str) -> int:
    if p[0] != "<":
        return TEXT
    c = p[1]
    if c == "/":
        return CLOSE
    if c == "!":
        return COMMENT if p.startswith("<!--") else CDATA if p.startswith("<![CDATA[") else DOCTYPE
    if c == "?":
        return DECLARATION if _DECL.match(p) else PI
    return EMPTY if p.endswith("/>") else OPEN


def texts(column: pa.Array) -> list[str | None]:
    """Strings of a column; bytes that are no UTF-8 become replacement characters, as in the JVM."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode(errors="replace") for b in column.view(pa.binary()).to_pylist()]


class Lexemes:
    """The lexemes of some documents, each document's after one that stands for itself, as arrays: where a tag's match is,
    and of nodes their ids, parents and places. Along one depth the children of a node are neighbours, and a tag's match
    is the next or last tag."""

    def __init__(self, sources: list[str | None], lengths: list[int]):
        self.raw, counts, sizes, complete = [], [], [], []
        for s, length in zip(sources, lengths, strict=True):
            parts = _LEX.findall(s) if s else []
            own = list(map(len, parts)) if s is None or s.isascii() else [len(p.encode()) for p in parts]
            complete.append(s is not None and sum(own) == length)
            self.raw.append("")
            self.raw += parts
            sizes.append(0)
            sizes += own
            counts.append(len(parts) + 1)
        raw = self.raw
        self.kind = kind = np.fromiter((_kind(p) if p else DOCUMENT for p in raw), np.int8, len(raw))
        self.complete, counts = np.array(complete, bool), np.array(counts, np.int64)
        self.stop = np.cumsum(counts)
        self.begin = self.stop - counts
        self.doc = doc = np.repeat(np.arange(len(counts)), counts)
        self.seq = np.arange(len(raw)) - self.begin[doc]
        self.size = size = np.array(sizes, np.int64)
        self.is_node = node = kind != CLOSE
        self.end, self.node_id, after = self.running(size), self.running(node), self.running(np.where((kind == OPEN) | (kind == DOCUMENT), 1, np.where(kind == CLOSE, -1, 0)))
        self.start = self.end - size
        opens = (kind == OPEN) | (kind == DOCUMENT)
        self.depth = np.where(opens, after, after + 1)
        above = np.zeros(len(raw), bool)
        above[1:] = opens[:-1]
        above[self.begin] = False
        first = node & above  # what follows an opening tag, unless that closes it, is its first child
        order = np.lexsort((self.depth, doc))
        d, dep = doc[order], self.depth[order]
        fresh = np.ones(len(raw), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (dep[1:] != dep[:-1])
        at = np.arange(len(raw))
        group = np.maximum.accumulate(np.where(fresh, at, 0))
        reset = np.maximum.accumulate(np.where(first[order], at, -1))
        nth = np.cumsum(node[order])
        has = (reset >= group) & node[order]
        parent, place = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        parent[order] = np.where(has, self.node_id[order][reset] - 1, 0)
        place[order] = np.where(has, nth - nth[reset] + 1, 0)
        self.parent_id, self.child_pos = parent, place  # 0 for none
        tag = (opens | (kind == CLOSE))[order]
        seen = np.maximum.accumulate(np.where(tag, at, -1))
        before = np.concatenate(([-1], seen[:-1]))
        self.opener = np.full(len(raw), -1)  # of a closing tag: the opening one that it meets
        met = (before >= group) & (kind[order] == CLOSE)
        met &= kind[order][before] == OPEN
        self.opener[order[met]] = order[before[met]]
        self.closer = np.full(len(raw), -1)
        self.closer[order[before[met]]] = order[met]

    def running(self, x: np.ndarray) -> np.ndarray:
        """The running sum within each document."""
        total = np.cumsum(x, dtype=np.int64)
        return total - (total[self.begin] - x[self.begin].astype(np.int64))[self.doc]

    def name(self, i: int) -> str:
        return _NAME.match(self.raw[i])[1]

    def tree(self, decode: bool) -> pa.Array:
        keep = np.flatnonzero(self.is_node)
        tag, value, attr_n, attr_k, attr_v, memo = [], [], [], [], [], {}
        for i, kind in zip(keep.tolist(), self.kind[keep].tolist(), strict=True):
            raw, t, v, n = self.raw[i], None, None, 0
            if kind == TEXT:
                v = unescape(raw) if decode else raw
            elif kind in (OPEN, EMPTY, DECLARATION):
                if "=" in raw:
                    t = None if kind == DECLARATION else self.name(i)
                    for k, q in _ATTR.findall(raw):
                        n += 1
                        attr_k.append(k)
                        attr_v.append(unescape(_WS.sub(" ", q[1:-1])) if decode else q[1:-1])
                elif kind != DECLARATION:
                    t = memo.get(raw)
                    if t is None:
                        t = memo[raw] = self.name(i)
            elif kind == COMMENT:
                v = raw[4:-3]
            elif kind == CDATA:
                v = raw[9:-3]
            elif kind == DOCTYPE:
                v = _DTD_HEAD.sub("", raw, count=1)[:-1].lstrip(" \t\r\n")
            elif kind == PI:
                m = _PI_TARGET.match(raw)
                t, v = m[1], raw[m.end() : -2].lstrip(" \t\r\n") or None
            tag.append(t)
            value.append(v)
            attr_n.append(n)
        most, whole = self.node_id[self.stop - 1], self.end[self.stop - 1]
        doc, kind, closer = self.doc[keep], self.kind[keep], self.closer[keep]
        open_ = kind == OPEN
        shut = np.where(closer >= 0, closer, 0)
        last = np.where(kind == DOCUMENT, most[doc], np.where(open_, np.where(closer >= 0, self.node_id[shut], most[doc]), self.node_id[keep]))
        end = np.where(kind == DOCUMENT, whole[doc], np.where(open_, np.where(closer >= 0, self.end[shut], whole[doc]), self.end[keep]))
        pairs = pa.StructArray.from_arrays([pa.array(attr_k, pa.string()), pa.array(attr_v, pa.string())], ["name", "value"])
        some = lambda x: pa.array(x[keep].astype(np.int32), mask=self.parent_id[keep] == 0)
        return packed(np.bincount(doc, minlength=len(self.begin)), [
            ints(self.node_id[keep]), some(self.parent_id), some(self.child_pos), _KINDS.take(pa.array(kind)), pa.array(tag, pa.string()), pa.array(value, pa.string()),
            pa.ListArray.from_arrays(offsets(attr_n), pairs), ints(self.depth[keep]), ints(last), ints(self.start[keep]), ints(end),
        ])


def ints(x: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    return pa.array(x.astype(np.int32), mask=none)


def offsets(counts) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))


def packed(counts: np.ndarray, columns: list[pa.Array], names: list[str] = FIELDS) -> pa.Array:
    return pa.ListArray.from_arrays(offsets(counts), pa.StructArray.from_arrays(columns, names))


def in_chunks(weights: np.ndarray, make: Callable[[int, int], pa.Array]) -> pa.Array:
    """What ``make`` gives for runs of rows that weigh about CHUNK together, as one array."""
    total, out, i = np.cumsum(weights + 64), [], 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + CHUNK, "right")))
        out.append(make(i, j))
        i = j
    return pa.concat_arrays(out) if out else make(0, 0)


def byte_lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)


def _shredder(decode: bool):
    def shred(sources: pa.Array) -> pa.Array:
        lengths = byte_lengths(sources)
        return in_chunks(lengths, lambda i, j: Lexemes(texts(sources[i:j]), lengths[i:j].tolist()).tree(decode))

    return F.arrow_udf(shred, TREE)


def trees(docs: DataFrame, decode: bool = True) -> DataFrame:
    """(doc_id, tree) of (doc_id, source); see shred.nodes(). Documents stay where they are."""
    return docs.select("doc_id", _shredder(decode)("source").alias("tree"))


def is_packed(df: DataFrame) -> bool:
    return "tree" in df.columns


def unpacked(rows: DataFrame, of: Column | str = "tree") -> DataFrame:
    """A row a node (or whatever the structs hold). An outer explode, since from another one the optimizer infers a filter
    that would make each tree twice."""
    return rows.select("doc_id", F.posexplode_outer(of).alias("_pos", "_node")).where("_node is not null").select("doc_id", "_node.*")


def node_at(node_id: Column) -> Column:
    """The node of ``tree`` with an id, null if there is none."""
    return F.when(node_id >= 1, F.get("tree", node_id - 1))


def subtree(n: Column) -> Column:
    """A node and all that is in it."""
    return F.slice("tree", n["node_id"], n["last_desc"] - n["node_id"] + 1)


class Batch:
    """The nodes of a column of packed trees, as arrays."""

    def __init__(self, column: pa.Array):
        counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
        self.nodes = nodes = column.flatten()
        self.counts, self.stop = counts, np.cumsum(counts)
        self.begin = self.stop - counts
        self.doc = np.repeat(np.arange(len(counts)), counts)
        number = lambda name: np.asarray(pc.fill_null(nodes.field(name), 0)).astype(np.int64)
        self.node_id, self.parent_id, self.depth, self.last_desc = map(number, ("node_id", "parent_id", "depth", "last_desc"))
        self.row = self.begin[self.doc]  # of its document
        self.up = np.where(self.parent_id > 0, self.row + self.parent_id - 1, -1)
        self.last = self.row + self.last_desc - 1

    def strings(self, name: str) -> list[str | None]:
        return texts(self.nodes.field(name))

    def is_(self, name: str, value: str) -> np.ndarray:
        return np.asarray(pc.fill_null(pc.equal(self.nodes.field(name), value), False))

    def attributes(self) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """(row, place, name, value) of each attribute, in order."""
        attrs = self.nodes.field("attrs")
        counts = np.asarray(pc.fill_null(pc.list_value_length(attrs), 0)).astype(np.int64)
        flat = attrs.flatten()
        row = np.repeat(np.arange(len(counts)), counts)
        return row, np.arange(len(row)) - (np.cumsum(counts) - counts)[row], flat.field("name"), flat.field("value")


def ranges(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number): the numbers from each first on, as many as its count, and whose they are."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - (np.cumsum(counts) - counts)[which] + first[which]
