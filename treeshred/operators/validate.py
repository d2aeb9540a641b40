"""Well-formedness at three levels, as data: (doc_id, ok, error, at)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ILLEGAL_CHAR, NAME_START
from .lex import TAG
from .trees import CLOSE, COMMENT, DECLARATION, DOCTYPE, DOCUMENT, EMPTY, OPEN, PI, TEXT, Lexemes, attributes, byte_lengths, code_point, in_chunks, python_regex, texts

LEVELS = ("lenient", "structural", "strict")
_TAG, _NAME_START, _ILLEGAL = (re.compile(python_regex(x)) for x in (TAG, NAME_START, ILLEGAL_CHAR))
_CHAR_REF = re.compile("&#(?:[0-9]+|x[0-9a-fA-F]+);")
_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]*")  # Unicode's white space


def is_blank(x: str) -> bool:
    return _BLANK.fullmatch(x) is not None


def _bad_reference(raw: str) -> bool:
    for ref in _CHAR_REF.findall(raw) if "&#" in raw else ():
        code = code_point(ref)
        if code is None or code in (0xFFFE, 0xFFFF) or code < 32 and code not in (9, 10, 13):
            return True
    return False


def _findings(x: Lexemes, level: str) -> list[tuple[np.ndarray, str]]:
    """(lexemes that have it, what is wrong), in the order in which one lexeme's faults count."""
    kind, raw = x.kind, x.raw
    tag, close = (kind == OPEN) | (kind == EMPTY), kind == CLOSE

    def those(where: np.ndarray, test) -> np.ndarray:
        out = np.zeros(len(raw), bool)
        at = np.flatnonzero(where)
        out[at] = np.fromiter((test(i) for i in at.tolist()), bool, len(at))
        return out

    memo: dict[str, bool] = {}

    def malformed(i: int) -> bool:
        if (known := memo.get(raw[i])) is None:
            known = memo[raw[i]] = _TAG.search(raw[i]) is None
        return known

    has_attrs = (tag | (kind == DECLARATION)) & those(tag | (kind == DECLARATION), lambda i: "=" in raw[i])
    attrs = {i: attributes(raw[i]) for i in np.flatnonzero(has_attrs).tolist()}
    names = {i: x.name(i) for i in np.flatnonzero((close & (x.opener >= 0)) | tag if level != "lenient" else close & (x.opener >= 0)).tolist()}
    opened = lambda i: names.get(x.opener[i]) or x.name(x.opener[i])
    cases = [
        ((kind == DOCUMENT) & ~x.complete[x.doc], "lexical error"),
        (those(tag, malformed), "malformed tag"),
        (close & (x.opener < 0), "closing tag without an opening one"),
        (those(close & (x.opener >= 0), lambda i: opened(i) != names[i]), "mismatched tags"),
        ((kind == OPEN) & (x.closer < 0), "unclosed element"),
        (those(has_attrs, lambda i: len({k for k, _ in attrs[i]}) != len(attrs[i])), "duplicate attribute"),
    ]
    if level != "lenient":
        top = x.depth == 2
        root = top & tag
        before = lambda of: x.running(of) - of
        of_doc = lambda of: (np.add.reduceat(of, x.begin) if len(x.begin) else of)[x.doc]
        markup = of_doc(((kind != DOCUMENT) & (kind != TEXT)).astype(np.int64)) > 0
        cases += [
            (those(tag, lambda i: not _NAME_START.match(names[i])), "invalid element name"),
            (those(has_attrs, lambda i: any("<" in v for _, v in attrs[i])), "'<' in an attribute value"),
            ((kind == DECLARATION) & ~((x.seq == 1) & top), "misplaced XML declaration"),
            ((kind == DOCTYPE) & (~top | (before(root) > 0)), "misplaced DOCTYPE"),
            ((kind == DOCTYPE) & (before(kind == DOCTYPE) > 0), "more than one DOCTYPE"),
            (root & (before(root) > 0), "more than one root element"),
            (those(top & (kind == TEXT), lambda i: not is_blank(raw[i])), "text outside the root element"),
            ((kind == DOCUMENT) & markup & (of_doc(root.astype(np.int64)) == 0), "no root element"),
        ]
    if level == "strict":
        body = lambda i: raw[i][4:-3]
        target = lambda i: re.match(r"<\?(.?)", raw[i], re.S)[1]
        cases += [
            (those(kind != DOCUMENT, lambda i: _ILLEGAL.search(raw[i]) is not None), "character not allowed in XML"),
            (those(tag | (kind == TEXT), lambda i: _bad_reference(raw[i])), "reference to a character not allowed in XML"),
            (those(kind == COMMENT, lambda i: "--" in body(i) or body(i).endswith("-")), "'--' in a comment"),
            (those(kind == PI, lambda i: not _NAME_START.match(target(i))), "invalid target of a processing instruction"),
        ]
    return cases


def _verdicts(sources: list[str | None], lengths: list[int], level: str) -> pa.Array:
    x = Lexemes(sources, lengths)
    why = np.full(len(x.raw), -1)
    cases = _findings(x, level)
    for k in reversed(range(len(cases))):
        why[cases[k][0]] = k
    wrong = np.flatnonzero(why >= 0)
    doc, at = np.unique(x.doc[wrong], return_index=True)
    first = np.full(len(sources), -1)
    first[doc] = wrong[at]
    ok = first < 0
    error = pa.array([w for _, w in cases], pa.string()).take(pa.array(np.where(ok, 0, why[first] if len(why) else first), mask=ok))
    return pa.StructArray.from_arrays([pa.array(ok), error, pa.array((x.start[first] if len(why) else first).astype(np.int32), mask=ok)], ["ok", "error", "at"])


def validate(docs: DataFrame, level: str = "structural") -> DataFrame:
    """Whether each document (each row, whatever its doc_id) is well-formed, the first thing that is wrong with it, and the
    byte at which what is wrong begins (from 0). A null source has a lexical error. Documents stay where they are."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")

    def verdict(column: pa.Array) -> pa.Array:
        lengths = byte_lengths(column)
        return in_chunks(lengths, lambda i, j: _verdicts(texts(column[i:j]), lengths[i:j].tolist(), level))

    found = docs.select("doc_id", F.arrow_udf(verdict, "struct<ok:boolean,error:string,at:int>")("source").alias("_e"))
    return found.select("doc_id", "_e.ok", "_e.error", "_e.at")


def require_valid(docs: DataFrame, level: str = "structural") -> DataFrame:
    """The documents, as they are; the job fails at the first that is not well-formed."""
    why = validate(docs, level).groupBy(F.col("doc_id").alias("_d")).agg(F.min("ok").alias("_ok"), F.min("error").alias("_error"), F.min_by("at", "error").alias("_at"))
    j = docs.join(why, docs["doc_id"].eqNullSafe(why["_d"]))
    message = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without an id")), F.lit(": "), F.col("_error"), F.lit(" at byte "), F.col("_at").cast("string"))
    return j.where(F.when(F.col("_ok"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).select(*[docs[c] for c in docs.columns])
