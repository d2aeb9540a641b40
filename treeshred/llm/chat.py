"""Chat formatting with a template that is a black box: where turns stand is found from what it renders.

Successive prefixes of a conversation are rendered; what a prefix adds to the one before it is the new turn's span. A
template whose output for a prefix doesn't begin with its output for the shorter one rewrites history, and is reported.
The text inside a turn's span is found by rendering the turn with other texts.

Rendering every prefix of n turns costs n squared. So prefixes are rendered within a window of turns; the pieces they
add must make up the rendering of the whole conversation, and where they don't, all whole prefixes are rendered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

# The control strings of the template.
OPEN, ROLE_END, CLOSE, START = "[INST]", "[/INST]", "</s>", "<s>"
_CONTROL = re.compile(r"([<\[])(s>|/s>|INST\]|/INST\])")
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string."""
    return _CONTROL.sub(r"\1\\\2", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def inst_template(messages: list[Message]) -> str:
    """[INST] role [/INST] text </s> without blanks, role and text escaped."""
    return "".join([f"{OPEN}{escape(role)}{ROLE_END}{escape(text)}{CLOSE}" for role, text in messages])


def read_inst(formatted: str) -> list[Message]:
    """The turns, read back from what inst_template rendered."""
    turns = formatted.split(CLOSE)
    if turns.pop():
        raise ValueError("the last turn has no end")
    out = []
    for turn in turns:
        role, mark, text = turn.removeprefix(OPEN).partition(ROLE_END)
        if not turn.startswith(OPEN) or not mark:
            raise ValueError("a turn has no head")
        out.append((unescape(role), unescape(text)))
    return out


@dataclass
class Span:
    role: str
    start: int
    end: int
    text_start: int
    text_end: int


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def _turn(template: Template, before: list[Message], message: Message, prior: str) -> tuple[str, bool, int, int] | None:
    """What a turn adds to its prefix, whether it leaves the prefix alone, and where its text stands in that."""
    now = template([*before, message])
    kept = _common(prior, now)
    empty, a, b = (template([*before, (message[0], x)]) for x in ("", "a", "b"))
    head = _common(a, b)
    at = max(0, head - kept)
    return now, kept == len(prior), at, at + max(0, len(now) - len(empty))


def locate(template: Template, messages: list[Message], window: int = 16) -> tuple[str, list[Span], bool]:
    """(formatted, spans, rewrites): the whole rendering, each turn's span and its text's, in characters, and whether
    any prefix's rendering isn't the beginning of the next one's. A rewriting template's spans are where each prefix
    first differs from the one before."""
    whole = template(messages)
    for reach in (window, len(messages)):
        spans, pieces, at, rewrites, prior = [], [], 0, False, None
        for k, message in enumerate(messages):
            before = messages[max(0, k - reach) : k]
            prior = template(before) if prior is None or k > reach else prior
            now, calm, a, b = _turn(template, before, message, prior)
            kept = _common(prior, now)
            rewrites |= not calm
            piece = now[kept:]
            begin = at if reach < len(messages) else kept
            spans.append(Span(message[0], begin, begin + len(piece), begin + a, min(begin + b, begin + len(piece))))
            pieces.append(piece)
            at += len(piece)
            prior = now
        if "".join(pieces) == whole and not rewrites:
            return whole, spans, False
    return whole, spans, rewrites


def _digest(parts: list[str]) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode())
    return h.hexdigest()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Message]]]:
    """Conversations of sorted rows, one at a time."""
    own, held = None, []
    for b in batches:
        for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
            if held and c != own:
                yield own, held
                held = []
            own = c
            held.append((role or "", text or ""))
    if held:
        yield own, held


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")


def format_conversations(conversations: DataFrame, template: Template = inst_template, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss, rewrites_history) for each conversation of rows (conv_id, turn, role, text).

    Rows go by turn (null last), then role and text, so ties and repeated rows have a fixed order and each is a turn.
    A null role or text is empty; rows without conv_id are one conversation. loss: (start, end) in ``formatted`` of each
    text of ``loss_role``. A task streams its sorted rows and holds one conversation, which is one row of the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, messages in _conversations(batches):
            formatted, spans, rewrites = locate(template, messages)
            loss = [{"start": s.text_start, "end": s.text_end} for s in spans if s.role == loss_role]
            yield pa.RecordBatch.from_pylist([{"conv_id": own, "n_turns": len(messages), "formatted": formatted, "loss": loss, "rewrites_history": rewrites}], schema=arrow)

    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("rewrites_history", pa.bool_())])
    return _sorted(conversations).mapInArrow(run, "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>, rewrites_history boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read from the output alone: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, rewrites_history)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                turns = read_inst(r["formatted"])
                under = [unescape(r["formatted"][x["start"] : x["end"]]) for x in r["loss"]]
                rows.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": _digest([f"{role}\n{text}\n" for role, text in turns]), "loss_chars": sum(map(len, under)), "loss_sha256": _digest(under), "formatted_chars": len(r["formatted"]), "rewrites_history": r["rewrites_history"]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())])
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
