"""Exact token counts of every prefix, by dynamic programming over a BPE vocabulary.

In BPE the tokens of a text are valid exactly if each two neighbours stay apart when encoded alone: the first merge
across a boundary would otherwise have happened there too. So each prefix has one last token, the one that stays apart
from the last token of what precedes it, and its count is that prefix's count plus one. One pass over a text gives the
count of every prefix; budgets and truncations are then look-ups.

No token spans two neighbouring characters that stand together in no piece. Texts are cut there, and the counts of the
parts, most of which repeat, are remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices, texts

SPACE = "▁"


class PrefixCounter:
    """Counts for a sentencepiece BPE model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, model_file: str, remember: int = 800_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        if not sum(sp.is_byte(i) for i in range(n)):
            raise ValueError("the model has no byte fallback")
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        ends: dict[str, set[int]] = {}
        for p in self.score:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items()}  # lengths of the pieces that end so
        letters = sorted({c for p in self.score for c in p})
        self.code = np.zeros(0x110000, np.int32)  # 0: a character of no piece
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        pairs = {(ord(p[i]), ord(p[i + 1])) for p in self.score for i in range(len(p) - 1)}
        self.joined = np.zeros(self.width * self.width, bool)
        self.joined[[int(self.code[a]) * self.width + int(self.code[b]) for a, b in pairs]] = True
        self.apart: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes | tuple[int, ...]] = {}
        self.remember = remember
        for probe in ("", " ", "a", "  Is it\n\tthere? éê \U00010348\x00 <s>", "xx" * 40):
            if self.counts(probe)[-1] != len(sp.encode(probe)):
                raise ValueError("the model is not a BPE of the kind counted here")

    def _merged(self, text: str) -> list[str]:
        """The greedy merges of a short string: best score first, then leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, last: str, token: str) -> bool:
        key = (last, token)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > self.remember:
                self.apart.clear()
            found = self.apart[key] = self._merged(last + token) == ([last, token] if last else [token])
        return found

    def part(self, text: str) -> bytes | tuple[int, ...]:
        """Counts of the prefixes of 1, 2, ... characters of a part."""
        found = self.parts.get(text)
        if found is not None:
            return found
        if len(self.parts) > self.remember:
            self.parts.clear()
        score, ends, fits = self.score, self.ends, self._fits
        last, count = [""], [0]
        for i in range(1, len(text) + 1):
            for size in ends.get(text[i - 2 : i], ()) if i > 1 else ():
                if size <= i and (token := text[i - size : i]) in score and fits(last[i - size], token):
                    last.append(token)
                    count.append(count[i - size] + 1)
                    break
            else:  # the character alone; in bytes, if it is no piece
                token = text[i - 1]
                if not fits(last[i - 1], token):
                    raise AssertionError(f"no last token for {text[:i]!r}")
                last.append(token)
                count.append(count[i - 1] + (1 if token in score else len(token.encode("utf-8", "surrogatepass"))))
        self.parts[text] = out = bytes(count[1:]) if max(count) < 256 else tuple(count[1:])
        return out

    def cut(self, text: str) -> tuple[str, list[int]]:
        """The text as the model sees it, and where its parts begin and end."""
        seen = SPACE + text.replace(" ", SPACE)
        codes = self.code[np.frombuffer(seen.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return seen, [0, *(np.flatnonzero(~self.joined[codes[:-1] * self.width + codes[1:]]) + 1).tolist(), len(seen)]

    def counts(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text."""
        if not text:
            return np.zeros(1, np.int64)
        seen, edges = self.cut(text)
        out, base = [], 0
        for a, b in zip(edges, edges[1:], strict=False):
            inner = self.part(seen[a:b])
            out.extend([base + x for x in inner])
            base += inner[-1]
        return np.array([0, *out[1:]], np.int64)

    def total_and_fit(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of the text, and the characters of its longest prefix of at most ``limit`` tokens."""
        if not text:
            return 0, 0
        seen, edges = self.cut(text)
        get, parts = self.parts.get, []
        for a, b in zip(edges, edges[1:], strict=False):
            piece = seen[a:b]
            parts.append(get(piece) or self.part(piece))
        total = sum([p[-1] for p in parts])
        if total <= limit:
            return total, len(text)
        base = np.concatenate(([0], np.cumsum([p[-1] for p in parts])))
        k = int(np.searchsorted(base, limit, "right")) - 1
        while k >= 0:
            fits = [i for i, x in enumerate(parts[k]) if base[k] + x <= limit]
            if fits:
                return total, edges[k] + fits[-1]  # the dummy prefix is one character
            k -= 1
        return total, 0


def counter(model_file: str) -> PrefixCounter:
    return kept(("counter", model_file), lambda: PrefixCounter(model_file))


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, prefixes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars[, prefix_counts]) for every row of (doc_id, text, ...).

    A null text counts as empty: no bytes, no tokens. fit_chars: characters of the longest prefix of at most ``limit``
    tokens. prefix_counts (on request): little-endian 32-bit counts of every prefix, from the empty one. Repeated rows
    and null doc_ids have rows like others. No shuffle: a map over the scan.
    """
    fields = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_counts binary" * prefixes
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file)
        for b in slices(batches):
            values = [v or b"" for v in texts(b)]
            strings = [v.decode() for v in values]
            found = [count.total_and_fit(s, limit) for s in strings]
            columns = [b.column("doc_id"), pa.array([len(v) for v in values], pa.int64()), pa.array([t for t, _ in found], pa.int64()), pa.array([t > limit for t, _ in found]), pa.array([f for _, f in found], pa.int64())]
            if prefixes:
                columns.append(pa.array([count.counts(s).astype("<u4").tobytes() for s in strings], pa.binary()))
            yield pa.record_batch(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)
