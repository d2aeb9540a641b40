"""Token ids in files of fixed-width bit-packed blocks.

A file: 8 bytes of magic; blocks of BLOCK ids, each id in the least number of bits that holds the vocabulary, each
block beginning at a byte; then little-endian tables: block offsets (uint64, one more than blocks), document ids
(int64), their validity (uint8), document ends in ids (uint64); last six uint64: bits, ids, blocks, documents, where
the tables begin, and the magic. The tables stand at the end, so a file is written in one pass and bounded memory.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, fresh_folder, kept, partitions, slices, span_hashes, texts, written

MAGIC, BLOCK, FOOTER = b"TSBITS01", 1 << 15, 48


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Letters 1, digits 2, punctuation 3 of ASCII; the apostrophe, which may begin a part that letters end, is none of them.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[ord("'")] = 0


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
    return np.packbits(raw, bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids: eight bytes are read at each id's first byte, shifted and masked, all at once."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    wide = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    out = (wide[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7))) & np.uint64((1 << bits) - 1)
    return out.astype(np.uint32)


def _store(path: str):
    """A file system and the path in it: local or mounted folders, else what pyarrow knows by the address."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file; it appears under its name only when it is whole, so a repeated task does no harm."""

    def __init__(self, path: str, vocabulary: int):
        self.fs, self.path = _store(path)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out, self.bits = self.fs.open_output_stream(self.part), bits_for(vocabulary)
        self.out.write(MAGIC)
        self.offsets, self.at, self.n = [len(MAGIC)], len(MAGIC), 0
        self.held, self.n_held = [], 0
        self.docs, self.valid, self.ends = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError("an id is beyond the vocabulary")
        self.n += len(ids)
        self.docs.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.ends.append(self.n)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            data = pack(ids[i : min(i + BLOCK, end)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._blocks(True)
        for values, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.valid, "u1"), (self.ends, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(np.array([self.bits, self.n, len(self.offsets) - 1, len(self.docs), self.at], "<u8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    """Random access to a file: only its tables and the blocks asked for are read."""

    def __init__(self, path: str):
        fs, path = _store(path)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        tail = self.file.read_at(FOOTER, end - FOOTER)
        if tail[-8:] != MAGIC:
            raise ValueError("not a file of packed ids")
        self.bits, self.n, blocks, docs, at = (int(x) for x in np.frombuffer(tail[:-8], "<u8"))
        tables = self.file.read_at(end - FOOTER - at, at)
        cut = lambda kind, n, size: (np.frombuffer(tables[cut.at : cut.at + n * size], kind), setattr(cut, "at", cut.at + n * size))[0]
        cut.at = 0
        self.offsets, self.docs, self.valid, self.ends = cut("<u8", blocks + 1, 8).astype(np.int64), cut("<i8", docs, 8), cut("u1", docs, 1), cut("<u8", docs, 8).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (end - 1) // BLOCK + 1
        data = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        base = self.offsets[a]
        out = [unpack(data[int(self.offsets[k] - base) : int(self.offsets[k + 1] - base)], min(BLOCK, self.n - k * BLOCK), self.bits) for k in range(a, b)]
        return np.concatenate(out)[start - a * BLOCK : end - a * BLOCK]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


class Memo:
    """Runs of ids by the hash of a word: an open-addressed table that is looked up and filled with whole arrays. A word
    is told from others by its hash and by ``check``, its first eight bytes and its length."""

    def __init__(self, slot_bits: int):
        self.slot_bits = slot_bits
        self.clear()

    def clear(self) -> None:
        self.table, self.entry = np.zeros(1 << self.slot_bits, np.uint64), np.zeros(1 << self.slot_bits, np.int32)
        self.n = 0
        self.check, self.at = np.zeros(1024, np.uint64), np.zeros(1025, np.int64)
        self.ids = np.zeros(4096, np.uint32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def find(self, hashes: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Each word's entry, -1 where it has none."""
        out, slot, left = np.full(len(hashes), -1, np.int64), self._slots(hashes), np.arange(len(hashes))
        while len(left):
            seen, own = self.table[slot], hashes[left]
            hit = np.flatnonzero(seen == own)
            found = self.entry[slot[hit]]
            good = self.check[found] == check[left[hit]]
            out[left[hit[good]]] = found[good]
            go_on = seen != 0
            go_on[hit[good]] = False
            left, slot = left[go_on], (slot[go_on] + 1) & ((1 << self.slot_bits) - 1)
        return out

    def add(self, hashes: np.ndarray, check: np.ndarray, runs: list[np.ndarray]) -> None:
        """Words that aren't there yet, each once."""
        many, sizes = len(hashes), np.array([len(r) for r in runs], np.int64)
        ends = self.at[self.n] + np.cumsum(sizes)
        while self.n + many > len(self.check):
            self.check, self.at = np.append(self.check, np.zeros_like(self.check)), np.append(self.at, np.zeros(len(self.check), np.int64))
        if many and ends[-1] > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(len(self.ids), int(ends[-1]) - len(self.ids)), np.uint32))
        if many:
            self.ids[self.at[self.n] : ends[-1]] = np.concatenate(runs)
        self.check[self.n : self.n + many], self.at[self.n + 1 : self.n + many + 1] = check, ends
        slot, left = self._slots(hashes), np.arange(many)
        while len(left):
            free = np.flatnonzero(self.table[slot] == 0)
            own, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.table[own], self.entry[own] = hashes[left[put]], self.n + left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.slot_bits) - 1)
        self.n += many

    def runs(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries, one after another, and how many each has."""
        sizes = self.at[entries + 1] - self.at[entries]
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(self.at[entries] - before, sizes) + np.arange(int(sizes.sum()))], sizes


_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Encoder:
    """The library's ids of a text, part by part. This vocabulary drops white space and case, and joins no ASCII letter,
    digit or punctuation mark with one of another kind, nor digits (but for apostrophes); what stands between such places
    is encoded by the library once while it is remembered, and looked up after that. Texts with an opening ``<|`` go to the library whole: special strings have one."""

    def __init__(self, path: str, remember: int = 1 << 21):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.remember = remember
        self.known = Memo((2 * remember - 1).bit_length())
        bar = self._whole("|")
        self.bar = bar[0] if len(bar) == 1 else None
        for probe in ("a b", "It's  A,b.c\n<|endoftext|> é, x!? <|ENDOFTEXT|>", " \u0301a \n", "KI\u0307 A\u0301, 5.5;x:!y's.", "a|b || c |,", "x1-y's 22'll ''s$a'm"):
            if self._whole(probe) != self.encode([probe.encode()])[0].tolist():
                raise ValueError("this vocabulary has tokens across white space, case or punctuation")

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new(self, words: list[str]) -> list[np.ndarray]:
        """The ids of words, many in one text with a bar between them; a word that has a bar itself goes alone."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if "|" not in w] if self.bar is not None else []
        for k in range(0, len(plain), 512):
            some = plain[k : k + 512]
            ids = np.array(self._whole(" | ".join([words[i] for i in some])), np.uint32)
            bars = np.flatnonzero(ids == self.bar).tolist()
            if len(bars) == len(some) - 1:
                for i, begin, end in zip(some, [0, *[x + 1 for x in bars]], [*bars, len(ids)], strict=True):
                    out[i] = ids[begin:end]
        alone = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([words[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def encode(self, values: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, of UTF-8 bytes."""
        if self.known.n > self.remember:
            self.known.clear()
        special = {i: np.array(self._whole(v.decode()), np.uint32) for i, v in enumerate(values) if b"<|" in v}
        raw = b"\n".join([b"" if i in special else v for i, v in enumerate(values)]).translate(_LOWER) + b"\n" + bytes(8)
        data = np.frombuffer(raw, np.uint8)[:-8]
        lengths = np.array([0 if i in special else len(v) for i, v in enumerate(values)], np.int64)
        within = (data != 0x20) & (data != 0x0A)
        begins, edge = within.copy(), ~within
        kind = _KIND[data]
        begins[1:] &= ~within[:-1] | ((kind[1:] != 0) & (kind[:-1] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2)))
        edge[1:] &= within[:-1]
        edge[0] = False
        at = np.flatnonzero(begins | edge)
        is_begin = begins[at]
        starts, ends = at[is_begin], at[1:][is_begin[:-1]]
        hashes = np.maximum(span_hashes(data, starts, ends), np.uint64(1))
        wide = np.ndarray((len(data),), "<u8", raw, 0, (1,))
        check = (wide[starts] & _HEAD[np.minimum(ends - starts, 8)]) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        entries = self.known.find(hashes, check)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            first = np.unique(hashes[missing] ^ (check[missing] << np.uint64(1)), return_index=True)[1]
            new = missing[first]
            self.known.add(hashes[new], check[new], self._new([raw[s:e].decode() for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]))
            entries[missing] = self.known.find(hashes[missing], check[missing])
        ids, sizes = self.known.runs(entries)
        first_byte = np.cumsum(lengths + 1) - lengths - 1
        first_id = np.append(0, np.cumsum(sizes))[np.append(np.searchsorted(starts, first_byte), len(starts))]
        return [special[i] if i in special else ids[first_id[i] : first_id[i + 1]] for i in range(len(values))]


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str, files: int) -> DataFrame:
    """Encodes (doc_id, text, ...) and writes ``files`` files in ascending doc_id order (nulls first, then by text).

    Returns the manifest: (file, path, n_ids, n_docs). A null text is empty and has the end id alone. Rows are
    range-partitioned by doc_id and text, so one doc_id on many rows is no hot spot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        path = f"{folder}/ids-{k:06d}.tsb"
        out = Writer(path, max(enc.size, end_id + 1))
        end = np.array([end_id], np.uint32)
        for b in slices(batches):
            ids = enc.encode([v or b"" for v in texts(b)])
            for d, x in zip(b.column("doc_id").to_pylist(), ids, strict=True):
                out.add(d, np.concatenate([x, end]))
        out.close()
        yield pa.record_batch([pa.array([k], pa.int64()), pa.array([path]), pa.array([out.n], pa.int64()), pa.array([len(out.docs)], pa.int64())], ["file", "path", "n_ids", "n_docs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return written(ordered.mapInArrow(run, "file long, path string, n_ids long, n_docs long"), "manifest")


def read_ids(manifest: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for path, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                r = Reader(path)
                begins = np.concatenate(([0], r.ends[:-1])).astype(np.int64) if len(r.ends) else r.ends
                i = 0
                while i < len(r.docs):
                    j = max(i + 1, int(np.searchsorted(r.ends, begins[i] + at_once, "right")))
                    ids = r.ids(int(begins[i]), int(r.ends[j - 1])).astype("<u4")
                    crcs = [zlib.crc32(ids[begins[k] - begins[i] : r.ends[k] - begins[i]].tobytes()) for k in range(i, j)]
                    yield pa.record_batch([pa.array(r.docs[i:j], pa.int64(), mask=r.valid[i:j] == 0), pa.array(begins[i:j] + before), pa.array(r.ends[i:j] - begins[i:j]), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    dealt = placed.select("file", "path", "before").repartition(partitions(manifest.sparkSession), "file")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    return read_ids(write_ids(docs, tokenizer, end_id, folder or fresh_folder(spark, "ids"), partitions(spark)))
