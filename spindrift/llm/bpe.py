"""Byte-level BPE: encoding and decoding of whole texts, equal to the public tokenizer file's own library."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

from spindrift.llm.common import batches, short_batches

#: Letters and numbers of Unicode 16 that Python's 15.1 tables lack, as inclusive ranges.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Fixed value: Unicode white space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _class(major: str, more: tuple[tuple[int, int], ...], top: int) -> str:
    """The inside of a character class with every code point below top of a major category.

    Built from the interpreter's tables: the regex library's differ on unassigned code points.
    """
    added = {i for a, b in more for i in range(a, b + 1)}
    flags = np.fromiter((i in added or unicodedata.category(chr(i))[0] == major for i in range(top)), bool, top)
    edges = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))


@functools.cache
def word_pattern(top: int = 0x110000) -> re.Pattern:
    """The split of a text into words before merging, for code points below top (a smaller class is faster)."""
    letter, number = _class("L", NEW_LETTERS, top), _class("N", NEW_NUMBERS, top)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


NONE = np.int32(2**31 - 1)
#: Words up to this many bytes take the contiguous rank array, longer ones the heap.
SHORT = 256
#: Words whose ids are remembered; cells of the arrays in which words are merged together. They bound a worker's memory.
CACHE_WORDS, CELLS = 300_000, 100_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next unused from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class ByteBpe:
    """Vocabulary, ranked merges and special tokens of a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.specials.items()}
        self.byte_id = np.array([vocab[c] for c in alphabet], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.int64(2**62)), np.append(order.astype(np.int32), NONE)
        self.patterns = word_pattern(0x10000), word_pattern()
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.cache: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbouring parts, NONE if they don't merge."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of similar length, as little-endian bytes.

        Each word is a row of part ids beside a row of the ranks of adjacent parts. Again and again the leftmost
        minimum of the ranks names a boundary; it is deleted, the rest moves up, and the two ranks beside it are
        looked up anew. Rows leave when no rank is left.
        """
        n, width = len(words), max(map(len, words)) + 1
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = self.byte_id[raw]
        live = np.arange(width - 1) < (size - 1)[:, None]
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1][live] = self.rank(ids[:, :-1][live], ids[:, 1:][live])
        out_ids, out_size = ids.copy(), size.copy()
        row = np.arange(n)
        column = np.arange(width)
        while len(row):
            at = ranks.argmin(axis=1)
            k = np.arange(len(row))
            best = ranks[k, at]
            done = best == NONE
            if done.any():
                out_ids[row[done]], out_size[row[done]] = ids[done], size[done]
                keep = ~done
                row, ids, ranks, size, at, best = row[keep], ids[keep], ranks[keep], size[keep], at[keep], best[keep]
                if not len(row):
                    break
                k = np.arange(len(row))
            ids[k, at] = self.merged[best]
            shift = np.minimum(column + (column > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, 1)
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= at[:, None]), width - 1), 1)
            size = size - 1
            ranks[:, -1] = NONE
            ok = at < size - 1
            ranks[k[~ok], at[~ok]] = NONE
            ranks[k[ok], at[ok]] = self.rank(ids[k[ok], at[ok]], ids[k[ok], at[ok] + 1])
            ok = at > 0
            ranks[k[ok], at[ok] - 1] = self.rank(ids[k[ok], at[ok] - 1], ids[k[ok], at[ok]])
        packed = out_ids.astype("<u4")
        return [packed[i, :s].tobytes() for i, s in enumerate(out_size)]

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one long word, by a heap over a linked list: time stays near-linear in its length."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)]
        n = len(ids)
        first = self.rank(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        ids = ids.tolist()
        table = self._table()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = first.tolist() + [int(NONE)]
        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            j = after[i]
            ids[i], now[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left < 0:
                    continue
                now[left] = table.get(ids[left] << 20 | ids[after[left]], int(NONE)) if after[left] < n else int(NONE)
                if now[left] != NONE:
                    heapq.heappush(heap, (now[left], left))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    @functools.cache
    def _table(self) -> dict[int, int]:
        return dict(zip(self.keys[:-1].tolist(), self.ranks[:-1].tolist()))

    def learn(self, words: set[str]) -> None:
        """Add words to the cache; short ones are merged together with others of their size."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) > SHORT:
                self.cache[w] = self.merge_long(raw)
            else:
                by_size.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for size, group in by_size.items():
            step = max(64, CELLS // size)
            for a in range(0, len(group), step):
                part = group[a : a + step]
                self.cache.update(zip((w for w, _ in part), self.merge_short([r for _, r in part])))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        parts = []
        new: set[str] = set()
        for text in texts:
            chunks = self.split.split(text) if self.split and any(t in text for t in self.specials) else [text]
            findall = self.patterns[len(text.encode("utf-16-le")) != 2 * len(text)].findall
            found = [c if i % 2 else findall(c) for i, c in enumerate(chunks)]
            for words in found[::2]:
                new.update(set(words).difference(self.cache))
            parts.append(found)
        self.learn(new)
        get = self.cache.__getitem__
        return [b"".join(self.specials[c].to_bytes(4, "little") if i % 2 else b"".join(map(get, c)) for i, c in enumerate(found)) for found in parts]

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids; bytes that are no UTF-8 become replacement characters, unknown ids nothing."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.cache
def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a file, loaded once per Python process."""
    return ByteBpe(path)


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>), special-token strings as their ids. Null text: no ids.

    Every other column stays as it is, whatever its name; a column called ids is replaced.
    """
    return _with(docs, text, ids, ArrayType(IntegerType()), functools.partial(_encode_column, path))


def decoded(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the text of their token ids; null ids: empty text, null or unknown ids in the array: nothing."""
    return _with(docs, ids, text, StringType(), functools.partial(_decode_column, path))


def _with(docs: DataFrame, source: str, target: str, kind: DataType, make) -> DataFrame:
    short_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != target]
    order = [f.name for f in kept]
    schema = StructType([*kept]).add(target, kind)

    def run(stream):
        import pyarrow as pa

        for batch in batches(stream, source) if kind != StringType() else stream:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in order), make(batch.column(source))], [*order, target])

    return docs.mapInArrow(run, schema)


def _lists(found: list[bytes]):
    """An Arrow array of lists of 32-bit integers from their bytes."""
    import pyarrow as pa

    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(b) // 4 for b in found], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), "<i4")))


def _encode_column(path: str, column):
    return _lists(tokenizer(path).encode_all([x or "" for x in column.to_pylist()]))


def _decode_column(path: str, column):
    import pyarrow as pa

    t = tokenizer(path)
    return pa.array([t.decode(np.array([i for i in x or () if i is not None], "<u4").tobytes()) for x in column.to_pylist()], pa.string())


def round_trips(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of docs (doc_id, text): encode, decode, digest; with ids, these too (array<int>).

    Null text: as empty. doc_id may be null or repeat; there is a row for each row. Other columns are ignored. One
    Python worker does both directions, so that ids don't travel between two.
    """
    short_batches(docs.sparkSession)

    def run(stream):
        import pyarrow as pa

        t = tokenizer(path)
        for batch in batches(stream, "text"):
            found = t.encode_all([x or "" for x in batch.column("text").to_pylist()])
            back = [hashlib.sha256(t.decode(b).encode()).hexdigest() for b in found]
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(b) // 4 for b in found], pa.int64()), "ids_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in found]), "decoded_sha256": pa.array(back)}
            yield pa.RecordBatch.from_pydict(out | ({"ids": _lists(found)} if ids else {}))

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)
