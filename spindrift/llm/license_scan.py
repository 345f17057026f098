"""License mentions: exact phrases, and short notices with a bounded number of errors."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import batches

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices that are also found with errors.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: One error is allowed for each so many characters of a notice.
CHARS_PER_ERROR = 12


class Span(NamedTuple):
    label: str
    first_word: int
    last_word: int
    errors: int
    chars: int


def _words_to_spaces() -> bytes:
    table = bytearray(b" " * 256)
    for a, b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[a : b + 1] = range(a, b + 1)
    table[0x41:0x5B] = range(0x61, 0x7B)
    return bytes(table)


TABLE = _words_to_spaces()


def normal(text: str) -> tuple[bytes, int]:
    """Words of a text (A-Z lowered), each between single spaces, and their number."""
    words = text.encode("utf-8", "surrogatepass").translate(TABLE).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" ", len(words)


def places(words: bytes, phrase: bytes):
    """Byte offsets at which the phrase's words stand, overlapping ones included."""
    at = words.find(phrase)
    while at >= 0:
        yield at
        at = words.find(phrase, at + 1)


class FuzzyNotice:
    """One notice with at most k errors: of k+1 pieces one must stand unchanged, which names the candidates."""

    def __init__(self, notice: str, label: str, errors: int) -> None:
        import regex

        self.label, self.errors, self.text = label, errors, notice
        cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
        self.seeds = [(notice[a:b].encode(), a) for a, b in zip(cuts, cuts[1:])]
        # best match within the errors, from the start of a word to the end of one
        self.pattern = regex.compile(f"(?b)(?<= )(?:{regex.escape(notice)}){{e<={errors}}}(?= )".encode())

    def find(self, words: bytes) -> list[tuple[int, int, int]]:
        """(start, end, errors) of matches in the normal words, not overlapping each other."""
        spans = []
        for seed, offset in self.seeds:
            for at in places(words, seed):
                spans.append((max(0, at - offset - self.errors - 1), at - offset + len(self.text) + self.errors + 1))
        found: list[tuple[int, int, int]] = []
        end = -1
        for a, b in sorted(set(spans)):
            if b <= end:
                continue
            m = self.pattern.search(words, max(a, end), min(b, len(words)))
            if m:
                found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                end = m.end()
        return found


@functools.cache
def notices(items: tuple[tuple[str, str], ...], chars_per_error: int) -> list[FuzzyNotice]:
    return [FuzzyNotice(n, label, len(n) // chars_per_error) for n, label in items]


def scan(text: str, phrases: dict[str, str], fuzzy: list[FuzzyNotice]) -> tuple[int, list[Span], list[Span]]:
    """Number of words, exact places, fuzzy places (those with errors too) of one text."""
    words, n = normal(text)
    exact = [Span(label, w := words.count(b" ", 0, at + 1) - 1, w + p.count(" "), 0, len(p)) for p, label in phrases.items() for at in places(words, f" {p} ".encode())]
    near = []
    for notice in fuzzy:
        for a, b, e in notice.find(words):
            w = words.count(b" ", 0, a) - 1
            near.append(Span(notice.label, w, w + words.count(b" ", a, b), e, len(notice.text)))
    return n, exact, near


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, notice_labels: dict[str, str] | None = None, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of the phrases, overlapping ones too; first_word and last_word are the smallest and
    largest start among them (null if none). labels has those of the notices found with errors as well. score is 1
    for an exact phrase, else the best share of a notice's characters that stand without error, else 0. spans lists
    label:first_word:last_word:errors of every place, by place. Null text: as empty. There is a row for each row.
    """
    phrases = PHRASES if phrases is None else phrases
    items = tuple((NOTICES if notice_labels is None else notice_labels).items())

    def run(stream):
        import pyarrow as pa

        fuzzy = notices(items, chars_per_error)
        for batch in batches(stream, "text"):
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column("text").to_pylist():
                n, exact, near = scan(text or "", phrases, fuzzy)
                starts = [s.first_word for s in exact]
                base = {s.label for s in exact}
                score = 1.0 if exact else max((1 - s.errors / s.chars for s in near), default=0.0)
                spans = sorted(set(exact + near), key=lambda s: (s.first_word, s.last_word, s.label, s.errors))
                row = (n, len(exact), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s.label for s in near})), score, ",".join(f"{s.label}:{s.first_word}:{s.last_word}:{s.errors}" for s in spans))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out, kinds)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
