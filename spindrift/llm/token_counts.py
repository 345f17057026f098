"""Token counts of a unigram vocabulary, by a Viterbi search that keeps only scores and counts."""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import batches

#: White space by Unicode, the mark of a word's start, the penalty of an unknown character.
WORDS = re.compile("[^\u0009-\u000d \u0085   -     　]+")
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000


def ranked_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a sentencepiece file in their order, each with a Zipf log-probability of its rank.

    No public unigram file is at hand; the order of the pieces is known, so rank i has weight 1/(i+1).
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    log_sum = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return [(p, -math.log(i + 1) - log_sum) for i, p in enumerate(pieces)]


class UnigramCounter:
    """Counts pieces of the best segmentation; equal scores go to the earlier start, runs of unknowns are one piece."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Piece count and score of one word (with its mark)."""
        n = len(word)
        score, count, open_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(word):
            ends[last + 1].append(match)
        for end in range(1, n + 1):
            best, start, single = -math.inf, -1, False
            for length, s in ends[end]:  # longest first, so the earlier start comes first
                value = s + score[end - length]
                single |= length == 1
                if value > best:
                    best, start = value, end - length
            unknown = False
            if not single and (value := self.unknown + score[end - 1]) > best:
                best, start, unknown = value, end - 1, True
            score[end], open_unknown[end] = best, unknown
            count[end] = count[start] + (0 if unknown and open_unknown[start] else 1)
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, int, float]:
        """Words, pieces and score of a text: words are split at white space and marked at their start."""
        words = WORDS.findall(text)
        cache = self.cache
        for w in set(words).difference(cache):
            marked = w if w.startswith(MARK) else MARK + w
            found = [self.word(p) for p in re.findall(f"{MARK}[^{MARK}]*", marked)]
            cache[w] = (sum(c for c, _ in found), sum(s for _, s in found))
        got = [cache[w] for w in words]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        return len(words), sum(c for c, _ in got), math.fsum(s for _, s in got)


@functools.cache
def counter(path: str) -> UnigramCounter:
    """The counter of a file's pieces, built once per Python process."""
    return UnigramCounter(ranked_pieces(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, score) per row of docs (doc_id, text); score is the best log-probability.

    Null or empty text: zeros. doc_id may be null or repeat; there is a row for each row. Other columns are ignored.
    """

    def run(stream):
        import pyarrow as pa

        c = counter(path)
        for batch in batches(stream, "text"):
            got = [c.text(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64())))], ["doc_id", "n_words", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, score double")
