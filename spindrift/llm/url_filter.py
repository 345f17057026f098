"""URL rules by a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many rules travel with a task at a time; more are swept one portion after the other.
PORTION = 200_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: str) -> str:
    """Labels from the top level down, each closed by a dot: a host and its subdomains are the keys from it on."""
    return "".join(f"{x}." for x in reversed(host.split(".")))


class RuleSweep:
    """Rules met in the order of their keys, with a stack of those whose interval holds the current key."""

    def __init__(self, rules: list[Rule]) -> None:
        by_host: dict[str, dict[str, Rule]] = {}
        for r in rules:
            same = by_host.setdefault(host_key(r.host), {})
            # of rules for one path that differ, block and then the greater
            same[r.path] = max(r, same.get(r.path, r), key=self.rank)
        self.keys = sorted(by_host)
        self.rules = by_host
        self.lengths = {k: sorted({len(p) for p in paths}, reverse=True) for k, paths in by_host.items()}
        self.stack: list[str] = []
        self.next = 0

    @staticmethod
    def rank(r: Rule):
        return len(r.host) + len(r.path), len(r.host), r.verdict == "block", r

    def seek(self, key: str) -> None:
        """Start at key: the rules of its own interval chain are the active ones."""
        self.next = bisect_right(self.keys, key)
        parts = [i + 1 for i, c in enumerate(key) if c == "."]
        self.stack = [key[:i] for i in parts if key[:i] in self.rules]

    def advance(self, key: str) -> None:
        """Move to a key that is not smaller: enter the intervals that begin by then, leave those that have ended."""
        while self.next < len(self.keys) and self.keys[self.next] <= key:
            new = self.keys[self.next]
            while self.stack and not new.startswith(self.stack[-1]):
                self.stack.pop()
            self.stack.append(new)
            self.next += 1
        while self.stack and not key.startswith(self.stack[-1]):
            self.stack.pop()

    def best(self, path: str) -> Rule | None:
        """The longest active rule whose path begins this one; of equal length the longer host, then block.

        Of a host only the longest path that begins this one can win; it is looked up by length.
        """
        fit = (next((self.rules[k][path[:n]] for n in self.lengths[k] if n <= len(path) and path[:n] in self.rules[k]), None) for k in self.stack)
        return max((r for r in fit if r is not None), key=self.rank, default=None)


def judged(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of pages (page_id, url).

    A rule fits its host and all subdomains if the path begins with the rule's; the longest (host and path
    together) wins. No rule: rule is null and the verdict is default. Null url or one without :// has empty host
    and path, which only a rule with empty host could fit. Other columns are ignored; each row gives a row.

    Rows are dealt by ranges of (reversed host, path, page_id), so one host is spread over as many tasks as it
    needs, and each range is swept once (for each PORTION of the rules, keeping the better one); the sweep seeks the
    rules that are active where its range begins. A repeated or null page_id gives a row each time.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", F.concat_ws("", F.transform(F.reverse(F.split("host", r"\.")), lambda x: F.concat(x, F.lit(".")))))

    def swept(portion: list[Rule]):
        def run(stream):
            import pyarrow as pa

            sweep, begun = RuleSweep(portion), False
            for batch in stream:
                found = []
                for key, p, *old in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "r_host", "r_path", "r_verdict"))):
                    if not begun:
                        sweep.seek(key)
                        begun = True
                    sweep.advance(key)
                    r = sweep.best(p)
                    if old[0] is not None and (r is None or RuleSweep.rank(Rule(*old)) > RuleSweep.rank(r)):
                        r = Rule(*old)
                    found.append(r or (None, None, None))
                columns = [pa.array(c, pa.string()) for c in zip(*found)] if found else [pa.array([], pa.string())] * 3
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "key")), *columns], ["page_id", "host", "path", "key", "r_host", "r_path", "r_verdict"])

        return run

    none = F.lit(None).cast("string")
    dealt = rows.repartitionByRange("key", "path", "page_id").sortWithinPartitions("key").withColumns({c: none for c in ("r_host", "r_path", "r_verdict")})
    for a in range(0, max(1, len(rules)), PORTION):
        dealt = dealt.mapInArrow(swept(rules[a : a + PORTION]), "page_id long, host string, path string, key string, r_host string, r_path string, r_verdict string")
    return dealt.select("page_id", "host", "path", F.concat("r_host", "r_path").alias("rule"), F.coalesce("r_verdict", F.lit(default)).alias("verdict"))
