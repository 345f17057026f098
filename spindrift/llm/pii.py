"""Personal data: exact formats, and further candidates judged by boosted trees. DataFrame functions only.

The trees are learnt on the driver, on seeded synthetic candidates, before any plan is built; they are applied as
SQL expressions.
"""

from __future__ import annotations

import functools
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base formats in their order. Possessive and anchored forms match the same places as the plain ones
#: (a failing start inside a run can't succeed later in it), in linear time and without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of 12 to 19 digits; shorter and longer ones are matches that fail.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: Generators of further candidates: many, also overlapping.
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{16,}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "birth": r"(?<![0-9/.-])(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9/.-])",
    "account": CARD,
}
KINDS = (*BASE, *GENERATORS)
#: Words before a candidate that speak for it.
CONTEXT = {
    "ctx_secret": "token|secret|passw|api|key|auth|bearer",
    "ctx_id": "ssn|social security|passport|identity",
    "ctx_bank": "iban|bank|account|card|visa|konto|compte|cuenta",
    "ctx_birth": "born|birth|dob|geboren|naissance|nacimiento",
    "ctx_neutral": "version|sha|commit|hash|checksum|isbn|order|build|uuid|published|updated",
}
WINDOW = 32
#: Code points of a block of a text, from which contexts and kept stretches are cut.
BLOCK = 4096
FEATURES = (*(f"is_{k}" for k in GENERATORS), "length", "digits", "digits_only", "hex_only", "upper", "lower", "luhn", *CONTEXT)
TREES, DEPTH, SHRINK, PRECISION = 32, 3, 0.4, 0.99


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, 1).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def running(values: str, block: int = 64, highest: bool = False) -> Column:
    """Sums (or the highest, at least 0) of all values of an array column before each position, in blocks, so that long arrays aren't copied for every element."""
    none = F.array().cast("array<int>")
    n = F.size(values)
    join = (lambda a, b: F.greatest(a, b)) if highest else (lambda a, b: a + b)
    starts = F.sequence(F.lit(1), n, F.lit(block))
    total = lambda a: F.aggregate(a, F.lit(0), join)
    sums = F.transform(starts, lambda s: total(F.slice(values, s, F.lit(block))))
    prefix = lambda a: F.aggregate(a, F.struct(F.lit(0).alias("s"), none.alias("o")), lambda acc, x: F.struct(join(acc["s"], x).alias("s"), F.concat(acc["o"], F.array(acc["s"])).alias("o")))["o"]
    parts = F.zip_with(starts, prefix(sums), lambda s, before: F.transform(prefix(F.slice(values, s, F.lit(block))), lambda x: join(x, before)))
    return F.when(n > 0, F.flatten(parts)).otherwise(none)


def cut(blocks: Column, start: Column, length: Column) -> Column:
    """length code points from start (from 0) of a text that stands in blocks of BLOCK, without a walk from its first one."""
    size, first = F.lit(BLOCK), F.floor(start / BLOCK).cast("int")
    last = F.floor((start + length - 1) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), ""), start % size + 1, length)


def with_matches(docs: DataFrame, patterns: dict[str, str], where: dict[str, Column]) -> DataFrame:
    """docs with _kind per pattern: array<struct(start, end, part)> of its matches in text, in code points, end exclusive.

    What stands between the matches comes from splitting the text at the same places. Each step is a column of its
    own, so that no pattern is searched twice. where: a cheap condition without which a kind has no matches.
    """
    none = F.array().cast("array<string>")
    found = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()}
    docs = docs.withColumns({f"_f_{k}": F.when(where[k], c).otherwise(none) if k in where else c for k, c in found.items()})
    between = {k: F.slice(F.split("text", p, -1), F.lit(1), F.size(f"_f_{k}")) for k, p in patterns.items()}
    steps = {k: F.zip_with(c, f"_f_{k}", lambda a, b: F.length(a) + F.length(b)) for k, c in between.items()}
    docs = docs.withColumns({f"_s_{k}": F.when(F.size(f"_f_{k}") > 0, c).otherwise(F.array().cast("array<int>")) for k, c in steps.items()})
    ends = {k: F.zip_with(running(f"_s_{k}"), f"_s_{k}", lambda a, b: a + b) for k in patterns}
    span = lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("part"))
    docs = docs.withColumns({f"_{k}": F.zip_with(c, f"_f_{k}", span) for k, c in ends.items()})
    return docs.drop(*(f"_{x}_{k}" for x in "fs" for k in patterns))


def synthetic(seed: int = 5, each: int = 500) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Features, labels, kinds and rounds of made-up candidates: private ones with and without context, and lookalikes."""
    rng = random.Random(seed)
    rows, labels, kinds, rounds = [], [], [], []

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def add(kind: str, part: str, context: str, label: int) -> None:
        found = plain_features(kind, part, context)
        rows.append([found[f] for f in FEATURES])
        labels.append(label)
        kinds.append(kind)
        rounds.append(turn)

    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(n))
    for turn in range(each):
        add("secret", rng.choice((hexa, mixed))(rng.choice((20, 24, 32, 40, 64))), rng.choice(("token = ", "api key: ", "secret ", "password=", "auth bearer ")), 1)
        add("secret", mixed(rng.randint(24, 64)), rng.choice(("", "with ")), 1)
        add("secret", rng.choice((hexa(40), hexa(64), digits(20))), rng.choice(("commit ", "sha ", "checksum ", "hash ")), 0)
        add("secret", "".join(rng.choice(("the", "and", "word", "section", "chapter")) for _ in range(5)) + digits(rng.randint(1, 2)), "", 0)
        add("secret", digits(rng.randint(16, 32)), rng.choice(("token = ", "api key: ", "secret ", "password=")), 1)
        add("secret", digits(rng.randint(16, 32)), rng.choice(("", "with ", "number ", "order ", "version ")), 0)
        add("ssn", f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", rng.choice(("ssn ", "social security ", "", "")), 1)
        add("ssn", f"{rng.randint(0, 999):03d}-{rng.randint(0, 99):02d}-{rng.randint(0, 9999):04d}", rng.choice(("isbn ", "order ", "build ")), 0)
        add("iban", rng.choice(("DE", "FR", "ES", "GB")) + digits(rng.choice((18, 20, 22))), rng.choice(("iban ", "bank ", "")), 1)
        add("iban", "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(2)) + digits(10), rng.choice(("version ", "order ", "build ")), 0)
        add("birth", f"{rng.randint(1930, 2010)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", rng.choice(("born ", "dob ", "date of birth ")), 1)
        add("birth", f"{rng.randint(1930, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", rng.choice(("updated ", "published ", "", "on ")), 0)
        add("account", digits(16), rng.choice(("card ", "account ", "visa ")), 1)
        add("account", digits(rng.choice((12, 13, 14, 16, 16, 17, 18))), rng.choice(("isbn ", "order ", "version ", "")), 0)
    return np.array(rows, float), np.array(labels), kinds, np.array(rounds)


def plain_features(kind: str, part: str, context: str) -> dict[str, float]:
    """The features of one candidate, as the SQL expressions give them."""
    d = [int(c) for c in part if c.isdigit()]
    check = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
    only = all(c in "0123456789abcdefABCDEF" for c in part)
    out = {f"is_{k}": float(k == kind) for k in GENERATORS}
    out |= {"length": len(part), "digits": len(d) / max(1, len(part)), "digits_only": float(len(d) == len(part)), "hex_only": float(only), "upper": float(any("A" <= c <= "Z" for c in part)), "lower": float(any("a" <= c <= "z" for c in part)), "luhn": float(check and bool(d))}
    return out | {k: float(any(w in context.lower() for w in words.split("|"))) for k, words in CONTEXT.items()}


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int):
    """A regression tree on the logistic loss: (feature, cut, left, right), or a leaf's value."""
    leaf = -gradient.sum() / (hessian.sum() + 1.0)
    if depth == 0:
        return leaf
    best = (1e-6, None, None)
    whole = gradient.sum() ** 2 / (hessian.sum() + 1)
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)))[:-1]:
            left = x[:, f] <= cut
            g, h = gradient[left].sum(), hessian[left].sum()
            gain = g * g / (h + 1) + (gradient.sum() - g) ** 2 / (hessian.sum() - h + 1) - whole
            if gain > best[0]:
                best = (gain, f, float(cut))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], gradient[left], hessian[left], depth - 1), grow(x[~left], gradient[~left], hessian[~left], depth - 1)


def value(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@functools.cache
def model() -> tuple[list, dict[str, float]]:
    """Boosted trees, and per kind the least log-odds, none below an even chance, that keeps PRECISION on candidates held out of training."""
    x, y, kinds, rounds = synthetic()
    train = rounds % 3 < 2
    odds = np.zeros(len(y))
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        tree = grow(x[train], (p - y)[train], (p * (1 - p))[train], DEPTH)
        trees.append(tree)
        odds += SHRINK * np.array([value(tree, r) for r in x])
    cuts = {}
    for kind in GENERATORS:
        own = ~train & (np.array(kinds) == kind)
        good = [c for c in np.unique(odds[own]) if c >= 0 and y[own][odds[own] >= c].mean() >= PRECISION]
        cuts[kind] = float(min(good, default=math.inf)) - 1e-9
    return trees, cuts


def judged(kind: str, candidates: str) -> Column:
    """The candidates of a kind, an array column with their features, that the trees keep: (start, end, ord).

    The trees are SQL text over the features; what the kind decides is decided here.
    """

    def expression(tree) -> str:
        if not isinstance(tree, tuple):
            return f"{float(SHRINK * tree)!r}D"
        name, cut, left, right = tree
        if FEATURES[name].startswith("is_"):
            return expression(left if float(FEATURES[name] == f"is_{kind}") <= cut else right)
        return f"IF(c.{FEATURES[name]} <= {cut!r}D, {expression(left)}, {expression(right)})"

    trees, cuts = model()
    odds = " + ".join(map(expression, trees))
    least = "double('infinity')" if math.isinf(cuts[kind]) else f"{cuts[kind]!r}D"
    span = f"named_struct('start', c.start, 'end', c.end, 'ord', {KINDS.index(kind)})"
    return F.expr(f"transform(filter({candidates}, c -> {odds} >= {least}), c -> {span})")


def column_features(part: Column, context: Column) -> dict[str, Column]:
    digits = F.regexp_replace(part, "[^0-9]", "")
    yes = lambda c: c.cast("double")
    out = {"length": F.length(part).cast("double"), "digits": F.length(digits) / F.greatest(F.length(part), F.lit(1)), "digits_only": yes(F.length(digits) == F.length(part)), "hex_only": yes(~part.rlike("[^0-9a-fA-F]")), "upper": yes(part.rlike("[A-Z]")), "lower": yes(part.rlike("[a-z]")), "luhn": yes(luhn(digits))}
    return out | {k: yes(context.rlike(f"(?i){words}")) for k, words in CONTEXT.items()}


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs with _kind per base kind, the array of (start, end, ord) in text, ord being the kind's place in KINDS, and per other kind its candidates.

    Candidates are (start, end, features): the features are worked out once for each, as the trees read them many times.
    """
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE} | GENERATORS
    docs = with_matches(docs, patterns, {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))})
    digits = lambda s: F.regexp_replace(s["part"], "[^0-9]", "")
    good = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.forall(F.split(s["part"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").cast("decimal(38,0)") <= 255),
        "card": lambda s: luhn(digits(s)),
        "phone": lambda s: F.length(digits(s)).between(9, 15),
    }

    def features(s: Column) -> Column:
        context = cut(F.col("_blocks"), F.greatest(s["start"] - WINDOW, F.lit(0)), F.least(s["start"], F.lit(WINDOW)))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), *(c.alias(k) for k, c in column_features(s["part"], context).items()))

    def kept(kind: str) -> Column:
        return F.transform(F.filter(f"_{kind}", good[kind]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("ord")))

    return docs.withColumns({f"_{k}": kept(k) for k in BASE} | {f"_{k}": F.transform(f"_{k}", features) for k in GENERATORS})


def with_free(docs: DataFrame, candidates: str, taken: str) -> DataFrame:
    """docs with the candidates that overlap none of the taken spans added to these, by one sweep over both.

    Taken spans are met at their starts, candidates at their ends: by then every taken span that begins before the
    candidate's end has been met, and none overlaps it if the furthest end so far is no further than its start.
    """
    met = F.array_sort(F.concat(
        F.transform(taken, lambda t: F.struct(t["start"].alias("at"), F.lit(1).alias("taken"), t["start"].alias("start"), t["end"].alias("end"), t["ord"].alias("ord"))),
        F.transform(candidates, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("taken"), c["start"].alias("start"), c["end"].alias("end"), c["ord"].alias("ord"))),
    ))
    empty = (F.size(candidates) == 0) | (F.size(taken) == 0)
    docs = docs.withColumn("_met", F.when(~empty, met))
    docs = docs.withColumn("_reach", F.transform("_met", lambda x: F.when(x["taken"] == 1, x["end"]).otherwise(0)))
    reach = running("_reach", highest=True)
    clear = F.filter(F.zip_with("_met", reach, lambda x, r: F.when((x["taken"] == 0) & (r <= x["start"]), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["ord"].alias("ord")))), lambda x: x.isNotNull())
    return docs.withColumn(taken, F.concat(taken, F.when(~empty, clear).otherwise(F.col(candidates)))).drop("_met", "_reach")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text, _blocks, _base, _all, ...): the rows of docs as structs, with arrays of (start, end, ord) by start, then kind.

    Base spans all stay, overlapping ones of different kinds too; a span of the trees is left out where it overlaps
    a base span or a span of a kind listed before it.
    """
    found = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = with_candidates(found.withColumn("_blocks", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    found = found.withColumns({f"_{k}": judged(k, f"_{k}") for k in GENERATORS})
    found = found.withColumn("_base", F.array_sort(F.concat(*(F.col(f"_{k}") for k in BASE))))
    found = found.withColumn("_so_far", F.col("_base"))
    for k in GENERATORS:
        found = with_free(found, f"_{k}", "_so_far")
    return found.withColumn("_all", F.array_sort("_so_far"))


def _listed(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    order = F.transform(F.col(column), lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of docs (doc_id, text).

    Null text: as empty, no spans. doc_id may be null or repeat; there is a row for each row.
    """
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return found.select("row.doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_listed("_base"), 256).alias("base_sha256"), _listed("_all").alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of their text replaced by its kind in brackets; spans that overlap are replaced together, by the first one's.

    All columns stay, a null text stays null.
    """
    found = with_spans(docs, text).withColumn("_ends", F.col("_all.end"))
    every = F.col("_all")
    # a span that begins behind the furthest end before it opens a run; that end is where the run before it ends
    both = F.zip_with(every, running("_ends", highest=True), lambda s, r: F.struct(s["start"].alias("start"), r.alias("from"), s["ord"].alias("ord")))
    found = found.withColumn("_cut", F.filter(both, lambda s: s["start"] >= s["from"]))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    last = F.array_max("_ends")
    body = F.transform("_cut", lambda s: F.concat(cut(F.col("_blocks"), s["from"], s["start"] - s["from"]), F.get(names, s["ord"])))
    done = F.concat(F.array_join(body, ""), F.substring(F.col("text"), last + 1, F.length("text")))
    clean = F.when(F.size(every) > 0, done).otherwise(F.col("row")[text])
    return found.withColumn("_clean", clean).select(*(F.col("_clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
