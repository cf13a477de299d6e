"""Learned decision lists over measures of a text, in DataFrame functions only.

Sequential covering learns an ordered list of rules from labelled rows: a rule is a conjunction of thresholds, grown on
one part of the rows not covered so far by the gain in information, then pruned from its end on the other part by its
worth there. A rule that isn't precise enough there is dropped and grown anew
on other parts; after a few such misses in a row the list ends. What no rule covers is kept. The list
becomes one ordered conditional expression of Spark. Hashes of the rows' ids decide which part a row is in, so the list
follows from the tables alone, however these are partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, smallest

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "n_lines", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "stop_share")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _covered(places: Column) -> Column:
    """How many words the windows that start at the sorted places cover."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, zero, lambda acc, p: F.struct((p + WINDOW).cast("long").alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p.cast("long"))).cast("long").alias("n")), lambda acc: acc["n"])


def _repeated_places(grams: Column) -> Column:
    """Sorted places of the grams that occur twice or more."""
    placed = F.array_sort(F.transform(grams, lambda g, k: F.struct(g.alias("g"), k.alias("k"))))

    def twins(s: Column) -> Column:
        near = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]), x["k"]))
        return F.array_sort(F.filter(near, lambda k: k.isNotNull()))

    return let(placed, twins)


def _n_repeat(words: Column) -> Column:
    """Words in windows of WINDOW words that the text has twice or more; windows are compared by 64-bit hashes."""

    def from_hashes(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda k: F.xxhash64(*[F.get(h, k + d) for d in range(WINDOW)]))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_covered(_repeated_places(g))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(hashed, from_hashes))


def measured(text: Column) -> Column:
    """A struct of a text's base counts and measures; a null text has no words and counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(t, F.lit(WS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, WS, "")).cast("long").alias("word_chars"),
            _count(t, SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _n_repeat(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _count(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
            _count(t, "0123456789").alias("n_digits"),
            _count(t, "!?").alias("n_marks"),
            _count(t, ".").alias("n_stops"),
        )

    def shares(c: Column) -> Column:
        chars, n = F.greatest(c["word_chars"], F.lit(1)), F.greatest(c["n_words"], F.lit(1))
        return F.struct(
            c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), c["lines"]["dup"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
            F.struct(
                c["n_words"].cast("double").alias("n_words"), c["lines"]["n"].cast("double").alias("n_lines"), (c["word_chars"] / n).alias("mean_word"), (c["n_symbols"] / chars).alias("symbol_share"),
                (c["lines"]["dup"] / F.greatest(c["lines"]["n"], F.lit(1))).alias("dup_line_share"), (c["n_repeat_words"] / n).alias("repeat_share"), (c["n_distinct"] / n).alias("distinct_share"),
                (c["n_upper"] / chars).alias("upper_share"), (c["n_digits"] / chars).alias("digit_share"), (c["n_marks"] / chars).alias("mark_share"), (c["n_stops"] / n).alias("stop_share"),
            ).alias("m"),
        )

    return let(let(words, counts), shares)


@dataclass(frozen=True)
class Test:
    measure: str
    above: bool
    threshold: float

    def column(self, m: Column) -> Column:
        return m[self.measure] > self.threshold if self.above else m[self.measure] <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, MEASURES.index(self.measure)]
        return v > self.threshold if self.above else v <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Rejects what passes all its tests; covered and precision are those on the pruning part."""

    tests: tuple[Test, ...]
    covered: int
    precision: float

    def column(self, m: Column) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column(m)
        return out

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for t in self.tests:
            out &= t.holds(x)
        return out


def _grow(x: np.ndarray, bad: np.ndarray, most_tests: int, thresholds: int) -> tuple[Test, ...]:
    """Adds the test with the largest gain p (log share after - log share before) until only bad rows are left."""
    tests: tuple[Test, ...] = ()
    inside = np.ones(len(x), bool)
    while len(tests) < most_tests and bad[inside].any() and not bad[inside].all():
        base = np.log2(bad[inside].mean())
        best, found = 1e-9, None
        for k, name in enumerate(MEASURES):
            v, b = x[inside, k], bad[inside]
            cuts = np.unique(np.concatenate([np.quantile(v[part], np.linspace(0, 1, thresholds + 1), method="lower") for part in (b, ~b)]))
            order = np.argsort(v, kind="stable")
            below = np.concatenate(([0], np.cumsum(b[order])))
            n = np.searchsorted(v[order], cuts, "right")
            for above, total, hits in ((False, n, below[n]), (True, len(v) - n, below[-1] - below[n])):
                gain = np.where(hits > 0, hits * (np.log2(np.maximum(hits, 1e-9) / np.maximum(total, 1)) - base), 0)
                if gain.max(initial=0) > best:
                    at = int(gain.argmax())
                    best, found = gain[at], Test(name, above, float(cuts[at]))
        if not found:
            break
        tests += (found,)
        inside &= found.holds(x)
    return tests


def _part(keys: np.ndarray, turn: int) -> np.ndarray:
    """Rows that the rule number `turn` grows on, about two thirds, by their keys."""
    with np.errstate(over="ignore"):
        h = (keys ^ np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(33)) % np.uint64(3) < 2


def learn(x: np.ndarray, bad: np.ndarray, keys: np.ndarray | None = None, most_rules: int = 24, most_tests: int = 4, thresholds: int = 64, precision: float = 0.97, least: int = 3, most_misses: int = 3) -> list[Rule]:
    """An ordered list of rejecting rules for rows of MEASURES; bad marks those to reject. Empty without rows of both kinds.

    keys (uint64, the rows' numbers if not given) part the rows; the order of the rows has no say.
    """
    keys = np.arange(len(x), dtype=np.uint64) if keys is None else keys
    rules: list[Rule] = []
    turn = misses = 0
    while len(rules) < most_rules and misses < most_misses and bad.any() and not bad.all():
        grow = _part(keys, turn)
        turn += 1
        tests = _grow(x[grow], bad[grow], most_tests, thresholds)
        px, pb = x[~grow], bad[~grow]
        best = None
        for n in range(len(tests), 0, -1):
            inside = Rule(tests[:n], 0, 0).holds(px)
            p, q = int(pb[inside].sum()), int((~pb[inside]).sum())
            worth = (p - q) / max(1, p + q)
            if best is None or worth >= best[0]:
                best = worth, n, p, q
        if not best or best[2] < least or best[2] / (best[2] + best[3]) < precision:
            misses += 1
            continue
        misses = 0
        rule = Rule(tests[: best[1]], best[2] + best[3], best[2] / (best[2] + best[3]))
        rules.append(rule)
        left = ~rule.holds(x)
        x, bad, keys = x[left], bad[left], keys[left]
    return rules


def labelled(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures, badness and keys (hashes of the ids) of at most `most` labelled documents, those with the smallest hash of their id; one row for each id.

    The sample is the only thing that is bounded: its ids are broadcast, its measures come to the driver.
    """
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    sample = smallest(marks, ["doc_id"], most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("__quality").alias("quality"))
    got = sorted(rows.select(F.xxhash64("doc_id").alias("key"), "quality", measured(F.col("text"))["m"].alias("m")).collect())
    x = np.array([[r["m"][k] for k in MEASURES] for r in got], float).reshape(-1, len(MEASURES))
    return x, np.array([r["quality"] == 0 for r in got], bool), np.array([r["key"] for r in got], np.int64).view(np.uint64)


def verdicts(m: Column, rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1 on; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = (F if out is None else out).when(rule.column(m), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def judge(docs: DataFrame, rules: list[Rule], name: str = "__q") -> DataFrame:
    """docs with a struct column `name` (a column of that name is replaced): base counts, base_failed, rule (number of the
    list's rule that rejects it, 0 if none) and kept."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def verdict(c: Column) -> Column:
        out = F.struct(base_failed(c).alias("base_failed"), verdicts(c["m"], rules).alias("rule"))
        return let(out, lambda v: F.struct(*[c[k].alias(k) for k in counts], v["base_failed"].alias("base_failed"), v["rule"].alias("rule"), (~v["base_failed"] & (v["rule"] == 0)).alias("kept")))

    # one expression, so that a filter on a field of it measures each text once
    return docs.withColumn(name, let(measured(F.col("text")), verdict))


def kept(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs without the rows that the base or the list rejects; all columns stay, whatever their names."""
    name = "__q"
    while name in docs.columns:
        name += "_"
    return judge(docs, rules, name).filter(f"`{name}`.kept").drop(name)


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) for each document.

    A null or empty text has no words and so fails the base. Null and repeated doc_ids are judged like others. Without
    labels of both kinds the list is empty and the base alone decides. An empty table gives an empty table. Other columns
    are not read. A text is measured whole in the memory of one task: about 100 bytes a word. Repeated ids in labels count
    once, with their lowest quality; of equally good tests the first measure's and lowest threshold is taken.
    """
    rules = learn(*labelled(docs, labels, most))
    return judge(docs.select("doc_id", "text"), rules).select("doc_id", *[F.col(f"__q.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")])
