"""Spelling variants: words one edit apart, by errata tries over parts of the vocabulary that a pair shares an intact end of.

Of two words one edit apart let m be the shorter length and e the length of their common prefix. Where e lies in [lo, hi), both have the
first lo characters in common and the last m - hi; so a part is (m, lo, hi) and these two ends. All words start with
the range [0, m + 1) in two halves, and parts of too many words are halved again, so that a task never holds more than one part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, parallel, pieces, stored
from .errata import one_edit

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def slip(word: str, before: int, one_in: int) -> str:
    """word, less a character where its hash (going on from `before`) is a multiple of one_in."""
    h = zlib.crc32(word.encode(), before)
    if h % one_in:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _count(batches, one_in: int, least: int, runs: int = 1 << 18):
    for batch in batches:
        for part in pieces(batch, text=1):
            total: Counter = Counter()
            for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                found = (m.group().translate(_LOWER) for m in _RUN.finditer(text or ""))
                while own := Counter(islice(found, runs)):  # a text's words, so many at a time
                    for w, n in own.items():
                        if len(w := slip(w, before, one_in) if one_in else w) >= least:
                            total[w] += n
                    if len(total) > runs:
                        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
                        total.clear()
            if total:
                yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, one_in: int = 97, least: int = 5, times: int = 3) -> DataFrame:
    """(word, n): words of at least `least` characters that occur `times` times or more in all texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased. With one_in, the character h % length is taken out
    of an occurrence where one_in divides h, the crc32 of `<doc_id>:<word>` (a null doc_id is empty); 0 leaves all as they are. Counted
    in a task, a few MB of text at a time, before anything is shuffled.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(lambda batches: _count(batches, one_in, least), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _halves(m, lo, hi) -> tuple[Column, Column]:
    """The two ranges that make up (lo, hi), as structs."""
    mid = lo + F.ceil((hi - lo) / 2).cast("int")
    return F.struct(m.alias("m"), mid.alias("lo"), hi.alias("hi")), F.struct(m.alias("m"), lo.alias("lo"), mid.alias("hi"))


def _placed(rows: DataFrame) -> DataFrame:
    """(word, n, m, lo, hi, ends): with the ends that words of a part have in common."""
    end = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    ends = F.concat(F.substring(F.col("word"), F.lit(1), F.col("lo")), F.lit("|"), F.substring(F.col("word"), F.length("word") - end + 1, end))
    return rows.withColumn("ends", ends)


_PART = ["m", "lo", "hi", "ends"]


def parts(words: DataFrame, least: int = 5, most: int = 20_000) -> DataFrame:
    """words (word, n) by part: (word, n, m, lo, hi, ends), four rows a word where no part has over `most` words.

    A part that has more is halved, and its halves, until they have not. A range of one place can't be halved: its words differ within two
    characters, so their number is bounded by the alphabet's (8,190 for 90 letters). Only whether there are such parts reaches the driver.
    """
    n = F.length("word")
    whole = F.array(*[F.struct((n - k).alias("m"), F.lit(0).alias("lo"), (n - k + 1).alias("hi")) for k in (0, 1)])
    level = words.select("word", "n", F.explode(F.filter(whole, lambda x: x["m"] >= least)).alias("x")).select("word", "n", "x.*")
    out = None
    while True:
        halved = F.explode(F.array(*_halves(F.col("m"), F.col("lo"), F.col("hi")))).alias("x")
        level = _placed(level.select("word", "n", halved).select("word", "n", "x.*"))
        hot = stored(level.groupBy(*_PART).agg(F.count("*").alias("k")).filter((F.col("k") > most) & (F.col("hi") - F.col("lo") > 1)).drop("k"))
        if hot.isEmpty():
            return level if out is None else out.unionByName(level)
        calm = level.join(hot, _PART, "left_anti")
        out = calm if out is None else out.unionByName(calm)
        level = level.join(hot, _PART, "left_semi").drop("ends")


def _near(batches):
    """(word, k, n, near) of the words that have near ones in their part; rows come with a part's together."""
    names = ["m", "lo", "hi", "ends", "word", "n"]

    def solved(key, rows):
        if len(rows) < 2:
            return
        m, lo, hi, _ = key
        end = max(0, m - hi)
        rows.sort(key=lambda r: (-r[1], r[0]))  # the first of a list is the best form
        many, best = [0] * len(rows), [len(rows)] * len(rows)
        for ids in one_edit([w[lo : len(w) - end] for w, _ in rows], hi - lo, m - lo - end):
            first, second = sorted(ids)[:2]
            for i in ids:
                many[i] += len(ids) - 1
                best[i] = min(best[i], second if i == first else first)
        got = [i for i, k in enumerate(many) if k]
        if got:
            yield pa.record_batch([pa.array([rows[i][0] for i in got], pa.string()), pa.array([many[i] for i in got], pa.int64()), pa.array([rows[best[i]][1] for i in got], pa.int64()), pa.array([rows[best[i]][0] for i in got], pa.string())], ["word", "k", "n", "near"])

    held_key, held, small = None, [], []
    for batch in batches:
        for *key, word, n in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if key != held_key:
                if held_key is not None:
                    small.extend(solved(held_key, held))
                held_key, held = key, []
                if len(small) > 500:
                    yield from pa.Table.from_batches(small).combine_chunks().to_batches()
                    small = []
            held.append((word, n))
    if held_key is not None:
        small.extend(solved(held_key, held))
    if small:
        yield from pa.Table.from_batches(small).combine_chunks().to_batches()


def near_words(words: DataFrame, least: int = 5, most: int = 20_000) -> DataFrame:
    """(word, n_near, near, near_n): how many words (word, n) are one edit away, and the one of these with the largest n (ties: first in code-point order); words without any are left out."""
    dealt = parts(words, least, most).repartition(parallel(words), *_PART).sortWithinPartitions(*_PART)
    found = dealt.select(*_PART, "word", "n").mapInArrow(_near, "word string, k long, n long, near string")
    best = F.min(F.struct((-F.col("n")).alias("n"), "near"))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form) that have a form: where following forms ends. By doubling: a round joins each word's root with that root's own."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(now.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, one_in: int = 97, least: int = 5, times: int = 3, ratio: int = 2, most: int = 20_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `vocabulary`.

    form: of the words one edit away (a code point inserted, deleted or replaced) the one with the largest n, ties by code points, if that is
    `ratio` times the word's own n or more; else null, like form_n. root: where following forms ends, the word itself if it has none; n grows at each
    step, so there are no circles. Null and empty texts have no words, repeated rows count as often as they come, a very long text is counted
    piece by piece, a very long word is a word. An empty table gives an empty table. Other columns are not read.
    """
    words = stored(vocabulary(docs, one_in, least, times))
    near = near_words(words, least, most)
    good = F.col("near_n") >= ratio * F.col("n")
    out = stored(words.join(near, "word", "left").select("word", F.when(good, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near_n")).alias("form_n")))
    ends = roots(out.filter("form IS NOT NULL").select("word", "form"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
