"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in partitions; shards are made of cells of at most `cell_rows` rows. How many rows partition p sends to cell c
is one draw from the matrix that a uniform random permutation of all rows would make: partition counts and cell sizes are
its margins. Each partition draws its own row by halving the range of partitions from the top, each half from a seed of
its own; so no task and no driver holds the matrix, and a task that is run again draws the same row.
Partitions permute their rows, send them as drawn, and each cell permutes what it has received.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parallel

#: numpy's own draws are for less than this many rows.
_NUMPY_MOST = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good; exact margins for any size."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    spread = 12 * int(math.sqrt(n * (good / (good + bad)) * (bad / (good + bad)) * max(1.0, good + bad - n) / (good + bad)) + 1) + 40
    ks = np.arange(max(lo, mode - spread), min(hi, mode + spread) + 1)
    # ratios p(k+1)/p(k) from the first value on: the weights need no more than their logarithms' differences
    steps = np.log(good - ks[:-1]) + np.log(n - ks[:-1]) - np.log(ks[:-1] + 1.0) - np.log(bad - n + ks[:-1] + 1.0)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.exp(logs - logs.max())
    total = np.cumsum(weights)
    return int(ks[np.searchsorted(total, rng.random() * total[-1], "right").clip(0, len(ks) - 1)])


def multivariate(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """Counts by colour of n draws without replacement."""
    if colours.sum() < _NUMPY_MOST:
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    out, left = np.zeros(len(colours), np.int64), int(colours.sum())
    for k, c in enumerate(colours.tolist()):
        left -= c
        out[k] = hypergeometric(rng, c, left, n)
        n -= int(out[k])
    return out


def matrix_row(sums: np.ndarray, cells: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix; sums[k] is the number of rows in the partitions before k, cells are the cells' sizes."""
    lo, hi, here = 0, len(sums) - 1, cells
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = multivariate(np.random.default_rng([seed, lo, hi]), here, int(sums[mid] - sums[lo]))
        if p < mid:
            hi, here = mid, left
        else:
            lo, here = mid, here - left
    return here


def cell_sizes(rows: int, shards: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's size and its shard; shards' sizes differ by one at most."""
    sizes, owner = [], []
    for s in range(shards):
        n = rows // shards + (s < rows % shards)
        k = max(1, -(-n // cell_rows))
        sizes += [n // k + (i < n % k) for i in range(k)]
        owner += [s] * k
    return np.array(sizes, np.int64), np.array(owner, np.int64)


def shuffled(rows: DataFrame, shards: int = 8, seed: int = 20240501, cell_rows: int = 1 << 18) -> DataFrame:
    """rows with two columns more: shard (int, 0 to shards - 1) and slot (long, gapless from 0 within a shard).

    Every order of all rows is equally likely (up to the generator); shards' counts differ by one at most. Null and
    repeated rows are rows like others. Fewer rows than shards: the last shards stay empty. Columns named __p, __i, __c,
    shard or slot are replaced. Only counts by partition reach the driver: two longs for each partition of the input.
    """
    kept = [c for c in rows.columns if c not in ("__p", "__i", "__c", "shard", "slot")]
    placed = cut(rows.select(*kept, F.monotonically_increasing_id().alias("__i")).withColumn("__p", F.shiftright("__i", 33)))
    counts = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    dense = {p: k for k, p in enumerate(sorted(counts))}
    sums = np.concatenate(([0], np.cumsum([counts[p] for p in sorted(counts)]))).astype(np.int64)
    total = int(sums[-1])
    sizes, owner = cell_sizes(total, shards, cell_rows)
    first = np.zeros(len(sizes), np.int64)
    for s in range(shards):
        of = owner == s
        first[of] = np.cumsum(sizes[of]) - sizes[of]
    shared = rows.sparkSession.sparkContext.broadcast((dense, sums, sizes, owner, first))

    def send(batches):
        for pdf in batches:
            cells = np.empty(len(pdf), np.int64)
            at = pdf["__i"].to_numpy() & ((1 << 33) - 1)
            ps = pdf["__p"].to_numpy()
            for p in np.unique(ps):
                if p not in drawn:
                    dense, sums, sizes, *_ = shared.value
                    k = dense[int(p)]
                    row = matrix_row(sums, sizes, k, seed)
                    drawn.clear()
                    drawn[p] = np.random.default_rng([seed, 1, k]).permutation(np.repeat(np.arange(len(row)), row))
                of = ps == p
                cells[of] = drawn[p][at[of]]
            yield pdf.assign(__c=cells)

    drawn: dict = {}
    sent = placed.mapInPandas(send, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema) + ", __c long")

    def settle(key, pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(key[0])
        _, _, _, owner, first = shared.value
        pdf = pdf.sort_values("__i", ignore_index=True)
        slot = first[c] + np.random.default_rng([seed, 2, c]).permutation(len(pdf))
        return pdf.drop(columns=["__p", "__i", "__c"]).assign(shard=np.int32(owner[c]), slot=slot)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name in kept) + ", shard int, slot long"
    return sent.groupBy("__c").applyInPandas(settle, schema)


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20240501, cell_rows: int = 1 << 18) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each document.

    size: the text's UTF-8 bytes plus 1, a null text has none; text_crc32: of the same bytes (null text: of none, 0).
    law is always `rows`: counts at most one apart, whatever texts, ids or sources repeat; grown_shard is null.
    Null and repeated doc_ids are kept. An empty table gives an empty table. Other columns are not read.
    Texts of any length are hashed where they lie; only ids and sizes are moved.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffled(small, shards, seed, cell_rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
