"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the corpus contracts define it.
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; only where it is unset (tests) a folder in the warehouse, which is shared as well."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from now on; for small rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


#: Tables that `stored` has written within the call of `alone` that is running, in its own thread.
_TABLES: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def stored(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder; for rows that carry texts or token ids."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (tables := _TABLES.get()) is not None:
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(spark: SparkSession, make) -> DataFrame:
    """make(), stored; the tables that were written on the way are removed."""
    held = _TABLES.set([])
    try:
        out = stored(make())
        written = _TABLES.get()
    finally:
        _TABLES.reset(held)
    for path in written[:-1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if (outer := _TABLES.get()) is not None:
        outer.append(written[-1])
    return out


def by_key(rows: DataFrame, small: DataFrame, key: str | list[str], size: str, most: int = 100_000) -> DataFrame:
    """rows joined (left) with small, which has each key once and in column `size` how many rows have it.

    Keys of over 1000 rows, and of more than a share 1 / most of all, are joined by a broadcast of at most `most` keys, so
    that their rows stay where they are; all others are shuffled.
    """
    total = small.agg(F.sum(size)).first()[0] or 0
    hot = cut(small.filter(F.col(size) > max(1000, total // most)).drop(size))
    cold = small.drop(size)
    if hot.isEmpty():
        return rows.join(cold, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left"))


def parallel(df: DataFrame) -> int:
    """Shuffle partitions to ask for where a shuffle has to be named."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, None where null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batch: pa.RecordBatch, text: int | None = None, rows: int = 512, most_bytes: int = 1 << 22):
    """Slices of a batch of `rows` rows and, where a text column is named, about `most_bytes` of text (a longer text comes alone)."""
    if text is None:
        cuts = [*range(0, batch.num_rows, rows), batch.num_rows]
    else:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        cuts, held = [0], 0
        for k, n in enumerate(sizes):
            if k > cuts[-1] and (held + n > most_bytes or k - cuts[-1] >= rows):
                cuts.append(k)
                held = 0
            held += n
        cuts.append(batch.num_rows)
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def smallest(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """The `most` rows with the smallest hashes of the columns, which have to be distinct.

    Where there are many more rows, only hashes below a share of their range are sorted, about twice as many rows as are
    wanted; so what tasks send on doesn't grow with their number.
    """
    h = F.xxhash64(*columns)
    if (n := rows.count()) > 4 * most:
        rows = rows.filter(h < int(-(2**63) + 2 * most / n * 2.0**64))
    return rows.orderBy(h, *columns).limit(most)


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
