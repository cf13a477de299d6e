"""Recordings of 24-bit samples (BDF): one channel from an event on, without reading the others into a task.

A file has a header of 256 bytes, 256 more for each channel, and records that hold so many samples of each channel in turn. The header is
read by column functions; only the wanted channel's bytes and the last channel's, which has the events, leave the file's row, a row
a record. These are decoded in tasks of any number; events are found across the borders of records.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"\xffBIOSEMI"
#: Where the header has what it says of the channels, a field of so many bytes for each: (bytes of the fields before, bytes).
FIELDS = {"pmin": (104, 8), "pmax": (112, 8), "dmin": (120, 8), "dmax": (128, 8), "samples": (216, 8)}


def _text(data: Column, at: Column | int, n: int) -> Column:
    return F.trim(F.substring(data, at if isinstance(at, Column) else F.lit(at), F.lit(n)).cast("string"))


def _field(name: str, channel: Column) -> Column:
    before, n = FIELDS[name]
    return _text(F.col("content"), F.lit(257) + F.col("ns") * before + channel * n, n).try_cast("double")


def _heads(raw: DataFrame, channel: int) -> DataFrame:
    """raw (path, content) with what the header says: ns, samples (an array), seconds of a record, fs, records, size of one, the channel's scale, and error."""
    rows = raw.withColumn("ns", _text(F.col("content"), 253, 4).try_cast("int")).withColumn("ns", F.when(F.substring("content", 1, 8) == F.lit(MAGIC), F.col("ns")))
    rows = rows.withColumn("samples", F.when(F.col("ns") > 0, F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda k: _field("samples", k).cast("int"))))
    rows = rows.withColumn("seconds", _text(F.col("content"), 245, 8).try_cast("double")).withColumn("size", 3 * F.aggregate("samples", F.lit(0), lambda s, x: s + x))
    rows = rows.withColumn("records", F.floor(F.try_divide(F.length("content") - 256 * (F.col("ns") + 1), F.col("size"))).cast("int"))
    own = F.lit(channel)
    rows = rows.withColumn("fs", F.try_divide(F.get("samples", own).cast("double"), F.col("seconds")))
    rows = rows.withColumns({c: _field(c, own) for c in ("pmin", "pmax", "dmin", "dmax")})
    wrong = F.when(F.col("ns").isNull(), "not a BDF recording").when(F.col("ns") <= channel + 1, "no such channel").when(F.col("fs").isNull() | F.col("records").isNull() | F.coalesce((F.col("dmax") <= F.col("dmin")) | F.isnull(F.col("pmin") + F.col("pmax")), F.lit(True)), "header cannot be read").when(F.col("records") < 1, "no records")
    return rows.withColumn("error", wrong)


def _integers(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
    return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000


def decoded(raw: DataFrame, channel: int = 33, event: int = 3) -> DataFrame:
    """(path, fs, signal, error) of recordings (path, content): the channel (from 0) in its physical unit, from the event-th event on.

    An event is a sample at which the low 16 bits of the last channel become another number than 0. What isn't a recording, lacks the channel
    or has fewer events keeps its row with an error. A record that was cut short is left out.
    """
    heads = _heads(raw.select("path", "content"), channel)
    before = lambda k: 3 * F.aggregate(F.slice("samples", F.lit(1), k), F.lit(0), lambda s, x: s + x)

    def part(record: Column, k: Column) -> Column:
        at = 256 * (F.col("ns") + 1) + record.cast("long") * F.col("size") + before(k) + 1
        return F.substring(F.col("content"), at.cast("int"), 3 * F.get("samples", k))

    each = F.transform(F.sequence(F.lit(0), F.col("records") - 1), lambda r: F.struct(r.alias("record"), part(r, F.lit(channel)).alias("data"), part(r, F.col("ns") - 1).alias("marks")))
    good = heads.filter("error IS NULL")
    records = good.select("path", F.explode(each).alias("x")).select("path", "x.*").repartition("path", "record")
    own = Window.partitionBy("path").orderBy("record")
    records = records.withColumn("last", F.lag(F.expr("substring(marks, -3, 3)")).over(own))

    def run(batches):
        for pdf in batches:
            out = []
            for path, record, data, marks, last in zip(*(pdf[c] for c in ("path", "record", "data", "marks", "last")), strict=True):
                m = _integers((b"\0\0\0" if last is None else bytes(last)) + bytes(marks)) & 0xFFFF
                x = _integers(bytes(data))
                events = np.flatnonzero((m[1:] != 0) & (m[1:] != m[:-1])) * len(x) // max(1, len(m) - 1)
                out.append((path, record, x.tolist(), (record * len(x) + events).tolist()))
            yield pd.DataFrame(out, columns=["path", "record", "x", "events"])

    parts = records.mapInPandas(run, "path string, record int, x array<int>, events array<long>")
    found = parts.select("path", F.explode("events").alias("at")).withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("at"))).filter(F.col("k") == event).select("path", F.col("at").alias("start"))
    whole = parts.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("record", "x"))), lambda r: r["x"])).alias("x"))
    joined = heads.drop("content").join(whole, "path", "left").join(found, "path", "left")
    scale = F.try_divide(F.col("pmax") - F.col("pmin"), F.col("dmax") - F.col("dmin"))
    late = F.slice("x", F.col("start").cast("int") + 1, F.greatest(F.size("x") - F.col("start").cast("int"), F.lit(0)))
    signal = F.transform(late, lambda v: (v - F.col("dmin")) * scale + F.col("pmin"))
    error = F.coalesce("error", F.when(F.col("start").isNull(), F.lit(f"fewer than {event} events")))
    return joined.select("path", F.when(error.isNull(), F.col("fs")).alias("fs"), F.when(error.isNull(), signal).alias("signal"), error.alias("error"))


def read_recordings(spark: SparkSession, root: str, pattern: str = "*.bdf", channel: int = 33, event: int = 3) -> DataFrame:
    """decoded recordings of the files below root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return decoded(raw, channel, event)


def encoded(channels: list[np.ndarray], fs: int, seconds: float = 1.0, physical: tuple[float, float] = (-8388608.0, 8388607.0)) -> bytes:
    """A recording of integer channels, the last with the events; whole records only. For tests and for data made of other tables."""
    per, ns = int(fs * seconds), len(channels)
    field = lambda v, n: str(v).encode().ljust(n)[:n]
    n = min(len(c) for c in channels) // per
    head = MAGIC + b" " * 176 + field(256 * (ns + 1), 8) + field("24BIT", 44) + field(n, 8) + field(f"{seconds:g}", 8) + field(ns, 4)
    own = [(b" " * 16, b" " * 80, b" " * 8), *((field(int(v) if v == int(v) else f"{v:g}", 8),) for v in physical), (field(-8388608, 8),), (field(8388607, 8),), (b" " * 80,), (field(per, 8),), (b" " * 32,)]
    head += b"".join(x * ns for group in own for x in group)
    data = np.stack([np.asarray(c[: n * per], np.int32).reshape(n, per) for c in channels], 1)
    return head + data.astype("<i4").view(np.uint8).reshape(n, ns, per, 4)[..., :3].tobytes()
