"""Ground-truth files of the public datasets as (path, fs, signal) rows, and their registry.

Each connector reads whole small files in parallel: a file is a row of `binaryFile` or a few rows of text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, fs double, signal array<double>, error string"


def _numbers(lines, column: int = 0, sep: str | None = ",", skip: int = 0) -> np.ndarray:
    return np.array([float(x.split(sep)[column]) for x in lines[skip:] if x.strip()])


def _rate(t: np.ndarray) -> float:
    return float(round(1 / np.diff(t).mean()))


def _lines(data: bytes) -> list[str]:
    return data.decode("utf-8").splitlines()


def _json_waveform(data: bytes):
    return 60.0, np.array([float(p["Value"]["waveform"]) for p in json.loads(data)["/FullPackage"]])


def _csv_ms(trace: int, skip: int):
    def read(data: bytes):
        lines = _lines(data)
        return _rate(_numbers(lines, 0, ",", skip) / 1000), _numbers(lines, trace, ",", skip)

    return read


def _three_lines(data: bytes):
    trace, _, t = ([float(x) for x in line.split()] for line in _lines(data)[:3])
    return _rate(np.array(t)), np.array(trace)


def _xml_values(data: bytes):
    import xml.etree.ElementTree as ET

    return 60.0, np.array([float(e.text) for e in ET.fromstring(data).iter("value2")])


def _ecg_csv(data: bytes):
    lines = _lines(data)
    t = np.unique(_numbers(lines, 0, ",", 1))
    return float(round(1 / (np.diff(t).mean() / 1000)) * 5), _numbers(lines, 1, ",", 1)


def _column(name: str, fs: float):
    def read(data: bytes):
        lines = _lines(data)
        k = [c.strip() for c in lines[0].split(",")].index(name)
        return fs, _numbers(lines, k, ",", 1)

    return read


def _hdf5(data: bytes):
    import io

    import h5py  # not everywhere: only this connector needs it

    with h5py.File(io.BytesIO(data)) as f:
        return 256.0, np.array(f["pulse"], float)


def _last_frame_ms(data: bytes):
    import xml.etree.ElementTree as ET

    return 0, int(float(ET.fromstring(data)[-1].find("value1").text))


def _frame_samples(data: bytes):
    lines = [x for x in _lines(data) if x.strip()]
    return tuple(int(x.split(",")[1]) for x in (lines[0], lines[-1]))


#: name -> (file beside the signal, its parser to two numbers): what places the signal in the video's time.
BESIDE: dict[str, tuple[str, Callable]] = {
    "ecg_fitness": ("c920.csv", _frame_samples),
    "lgi_ppgi": ("cv_camera_sensor_timer_stream_handler.xml", _last_frame_ms),
    "sample": ("cv_camera_sensor_timer_stream_handler.xml", _last_frame_ms),
}


def _elsewhere(data: bytes):
    raise NotImplementedError("recordings are decoded by record, see sources/bdf.py")


#: name -> (video pattern, signal pattern, kind of ground truth, parser)
CONNECTORS: dict[str, tuple[str, str, str, Callable]] = {
    "cohface": ("*.avi", "*.hdf5", "BVP", _hdf5),
    "ecg_fitness": ("*.avi", "viatom*.csv", "ECG", _ecg_csv),
    "lgi_ppgi": ("*.avi", "cms50*.xml", "BVP", _xml_values),
    "sample": ("*.avi", "cms50*.xml", "BVP", _xml_values),
    "mahnob": ("*.avi", "*emotion*.bdf", "ECG", _elsewhere),
    "pure": ("*.avi", "*.json", "BVP", _json_waveform),
    "ubfc1": ("*.avi", "*.xmp", "BVP", _csv_ms(3, 0)),
    "ubfc2": ("*.avi", "ground_truth.txt", "BVP", _three_lines),
    "ubfc_phys": ("*.avi", "bvp*.csv", "BVP", lambda d: (64.0, _numbers(_lines(d), 0))),
    "v4v": ("*.mkv", "*.txt", "BVP", lambda d: (1000.0, _numbers(_lines(d), 0, None))),
    "vicar_ppg": ("*.mp4", "*.csv", "BVP", _csv_ms(1, 1)),
    "vipl_hr_v1": ("*.avi", "*.csv", "BVP", _column("Wave", 50.0)),
}


def register(name: str, video: str, signal: str, kind: str, parser: Callable[[bytes], tuple[float, np.ndarray]]) -> None:
    """Adds a connector: parser(file's bytes) gives (rate, signal)."""
    CONNECTORS[name.lower().replace("-", "_")] = (video, signal, kind, parser)


def connector(name: str) -> tuple[str, str, str, Callable]:
    """By name, whatever its case, - or _; ImportError if there is none."""
    if (key := name.lower().replace("-", "_")) not in CONNECTORS:
        raise ImportError(f"no such dataset: {name}; there are {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[key]


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path) of the files below root; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")


def _parsed(spark: SparkSession, root: str, pattern: str, parser: Callable, schema: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return parsed(raw, parser, schema)


def parsed(raw: DataFrame, parser: Callable, schema: str) -> DataFrame:
    """(path, the parser's two values, error) of each file (path, content); an unreadable one keeps its row with an error. Files go to Python a few at a time."""
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def one(data):
        try:
            return (*parser(bytes(data)), None)
        except Exception as e:  # noqa: BLE001 - kept as a row
            return (None, None, f"{type(e).__name__}: {e}")

    # rows of files are wide: pickled rows come by the hundred, Arrow's batches by the ten thousand
    read = F.udf(one, ", ".join(f"{n} {t}" for n, t in zip(names[1:], types[1:], strict=True)), useArrow=False)
    return raw.select(F.col("path").alias(names[0]), F.explode(F.array(read("content"))).alias("x")).select(names[0], "x.*")


def signals_of(raw: DataFrame, dataset: str) -> DataFrame:
    """(path, fs, signal, error) of files (path, content) by the data set's parser, as they stand."""
    parser = connector(dataset)[3]
    return parsed(raw, lambda data: (float((got := parser(data))[0]), [float(v) for v in got[1]]), SCHEMA)


def read_signals(spark: SparkSession, dataset: str, root: str) -> DataFrame:
    """(path, fs, signal, error): an unreadable file keeps its row with an error, so that it is counted.

    Where a data set has a file beside the signal that places it in the video's time, the signal is cut by it: to the sample
    numbers of the first and last frame, or by the lead that it has over the last frame. A signal without that file, or
    with an unreadable one, is an error.
    """
    _, pattern, _, parser = connector(dataset)
    if parser is _elsewhere:
        from .bdf import read_recordings

        return read_recordings(spark, root, pattern)
    files_ = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    raw = signals_of(files_, dataset)
    if (key := dataset.lower().replace("-", "_")) not in BESIDE:
        return raw
    name, place = BESIDE[key]
    places = _parsed(spark, root, name, place, "place string, first long, last long, wrong string")
    places = places.select(_folder("place").alias("folder"), "first", "last", "wrong", F.lit(True).alias("there"))
    rows = raw.withColumn("folder", _folder("path")).join(places, "folder", "left")
    missing = F.when(F.col("there").isNull(), F.lit(f"no {name} beside it"))
    rows = rows.withColumn("error", F.coalesce("error", "wrong", missing))
    if key == "ecg_fitness":
        cut = F.slice("signal", (F.col("first") + 1).cast("int"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0)).cast("int"))
        rows = rows.withColumn("signal", F.when(F.col("error").isNull(), cut))
    else:
        end = F.floor(F.size("signal") * 1000 / F.col("fs"))  # ms
        rows = without_lead(rows.withColumn("lead_s", F.when(F.col("error").isNull(), (end - F.col("last")) / 1000)))
    return rows.select("path", "fs", "signal", "error")


def _folder(path: str):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def without_lead(signals: DataFrame, seconds: str = "lead_s") -> DataFrame:
    """Signals less the samples before the video starts: round(lead x rate); a negative lead is an error."""
    n = F.round(F.col(seconds) * F.col("fs")).cast("int")
    bad = F.when(F.col(seconds) < 0, F.lit("signal starts after the video"))
    return signals.withColumn("error", F.coalesce("error", bad)).withColumn("signal", F.when(F.col(seconds) >= 0, F.slice("signal", n + 1, F.greatest(F.size("signal") - n, F.lit(0)))))


def dataset(spark: SparkSession, name: str, video_root: str, signal_root: str) -> DataFrame:
    """(dataset, video_idx, video_path, sig_path, gt_kind): files of the same directory, numbered in the videos' natural order."""
    from ..operators.align import paired_files

    video, signal, kind, _ = connector(name)
    pairs = paired_files(files(spark, video_root, video), files(spark, signal_root, signal))
    placed = natural_places(pairs, "video_path")
    return placed.select(F.lit(name).alias("dataset"), (F.col("place") - 1).cast("int").alias("video_idx"), "video_path", "sig_path", F.lit(kind).alias("gt_kind"))


def natural(path: str):
    """Sort keys that put file2 before file10."""
    number = F.regexp_extract(path, r"(\d+)\D*$", 1)
    return F.regexp_replace(path, r"\d+\D*$", ""), F.when(number != "", number.cast("long")), F.col(path)


def natural_places(rows: DataFrame, name: str) -> DataFrame:
    """rows in natural order of the column `name`, with their place from 1: no task sees more than a range of the rows."""
    from ..plans.pipeline import written

    ranged = rows.orderBy(*natural(name)).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = written(ranged)  # counted and read from the same ranges, whichever executors are lost
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 1
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    before = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__part int, __before long"))
    return ranged.join(before, "__part").withColumn("place", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def image_frames(spark: SparkSession, root: str, fps: float = 30.0, pattern: str = "*.png", most: int = 500_000) -> DataFrame:
    """(video_path, frame_idx, ts, content) of image sequences, one directory a video, in natural order of the names.

    Up to `most` places are broadcast; of more images each goes to its place by one shuffle.
    """
    from pyspark.sql import Window

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = raw.select(_folder("path").alias("video_path"), "path", "content")
    # the places follow from the paths alone; no sort carries an image
    own = Window.partitionBy("video_path").orderBy(*natural("path"))
    places = files(spark, root, pattern).select(_folder("path").alias("video_path"), "path").select("path", (F.row_number().over(own) - 1).alias("frame_idx"))
    small = places.count() <= most
    return rows.join(F.broadcast(places) if small else places, "path").select("video_path", "frame_idx", (F.col("frame_idx") / fps).alias("ts"), "content")
