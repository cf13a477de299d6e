"""Image sequences as frames, whole or as a stream: a directory is a video, a file a frame, a file named END (with some text: Spark reads no empty files) its end.

Files come through Spark's own reader, which also keeps what a stream has seen; so a stream goes on after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches

END = "END"
_COLOURS = pa.schema([("video_id", pa.string()), ("estimator_id", pa.int32()), ("frame_idx", pa.int64()), ("r", pa.float64()), ("g", pa.float64()), ("b", pa.float64()), ("last", pa.bool_()), ("error", pa.string())])
_FILE = "path string, modificationTime timestamp, length long, content binary"


def pnm(data: bytes) -> np.ndarray:
    """(height, width, 3) of a binary PGM or PPM image of 8 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("the header ends early")
        fields.append(data[at:end])
        at = end
    kind, width, height, top = fields[0], *map(int, fields[1:])
    if kind not in (b"P5", b"P6") or top != 255:
        raise ValueError("not a binary PGM or PPM image of 8 bits")
    x = np.frombuffer(data, np.uint8, width * height * (1 if kind == b"P5" else 3), at + 1).reshape(height, width, -1)
    return np.broadcast_to(x, (height, width, 3)) if kind == b"P5" else x


def to_width(image: np.ndarray, width: int = 640) -> np.ndarray:
    """The image at a width, its height in proportion, by nearest places."""
    h, w = image.shape[:2]
    height = int(width * h / w)
    return image[(np.arange(height) * h // height)[:, None], np.arange(width) * w // width]


def _frames(files: DataFrame, fps: float) -> DataFrame:
    """(video_path, frame_idx, ts, content, last): frames by the number in their name; the end's row has neither number nor content."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    last = F.regexp_replace(name, r"\.[^.]*$", "") == END
    number = F.when(~last, F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("long"))
    rows = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("video_path"), number.alias("frame_idx"), F.when(~last, F.col("content")).alias("content"), last.alias("last"))
    return rows.select("video_path", "frame_idx", (F.col("frame_idx") / fps).alias("ts"), "content", "last")


def read_frames(spark: SparkSession, root: str, fps: float = 30.0, pattern: str = "*.ppm") -> DataFrame:
    """Frames of the image sequences below root. Nothing is sorted: a frame's number is in its name, and rows that carry images stay where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return _frames(files, fps)


def stream_frames(spark: SparkSession, root: str, fps: float = 30.0, pattern: str = "*.ppm", at_once: int = 1000) -> DataFrame:
    """Frames of the image sequences below root as they appear, up to `at_once` files a batch, with the row of each END."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{pattern},{END},{END}.*}}").option("maxFilesPerTrigger", at_once)
    return _frames(files.load(root), fps)


def colours(frames: DataFrame, decode: Callable[[bytes], np.ndarray] = pnm, measure: Callable[[np.ndarray], np.ndarray] | None = None, width: int | None = None) -> DataFrame:
    """(video_id, estimator_id, frame_idx, r, g, b, last, error) of frames: measure(image) gives (estimators, 3) colours, by default the image's mean.

    width: images are brought to it first. An image that can't be decoded, or a frame without a number, is one row with an error; an end is one row.
    """
    take = measure or (lambda x: np.add.reduce(x.reshape(-1, 3), 0, np.int64)[None] / (x.size // 3))

    def run(parts):
        for b in batches.pieces(parts, 64):
            out = []
            for video, idx, content, last in zip(*(b.column(c) for c in ("video_path", "frame_idx", "content", "last")), strict=True):
                video, idx = video.as_py(), idx.as_py()
                if last.as_py():
                    out.append((video, None, None, None, None, None, True, None))
                    continue
                try:
                    if idx is None:
                        raise ValueError("no number in the name")
                    x = decode(content.as_py())
                    rgb = np.asarray(take(to_width(x, width) if width else x), float)
                    out += [(video, k, idx, *map(float, c), False, None) for k, c in enumerate(rgb)]
                except Exception as e:  # noqa: BLE001 - kept as a row
                    out.append((video, None, idx, None, None, None, False, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_pylist([dict(zip(_COLOURS.names, row, strict=True)) for row in out], schema=_COLOURS)

    rows = frames.select("video_path", F.col("frame_idx").cast("long").alias("frame_idx"), "content", "last")
    return rows.mapInArrow(run, "video_id string, estimator_id int, frame_idx long, r double, g double, b double, last boolean, error string")
