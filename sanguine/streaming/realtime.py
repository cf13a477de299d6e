"""Live traces by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bvp, dsp
from ..operators.pulse import FILTERS, ArrayFunction

#: numpy forms of the filters that are column functions in a batch plan.
_BLOCKS = {"zeromean": lambda x: x - x.mean(1, keepdims=True), "zscore": lambda x: (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)}


#: Windows of a video that are worked out at once.
BLOCK = 256


@dataclass(frozen=True)
class Live:
    """Settings of a live query; frames in, a rate each `stride` seconds once a window is full."""

    fps: float = 30.0
    window: float = 6.0
    stride: float = 1.0
    method: str = "CHROM"
    min_hz: float = 0.7
    max_hz: float = 3.0
    filter_signal: bool = True
    #: Estimators with a frame that is all darker or all brighter are left out of a window.
    gate: tuple[float, float] | None = None
    #: Registered filters (name, params) before and after the method, window by window; with any after it, filter_signal is off.
    pre: tuple[tuple[str, dict], ...] = ()
    post: tuple[tuple[str, dict], ...] = ()
    #: A video without frames for so long (processing time) ends, like `10 minutes`; None: never.
    idle: str | None = None


def kernel(name: str, fps: float, params: dict | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """A registered filter as a function of (rows, time); `adaptive` stands for the rate. A filter that is a column function only raises ValueError."""
    if name not in FILTERS:
        raise ValueError(f"no such filter: {name}; there are {', '.join(FILTERS)}")
    if name in _BLOCKS:
        return _BLOCKS[name]
    made = FILTERS[name](fps, {k: fps if v == "adaptive" else v for k, v in (params or {}).items()})
    if not isinstance(made, ArrayFunction):
        raise ValueError(f"the filter {name} has no form for streams")
    return made.function


def _milliseconds(span: str) -> int:
    n, unit = span.split()
    return int(float(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])


def rates(frames: DataFrame, live: Live = Live()) -> DataFrame:
    """(video_id, frame_idx, bpm) from a stream of (video_id, estimator_id, frame_idx, r, g, b), in order within a video.

    State: the last window's frames of each video, so it is bounded by window x estimators. Windows start at frames 0, stride,
    2 x stride and so on, as in the batch plan; the two give equal rates for equal input. A stream that is joined late begins
    with the first whole window. Frames of windows that were given out are left out when they come late. A row with `last` (a
    column that frames may have) ends its video, as does `idle` time without frames: its state goes, and frames that
    follow begin anew.
    """
    width, step = int(live.fps * live.window), max(1, int(live.fps * live.stride))
    video = frames.schema["video_id"].dataType.simpleString()
    fields = "frame_idx array<long>, estimator_id array<int>, r array<double>, g array<double>, b array<double>, next long"

    before, after = ([kernel(name, live.fps, params) for name, params in chain] for chain in (live.pre, live.post))

    def filtered(x: np.ndarray) -> np.ndarray:
        """(estimators, 3, time) through the filters before the method; of too short windows nothing is left."""
        try:
            for f in before:
                x = np.asarray(f(x.reshape(-1, x.shape[2])), float).reshape(x.shape)
        except ValueError:
            return x[:0]
        return x

    def many(x: np.ndarray, of: np.ndarray) -> dict[int, float]:
        """Rates by window of the signals (estimators of all windows, 3, time); of: the window of each."""
        if live.gate:
            keep = ~((x.max(1) < live.gate[0]) | (x.min(1) > live.gate[1])).any(1)
            x, of = x[keep], of[keep]
        x = filtered(x)
        if not len(x):
            return {}
        n = len(x)
        x = bvp.extract(live.method, x, live.fps)
        of = np.repeat(of, len(x) // n)
        x, of = (y[keep] for keep in [~np.isnan(x).any(1)] for y in (x, of))
        try:
            for f in after if len(x) else ():
                x = np.asarray(f(x), float)
        except ValueError:
            return {}
        x, of = (y[keep] for keep in [~np.isnan(x).any(1)] for y in (x, of))
        if live.filter_signal and not after and len(x) and x.shape[1] > 39:
            x = dsp.bandpass(x, live.fps, live.min_hz, live.max_hz)
        if not len(x):
            return {}
        freqs, power = dsp.welch(x, live.fps, live.min_hz, live.max_hz)
        best = freqs[power.argmax(1)]
        order = np.argsort(of, kind="stable")
        windows, at = np.unique(of[order], return_index=True)
        return {int(w): float(np.median(r)) for w, r in zip(windows, np.split(best[order], at[1:]), strict=True)}

    def rated(held: pd.DataFrame, starts: np.ndarray) -> dict[int, float]:
        """Rates by number of the windows that begin at these frames; an estimator without all its frames is left out of a window."""
        order = np.lexsort((held["frame_idx"].to_numpy(), held["estimator_id"].to_numpy()))
        frame, who, rgb = (held[c].to_numpy()[order] for c in ("frame_idx", "estimator_id", ["r", "g", "b"]))
        out = {}
        edges = np.append(np.flatnonzero(np.append(True, who[1:] != who[:-1])), len(who))
        for k in range(0, len(starts), BLOCK):
            some, x, of = starts[k : k + BLOCK], [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                first, end = (lo + np.searchsorted(frame[lo:hi], s) for s in (some, some + width))
                whole = np.flatnonzero(end - first == width)
                x.append(rgb[first[whole][:, None] + np.arange(width)].astype(float).transpose(0, 2, 1))
                of.append(whole)
            if sum(map(len, of)):
                out |= {k + w: bpm for w, bpm in many(np.concatenate(x), np.concatenate(of)).items()}
        return out

    def update(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        every = pd.concat(list(parts))
        ended = bool(every["last"].any())
        new = every.loc[~every["last"], ["frame_idx", "estimator_id", "r", "g", "b"]]
        if not len(new) and not state.exists:
            return
        start = -1 if not len(new) else -(-int(new["frame_idx"].min()) // step) * step
        if state.exists:
            *cols, start = state.get
            new = pd.concat([pd.DataFrame(dict(zip(["frame_idx", "estimator_id", "r", "g", "b"], cols, strict=True))), new])
        last, out = int(new["frame_idx"].max()) if len(new) else -1, []
        starts = np.arange(start, last - width + 2, step)
        if len(starts):
            found = rated(new, starts)
            out = [(key[0], int(starts[k]) + width - 1, found[k]) for k in sorted(found)]
            start = int(starts[-1]) + step
        if ended:
            if state.exists:
                state.remove()
            yield pd.DataFrame(out, columns=["video_id", "frame_idx", "bpm"])
            return
        kept = new[new["frame_idx"] >= start]
        if live.idle:
            state.setTimeoutDuration(_milliseconds(live.idle))
        state.update((*[kept[c].tolist() for c in ("frame_idx", "estimator_id", "r", "g", "b")], start))
        yield pd.DataFrame(out, columns=["video_id", "frame_idx", "bpm"])

    rows = frames.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("estimator_id").cast("int").alias("estimator_id"), *[F.col(c).cast("double").alias(c) for c in "rgb"], (F.coalesce("last", F.lit(False)) if "last" in frames.columns else F.lit(False)).alias("last"))
    rows = rows.filter("last OR (frame_idx IS NOT NULL AND estimator_id IS NOT NULL)")
    return rows.groupBy("video_id").applyInPandasWithState(update, f"video_id {video}, frame_idx long, bpm double", fields, "append", "ProcessingTimeTimeout" if live.idle else "NoTimeout")


def causal(frames: DataFrame, b: np.ndarray, a: np.ndarray, value: str = "value") -> DataFrame:
    """(video_id, estimator_id, frame_idx, value) of a stream's values through a causal filter, from frame 0 on and in order.

    The filter's delay line is the state, with the frames that came before one that is still missing; so the result is that of
    the whole signal, however the stream is cut. Frames that come again are left out. NULL values count as missing.
    """
    b, a = (np.asarray(x, float) / a[0] for x in (b, a))
    types = {f.name: f.dataType.simpleString() for f in frames.schema}

    def update(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        line, at, frame, waiting = state.get if state.exists else ([0.0] * (len(a) - 1), 0, [], [])
        frames_, values = [np.array(frame, np.int64)], [np.array(waiting, float)]
        for pdf in parts:
            new = pdf["frame_idx"].to_numpy() >= at
            frames_.append(pdf["frame_idx"].to_numpy()[new])
            values.append(pdf["value"].to_numpy(float)[new])
        # the first of rows of one frame counts
        held, first = np.unique(np.concatenate(frames_), return_index=True)
        value = np.concatenate(values)[first]
        gaps = np.flatnonzero(held != at + np.arange(len(held)))
        n = int(gaps[0]) if len(gaps) else len(held)
        ready = value[:n]
        y, line = dsp.lfilter_on(b, a, ready[None], np.array([line], float))
        at += n
        state.update((line[0].tolist(), at, held[n:].tolist(), value[n:].tolist()))
        yield pd.DataFrame({"video_id": [key[0]] * len(ready), "estimator_id": [key[1]] * len(ready), "frame_idx": range(at - len(ready), at), "value": y[0]})

    rows = frames.select("video_id", "estimator_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col(value).cast("double").alias("value")).filter("value IS NOT NULL AND frame_idx IS NOT NULL")
    keys = f"video_id {types['video_id']}, estimator_id {types['estimator_id']}"
    fields = "line array<double>, at long, frame array<long>, waiting array<double>"
    return rows.groupBy("video_id", "estimator_id").applyInPandasWithState(update, f"{keys}, frame_idx long, value double", fields, "append", "NoTimeout")


def event_windows(events: DataFrame, window: str = "6 seconds", stride: str = "1 second", late: str = "2 seconds", time: str = "ts", keys: tuple[str, ...] = ("video_id",), value: str = "value") -> DataFrame:
    """Event-time sliding means with a watermark for late rows; epoch-aligned, an extension beside the frame-counted windows."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(*keys, F.window(time, window, stride).alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n")


def preview(frames: DataFrame, every: int = 4) -> DataFrame:
    """Each fourth frame, for display."""
    return frames.filter(F.col("frame_idx") % every == every - 1)
