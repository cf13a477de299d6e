"""Filters, pulse methods, spectra and rates over windowed signals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import arrays as A
from ..functions import batches, bvp, circle, dsp
from ..functions.arrays import let


def _by_length(series: pd.Series):
    """(positions, stacked arrays) of the series' arrays, a length at a time, so that numpy works on whole blocks."""
    sizes = series.map(lambda a: -1 if a is None else len(a)).to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        if n >= 0:
            yield at, np.stack([np.asarray(series.iloc[k], float) for k in at]) if n else np.zeros((len(at), 0))


class ArrayFunction:
    """A numpy function over (rows, time) for columns array<double>. Signals that are too short for it give NULL."""

    def __init__(self, function):
        self.function = function

    def _run(self, column: pa.Array) -> pa.Array:
        out = []
        for at, block in batches.blocks(column):
            try:
                got = self.function(block)
                if len(got) != len(at):
                    continue
                if isinstance(got, np.ndarray) and got.ndim == 2:
                    out.append((at, got))
                else:
                    out += [(at[k : k + 1], np.asarray(row, float)[None]) for k, row in enumerate(got) if row is not None]
            except ValueError:
                continue
        return batches.lists(len(column), out)

    def over(self, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        """rows with new columns: name -> the column it is made from. A stage of its own, so that what comes before stays in the JVM; a few rows are in work at a time."""
        kept = [f for f in rows.schema if f.name not in columns]
        order = [f.name for f in rows.schema] + [c for c in columns if c not in rows.columns]
        types = {f.name: f.dataType.simpleString() for f in kept} | {c: "array<double>" for c in columns}

        def run(parts):
            for b in batches.pieces(parts):
                made = {name: self._run(b.column(c)) for name, c in columns.items()}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c) for c in order], names=order)

        return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in order))


def bandpass(fps: float, low: float = 0.65, high: float = 4.0, order: int = 6):
    return ArrayFunction(lambda x: dsp.bandpass(x, fps, low, high, order))


def causal_bandpass(fps: float = 30.0, low: float = 0.8, high: float = 6.0, order: int = 4):
    return ArrayFunction(lambda x: dsp.lfilter(*dsp.butter_bandpass(low, high, fps, order), x))


def detrend(det_lambda: float = 10.0, absolute: bool = False):
    return ArrayFunction(lambda x: dsp.detrend(x, det_lambda, absolute))


def notched(rows: DataFrame, fps: float, column: str = "bvp", centre: str = "centre", q: float = 10.0) -> DataFrame:
    """rows with the signal through a causal notch at its own centre (Hz, a column), all rows of a length at once. A centre that is NULL, or not between 0 and fps / 2, leaves the signal as it is."""

    def run(batches):
        for pdf in batches:
            out = pdf[column].tolist()
            hz = pdf[centre].to_numpy(float)
            for at, x in _by_length(pdf[column]):
                with np.errstate(invalid="ignore"):
                    use = (hz[at] > 0) & (hz[at] < fps / 2)
                if use.any():
                    for k, y in zip(at[use], dsp.lfilter_rows(*dsp.notch(hz[at][use], q, fps), x[use]), strict=True):
                        out[k] = y
            yield pdf.assign(**{column: pd.Series(out, dtype=object, index=pdf.index)})

    return rows.mapInPandas(run, rows.withColumn(column, F.col(column).cast("array<double>")).schema)


def notch_response(centre: Column, freqs: list[float], fps: float, q: float = 10.0) -> Column:
    """Gains of a notch at `centre` (Hz) at the frequencies (Hz); 0 at the centre, near 1 away from it."""
    w0 = centre * (2 * np.pi / fps)
    p = F.struct(F.cos(w0).alias("c"), (1 / (1 + F.tan(w0 / (2 * q)))).alias("g"))

    def gain(p: Column, w: Column) -> Column:
        # numerator and denominator turned by one sample, so that both are sums of cosines and one sine
        re, im = 2 * p["g"] * F.cos(w) - 2 * p["g"] * p["c"], (2 - 2 * p["g"]) * F.sin(w)
        return F.abs(2 * p["g"] * (F.cos(w) - p["c"])) / F.sqrt(re * re + im * im)

    table = A.constants([2 * np.pi * float(f) / fps for f in freqs])
    return let(p, lambda p: F.transform(table, lambda w: gain(p, w)))


def sg_detrend(window: int = 31, degree: int = 5):
    return ArrayFunction(lambda x: x - dsp.savgol(x, window, degree))


#: Filters by name: (fps, params) -> a function of a column.
FILTERS = {
    "BPfilter": lambda fps, p: bandpass(fps, float(p.get("minHz", 0.65)), float(p.get("maxHz", 4.0)), int(p.get("order", 6))),
    "detrend": lambda fps, p: detrend(float(p.get("detLambda", 10))),
    "sg_detrend": lambda fps, p: sg_detrend(int(p.get("window_length", 31)), int(p.get("polyorder", 5))),
    "zeromean": lambda fps, p: A.zero_mean,
    "zscore": lambda fps, p: A.zscore,
}


def register_filter(name: str, make) -> None:
    """Adds a filter to the registry: make(fps, params) gives a function of an array column, or an ArrayFunction. Nothing is loaded from paths."""
    FILTERS[name] = make


def apply_filter(rows: DataFrame, name: str, fps: float, params: dict | None = None, columns: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """rows with the filter on each column; 'adaptive' stands for the rate and the caller's params are left alone."""
    params = {k: fps if v == "adaptive" else v for k, v in (params or {}).items()}
    if name not in FILTERS:
        raise ValueError(f"no such filter: {name}; there are {', '.join(FILTERS)}")
    f = FILTERS[name](fps, params)
    return f.over(rows, {c: c for c in columns}) if isinstance(f, ArrayFunction) else rows.withColumns({c: f(F.col(c)) for c in columns})


# --- methods that need no Python ---


def chrom(r: Column, g: Column, b: Column) -> Column:
    """NULL where the second signal is constant."""
    u, v = A.combine((3.0, r), (-2.0, g)), A.combine((1.5, r), (1.0, g), (-1.5, b))

    def out(p: Column) -> Column:
        a = F.try_divide(A.std(p["u"]), A.std(p["v"]))
        return let(a, lambda k: F.when(k.isNotNull(), F.zip_with(p["u"], p["v"], lambda x, y: x - k * y)))

    return let(F.struct(u.alias("u"), v.alias("v")), out)


def omit(r: Column, g: Column, b: Column) -> Column:
    """Green without the first sample's direction; NULL where that sample is black."""
    first = [F.get(c, F.lit(0)) for c in (r, g, b)]
    norm = first[0] * first[0] + first[1] * first[1] + first[2] * first[2]

    def out(w: Column) -> Column:
        return F.when(w["r"].isNotNull(), A.combine((w["r"], r), (w["g"], g), (w["b"], b)))

    return let(F.struct(*[(F.lit(1.0 if n == "g" else 0.0) - F.try_divide(first[1] * x, norm)).alias(n) for n, x in zip("rgb", first, strict=True)]), out)


def pbv(r: Column, g: Column, b: Column) -> Column:
    """By Cramer's rule on the 3 x 3 products of the channels over their means; NULL where singular."""

    def over_mean(c: Column) -> Column:
        return let(A.mean(c), lambda m: F.transform(c, lambda x: F.try_divide(x, m)))

    scaled = F.struct(*[over_mean(c).alias(n) for n, c in zip("rgb", (r, g, b), strict=True)])

    def solve(c: Column) -> Column:
        products = F.struct(*[A.dot(c[x], c[y]).alias(x + y) for x, y in ("rr", "rg", "rb", "gg", "gb", "bb")], *[A.std(c[x]).alias(f"s{x}") for x in "rgb"])

        def weights(m: Column) -> Column:
            q = [[m["rr"], m["rg"], m["rb"]], [m["rg"], m["gg"], m["gb"]], [m["rb"], m["gb"], m["bb"]]]
            norm = F.sqrt(m["sr"] * m["sr"] + m["sg"] * m["sg"] + m["sb"] * m["sb"])
            p = [F.try_divide(m[f"s{x}"], norm) for x in "rgb"]

            def det(a):
                return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

            w = [F.try_divide(det([[p[i] if k == j else q[i][k] for k in range(3)] for i in range(3)]), det(q)) for j in range(3)]
            scale = p[0] * w[0] + p[1] * w[1] + p[2] * w[2]
            return F.struct(*[F.try_divide(x, scale).alias(n) for n, x in zip("rgb", w, strict=True)])

        return let(let(products, weights), lambda w: F.when(w["r"].isNotNull(), A.combine((w["r"], c["r"]), (w["g"], c["g"]), (w["b"], c["b"]))))

    return let(scaled, solve)


NATIVE = {"GREEN": lambda r, g, b: g, "CHROM": chrom, "OMIT": omit, "PBV": pbv}
#: Those that read each sample once or twice.
LIGHT = ("GREEN", "OMIT")


def _signals_of(method, r: pa.Array, g: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, output, signal) of a numpy method, block by block of equal lengths; signals with NaN are left out."""

    def signals(block: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(first trace, (traces, outputs, time)) of the block's parts that can be done."""
        try:
            got = method(block)
            return [(0, got.reshape(len(block), -1, got.shape[-1]))]
        except np.linalg.LinAlgError:  # some trace of the block is singular: by halves, without it
            half = len(block) // 2
            return signals(block[:half]) + [(k + half, x) for k, x in signals(block[half:])] if half else []

    others, parts = [{x.shape[1]: (at, x) for at, x in batches.blocks(c)} for c in (g, b)], []
    for at, x in batches.blocks(r):
        own = [o.get(x.shape[1], (at[:0], x[:0])) for o in others]
        if not all(np.array_equal(at, there) for there, _ in own):
            if not all(np.isin(at, there).all() for there, _ in own):
                raise ValueError("a window's channels differ in length")
            own = [(at, y[np.searchsorted(there, at)]) for there, y in own]
        for k, got in signals(np.stack([x, *(y for _, y in own)], 1)):
            trace, output = np.nonzero(~np.isnan(got).any(2))
            parts.append((at[k + trace], output, got[trace, output]))
    of, output = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, int) for k in (0, 1))
    order = np.lexsort((output, of))
    place = np.empty(len(of), int)
    place[order] = np.arange(len(of))
    ends = np.cumsum([0, *(len(p[0]) for p in parts)])
    return of[order], output[order].astype(np.int32), batches.lists(len(of), [(place[a:z], p[2]) for a, z, p in zip(ends[:-1], ends[1:], parts, strict=True)])


def _method_stage(rows: DataFrame, rest: list[str], name: str, fps: float, component: str) -> DataFrame:
    """(rest, output, bvp) of a numpy method."""
    method = bvp.method(name, fps, component)  # looked up here: a task doesn't know what was registered

    def run(parts):
        for b in batches.pieces(parts):
            of, output, made = _signals_of(method, *(b.column(c) for c in "rgb"))
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in rest), pa.array(output), made], names=[*rest, "output", "bvp"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*rest, "r", "g", "b").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in rest) + ", output int, bvp array<double>")


class Chain(NamedTuple):
    """A method with the filters before it (of each channel) and after it."""

    name: str
    before: list[ArrayFunction]
    method: Callable
    after: list[ArrayFunction]


def chain(method: str, fps: float, component: str = "second_comp", before=(), after=()) -> Chain | None:
    """before, after: filters as (name, params). None where a filter is a column function, which no task can apply."""
    steps = [[FILTERS[name](fps, {k: fps if v == "adaptive" else v for k, v in p.items()}) if name in FILTERS else None for name, p in own] for own in (before, after)]
    if not all(isinstance(f, ArrayFunction) for own in steps for f in own):
        return None
    return Chain(bvp.plain_name(method), steps[0], bvp.method(method, fps, component), steps[1])


def measured(windows: DataFrame, chains: list[Chain], fps: float, values: dict[str, Callable]) -> DataFrame:
    """(..., output, method, values) of all chains' valid signals, in one pass over the windows; the signals don't leave their task.

    values: name -> function of signals (rows, time) and of a batch's columns by name at those rows, giving a number a row; NaN is NULL,
    as are the numbers of signals that are too short for it.
    """
    rest = [c for c in windows.columns if c not in "rgb"]

    def run(parts):
        for b in batches.pieces(parts):
            for c in chains:
                traces = [b.column(x) for x in "rgb"]
                for f in c.before:
                    traces = [f._run(x) for x in traces]
                of, output, made = _signals_of(c.method, *traces)
                for f in c.after:
                    made = f._run(made)
                got, valid = {name: np.full(len(of), np.nan) for name in values}, np.zeros(len(of), bool)
                for at, x in batches.blocks(made):
                    good = ~np.isnan(x).any(1)
                    at, x = at[good], x[good]
                    valid[at] = True
                    for name, f in values.items():
                        try:
                            got[name][at] = f(x, lambda column, rows=of[at]: b.column(column).take(pa.array(rows)))
                        except ValueError:
                            continue
                of, take = of[valid], pa.array(of[valid])
                numbers = [pa.array(got[name][valid], from_pandas=True) for name in values]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in rest), pa.array(output[valid]), pa.array([c.name] * len(of), pa.string()), *numbers], names=[*rest, "output", "method", *values])

    types = {f.name: f.dataType.simpleString() for f in windows.schema}
    return windows.select(*rest, "r", "g", "b").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in rest) + ", output int, method string, " + ", ".join(f"`{v}` double" for v in values))


def _rows_of(column: pa.Array):
    for at, block in batches.blocks(column):
        yield from zip(at, block, strict=True)


def to_bvp(windows: DataFrame, method: str, fps: float, component: str = "second_comp", native: bool | None = None) -> DataFrame:
    """(..., method, bvp): the windows' pulse signals; signals with NaN are dropped. Methods with several outputs give rows of their own, told by `output`.

    native: by built-in functions, where the method has such a form; by default those of a few passes have it, since
    functions of arrays cost more than numpy's blocks from then on.
    """
    name = bvp.plain_name(method)
    rest = [c for c in windows.columns if c not in "rgb"]
    if name in (LIGHT if native is None else NATIVE if native else ()):
        # generated, not projected and filtered: the signal is worked out once
        one = F.filter(F.array(NATIVE[name](F.col("r"), F.col("g"), F.col("b"))), lambda x: x.isNotNull() & ~A.has_nan(x))
        return windows.select(*rest, F.lit(0).alias("output"), F.explode(one).alias("bvp")).withColumn("method", F.lit(name))
    out = _method_stage(windows, rest, name, fps, component)
    return out.withColumn("method", F.lit(name))


def united(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Signals of several methods as estimators of one; all have to cover the same windows with the same lengths, else ValueError."""
    both = first
    for o in others:
        both = both.unionByName(o)
    _same_shape(both, 1 + len(others))
    return both


_DIFFER = "the methods differ in windows or in lengths"


def _odd_shapes(both: DataFrame, methods: int) -> DataFrame:
    shapes = both.groupBy("video_id", "win_idx").agg(F.count_distinct("method").alias("methods"), F.count_distinct(F.size("bvp")).alias("sizes"))
    return shapes.filter((F.col("methods") != methods) | (F.col("sizes") > 1))


def _same_shape(both: DataFrame, methods: int) -> None:
    if _odd_shapes(both, methods).limit(1).count():
        raise ValueError(_DIFFER)


def united_methods(windows: DataFrame, methods: list[str], fps: float) -> DataFrame:
    """united over built-in methods of the same windows (each once by its name), which are made once for all: each window gives its methods' rows.

    The shapes are checked within the plan of the rows, from the same shuffle of frames; where they differ, the rows' job fails.
    """
    names = [bvp.plain_name(m) for m in methods]
    if rest := [n for n in names if n not in NATIVE]:
        raise ValueError(f"no built-in form: {', '.join(rest)}")
    keys = [c for c in windows.columns if c not in "rgb"]
    each = F.array(*[F.struct(F.lit(0).alias("output"), NATIVE[n](F.col("r"), F.col("g"), F.col("b")).alias("bvp"), F.lit(n).alias("method")) for n in names])
    rows = windows.select(*keys, F.explode(F.filter(each, lambda x: x["bvp"].isNotNull() & ~A.has_nan(x["bvp"]))).alias("x")).select(*keys, "x.*")
    odd = _odd_shapes(rows, len(set(names))).agg(F.count("*").alias("__odd"))
    same = F.when(F.col("__odd") > 0, F.raise_error(F.lit(_DIFFER)).cast("boolean")).otherwise(F.lit(True))
    return rows.crossJoin(F.broadcast(odd)).filter(same).drop("__odd")


def pos_by_windows(frames: DataFrame, fps: float, keys: tuple[str, ...]) -> DataFrame:
    """POS in two window passes over frame_idx, without Python: (keys, frame_idx, h). Equal to the overlap-added form but for its 1e-9 terms."""
    w = int(1.6 * fps)
    own = Window.partitionBy(*keys).orderBy("frame_idx")
    past, future = own.rowsBetween(-(w - 1), 0), own.rowsBetween(0, w - 1)
    rows = frames.select(*keys, "frame_idx", *[F.col(c).cast("double").alias(c) for c in "rgb"])
    rows = rows.select("*", *[F.avg(c).over(past).alias(f"m{c}") for c in "rgb"], *[F.avg(F.col(x) * F.col(y)).over(past).alias(f"{x}{y}") for x, y in ("rr", "rg", "rb", "gg", "gb", "bb")])
    s = {x + y: F.try_divide(F.col(x + y), F.col(f"m{x}") * F.col(f"m{y}")) - 1 for x, y in ("rr", "rg", "rb", "gg", "gb", "bb")}
    v1 = s["gg"] + s["bb"] - 2 * s["gb"]
    v2 = 4 * s["rr"] + s["gg"] + s["bb"] - 4 * s["rg"] - 4 * s["rb"] + 2 * s["gb"]
    alpha = F.try_divide(F.sqrt(F.greatest(v1, F.lit(0.0))), F.sqrt(F.greatest(v2, F.lit(0.0))))
    full = F.col("frame_idx") >= w
    rows = rows.withColumn("a", alpha)
    terms = {"kr": F.try_divide(-2 * F.col("a"), F.col("mr")), "kg": F.try_divide(1 + F.col("a"), F.col("mg")), "kb": F.try_divide(F.col("a") - 1, F.col("mb")), "k1": F.lit(0.0) * F.col("a")}
    rows = rows.withColumns({k: F.when(full, c) for k, c in terms.items()})
    h = sum((F.coalesce(F.sum(f"k{c}").over(future), F.lit(0.0)) * F.col(c) for c in "rgb"), F.lit(0.0))
    return rows.select(*keys, "frame_idx", h.alias("h"))


# --- spectra and rates ---


def band_freqs(fps: float, low: float = 0.65, high: float = 4.0, nfft: int = 2048) -> np.ndarray:
    """BPM of the bins that psd gives, the same for all rows."""
    return dsp.welch(np.zeros((1, 64)), fps, low, high, nfft)[0]


def psd(bvps: DataFrame, fps: float, low: float = 0.65, high: float = 4.0, nfft: int = 2048, overlap: float = 0.8) -> DataFrame:
    """bvps with `power`, the Welch density of the bins in the band (overlap 0.6 for parity with the older convention)."""
    return ArrayFunction(lambda x: dsp.welch(x, fps, low, high, nfft, overlap)[1]).over(bvps, {"power": "bvp"})


def dft_power(bvps: DataFrame, n: int, bins: list[int], column: str = "bvp") -> DataFrame:
    """bvps with `power`, |X(k)|^2 of signals of n samples at the bins: one matrix product for all rows of an Arrow batch."""
    turn = 2 * np.pi * np.outer(np.arange(n), bins) / n
    return ArrayFunction(lambda x: (x @ np.cos(turn)) ** 2 + (x @ np.sin(turn)) ** 2).over(bvps, {"power": column})


def strongest(power: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """The rate of each row's strongest bin, the first of equals; bins without a number count for nothing, NaN where none has one."""
    known = np.where(np.isnan(power), -np.inf, power)
    return np.where(np.isnan(power).all(1), np.nan, freqs[known.argmax(1)])


def spectrum_values(bvps: DataFrame, fps: float, values: dict[str, Callable], low: float = 0.65, high: float = 4.0, nfft: int = 2048, overlap: float = 0.8) -> DataFrame:
    """bvps with a number for each of values, functions of psd's densities (rows, bins), instead of the signal: only the numbers leave the task. NaN is NULL."""
    rest = [c for c in bvps.columns if c != "bvp"]

    def run(parts):
        for b in batches.pieces(parts):
            got = {name: np.full(b.num_rows, np.nan) for name in values}
            for at, x in batches.blocks(b.column("bvp")):
                try:
                    power = dsp.welch(x, fps, low, high, nfft, overlap)[1]
                except ValueError:  # too short
                    continue
                for name, f in values.items():
                    got[name][at] = f(power)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(x, from_pandas=True) for x in got.values())], names=[*rest, *values])

    types = {f.name: f.dataType.simpleString() for f in bvps.schema}
    return bvps.select(*rest, "bvp").mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in rest), *(f"`{v}` double" for v in values)]))


def psd_rates(bvps: DataFrame, fps: float, low: float = 0.65, high: float = 4.0, overlap: float = 0.8) -> DataFrame:
    """rates(psd(bvps)) without the signals and spectra."""
    freqs = band_freqs(fps, low, high)
    return spectrum_values(bvps, fps, {"bpm": lambda p: strongest(p, freqs)}, low, high, overlap=overlap)


def rates(spectra: DataFrame, freqs: np.ndarray) -> DataFrame:
    """spectra with `bpm`: the rate of the strongest bin, the first of equals."""
    table = F.array(*[F.lit(float(f)) for f in freqs])
    return spectra.withColumn("bpm", F.get(table, A.arg_max(F.col("power"))))


def summed_spectra(spectra: DataFrame, column: str = "power", keys: tuple[str, ...] = ("win_idx",)) -> DataFrame:
    """(keys, k, power): squares summed over the estimators by bin, over the largest of the window's bins."""
    bins = spectra.select(*keys, F.posexplode(column).alias("k", "x")).groupBy(*keys, "k").agg(F.sum(F.col("x") * F.col("x")).alias("__p"))
    return bins.select(*keys, "k", F.try_divide("__p", F.max("__p").over(Window.partitionBy(*keys))).alias("power"))


def loudest(spectra: DataFrame, column: str = "power", keys: tuple[str, ...] = ("win_idx",)) -> DataFrame:
    """(keys, estimator_id) of the largest value in each window; the smallest id of equals."""
    return spectra.groupBy(*keys).agg(F.max_by("estimator_id", F.struct(F.array_max(column), -F.col("estimator_id"))).alias("estimator_id"))


def median_rates(bpms: DataFrame, keys: tuple[str, ...] = ("video_id", "method", "win_idx", "t_center")) -> DataFrame:
    """(keys, bpm, mad): the estimators' median and unscaled median deviation."""
    rows = bpms.groupBy(*keys).agg(F.sort_array(F.collect_list("bpm")).alias("__all"))
    return rows.select(*keys, A.median(F.col("__all")).alias("bpm"), A.mad(F.col("__all")).alias("mad"))


def attenuated(spectra: DataFrame, motion: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """spectra times the attenuation of each axis whose energy in the window is over its threshold. motion: (video_id, win_idx, axis, atten, energy)."""
    out = spectra
    for axis, limit in thresholds.items():
        own = motion.filter((F.col("axis") == axis) & (F.col("energy") > limit)).select("video_id", "win_idx", F.col("atten").alias("__a"))
        out = out.join(own, ["video_id", "win_idx"], "left").withColumn("power", F.when(F.col("__a").isNull(), F.col("power")).otherwise(F.zip_with("power", "__a", lambda p, a: p * a))).drop("__a")
    return out


#: Rows that a window's matrix of spectra begins with; it is doubled.
ROOM = 64


def clustered_rates(spectra: DataFrame, freqs: np.ndarray, reach: int = 8, limit: float = 10.0, **options) -> DataFrame:
    """(video_id, method, win_idx, t_center, bpm, bpm0, bpm1): rates by bi-partition of a window's spectra, then adjusted along the video.

    A group is one window's estimators; the adjustment's group holds three numbers for each window of a video. The start
    of each window's clustering is seeded by (video, window), so results repeat.
    """
    options = {"by_variance": True} | options

    def one(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The group's batches are copied into one matrix as they come."""
        video, method, window, t = (k.as_py() for k in key)
        power, n = np.zeros((ROOM, len(freqs))), 0
        for b in batches.pieces(parts):
            got = np.stack([x for _, x in sorted(_rows_of(b.column("power")), key=lambda r: r[0])])
            while n + len(got) > len(power):
                power.resize((2 * len(power), len(freqs)), refcheck=False)
            power[n : n + len(got)] = got
            n += len(got)
        got = circle.estimate(power[:n], freqs, seed=_seed(video, window), **options)
        yield pa.RecordBatch.from_pylist([dict(zip(names, [video, method, window, t, *map(float, got)], strict=True))], schema=arrow)

    video = spectra.schema["video_id"].dataType.simpleString()
    schema = f"video_id {video}, method string, win_idx int, t_center double, bpm double, bpm0 double, bpm1 double"
    names = ["video_id", "method", "win_idx", "t_center", "bpm", "bpm0", "bpm1"]
    arrow = to_arrow_schema(spectra.sparkSession.createDataFrame([], schema).schema)
    rows = spectra.select("video_id", "method", F.col("win_idx").cast("int").alias("win_idx"), "t_center", F.col("power").cast("array<double>").alias("power"))
    ordered = rows.groupBy("video_id", "method", "win_idx", "t_center").applyInArrow(one, schema)

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("win_idx", ignore_index=True)
        return pdf.assign(bpm=circle.adjusted(pdf["bpm"], pdf["bpm0"], pdf["bpm1"], reach, limit))

    return ordered.groupBy("video_id", "method").applyInPandas(along, schema)


def _seed(video, window) -> int:
    import zlib

    return zlib.crc32(f"{video}|{int(window)}".encode())


def motion_filter(tracks: DataFrame, fps: float, low: float = 0.65, high: float = 4.0, notch_q: float | None = None) -> DataFrame:
    """(video_id, win_idx, axis, atten, energy) from windowed landmark tracks (video_id, win_idx, axis in y, x, z; track array).

    Band-passed tracks' densities; the first principal component over the landmarks (of z the density itself); attenuation
    1 - P / max P, energy the mean of P less its negative minimum. low and high bound the band, which has to be the spectra's.
    Rows may be whole groups instead, with `tracks`, an array of the group's tracks, for `track`; then nothing is shuffled.
    With notch_q the attenuation is that of a notch of this quality at the strongest bin of P, and z is centred like the others.
    """
    hz = band_freqs(fps, low, high) / 60

    def components(power: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Curves and energies of groups (groups, tracks, bins) of so many tracks each."""
        if notch_q and power.shape[1] == 1:
            p = power[:, 0] - power[:, 0].mean(1, keepdims=True)
            return p, (p - np.minimum(p.min(1, keepdims=True), 0.0)).mean(1)
        p = power.mean(1)
        energy = p.mean(1)
        if power.shape[1] > 1 and (flat := axes != "z").any():
            # the first component from the tracks' own products, a small matrix for each group
            c = power[flat] - power[flat].mean(2, keepdims=True)
            q = np.einsum("gtb,gt->gb", c, np.linalg.eigh(c @ c.transpose(0, 2, 1))[1][:, :, -1])
            q *= np.where(np.take_along_axis(q, np.abs(q).argmax(1)[:, None], 1) < 0, -1, 1)
            p[flat], energy[flat] = q, (q - np.minimum(q.min(1, keepdims=True), 0.0)).mean(1)
        return p, energy

    def run(parts):
        """All tracks of some groups are filtered at once, then parted by group again."""
        for b in batches.pieces(parts):
            groups = b.column("tracks")
            ends = groups.offsets.to_numpy()
            inner = groups.values.slice(ends[0], ends[-1] - ends[0])
            powers = np.full((len(inner), len(hz)), np.nan)
            for at, block in batches.blocks(inner):
                powers[at] = dsp.welch(dsp.bandpass(block, fps), fps, low, high, overlap=0.6)[1]
            starts, sizes, axes = ends[:-1] - ends[0], np.diff(ends), np.array(b.column("axis").to_pylist())
            curve, energy = np.zeros((b.num_rows, len(hz))), np.zeros(b.num_rows)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                curve[at], energy[at] = components(powers[starts[at][:, None] + np.arange(n)], axes[at])
            top = curve.max(1, keepdims=True)
            atten = batches.lists(b.num_rows, [(np.arange(b.num_rows), 1 - curve / np.where(top == 0, np.inf, top))] if notch_q is None else [])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), atten, pa.array(energy), pa.array(hz[curve.argmax(1)])], names=[*names, "atten", "energy", "centre"])

    names = ["video_id", "win_idx", "axis"]
    types = {f.name: f.dataType.simpleString() for f in tracks.schema}
    groups = tracks if "tracks" in tracks.columns else tracks.groupBy(*names).agg(F.sort_array(F.collect_list("track")).alias("tracks"))
    out = groups.select(*names, "tracks").mapInArrow(run, f"video_id {types['video_id']}, win_idx {types['win_idx']}, axis string, atten array<double>, energy double, centre double")
    if notch_q is not None:
        out = out.withColumn("atten", notch_response(F.col("centre"), hz.tolist(), fps, notch_q))
    return out.drop("centre")


def truth_rates(signals: DataFrame, window: float = 5.0, kind: str = "BVP") -> DataFrame:
    """(video_id, t, bpm) from whole ground-truth signals (video_id, fs, signal array): STFT track of a pulse, R peaks of an ECG."""

    def run(parts):
        for b in batches.pieces(parts, 64):
            rate, found, t, bpm = b.column("fs").to_numpy(zero_copy_only=False), [], [], []
            signals = [(int(k), np.array(x)) for k, x in _rows_of(b.column("signal"))]
            waves = {}
            for fs in {rate[k] for k, _ in signals} if kind != "BVP" else ():
                own = [(k, x) for k, x in signals if rate[k] == fs]
                waves |= dict(zip([k for k, _ in own], dsp.qrs_band([x for _, x in own], fs), strict=True))
            for k, x in signals:
                at, rates = dsp.stft_track(np.array(x), rate[k], window) if kind == "BVP" else dsp.heart_rate(dsp.r_peaks(x, rate[k], waves[k]), rate[k])
                found.append(np.full(len(at), k))
                t.append(np.asarray(at, float))
                bpm.append(np.asarray(rates, float))
            if found:
                of = pa.array(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([b.column("video_id").take(of), pa.array(np.concatenate(t)), pa.array(np.concatenate(bpm))], names=["video_id", "t", "bpm"])

    video = signals.schema["video_id"].dataType.simpleString()
    rows = signals.select("video_id", F.col("fs").cast("double").alias("fs"), F.col("signal").cast("array<double>").alias("signal"))
    return rows.mapInArrow(run, f"video_id {video}, t double, bpm double")


def rotation_pulse(correlations: DataFrame, fps: float) -> DataFrame:
    """(video_id, frame_idx, value) of the subspace rotation over each video's frame correlations (nine numbers a frame)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx", ignore_index=True)
        return pdf[["video_id", "frame_idx"]].assign(value=bvp.ssr(np.stack([np.reshape(c, (3, 3)) for c in pdf["c"]]), fps))

    video = correlations.schema["video_id"].dataType.simpleString()
    return correlations.groupBy("video_id").applyInPandas(one, f"video_id {video}, frame_idx int, value double")
