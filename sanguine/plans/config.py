"""Job specifications: INI text to typed, immutable settings. Values are literals; nothing is evaluated as code."""

from __future__ import annotations

import ast
import configparser
from dataclasses import dataclass, field


class SpecError(ValueError):
    """An unknown key, a missing section or a bad value."""


@dataclass(frozen=True)
class Step:
    """A filter with its parameters."""

    name: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class MethodSpec:
    name: str
    params: dict = field(default_factory=dict)
    pre: tuple[Step, ...] = ()
    post: tuple[Step, ...] = ()


@dataclass(frozen=True)
class JobSpec:
    dataset: str
    video_dir: str
    signal_dir: str
    videos: tuple[int, ...] | None
    window: float
    stride: float
    approach: str
    methods: tuple[MethodSpec, ...]
    min_hz: float = 0.65
    max_hz: float = 4.0
    estimate: str = "holistic"
    movement_thrs: tuple[float, ...] | None = None
    rgb_low: float = 75.0
    rgb_high: float = 230.0
    skin_low: float = 75.0
    skin_high: float = 230.0
    extra: dict = field(default_factory=dict)

    @property
    def thresholds(self) -> dict[str, float] | None:
        """Motion thresholds by axis."""
        return dict(zip("xyz", self.movement_thrs, strict=True)) if self.movement_thrs else None


#: Keys of each section; a key outside is an error.
KEYS = {
    "DATASET": {"dataset", "path", "videodataDIR", "BVPdataDIR", "videoIdx"},
    "SIG": {"winSize", "stride", "method", "approach", "skin_extractor", "landmarks_list", "patch_size", "cuda", "tot_sec", "fps", "videoIdx", "patches"},
    "BVP": {"methods", "sig_color_low_threshold", "sig_color_high_threshold", "skin_color_low_threshold", "skin_color_high_threshold"},
    "BPM": {"estimate", "type", "minHz", "maxHz", "movement_thrs", "wsize", "winSize"},
}
METHOD_KEYS = {"path", "name", "device_type", "params", "pre_filtering", "post_filtering"}
FILTER_KEYS = {"path", "name", "params"}


def _value(text: str):
    text = text.strip()
    if text in ("", "None"):
        return None
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def parse(text: str) -> JobSpec:
    """A specification in the `estimate` dialect; `type` is taken as its alias (welch: holistic or median by approach)."""
    ini = configparser.ConfigParser(interpolation=None, inline_comment_prefixes=("#", ";"))
    ini.optionxform = str
    try:
        ini.read_string(text)
    except configparser.Error as e:
        raise SpecError(str(e)) from e
    for s in ("DATASET", "SIG", "BVP", "BPM"):
        if s not in ini:
            raise SpecError(f"section {s} is missing")
        if bad := set(ini[s]) - KEYS[s]:
            raise SpecError(f"unknown keys in {s}: {', '.join(sorted(bad))}")
    v = {s: {k: _value(x) for k, x in ini[s].items()} for s in ini.sections()}

    def steps(names, owner) -> tuple[Step, ...]:
        out = []
        for name in names or ():
            if name not in v:
                raise SpecError(f"{owner} names filter {name}, which has no section")
            if bad := set(v[name]) - FILTER_KEYS:
                raise SpecError(f"unknown keys in {name}: {', '.join(sorted(bad))}")
            if v[name].get("path"):
                raise SpecError(f"filter {name}: code is not loaded from paths; register it by name")
            out.append(Step(v[name].get("name") or name, v[name].get("params") or {}))
        return tuple(out)

    methods = []
    for name in v["BVP"].get("methods") or ():
        own = v.get(name, {})
        if bad := set(own) - METHOD_KEYS:
            raise SpecError(f"unknown keys in {name}: {', '.join(sorted(bad))}")
        if own.get("path"):
            raise SpecError(f"method {name}: code is not loaded from paths; register it by name")
        methods.append(MethodSpec(own.get("name") or name, own.get("params") or {}, steps(own.get("pre_filtering"), name), steps(own.get("post_filtering"), name)))
    d, s, b, p = v["DATASET"], v["SIG"], v["BVP"], v["BPM"]
    approach = s.get("approach") or s.get("method") or "holistic"
    estimate = p.get("estimate") or {"clustering": "clustering"}.get(p.get("type"), "holistic" if approach == "holistic" else "median")
    if estimate not in ("holistic", "median", "clustering"):
        raise SpecError(f"estimate {estimate}: holistic, median or clustering")
    idx = d.get("videoIdx", s.get("videoIdx"))
    thrs = p.get("movement_thrs")
    if thrs is not None and not (isinstance(thrs, (list, tuple)) and len(thrs) == 3 and all(isinstance(x, (int, float)) for x in thrs)):
        raise SpecError(f"movement_thrs {thrs}: three numbers, for x, y and z")
    return JobSpec(
        dataset=str(d.get("dataset")), video_dir=str(d.get("videodataDIR") or ""), signal_dir=str(d.get("BVPdataDIR") or ""), videos=None if idx in (None, "all") else tuple(idx), window=float(s.get("winSize") or 8), stride=float(s.get("stride") or 1), approach=approach, methods=tuple(methods),
        min_hz=float(p.get("minHz") or 0.65), max_hz=float(p.get("maxHz") or 4.0), estimate=estimate, movement_thrs=tuple(thrs) if thrs else None,
        rgb_low=float(b.get("sig_color_low_threshold") or 75), rgb_high=float(b.get("sig_color_high_threshold") or 230), skin_low=float(b.get("skin_color_low_threshold") or 75), skin_high=float(b.get("skin_color_high_threshold") or 230), extra={k: x for k, x in s.items() if k not in ("winSize", "stride")},
    )
