"""Segmentation parameters: defaults, unit-cube decoding, validation, features. Columns over u: array<double>."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.functions.scalar import decoded_choice, interpolated_window, quantised, window_diameter

#: The parameters a study starts from.
BASELINE = {
    "min_height": 2.0, "median_filter_size": 3, "lmf_low_height_limit": 10.0, "lmf_high_height_limit": 25.0,
    "lmf_low_window_size": 2.0, "lmf_mid_slope": 0.1, "lmf_mid_intercept": 0.3, "lmf_high_slope": 0.15,
    "lmf_high_intercept": 1.0, "watershed_connectivity": 8, "polygon_connectivity": 4,
}
#: Ranges of the search profiles (the jump of the third is the one in effect).
PROFILES = {
    "broad": {"low": (6, 14), "high": 32, "gap": 6, "window": (1, 3.5), "mid": 6, "jump": (0, 2), "slope": (0.03, 0.25), "median": (1, 3, 5), "connectivity": (4, 8)},
    "for-instance-refined-v2": {"low": (7, 15), "high": 40, "gap": 6, "window": (1.75, 2.5), "mid": 4.5, "jump": (0, 2), "slope": (0.03, 0.12), "median": (1,), "connectivity": (4,)},
    "ideas-als-small-windows-v2": {"low": (6, 14), "high": 36, "gap": 6, "window": (1, 2.75), "mid": 4, "jump": (0, 2), "slope": (0.01, 0.12), "median": (1, 3), "connectivity": (4,)},
}
SAMPLED_HEIGHTS = (2, 5, 10, 15, 20, 25, 30, 35, 40, 50)


def decode(candidates: DataFrame, profile: str = "broad") -> DataFrame:
    """Parameters of each unit-cube candidate (u[0] to u[7])."""
    p = PROFILES[profile]
    u = lambda k: F.get("u", F.lit(k))
    span = lambda k, lo, hi: lo + u(k) * (hi - lo)
    d = candidates.withColumn("low", quantised(span(0, *p["low"]), 0.25))
    least = F.greatest(F.lit(18.0), F.col("low") + p["gap"])
    d = d.withColumn("high", quantised(span(1, least, p["high"]), 0.25)).withColumn("w_low", quantised(span(2, *p["window"]), 0.25))
    d = d.withColumn("w_mid", quantised(span(3, F.col("w_low"), p["mid"]), 0.25))
    d = d.withColumn("jump", quantised(span(4, *p["jump"]), 0.25)).withColumn("s_high", quantised(span(5, *p["slope"]), 0.01))
    d = d.withColumn("s_mid", (F.col("w_mid") - F.col("w_low")) / (F.col("high") - F.col("low")))
    return d.withColumns({
        "i_mid": F.col("w_low") - F.col("s_mid") * F.col("low"),
        "i_high": F.col("w_mid") + F.col("jump") - F.col("s_high") * F.col("high"),
        "median": decoded_choice(u(6), list(p["median"])),
        "connectivity": decoded_choice(u(7), list(p["connectivity"])),
    })


def decode_flexible(candidates: DataFrame) -> DataFrame:
    """Pit filling, smoothing and a four-point window curve (u[0] to u[10])."""
    u = lambda k: F.get("u", F.lit(k))
    d = candidates.withColumn("pit_size", decoded_choice(u(0), [1, 3, 5]))
    d = d.withColumn("pit_depth", F.when(F.col("pit_size") == 1, F.lit(0.0)).otherwise(quantised(0.5 + 3.5 * u(1), 0.5)))
    d = d.withColumn("sigma", decoded_choice(u(2), [0.0, 0.5, 0.75, 1.0])).withColumn("median", decoded_choice(u(3), [1, 3]))
    d = d.withColumn("h1", quantised(8 + 6 * u(4), 0.25))
    for k, (floor, top) in ((2, (16.0, 30.0)), (3, (28.0, 48.0))):
        least = F.greatest(F.lit(floor), F.col(f"h{k - 1}") + 5)
        d = d.withColumn(f"h{k}", quantised(least + u(k + 3) * (top - least), 0.25))
    d = d.withColumn("w0", quantised(1.5 + 2 * u(7), 0.25))
    for k, width in ((1, 1.25), (2, 2.0), (3, 2.5)):
        d = d.withColumn(f"w{k}", F.col(f"w{k - 1}") + quantised(width * u(k + 7), 0.25))
    return d


#: Range of the ninth dimension, preprocessing of candidates that name none, names of parameters.
MIN_HEIGHTS = (1.0, 4.0)
PREPROCESSING = {"chm_pit_fill_size": 1, "chm_pit_depth": 0.0, "chm_gaussian_sigma": 0.0}
COMMON = ("min_height", "median_filter_size", "watershed_connectivity", "polygon_connectivity")
LEGACY = (
    "lmf_low_height_limit", "lmf_high_height_limit", "lmf_low_window_size", "lmf_mid_slope", "lmf_mid_intercept",
    "lmf_high_slope", "lmf_high_intercept",
)
CONTROL_HEIGHTS = tuple(f"lmf_control_height_{k}" for k in (1, 2, 3))
CONTROL_WINDOWS = tuple(f"lmf_control_window_{k}" for k in (0, 1, 2, 3))
FLEXIBLE = CONTROL_HEIGHTS + CONTROL_WINDOWS


def named(decoded: DataFrame, tune_min_height: bool = False) -> DataFrame:
    """Decoded candidates under the parameters' own names; u[8] is the least height where that is tuned."""
    least = quantised(MIN_HEIGHTS[0] + F.get("u", F.lit(8)) * (MIN_HEIGHTS[1] - MIN_HEIGHTS[0]), 0.25)
    names = {
        "min_height": least if tune_min_height else F.lit(BASELINE["min_height"]), "median_filter_size": F.col("median"),
        "lmf_low_height_limit": F.col("low"), "lmf_high_height_limit": F.col("high"), "lmf_low_window_size": F.col("w_low"),
        "lmf_mid_slope": F.col("s_mid"), "lmf_mid_intercept": F.col("i_mid"), "lmf_high_slope": F.col("s_high"),
        "lmf_high_intercept": F.col("i_high"), "watershed_connectivity": F.col("connectivity"),
        "polygon_connectivity": F.lit(BASELINE["polygon_connectivity"]),
    }
    # numbers are kept to eight places
    return decoded.withColumns({k: F.round(v, 8) if k not in ("median_filter_size", "watershed_connectivity", "polygon_connectivity") else v for k, v in names.items()})


def named_flexible(decoded: DataFrame) -> DataFrame:
    names = {"chm_pit_fill_size": "pit_size", "chm_pit_depth": "pit_depth", "chm_gaussian_sigma": "sigma", "median_filter_size": "median"}
    names |= dict(zip(CONTROL_HEIGHTS, ("h1", "h2", "h3"))) | dict(zip(CONTROL_WINDOWS, ("w0", "w1", "w2", "w3")))
    fixed = {"min_height": 2.0, "watershed_connectivity": 4, "polygon_connectivity": 4}
    return decoded.withColumns({k: F.col(v) for k, v in names.items()} | {k: F.lit(v) for k, v in fixed.items()})


def with_defaults(candidates: DataFrame) -> DataFrame:
    """Candidates from before there was preprocessing get the values that change nothing."""
    there = set(candidates.columns)
    return candidates.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in there else F.lit(v) for k, v in PREPROCESSING.items()})


def window(h: Column, flexible: bool = False) -> Column:
    """Diameter of the window at a height, from the parameters' columns."""
    if flexible:
        return interpolated_window(h, [F.col(k) for k in ("min_height", *CONTROL_HEIGHTS)], [F.col(k) for k in CONTROL_WINDOWS])
    return window_diameter(h, *[F.col(k) for k in LEGACY])


def legacy_features(d: DataFrame) -> Column:
    """The ten numbers of a legacy candidate that a surrogate model reads."""
    return F.array(*[F.col(k).cast("double") for k in ("min_height", "median_filter_size", *LEGACY, "watershed_connectivity")])


def features(d: DataFrame, flexible: bool) -> Column:
    """Fifteen numbers: preprocessing, median, windows at ten heights, connectivity."""
    windows = [window(F.lit(float(v)), flexible).cast("double") for v in SAMPLED_HEIGHTS]
    first = [F.col(k).cast("double") for k in (*PREPROCESSING, "median_filter_size")]
    return F.array(*first, *windows, F.col("watershed_connectivity").cast("double"))


def valid(flexible: bool = False) -> dict[str, Column]:
    """Named rules that parameters must meet, as columns of the parameter table; NaN and infinities break ``finite``."""
    c = F.col
    numbers = ("min_height", "chm_pit_depth", "chm_gaussian_sigma", *(FLEXIBLE if flexible else LEGACY))
    odd = lambda k: (c(k) >= 1) & (c(k) % 2 == 1)
    rules = {
        "finite": F.forall(F.array(*[c(k).cast("double") for k in numbers]), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))),
        "min_height": c("min_height") >= 0,
        "median_odd": odd("median_filter_size"),
        "pit_size_odd": odd("chm_pit_fill_size"),
        "pit_depth": c("chm_pit_depth") >= 0,
        "sigma": c("chm_gaussian_sigma") >= 0,
    }
    if flexible:
        heights, windows = ("min_height", *CONTROL_HEIGHTS), CONTROL_WINDOWS
        every = lambda x: F.coalesce(x, F.lit(False))
        rules |= {
            "complete": F.forall(F.array(*[c(k).cast("double") for k in FLEXIBLE]), lambda x: x.isNotNull()),
            "heights_increase": every(F.forall(F.array(*[c(b) > c(a) for a, b in zip(heights, heights[1:])]), lambda x: x)),
            "windows_positive": every(F.least(*[c(k) for k in windows]) > 0),
            "windows_never_fall": every(F.forall(F.array(*[c(b) >= c(a) for a, b in zip(windows, windows[1:])]), lambda x: x)),
        }
    else:
        rules |= {
            "low_limit": c("lmf_low_height_limit") >= 0,
            "limits_ordered": c("lmf_high_height_limit") > c("lmf_low_height_limit"),
            "low_window": c("lmf_low_window_size") > 0,
            "windows_positive": F.least(
                c("lmf_low_height_limit") * c("lmf_mid_slope") + c("lmf_mid_intercept"),
                c("lmf_high_height_limit") * c("lmf_mid_slope") + c("lmf_mid_intercept"),
                c("lmf_high_height_limit") * c("lmf_high_slope") + c("lmf_high_intercept"),
            ) > 0,
        }
    return rules


def shape_valid(keys: Column) -> Column:
    """Whether an array of parameter names is one whole set: the common ones, one kind of window, nothing else."""
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    has_all = lambda names: F.size(F.array_except(lit(names), keys)) == 0
    has_any = lambda names: F.arrays_overlap(lit(names), keys)
    known = (*COMMON, *PREPROCESSING, *LEGACY, *FLEXIBLE)
    one_kind = (has_all(LEGACY) | has_all(FLEXIBLE)) & ~(has_any(LEGACY) & has_any(FLEXIBLE))
    return has_all(COMMON) & one_kind & (F.size(F.array_except(keys, lit(known))) == 0)


def fractions(values: list[float], primary: float) -> list[float]:
    """Sorted distinct thresholds with the primary one; a value outside (0, 1] is an error."""
    out = sorted({float(v) for v in (*values, primary)})
    if any(not 0 < v <= 1 for v in out):  # NaN fails too
        raise ValueError("thresholds must be over 0 and at most 1")
    return out


def signature(parameters: dict[str, float | int]) -> str:
    """Twelve hex digits that name a parameter set: its numbers to eight places, as JSON in the order of names."""
    plain = {k: int(v) if isinstance(v, int) else round(float(v), 8) for k, v in sorted(parameters.items())}
    return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()[:12]
