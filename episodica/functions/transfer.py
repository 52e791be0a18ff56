"""How a field moves from a front to a back stage: features of two paths, and their dynamics along an episode.

A path is an array of points (arrays of doubles of one length), one for each flow step. `flow` compares two paths in the
same coordinates, `channel` paths that share only their steps. `pair`, `channel_steps` and `scalar_steps` follow the
last points (or a scalar) along the steps of an episode, looking back only; they are NULL until enough steps are there.
Logs of ratios and quotients are guarded by EPS; a cosine with a side of (nearly) no length is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import Series, difference, lag_delta
from .vectors import _c, norm

EPS = 1e-8


def minus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def moves(path) -> Column:
    """Differences of successive points."""
    n = F.size(path) - 1
    return F.zip_with(F.slice(path, F.lit(2), n), F.slice(path, F.lit(1), n), minus)


def lengths(path) -> Column:
    return F.transform(path, norm)


def mean(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def early(a, n: int = 3) -> Column:
    return mean(F.slice(a, 1, n))


def late(a, n: int = 3) -> Column:
    return mean(F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n)))


def log_ratio(a: Column, b: Column) -> Column:
    return F.ln((a + EPS) / (b + EPS))


def cosine(a, b) -> Column:
    """Cosine within -1 and 1; 0 if the product of the lengths is next to nothing."""
    size = norm(a) * norm(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(size > EPS, F.least(F.greatest(dot / size, F.lit(-1.0)), F.lit(1.0))).when(size.isNotNull(), 0.0)


def cosines(a, b) -> Column:
    return F.zip_with(a, b, cosine)


def lagged(a, b, k: int) -> tuple[Column, Column]:
    """a and b with b k steps later."""
    n = F.size(a) - abs(k)
    return F.slice(a, F.lit(1 + max(0, -k)), n), F.slice(b, F.lit(1 + max(0, k)), n)


def correlation(a, b) -> Column:
    centred = lambda x: F.transform(x, lambda t: t - mean(x))
    return cosine(centred(a), centred(b))


def settling(speed) -> Column:
    return log_ratio(late(speed), early(speed))


def time_centre(speed) -> Column:
    """Where along the steps (0 to 1) the movement lies."""
    at = F.transform(speed, lambda s, i: s * (i + 0.5))
    return total(at) / F.size(speed) / F.greatest(total(speed), F.lit(EPS))


def held(df: DataFrame, **columns) -> DataFrame:
    """df with intermediate columns, each computed once."""
    return df.withColumns({f"_{k}": c for k, c in columns.items()})


def flow(df: DataFrame, front: str = "front", back: str = "back") -> DataFrame:
    """df with the 34 features of a front and a back path in the same coordinates."""
    f, b = _c(front), _c(back)
    old = df.columns
    df = held(df, gap=F.zip_with(b, f, minus), fv=moves(f), bv=moves(b))
    df = held(df, gv=moves("_gap"), fs=lengths("_fv"), bs=lengths("_bv"))
    df = held(df, gs=lengths("_gv"), gg=lengths(moves("_gv")), al=cosines(f, b), va=cosines("_fv", "_bv"), mixed=lengths(F.zip_with("_bv", "_fv", minus)))
    first, last = (lambda a: F.element_at(a, 1)), (lambda a: F.element_at(a, -1))
    g0, g1, path, end = norm(first("_gap")), norm(last("_gap")), total("_gs"), norm(minus(last("_gap"), first("_gap")))
    out = {
        "gap_initial": g0, "gap_terminal": g1, "gap_log_ratio": log_ratio(g1, g0), "gap_path": path, "gap_endpoint": end,
        "gap_efficiency": end / F.greatest(path, F.lit(EPS)), "gap_curvature": mean("_gg"), "gap_settling_log_ratio": settling("_gs"),
        "front_path": total("_fs"), "back_path": total("_bs"), "back_front_path_log_ratio": log_ratio(total("_bs"), total("_fs")),
        "back_front_early_log_ratio": log_ratio(early("_bs"), early("_fs")), "back_front_late_log_ratio": log_ratio(late("_bs"), late("_fs")),
        "velocity_alignment_mean": mean("_va"), "velocity_alignment_early": early("_va"), "velocity_alignment_late": late("_va"),
        "velocity_opposition_fraction": mean(F.transform("_va", lambda x: (x < 0).cast("double"))), "mixed_velocity": mean("_mixed"),
        "front_time_center": time_centre("_fs"), "back_time_center": time_centre("_bs"), "handoff_delay": time_centre("_bs") - time_centre("_fs"),
        "initial_alignment": first("_al"), "terminal_alignment": last("_al"), "alignment_change": last("_al") - first("_al"),
        "front_terminal_norm": norm(last(f)), "back_terminal_norm": norm(last(b)), "terminal_norm_log_ratio": log_ratio(norm(last(b)), norm(last(f))),
        "front_settling_log_ratio": settling("_fs"), "back_settling_log_ratio": settling("_bs"), "settling_difference": settling("_bs") - settling("_fs"),
    }
    for k, name in ((-2, "m2"), (-1, "m1"), (1, "p1"), (2, "p2")):
        out[f"lag_alignment_{name}"] = mean(cosines(*lagged("_fv", "_bv", k)))
    return df.select(*old, *[c.alias(n) for n, c in out.items()])


def channel(df: DataFrame, source: str = "front", target: str = "back") -> DataFrame:
    """df with the 19 features of a source and a target path, whose coordinates may differ."""
    old = df.columns
    df = held(df, sv=moves(source), tv=moves(target))
    df = held(df, ss=lengths("_sv"), ts=lengths("_tv"), sg=lengths(moves("_sv")), tg=lengths(moves("_tv")))
    rough = lambda g, s: total(g) / F.greatest(total(s), F.lit(EPS))
    out = {
        "source_path": total("_ss"), "target_path": total("_ts"), "target_source_path_log_ratio": log_ratio(total("_ts"), total("_ss")),
        "target_source_early_log_ratio": log_ratio(early("_ts"), early("_ss")), "target_source_late_log_ratio": log_ratio(late("_ts"), late("_ss")),
        "source_settling_log_ratio": settling("_ss"), "target_settling_log_ratio": settling("_ts"), "settling_difference": settling("_ts") - settling("_ss"),
        "source_time_center": time_centre("_ss"), "target_time_center": time_centre("_ts"), "handoff_delay": time_centre("_ts") - time_centre("_ss"),
        "speed_correlation": correlation("_ss", "_ts"),
    }
    for k, name in ((-2, "m2"), (-1, "m1"), (1, "p1"), (2, "p2")):
        out[f"speed_lag_correlation_{name}"] = correlation(*lagged("_ss", "_ts", k))
    out |= {"source_roughness": rough("_sg", "_ss"), "target_roughness": rough("_tg", "_ts"), "roughness_difference": rough("_tg", "_ts") - rough("_sg", "_ss")}
    return df.select(*old, *[c.alias(n) for n, c in out.items()])


# ---- along an episode


def back_at(s: Series, x, k: int) -> Column:
    return F.lag(x, k).over(s.by) if k else _c(x)


def times(a: Column, w: float) -> Column:
    return F.transform(a, lambda t: t * w)


def drift(s: Series, x, *weights: float) -> Column:
    """Weighted sum of a vector now and one, two, ... steps back."""
    out = None
    for k, w in enumerate(weights):
        part = times(back_at(s, x, k), w)
        out = part if out is None else F.zip_with(out, part, lambda a, b: a + b)
    return out


def away(s: Series, x, k: int) -> Column:
    return norm(minus(x, back_at(s, x, k)))


def advantage(s: Series, x) -> Column:
    """Distance to the step before less the least of those two to four steps back."""
    whole = back_at(s, x, 4).isNotNull()
    return F.when(whole, away(s, x, 1) - F.least(*[away(s, x, k) for k in (2, 3, 4)]))


def pair(df: DataFrame, s: Series, front: str, back: str) -> DataFrame:
    """df with the 23 dynamics of two vectors along an episode."""
    old = df.columns
    df = held(df, gap=minus(back, front))
    df = df.withColumns({f"_{n}1": drift(s, x, 1, -1) for n, x in (("f", front), ("b", back), ("g", "_gap"))} | {f"_{n}2": norm(drift(s, x, 1, -2, 1)) for n, x in (("f", front), ("b", back), ("g", "_gap"))})
    far = {n: away(s, x, 4) for n, x in (("front", front), ("back", back), ("gap", "_gap"))}
    home = {n: advantage(s, x) for n, x in (("front", front), ("back", back), ("gap", "_gap"))}
    turn = {n: 1 - cosine(f"_{n[0]}1", back_at(s, f"_{n[0]}1", 1)) for n in ("front", "back", "gap")}
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    out = {
        "front_d1": norm("_f1"), "back_d1": norm("_b1"), "gap_d1": norm("_g1"), "response_log_ratio": log_ratio(norm("_b1"), norm("_f1")),
        "velocity_alignment": cosine("_f1", "_b1"), "parallel_gain": dot("_f1", "_b1") / (dot("_f1", "_f1") + EPS),
        "front_acceleration": _c("_f2"), "back_acceleration": _c("_b2"), "gap_acceleration": _c("_g2"), "acceleration_log_ratio": log_ratio(_c("_b2"), _c("_f2")),
        "gap_jerk": norm(drift(s, "_gap", 1, -3, 3, -1)),
        "front_lag4": far["front"], "back_lag4": far["back"], "gap_lag4": far["gap"], "lag4_log_ratio": log_ratio(far["back"], far["front"]),
        "front_return_advantage": home["front"], "back_return_advantage": home["back"], "gap_return_advantage": home["gap"], "return_difference": home["back"] - home["front"],
        "front_turn_instability": turn["front"], "back_turn_instability": turn["back"], "gap_turn_instability": turn["gap"], "turn_difference": turn["back"] - turn["front"],
    }
    return df.select(*old, *[c.alias(n) for n, c in out.items()])


def channel_steps(df: DataFrame, s: Series, source: str, target: str) -> DataFrame:
    """df with the 10 dynamics of a source and a target vector along an episode."""
    old = df.columns
    df = held(df, s1=away(s, source, 1), t1=away(s, target, 1), s2=norm(drift(s, source, 1, -2, 1)), t2=norm(drift(s, target, 1, -2, 1)), s4=away(s, source, 4), t4=away(s, target, 4))
    recent = s.last(4)
    df = held(df, ls=F.collect_list("_s1").over(recent), lt=F.collect_list("_t1").over(recent))
    out = {
        "source_d1": _c("_s1"), "target_d1": _c("_t1"), "target_source_d1_log_ratio": log_ratio(_c("_t1"), _c("_s1")),
        "source_acceleration": _c("_s2"), "target_acceleration": _c("_t2"), "target_source_acceleration_log_ratio": log_ratio(_c("_t2"), _c("_s2")),
        "source_lag4": _c("_s4"), "target_lag4": _c("_t4"), "target_source_lag4_log_ratio": log_ratio(_c("_t4"), _c("_s4")),
        "recent_speed_correlation": F.when(F.size("_ls") == 4, correlation("_ls", "_lt")),
    }
    return df.select(*old, *[c.alias(n) for n, c in out.items()])


def scalar_steps(df: DataFrame, s: Series, x: str) -> DataFrame:
    """df with the 6 dynamics of a scalar along an episode."""
    old = df.columns
    df = held(df, v=lag_delta(s, x, 1))
    product = F.col("_v") * F.lag("_v").over(s.by)
    sign = F.when(F.abs(product) > EPS, F.signum(product)).when(product.isNotNull(), 1.0)
    d = [F.abs(lag_delta(s, x, k)) for k in (1, 2, 3, 4)]
    out = {
        "d1": d[0], "acceleration": F.abs(difference(s, x, 2)), "jerk": F.abs(difference(s, x, 3)), "lag4": d[3],
        "return_advantage": F.when(d[3].isNotNull(), d[0] - F.least(*d[1:])), "turn_instability": 1 - sign,
    }
    return df.select(*old, *[c.alias(n) for n, c in out.items()])
