"""Operators over the ordered frames of an episode: offset windows, look-ahead, interpolation, velocity, latches, transitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def by_episode(order: str = "frame_index") -> WindowSpec:
    return Window.partitionBy("episode_index").orderBy(order)


def offsets_of(seconds: list[float], fps: float, tolerance: float = 1e-4) -> list[int]:
    """Frame offsets, rounded half to even; seconds off the frame grid by more than tolerance raise ValueError."""
    out = [round(s * fps) for s in seconds]
    if bad := [s for s, o in zip(seconds, out, strict=True) if abs(s - o / fps) > tolerance]:
        raise ValueError(f"not multiples of 1/{fps} s: {bad}")
    return out


def offset_window(frames: DataFrame, column: str, offsets: list[int], out: str, order: str = "frame_index") -> DataFrame:
    """Adds out: the values at each offset, clamped to the episode, and out_is_pad: whether it lies outside.

    The pad flag looks at rows, not values, so a null value isn't padding.
    """
    w = by_episode(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pads = [F.lead(F.lit(True), d).over(w).isNull() if d >= 0 else F.lag(F.lit(True), -d).over(w).isNull() for d in offsets]
    moved = [F.lead(column, d).over(w) if d >= 0 else F.lag(column, -d).over(w) for d in offsets]
    edge = [F.last(column).over(whole) if d >= 0 else F.first(column).over(whole) for d in offsets]
    values = [F.when(p, e).otherwise(m) for p, e, m in zip(pads, edge, moved, strict=True)]
    return frames.withColumns({out: F.array(*values), f"{out}_is_pad": F.array(*pads)})


def nearest_offset_window(frames: DataFrame, column: str, offsets: list[int], out: str, order: str = "frame_index") -> DataFrame:
    """As offset_window, but an offset outside the episode repeats the nearest offset on its side that is inside."""
    full = offset_window(frames, column, offsets, "_w", order)
    values = []
    for i, d in enumerate(offsets):
        nearer = [j for j, e in sorted(enumerate(offsets), key=lambda p: -abs(p[1])) if e * d >= 0 and abs(e) <= abs(d)]
        values.append(F.coalesce(*[F.when(~F.col("_w_is_pad")[j], F.struct(F.col("_w")[j].alias("v"))) for j in nearer], F.struct(F.col(column).alias("v"))).getField("v"))
    return full.withColumns({out: F.array(*values), f"{out}_is_pad": F.col("_w_is_pad")}).drop("_w", "_w_is_pad")


def clamped_indices(index: Column, start: Column, end: Column, offsets: Column) -> Column:
    """array of struct(index, is_pad) for absolute indices in [start, end)."""
    return F.transform(offsets, lambda d: F.struct(F.greatest(start, F.least(end - 1, index + d)).alias("index"), ((index + d < start) | (index + d >= end)).alias("is_pad")))


def strided_offsets(n: int, gap: int, symmetric: bool = True) -> Column:
    """n // 2 past steps, now, and as many future ones; or n past steps and now."""
    steps = range(-(n // 2), n // 2 + 1) if symmetric else range(-n, 1)
    return F.array(*[F.lit(gap * k) for k in steps])


def look_ahead_delta(value: str, steps: int) -> Column:
    """value at min(i + steps, last) minus value here; null where either is missing."""
    w = by_episode()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.lead(F.lit(True), steps).over(w).isNotNull()
    return F.when(inside, F.lead(value, steps).over(w)).otherwise(F.last(value).over(whole)) - F.col(value)


def rewind_indices(index: Column, start: Column, first_offset: int, k: Column, gap: int) -> Column:
    """k earlier steps of gap frames before index - first_offset, nearest first, clamped at start."""
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda j: F.greatest(start, index - first_offset - j * gap))).otherwise(F.array().cast("array<bigint>"))


def interpolated(value: str) -> Column:
    """Linear interpolation between known values by frame_index, edges held; NaN and null are unknown; none known gives null."""
    known = F.when(~F.isnan(value) & F.col(value).isNotNull(), F.struct("frame_index", F.col(value).alias("v")))
    w = by_episode()
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    span = b.frame_index - a.frame_index
    between = a.v + (b.v - a.v) * F.try_divide(F.col("frame_index") - a.frame_index, span)
    return F.when(a.isNull(), b.v).when(b.isNull() | (span == 0), a.v).otherwise(between)


def progress_classes(values: str, threshold: float, complete: float) -> list[Column]:
    """For a list of strided progress values: 2, 0 or 1 for a rise, fall or neither by more than threshold, and completion flags."""
    v = F.col(values)
    n = F.size(v)
    rise = F.zip_with(F.slice(v, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: F.when(b - a > threshold, 2).when(b - a < -threshold, 0).otherwise(1))
    return [rise.alias("classes"), F.transform(v, lambda p: p >= complete).alias("complete")]


def velocity(vector: str, dt: float) -> Column:
    """(q_t - q_(t-1)) / dt by element; zeros at the first frame."""
    v = F.col(vector)
    return F.zip_with(v, F.coalesce(F.lag(v).over(by_episode()), v), lambda a, b: (a - b) / dt)


def clipped_with_jump(vector: str, low: list[float], high: list[float], max_step: float) -> list[Column]:
    """The vector clipped to bounds, and whether the clipped step from the frame before is longer than max_step."""
    clip = lambda v: F.array(*[F.greatest(F.lit(a), F.least(F.lit(b), v[i])) for i, (a, b) in enumerate(zip(low, high, strict=True))])
    now, before = clip(F.col(vector)), clip(F.lag(vector).over(by_episode()))
    step = F.sqrt(F.aggregate(F.zip_with(now, before, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return [now.alias("clipped"), F.coalesce(F.when(F.lag(F.lit(True)).over(by_episode()).isNotNull(), step > max_step), F.lit(False)).alias("jump")]


def latched(enabled: str, value: str) -> list[Column]:
    """The value where enabled last went up, and the value held since enabled was last on."""
    w = by_episode()
    rising = F.col(enabled) & ~F.coalesce(F.lag(enabled).over(w), F.lit(False))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return [F.last(F.when(rising, F.col(value)), ignorenulls=True).over(upto).alias("reference"), F.last(F.when(F.col(enabled), F.col(value)), ignorenulls=True).over(upto).alias("held")]


def action_chunks(frames: DataFrame, action: str, horizon: int, state: str | None = None, delta_dims: tuple[int, ...] = ()) -> DataFrame:
    """(episode_index, frame_index, chunk) for every full window of horizon actions; chosen dims relative to the first state."""
    w = by_episode()
    chunk = F.collect_list(action).over(w.rowsBetween(0, horizon - 1))
    out = frames.withColumn("_c", chunk).where(F.size("_c") == horizon)
    if state and delta_dims:
        relative = F.transform("_c", lambda a: F.transform(a, lambda x, i: F.when(i.isin(*delta_dims), x - F.col(state)[i]).otherwise(x)))
        return out.select("episode_index", "frame_index", relative.alias("chunk"))
    return out.select("episode_index", "frame_index", F.col("_c").alias("chunk"))


def smoothed(frames: DataFrame, value: str, window: int = 11, order: int = 3, out: str = "smooth") -> DataFrame:
    """Savitzky-Golay smoothing of each episode: fitted cubics, also at the edges; under five frames the values as they are.

    An episode is one group: its edges need the polynomial fitted to them.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame_index")
        y = group[value].to_numpy(float)
        size = min(window, len(y) - (len(y) + 1) % 2)
        if size >= 5:
            half, x = size // 2, np.arange(size)
            hat = np.vander(x, order + 1) @ np.linalg.pinv(np.vander(x, order + 1))
            smooth = np.convolve(y, hat[half][::-1], "same")
            smooth[:half], smooth[len(y) - half :] = (hat @ y[:size])[:half], (hat @ y[-size:])[half + 1 :]
            y = smooth
        return pd.DataFrame({"episode_index": group["episode_index"], "frame_index": group["frame_index"], out: y})

    return frames.select("episode_index", "frame_index", value).groupBy("episode_index").applyInPandas(fit, f"episode_index long, frame_index long, {out} double")


def weighted_filter(frames: DataFrame, value: str, weights: list[float], out: str = "filtered") -> DataFrame:
    """Consecutive repeats dropped, then the weighted sum of the newest values, newest first; the newest value while there are too few."""
    w = by_episode()
    kept = frames.withColumn("_b", F.lag(value).over(w)).where(F.col("_b").isNull() | (F.col("_b") != F.col(value))).drop("_b")
    total = sum((F.lag(value, i).over(w) * c for i, c in enumerate(weights)), F.lit(0.0))
    return kept.withColumn(out, F.coalesce(total, F.col(value)))


def transitions(frames: DataFrame, state: str, action: str, reward: str, done: str | None = None) -> DataFrame:
    """(episode_index, frame_index, state, action, reward, next_state, done): done by column or at an episode's last frame; there the next state is the state."""
    w = by_episode()
    end = F.lead(F.lit(True)).over(w).isNull()
    done_ = (F.coalesce(F.col(done), F.lit(False)) | end) if done else end
    nxt = F.when(done_, F.col(state)).otherwise(F.lead(state).over(w))
    return frames.select("episode_index", "frame_index", F.col(state).alias("state"), F.col(action).alias("action"), F.col(reward).alias("reward"), nxt.alias("next_state"), done_.alias("done"))


def truncated(limit: int) -> Column:
    return F.row_number().over(by_episode()) >= limit


def intervention_states(toggle: str) -> Column:
    """`active` after an odd number of toggles, `release` for one frame after it ends, else `policy`."""
    w = by_episode()
    on = F.sum(F.col(toggle).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    return F.when(on, "active").when(F.col(toggle), "release").otherwise("policy")


def fallback_action(active: Column, teleop: str, policy: str) -> Column:
    """Under intervention the fresh teleop value, else the last one, else the policy's, else 0; otherwise the policy's or 0."""
    last = F.last(teleop, ignorenulls=True).over(by_episode().rowsBetween(Window.unboundedPreceding, 0))
    return F.when(active, F.coalesce(F.col(teleop), last, F.col(policy), F.lit(0.0))).otherwise(F.coalesce(F.col(policy), F.lit(0.0)))


def compiled_rollouts(steps: DataFrame, done: str, action: str) -> DataFrame:
    """Rows up to two after the first done of each rollout, the last action repeated where it is missing, renumbered."""
    w = by_episode()
    first = F.min(F.when(F.col(done), F.col("frame_index"))).over(Window.partitionBy("episode_index"))
    kept = steps.withColumn("_f", first).where(F.col("_f").isNull() | (F.col("frame_index") <= F.col("_f") + 1))
    filled = F.coalesce(F.col(action), F.last(action, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.withColumn(action, filled).withColumn("frame_index", (F.row_number().over(w) - 1).cast("long")).drop("_f")


def scored(frames: DataFrame, columns: list[str], scorer, out: str = "score") -> DataFrame:
    """A user's scorer (pandas.DataFrame -> array of float) over batches of frames; loaded once in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"index": batch["index"], out: np.asarray(scorer(batch[columns]), float)})

    return frames.select("index", *[c for c in columns if c != "index"]).mapInPandas(run, f"index long, {out} double")
