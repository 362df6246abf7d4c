"""Column functions on vectors: normalisation, padding, bins, rewards, overlaps, pixels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-8
#: The statistics that each mode needs.
NEEDS = {"MEAN_STD": ("mean", "std"), "MIN_MAX": ("min", "max"), "QUANTILES": ("q01", "q99"), "QUANTILE10": ("q10", "q90"), "IDENTITY": ()}

Stats = dict[str, list[float]]


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def normalized(v: Column, mode: str, stats: Stats | None, inverse: bool = False, eps: float = EPS) -> Column:
    """A vector by the statistics of its mode, or back; IDENTITY and no statistics leave it; a missing statistic raises ValueError."""
    if mode == "IDENTITY" or not stats:
        return v
    if lost := [n for n in NEEDS[mode] if n not in stats]:
        raise ValueError(f"{mode} needs {lost}")
    a, b = (stats[n] for n in NEEDS[mode])
    if mode == "MEAN_STD":
        pairs = F.arrays_zip(v.alias("x"), _array(a).alias("m"), _array(b).alias("s"))
        return F.transform(pairs, lambda p: p.x * p.s + p.m if inverse else (p.x - p.m) / (p.s + eps))
    width = [hi - lo or eps for lo, hi in zip(a, b, strict=True)]
    pairs = F.arrays_zip(v.alias("x"), _array(a).alias("lo"), _array(width).alias("d"))
    return F.transform(pairs, lambda p: (p.x + 1) / 2 * p.d + p.lo if inverse else 2 * (p.x - p.lo) / p.d - 1)


def normalized_columns(names: dict[str, tuple[str, Stats]], inverse: bool = False) -> dict[str, Column]:
    """For withColumns: each named column by its (mode, statistics)."""
    return {n: normalized(F.col(n), mode, stats, inverse) for n, (mode, stats) in names.items()}


def clip_normalized(v: Column, mode: str, stats: Stats, eps: float = EPS) -> Column:
    """Clipped to the range of its mode first, with widths of eps at least."""
    a, b = (stats[n] for n in NEEDS[mode])
    if mode == "MEAN_STD":
        return F.transform(F.arrays_zip(v.alias("x"), _array(a).alias("m"), _array([max(s, eps) for s in b]).alias("s")), lambda p: (p.x - p.m) / p.s)
    pairs = F.arrays_zip(v.alias("x"), _array(a).alias("lo"), _array(b).alias("hi"), _array([max(hi - lo, eps) for lo, hi in zip(a, b, strict=True)]).alias("d"))
    return F.transform(pairs, lambda p: 2 * (F.greatest(p.lo, F.least(p.hi, p.x)) - p.lo) / p.d - 1)


def masked_min_max(v: Column, low: list[float], high: list[float], inverse: bool = False) -> Column:
    """To [-1, 1]; a dim without width gives 0, and its minimum on the way back."""
    pairs = F.arrays_zip(v.alias("x"), _array(low).alias("lo"), _array([b - a for a, b in zip(low, high, strict=True)]).alias("d"))
    return F.transform(pairs, lambda p: F.when(p.d == 0, p.lo if inverse else F.lit(0.0)).otherwise((p.x + 1) / 2 * p.d + p.lo if inverse else 2 * (p.x - p.lo) / F.when(p.d == 0, 1.0).otherwise(p.d) - 1))


def delta(action: Column, state: Column, dims: tuple[int, ...], back: bool = False) -> Column:
    return F.transform(action, lambda x, i: F.when(i.isin(*dims), x + F.get(state, i) if back else x - F.get(state, i)).otherwise(x))


def parse_dims(text: str) -> list[tuple[int, int]]:
    """[(start, end)] of "0:6,7:23"."""
    return [(int(a), int(b)) for a, b in (p.split(":") for p in text.split(",") if p.strip())]


def selected_dims(v: Column, text: str) -> Column:
    return F.concat(*[F.slice(v, a + 1, b - a) for a, b in parse_dims(text)])


def two_hot(value: Column, centers: list[float]) -> Column:
    """Weights of the two bin centres next to the clamped value; the centres are evenly spaced."""
    lo, hi, k = centers[0], centers[-1], len(centers)
    p = (F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), value)) - lo) / ((hi - lo) / (k - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.greatest(F.lit(0.0), 1 - F.abs(p - i)))


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def expected_value(logits: Column, centers: list[float]) -> Column:
    return dot(softmax(logits), _array(centers))


def discretized(v: Column, bins: int = 256) -> Column:
    """Bins of [-1, 1]: below -1 gives -1, 1 and above the last bin."""
    return F.transform(v, lambda x: F.least(F.call_function("width_bucket", x, F.lit(-1.0), F.lit(1.0), F.lit(bins)) - 1, F.lit(bins - 1)))


def padded(v: Column, n: int, value: float = 0.0) -> Column:
    return F.slice(F.concat(v, F.array_repeat(F.lit(value), n)), 1, n)


def real_dims(v: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < F.size(v))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def similar(a: Column, b: Column, tolerance: float) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y)) < tolerance


def delta_action(v: Column, scale: float, noise: float) -> Column:
    """struct(enabled, scaled): whether the command is longer than noise, and the command times scale."""
    return F.struct((norm(v) > noise).alias("enabled"), F.transform(v, lambda x: x * scale).alias("scaled"))


def gripper_penalty(state: Column, action: Column, highest: float, penalty: float) -> Column:
    """The penalty where an open gripper is closed or a closed one opened; state is divided by highest."""
    s = state / highest
    return F.when(((s < 0.5) & (action > 0.5)) | ((s > 0.75) & (action < 0.5)), penalty).otherwise(0.0)


def intervened(intervention: Column, teleop: Column, action: Column, terminate: Column, success: Column, end_on_success: bool = True) -> Column:
    """struct(action, done, reward) of a step under possible intervention."""
    done = terminate | (success & F.lit(end_on_success))
    return F.struct(F.when(intervention, teleop).otherwise(action).alias("action"), done.alias("done"), F.when(success, 1.0).otherwise(0.0).alias("reward"))


def classifier_reward(probability: Column, reward: Column, done: Column, success_reward: float = 1.0, end: bool = True) -> Column:
    """struct(reward, done), overridden where a classifier is sure of success."""
    sure = F.abs(probability - 1) <= 1e-2
    return F.struct(F.when(sure, success_reward).otherwise(reward).alias("reward"), F.when(sure & F.lit(end), True).otherwise(done).alias("done"))


def timed_chunk(start_time: Column, start_step: Column, chunk: Column, dt: float) -> Column:
    """array of struct(timestamp, timestep, action)."""
    return F.transform(chunk, lambda a, i: F.struct((start_time + i * dt).alias("timestamp"), (start_step + i).alias("timestep"), a.alias("action")))


def curve_rescaled(value: Column, length: Column, shortest: Column, longest: Column) -> Column:
    return value * F.greatest(F.lit(1.0), F.least(longest / length, longest / shortest)) * 2 + 1


def first_scalar(v: Column) -> Column:
    return F.coalesce(F.get(v, 0).cast("double"), F.lit(0.0))


def squashed(v: Column, zero: tuple[int, ...] = (), sigmoid: tuple[int, ...] = ()) -> Column:
    return F.transform(v, lambda x, i: F.when(i.isin(*zero) if zero else F.lit(False), 0.0).when(i.isin(*sigmoid) if sigmoid else F.lit(False), 1 / (1 + F.exp(-x))).otherwise(x))


def pixels_scaled(image: Column) -> Column:
    """A height-width-channel array of bytes as a channel-first array in [0, 1]."""
    channels = F.size(F.get(F.get(image, 0), 0))
    return F.transform(F.sequence(F.lit(0), channels - 1), lambda c: F.transform(image, lambda row: F.transform(row, lambda px: F.get(px, c) / 255.0)))


def flattened(schema, prefix: str = "", path: str = "") -> list[Column]:
    """A column `a/b` for each leaf of a schema's structs."""
    out = []
    for f in schema.fields:
        name, at = f"{prefix}/{f.name}" if prefix else f.name, f"{path}.`{f.name}`" if path else f"`{f.name}`"
        out += flattened(f.dataType, name, at) if f.dataType.typeName() == "struct" else [F.col(at).alias(name)]
    return out


def unflattened(names: list[str]) -> list[Column]:
    """Structs from columns named `a/b`."""
    tree: dict = {}
    for n in names:
        node = tree
        *parents, leaf = n.split("/")
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = n
    build = lambda node: [F.struct(*build(v)).alias(k) if isinstance(v, dict) else F.col(f"`{v}`").alias(k) for k, v in node.items()]
    return build(tree)


def sample_weight(d: Column, kappa: float, mean: Column, std: Column, fallback: float = 1.0, eps: float = 1e-6) -> Column:
    """Weight of a progress delta: 1 over kappa, 0 under 0, between them by its place in mean +- 2 std; null takes the fallback."""
    soft = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - (mean - 2 * std)) / (4 * std + eps)))
    return F.when(d.isNull() | F.isnan(d), fallback).when(d > kappa, 1.0).when(d < 0, 0.0).otherwise(soft)


def relative_position(frame: Column, start: Column, end: Column) -> Column:
    return F.when(end <= start, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((frame - start).cast("double"), (end - start).cast("double")))))


def stage_progress(stage: Column, tau: Column, proportions: list[float] | None = None, stages: int | None = None) -> Column:
    """Global progress of a stage and its tau, by cumulative proportions or equal parts."""
    parts = [p / sum(proportions) for p in proportions] if proportions else [1 / stages] * stages
    ends = [sum(parts[:i]) for i in range(len(parts) + 1)]
    at = F.least(stage, F.lit(len(parts) - 1))
    return F.get(_array(ends), at) + tau * F.get(_array(parts), at)
