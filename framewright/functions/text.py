"""Column functions on task texts, tags, prompts and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def cleaned(task: Column) -> Column:
    return F.translate(F.trim(task), "_\n", "  ")


def state_prompt(task: Column, bins: Column) -> Column:
    return F.concat(F.lit("Task: "), cleaned(task), F.lit(", State: "), F.array_join(F.transform(bins, lambda b: b.cast("string")), " "), F.lit(";\nAction: "))


def advantage_tag(task: Column, positive: Column) -> Column:
    tag = F.concat(F.lit("Advantage: "), F.when(positive, "positive").otherwise("negative"))
    return F.when(F.coalesce(task, F.lit("")) == "", tag).otherwise(F.concat(task, F.lit("\n"), tag))


def tag_with_dropout(task: Column, indicator: Column, draw: Column, dropout: float) -> Column:
    """The tagged task, or the plain one where draw < dropout; an indicator other than 0 and 1 raises."""
    ok = F.when(indicator.isin(0, 1), indicator == 1).otherwise(F.raise_error(F.lit("the indicator must be 0 or 1")).cast("boolean"))
    return F.when(draw < dropout, task).otherwise(advantage_tag(task, ok))


def ends_with_newline(task: Column) -> Column:
    return F.when(task.endswith("\n"), task).otherwise(F.concat(task, F.lit("\n")))


def ends_with_period(task: Column, default: str = "Execute the robot action.") -> Column:
    t = F.when(F.coalesce(F.trim(task), F.lit("")) == "", default).otherwise(task)
    return F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))


def plain_words(task: Column) -> Column:
    return F.regexp_replace(F.lower(task), r"[^\p{L}\p{N}_\s]", "")


def seconds(clock: Column) -> Column:
    p = F.split(clock, ":")
    return p[0].cast("int") * 60 + p[1].cast("int")


def clock(s: Column) -> Column:
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s.cast("long") % 60).cast("string"), 2, "0"))


def frame_of(clock_: Column, fps: float) -> Column:
    return F.floor(seconds(clock_) * fps).cast("long")


def default_annotation(length: Column, fps: float, name: str = "task") -> Column:
    """One subtask over the whole episode."""
    return F.array(F.struct(F.lit(name).alias("name"), F.lit("00:00").alias("start"), clock(length / fps).alias("end"), F.lit(0).cast("long").alias("start_frame"), (length - 1).alias("end_frame")))


def collector(intervention_on: Column, is_intervention: Column, from_policy: Column, policy: str, human: str) -> Column:
    return F.when(intervention_on & is_intervention, human).when(from_policy, policy).otherwise(human)


def chosen_instruction(*by_priority: Column, default: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in by_priority], default)


def rescaled_points(text: Column, old: tuple[int, int], new: tuple[int, int]) -> Column:
    """<point>[x, y]</point> in (height, width) of old restated in new, clamped to it; malformed points stay as they are."""
    pattern = r"<point>\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\]</point>"
    parts = F.split(text, pattern)
    xs, ys = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)
    fit = lambda v, a, b: F.greatest(F.lit(0), F.least(F.lit(b - 1), F.bround(v.cast("double") * b / a).cast("long"))).cast("string")
    points = F.zip_with(xs, ys, lambda x, y: F.concat(F.lit("<point>["), fit(x, old[1], new[1]), F.lit(", "), fit(y, old[0], new[0]), F.lit("]</point>")))
    return F.concat(parts[0], F.array_join(F.zip_with(points, F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p, t: F.concat(p, t)), ""))


def camera_prompt(instruction: Column, cameras: list[str], steps: int, placeholder: str = "<action>") -> Column:
    views = "".join(f"{c.removeprefix('observation.').replace('_', ' ')}: <image>\n" for c in cameras)
    return F.concat(F.lit(views), F.lit("Instruction: "), instruction, F.lit("\nActions: "), F.repeat(F.lit(placeholder), F.lit(steps)))
