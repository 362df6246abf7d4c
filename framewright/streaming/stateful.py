"""Structured Streaming operators with keyed state, and their batch counterparts' rules.

Each works on a key (episode, robot or source), so state is spread over the cluster and bounded by a window, a ring or an episode.
Keys are called and stored in groups, as a call for each would take longer than its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: The keys of a stream are dealt by their hash to so many groups. A group is one call of Python and one row of state that holds the states
#: of its keys side by side: a call for each key costs some milliseconds, many times what its rows do. Fixed for a checkpoint's life.
GROUPS = 512
#: Rows that a group gives out at a time, about.
GIVEN_ROWS = 100_000


def grouped(df: DataFrame, key: str, groups: int) -> DataFrame:
    """df with group__, a number under groups by the key's hash. Columns that pandas can't hold with nulls are filled and flagged, so that
    a null of one key doesn't change the numbers of others; keyed() takes that back. No name begins with an underscore, which tuples don't bear."""
    plain = [c for c, t in df.dtypes if t in ("boolean", "tinyint", "smallint", "int", "bigint") or c == key]
    flags = [F.col(c).isNull().alias(f"isnull__{c}") for c in plain]
    filled = [F.coalesce(c, F.lit(0).cast(dict(df.dtypes)[c])).alias(c) if c in plain else F.col(c) for c in df.columns]
    return df.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("group__"), *flags, *filled)


def keyed(batches: Iterable[pd.DataFrame], key: str) -> Iterator[tuple[object, dict[str, np.ndarray]]]:
    """(key, columns) of a group's rows, for each key that has some, with nulls as pandas would show them for this key alone."""
    parts = list(batches)
    if not sum(map(len, parts)):
        return
    columns = {c: np.concatenate([p[c].to_numpy() for p in parts]) for c in parts[0].columns if c != "group__"}
    codes, found = pd.factorize(columns.pop(key))
    codes = np.where(columns.pop(f"isnull__{key}").astype(bool), len(found), codes)
    order = np.argsort(codes, kind="stable")
    columns = {c: v[order] for c, v in columns.items()}
    numbers, starts = np.unique(codes[order], return_index=True)
    names = [*found.tolist(), None]
    for number, low, high in zip(numbers.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        own = {c: v[low:high] for c, v in columns.items()}
        for c in [c for c in own if c.startswith("isnull__")]:
            missing = own.pop(c).astype(bool)
            if missing.any():
                v = own[c.removeprefix("isnull__")]
                own[c.removeprefix("isnull__")] = np.where(missing, None, v.astype(object)) if v.dtype == bool else np.where(missing, np.nan, v)
        yield names[number], own


class _Held:
    """The state of one key of a group, with what GroupState has."""

    def __init__(self, value: tuple | None):
        self.get = value

    @property
    def exists(self) -> bool:
        return self.get is not None

    def update(self, value: tuple) -> None:
        self.get = value

    def remove(self) -> None:
        self.get = None


def _stateful(df: DataFrame, key: str, step: Callable, output: str, state: str, idle: str | None = None, groups: int = GROUPS) -> DataFrame:
    """step over each key's rows, giving columns beside the key's, which is output's first; with idle, such as `1 hour`, state that
    step leaves is dropped, with nothing given out, after so long without rows.

    Spark runs batches for ever to watch such times, so idle is for streams that run on, not for availableNow.
    """
    kinds = dict(c.split() for c in output.split(", "))
    names = list(kinds)
    number, unit = (idle or "0 seconds").split()
    wait = int(number) * {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}[unit.removesuffix("s")] * 1_000
    kept = f"_keys array<{dict(df.dtypes)[key]}>, _seen array<long>, " + ", ".join("{} array<{}>".format(*c.split(" ", 1)) for c in state.split(", "))

    def run(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        keys, seen, *values = held.get if held.exists else ([], [])
        states = dict(zip(keys, zip(*values, strict=True), strict=True))
        times = dict(zip(keys, seen, strict=True)) if idle else {}
        now = held.getCurrentProcessingTimeMs() if idle else 0
        out: list[tuple] = []
        if not held.hasTimedOut:
            rows = 0
            for k, columns in keyed(batches, key):
                one = _Held(states.get(k))
                for given in step((k,), [columns], one):
                    lists = [v.tolist() if isinstance(v, np.ndarray) else list(v) for v in (given[n] for n in names[1:])]
                    if lists[0]:
                        out.append(([k] * len(lists[0]), *lists))
                        rows += len(lists[0])
                if one.exists:
                    states[k], times[k] = one.get, now
                else:
                    states.pop(k, None)
                if rows >= GIVEN_ROWS:
                    yield _frame(out, kinds)
                    out, rows = [], 0
        if idle:
            states = {k: v for k, v in states.items() if times[k] + wait > now}
        if states:
            held.update((list(states), [times[k] for k in states] if idle else [], *map(list, zip(*states.values(), strict=True))))
            if idle:
                held.setTimeoutDuration(max(1, min(times[k] for k in states) + wait - now))
        elif held.exists:
            held.remove()
        if out:
            yield _frame(out, kinds)

    rows = grouped(df, key, groups)
    return rows.groupBy("group__").applyInPandasWithState(run, output, kept, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def _frame(parts: list[tuple], kinds: dict[str, str]) -> pd.DataFrame:
    """The columns of some keys one after the other; a null among whole numbers doesn't make the others floats."""
    columns = {}
    for i, (name, kind) in enumerate(kinds.items()):
        values = list(chain.from_iterable(p[i] for p in parts))
        columns[name] = pd.Series(values)
        if kind in ("long", "int") and columns[name].dtype.kind != "i":
            columns[name] = pd.Series([None if v is None or v != v else int(v) for v in values], dtype="Int64")
    return pd.DataFrame(columns)


def ordered_columns(batches: Iterable, by: tuple[str, ...], *names: str) -> list[np.ndarray]:
    """The named columns of a key's rows, in the order of the columns `by`: a key has few rows in a batch, so frames are neither joined nor sorted whole."""
    parts = list(batches)
    column = lambda name: np.asarray(parts[0][name]) if len(parts) == 1 else np.concatenate([np.asarray(p[name]) for p in parts])
    order = np.lexsort([column(name) for name in reversed(by)])
    return [column(name)[order] for name in names]


def look_around(frames: DataFrame, value: str, back: int, ahead: int, last: str = "last", idle: str | None = None) -> DataFrame:
    """(episode_index, frame_index, window, is_pad): each frame's values from back frames before to ahead after, clamped.

    A frame is given out once its look-ahead has come or the episode's last frame (flag `last`) has; state holds at most
    back + ahead frames. Frames of an episode come in order.
    """

    def step(key: tuple, batches: Iterable, state: _Held) -> Iterator[dict]:
        at, values, base, given = state.get if state.exists else ([], [], 0, 0)
        at, values = list(at), list(values)
        frame, x, over = ordered_columns(batches, ("frame_index",), "frame_index", value, last)
        at += frame.tolist()
        values += x.astype(float).tolist()
        ended = bool(over.any())
        ready = len(at) if ended else max(given, len(at) - ahead)
        out = []
        for i in range(given, ready):
            places = range(i - back, i + ahead + 1)
            out.append((at[i], [values[max(0, min(len(at) - 1, p))] for p in places], [p + base < 0 or p >= len(at) for p in places]))
        keep = max(0, ready - back)
        if ended:
            state.remove()
        else:
            state.update((at[keep:], values[keep:], base + keep, ready - keep))
        yield {name: [o[i] for o in out] for i, name in enumerate(("frame_index", "window", "is_pad"))}

    return _stateful(frames.select("episode_index", "frame_index", value, last), "episode_index", step, "episode_index long, frame_index long, window array<double>, is_pad array<boolean>", "at array<long>, vals array<double>, base long, given long", idle)


def _with_end(rows: DataFrame, ended: str | None) -> DataFrame:
    return rows.withColumn("ended", F.col(ended) if ended else F.lit(False))


def merge_actions(chunks: DataFrame, combine: Callable[[float, float], float], ended: str | None = None, idle: str | None = None) -> DataFrame:
    """(robot, timestep, action): queued and incoming actions as they are taken.

    chunks: robot, timestep, action, taken (the latest timestep the robot has executed), and a flag that the robot has ended.
    Timesteps up to taken are dropped as late; a timestep that comes again is combined. What the robot executes next is given
    out; state is the open queue, and goes with the end or after idle.
    """

    def step(key: tuple, batches: Iterable, state: _Held) -> Iterator[dict]:
        steps, actions, latest = state.get if state.exists else ([], [], -1)
        queue, out = dict(zip(steps, actions, strict=True)), []
        at, xs, taken, over = ordered_columns(batches, ("taken", "seq", "timestep"), "timestep", "action", "taken", "ended")
        before = None
        for s, x, now in zip(at.tolist(), xs.tolist(), taken.tolist(), strict=True):
            if now != before:  # the robot is at another timestep
                for t in sorted(t for t in queue if t <= now):
                    out.append((t, queue.pop(t)))
                latest, before = max(latest, now), now
            if s > latest:
                queue[s] = combine(queue[s], x) if s in queue else x
        if over.any():
            state.remove()
        else:
            state.update((list(queue), list(queue.values()), latest))
        yield {"timestep": [t for t, _ in out], "action": [x for _, x in out]}

    rows = _with_end(chunks, ended).where("taken is not null or ended").select("robot", "seq", "timestep", "action", "taken", "ended")
    return _stateful(rows, "robot", step, "robot long, timestep long, action double", "steps array<long>, actions array<double>, latest long", idle)


def distinct_observations(rows: DataFrame, tolerance: float, ended: str | None = None, idle: str | None = None) -> DataFrame:
    """(robot, timestep, x): observations that are new: their timestep wasn't seen and x differs from the last kept one by
    tolerance or more; must_go ones always pass. State is the last kept one, and goes with the flag ended or after idle."""

    def step(key: tuple, batches: Iterable, state: _Held) -> Iterator[dict]:
        last, x = state.get if state.exists else (-1, float("nan"))
        at, xs, must, over = ordered_columns(batches, ("timestep",), "timestep", "x", "must_go", "ended")
        kept = []
        for i, (t, v, go) in enumerate(zip(at.tolist(), xs.astype(float).tolist(), must.tolist(), strict=True)):
            if go or (t > last and not abs(v - x) < tolerance):
                last, x = t, v
                kept.append(i)
        if over.any():
            state.remove()
        else:
            state.update((last, x))
        yield {"timestep": at[kept], "x": xs[kept]}

    return _stateful(_with_end(rows, ended).select("robot", "timestep", "x", "must_go", "ended"), "robot", step, "robot long, timestep long, x double", "last long, x double", idle)


def episodes_of(rows: DataFrame, longest: int = 100_000, idle: str | None = None) -> DataFrame:
    """(source, episode, frame_index, seq): rows of each source numbered in episodes that end at done, given out when they end.

    An episode of more than longest rows is given out as it comes, so that state holds no more; one that never ends goes after idle.
    """

    def step(key: tuple, batches: Iterable, state: _Held) -> Iterator[dict]:
        held, episode, given = state.get if state.exists else ([], 0, 0)
        new, ends = ordered_columns(batches, ("seq",), "seq", "done")
        seq = np.concatenate((np.array(list(held), np.int64), new.astype(np.int64)))
        done = np.concatenate((np.zeros(len(held), bool), ends.astype(bool)))
        before = np.cumsum(done) - done  # episodes that ended earlier
        starts = np.searchsorted(before, before)
        frame = np.arange(len(seq)) - starts + np.where(before == 0, given, 0)
        ended = int(done.sum())
        closed = before < ended
        left = seq[~closed]
        over = len(left) > longest
        out = closed | over
        given = (given if not ended else 0) + len(left) * over
        state.update(([] if over else left.tolist(), episode + ended, given))
        yield {"episode": episode + before[out], "frame_index": frame[out], "seq": seq[out]}

    return _stateful(rows.select("source", "seq", "done"), "source", step, "source long, episode long, frame_index long, seq long", "held array<long>, episode long, given long", idle)


def stepwise(rows: DataFrame, dt: float, jump: float | None = None, ended: str | None = None, idle: str | None = None) -> DataFrame:
    """(episode_index, frame_index, velocity, jumped, step, held): the stateful steps of an episode, reset at its first frame.

    velocity is (x - x before) / dt and 0 at first; jumped tells that x moved by more than jump; step counts the frames; held is
    x at the latest rising edge of enabled, 0 before any. rows: episode_index, frame_index, x, enabled. State is four values,
    and goes with the flag ended or after idle.
    """

    def step(key: tuple, batches: Iterable, state: _Held) -> Iterator[dict]:
        frame, x, on, over = ordered_columns(batches, ("frame_index",), "frame_index", "x", "enabled", "ended")
        x, on = x.astype(float), on.astype(bool)
        last, was, count, held = state.get if state.exists else (x[0], False, 0, 0.0)
        before = np.concatenate(([last], x[:-1]))
        rising = on & ~np.concatenate(([was], on[:-1]))
        edge = np.maximum.accumulate(np.where(rising & ~np.isnan(x), np.arange(len(x)), -1))
        latched = np.where(edge < 0, held, x[edge])
        if over.any():
            state.remove()
        else:
            state.update((float(x[-1]), bool(on[-1]), count + len(x), float(latched[-1])))
        moved = np.abs(x - before) > (jump if jump is not None else np.inf)
        yield {"frame_index": frame, "velocity": (x - before) / dt, "jumped": moved, "step": count + np.arange(1, len(x) + 1), "held": latched}

    rows = _with_end(rows, ended).select("episode_index", "frame_index", "x", "enabled", "ended")
    return _stateful(rows, "episode_index", step, "episode_index long, frame_index long, velocity double, jumped boolean, step long, held double", "x double, enabled boolean, count long, held double", idle)


def latency(rows: DataFrame, size: int = 100, ended: str | None = None, idle: str | None = None) -> DataFrame:
    """(robot, seq, n, max): after each batch, over the newest size values of each robot; seq is the newest. State is the ring,
    and goes with the flag ended or after idle."""

    def step(key: tuple, batches: Iterable, state: _Held) -> Iterator[dict]:
        seq, values, over = ordered_columns(batches, ("seq",), "seq", "value", "ended")
        ring = ((list(state.get[0]) if state.exists else []) + values.tolist())[-size:]
        if over.any():
            state.remove()
        else:
            state.update((ring,))
        yield {"seq": [int(seq[-1])], "n": [len(ring)], "max": [max(ring)]}

    return _stateful(_with_end(rows, ended).select("robot", "seq", "value", "ended"), "robot", step, "robot long, seq long, n long, max double", "ring array<double>", idle)


def windowed_latency(rows: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """By event time: count and mean in windows, rows later than the watermark dropped."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def routed(rows: DataFrame, folder: str, checkpoint: str):
    """The query that appends each batch without NaN to folder/online, and its interventions to folder/offline too; a batch
    that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.where(~F.isnan("x"))
        kept.write.mode("overwrite").parquet(f"{folder}/online/batch={number}")
        kept.where("is_intervention > 0.5").write.mode("overwrite").parquet(f"{folder}/offline/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
