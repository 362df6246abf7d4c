"""Streams whose state is kept by element: lists that are added to and maps whose entries are read and written one by one.

Where an operator in `stateful` reads and writes a key's whole state with each batch, these touch only what a batch changes. They
need the state store that keeps elements apart (RocksDB), which `element_store` asks the session for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framewright.streaming.stateful import GIVEN_ROWS, GROUPS, grouped, keyed, ordered_columns

#: Rows of an episode that are read back at a time.
CHUNK = 10_000


def element_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Sessions(StatefulProcessor):
    """Open rows in a list that only grows until the episode ends; (episode, rows in the list) beside it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "seq long")
        self.place = handle.getValueState("place", "episode long, rows long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        episode, count = self.place.get() or (0, 0)
        seq, done = ordered_columns(rows, ("seq",), "seq", "done")
        before = np.cumsum(done) - done  # episodes that ended earlier in this batch
        ended = int(done.sum())
        first = int(np.searchsorted(before, ended))  # where the episode that stays open begins
        if ended:
            if count:  # the list is read when its episode ends, and not before
                at, chunk = 0, []
                for (s,) in self.held.get():
                    chunk.append(s)
                    if len(chunk) == CHUNK:
                        yield self._given(key, episode, at, chunk)
                        at, chunk = at + CHUNK, []
                if chunk:
                    yield self._given(key, episode, at, chunk)
                self.held.clear()
            frame = np.arange(first) - np.searchsorted(before, before[:first]) + np.where(before[:first] == 0, count, 0)
            yield pd.DataFrame({"source": key[0], "episode": episode + before[:first], "frame_index": frame, "seq": seq[:first]})
            count = 0
        if first < len(seq):
            self.held.appendList([(s,) for s in seq[first:].tolist()])
        self.place.update((episode + ended, count + len(seq) - first))

    @staticmethod
    def _given(key, episode: int, at: int, seq) -> pd.DataFrame:
        return pd.DataFrame({"source": key[0], "episode": episode, "frame_index": np.arange(at, at + len(seq)), "seq": seq})

    def close(self) -> None:
        pass


class _SessionGroups(StatefulProcessor):
    """The same for a group of sources at a time. Beside each source's place lie its open rows, up to `short` of them; more go to
    entries of a map, by source and number, that are written once and read when the episode ends."""

    def __init__(self, key: str, short: int):
        self.key, self.short = key, short

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", f"sources array<{self.key}>, episodes array<long>, rows array<long>, entries array<long>, open array<array<long>>")
        self.held = handle.getMapState("held", f"source {self.key}, entry long", "seq array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.place.get() or ([],) * 5
        places = {source: rest for source, *rest in zip(*stored, strict=True)}
        out = {"source": [], "episode": [], "frame_index": [], "seq": []}

        def give(source, episode: np.ndarray, frame: np.ndarray, seq) -> None:
            for name, part in zip(out, ([source] * len(seq), episode, frame, seq), strict=True):
                out[name].extend(part if isinstance(part, list) else part.tolist())

        for source, columns in keyed(rows, "source"):
            episode, count, entries, held = places.get(source, (0, 0, 0, []))
            held = list(held)
            seq, done = ordered_columns([columns], ("seq",), "seq", "done")
            done = done.astype(bool)
            before = np.cumsum(done) - done  # episodes that ended earlier in this batch
            ended = int(done.sum())
            first = int(np.searchsorted(before, ended))  # where the episode that stays open begins
            if ended:
                at = 0
                for entry in range(entries):  # entries are read when their episode ends, and not before
                    (chunk,) = self.held.getValue((source, entry))
                    give(source, np.full(len(chunk), episode), np.arange(at, at + len(chunk)), list(chunk))
                    self.held.removeKey((source, entry))
                    at += len(chunk)
                    if len(out["seq"]) >= GIVEN_ROWS:
                        yield pd.DataFrame(out)
                        out = {name: [] for name in out}
                give(source, np.full(len(held), episode), np.arange(at, at + len(held)), held)
                give(source, episode + before[:first], np.arange(first) - np.searchsorted(before, before[:first]) + np.where(before[:first] == 0, count, 0), seq[:first])
                count, entries, held = 0, 0, []
            held += seq[first:].tolist()
            if len(held) > self.short:
                for i in range(0, len(held), CHUNK):
                    self.held.updateValue((source, entries), (held[i : i + CHUNK],))
                    entries += 1
                held = []
            places[source] = (episode + ended, count + len(seq) - first, entries, held)
            if len(out["seq"]) >= GIVEN_ROWS:
                yield pd.DataFrame(out)
                out = {name: [] for name in out}
        self.place.update((list(places), *map(list, zip(*places.values(), strict=True))))
        if out["seq"]:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def long_episodes_of(rows: DataFrame, groups: int | None = GROUPS, short: int = 1_000) -> DataFrame:
    """(source, episode, frame_index, seq): rows of each source (source, seq, done) numbered in episodes that end at done, given out
    when they end. A batch adds its rows to the open episode without reading those before, but for the newest `short` at most, so that
    episodes may be long; the rows of a source come in the order of seq. Sources are called in so many groups, or with None each by itself."""
    element_store(rows.sparkSession)
    rows, output = rows.select("source", "seq", "done"), "source long, episode long, frame_index long, seq long"
    if groups is None:
        return rows.groupBy("source").transformWithStateInPandas(_Sessions(), output, "append", "none")
    return grouped(rows, "source", groups).groupBy("group__").transformWithStateInPandas(_SessionGroups(dict(rows.dtypes)["source"], short), output, "append", "none")


class _Queue(StatefulProcessor):
    """Open actions by timestep; the latest timestep taken, and when the queue closes, beside them."""

    def __init__(self, combine: Callable[[float, float], float], idle_ms: int):
        self.combine, self.idle_ms = combine, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "timestep long", "action double")
        self.place = handle.getValueState("place", "latest long, last long, closes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, last, closes = self.place.get() or (-1, -1, -1)
        new = list(rows)
        at, xs, takens = ordered_columns(new, ("taken", "seq", "timestep"), "timestep", "action", "taken")
        sent, read, stored = {}, set(), last  # what this batch sends; which of it is stored too; none beyond stored is
        out, before = [], None
        for s, x, taken in zip(at.tolist(), xs.tolist(), takens.tolist(), strict=True):
            if taken != before:  # the robot is at another timestep
                for t in range(latest + 1, min(taken, last) + 1):  # what is taken now: these entries and no others are read
                    if t in sent:
                        out.append((t, sent.pop(t)))
                        if t in read:
                            self.queue.removeKey((t,))
                    elif t <= stored and self.queue.containsKey((t,)):
                        out.append((t, self.queue.getValue((t,))[0]))
                        self.queue.removeKey((t,))
                latest, before = max(latest, taken), taken
            if s <= latest:
                continue
            if s in sent:
                sent[s] = self.combine(sent[s], x)
            elif s <= stored and self.queue.containsKey((s,)):
                sent[s] = self.combine(self.queue.getValue((s,))[0], x)
                read.add(s)
            else:
                sent[s] = x
            last = max(last, s)
        for s, x in sent.items():  # what the batch both sends and takes is never stored
            self.queue.updateValue((s,), (x,))
        if closes >= 0:
            self.handle.deleteTimer(closes)
        closes = int(max(p["ts"].max() for p in new).timestamp() * 1000) + self.idle_ms
        self.handle.registerTimer(closes)
        self.place.update((latest, last, closes))
        if out:
            yield pd.DataFrame({"robot": key[0], "timestep": [t for t, _ in out], "action": [x for _, x in out], "closed": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The robot is silent: what it still has is given out as closed, and its state goes."""
        left = sorted((s, x) for (s,), (x,) in self.queue.iterator())
        self.queue.clear()
        self.place.clear()
        if left:
            yield pd.DataFrame([(key[0], s, x, True) for s, x in left], columns=["robot", "timestep", "action", "closed"])

    def close(self) -> None:
        pass


def queued_actions(chunks: DataFrame, combine: Callable[[float, float], float], late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """(robot, timestep, action, closed): actions as they are taken, and those left when a robot has been silent for idle_ms of event time.

    chunks: robot, seq, timestep, action, taken (the latest timestep executed) and ts. Timesteps up to taken are late and dropped, a
    timestep that comes again is combined; chunks whose ts is under the watermark, late behind the newest ts, are dropped whole. A queue
    is a map by timestep of which only the entries that are taken or sent again are read.
    """
    element_store(chunks.sparkSession)
    rows = chunks.select("robot", "seq", "timestep", "action", "taken", "ts").withWatermark("ts", late)
    return rows.where("taken is not null").groupBy("robot").transformWithStateInPandas(_Queue(combine, idle_ms), "robot long, timestep long, action double, closed boolean", "append", "EventTime")
