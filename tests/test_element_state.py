"""State by element: what a batch reads and writes of it."""

import pandas as pd

from framewright.operators import steps as P
from framewright.streaming import elements as E, stateful as R


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Entries(dict):
    """A map state that counts the entries it is asked for."""

    asked = 0

    def containsKey(self, k):
        self.asked += 1
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]

    def iterator(self):
        return iter(list(self.items()))


class Held(list):
    reads = 0

    def appendList(self, rows):
        self.extend(rows)

    def get(self):
        self.reads += 1
        return iter(list(self))


class Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Entries())

    def getListState(self, name, *_):
        return self.states.setdefault(name, Held())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Value())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def batch(seq, steps, taken, minute):
    return pd.DataFrame({"robot": 1, "seq": seq, "timestep": steps, "action": [float(s) for s in steps], "taken": taken, "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute)})


def test_a_queue_reads_only_what_is_taken_or_sent_again():
    queue, handle = E._Queue(lambda old, new: old + new, 60_000), Handle()
    queue.init(handle)
    assert list(queue.handleInputRows((1,), iter([batch(0, list(range(1000)), -1, 0)]), None)) == []
    entries = handle.states["queue"]
    entries.asked = 0
    (out,) = queue.handleInputRows((1,), iter([batch(1, [500, 501, 1000], 3, 5)]), None)
    assert out.values.tolist() == [[1, s, float(s), False] for s in range(4)] and entries.asked == 4 + 2
    assert entries[(500,)] == (1000.0,) and len(entries) == 997
    assert len(handle.timers) == 1  # the one before is gone
    (left,) = queue.handleExpiredTimer((1,), None, None)
    assert left["timestep"].tolist() == list(range(4, 1001)) and left["closed"].all()
    entries.clear()
    assert not handle.states["place"].exists()


def test_a_session_is_read_when_it_ends():
    sessions, handle = E._Sessions(), Handle()
    sessions.init(handle)
    rows = lambda seq, ends=(): pd.DataFrame({"source": 1, "seq": seq, "done": [s in ends for s in seq]})
    for k in range(5):
        assert list(sessions.handleInputRows((1,), iter([rows(range(10 * k, 10 * k + 10))]), None)) == []
    held = handle.states["held"]
    assert held.reads == 0 and len(held) == 50
    out = pd.concat(sessions.handleInputRows((1,), iter([rows(range(50, 60), (52, 55))]), None))
    assert held.reads == 1 and len(held) == 4
    assert out["seq"].tolist() == list(range(56)) and out["frame_index"].tolist() == [*range(53), 0, 1, 2] and out["episode"].tolist() == [0] * 53 + [1] * 3


def test_functions_along_episodes(spark):
    class Last:
        def __init__(self):
            self.n, self.key = 0, None

        def eval(self, row):
            self.key, self.n = row["episode_index"], self.n + 1
            if row["x"] > 5:
                yield self.key, self.n

        def terminate(self):
            yield self.key, -self.n

    f = spark.createDataFrame([(e, i, float(e + i)) for e in (1, 4) for i in (2, 0, 1)], "episode_index long, frame_index long, x double")
    got = sorted(map(tuple, P.expanded_along(f, Last, "episode_index long, n long").collect()))
    assert got == [(1, -3), (4, -3), (4, 3)]
    assert P.expanded_along(f.limit(0), Last, "episode_index long, n long").count() == 0


def test_idle_state_goes(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "robot long, seq long, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = R.latency(stream, 3, idle="1 seconds").writeStream.format("memory").queryName("idle_state").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            q.awaitTermination(0.5)
            held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
            if 1 in held and held[-1] == 0:
                break
    finally:
        q.stop()
    assert 1 in held and held[-1] == 0 and spark.table("idle_state").collect()[0]["max"] == 5.0


def test_a_queue_stores_only_what_a_batch_leaves_open():
    queue, handle = E._Queue(lambda old, new: old + new, 60_000), Handle()
    queue.init(handle)
    entries, stored = handle.getMapState("queue"), []
    entries.updateValue = lambda k, v: (stored.append(k), entries.__setitem__(k, v))
    rows = pd.concat([batch(s, [s + 1, s + 2], s - 1, s) for s in range(50)])  # a step is sent twice and then taken
    (out,) = queue.handleInputRows((1,), iter([rows.iloc[60:], rows.iloc[:60]]), None)
    assert out["timestep"].tolist() == list(range(1, 49)) and out["action"].tolist() == [1.0] + [2.0 * s for s in range(2, 49)]
    assert sorted(stored) == [(49,), (50,), (51,)] and entries.asked == 0
    (out,) = queue.handleInputRows((1,), iter([batch(50, [49, 51, 52], 49, 50)]), None)
    assert out["timestep"].tolist() == [49] and dict(entries) == {(50,): (100.0,), (51,): (102.0,), (52,): (52.0,)}


def test_batches_of_a_stream_do_not_grow_with_its_rows(spark, monkeypatch):
    from framewright.plans import stream_queries as Q

    monkeypatch.setattr(Q, "SLICE_ROWS", 50)
    rows = spark.range(1000).selectExpr("id as robot", "id as seq", "double(id) as value", "id as _seq")
    seen = []
    q = Q._source(rows).writeStream.foreachBatch(lambda b, n: seen.append([r.seq for r in b.collect()])).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) <= 5 and sorted(sum(seen, [])) == list(range(1000))
    assert all(max(a) < min(b) for a, b in zip(seen, seen[1:]))  # in order


def test_keys_are_called_and_stored_in_groups(spark, tmp_path):
    """Each key's results are those that it has alone, nulls and large numbers included, and states lie in few rows."""
    n, big = 1_500, 2**60 + 1
    rows = spark.range(n).selectExpr("if(id = 7, null, id) as robot", "id + 1 as _at").selectExpr("robot", "explode(array(_at, _at + 1)) as timestep", "double(0) as x", "false as must_go")
    more = spark.createDataFrame([(-1, big, 5.0, False), (-2, None, 5.0, True)], "robot long, timestep long, x double, must_go boolean")
    rows.unionByName(more).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = R.distinct_observations(stream, 1.0)
    q = out.writeStream.format("memory").queryName("grouped_keys").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.robot, r.timestep) for r in spark.table("grouped_keys").collect()}
    assert got == {(None if i == 7 else i, i + 1) for i in range(n)} | {(-1, big), (-2, None)}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= R.GROUPS


def test_long_sessions_of_a_group_are_read_when_they_end():
    sessions, handle = E._SessionGroups("bigint", 15), Handle()
    sessions.init(handle)

    def rows(seq, ends=()):
        both = [(source, s, s in ends and source == 1) for s in seq for source in (1, 2)]
        return R.pd.DataFrame(both, columns=["source", "seq", "done"]).assign(isnull__source=False, isnull__seq=False, isnull__done=False)

    for k in range(5):
        assert list(sessions.handleInputRows((0,), iter([rows(range(10 * k, 10 * k + 10))]), None)) == []
    entries = handle.states["held"]
    reads, entries.getValue = [], lambda k: (reads.append(k), entries[k])[1]
    assert sorted(entries) == [(1, 0), (1, 1), (2, 0), (2, 1)]  # each written once, of 20 rows
    out = pd.concat(sessions.handleInputRows((0,), iter([rows(range(50, 60), (52, 55))]), None))
    assert sorted(entries) == [(2, 0), (2, 1), (2, 2)] and reads == [(1, 0), (1, 1)]
    assert out["source"].tolist() == [1] * 56 and out["seq"].tolist() == list(range(56))
    assert out["frame_index"].tolist() == [*range(53), 0, 1, 2] and out["episode"].tolist() == [0] * 53 + [1] * 3
