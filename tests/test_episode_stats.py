"""Statistics of episodes: gathered by frame, and right on odd vectors."""

import math

from framewright.operators import stats as S


def test_episode_stats_group_frames_and_not_elements(spark):
    nan = float("nan")
    rows = [(1, [1.0, None]), (1, [3.0, nan, 5.0]), (1, None), (1, [2.0, 4.0]), (2, [7.0]), (3, None), (4, [None])]
    f = spark.createDataFrame(rows, "episode_index long, state array<double>")
    df = S.feature_stats(f, ["state"], ("episode_index",), (0.5,))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan[plan.rindex("Aggregate") :]  # nothing is taken apart before it is grouped
    got = {(r.episode_index, r.dim): tuple(r)[3:] for r in df.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0), (4, 0)}
    assert got[1, 0][:4] == (3, 1.0, 3.0, 2.0) and math.isclose(got[1, 0][4], math.sqrt(2 / 3)) and got[1, 0][5] == 2.0
    assert got[1, 1][:2] == (2, 4.0) and all(math.isnan(v) for v in got[1, 1][2:])
    assert got[1, 2] == (1, 5.0, 5.0, 5.0, 0.0, 5.0) and got[2, 0] == (1, 7.0, 7.0, 7.0, 0.0, 7.0)
    assert got[4, 0] == (0, None, None, None, None, None)
