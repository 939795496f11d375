"""Sessions on a stream: late rows, restarts, the week's end, rows that only carry the time."""

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from activity_engine.operators import sessions as SE
from activity_engine.streaming.sessions import Sessions, append_to_parquet, appended, session_stream

SCHEMA = "user long, week int, pcid string, ts timestamp, actid long, act int"
DAY0 = dt.datetime(2023, 12, 31)


def at(hours):
    return DAY0 + dt.timedelta(hours=hours)


def run(spark, tmp_path, batches):
    """Each batch is a run of its own, which goes on from the state of the one before."""
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        append_to_parquet(session_stream(stream, "2023-12-31", "1 hour"), f"{tmp_path}/out")
    return sorted(tuple(r) for r in appended(session_stream(stream, "2023-12-31", "1 hour"), f"{tmp_path}/out").collect())


def test_late_rows_and_week_end(spark, tmp_path):
    silence = lambda h: [(None, None, None, at(h), None, None)]
    batches = [
        [(1, 0, "a", at(10), 1, 1), (1, 0, "a", at(9.5), 2, 5)],  # out of order within the delay
        silence(20),
        [(1, 0, "a", at(9.7), 3, 2), (1, 0, "a", at(20), 4, 5)],  # the first is too late: the session stays open
        silence(30) + [(1, 0, "a", at(29.5), 5, 2)],
        [(2, 0, "a", at(30), 6, 1)],
        silence(24 * 7 + 5),  # user 2's session is still open at the end of its week
        [(1, 1, "a", at(24 * 7 + 6), 7, 5), (1, 1, "a", at(24 * 7 + 7), 8, 2), (1, 1, "a", at(24 * 7 + 8), 9, 2)],
        silence(24 * 40),
    ]
    got = run(spark, tmp_path, batches)
    assert got == [(1, 0, "a", 1, 1, at(10), at(29.5), 3), (1, 0, "a", 2, 2, at(9.5), at(9.5), 1), (1, 1, "a", 2, 1, at(24 * 7 + 6), at(24 * 7 + 7), 2)]


def test_stream_equals_windows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(u, w, f"p{rng.randrange(2)}", at(24 * 7 * w + rng.randrange(24 * 7 * 60) / 60), i, rng.choice([1, 2, 2, 5, 6])) for i, (u, w) in enumerate((u, w) for u in range(4) for w in range(2) for _ in range(40))]
    want = SE.session_table(SE.sessionize(spark.createDataFrame(rows, SCHEMA)))
    want = sorted(tuple(r) for r in want.select("user", F.col("week").cast("int"), "pcid", "start_with", "end_with", "start_ts", "end_ts", "n_acts").collect())
    rows.sort(key=lambda r: r[3])
    feed = [rows[i : i + 110] for i in range(0, len(rows), 110)]
    for part in feed:
        rng.shuffle(part)
    assert run(spark, tmp_path, [*feed, [(None, None, None, at(24 * 60), None, None)]]) == want


class State:
    """What a processor keeps, with the number of calls to it."""

    def __init__(self, single=False):
        self.rows, self.timers, self.calls, self.single = [], [], 0, single

    def _count(self, out=None):
        self.calls += 1
        return out

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        self.other = State(single=True)
        return self.other

    listTimers = lambda self: self._count(iter(list(self.timers)))
    deleteTimer = lambda self, t: self._count(self.timers.remove(t))
    registerTimer = lambda self, t: self._count(self.timers.append(t))
    appendValue = lambda self, row: self._count(self.rows.append(row))
    clear = lambda self: self._count(self.rows.clear())
    exists = lambda self: self._count(bool(self.rows))

    def update(self, row):
        self.calls, self.rows = self.calls + 1, [row]

    def get(self):
        self.calls += 1
        return self.rows[0] if self.single else iter(list(self.rows))


def test_calls_to_the_state_do_not_grow_with_keys():
    """A group of 500 keys in five steps: the sessions of a plain automaton, by as many calls as one key takes."""
    rng, calls = random.Random(3), []
    for users in (1, 500):
        rows = [(u, 0, rng.choice([None, "a"]), rng.randrange(24 * 7 * 3600) * 10**6, i, rng.choice([1, 2, 2, 5])) for i, u in enumerate(rng.choices(range(users), k=4000))]
        state, got = State(), []
        p = Sessions(0)
        p.init(state)
        for step in range(5):  # a day late at most, and in no order
            end = (step + 1) * 34 * 3600 * 1000
            part = [r for r in rows if (end - 34 * 3600 * 1000) * 1000 <= r[3] < end * 1000]
            frame = pd.DataFrame(part, columns=["user", "week", "pcid", "us", "actid", "act"])
            list(p.handleInputRows((0,), iter([frame]), None))
            watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda end=end, step=step: end - 86_400_000 if step < 4 else 8 * 86_400_000)
            got += [tuple(r) for f in p.handleExpiredTimer((0,), watermark, None) for r in f.itertuples(index=False)]
        want, keys = [], {}
        for r in sorted(rows, key=lambda r: r[3:]):
            keys.setdefault(r[:3], []).append(r)
        for key, own in keys.items():
            session = None
            for _, _, _, us, _, act in own:
                if session and act == 1:
                    want.append((*key, session[0], 2, *session[1:]))
                    session = None
                if not session:
                    session = (1 if act == 1 else 2, us, us, 1)
                    continue
                session = (session[0], session[1], us, session[3] + 1)
                if act == 2:
                    want.append((*key, session[0], 1, *session[1:]))
                    session = None
        assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 100
        assert not state.rows and not state.other.rows
        calls.append(state.calls + state.other.calls)
    assert calls[1] <= calls[0] + 5
