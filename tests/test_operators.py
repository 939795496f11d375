"""Operators against plain-Python statements of their rules, on small made-up logs."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from activity_engine.functions import scalars as S
from activity_engine.operators import actions as A
from activity_engine.operators import evaluate as E
from activity_engine.operators import features as X
from activity_engine.operators import params as P
from activity_engine.operators import ranking as R
from activity_engine.operators import scoring as C
from activity_engine.operators import sequences as Q
from activity_engine.operators import sessions as SE
from activity_engine.operators import temporal as T
from activity_engine.operators import users as U


def literal_sessions(rows):
    """One user-week, told row by row: rows are (order, pc, act)."""
    open_, done = {}, []

    def start(pc, r, kind):
        open_[pc] = {"pc": pc, "start": kind, "n": 1, "rows": [r]}
        if len(open_) > 1:
            for s in open_.values():
                s["n"] += 1

    for r, pc, act in rows:
        if pc not in open_:
            start(pc, r, 1 if act == 1 else 2)
        elif act == 2:
            s = open_.pop(pc)
            s["rows"].append(r)
            done.append(s | {"end": 1})
        elif act == 1:
            done.append(open_.pop(pc) | {"end": 2})
            start(pc, r, 1)
        else:
            open_[pc]["rows"].append(r)
    return [(i, s["pc"], s["start"], s["end"], s["n"], tuple(s["rows"])) for i, s in enumerate(done)]


def test_sessions_against_the_literal_rule(spark):
    rng = random.Random(11)
    logs, want, n = [], {}, 0
    t0 = dt.datetime(2024, 1, 1)
    for week in range(150):
        rows = []
        for j in range(rng.randint(1, 25)):
            rows.append((n, f"p{rng.randint(0, 3)}", rng.choice([1, 1, 2, 2, 2, 3, 5])))
            logs.append((n, 1, week, rows[-1][1], t0 + dt.timedelta(seconds=n), rows[-1][2]))
            n += 1
        for i, pc, a, b, c, members in literal_sessions(rows):
            want[week * 100000 + i] = (pc, a, b, c, members)
    df = spark.createDataFrame(logs, "actid long, user long, week int, pcid string, ts timestamp, act int")
    got = SE.sessionize(df).groupBy("session_id").agg(
        F.first("pcid").alias("pc"), F.first("start_with").alias("a"), F.first("end_with").alias("b"), F.first("n_concurrent").alias("c"), F.sort_array(F.collect_list("actid")).alias("m")
    )
    assert {r["session_id"]: (r["pc"], r["a"], r["b"], r["c"], tuple(r["m"])) for r in got.collect()} == want


def test_subsessions_at_the_edges(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 8) + dt.timedelta(minutes=m)
    rows = [(1, i, t(0), 1) for i in (1, 2)]  # no length
    rows += [(2, 3, t(0), 1), (2, 4, t(120), 1)]  # one chunk: all rows stay
    rows += [(3, 5, t(0), 2), (3, 6, t(130), 2), (3, 7, t(240), 2)]  # the last action on the edge is lost
    df = spark.createDataFrame(rows, "session_id long, actid long, ts timestamp, end_with int")
    assert {(r["session_id"], r["actid"], r["chunk"], r["end_with"]) for r in SE.by_time(df, 120).collect()} == {(2, 3, 0, 1), (2, 4, 0, 1), (3, 5, 0, 0), (3, 6, 1, 2)}
    assert {(r["actid"], r["chunk"], r["end_with"]) for r in SE.by_count(df.filter("session_id = 3"), 2).collect()} == {(5, 0, 0), (6, 0, 0), (7, 1, 2)}


def test_usb_duration(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 8) + dt.timedelta(seconds=s)
    rows = [(1, t(0), 3), (2, t(5), 5), (3, t(9), 4), (4, t(20), 3), (5, t(30), 3), (6, t(30), 4), (7, t(50), 3)]
    df = spark.createDataFrame(rows, "actid long, ts timestamp, act int").withColumn("user", F.lit(1))
    got = lambda legacy: {r["actid"]: r["usb_dur"] for r in A.usb_duration(df, ["user"], legacy=legacy).collect()}
    assert got(False) == {1: 9, 2: 0, 3: 0, 4: -1, 5: 0, 6: 0, 7: -1}
    assert got(True) == {1: -1, 2: 0, 3: 0, 4: -1, 5: 0, 6: 0, 7: -1}


def test_employment_gap_and_return(spark):
    rows = [("a", m, "r1" if m < "2010-02" else "r2") for m in ("2010-01", "2010-02", "2010-05")] + [("b", f"2010-0{i}", "r") for i in range(1, 6)] + [("c", "2010-03", "r"), ("d", "2010-04", "x")]
    got = {r["user"]: (r["role"], r["wstart"], r["wend"]) for r in U.employment(spark.createDataFrame(rows, "user string, month string, role string"), "user", "month", ["role"]).collect()}
    assert got == {"a": ("r1", "2010-01", "2010-03"), "b": ("r", "2010-01", None), "c": ("r", "2010-03", "2010-04"), "d": ("x", "2010-04", "2010-05")}


def test_scalars_of_odd_values(spark):
    df = spark.createDataFrame([("", "noscheme", "nodot", "a.zip(3);b.exe(4);c", "File Copy", "www upload", None)], "to string, url string, path string, att string, fact string, hact string, num string")
    cols = S.email_counts(S.addresses(F.col("to"), legacy=True), S.addresses(F.col("to")), S.addresses(F.col("to"), legacy=True), "dtaa.com")
    r = df.select(
        *[c.alias(n) for n, c in cols.items()], S.url_category(F.col("url"), S.domain(F.col("url"))).alias("cat"), S.file_type(S.extension(F.col("path"))).alias("ft"),
        *[c.alias(n) for n, c in S.attachment_features(F.col("att")).items()], S.coded(F.col("fact"), S.FILE_ACTIONS).alias("fa"), S.coded(F.col("hact"), S.HTTP_ACTIONS).alias("ha"),
        S.coded(F.col("to"), S.HTTP_ACTIONS).alias("none"), S.model_input(F.col("num")).alias("m0"), S.model_input(F.lit("x")).alias("mx"), S.model_input(F.lit(-3)).alias("neg"),
        S.date_text(F.lit("2010-01-04 07:30:00").cast("timestamp")).alias("txt"),
    ).first()
    assert (r["n_des"], r["n_bccdes"], r["n_exdes"], r["Xemail"], r["exbccmail"]) == (2, 1, 2, 1, 1)
    assert (r["cat"], r["ft"], r["n_atts"], r["e_att_comp"], r["e_att_scomp"], r["e_att_exe"], r["e_att_sexe"], r["e_att_other"]) == (1, 1, 3, 1, 3, 1, 4, 0)
    assert (r["fa"], r["ha"], r["none"], r["m0"], r["mx"], r["neg"], r["txt"]) == (2, 3, 0, 0.0, 0.0, 0.0, "01/04/2010 07:30:00")


def test_time_code_bounds(spark):
    times = ["2024-01-01 07:29:59", "2024-01-01 07:30:00", "2024-01-01 17:30:00", "2024-01-01 17:30:01", "2024-01-06 12:00:00", "2024-01-07 03:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(S.time_code(F.col("t").cast("timestamp")).alias("c"))
    assert [r["c"] for r in df.collect()] == [2, 1, 1, 2, 3, 4]


def test_percentile_rank_against_counts(spark):
    rng = random.Random(3)
    rows = [(u, d, float(rng.randint(0, 4)), float(rng.randint(0, 2))) for u in (1, 2) for d in range(20) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "user int, day int, a double, b double")
    want = {}
    for u, d, *x in rows:
        past = [r[2:] for r in rows if r[0] == u and d - 5 <= r[1] <= d - 1]
        if d >= min(r[1] for r in rows if r[0] == u) + 5 and past:
            want[u, d] = tuple((sum(p[i] < x[i] for p in past) + sum(p[i] <= x[i] for p in past)) * 50 / len(past) - 50 for i in (0, 1))
    got = {(r["user"], r["day"]): (r["a"], r["b"]) for r in T.percentile_rank(df, ["a", "b"], "user", "day", 5).collect()}
    assert got.keys() == want.keys() and all(abs(g - w) < 1e-9 for k in want for g, w in zip(got[k], want[k]))


def test_day_counts_add_up(spark):
    from activity_engine.sources.adapters import actions

    a = actions(spark, "/root/testdata/sf0.001")
    day, n = X.day_features(a).cache(), a.count()
    sums = day.agg(*[F.sum(f"`{c}`").alias(c) for c in ("n_allact", "n_workhourallact", "n_afterhourallact", "n_http", "allact_n-pc0")], sum((F.sum(f"`http_n_{t}`") for t in X.HTTP_NAMES), F.lit(0)).alias("types")).first()
    assert sums["n_allact"] == n == sums["n_workhourallact"] + sums["n_afterhourallact"]
    assert sums["types"] == sums["n_http"] == a.filter("act = 5").count()
    week = X.week_features(a, "2023-12-31").agg(F.sum("n_allact")).first()[0]
    assert week == day.filter("week >= 1").agg(F.sum("n_allact")).first()[0]
    day.unpersist()


def test_average_precision_and_ties(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 6) / 2.0, int(rng.random() < 0.4)) for _ in range(80)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, last, ap, best = sum(y for _, y in rows), 0.0, 0.0, (0, 0)
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, n = sum(y for s, y in rows if s >= t), sum(s >= t for s, _ in rows)
        p, r = tp / n, tp / pos
        ap, last = ap + (r - last) * p, r
        best = max(best, (round(2 * p * r / (p + r), 12) if tp else 0, -t))
    curve = E.pr_curve(df, [])
    assert abs(E.average_precision(curve, []).first()[0] - ap) < 1e-12
    got = E.best_f1(curve, []).first()
    assert (round(got["f1"], 12), got["threshold"]) == (best[0], -best[1])
    none = E.metrics_at_threshold(df, 99.0).first()
    assert none["precision"] == none["recall"] == none["f1"] == 0


def test_parameters(spark):
    df = spark.createDataFrame([(0, 0, 0, i, float(v), 1) for i, v in enumerate([1, -5, 5, 0.1, 2])], "round int, client_id int, layer int, idx int, value float, weight int")
    assert [r["value"] for r in P.topk_sparsify(df, ["layer"], 0.4).orderBy("idx").collect()] == [0, -5, 5, 0, 0]
    assert [r["value"] for r in P.chain(df, []).orderBy("idx").collect()] == [r["value"] for r in df.orderBy("idx").collect()]
    assert abs(P.quantize(df).filter("idx = 3").first()["value"] - 0.1) < 1e-4
    assert P.transport_mb(df, ["round"], 4, False).first()["mb"] == 20 / 1048576


def test_clients_and_sequences(spark):
    df = spark.createDataFrame([(u, d, float(d)) for u in range(13) for d in range(3 if u else 20)], "user int, day int, x double")
    sizes = [r["count"] for r in Q.client_partition(df, "user", 5).groupBy("client_id").count().orderBy("client_id").collect()]
    assert sizes == [3, 3, 3, 2, 2]
    assert [r["start"] for r in Q.sequences(df, ["x"], "user", "day", 14, 5).orderBy("start").collect()] == [0, 5]
    assert Q.select_features(df, [], ["user", "day"]).columns == ["user", "day", "x"]


def test_session_ids_of_a_large_week(spark):
    """More sessions in a week than its range of ids: none clashes, also not with the next week's."""
    one = spark.range(100_050).select(F.col("id").alias("actid"), F.col("id").alias("user"), F.lit(1).alias("week"))
    two = spark.range(30).select((F.col("id") + 1_000_000).alias("actid"), F.col("id").alias("user"), F.lit(2).alias("week"))
    acts = one.union(two).select("actid", "user", "week", F.lit("p").alias("pcid"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("act"))
    acts = acts.withColumn("actid", 2 * F.col("actid") + F.col("act"))
    rows = SE.sessionize(acts)
    got = rows.groupBy("session_id").agg(F.count_distinct("user", "week").alias("n"), F.min("week").alias("week"))
    assert got.filter("n > 1").count() == 0 and got.count() == 100_080
    ids = [r["session_id"] for r in got.filter("week = 1").collect()]
    assert sorted(ids)[:100_000] == list(range(100_000, 200_000)) and sorted(ids)[100_000:] == [10**12 + 100_000 + i for i in range(50)]
    assert sorted(r["session_id"] for r in got.filter("week = 2").collect()) == list(range(200_000, 200_030))


def test_trimmed_stats_of_errors_that_differ_when_made_anew(spark):
    """Sums in another order differ in their last digit: one evaluation has to serve all passes over ties at the cut."""
    noisy = F.udf(lambda x: x + random.choice([0.0, 1e-12]), "double").asNondeterministic()
    values = [float(min(i, 1950)) for i in range(2000)]  # the cut falls into the ties
    errs = spark.createDataFrame([("a", v) for v in values], "feature string, x double").select("feature", noisy("x").alias("err"))
    from activity_engine.operators.scoring import trimmed_stats

    r = trimmed_stats(errs).first()
    stay = values[:1980]
    mean = sum(stay) / len(stay)
    assert abs(r["mean"] - mean) < 1e-9 and abs(r["std"] - (sum((v - mean) ** 2 for v in stay) / len(stay)) ** 0.5) < 1e-9


def test_positions_and_running_sums(spark):
    rng = random.Random(4)
    values = [(rng.choice("ab"), i, rng.randint(0, 9)) for i in rng.sample(range(5000), 700)]
    df = spark.createDataFrame(values, "g string, k int, v int")
    order = sorted(values, key=lambda r: r[1])
    assert {r["k"]: r["p"] for r in R.positions(df, ["k"], "p").collect()} == {k: i for i, (_, k, _) in enumerate(order)}
    for by in ([], ["g"]):
        want, run = {}, {}
        for g, k, v in reversed(order):
            run[g if by else ""] = run.get(g if by else "", 0) + v
            want[k] = run[g if by else ""]
        assert {r["k"]: r["s"] for r in R.running_sums(df, by, "k", {"s": "v"}).collect()} == want
    for n, chunks in ((10, 3), (7, 7), (3, 5), (100, 1), (11, 4)):
        sizes = [n // chunks + (i < n % chunks) for i in range(chunks)]
        want = [i for i, size in enumerate(sizes) for _ in range(size)]
        got = spark.range(n).select(R.chunk_of(F.col("id"), F.lit(n), chunks).alias("c")).collect()
        assert [r["c"] for r in got] == want


def test_trimmed_stats(spark):
    import numpy as np

    rng = random.Random(9)
    data = {"smooth": [rng.random() for _ in range(3000)], "ties": [float(rng.choice([0, 0, 0, 1, 5])) for _ in range(2000)], "same": [2.0] * 500, "few": [1.0, 2.0, 30.0]}
    df = spark.createDataFrame([(f, x) for f, xs in data.items() for x in xs], "feature string, err double")
    for top in (0.01, 0.3):
        got = {r["feature"]: (r["mean"], r["std"]) for r in C.trimmed_stats(df, top).collect()}
        for f, xs in data.items():
            kept = sorted(xs)[: int(len(xs) * (1 - top))]
            assert np.allclose(got[f], (np.mean(kept), np.std(kept)), atol=1e-9), f


def test_default_calibration(spark):
    """A client without statistics is scored by the default mean and deviation."""
    errs = spark.createDataFrame([("u", 1, 0, "f", 0.12), ("v", 1, 1, "f", 0.12)], "user string, start int, client_id int, feature string, err double")
    calib = spark.createDataFrame([(0, "f", 0.1, 0.01)], "client_id int, feature string, mean double, std double")
    got = {r["user"]: r["score"] for r in C.window_scores(errs, calib, ["user", "start"], ["client_id"], diversity=False).collect()}
    assert abs(got["u"] - 0.02 / (0.01 + 1e-6)) < 1e-9 and abs(got["v"] - 0.1 / (0.05 + 1e-6)) < 1e-9


def test_parameters_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=200).astype(np.float32)
    df = spark.createDataFrame([(0, 0, i % 2, i, float(v)) for i, v in enumerate(x)], "round int, client_id int, layer int, idx int, value float")
    half = {r["idx"]: r["value"] for r in P.quantize(df).collect()}
    assert half == {i: float(np.float32(np.float16(v))) for i, v in enumerate(x)}
    steps = [lambda p: P.topk_sparsify(p, ["round", "client_id", "layer"], 0.05), P.quantize]
    got = {r["idx"]: r["value"] for r in P.chain(df, steps).collect()}
    want = {}
    for layer in (0, 1):
        idx = np.arange(layer, 200, 2)
        top = set(idx[np.argsort(-np.abs(x[idx]), kind="stable")[:5]])
        want |= {int(i): half[i] if i in top else 0.0 for i in idx}
    assert got == want
    add, double = (lambda p: p.withColumn("value", F.col("value") + 1)), (lambda p: p.withColumn("value", F.col("value") * 2))
    one = spark.createDataFrame([(3.0,)], "value double")
    assert P.chain(one, [add, double]).first()[0] == 8 and P.chain_at_server(one, [add, double]).first()[0] == 7


def test_pca_against_numpy(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(60, 4)) @ np.diag([5.0, 2.0, 1.0, 0.1])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    centre = x.mean(axis=0)
    axes = np.linalg.svd(x - centre, full_matrices=False)[2][:2]
    want = centre + (x - centre) @ axes.T @ axes
    seqs = df.select("id", F.lit(1).alias("client"), F.array(F.array(*"abcd")).alias("seq"))
    got = {(r["id"], r["feature"]): (r["x"], r["xhat"]) for r in C.principal_reconstruction(seqs, list("abcd"), ["id", "client"], ["client"], 2, 25).collect()}
    for (i, f), (v, back) in got.items():
        assert v == x[i, "abcd".index(f)] and np.isclose(back, want[i, "abcd".index(f)], atol=1e-8)


def test_components_of_windows(spark):
    """Windows of several rows and clients; one client has a single window, one has equal windows, one only one direction."""
    rng = np.random.default_rng(8)
    windows = {1: rng.normal(size=(200, 2, 3)) * [[9, 1, 1], [1, 5, 1]], 2: rng.normal(size=(1, 2, 3)), 3: np.ones((4, 2, 3)), 4: np.arange(5.0)[:, None, None] * np.ones((5, 2, 3))}
    seqs = spark.createDataFrame([(c, i, w.tolist()) for c, ws in windows.items() for i, w in enumerate(ws)], "client int, start int, seq array<array<double>>")
    got = {(r["client"], r["start"], r["t"], r["feature"]): r["xhat"] for r in C.principal_reconstruction(seqs, list("abc"), ["client", "start"], ["client"], 2, 40).collect()}
    assert len(got) == 210 * 6
    for c, ws in windows.items():
        flat = ws.reshape(len(ws), 6)
        axes = np.linalg.svd(flat - flat.mean(axis=0), full_matrices=False)[2][:2]
        want = (flat.mean(axis=0) + (flat - flat.mean(axis=0)) @ axes.T @ axes).reshape(ws.shape)
        have = np.array([[[got[c, i, t, f] for f in "abc"] for t in range(2)] for i in range(len(ws))])
        assert np.allclose(have, want, atol=1e-5)


def test_scores_of_users_and_last_rounds(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user string")
    scores = spark.createDataFrame([("a", 2, 5), ("a", 1, 9), ("c", 3, 3)], "user string, O int, C int")
    assert sorted(map(tuple, U.with_scores(users, scores, "user").collect())) == [("a", 1, 9), ("b", None, None)]
    rounds = spark.createDataFrame([(i % 8, i) for i in range(20)], "round int, x int")
    assert {r["round"] for r in E.last_rounds(rounds).collect()} == {3, 4, 5, 6, 7}


def test_stream_goes_on(spark, tmp_path):
    """Two batches by one path: counts grow, state is kept, and a row after the watermark is left out."""
    from activity_engine.streaming.counts import period_counts, run_to_parquet, stream_events

    def put(name, *rows):
        df = spark.createDataFrame([(u, dt.datetime.fromisoformat(t)) for u, t in rows], "user_id long, ts timestamp")
        df.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "in" / name)

    (tmp_path / "in").mkdir()
    run = lambda: {(r["user_id"], str(r["start"])[:10]): r["n"] for r in run_to_parquet(period_counts(stream_events(spark, str(tmp_path / "in"), "*.parquet"), "user_id", "ts"), f"file://{tmp_path}/out").collect()}
    put("a.parquet", (1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-01-03"))
    assert run() == {(1, "2023-12-31"): 2, (2, "2023-12-31"): 1}
    put("b.parquet", (1, "2024-01-06"), (1, "2024-02-20"))
    assert run() == {(1, "2023-12-31"): 3, (2, "2023-12-31"): 1, (1, "2024-02-18"): 1}
    put("c.parquet", (1, "2024-01-04"), (2, "2024-02-20"))
    assert run() == {(1, "2023-12-31"): 3, (2, "2023-12-31"): 1, (1, "2024-02-18"): 1, (2, "2024-02-18"): 1}


# --- selection, rounding, samples ------------------------------------------------------------------------------


def test_kth_largest(spark):
    from activity_engine.operators.selection import comparable, kth_largest

    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [5.0] * 50, "c": [rng.choice([1.0, 2.0, 1e-300, -1e300, float("inf"), float("nan"), None]) for _ in range(400)], "d": [7.0], "e": [2.0**-k for k in range(60)]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").withColumn("key", comparable(F.col("v")))
    for k in (1, 37, 10_000):
        got = {r["g"]: r for r in kth_largest(rows, ["g"], "key", F.lit(k)).collect()}
        for g, vs in groups.items():
            keys = sorted((-1e307 if v is None else 1e307 if v != v else max(-1e307, min(1e307, v)) for v in vs), reverse=True)
            at = min(k, len(keys)) - 1
            assert got[g]["cut"] == keys[at]
            assert got[g]["wanted"] == at + 1 - sum(x > keys[at] for x in keys) and got[g]["equal"] == keys.count(keys[at])


def test_topk_of_one_large_layer(spark):
    """Nearly all rows in one layer, many of them tied at the cut: no window sees the layer, ties go by idx."""
    rng = random.Random(5)
    values = [(1, i, rng.choice([-3.0, 3.0, 2.0, 1.0])) for i in range(20_000)] + [(2, 0, 1.0), (2, 1, None), (3, 0, float("nan"))]
    df = spark.createDataFrame(values, "layer int, idx long, value float")
    out = P.topk_sparsify(df, ["layer"], 0.3)
    got = {(r["layer"], r["idx"]): r["value"] for r in out.collect()}
    want = sorted((v for v in values if v[0] == 1), key=lambda v: (-abs(v[2]), v[1]))
    assert {(1, v[1]): v[2] for v in want[:6000]} | {(1, v[1]): 0.0 for v in want[6000:]} == {k: v for k, v in got.items() if k[0] == 1}
    assert got[2, 0] == 1.0 and got[2, 1] == 0.0 and got[3, 0] != got[3, 0]
    assert "row_number" not in out._jdf.queryExecution().toString()


def test_half_precision_is_numpys(spark):
    edge = [0.0, -0.0, 1.0, 65504.0, 65519.9, 65520.0, -65520.0, 1e30, 2.0**-14, 2.0**-24, 2.0**-25, 2.0**-25 * 1.0001, 3 * 2.0**-25, -(2.0**-26), float("inf"), float("-inf"), 2049.0, 2051.0, 1 + 2.0**-11, 1 + 3 * 2.0**-11]
    rng = np.random.default_rng(1)
    x = np.concatenate([np.array(edge), rng.normal(size=20_000) * 10.0 ** rng.integers(-9, 6, 20_000)]).astype("float32")
    with np.errstate(over="ignore"):
        want = x.astype("float16").astype("float32")
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, float("nan")), (-2, None)], "i long, value float")
    got = {r["i"]: r["value"] for r in P.quantize(df).collect()}
    have = np.array([got[i] for i in range(len(x))], "float32")
    assert (have == want).all() and (np.signbit(have) == np.signbit(want)).all()
    assert got[-1] != got[-1] and got[-2] is None
    assert "Arrow" not in P.quantize(df)._jdf.queryExecution().toString()


@pytest.mark.parametrize("n", [0, 1, 3, 10, 1009])
def test_client_samples(spark, n):
    rounds = spark.createDataFrame([(r,) for r in range(40)], "round long")
    df = P.sample_clients(rounds, spark.range(n).withColumnRenamed("id", "client_id"), 0.4)
    got = [tuple(r) for r in df.select("round", "client_id").collect()]
    assert len(got) == len(set(got)) == 40 * min(n, max(2, int(n * 0.4)))
    plan = df._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    if n == 10:
        assert len({frozenset(c for r, c in got if r == k) for k in range(40)}) > 10 and {c for _, c in got} == set(range(10))


# --- full statistics, long histories ---------------------------------------------------------------------------


def test_order_statistics(spark):
    from activity_engine.operators.statistics import order_statistics

    rng = random.Random(2)
    cells = {(1, 0): [float(rng.randrange(-50, 1000)) for _ in range(999)], (1, 1): [0.0], (2, 0): [1e9 + rng.random() for _ in range(300)], (2, 1): [-1.5, 2.0, 2.0, 1e-5], (3, 7): [4.0] * 1000}
    rows = spark.createDataFrame([(g, c, v, 1 + i % 3) for (g, c), vs in cells.items() for i, v in enumerate(vs)], "g int, c int, v double, n long")
    got = {(r["g"], r["c"]): r for r in order_statistics(rows, ["g"], ["c"]).collect()}
    for key, vs in cells.items():
        x = np.repeat(vs, [1 + i % 3 for i in range(len(vs))])
        want = [x.min(), x.max(), np.median(x), x.mean(), x.std()]
        assert [got[key][s] for s in ("min", "max", "med", "mean", "std")] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_statistics_table(spark):
    """Five columns in the place of each mean, in the reference's order; empty slices are 0, null values don't count."""
    from activity_engine.operators.statistics import with_statistics

    feature_table, features = X.feature_table, X.features

    rows = [(1, 0, 7, 1, 2, 10 * k, k, 3) for k in range(1, 5)] + [(1, 0, 7, 2, 1, None, 9, 3), (1, 0, 1, 1, None, None, None, None)]
    a = spark.createDataFrame(rows, "user int, day int, act int, time int, file_type int, file_len int, file_depth int, file_nwords int")
    a = a.withColumns({"disk": F.lit(0), "pc": F.lit(0)})
    t = with_statistics(feature_table(a, ["user", "day"], "day", only=["file"]), a, ["user", "day"], "day", only=["file"])
    assert t.columns[2:8] == ["n_file", "file_min_file_len", "file_max_file_len", "file_med_file_len", "file_mean_file_len", "file_std_file_len"]
    assert len(t.columns) == 2 + len(features("day", only=["file"])) + 4 * sum(f.kind == "mean" for f in features("day", only=["file"]))
    r = t.first()
    assert [r[f"file_{s}_file_len"] for s in ("min", "max", "med", "mean")] == [10, 40, 25, 25] and r["file_std_file_len"] == pytest.approx(125**0.5)
    assert r["file_max_file_depth"] == 9 and r["workhourfile_max_file_depth"] == 4 and r["afterhourfile_min_file_len"] == 0
    assert r["file_compf_med_file_depth"] == 2.5 and r["file_otherf_med_file_depth"] == 9 and r["file_exef_std_file_depth"] == 0


@pytest.mark.parametrize("window, many", [(3, 1 << 15), (300, 1 << 15), (300, 8)])
def test_long_histories(spark, window, many, monkeypatch):
    """Users longer than a range, gaps, nulls and ties, against direct computation; with windows in trees, too."""
    monkeypatch.setattr(T, "MANY", many)
    rng = random.Random(window)
    rows = []
    for user, days in ((1, range(900)), (2, [d for d in range(-40, 1200) if rng.random() < 0.4]), (3, [5, 6]), (None, [1, 9])):
        rows += [(user, d, rng.choice([None, 0.0, 1.0, 2.0]), float(rng.randrange(10**6)), "i") for d in days]
    df = spark.createDataFrame(rows, "user int, day int, a double, b double, info string")
    history = {}
    for u, d, a, b, _ in rows:
        before = [(x, y) for v, t, x, y, _ in rows if v == u and d - window <= t < d]
        if d >= min(t for v, t, *_ in rows if v == u) + window and before:
            history[u, d] = ((a, b), before)

    def check(out, of):
        got = {(r["user"], r["day"]): (r["a"], r["b"], r["info"]) for r in out.collect()}
        assert set(got) == set(history)
        for key, (own, before) in history.items():
            for i in (0, 1):
                want = of(own[i], [h[i] for h in before])
                assert got[key][i] == (None if want is None else pytest.approx(want, abs=1e-9)), (key, i)

    less = lambda middle: lambda v, h: None if v is None or not (h := [x for x in h if x is not None]) else v - middle(h)
    rank = lambda v, h: (2 * sum(x is not None and v is not None and x < v for x in h) + sum(x is not None and x == v for x in h)) * 50 / len(h) - 50
    check(T.mean_diff(df, ["a", "b"], "user", "day", window), less(lambda h: sum(h) / len(h)))
    check(T.median_diff(df, ["a", "b"], "user", "day", window), less(np.median))
    check(T.percentile_rank(df, ["a", "b"], "user", "day", window), rank)


def test_feature_table_of_groups_over_several_batches(spark):
    """Groups are read batch by batch, also those that a batch cuts; null groups and null values count as before."""
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([1, 7]), rng.randint(1, 4), rng.choice([0, 1, 2, 3]), rng.choice([5, 9, None]), 2, rng.randint(0, 2), rng.randint(1, 6), 1) for _ in range(500)]
    a = spark.createDataFrame(rows, "g int, act int, time int, pc int, file_len int, file_depth int, disk int, file_type int, file_nwords int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        t = {r["g"]: r for r in X.feature_table(a, ["g"], "day", only=["allact", "file"], extra={"top": F.max("time"), "all": F.sum(F.lit(1))}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(t) == {1, 2, 3, None}
    for g, r in t.items():
        own = [x for x in rows if x[0] == g]
        late = [x for x in own if x[1] == 7 and x[2] in (2, 4) and x[7] == 3]
        assert (r["all"], r["top"], r["n_allact"]) == (len(own), max(x[2] for x in own), len(own))
        assert r["allact_n-pc2"] == sum(x[3] == 2 for x in own)
        assert r["afterhourfile_n_phof"] == len(late)
        assert abs(r["afterhourfile_phof_mean_file_len"] - (sum(x[4] or 0 for x in late) / len(late) if late else 0)) < 1e-12


def test_features_are_compared_in_the_task_that_made_them(spark, monkeypatch):
    """Pieces of 7 rows, so that windows cross them: as the wide table compared, without a shuffle of wide rows."""
    from activity_engine.operators import features as X
    from activity_engine.operators import temporal as T

    names = ["usb_dur", "file_len", "file_depth", "file_nwords", "disk", "file_type", "n_des", "n_atts", "n_exdes", "n_bccdes", "email_size", "email_text_slen", "email_text_nwords",
             "Xemail", "exbccmail", "url_len", "url_depth", "http_c_len", "http_c_nwords", "http_type", "pc"]
    a = spark.range(600).select(
        (F.xxhash64("id") % 4).alias("user"), F.when(F.col("id") % 97 > 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60)).cast("int")).alias("t"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(7)).cast("int").alias("act"), (F.col("id") % 4 + 1).cast("int").alias("time"), *[(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(9)) - 1).cast("int").alias(n) for n in names],
    ).localCheckpoint()
    wide = X.feature_table(a, ["user", "t"], "day", digits=3)
    columns = [f.name for f in X.features("day")]
    monkeypatch.setattr(T, "ROWS", 7)
    for find, whole in (("median", T.median_diff), ("percentile", T.percentile_rank)):
        got = T.trailing_features(a, "user", "t", 5, find, digits=3)
        want = {(r["user"], r["t"]): r for r in whole(wide, columns, "user", "t", 5).collect()}
        rows = got.collect()
        assert len(rows) == len(want) > 100
        for r in rows:
            w = want[r["user"], r["t"]]
            assert all(abs(r[c] - w[c]) < 0.00051 for c in columns)
        assert any(r[c] for r in rows for c in columns)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]


def test_small_windows_with_negative_numbers_and_gaps():
    """Medians and percentiles by counts and by sorting each window agree."""
    from activity_engine.operators import temporal as T

    rng = np.random.default_rng(5)
    x = rng.choice([0.0, 0.0, 0.0, -1.0, 2.5, 7.0, np.nan], (300, 11))
    at = np.arange(10, 300)
    low, high = np.maximum(np.arange(300) - 9, 0), np.arange(300)
    for find in ("median", "percentile"):
        got = T._gathered(x, at, low, high, find)
        for i, r in enumerate(at):
            h = x[low[r] : high[r]]
            if find == "median":
                want = [v - np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else np.nan for v, c in zip(x[r], h.T, strict=True)]
            else:
                want = [-50.0 if np.isnan(v) else ((c < v).sum() + (c <= v).sum()) * 50.0 / len(c) - 50 for v, c in zip(x[r], h.T, strict=True)]
            np.testing.assert_allclose(got[i], want, atol=1e-12)


def test_labels_and_computers_move_no_sorted_rows(spark):
    """Weeks are few and are sent to the rows; users and answers are hashed. Wide rows of actions aren't sorted for a join."""
    acts = spark.range(50).select(F.concat(F.lit("u"), F.col("id") % 5).alias("user"), F.col("id").cast("string").alias("actid"), (F.col("id") % 3).alias("week"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit("p").alias("pcid"))
    users = spark.createDataFrame([("u0", "p", None, None)], "user string, pc string, sharedpc array<string>, sup string")
    insiders = spark.range(1).select(F.lit("u1").alias("user"), F.lit(2).alias("scenario"), F.timestamp_seconds(F.lit(0)).alias("mstart"), F.timestamp_seconds(F.lit(9)).alias("mend"))
    out = A.label_actions(A.pc_codes(acts, users), insiders, acts.filter("CAST(actid AS INT) % 2 = 0").select("user", "actid"))
    rows = {r["actid"]: r for r in out.collect()}
    assert len(rows) == 50 and {a for a, r in rows.items() if r["mal_act"]} == {str(i) for i in range(50) if i % 5 == 1 and i % 2 == 0}
    assert all(r["insider"] == 2 * r["mal_act"] and r["pc_code"] == (0 if r["user"] == "u0" else 2) for r in rows.values())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 2 and "BroadcastHashJoin" in plan
