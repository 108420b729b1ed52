"""Ordered operators and metrics against brute force on small fixtures."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from propensity.operators import metrics as mt
from propensity.operators.windows import dedup_first, global_rank, latest_per_key, sessionize
from propensity.streaming.throttle import throttle


def brute_sessions(rows, gap):
    out = {}
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        by.setdefault(r[1], []).append(r)
    for lead, evs in by.items():
        n = 0
        prev = None
        for r in evs:
            if r[2] == "page_view":
                cont = prev is not None and prev[2] == "page_view" and (r[3] - prev[3]).total_seconds() <= gap
                if not cont:
                    n += 1
                out[r[0]] = n
            else:
                out[r[0]] = None
            prev = r
    return out


def test_sessionize_matches_brute_force(spark):
    rnd = random.Random(7)
    base = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        rows.append((i, rnd.randint(0, 4), rnd.choice(["page_view", "page_view", "email_open"]),
                     base + timedelta(minutes=rnd.randint(0, 60 * 24 * 4))))
    df = spark.createDataFrame(rows, "event_id long, lead_id long, event_type string, occurred_at timestamp_ntz")
    got = {r["event_id"]: r["session_no"] for r in sessionize(df, gap_seconds=1800).collect()}
    assert got == brute_sessions(rows, 1800)
    # hot keys get narrower buckets (here ~1/3 day); the answer must not change
    for rpt in (30, 2):  # ~8 h buckets, then ~30 min buckets (narrower than the gap)
        got = {r["event_id"]: r["session_no"] for r in
               sessionize(df, gap_seconds=3600, rows_per_task=rpt).collect()}
        assert got == brute_sessions(rows, 3600)


def test_dedup_first_and_latest(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("a", 2, "w")], "k string, o long, v string")
    assert {r["k"]: r["v"] for r in dedup_first(df, "k", ["o"]).collect()} == {"a": "y", "b": "z"}
    assert {r["k"]: r["v"] for r in latest_per_key(df, "k", "o").collect()} == {"a": "x", "b": "z"}


def test_global_rank(spark):
    vals = list(range(500))
    random.Random(1).shuffle(vals)
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    got = {r["v"]: r["_rank"] for r in global_rank(df, ["v"], partitions=7).collect()}
    assert got == {v: v + 1 for v in range(500)}


def brute_auc(y, p):
    pos = [pi for yi, pi in zip(y, p) if yi == 1]
    neg = [pi for yi, pi in zip(y, p) if yi == 0]
    s = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def brute_ece(y, p, n_bins=10):
    y, p = np.array(y, float), np.array(p, float)
    edges = np.percentile(p, np.linspace(0, 100, n_bins + 1))
    edges[0], edges[-1] = 0.0, 1.0 + 1e-8
    ece = 0.0
    for i in range(n_bins):
        m = (p >= edges[i]) & (p < edges[i + 1])
        if m.sum():
            ece += m.sum() / len(y) * abs(y[m].mean() - p[m].mean())
    return ece


def test_metrics_match_brute_force(spark):
    rnd = random.Random(3)
    y = [rnd.randint(0, 1) for _ in range(300)]
    p = [round(rnd.random(), 2) for _ in range(300)]  # many ties
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    assert mt.auc_roc(df).first()[0] == pytest.approx(brute_auc(y, p))
    assert mt.calibration_error(df).first()[0] == pytest.approx(brute_ece(y, p))
    eps = np.finfo(float).eps
    pc = np.clip(np.array(p), eps, 1 - eps)
    ll = -np.mean(np.array(y) * np.log(pc) + (1 - np.array(y)) * np.log(1 - pc))
    assert mt.log_loss(df).first()[0] == pytest.approx(ll)
    cm = mt.confusion_metrics(df).first()
    tp = sum(1 for a, b in zip(y, p) if a == 1 and b > 0.5)
    fp = sum(1 for a, b in zip(y, p) if a == 0 and b > 0.5)
    assert cm["precision"] == pytest.approx(tp / (tp + fp))


def brute_throttle(rows, max_requests, window):
    out = {}
    kept = {}
    for key, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        k = [x for x in kept.get(key, []) if x > t - window]
        if len(k) >= max_requests:
            out[i] = True
        else:
            out[i] = False
            k.append(t)
        kept[key] = k
    return out


def test_throttle_matches_brute_force(spark):
    rnd = random.Random(5)
    base = datetime(2024, 1, 1)
    rows = [(rnd.choice(["a", "b", "c"]), rnd.randint(0, 600), i) for i in range(2000)]
    df = spark.createDataFrame([(k, base + timedelta(seconds=t), i) for k, t, i in rows],
                               "k string, t timestamp_ntz, i long")
    got = {r["i"]: r["limited"] for r in throttle(df, "k", "t", max_requests=20, window_seconds=60, tie="i").collect()}
    assert got == brute_throttle(rows, 20, 60)


def test_throttle_cuts_keys_at_calm_stretches(spark):
    from propensity.streaming.throttle import saturated_cells
    rnd = random.Random(8)
    base = datetime(1969, 12, 31, 23, 50)
    # bursts between calm stretches of all lengths, on both sides of the epoch, one very busy key
    rows = []
    for k in ("hot", "a", "b"):
        t = 0.0
        while t < 3000:
            gap = rnd.choice([0.5, 0.5, 3, 12, 40, 130]) if k != "hot" else rnd.choice([0.5, 1, 1, 60])
            for _ in range(rnd.randint(1, 12)):
                t += rnd.random() * gap
                rows.append((k, int(t), len(rows)))
    df = spark.createDataFrame([(k, base + timedelta(seconds=t), i) for k, t, i in rows],
                               "k string, t timestamp_ntz, i long")
    for most, window in ((1, 7), (3, 10), (20, 60)):
        out = throttle(df, "k", "t", max_requests=most, window_seconds=window, tie="i").collect()
        assert len(out) == len(rows)
        assert {r["i"]: r["limited"] for r in out} == brute_throttle(rows, most, window)
    timed = df.selectExpr("k", "cast(unix_seconds(cast(t as timestamp)) div 10 as long) as _cell")
    cells = saturated_cells(timed, "k", 20)
    assert cells.where("_key = 'hot'").select("_segment").distinct().count() > 3
    odd = spark.createDataFrame([("a", None), ("a", base), (None, None)], "k string, t timestamp_ntz")
    assert [r["limited"] for r in throttle(odd, "k", "t", 1, 60).collect()] == [False] * 3


def test_auc_is_exact_and_repeatable_on_many_scores(spark):
    import numpy as np
    from propensity.operators import metrics as mt
    rng = np.random.default_rng(8)
    p, y = rng.random(150_000), rng.integers(0, 2, 150_000)
    order = np.argsort(p)
    below = np.cumsum(1 - y[order]) - (1 - y[order])
    want = (below * y[order]).sum() / (y.sum() * (1 - y).sum())
    df = spark.range(0, 150_000, 1, 16).join(spark.createDataFrame(
        list(zip(range(150_000), p.tolist(), y.tolist())), "id long, p double, y int"), "id")
    got = [mt.auc_roc(df).first()[0] for _ in range(2)]
    assert got[0] == got[1] and abs(got[0] - want) < 1e-12


def test_throttle_counts_null_keys_together(spark):
    from propensity.streaming.throttle import throttle
    df = spark.createDataFrame([(None, f"2024-01-01 00:00:0{i}") for i in range(5)] + [(1, "2024-01-01 00:00:00")],
                               "k long, t string").selectExpr("k", "cast(t as timestamp_ntz) as t")
    got = throttle(df, "k", "t", max_requests=2, window_seconds=60).collect()
    assert sum(r["limited"] for r in got) == 3


def test_registering_a_name_twice_fails():
    import pytest
    from propensity.plans.queries import register
    with pytest.raises(ValueError):
        register("feature_matrix")(lambda spark, sf_dir: None)
