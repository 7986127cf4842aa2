"""Summaries merged over any cut of a series equal the rules over the whole."""
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldpulse.operators import recovery as R
from fieldpulse.operators.run_summary import SUMMARY, Rule, drained, recovered
from fieldpulse.streaming.run_watch import RunWatch

SCHEMA = "run string, sample_ts int, value long"


def series(seed):
    rnd = random.Random(seed)
    out = []
    for run in range(24):
        n = rnd.choice([1, 2, 3, 7, 15, 40])
        high = rnd.choice([1, 2, 4, 9])
        out += [(f"r{run}", i, None if rnd.random() < 0.03 else rnd.randint(0, high)) for i in range(n)]
    return out


def plain(rows, rule):
    """First index at which the rule has held ``needed`` samples in a row."""
    runs = {}
    for run, i, v in rows:
        runs.setdefault(run, []).append(v)
    out = {}
    for run, vs in runs.items():
        held, out[run] = 0, None
        for i, v in enumerate(vs):
            good = (i > 0 and v is not None and v == vs[i - 1]) if rule.limit is None else (v is not None and v <= rule.limit)
            held = held + 1 if good else 0
            if held >= rule.needed and out[run] is None:
                out[run] = i
    return out


RULES = [Rule(3), Rule(1), Rule(4, limit=2), Rule(1, limit=0)]


@pytest.mark.parametrize("rule", RULES)
def test_any_cut_gives_the_rule_over_the_whole(spark, rule):
    """Every run is cut at random places, several times; all cuts are merged in one job."""
    rows, rnd = series(7), random.Random(1)
    pieces = []
    for cut in range(12):
        part = {}
        for run, i, v in rows:
            k = part.get(run, 0)
            part[run] = k + (rnd.random() < rnd.choice([0.05, 0.3, 0.9]))
            pieces.append((f"{cut}/{run}", k, i, v))
    df = spark.createDataFrame(pieces, "run string, piece int, sample_ts int, value long")
    each = rule.summaries(df, ["run", "piece"])
    merged = each.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("piece", "summary"))).alias("s")).select(
        "run", F.aggregate("s", F.lit(None).cast(SUMMARY), lambda a, x: rule.merge(a, x["summary"])).alias("summary"))
    # and from the right: merging is associative
    right = each.groupBy("run").agg(F.array_sort(F.collect_list(F.struct((-F.col("piece")).alias("p"), "summary"))).alias("s")).select(
        "run", F.aggregate("s", F.lit(None).cast(SUMMARY), lambda a, x: rule.merge(x["summary"], a)).alias("summary"))
    want = plain(rows, rule)
    got = {r.run: r.summary for r in merged.collect()}
    assert len(got) == 12 * len(want)
    assert all(s.hit == want[run.split("/")[1]] for run, s in got.items())
    assert {r.run: r.summary for r in right.collect()} == got


def test_results_equal_the_batch_operators(spark):
    df = spark.createDataFrame(series(3), SCHEMA)
    drain, streak = Rule(3), Rule(4, limit=2)
    for whole, live in ((R.drain_stable(df, timeout=6), drained(drain.summaries(df), timeout=6)),
                        (R.recovery_streak(df, limit=2, needed=4, horizon=9), recovered(streak.summaries(df), horizon=9))):
        assert whole.columns == live.columns
        assert sorted(map(str, whole.collect())) == sorted(map(str, live.collect()))


def test_watch_over_a_stream(spark, scratch):
    rows = series(5)
    src = os.path.join(scratch, "samples")
    bounds = [0, 3, 4, 9, 40]                                       # the micro-batches, one file each, in order
    rule = Rule(3)
    watch = RunWatch(spark, os.path.join(scratch, "watch"), rule)
    seen = []
    for lo, hi in zip(bounds, bounds[1:]):
        part = [r for r in rows if lo <= r[1] < hi]
        random.Random(lo).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(src)
        q = (spark.readStream.schema(SCHEMA).json(src).writeStream.foreachBatch(watch.write)
             .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
        known = plain([r for r in rows if r[1] < hi], rule)
        hits = {r.run: r["index"] for r in watch.hits().collect()}  # raised as soon as the rule is met
        assert hits == {k: v for k, v in known.items() if v is not None}
        seen.append(len(hits))
    assert seen[0] < seen[-1]
    whole = R.drain_stable(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(str, drained(watch.state()).collect())) == sorted(map(str, whole.collect()))
    state = (watch.last_batch(), sorted(map(str, watch.state().collect())), watch.hits().count())
    last = spark.createDataFrame([r for r in rows if r[1] >= 9], SCHEMA)
    watch.write(last, watch.last_batch())                           # the last micro-batch is run again
    assert state == (watch.last_batch(), sorted(map(str, watch.state().collect())), watch.hits().count())
