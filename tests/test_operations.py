"""Daily figures that merge into weeks, and freshness with files that are still open."""

import datetime as dt
import random

from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.operators import operations

START = dt.datetime(2024, 1, 1)


def moments(rng, count, days=20):
    return [START + dt.timedelta(seconds=rng.randrange(days * 86400)) for _ in range(count)]


def test_weeks_from_stored_days_equal_the_direct_figures(spark):
    rng = random.Random(1)
    rules = [[], ["BLOCKED by binding_opinion"], ["APPENDED by x"]]
    answers = [(t, rng.choice(rules), rng.random() < 0.8) for t in moments(rng, 300)]
    ratings = [(t, rng.choice([1, -1, None])) for t in moments(rng, 200)]
    searches = [(t, rng.choice([True, False, None])) for t in moments(rng, 100, 3)]
    waits = [(t, rng.choice([None, rng.random() * 9, 2.5])) for t in moments(rng, 400)]
    frame = lambda rows, kind: spark.createDataFrame(rows, "at timestamp, " + kind)
    counts = operations.daily_counts(frame(answers, "applied_rules array<string>, cited boolean"), frame(ratings, "rating int"), frame(searches, "hit boolean"))
    times = operations.daily_times(frame(waits, "elapsed double"))
    week = lambda t: (t - dt.timedelta(days=t.weekday())).date()
    for period, key in (("day", lambda t: t.date()), ("week", week)):
        rolled = operations.rolled_up(counts, period), operations.rolled_up(times, period, ["ms"])
        got = {(r.day, r.metric): r.value for r in operations.series(*rolled).collect()}
        assert {m for _, m in got} == set(fv.OPERATION_TARGETS)
        for day in {key(t) for t, *_ in answers}:
            told = [a for a in answers if key(a[0]) == day]
            assert got[day, "citation_coverage_pct"] == round(100 * sum(a[2] for a in told) / len(told), 4)
            assert got[day, "binding_block_pct"] == round(100 * sum(a[1] == rules[1] for a in told) / len(told), 4)
            rated = [r[1] for r in ratings if key(r[0]) == day]
            assert got.get((day, "satisfaction_pct")) == (round(100 * rated.count(1) / len(rated), 4) if rated else None)
            waited = sorted(w for t, w in waits if key(t) == day and w is not None)
            if waited:
                # The stated error is half a millisecond.
                assert abs(got[day, "response_p95_s"] - waited[int(len(waited) * 0.95)]) <= 0.0005 + 1e-9
        for day in {key(t) for t, _ in searches}:
            looked = [h for t, h in searches if key(t) == day]
            assert got[day, "vector_hit_pct"] == round(100 * looked.count(True) / len(looked), 4)


def test_freshness_pairs_two_times_and_counts_open_files(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    files = [("a", 1, at(0)), ("a", 1, at(50)), ("a", 2, at(100)), ("b", 3, at(10)), (None, 1, at(5)), ("a", None, at(20))]
    batches = [(1, at(200)), (1, at(260)), (2, at(130)), (9, at(1))]
    frame = spark.createDataFrame(files, "category string, batch_id long, arrived_at timestamp")
    commits = spark.createDataFrame(batches, "batch_id long, committed_at timestamp")
    got = {r.category: (r.n_indexed, r.n_open, r.oldest_open_s, r.p95_lag_s) for r in operations.freshness(frame, commits, F.lit(at(400))).collect()}
    assert got == {"a": (3, 1, 380, 260), "b": (0, 1, 390, None), None: (1, 0, None, 255)}
