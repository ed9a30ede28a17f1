"""Comparable accounts against all pairs, and rows that grow with the accounts, not with pairs."""

import random

import pytest
from pyspark.sql import functions as F

from haulmark.operators import accounts

SCHEMA = (
    "insured_id string, state_domicile string, naics_sector string, fleet_size int, primary_commodity string, years_band string, "
    "ratio_band string, loss_ratio double, premium double, non_renewed boolean"
)
WEIGHTS = (3, 2, 1, 3)


def book(seed, count, hot=3):
    rnd = random.Random(seed)
    pick = lambda *values: rnd.choice(values)
    rows = []
    for i in range(count):
        if i % hot == 0:
            rest = ("S1", "T1", 20, "C1", "2-5", "<50%")
        else:
            rest = (pick("S1", "S2", None), pick("T1", "T1", "T2"), pick(None, rnd.randint(1, 130)), pick("C1", "C2", None), pick("2-5", "5-10", None), pick("<50%", ">100%", None))
        rows.append((f"A{i:03d}", *rest, float(rnd.randrange(200)), 100.0 + i, rnd.random() < 0.4))
    return rows


def band(fleet):
    return sum(fleet > b for b in (10, 25, 50, 100))


def score(a, b):
    """Similarity of two rows, None outside the hard filter."""
    if None in (a[1], a[2], a[3], b[3]) or a[1:3] != b[1:3] or not a[3] * 70 <= b[3] * 100 <= a[3] * 130:
        return None
    agree = [band(a[3]) == band(b[3]), *[a[k] is not None and a[k] == b[k] for k in (4, 5, 6)]]
    return round((5 + sum(w for w, same in zip(WEIGHTS, agree) if same)) / 14, 4)


def near(probe, own, rows, threshold):
    found = [(score(probe, b), b) for b in rows if b[0] != own]
    return sorted(((-s, b) for s, b in found if s is not None and s >= threshold), key=lambda x: (x[0], x[1][0]))


@pytest.mark.parametrize("threshold", [0.75, 0.6, 0.36])
def test_equal_to_all_pairs(spark, threshold):
    rows = book(8, 220)
    cohorts = spark.createDataFrame(rows, SCHEMA)
    probes = accounts.account_probes(cohorts)
    got = {}
    for r in accounts.similar(probes, cohorts, 7, threshold).collect():
        got.setdefault(r.probe_id, []).append((r["rank"], r.similar_id, r.similarity, r.similar_premium))
    stats = {r.probe_id: r for r in accounts.cohort_statistics(probes, cohorts, threshold).collect()}
    for a in rows:
        want = near(a, a[0], rows, threshold)
        assert sorted(got.get(a[0], [])) == [(i + 1, b[0], -s, b[8]) for i, (s, b) in enumerate(want[:7])]
        if want:
            assert stats[a[0]].n_accounts == len(want)
            assert stats[a[0]].avg_ratio == pytest.approx(sum(b[7] for _, b in want) / len(want))
            high = [b for _, b in want if b[7] > 80]
            rate = stats[a[0]].non_renewal_pct
            assert rate is None if not high else rate == pytest.approx(100 * sum(b[9] for b in high) / len(high), abs=1e-4)
        else:
            assert a[0] not in stats


def test_submissions_are_probes_that_leave_out_their_own_account(spark):
    rows = book(9, 150)
    cohorts = spark.createDataFrame(rows, SCHEMA)
    rnd = random.Random(1)
    insureds = [(r[0], r[1], r[2], rnd.randrange(15)) for r in rows]
    subs = [(f"S{i}", rnd.choice([None, rnd.choice(rows)[0]]), rnd.choice([None, rnd.randint(5, 60)]), rnd.choice(["C1", None]), rnd.choice([None, 0.4, 1.2, 85.0])) for i in range(60)]
    probes = accounts.submission_probes(
        spark.createDataFrame(subs, "submission_id string, insured_id string, fleet_size int, primary_commodity string, loss_ratio_3yr double"),
        spark.createDataFrame(insureds, "insured_id string, state_domicile string, naics_sector string, years_in_business int"),
    )
    flat = {r.probe_id: (r.probe_id, *[r[c] for c in accounts.PROFILE]) for r in probes.collect()}
    assert len(flat) == 60
    got = {}
    for r in accounts.similar(probes, cohorts).collect():
        got.setdefault(r.probe_id, []).append(r.similar_id)
    stats = {r.probe_id: r.n_accounts for r in accounts.cohort_statistics(probes, cohorts).collect()}
    for i, own, *_ in subs:
        want = near(flat[i], own, rows, 0.75)
        assert got.get(i, []) == [b[0] for _, b in want[:10]]
        assert stats.get(i, 0) == len(want)
    bands = accounts.pricing_band(accounts.similar(probes, cohorts), minimum_confidence=0.0).collect()
    assert {r.probe_id for r in bands} == set(got)
    assert all(r.evidence.count(" LR, ") == r.n_comparables for r in bands)


def test_no_pair_join_and_linear_rows(spark):
    plans = []
    for count in (200, 2000):
        rows = [(f"A{i:05d}", "S1", "T1", 5 + i % 97, "C1", "2-5", "<50%", 1.0, 2.0, False) for i in range(count)]
        cohorts = spark.createDataFrame(rows, SCHEMA)
        found = accounts.similar(accounts.account_probes(cohorts), cohorts)
        assert 9 * count < found.count() <= 10 * count
        plans.append(accounts.cohort_statistics(accounts.account_probes(cohorts), cohorts)._jdf.queryExecution().toString())
    for plan in plans:
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    # Ten times the accounts in equally many profiles: the lists that profiles meet stay as long.
    assert accounts.similar(accounts.account_probes(cohorts), cohorts).select(F.countDistinct("similar_id")).first()[0] <= 97 * 11


def test_exploded_lists_and_ranges_are_not_broadcast(spark):
    cohorts = spark.createDataFrame(book(1, 30), SCHEMA)
    plan = accounts.similar(accounts.account_probes(cohorts), cohorts)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "_node" in line and "Join" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]
