"""Earned premium and claims on terms: nothing is lost, and terms are those in force."""

import datetime as dt
import random

import pytest

from haulmark.operators import experience

POLICY = "policy_id string, insured_id string, effective_date date, expiration_date date, written_premium double"
CLAIM = "claim_id string, policy_id string, insured_id string, loss_date date, total_incurred double"


def day(n):
    return dt.date(1998, 1, 1) + dt.timedelta(days=n)


def book(seed=1):
    rng = random.Random(seed)
    policies = []
    for i in range(80):
        start = rng.randrange(900)
        policies.append((f"P{i}", f"I{rng.randrange(12)}", day(start), day(start + rng.choice([1, 90, 365, 730])), float(rng.randrange(1, 9000))))
    policies += [("PN", None, day(5), day(100), 10.0), ("PX", "I1", day(5), None, 70.0), ("PY", "I1", None, None, 30.0), ("PZ", "I2", day(40), day(40), 5.0)]
    claims = [(f"C{i}", f"P{rng.randrange(95)}", f"I{rng.randrange(14)}", day(rng.randrange(1300)), float(rng.randrange(9999))) for i in range(400)]
    claims += [("CN", None, None, day(3), 1.0), ("CD", "P1", "I1", None, 2.0), ("CM", "P2", "I3", day(9), None)]
    return policies, claims


@pytest.fixture
def frames(spark):
    policies, claims = book()
    return policies, claims, spark.createDataFrame(policies, POLICY), spark.createDataFrame(claims, CLAIM)


def test_premium_is_earned_by_days(frames):
    policies, _, p, _ = frames
    got = {(r.policy_id, r.year): float(r.earned) for r in experience.earned_premium(p).collect()}
    for i, _, a, b, premium in policies:
        if a and b and a < b:
            for year in range(a.year, (b - dt.timedelta(days=1)).year + 1):
                days = (min(b, dt.date(year + 1, 1, 1)) - max(a, dt.date(year, 1, 1))).days
                assert got.pop((i, year)) == pytest.approx(premium * days / (b - a).days, abs=1e-5)
        else:
            assert got.pop((i, a and a.year)) == premium
    assert not got


def test_totals_before_and_after_are_equal(spark, frames):
    policies, claims, p, c = frames
    units = spark.createDataFrame([(f"I{i}", i) for i in range(8)], "insured_id string, fleet_size int")
    rows = experience.loss_metrics(p, c, units).collect()
    assert len({(r.insured_id, r.year) for r in rows}) == len(rows)
    assert sum(r.num_claims for r in rows) == len(claims)
    assert sum(r.total_incurred for r in rows) == sum(x[4] or 0 for x in claims)
    assert sum(r.earned_premium or 0 for r in rows) == pytest.approx(sum(x[4] for x in policies), abs=1e-3)
    bare = [r for r in rows if r.earned_premium is None]
    assert bare and all(r.loss_ratio is None for r in bare)
    total = experience.year_results(experience.loss_metrics(p, c, units), 30.0).collect()
    assert sum(r.num_claims for r in total) == len(claims)


def test_claims_meet_the_term_in_force(frames):
    policies, claims, p, c = frames
    got = {r.claim_id: r.term_policy_id for r in experience.claims_on_terms(c, p).collect()}
    assert len(got) == len(claims)
    for i, own, insured, loss, _ in claims:
        live = [x for x in policies if loss and x[2] and x[3] and x[2] <= loss < x[3]]
        best = [x for x in live if x[0] == own] or sorted((x for x in live if insured and x[1] == insured), key=lambda x: (x[2], x[0]))[-1:]
        assert got[i] == (best[0][0] if best else None)
    terms = experience.term_losses(c, p).collect()
    assert sum(r.num_claims for r in terms) == len(claims)
    assert {r.policy_id for r in terms} - {None} == {x[0] for x in policies}
    assert any(r.policy_id is None and r.insured_id for r in terms)


def test_terms_laid_out_by_months_are_not_broadcast(frames):
    # The guessed size of the laid out terms does not count the rows that months add.
    _, _, p, c = frames
    plan = experience.claims_on_terms(c, p)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "_month" in line and "Join" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]
