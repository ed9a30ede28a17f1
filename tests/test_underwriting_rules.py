"""Edges of the referral, renewal, pricing and row filter rules."""

import pytest

from haulmark.operators import access, underwriting as uw

SUBMISSION = "submission_id string, insured_id string, primary_commodity string, loss_ratio_3yr double"
INSURED = (
    "insured_id string, csa_unsafe_driving double, csa_hos double, csa_vehicle_maint double, csa_driver_fitness double, years_in_business int, "
    "state_domicile string, primary_commodity string, fleet_size int, dashcam_coverage_pct double"
)
DRIVER = "insured_id string, driver_status string"
CLAIM = "insured_id string, total_incurred double, catastrophic_flag boolean, siu_referral boolean"
POLICY = "policy_id string, insured_id string, policy_status string, renewal_status string, deductible double"
RUN = "insured_id string, policy_year int, loss_ratio double"


def insured(name, *csa, years=10, commodity="General Freight", fleet=10, cameras=0.0, state="X"):
    return (name, *csa, years, state, commodity, fleet, cameras)


@pytest.fixture(scope="module")
def frames(spark):
    insureds = [insured(i, 1.0, 2.0, None, 4.0) for i in "abcdef"] + [insured("g", None, None, None, 50.1), insured("n", None, None, None, None, years=None)]
    submissions = [(f"s{i}", i, "General Freight", 0.1) for i in "abcdegn"] + [("sf", "f", "Electronics", None), ("none", None, "Electronics", 9.0), ("free", "n", None, None)]
    drivers = [("a", "Excluded")] + [("a", "Active")] * 9 + [("b", "Excluded"), ("b", None)]
    claims = [("c", 649999.0, None, None), ("d", 650000.0, False, False), ("e", None, None, True), ("e", 1.0, None, None), ("a", 1.0, None, False)]
    policies = [("p1", "a", "Active", "Auto-Renew", 1000.0), ("p2", "e", "Expired", "Non-Renew", 1.0), ("p3", "f", "Active", None, None), ("p4", "g", "Active", "Non-Renew", 9.0), ("p5", "e", "Active", None, 5000.0), ("p6", "n", "Active", None, 4999.0)]
    tables = [(submissions, SUBMISSION), (insureds, INSURED), (drivers, DRIVER), (claims, CLAIM), (policies, POLICY)]
    return [spark.createDataFrame(rows, schema) for rows, schema in tables]


def test_referrals(frames):
    got = {r.submission_id: (r.triggers, r.tier) for r in uw.referral_triggers(*frames).collect()}
    assert got == {
        "sa": ([], "NONE"),  # one in ten is not above 10 %
        "sb": (["EXCLUDED_DRIVERS"], "Claims Director"),
        "sc": (["LARGE_CLAIM"], "Claims Director"),
        "sd": (["LARGE_CLAIM"], "Reserve Committee"),
        "se": ([], "NONE"),  # only an expired policy is not renewed
        "sf": (["HIGH_VALUE_CARGO"], "CCO"),
        "sg": (["CSA_SCORE"], "Reserve Committee"),  # fourth score, and a policy not renewed
        "sn": ([], "NONE"),
        "free": ([], "NONE"),
    }


def test_referrals_of_given_cargo(frames):
    got = uw.referral_triggers(*frames, high_value=["General Freight"]).where("submission_id = 'sa'").first()
    assert (got.triggers, got.tier) == (["HIGH_VALUE_CARGO"], "CCO")


def test_suspected_fraud_is_not_renewed(spark, frames):
    _, _, _, claims, policies = frames
    runs = spark.createDataFrame([(i, 2000, 10.0) for i in "aefg"] + [("f", 1999, 95.0)], RUN)
    referrals = spark.createDataFrame([("g",)], "insured_id string")
    got = {r.policy_id: r.outcome for r in uw.renewal_outcome(policies, runs, claims, referrals).collect()}
    assert got == {"p1": "Auto-Renew", "p3": "Auto-Renew", "p4": "Review Required", "p5": "Non-Renew", "p6": "Review Required"}


def test_indication_by_hand(spark, frames):
    policies = frames[4]
    insureds = spark.createDataFrame(
        [
            insured("e", 80.0, 1.0, None, 80.1, years=20, cameras=100.0, fleet=2, state="Y"),
            insured("n", None, None, None, None, years=None, cameras=None, fleet=3, commodity=None),
            insured("z", 50.0, 1.0, 1.0, 1.0, fleet=1),
        ],
        INSURED,
    )
    runs = spark.createDataFrame([("e", 1, 500.0), ("e", 2, 80.0), ("e", 3, 90.0), ("e", 4, 100.0), ("z", 1, 55.0), ("n", 1, None)], RUN)
    rates = uw.Rates(base=1000.0, expense=7.0)
    accounts = uw.rating_accounts(insureds, runs, policies)
    territory = spark.createDataFrame([("Y", 1.5)], "state_domicile string, territory_factor double")
    commodity = spark.createDataFrame([("General Freight", 2.0)], "primary_commodity string, commodity_factor double")
    got = {r[0]: tuple(r[1:]) for r in uw.premium_indication(accounts, rates, territory, commodity).collect()}
    # e: mean of the last three runs is 90, not above it; worst score above 80; all three credits.
    assert got["e"] == (6000.0, 1500.0, 1500.0, 1500.0, 7507.0)
    assert got["n"] == (3000.0, 0.0, 0.0, 0.0, 3007.0)
    assert got["z"] == (2000.0, 0.0, 0.0, 0.0, 2007.0)


def test_rows_of_a_user(spark):
    rows = spark.createDataFrame([("b1", 1), ("b1", 1), ("b2", 2), (None, 3), ("b3", 4)], "broker_name string, n int")
    entitled = spark.createDataFrame([("u", "b1"), ("u", "b1"), ("u", None), ("u", "b3"), ("v", "b2")], "user_id string, broker_name string")
    seen = lambda user: sorted(r.n for r in access.rows_of_user(rows, entitled, user).collect())
    assert (seen("u"), seen("v"), seen("w")) == ([1, 1, 4], [2], [])
    assert access.rows_of_user(rows, entitled, "u").columns == ["broker_name", "n"]
