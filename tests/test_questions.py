"""Answers that list rows: unknown accounts, null conditions, one account by name."""

import datetime as dt

from pyspark.sql import functions as F

from haulmark.operators import access, underwriting
from haulmark.operators import questions as qs

NAMES = "insured_id string, company_name string, safety_rating string, csa_unsafe_driving double, csa_hos double, csa_vehicle_maint double, dashcam_coverage_pct double, fleet_size int"
CLAIM = "insured_id string, claim_id string, policy_id string, loss_date date, loss_type string, claim_status string, total_incurred double"
DRIVER = "insured_id string, driver_id string, first_name string, driver_status string, mvr_points int, accidents_3yr int, violations_3yr int"


def test_lists_and_profiles(spark):
    names = spark.createDataFrame([("I1", "Lone Star", "Satisfactory", 1.0, 2.0, 3.0, 4.0, 10), ("I2", "Pacific Coast", None, None, 2.0, 3.0, 4.0, 0)], NAMES)
    day = dt.date(2024, 1, 1)
    claims = spark.createDataFrame([("I1", "C1", "P", day, "Cargo", "Open", 5.0), ("I9", "C2", "P", day, "Cargo", "Open", 5.0), (None, "C3", None, None, None, None, None)], CLAIM)
    drivers = spark.createDataFrame([("I1", "D1", "A", "Excluded", 3, 1, None), ("I1", "D2", "B", None, 6, None, 2), ("I9", "D3", "C", "Excluded", 1, 1, 1)], DRIVER)
    assert {(r.claim_id, r.company_name) for r in qs.claim_list(claims, names, F.lit(True)).collect()} == {("C1", "Lone Star"), ("C2", None), ("C3", None)}
    assert [r.claim_id for r in qs.claim_list(claims, names, F.lit(True), "lone").collect()] == ["C1"]
    assert [r.driver_id for r in qs.driver_list(drivers, names, F.col("driver_status") == "Excluded").collect()] == ["D1"]
    safety = {r.insured_id: r for r in qs.safety_profile(names, drivers, claims).collect()}
    assert (safety["I1"].n_drivers, safety["I1"].avg_mvr, safety["I1"].accidents, safety["I1"].claims_per_unit) == (2, 4.5, 1, 0.1)
    assert (safety["I2"].n_drivers, safety["I2"].avg_mvr, safety["I2"].n_claims, safety["I2"].claims_per_unit) == (0, None, 0, None)


def test_policies_by_the_ratio_of_their_year(spark):
    policies = spark.createDataFrame([("P1", "I1", 2020, "L"), ("P2", "I1", 2021, "L"), ("P3", None, 2020, "L")], "policy_id string, insured_id string, policy_year int, line_of_business string")
    runs = spark.createDataFrame([("I1", 2020, 120.0), ("I1", 2021, None), (None, 2020, 300.0)], "insured_id string, policy_year int, loss_ratio double")
    assert [r.policy_id for r in qs.policies_above_ratio(policies, runs).collect()] == ["P1"]


def test_growth_conversion_and_seen_categories(spark):
    insureds = spark.createDataFrame([("I1", "Grain"), ("I2", "Steel")], "insured_id string, kind string")
    policies = spark.createDataFrame([("I1", 2020, 100.0), ("I1", 2021, 300.0), ("I2", 2020, 100.0), ("I2", 2021, 100.0), ("I9", 2021, 50.0)], "insured_id string, policy_year int, written_premium double")
    runs = spark.createDataFrame([("I1", 2021, 270.0), ("I2", 2021, 10.0), ("I2", 2022, 5.0)], "insured_id string, policy_year int, total_incurred double")
    rows = {(r.kind, r.year): r for r in underwriting.segment_growth(policies, runs, insureds, "kind").collect()}
    assert set(rows) == {("Grain", 2020), ("Grain", 2021), ("Steel", 2020), ("Steel", 2021), ("Steel", 2022), (None, 2021)}
    assert (rows["Grain", 2021].growth_pct, rows["Grain", 2021].loss_ratio, rows["Grain", 2021].outgrows_losses) == (200.0, 90.0, True)
    assert not rows["Steel", 2021].outgrows_losses and rows["Grain", 2020].growth_pct is None and rows["Steel", 2022].loss_ratio is None
    subs = spark.createDataFrame([("b", s) for s in ("New", "Quoted", "Bound", "Lost", "Declined", None)] + [(None, "New")], "broker string, submission_status string")
    got = {r.broker: r for r in underwriting.conversion(subs, "broker").collect()}
    assert (got["b"].n_submissions, got["b"].n_quoted, got["b"].n_bound, got["b"].bind_pct) == (6, 3, 1, 33.3333)
    assert got[None].bind_pct is None and got[None].conversion_pct == 0.0
    policy = spark.createDataFrame([("all", None), ("few", ["a"]), ("idle", ["a"])], "role string, allowed array<string>")
    hits = spark.createDataFrame([("all", "b"), ("few", "b"), ("few", "a"), ("few", "b")], "role string, category string")
    seen = {r.role: (r.categories, r.unexpected) for r in access.seen_categories(hits, policy).collect()}
    assert seen == {"all": (["b"], []), "few": (["a", "b"], ["b"]), "idle": ([], [])}
