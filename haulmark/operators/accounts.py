"""Comparable accounts, cohort statistics and pricing bands.

A probe (an account or a submission) is compared with the accounts of its state and sector whose
fleet is within the tolerance.  Similarity is a sum of weights of the fields that agree, so it
depends only on which of four fields agree, and no pair of profiles is ever formed:

* the best accounts are found through small lists.  For every set of agreeing fields that reaches
  the threshold, and every aligned interval of fleet sizes, the first ``n + 1`` accounts are kept;
  a probe's range is a few such intervals.  An account among a probe's best is one of the first in
  the list of its own set of fields, so the lists hold the whole answer;
* statistics over all comparable accounts are differences of running sums over the fleet size,
  with sets of agreeing fields combined by inclusion and exclusion.

Probes are reduced to distinct profiles first.  Work grows with the accounts and the profiles, not
with their product, however many accounts share a profile.  A null field agrees with nothing, and a
probe without state, sector or fleet size has no comparable account.
"""

from __future__ import annotations

from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions.ranking import join_same, top_n
from haulmark.functions.text import normalize_ratio
from haulmark.operators.underwriting import exact_mean, fleet_band, loss_ratio_band, years_band

PROFILE = ["state_domicile", "naics_sector", "fleet_size", "primary_commodity", "years_band", "ratio_band"]

# Weight of agreement per field: high 3, medium 2, low 1.
WEIGHTS = {"sector": 3, "fleet_band": 3, "state": 2, "commodity": 2, "years_band": 1, "ratio_band": 3}


def historical_cohorts(insureds: DataFrame, loss_runs: DataFrame, policies: DataFrame) -> DataFrame:
    """One row per account: profile fields, mean loss ratio, mean premium and outcome."""
    ratio = loss_runs.groupBy("insured_id").agg(exact_mean("loss_ratio").alias("loss_ratio"))
    book = policies.groupBy("insured_id").agg(
        exact_mean("written_premium", 2).alias("premium"),
        F.max(F.col("renewal_status") == "Non-Renew").alias("non_renewed"),
    )
    both = insureds.join(ratio, "insured_id").join(book, "insured_id")
    return both.select(
        "insured_id",
        "state_domicile",
        "naics_sector",
        "fleet_size",
        "primary_commodity",
        years_band(F.col("years_in_business")).alias("years_band"),
        loss_ratio_band(F.col("loss_ratio")).alias("ratio_band"),
        "loss_ratio",
        "premium",
        "non_renewed",
    )


# The fields that may agree or not, next to state and sector, which have to.
_FIELDS = {"fleet_band": "fleet_band", "primary_commodity": "commodity", "years_band": "years_band", "ratio_band": "ratio_band"}
_BASE = WEIGHTS["sector"] + WEIGHTS["state"]
_TOTAL = float(sum(WEIGHTS.values()))
_RANK = ["similarity", "similar_id", "similar_fleet", "similar_ratio", "similar_premium", "similar_non_renewed"]


def account_probes(cohorts: DataFrame) -> DataFrame:
    """Every account as a probe that must not find itself."""
    return cohorts.select(F.col("insured_id").alias("probe_id"), F.col("insured_id").alias("own_id"), *PROFILE)


def submission_probes(submissions: DataFrame, insureds: DataFrame) -> DataFrame:
    """Submissions as probes: state, sector and years of the insured, the rest as submitted."""
    known = insureds.select("insured_id", "state_domicile", "naics_sector", "years_in_business")
    both = submissions.select("submission_id", "insured_id", "fleet_size", "primary_commodity", "loss_ratio_3yr").join(known, "insured_id", "left")
    percent = F.when(F.col("loss_ratio_3yr").isNotNull(), normalize_ratio(F.col("loss_ratio_3yr")) * 100)
    return both.select(
        F.col("submission_id").alias("probe_id"),
        F.col("insured_id").alias("own_id"),
        "state_domicile",
        "naics_sector",
        "fleet_size",
        "primary_commodity",
        years_band(F.col("years_in_business")).alias("years_band"),
        loss_ratio_band(percent).alias("ratio_band"),
    )


def _field_sets() -> list[tuple[str, ...]]:
    return list(chain.from_iterable(combinations(_FIELDS, k) for k in range(len(_FIELDS) + 1)))


def _reaches(fields: tuple[str, ...], threshold: float) -> bool:
    return round((_BASE + sum(WEIGHTS[_FIELDS[f]] for f in fields)) / _TOTAL, 4) >= threshold


def _similarity(a: str, b: str) -> Column:
    """Weighted agreement of the fields with prefix ``a`` and with prefix ``b``."""
    agree = [F.when(F.col(f"{a}{f}") == F.col(f"{b}{f}"), WEIGHTS[w]).otherwise(0) for f, w in _FIELDS.items()]
    return F.round((F.lit(_BASE) + sum(agree[1:], agree[0])) / F.lit(_TOTAL), 4)


def _with_band(df: DataFrame) -> DataFrame:
    whole = F.col("state_domicile").isNotNull() & F.col("naics_sector").isNotNull() & F.col("fleet_size").isNotNull()
    return df.where(whole).withColumn("fleet_band", fleet_band(F.col("fleet_size")))


def _keyed(df: DataFrame, sets: list[tuple[int, tuple[str, ...]]]) -> DataFrame:
    """One row per row and set of fields: _set and _key, the values that have to agree."""
    keys = []
    for number, fields in sets:
        key = F.to_json(F.struct("state_domicile", "naics_sector", *fields))
        complete = F.lit(True)
        for f in fields:
            complete = complete & F.col(f).isNotNull()
        keys.append(F.when(complete, F.struct(F.lit(number).alias("_set"), key.alias("_key"))))
    return df.withColumn("_s", F.explode(F.array(*keys))).where("_s IS NOT NULL").withColumns({"_set": F.col("_s._set"), "_key": F.col("_s._key")}).drop("_s")


def _range(tolerance_pct: int) -> tuple[Column, Column]:
    """Smallest and largest fleet within the tolerance."""
    size = F.col("fleet_size").cast("long")
    return F.ceil(size * (100 - tolerance_pct) / F.lit(100)), F.floor(size * (100 + tolerance_pct) / F.lit(100))


def _levels(longest: Column) -> Column:
    """One row for every power of two up to ``longest``."""
    return F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(longest, F.lit(1.0)))).cast("int"))).alias("_level")


def similar(
    probes: DataFrame, cohorts: DataFrame, n: int = fv.SIMILAR_ACCOUNTS, threshold: float = fv.SIMILARITY_THRESHOLD, tolerance_pct: int = 30
) -> DataFrame:
    """Best ``n`` accounts for every probe (probe_id, own_id, profile fields), with ratio, premium and outcome."""
    sets = [(i, fields) for i, fields in enumerate(_field_sets()) if _reaches(fields, threshold)]
    # A probe only leaves out itself, so n + 1 members of a profile, and of a list, are enough.
    members = top_n(_with_band(cohorts), PROFILE, [F.asc("insured_id")], n + 1, "_m").drop("_m")
    size = F.col("fleet_size").cast("long")
    # No probe that reaches an account asks for a longer interval than this account's longest.
    longest = size * (2 * tolerance_pct) / F.lit(100.0 - tolerance_pct) + 3
    lists = _keyed(members, sets).select("*", _levels(longest)).withColumn("_node", F.floor(size / F.pow(F.lit(2.0), "_level")).cast("long"))
    lists = top_n(lists, ["_set", "_key", "_level", "_node"], [F.asc("insured_id")], n + 1, "_m")
    lists = lists.select(
        "_set", "_key", "_level", "_node",
        *[F.col(f).alias(f"o_{f}") for f in _FIELDS],
        F.col("insured_id").alias("similar_id"),
        F.col("fleet_size").alias("similar_fleet"),
        F.col("loss_ratio").alias("similar_ratio"),
        F.col("premium").alias("similar_premium"),
        F.col("non_renewed").alias("similar_non_renewed"),
    )

    # The aligned intervals that make up a range: inside it, with a parent that is not.
    low, high = _range(tolerance_pct)
    asks = _keyed(_with_band(probes.select(*PROFILE).distinct()), sets).withColumns({"_low": low, "_high": high})
    step = F.pow(F.lit(2.0), "_level").cast("long")
    ends = F.array_distinct(F.array(F.ceil(F.col("_low") / step), F.floor((F.col("_high") + 1) / step) - 1))
    asks = asks.select("*", _levels(F.col("_high") - F.col("_low") + 1)).withColumn("_node", F.explode(ends))
    inside = lambda node, size: (node * size >= F.col("_low")) & ((node + 1) * size - 1 <= F.col("_high"))
    parent = F.floor(F.col("_node") / 2)
    asks = asks.where(inside(F.col("_node"), step) & ~inside(parent, step * 2)).drop("_low", "_high")

    # The guessed size of an exploded side does not count the rows it was exploded to: no broadcast.
    met = asks.join(lists.hint("merge"), ["_set", "_key", "_level", "_node"]).withColumn("similarity", _similarity("", "o_"))
    met = met.select(*PROFILE, *_RANK).dropDuplicates([*PROFILE, "similar_id"])
    best = top_n(met, PROFILE, [F.desc("similarity"), F.asc("similar_id")], n + 1, "_c")
    # One list of at most n + 1 candidates per profile; every probe drops its own account from it.
    best = best.groupBy(*PROFILE).agg(F.array_sort(F.collect_list(F.struct("_c", *_RANK))).alias("_list"))
    own = join_same(probes, best.hint("merge"), PROFILE)
    others = F.slice(F.filter("_list", lambda s: ~s["similar_id"].eqNullSafe(F.col("own_id"))), 1, n)
    return own.select("probe_id", F.posexplode(others).alias("_p", "_s")).select(
        "probe_id", (F.col("_p") + 1).alias("rank"), *[F.col(f"_s.{c}").alias(c) for c in _RANK[1:2] + _RANK[:1] + _RANK[2:]]
    )


def cohort_statistics(
    probes: DataFrame, cohorts: DataFrame, threshold: float = fv.SIMILARITY_THRESHOLD, high_ratio: float = 80.0, tolerance_pct: int = 30
) -> DataFrame:
    """Over all comparable accounts: number, mean ratio, non-renewal rate above ``high_ratio``."""
    # Accounts that agree in exactly the fields of some set that reaches the threshold, from counts
    # of those that agree in at least the fields of a set.
    every = _field_sets()
    weight = {
        outer: sum((-1) ** (len(outer) - len(inner)) for inner in every if set(inner) <= set(outer) and _reaches(inner, threshold)) for outer in every
    }
    sets = [(i, fields) for i, fields in enumerate(every) if weight[fields]]
    sign = F.element_at(F.create_map(*[F.lit(x) for i, fields in sets for x in (i, weight[fields])]), F.col("_set"))
    high = F.coalesce(F.col("loss_ratio") > high_ratio, F.lit(False))
    dropped = high & F.coalesce("non_renewed", F.lit(False))
    names = ["_n", "_ratio", "_high", "_dropped"]
    values = [F.lit(1), F.coalesce(F.col("loss_ratio").cast("decimal(18,6)"), F.lit(0)), high.cast("int"), dropped.cast("int")]
    accounts = _with_band(cohorts).withColumns(dict(zip(names, values)))
    held = accounts.groupBy(*PROFILE, "fleet_band").agg(*[F.sum(c).alias(c) for c in names])
    held = _keyed(held, sets).groupBy("_set", "_key", F.col("fleet_size").cast("long").alias("_x")).agg(*[F.sum(c).alias(c) for c in names])

    profiles = probes.select(*PROFILE).distinct()
    low, high_end = _range(tolerance_pct)
    bounds = F.explode(F.array(F.struct(high_end.alias("_x"), F.lit(1).alias("_sign")), F.struct((low - 1).alias("_x"), F.lit(-1).alias("_sign"))))
    asks = _keyed(_with_band(profiles), sets).withColumn("_b", bounds).withColumns({"_x": F.col("_b._x"), "_sign": F.col("_b._sign") * sign}).drop("_b")
    both = held.withColumn("_ask", F.lit(0)).unionByName(asks.select("_set", "_key", "_x", "_sign", *PROFILE, F.lit(1).alias("_ask")), allowMissingColumns=True)
    upto = Window.partitionBy("_set", "_key").orderBy("_x", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    running = both.select("_ask", "_sign", *PROFILE, *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in names]).where("_ask = 1")
    around = running.groupBy(*PROFILE).agg(*[F.sum(F.col(c) * F.col("_sign")).alias(c) for c in names])

    found = join_same(probes, around.hint("merge"), PROFILE)
    mine = accounts.select(
        F.col("insured_id").alias("own_id"), *[F.col(c).alias(f"o_{c}") for c in [*PROFILE, "fleet_band"]], *[F.col(c).alias(f"o{c}") for c in names]
    )
    found = _with_band(found).join(mine.hint("merge"), "own_id", "left")
    size = F.col("o_fleet_size").cast("long")
    counts = (F.col("o_state_domicile") == F.col("state_domicile")) & (F.col("o_naics_sector") == F.col("naics_sector"))
    counts = counts & size.between(*_range(tolerance_pct)) & (_similarity("", "o_") >= threshold)
    # The probe's own account is taken out again where it was counted.
    left = {c: F.col(c) - F.when(counts, F.col(f"o{c}")).otherwise(F.lit(0)) for c in names}
    return found.where(left["_n"] > 0).select(
        "probe_id",
        left["_n"].cast("long").alias("n_accounts"),
        (left["_ratio"].cast("double") / left["_n"].cast("double")).alias("avg_ratio"),
        F.round(F.try_divide(left["_dropped"] * F.lit(100.0), left["_high"].cast("double")), 4).alias("non_renewal_pct"),
    )


def pricing_band(similar: DataFrame, wanted: int = fv.SIMILAR_ACCOUNTS, minimum_confidence: float = 0.60) -> DataFrame:
    """Quartile premium band of a probe's comparables; hidden below the minimum confidence.

    Confidence is the mean similarity times the share of wanted comparables found.  The evidence
    lists at most ``wanted`` accounts with fleet, premium, loss ratio and outcome.
    """
    whole = lambda c: F.coalesce(F.round(c, 0).cast("long").cast("string"), F.lit("?"))
    outcome = F.when(F.col("similar_non_renewed"), "Non-renewed").otherwise("Renewed")
    line = F.concat(
        "similar_id", F.lit(": "), whole("similar_fleet"), F.lit(" u., $"), whole("similar_premium"), F.lit(", "), whole("similar_ratio"), F.lit("% LR, "), outcome
    )
    banded = similar.groupBy("probe_id").agg(
        F.count(F.lit(1)).alias("n_comparables"),
        F.percentile("similar_premium", F.lit(0.25)).alias("_low"),
        F.percentile("similar_premium", F.lit(0.5)).alias("_mid"),
        F.percentile("similar_premium", F.lit(0.75)).alias("_high"),
        F.round(F.avg("similarity") * F.least(F.count(F.lit(1)) / F.lit(float(wanted)), F.lit(1.0)), 4).alias("confidence"),
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_e"),
    )
    return banded.where(F.col("confidence") >= minimum_confidence).select(
        "probe_id",
        "n_comparables",
        F.round("_low", 4).alias("low_premium"),
        F.round("_mid", 4).alias("median_premium"),
        F.round("_high", 4).alias("high_premium"),
        "confidence",
        F.array_join(F.transform("_e", lambda s: s["line"]), "|").alias("evidence"),
    )
