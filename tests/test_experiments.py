import hashlib
import math
import statistics
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from frames import moments_row
from touchtally.operators import assignment, bayes, design, estimators, guardrails, integrity, moments, sequential
from touchtally.operators.ranks import ranked
from touchtally.sources.tables import experiment_config

ASSIGNMENT = (
    "user_id long, experiment_id string, variant string, assign_ts timestamp_ntz, pre_covariate double, "
    "primary_metric double, guardrail_refund boolean, guardrail_latency_ms double"
)


def config(spark, *ids, **settings):
    return experiment_config(spark, [
        {"experiment_id": i, "salt": f"salt-{i}", "practical_threshold": 0.005, **settings} for i in ids
    ])


def arm_sizes(spark, sizes, experiment="e"):
    rows = [(experiment, variant, i) for variant, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "experiment_id string, variant string, user_id long")


def weights(spark, **shares):
    return spark.createDataFrame(
        [("e", v, float(w)) for v, w in shares.items()], "experiment_id string, variant string, weight double"
    )


# --- assignment -----------------------------------------------------------------------


def test_hash_matches_hashlib(spark):
    ids = [0, 1, 7, 42, 10**12]
    df = assignment.assign(spark.createDataFrame([(i,) for i in ids], "user_id long"), "some-salt", 0.5)
    for row in df.collect():
        digest = hashlib.sha256(f"some-salt:{row.user_id}".encode()).hexdigest()
        assert row.bucketing_hash == int(digest[:16], 16) / 2**64
        assert row.variant == ("control" if row.bucketing_hash < 0.5 else "treatment")


def test_string_and_number_ids_hash_alike(spark):
    a = assignment.assign(spark.createDataFrame([("7",)], "user_id string"), "s").first()
    b = assignment.assign(spark.createDataFrame([(7,)], "user_id long"), "s").first()
    assert a.bucketing_hash == b.bucketing_hash


def test_splits_and_their_limits(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "user_id")
    shares = {r.variant: r["count"] / 20_000 for r in assignment.assign_multivariate(
        ids, "m", [("a", 0.5), ("b", 0.2), ("c", 0.3)]).groupBy("variant").count().collect()}
    assert shares == pytest.approx({"a": 0.5, "b": 0.2, "c": 0.3}, abs=0.015)
    two = assignment.assign(ids, "m", 0.5).select("user_id", F.col("variant").alias("v"))
    multi = assignment.assign_multivariate(ids, "m", [("control", 0.5), ("treatment", 0.5)])
    assert multi.join(two, "user_id").where("v <> variant").count() == 0
    assert assignment.assign(ids, "m", 1.0).where("variant <> 'control'").count() == 0
    with pytest.raises(ValueError):
        assignment.assign(ids, "m", 1.1)
    for bad in ([("a", 0.5), ("b", 0.6)], [("a", -0.5), ("b", 1.5)], []):
        with pytest.raises(ValueError):
            assignment.assign_multivariate(ids, "m", bad)


# --- integrity ---------------------------------------------------------------------------


# Sizes, weights and the statistic by hand: the squared distances from the expected sizes over those.
@pytest.mark.parametrize("sizes, shares, chi_square, passed", [
    ({"control": 1030, "treatment": 970}, {"control": 1, "treatment": 1}, 2 * 30**2 / 1000, True),
    ({"control": 1200, "treatment": 1000}, {"control": 1, "treatment": 1}, 2 * 100**2 / 1100, False),
    ({"control": 330, "treatment": 90}, {"control": 3, "treatment": 1}, 15**2 / 315 + 15**2 / 105, True),
    ({"control": 330, "treatment": 90}, {"control": 1, "treatment": 1}, 2 * 120**2 / 210, False),
    ({"x": 90, "y": 110, "z": 100}, {"x": 2, "y": 2, "z": 2}, 2.0, True),
    # A published split, with its statistic and p-value.
    ({"control": 29967, "treatment": 30033}, {"control": 0.5, "treatment": 0.5}, 0.0726, True),
])
def test_sample_ratio(spark, sizes, shares, chi_square, passed):
    row = integrity.srm_check(arm_sizes(spark, sizes), weights(spark, **shares)).first()
    assert row.passed is passed and row.error is None and row.degrees_of_freedom == len(sizes) - 1
    assert row.chi_square == pytest.approx(chi_square)
    if row.degrees_of_freedom == 2:
        assert row.p_value == pytest.approx(math.exp(-chi_square / 2))
    else:
        assert row.p_value == pytest.approx(math.erfc(math.sqrt(chi_square / 2)), rel=1e-6)
    total, weight = sum(sizes.values()), sum(shares.values())
    assert abs(row.worst_delta_units) == pytest.approx(max(abs(n - total * shares[v] / weight) for v, n in sizes.items()))


def test_sample_ratio_errors_stay_in_their_row(spark):
    rows = integrity.srm_check(arm_sizes(spark, {"control": 5, "other": 5}), weights(spark, control=1, treatment=1)).first()
    assert rows.error == "a variant has no expected share" and rows.p_value is None
    lost = integrity.srm_check(arm_sizes(spark, {"control": 50}), weights(spark, control=1, treatment=1)).first()
    assert lost.error is None and lost.passed is False and lost.arms == 2
    lone = integrity.srm_check(arm_sizes(spark, {"control": 50}), weights(spark, control=1)).first()
    assert lone.error == "needs at least two variants"


def test_detectable_loss(spark):
    row = spark.range(1).select(
        integrity.minimum_detectable_loss(F.lit(10.827566170662733), F.lit(30000.0)).alias("f")
    ).first()
    assert row.f == pytest.approx(0.0267, abs=5e-5)


def test_drift_and_duplicates(spark):
    """Every thirtieth of 1200 units is in the other arm: 40 of them."""
    ids = spark.range(1200).withColumnRenamed("id", "user_id").withColumn("experiment_id", F.lit("e"))
    good = assignment.assign(ids, "salt-e", 0.5)
    other = F.when(F.col("variant") == "control", "treatment").otherwise("control")
    moved = good.withColumn("variant", F.when(F.col("user_id") % 30 == 7, other).otherwise(F.col("variant")))
    row = integrity.assignment_reproducibility(moved, config(spark, "e")).first()
    assert row.mismatch_rate == pytest.approx(1 / 30) and row.all_match is False
    assert {r.user_id for r in integrity.mismatched_units(moved, config(spark, "e")).collect()} == set(range(7, 1200, 30))
    assert integrity.assignment_reproducibility(good, config(spark, "e")).first().all_match is True
    units = spark.createDataFrame([("e", i) for i in (8, 3, 3, 9, 8, 8, 1)], "experiment_id string, user_id long")
    assert {r.user_id for r in integrity.duplicate_units(units).collect()} == {3, 8}


# --- estimators --------------------------------------------------------------------------


def z_row(spark, xc, nc, xt, nt, **kw):
    df = moments_row(spark, xc=xc, nc=nc, xt=xt, nt=nt)
    return estimators.two_proportion_test(df, "xc", "nc", "xt", "nt", **kw).first()


def test_two_proportions_published(spark):
    row = z_row(spark, 2369, 29967, 2661, 30033)
    assert row.statistic == pytest.approx(4.220, abs=5e-4) and row.p_value == pytest.approx(2.44e-5, rel=5e-3)
    assert (row.ci_low, row.ci_high) == pytest.approx((0.0051, 0.0140), abs=5e-5) and row.significant
    row = z_row(spark, 800, 10000, 900, 10000)
    pooled = 0.085
    assert row.statistic == pytest.approx(0.01 / (pooled * (1 - pooled) * 2 / 10000) ** 0.5, abs=1e-10)


def test_two_proportions_one_sided_and_edges(spark):
    two, one = z_row(spark, 800, 10000, 900, 10000), z_row(spark, 800, 10000, 900, 10000, two_sided=False)
    assert one.p_value == pytest.approx(two.p_value / 2) and one.ci_low > two.ci_low
    none = z_row(spark, 0, 100, 0, 100)
    assert none.statistic == 0.0 and none.p_value == 1.0 and none.relative_effect is None
    for bad in ((5, 0, 1, 10), (11, 10, 1, 10), (1, 10, -1, 10)):
        row = z_row(spark, *bad)
        assert row.error and row.statistic is None and row.ci_low is None and row.significant is None


def test_z_squared_is_chi_square(spark):
    row = z_row(spark, 120, 1000, 150, 1100)
    p = 270 / 2100
    expected = [(1000 * p, 120), (1000 * (1 - p), 880), (1100 * p, 150), (1100 * (1 - p), 950)]
    assert row.statistic**2 == pytest.approx(sum((o - e) ** 2 / e for e, o in expected))


def test_welch(spark):
    df = moments_row(spark, n_c=5, m_c=3.0, v_c=2.5, n_t=5, m_t=6.0, v_t=10.0)
    row = estimators.welch_test(df, ("n_c", "m_c", "v_c"), ("n_t", "m_t", "v_t")).first()
    assert row.statistic == pytest.approx(3 / 2.5**0.5) and row.degrees_of_freedom == pytest.approx(100 / 17)
    assert row.p_value == pytest.approx(0.10753, abs=1e-4)
    constant = moments_row(spark, n_c=5, m_c=3.0, v_c=0.0, n_t=5, m_t=6.0, v_t=0.0)
    assert "variance" in estimators.welch_test(constant, ("n_c", "m_c", "v_c"), ("n_t", "m_t", "v_t")).first().error
    short = moments_row(spark, n_c=1, m_c=3.0, v_c=1.0, n_t=5, m_t=6.0, v_t=1.0)
    assert "two observations" in estimators.welch_test(short, ("n_c", "m_c", "v_c"), ("n_t", "m_t", "v_t")).first().error


def units(spark, n=400, effect=0.0, experiment="e", start=datetime(2026, 1, 1)):
    rows = []
    for i in range(n):
        x = ((i * 7919) % 101) / 10
        y = 1.0 if (i * 104729 % 97) / 97 < 0.3 + x / 50 + (effect if i % 2 else 0) else 0.0
        rows.append((
            i, experiment, "treatment" if i % 2 else "control", start + timedelta(hours=i),
            None if i % 53 == 0 else x, y, bool(y and i % 5 == 0), 200.0 + i % 17,
        ))
    return spark.createDataFrame(rows, ASSIGNMENT)


def test_cuped_moments_equal_row_level_adjustment(spark):
    df = units(spark)
    m = moments.arm_moments(df)
    row = estimators.cuped_two_sample(m.withColumn("alpha", F.lit(0.05))).first()
    adjusted = estimators.cuped_adjusted_rows(df, m).where("adjusted_metric is not null")
    stats = {r.variant: r for r in adjusted.groupBy("variant").agg(
        F.avg("adjusted_metric").alias("m"), F.var_samp("adjusted_metric").alias("v"), F.count("*").alias("n")).collect()}
    c, t = stats["control"], stats["treatment"]
    assert row.cuped_absolute_effect == pytest.approx(t.m - c.m)
    assert row.cuped_standard_error == pytest.approx((c.v / c.n + t.v / t.n) ** 0.5)
    assert row.variance_reduction == pytest.approx(row.theoretical_reduction)
    assert 0 < row.ci_width_reduction < row.variance_reduction


def test_cuped_without_covariate_spread(spark):
    df = units(spark).withColumn("pre_covariate", F.lit(1.0))
    row = estimators.cuped_two_sample(moments.arm_moments(df).withColumn("alpha", F.lit(0.05))).first()
    assert row.theta == 0.0 and row.correlation == 0.0
    assert row.cuped_absolute_effect == pytest.approx(row.raw_absolute_effect)


def test_beta_binomial_row(spark):
    df = moments_row(spark, xc=2370, nc=29967, xt=2661, nt=30033)
    row = bayes.decision_summary(
        bayes.beta_binomial_test(df, "xc", "nc", "xt", "nt", 0.005), 0.005
    ).first()
    assert row.prob_exceeds_threshold == pytest.approx(0.9770, abs=5e-5)
    assert row.expected_loss_hold == pytest.approx(0.009515, abs=5e-7)
    assert row.ship_within_tolerance and row.loss_tolerance == pytest.approx(0.0005)
    assert row.lift_ci_low < row.lift_median < row.lift_ci_high and "within tolerance" in row.summary
    bad = bayes.beta_binomial_test(moments_row(spark, xc=5, nc=3, xt=1, nt=3), "xc", "nc", "xt", "nt", 0.0).first()
    assert bad.posterior_a_c is None and bad.prob_treatment_better is None
    with pytest.raises(ValueError):
        bayes.posterior_parameters(df, "xc", "nc", "xt", "nt", (0.0, 1.0))


# --- sequential ------------------------------------------------------------------------------


def test_look_plan_rows(spark):
    rows = sequential.look_plan(config(spark, "e")).orderBy("look").collect()
    assert [r.look for r in rows] == [1, 2, 3, 4, 5] and rows[-1].is_final and not rows[0].is_final
    assert sum(r.incremental_alpha for r in rows) == pytest.approx(0.05)
    assert rows[-1].nominal_alpha == pytest.approx(0.039, abs=1e-3)


def test_first_crossing_decides(spark):
    rows = [("late", i, z, b) for i, (z, b) in enumerate(
        zip((1.0, 1.5, 2.0, 2.1, 2.2), (4.383, 3.099, 2.551, 2.254, 2.064)), 1)]
    rows += [("early", 1, 1.0, 4.383), ("early", 2, -3.2, 3.099), ("early", 3, 5.0, 2.551)]
    rows += [("never", 1, 1.0, 4.383), ("never", 2, 1.0, 3.099)]
    looks = spark.createDataFrame(rows, "experiment_id string, look int, z double, z_boundary double").selectExpr(
        "*", "abs(z) >= z_boundary AS crossed", "true AS stop", "0.5D AS nominal_p", "'' AS reason")
    got = {r.experiment_id: (r.look, r.crossed) for r in sequential.sequential_decision(looks).collect()}
    assert got == {"late": (5, True), "early": (2, True), "never": (2, False)}


def looks_by_hand(rows, fractions, metric):
    """Counts, sums and z of each look over the first ceil(fraction * n) units in order of (time, user)."""
    rows = sorted(rows, key=lambda r: (r[3] is None, r[3] or datetime.max, r[0]))
    out = []
    for t in fractions:
        first = rows[: math.ceil(Fraction(str(t)) * len(rows))]
        arms = {v: [metric(r) for r in first if r[2] == v] for v in ("control", "treatment")}
        out.append((arms["control"], arms["treatment"], first[-1][3]))
    return out


def uneven(n=203):
    """Units of few days, many at one time, some without a time; the metric grows with the user."""
    start, rows = datetime(2026, 6, 1), []
    for u in range(n):
        when = None if u % 40 == 3 else start + timedelta(days=(u * u) % 3, seconds=(u % 4) * 30)
        rows.append((u, "e", "control" if u % 3 else "treatment", when, None, float(u % 5 == 0), False, 1e6 + u % 17 + (3 if u % 3 == 0 else 0)))
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_looks_count_exactly_their_units(spark, partitions):
    rows, fractions = uneven(), (0.1, 0.15, 0.2, 0.333, 0.6, 0.95, 1.0)
    df = spark.createDataFrame(rows, ASSIGNMENT).repartition(partitions)
    plan = config(spark, "e", looks=list(fractions))
    looks = sequential.interim_looks(df, plan).orderBy("look").collect()
    hand = looks_by_hand(rows, fractions, lambda r: r[5])
    assert [(r.n_c, r.n_t, r.conversions_c, r.conversions_t) for r in looks] == [(len(c), len(t), sum(c), sum(t)) for c, t, _ in hand]
    assert [r.n_c + r.n_t for r in looks] == [21, 31, 41, 68, 122, 193, 203]
    assert [r.reached_at for r in looks] == [when for *_, when in hand] and looks[-1].reached_at is None
    # The first looks fall in one day and still differ.
    assert len({r.reached_at.date() for r in looks[:3]}) == 1
    final = estimators.two_proportion_test(moments.arm_moments(df), "conversions_c", "n_c", "conversions_t", "n_t", 0.05).first()
    assert looks[-1].z == pytest.approx(final.statistic) and looks[-1].stop


def test_mean_looks_are_welch_statistics(spark):
    rows, fractions = uneven(), (0.02, 0.3, 0.55, 1.0)
    df = spark.createDataFrame(rows, ASSIGNMENT).withColumn(
        "guardrail_latency_ms", F.when(F.col("user_id") % 11 != 0, F.col("guardrail_latency_ms")))
    plan = config(spark, "e", looks=list(fractions))
    looks = sequential.mean_looks(df, plan, "guardrail_latency_ms").orderBy("look").collect()
    for row, (c, t, _) in zip(looks, looks_by_hand(rows, fractions, lambda r: (r[0], r[7]))):
        c, t = ([y for u, y in arm if u % 11] for arm in (c, t))
        assert (row.n_c, row.n_t) == (len(c), len(t))
        if len(c) > 1 and len(t) > 1:
            z = (statistics.mean(t) - statistics.mean(c)) / math.sqrt(statistics.variance(c) / len(c) + statistics.variance(t) / len(t))
            assert row.z == pytest.approx(z) and row.crossed == (abs(z) >= row.z_boundary)
        else:
            assert row.z is None and not row.crossed
    assert looks[-1].mean_t - looks[-1].mean_c > 2 and looks[-1].crossed


def test_looks_of_an_empty_table(spark):
    empty = spark.createDataFrame([], ASSIGNMENT)
    assert sequential.interim_looks(empty, config(spark, "e")).collect() == []
    assert sequential.mean_looks(empty, config(spark, "e"), "guardrail_latency_ms").collect() == []
    assert sequential.aa_audit(empty, config(spark, "e")).collect() == []


def test_ranks_of_a_group_in_many_tasks(spark):
    rows = [("a", i % 50, i) for i in range(3000)] + [("b", 5, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "g string, x long, y long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(df.where("g IS NOT NULL"), ["g"], ["x", "y"])
        tasks = got.where("g = 'a'").select(F.spark_partition_id()).distinct().count()
        got = got.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
    ordered = sorted((x, y) for g, x, y in rows if g == "a")
    assert {r.rank: (r.x, r.y) for r in got if r.g == "a"} == dict(enumerate(ordered, 1))
    assert [r.rank for r in got if r.g == "b"] == [1]


def test_audit_draws_match_hashlib(spark):
    """Each draw by plain Python: bit i of the unit's hash is draw i, looks at exact counts."""
    rows, fractions = uneven(90), (0.5, 1.0)
    plan = config(spark, "e", looks=list(fractions))
    got = sequential.aa_audit(spark.createDataFrame(rows, ASSIGNMENT), plan, 300).first()
    bounds = [r.z_boundary for r in sequential.look_plan(plan).orderBy("look").collect()]
    peeked = crossed = 0
    for d in range(300):
        def arm(u):
            digest = hashlib.sha256(f"salt-e#{d // 256 + 1}:{u}".encode()).digest()
            return "treatment" if digest[d % 256 // 8] >> (7 - d % 8) & 1 else "control"

        zs = []
        for c, t, _ in looks_by_hand([(r[0], r[1], arm(r[0]), *r[3:]) for r in rows], fractions, lambda r: r[5]):
            p = (sum(c) + sum(t)) / (len(c) + len(t))
            zs.append((sum(t) / len(t) - sum(c) / len(c)) / math.sqrt(p * (1 - p) * (1 / len(c) + 1 / len(t))))
        peeked += any(abs(z) >= 1.959963984540054 for z in zs)
        crossed += any(abs(z) >= b for z, b in zip(zs, bounds))
    assert (got.draws, got.fixed_level_rate, got.spending_rate) == (300, pytest.approx(peeked / 300), pytest.approx(crossed / 300))


def test_audit_tells_peeking_from_spending(spark):
    """At 256 draws a fixed level with five looks is seen to err more often than the plan, for any control share."""
    rows = [(u, "e", "control", datetime(2026, 6, 1) + timedelta(minutes=u), None, float(u % 3 == 0), False, 0.0) for u in range(2000)]
    df = spark.createDataFrame(rows, ASSIGNMENT)
    for share in (0.5, 0.25, 0.3):
        row = sequential.aa_audit(df, config(spark, "e", control_share=share)).first()
        assert row.draws == 256 and 0.01 <= row.spending_rate <= 0.1 < row.fixed_level_rate < 0.25


def test_audit_multiplies_no_unit(spark, tmp_path):
    """No row generator in the plan, whatever the number of draws."""
    units = sequential._units(spark.createDataFrame(uneven(), ASSIGNMENT), "primary_metric").withColumns(
        {"look": F.lit(1), "words": F.lit(b"0" * 32), "control_share": F.lit(0.5)})
    plan = sequential._redrawn_sums(units, 256, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


# --- guardrails --------------------------------------------------------------------------------


def guard(spark, ec, nc, et, nt, margin, **kw):
    df = moments_row(spark, ec=ec, nc=nc, et=et, nt=nt)
    df = guardrails.guardrail_proportion(df, "g", "ec", "nc", "et", "nt", margin, **kw)
    return guardrails.guardrail_report(df, ["g"]).first()


def test_guardrail_verdicts(spark):
    passed = guard(spark, 3000, 50000, 3150, 50000, 0.01)
    assert passed.g_verdict == "PASS" and passed.g_harm == pytest.approx(0.003) and passed.guardrails_passed
    assert guard(spark, 3000, 50000, 4250, 50000, 0.01).g_verdict == "FAIL"
    unclear = guard(spark, 30, 500, 33, 500, 0.01)
    assert unclear.g_verdict == "INCONCLUSIVE" and not unclear.g_adequately_powered
    assert unclear.guardrails_blocking == ["g (INCONCLUSIVE)"] and unclear.guardrails_underpowered == ["g"]
    worse = guard(spark, 20000, 50000, 18500, 50000, 0.01, direction=guardrails.HIGHER_IS_BETTER)
    assert worse.g_harm == pytest.approx(0.03) and worse.g_verdict == "FAIL" and worse.g_harm_ci_low < worse.g_harm_ci_high
    free = guard(spark, 0, 500, 3, 500, 0.0)
    assert free.g_verdict == "INCONCLUSIVE" and free.g_error == "margin must be positive"
    with pytest.raises(ValueError):
        guard(spark, 1, 10, 1, 10, 0.1, direction="sideways")


def test_guardrail_mean_matches_interval(spark):
    df = moments_row(spark, n_c=1000, m_c=220.0, v_c=400.0, n_t=1000, m_t=223.0, v_t=400.0)
    df = guardrails.guardrail_mean(df, "g", ("n_c", "m_c", "v_c"), ("n_t", "m_t", "v_t"), 25.0)
    row = guardrails.guardrail_rows(df, ["g"]).first()
    assert row.verdict == "PASS" and row.harm == pytest.approx(3.0) and row.non_inferiority_p < 1e-10
    assert row.resolvable_margin == pytest.approx(2.8016 * 0.8**0.5, abs=1e-3)


def test_margin_and_units_are_inverse(spark):
    row = spark.range(1).select(
        guardrails.required_n_for_margin(F.lit(0.05), F.lit(0.005)).alias("n"),
        guardrails.required_n_for_margin(F.lit(0.05), F.lit(0.0)).alias("impossible"),
        guardrails.minimum_resolvable_margin(F.lit(0.0), F.lit(10), F.lit(10)).alias("none"),
    ).first()
    assert row.impossible is None and row.none is None
    back = spark.range(1).select(
        guardrails.minimum_resolvable_margin(F.lit(0.05), F.lit(row.n), F.lit(row.n)).alias("m")).first()
    assert back.m == pytest.approx(0.005, rel=1e-3)


# --- design --------------------------------------------------------------------------------------


def test_sample_size_power_and_mde_are_consistent(spark):
    row = spark.range(1).select(
        design.sample_size_two_proportions(F.lit(0.10), F.lit(0.02)).alias("s"),
        design.power_two_proportions(F.lit(3841), F.lit(0.10), F.lit(0.02)).alias("power"),
        design.mde_two_proportions(F.lit(3841), F.lit(0.10)).alias("mde"),
        design.mde_two_proportions(F.lit(5), F.lit(0.10)).alias("unreachable"),
        design.sample_size_two_proportions(F.lit(0.10), F.lit(0.02), ratio=2.0).alias("uneven"),
        design.sample_size_two_proportions(F.lit(0.99), F.lit(0.02)).alias("outside"),
        design.sample_size_means(F.lit(10.0), F.lit(1.0)).alias("means"),
        design.duration_days(F.lit(1000), F.lit(50.0), 0.5).alias("days"),
        design.cuped_variance_factor(F.lit(0.6)).alias("factor"),
        design.sample_size_with_cuped(F.lit(3841), F.lit(0.6)).alias("fewer"),
    ).first()
    assert row.s.n_control == 3841 and row.s.n_total == 7682
    assert row.power == pytest.approx(0.80, abs=1e-3) and row.mde == pytest.approx(0.02, abs=1e-5)
    assert row.unreachable is None and row.outside.n_control is None
    assert row.uneven.n_treatment == 2 * row.uneven.n_control < 2 * 3841
    assert row.means == 1570 and row.days == 40.0
    assert row.factor == pytest.approx(0.64) and row.fewer == 2459
    with pytest.raises(ValueError):
        design.duration_days(F.lit(1), F.lit(1), 0.0)


def test_looks_of_given_statistics(spark):
    """Any metric: only z is needed. The first experiment crosses at its third look, the second never."""
    plan = spark.createDataFrame(
        [(e, [0.25, 0.5, 0.75, 1.0], 0.05, "obrien_fleming") for e in ("up", "flat")],
        "experiment_id string, looks array<double>, alpha double, spending string",
    )
    z = {"up": [1.2, 2.4, 3.1, 3.3], "flat": [0.4, None, -1.1, 0.9]}
    given = spark.createDataFrame([(e, i + 1, v) for e, values in z.items() for i, v in enumerate(values)], "experiment_id string, look int, z double")
    looks = sequential.looks_of_statistics(given, plan)
    got = {e: [r.crossed for r in looks.where(F.col("experiment_id") == e).orderBy("look").collect()] for e in z}
    assert got == {"up": [False, False, True, True], "flat": [False] * 4}
    decided = {r.experiment_id: (r.look, r.crossed, r.stop) for r in sequential.sequential_decision(looks).collect()}
    assert decided == {"up": (3, True, True), "flat": (4, False, True)}


def test_added_spending_functions(spark, monkeypatch):
    monkeypatch.setitem(sequential.SPENDING, "late", lambda t, alpha: alpha * t**4)
    monkeypatch.setitem(sequential.SPENDING, "falling", lambda t, alpha: alpha * (1 - t))
    row = spark.range(1).select(sequential.spent_column("late", F.lit(0.5), F.lit(0.08)).alias("spent")).first()
    assert row.spent == pytest.approx(0.005)
    assert sequential.boundaries((0.5, 1.0), 0.08, "late")[0][1] == pytest.approx(0.005)
    with pytest.raises(ValueError, match="falls"):
        sequential.boundaries((0.3, 0.6), 0.05, "falling")


def test_settings_and_rank_starts_need_no_python_worker(spark):
    """Rows of the driver as a pickled list would be read by a Python worker on every core."""
    from touchtally.operators.ranks import ranked

    plan = config(spark, "e")._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    rows = ranked(spark.range(20).selectExpr("id % 2 AS g", "id"), ["g"], ["id"], few_groups=True)
    # The written rows are an RDD scan of their own; the starts are not.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 2  # in both branches of the join
    assert sorted((r.g, r["rank"], r.id) for r in rows.collect()) == sorted((i % 2, i // 2 + 1, i) for i in range(20))


def test_mean_looks_make_the_plan_once(spark):
    df = spark.createDataFrame(
        [("e", i, "treatment" if i % 2 else "control", None, float(i % 5)) for i in range(40)],
        "experiment_id string, user_id long, variant string, assign_ts timestamp, guardrail_latency_ms double",
    )
    looks = sequential.mean_looks(df, config(spark, "e"), "guardrail_latency_ms")
    assert "_plan_column" not in looks._jdf.queryExecution().optimizedPlan().toString()
    assert looks.count() == 5
