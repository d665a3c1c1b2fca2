import math
from dataclasses import replace
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import CFG, DAY0, conversions, from_specs, touches
from touchtally.operators import journeys, markov, rules, shapley, value
from touchtally.plans.attribution import AttributionRun

CH = CFG.channels


def shap(spark, specs):
    facts = from_specs(spark, specs)
    values = shapley.coalition_values(facts, CH)
    phi = shapley.shapley_attribution(values, CH)
    return values, phi, {r.channel: (r.phi, r.share) for r in phi.collect()}


LOOP = [(("meta", "email", "meta"), True, 2), (("email",), True, 1), (("meta",), False, 1), (("tiktok", "email"), False, 2)]


def test_markov_with_a_loop_by_hand(spark):
    """meta and email lead to each other and both to the end; meta opens and closes a path.

    From meta the end is reached with m = 2/5 e + 2/5, from email with e = 2/5 m + 1/5: m = 4/7 and e = 3/7. The start
    goes to meta 3, email 1 and tiktok 2 times of 6, so 1/2 converts; 1/10 without meta, 1/5 without email, 5/14 without tiktok.
    """
    rows = {r.channel: r for r in markov.markov_attribution(from_specs(spark, LOOP), CH).collect()}
    assert all(r.base_probability == pytest.approx(1 / 2) for r in rows.values())
    without = {"meta": 1 / 10, "email": 1 / 5, "tiktok": 5 / 14, "google": 1 / 2, "referral": 1 / 2}
    assert {c: r.probability_without for c, r in rows.items()} == pytest.approx(without)
    shares = {"meta": 28 / 59, "email": 21 / 59, "tiktok": 10 / 59, "google": 0, "referral": 0}
    assert {c: r.share for c, r in rows.items()} == pytest.approx(shares)


def test_transition_rows_add_up_with_loops_and_unvisited_states(spark):
    facts = from_specs(spark, [(("meta", "meta", "google"), True, 3), (("google",), False, 2)])
    matrix = markov.transition_matrix(facts, CH)
    sums = {r[0]: r[1] for r in matrix.groupBy("from_state").agg(F.sum("probability")).collect()}
    assert set(sums) == {"(start)", "(conversion)", "(null)", *CH}
    assert all(v == pytest.approx(1.0) for v in sums.values())
    entry = {(r.from_state, r.to_state): r for r in matrix.collect()}
    assert entry["meta", "meta"].transitions == 3
    assert entry["meta", "meta"].probability == pytest.approx(0.5)
    assert entry["email", "(null)"].probability == 1.0
    assert entry["google", "(conversion)"].probability == pytest.approx(0.6)


def test_markov_without_conversions_gives_a_reason(spark):
    facts = from_specs(spark, [(("google",), False, 5)])
    rows = markov.markov_attribution(facts, CH).collect()
    assert len(rows) == 5 and all(r.share is None and r.reason == "no path converts" for r in rows)


def test_shapley_by_hand(spark):
    """Rates 1/4 for google, 1/2 email, 0 referral, 1/2 for google and email, 5/12 google and referral, 1/3 email and referral, 1/2 for all."""
    sets = [(("google",), 4, 1), (("email",), 6, 3), (("email", "google"), 2, 2), (("referral",), 3, 0), (("referral", "google"), 5, 4)]
    specs = [(s, True, c) for s, _, c in sets if c] + [(s, False, n - c) for s, n, c in sets if n > c]
    values, phi, got = shap(spark, specs)
    expected = {"google": 5 / 24, "email": 7 / 24, "referral": 0, "meta": 0, "tiktok": 0}
    assert {c: v for c, (v, _) in got.items()} == pytest.approx(expected)
    assert {c: v for c, (_, v) in got.items()} == pytest.approx({"google": 5 / 12, "email": 7 / 12, "referral": 0, "meta": 0, "tiktok": 0})
    assert shapley.efficiency_residual(phi, values, CH).first().residual < 1e-12


def test_shapley_follows_names(spark):
    """Renaming channels renames the values, also when the new names are in another order."""
    specs = [(("google", "tiktok"), True, 7), (("tiktok",), False, 9), (("referral", "google"), True, 3), (("referral",), False, 2)]
    names = {"google": "referral", "tiktok": "google", "referral": "meta"}
    _, _, got = shap(spark, specs)
    _, _, moved = shap(spark, [(tuple(names[c] for c in path), *rest) for path, *rest in specs])
    assert {names[c]: got[c][0] for c in names} == pytest.approx({names[c]: moved[names[c]][0] for c in names})


def exact_phi(sets, n):
    """Shapley values of the conversion rate game by numpy over all coalitions; sets are {mask: (journeys, conversions)}."""
    support, won = np.zeros(1 << n), np.zeros(1 << n)
    for mask, (journeys, conversions) in sets.items():
        support[mask] += journeys
        won[mask] += conversions
    every = np.arange(1 << n)
    for i in range(n):
        with_i = every[every >> i & 1 == 1]
        support[with_i] += support[with_i ^ (1 << i)]
        won[with_i] += won[with_i ^ (1 << i)]
    value = np.divide(won, support, out=np.zeros(1 << n), where=support > 0)
    size = np.array([bin(c).count("1") for c in range(1 << n)])
    weight = np.array([math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) if k < n else 0 for k in range(n + 1)])
    out = []
    for i in range(n):
        outside = every[every >> i & 1 == 0]
        out.append(float((weight[size[outside]] * (value[outside | 1 << i] - value[outside])).sum()))
    return out


def random_sets(rng, n, k):
    sets = {}
    for _ in range(k):
        mask = sum(1 << int(i) for i in rng.choice(n, rng.integers(1, 5), replace=False))
        journeys = int(rng.integers(1, 40))
        sets[mask] = (journeys, int(rng.integers(0, journeys + 1)))
    return sets


def as_facts(spark, sets, bits, **more):
    """Facts of channel sets, bit i of a mask moved to bits[i]."""
    rows = [(sum(1 << b for i, b in enumerate(bits) if m >> i & 1), n, c, *more.values()) for m, (n, c) in sets.items()]
    return spark.createDataFrame(rows, ", ".join(["channel_mask long, journeys long, conversions long", *[f"{k} string" for k in more]]))


def test_unseen_channels_leave_the_game(spark):
    """Thirty declared channels of which twelve are seen: the exact values, zeros for the others."""
    rng = np.random.default_rng(2)
    sets, bits = random_sets(rng, 12, 60), sorted(rng.choice(30, 12, replace=False).tolist())
    sets[(1 << 12) - 1] = (5, 2)
    names = [f"c{i}" for i in range(30)]
    rows = {r.channel: r for r in shapley.shapley_credit(as_facts(spark, sets, bits), names).collect()}
    expected = dict.fromkeys(names, 0.0) | {f"c{b}": v for b, v in zip(bits, exact_phi(sets, 12))}
    assert {c: r.phi for c, r in rows.items()} == pytest.approx(expected, abs=1e-12)
    assert all(r.standard_error == 0 for r in rows.values()) and sum(r.share for r in rows.values()) == pytest.approx(1)


def test_sampled_values_cover_exact_ones(spark):
    """Twenty-two seen channels, above the limit: intervals of 4 standard errors hold the exact values, and the sum is exact."""
    n = 22
    sets = random_sets(np.random.default_rng(3), n, 150)
    sets[(1 << n) - 1] = (20, 9)
    names = [f"c{i}" for i in range(25)]
    rows = {r.channel: r for r in shapley.shapley_credit(as_facts(spark, sets, range(n)), names).collect()}
    exact = exact_phi(sets, n)
    assert all(rows[f"c{i}"].standard_error > 0 for i in range(n)) and rows["c24"].phi == rows["c24"].standard_error == 0
    assert all(abs(rows[f"c{i}"].phi - exact[i]) <= 4 * rows[f"c{i}"].standard_error for i in range(n))
    total = sum(c for _, c in sets.values()) / sum(j for j, _ in sets.values())
    assert sum(r.phi for r in rows.values()) == pytest.approx(total)


def test_sampling_25_equal_channels_and_segments(spark):
    """Exchangeable channels have equal values; a segment is sampled apart from others."""
    n = 25
    equal = {1 << i: (10, 3) for i in range(n)} | {1 << i | 1 << (i + 1) % n: (4, 3) for i in range(n)}
    one = {1: (5, 5), 1 << 24: (5, 0)}
    facts = as_facts(spark, equal, range(n), seg="a").unionByName(as_facts(spark, one, range(n), seg="b"))
    rows = shapley.shapley_credit(facts.repartition(3), [f"c{i}" for i in range(n)], ["seg"], blocks=40).collect()
    value = (3 * n + 3 * n) / (14 * n)
    a = [r for r in rows if r.seg == "a"]
    assert len(rows) == 2 * n and all(abs(r.phi - value / n) <= 4.5 * r.standard_error + 1e-12 for r in a)
    b = {r.channel: r.phi for r in rows if r.seg == "b"}
    assert b["c0"] == pytest.approx(0.75, abs=0.12) and sum(b.values()) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        shapley.shapley_credit(facts, [f"c{i}" for i in range(64)], ["seg"])


def test_shapley_null_players(spark):
    _, _, got = shap(spark, [(("google",), True, 30), (("meta",), False, 30)])
    for absent in ("tiktok", "email", "referral"):
        assert got[absent][0] == pytest.approx(0.0)
    assert sum(share for _, share in got.values()) == pytest.approx(1.0)


def test_shapley_sees_rate_not_volume(spark):
    specs = [(("meta",), True, 6), (("meta",), False, 24), (("email",), True, 5), (("email",), False, 5),
             (("meta", "email"), True, 8), (("meta", "email"), False, 2)]
    _, _, got = shap(spark, specs)
    assert got["email"][1] > got["meta"][1] and got["email"][1] > 0.5


def test_coalition_values_match_brute_force_over_many_channels(spark):
    """Ten channels need two passes of supersets."""
    names = [f"c{i}" for i in range(10)]
    rows = [((i * 37) % 1023 + 1, i % 7 + 1, i % 3) for i in range(60)]
    facts = spark.createDataFrame(
        [(m, n, min(c, n)) for m, n, c in rows], "channel_mask long, journeys long, conversions long"
    )
    got = {r.coalition: (r.support, r.conversions) for r in shapley.coalition_values(facts, names).collect()}
    assert len(got) == 1024
    for c in range(1024):
        inside = [(n, min(k, n)) for m, n, k in rows if m & ~c == 0]
        assert got[c] == (sum(n for n, _ in inside), sum(k for _, k in inside))
    with pytest.raises(ValueError):
        shapley.coalition_values(facts, [f"c{i}" for i in range(30)])


def test_segments_are_solved_apart(spark):
    a = from_specs(spark, [(("google",), True, 5), (("meta",), False, 5)]).withColumn("seg", F.lit("a"))
    b = from_specs(spark, [(("meta",), True, 5), (("google",), False, 5)]).withColumn("seg", F.lit("b"))
    both = a.unionByName(b)
    shares = {(r.seg, r.channel): r.share for r in markov.markov_attribution(both, CH, ["seg"]).collect()}
    assert shares["a", "google"] == pytest.approx(1.0) and shares["b", "meta"] == pytest.approx(1.0)
    credit = rules.credit_by_channel(both, CFG, ["linear"], ["seg"])
    assert credit.count() == 10 and credit.agg(F.sum("conversions")).first()[0] == pytest.approx(10)
    values = shapley.coalition_values(both, CH, ["seg"])
    assert values.count() == 64
    phi = shapley.shapley_attribution(values, CH, ["seg"])
    residuals = shapley.efficiency_residual(phi, values, CH, ["seg"]).collect()
    assert len(residuals) == 2 and all(r.residual < 1e-12 for r in residuals)


# --- value --------------------------------------------------------------------------


def _spend(spark, monthly, days=30):
    from datetime import date, timedelta

    rows = [(date(2026, 1, 1) + timedelta(days=d), c, "x", m / days, 10, 1) for c, m in monthly.items() for d in range(days)]
    return spark.createDataFrame(
        rows, "date date, channel string, campaign string, spend double, impressions long, clicks long"
    )


MIXED = [(("google", "meta"), True, 10), (("email",), True, 6), (("meta",), False, 20), (("email", "google"), True, 4),
         (("referral",), False, 4)]


def test_channel_spend_uses_the_channels_own_days(spark):
    spend = _spend(spark, {"google": 3000.0}, 30).unionByName(_spend(spark, {"meta": 1000.0}, 15))
    got = {r.channel: r.monthly_spend for r in value.channel_spend(spend, CH).collect()}
    assert got["google"] == pytest.approx(3000.0) and got["meta"] == pytest.approx(2000.0)
    assert got["email"] == 0.0 and len(got) == 5


def test_roi_has_no_infinite_cost_and_equal_totals(spark):
    facts = from_specs(spark, MIXED)
    spend = _spend(spark, {"google": 100.0, "meta": 300.0, "email": 50.0, "referral": 20.0})
    credited = value.credited_value(facts, CFG)
    totals = {r.model: r.c for r in credited.groupBy("model").agg(F.sum("conversions").alias("c")).collect()}
    assert len(totals) == 7 and all(t == pytest.approx(20.0) for t in totals.values())
    roi = value.roi_table(credited, spend, CH)
    rows = {(r.model, r.channel): r for r in roi.collect()}
    assert rows["linear", "referral"].cac is None and rows["linear", "tiktok"].roas is None
    assert rows["linear", "email"].cac == pytest.approx(50.0 / 8.0)
    explicit = value.roi_table(credited, spend, CH, months=2.0).where("model = 'linear' and channel = 'email'").first()
    assert explicit.credited_conversions == pytest.approx(4.0)


def test_empty_spend_fails(spark):
    facts = from_specs(spark, MIXED)
    with pytest.raises(Exception, match="spend is empty"):
        value.roi_table(value.credited_value(facts, CFG, ["linear"]), _spend(spark, {}), CH).collect()
    with pytest.raises(ValueError):
        value.credited_value(facts, CFG, ["magic"])


def test_reallocation_is_budget_neutral_and_capped(spark):
    facts = from_specs(spark, MIXED)
    spend = _spend(spark, {"google": 100.0, "meta": 300.0, "email": 50.0, "referral": 20.0, "tiktok": 70.0})
    roi = value.roi_table(value.credited_value(facts, CFG), spend, CH)
    for shift in (0.0, 0.1, 0.3):
        for model_rows in value.reallocation_plan(roi, shift).groupBy("model").agg(
            F.sum("delta").alias("net"), F.max(F.abs("delta_pct")).alias("most")
        ).collect():
            assert model_rows.net == pytest.approx(0.0, abs=1e-6)
            assert model_rows.most <= shift + 1e-9
    with pytest.raises(ValueError):
        value.reallocation_plan(roi, 1.5)


def test_misallocation_counts_each_dollar_once(spark):
    facts = from_specs(spark, MIXED)
    spend = _spend(spark, {"google": 100.0, "meta": 300.0, "email": 50.0})
    roi = value.roi_table(value.credited_value(facts, CFG, ["first_touch", "last_touch"]), spend, CH)
    rows = value.misallocation(roi, "first_touch", "last_touch").collect()
    moved = sum(r.difference for r in rows if r.difference > 0)
    assert rows[0].total_misallocated == pytest.approx(moved)
    assert sum(r.difference for r in rows) == pytest.approx(0.0, abs=1e-9)


def test_recovery_scores(spark):
    shares = spark.createDataFrame(
        [("last_touch", "a", 0.8), ("last_touch", "b", 0.2), ("linear", "a", 0.6), ("linear", "b", 0.4)],
        "model string, channel string, share double",
    )
    truth = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "channel string, true_share double")
    rows = value.recovery_scores(shares, truth).collect()
    assert [r.model for r in rows] == ["linear", "last_touch"]
    assert rows[0].mae == pytest.approx(0.1) and rows[1].max_abs_error == pytest.approx(0.3)
    assert rows[0].error_reduction_vs_baseline == pytest.approx(2 / 3)


def test_models_without_a_result_have_no_plan_and_rank_last(spark):
    rows = [("a", "google", 10.0, 0.0, 0.0, 0.5, None), ("a", "meta", 10.0, 0.0, 0.0, 0.5, None),
            ("b", "google", 10.0, 1.0, 5.0, 0.5, 0.25), ("b", "meta", 10.0, 3.0, 9.0, 0.5, 0.75)]
    roi = spark.createDataFrame(
        rows, "model string, channel string, monthly_spend double, credited_conversions double, credited_revenue double, "
        "spend_share double, value_share double",
    ).withColumns({"cac": F.lit(None).cast("double"), "roas": F.lit(None).cast("double")})
    plan = value.reallocation_plan(roi)
    for r in plan.collect():
        assert (r.model == "a") == (r.proposed_spend is None) == (r.reason is not None)
    moved = {r.model: r.dollars_moved for r in value.reallocation_summary(plan).collect()}
    assert moved["a"] is None and moved["b"] > 0
    shares = spark.createDataFrame([("a", "google", None), ("b", "google", 0.4)], "model string, channel string, share double")
    truth = spark.createDataFrame([("google", 0.5)], "channel string, true_share double")
    assert [r.model for r in value.recovery_scores(shares, truth, "b").collect()] == ["b", "a"]


def test_added_rules_and_many_channels_reach_the_reports(spark, monkeypatch):
    monkeypatch.setitem(rules.RULES, "all_to_first", lambda cfg: F.expr("DOUBLE(n_first)"))
    cfg = replace(CFG, channels=(*CFG.channels, *[f"c{i}" for i in range(70)]))
    data = (touches(spark, [(1, "c69", DAY0), (1, "meta", DAY0 + timedelta(days=1))]), conversions(spark, [(1, DAY0 + timedelta(days=2))]))
    facts = rules.attribution_facts(journeys.build_touches(*data, cfg), cfg, ["all_to_first", "linear"])
    got = {(r.model, r.channel): r.share for r in value.attribution_shares(facts, cfg, ["all_to_first", "linear"]).where("share > 0").collect()}
    assert got == {("all_to_first", "c69"): 1.0, ("linear", "c69"): 0.5, ("linear", "meta"): 0.5}
    markov = value.attribution_shares(facts, cfg, ["markov"]).where("share > 0").collect()
    assert sum(r.share for r in markov) == pytest.approx(1.0)


def test_credit_that_is_not_conserved_fails_the_report(spark, monkeypatch):
    monkeypatch.setitem(rules.RULES, "half", lambda cfg: F.expr("n / touches / 2"))
    data = (touches(spark, [(1, "meta", DAY0)]), conversions(spark, [(1, DAY0 + timedelta(days=1))]))
    facts = rules.attribution_facts(journeys.build_touches(*data, CFG), CFG, ["half", "linear"])
    assert value.attribution_shares(facts, CFG, ["linear"]).count() > 0
    with pytest.raises(Exception, match="not conserved by half"):
        value.attribution_shares(facts, CFG, ["half"]).collect()


# --- segments ------------------------------------------------------------------------


def _segmented(spark):
    """Two segments with conversions and one without; users of a segment are apart."""
    rows, bought, user = [], [], 0
    for seg, specs in {"x": MIXED, "y": LOOP, "z": [(("meta", "email"), False, 4)], None: [(("google",), True, 2)]}.items():
        for path, converts, copies in specs:
            for _ in range(copies):
                user += 1
                rows += [(user, c, DAY0 + timedelta(days=i), seg) for i, c in enumerate(path)]
                if converts:
                    bought.append((user, DAY0 + timedelta(days=len(path))))
    log = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "touch_id long, user_id long, channel string, ts timestamp_ntz, seg string"
    )
    return log, conversions(spark, bought)


MONTHLY = {"google": 100.0, "meta": 300.0, "email": 50.0, "referral": 20.0, "tiktok": 10.0}


def test_reports_per_segment_equal_runs_of_each(spark):
    log, bought = _segmented(spark)
    run = AttributionRun.start(log, bought, CFG, ["seg"])
    spend = _spend(spark, MONTHLY)
    truth = spark.createDataFrame([(c, 0.2) for c in CH], "channel string, true_share double")

    def reports(r, keep=None):
        frames = {
            "shares": r.shares(), "matrix": r.attribution_matrix(), "value": r.credited_value(), "roi": r.roi(spend), "plan": r.reallocation(spend, "markov"),
            "mis": r.misallocation(spend), "truth": r.recovery(truth),
        }
        # Shapley weights depend on how many channels the other segments have seen, so the last bits may differ.
        def told(row):
            return str([round(x, 9) + 0.0 if isinstance(x, float) else x for x in row])

        return {k: sorted(map(told, (f if keep is None else f.where(keep).drop("seg")).collect())) for k, f in frames.items()}

    for seg in ("y", None):
        here = F.col("seg").eqNullSafe(F.lit(seg))
        alone = reports(AttributionRun.start(log.where(here), bought, CFG))
        assert reports(run, here) == alone


def test_a_segment_without_conversion_says_why(spark):
    log, bought = _segmented(spark)
    run = AttributionRun.start(log, bought, CFG, ["seg"])
    shares = run.shares().where("seg = 'z'").collect()
    assert len(shares) == 35 and all(r.share is None for r in shares)
    assert {r.model: r.reason for r in shares} == dict.fromkeys(rules.RULES, "no journey converts") | {
        "markov": "no path converts", "shapley": "no channel adds value"}
    plan = run.reallocation(_spend(spark, MONTHLY)).where("seg = 'z'").collect()
    assert len(plan) == 5 and all(r.proposed_spend is None and r.reason == "the model gives no value shares" for r in plan)
    assert all(r.reason is None for r in run.shares().where("seg <> 'z'").collect())


def test_spend_of_a_segment(spark):
    """A log with the segment's columns gives each segment its own spend and months; a segment it lacks has no basis."""
    log, bought = _segmented(spark)
    spend = _spend(spark, {"google": 60.0}, 30).withColumn("seg", F.lit("x")).unionByName(
        _spend(spark, {"meta": 40.0, "radio": 1.0}, 15).withColumn("seg", F.lit("y")))
    run = AttributionRun.start(log, bought, CFG, ["seg"])
    rows = {(r.seg, r.channel): r for r in run.roi(spend, ["linear"]).collect()}
    assert rows["x", "google"].monthly_spend == pytest.approx(60) and rows["y", "meta"].monthly_spend == pytest.approx(80)
    assert rows["y", "google"].monthly_spend == 0 and rows["y", "google"].reason is None
    linear = {(r.seg, r.channel): r.conversions for r in run.credited_value(["linear"]).collect()}
    assert rows["y", "email"].credited_conversions == pytest.approx(linear["y", "email"] / 0.5)
    assert rows["z", "meta"].reason == rows[None, "meta"].reason == "no spend in the segment: no monthly basis"
    assert rows[None, "google"].credited_conversions is None


def test_spend_is_read_once(spark, tmp_path):
    facts = from_specs(spark, MIXED)
    _spend(spark, MONTHLY).write.parquet(str(tmp_path / "spend"))
    roi = value.roi_table(value.credited_value(facts, CFG, ["linear"]), spark.read.parquet(str(tmp_path / "spend")), CH)
    plan = roi._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Expand" not in plan


def test_days_before_1970_and_far_apart(spark):
    from datetime import date

    rows = [(date(y, 1, 1), "google", "x", 10.0, 1, 1) for y in (1, 1890, 1969, 1970, 2026, 9999)] + [(None, "google", "x", 40.0, 1, 1), (date(2026, 1, 1), "radio", "x", None, 1, 1)]
    spend = spark.createDataFrame(rows, "date date, channel string, campaign string, spend double, impressions long, clicks long")
    got = {r.channel: r for r in value.spend_basis(spend, CH).collect()}
    assert got["google"].monthly_spend == pytest.approx(100.0 / (6 / 30)) and got["google"].months == pytest.approx(6 / 30)


@pytest.mark.parametrize("partitions", [4, 64])
def test_results_do_not_depend_on_tasks(spark, partitions):
    """Thirds and sevenths, summed in any order, give the same bits."""
    specs = [(tuple(CH[(i + k) % 5] for k in range(i % 7 + 1)), i % 3 > 0, 1) for i in range(60)]
    rows, bought = [], []
    for user, (path, converts, _) in enumerate(specs):
        rows += [(user, c, DAY0 + timedelta(hours=i)) for i, c in enumerate(path)]
        if converts:
            bought.append((user, DAY0 + timedelta(days=1), 0.1 * user + 0.01, user % 5 == 0))
    spend = _spend(spark, MONTHLY)

    def bits(parts):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            run = AttributionRun.start(touches(spark, rows).repartition(parts), conversions(spark, bought).repartition(parts), CFG)
            frames = run.roi(spend.repartition(parts)), run.shares()
            return [sorted(map(repr, f.collect())) for f in frames]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    assert bits(partitions) == bits(1)
