from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from frames import CFG, DAY0, conversions, from_specs, sample, touches, ts
from touchtally.config import RULE_MODELS, AttributionConfig
from touchtally.operators import journeys, rules, slices
from touchtally.plans import marts


def kept(spark, cfg=CFG, data=None):
    return journeys.build_touches(*(data or sample(spark)), cfg)


def weights(spark, cfg=CFG, data=None, user=1):
    rows = rules.touch_weights(journeys.touch_positions(kept(spark, cfg, data), cfg), cfg)
    return [r.asDict() for r in rows.where(F.col("user_id") == user).orderBy("pos_asc").collect()]


def test_sample_counts_and_ages(spark):
    rows = kept(spark).rows()
    counts = journeys.journey_counts(journeys.journeys(kept(spark), CFG)).first()
    assert (counts.journeys, counts.conversions, counts.touches) == (4, 2, 8)
    assert sorted(r.age_days for r in rows.where("user_id = 11").collect()) == [1.0, 1.5, 4.0]
    assert rows.where("user_id in (13, 14) and age_days is not null").count() == 0


def test_sample_weights(spark):
    """Ages 4, 1.5 and 1 day at a half-life of 7: 0.6730, 0.8620 and 0.9057 before they are made to add up to 1."""
    got = {m: [r[f"weight_{m}"] for r in weights(spark, user=11)] for m in RULE_MODELS}
    assert got["first_touch"] == [1, 0, 0] and got["last_touch"] == [0, 0, 1]
    assert got["linear"] == pytest.approx([1 / 3] * 3)
    assert got["position_based"] == pytest.approx([0.4, 0.2, 0.4])
    assert got["time_decay"] == pytest.approx([0.2757, 0.3532, 0.3711], abs=1e-4)
    # A repeated channel holds both ends.
    assert [r["weight_position_based"] for r in weights(spark, user=12)] == [0.5, 0.5]


@pytest.mark.parametrize("n", [1, 2, 4, 11])
def test_position_weights_add_up(spark, n):
    data = (
        touches(spark, [(1, "meta", DAY0 + timedelta(hours=i)) for i in range(n)]),
        conversions(spark, [(1, DAY0 + timedelta(days=1))]),
    )
    got = [r["weight_position_based"] for r in weights(spark, data=data)]
    assert sum(got) == pytest.approx(1.0)
    if n == 2:
        assert got == [0.5, 0.5]


def test_decay_underflow_is_linear(spark):
    data = (
        touches(spark, [(1, "meta", ts("2020-01-01")), (1, "google", ts("2020-01-02"))]),
        conversions(spark, [(1, ts("2026-01-01"))]),
    )
    cfg = replace(CFG, lookback_days=1e6, half_life_days=1e-3)
    assert [r["weight_time_decay"] for r in weights(spark, cfg, data)] == [0.5, 0.5]


def test_touches_outside_the_lookback_or_after_the_purchase_are_dropped(spark):
    bought = ts("2026-03-31 12:00")
    ages = {"referral": 46, "email": 44.9, "meta": 0, "google": -0.5}
    data = (touches(spark, [(5, c, bought - timedelta(days=d)) for c, d in ages.items()]), conversions(spark, [(5, bought)]))
    assert journeys.journey_paths(kept(spark, data=data), CFG).first().path == "email > meta"


def test_fractional_and_calendar_lookback_differ(spark):
    data = (
        touches(spark, [(1, "meta", ts("2026-01-01 00:30:00"))]),
        conversions(spark, [(1, ts("2026-02-15 12:30:00"))]),
    )
    assert kept(spark, data=data).rows().count() == 0
    assert kept(spark, replace(CFG, lookback_mode="calendar"), data).rows().count() == 1


def test_session_time_zone_does_not_matter(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        data = (
            touches(spark, [(1, "meta", ts("2026-03-07 12:00:00"))]),
            conversions(spark, [(1, ts("2026-03-09 12:00:00"))]),
        )
        assert kept(spark, data=data).rows().first().age_days == 2.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_repeat_conversions_anchor_first_and_sum_revenue(spark):
    data = (
        touches(spark, [(1, "meta", ts("2026-06-01")), (1, "email", ts("2026-06-05"))]),
        conversions(spark, [(1, ts("2026-06-03"), 10.0), (1, ts("2026-06-09"), 20.0, True)]),
    )
    row = journeys.journeys(kept(spark, data=data), CFG).first()
    assert (row.touches, row.last_channel, row.revenue, row.is_refunded, row.net_revenue) == (1, "meta", 30.0, True, 0.0)


def test_converter_without_eligible_touch_vanishes(spark):
    data = (touches(spark, [(1, "meta", ts("2026-06-09"))]), conversions(spark, [(1, ts("2026-06-03"))]))
    assert journeys.journeys(kept(spark, data=data), CFG).count() == 0


def test_unplaceable_touches_are_left_out_and_counted(spark):
    frame = touches(spark, [(1, "meta", DAY0), (1, "email", None), (None, "meta", DAY0), (1, "radio", DAY0)])
    row = journeys.touch_quality(frame, CFG.channels).first()
    assert (row.touches, row.without_ts, row.without_user, row.unknown_channel) == (4, 1, 1, 1)
    assert kept(spark, data=(frame, conversions(spark, [(1, DAY0)]))).rows().count() == 2


def test_equal_timestamps_are_ordered_by_touch_id(spark):
    data = (
        touches(spark, [(1, c, DAY0) for c in ("email", "meta", "google")]),
        conversions(spark, [(1, DAY0)]),
    )
    assert journeys.journey_paths(kept(spark, data=data), CFG).first().path == "email > meta > google"


def test_path_summary_ties_and_length(spark):
    rows = [(u, c, DAY0 + timedelta(hours=i)) for u, path in enumerate(["ab", "ab", "c", "b", "b"], 1)
            for i, c in enumerate(path)]
    data = (touches(spark, rows), conversions(spark, [(u, DAY0 + timedelta(days=1)) for u in range(1, 6)]))
    top = journeys.path_summary(kept(spark, data=data), 2).collect()
    assert [(r.path, r.conversions, r.revenue, r.path_length) for r in top] == [
        ("a > b", 2, 192.0, 2), ("b", 2, 192.0, 1),
    ]


def test_repeated_channel_accumulates(spark):
    facts = from_specs(spark, [(("meta", "meta", "google"), True, 1)])
    credit = {r.channel: r.conversions for r in rules.credit_by_channel(facts, CFG, ["linear"]).collect()}
    assert credit["meta"] == pytest.approx(2 / 3) and credit["google"] == pytest.approx(1 / 3)
    assert credit["tiktok"] == credit["email"] == credit["referral"] == 0.0


def test_facts_agree_with_touch_weights(spark):
    positions = journeys.touch_positions(kept(spark), CFG)
    facts = rules.attribution_facts(kept(spark), CFG)
    for model in RULE_MODELS:
        by_touch = {r[0]: r[1] for r in rules.touch_weights(positions, CFG).groupBy("channel").agg(
            F.sum(f"weight_{model}")).collect()}
        by_facts = {r.channel: r.conversions for r in rules.credit_by_channel(facts, CFG, [model]).collect()}
        assert {c: v for c, v in by_facts.items() if v} == pytest.approx({c: v for c, v in by_touch.items() if v})
    assert all(r.conserved for r in rules.conservation(facts).collect())


def test_shares_add_up_and_conservation_is_enforced(spark):
    facts = rules.attribution_facts(kept(spark), CFG)
    credit = rules.credit_by_channel(facts, CFG)
    totals = rules.credit_shares(credit).groupBy("model").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in totals) and len(totals) == 5
    rules.require_conservation(credit, 2).collect()
    with pytest.raises(Exception, match="not conserved"):
        rules.require_conservation(credit, 3).collect()


def test_unknown_channel_and_model_raise(spark):
    data = (touches(spark, [(1, "radio", DAY0)]), conversions(spark, [(1, DAY0)]))
    with pytest.raises(Exception, match="unknown channel: radio"):
        rules.attribution_facts(kept(spark, data=data), CFG).collect()
    with pytest.raises(ValueError, match="unknown rule model"):
        rules.rule_weight("magic", CFG)
    with pytest.raises(ValueError):
        AttributionConfig(lookback_mode="weekly")


# --- hot users ----------------------------------------------------------------------


def _skewed(spark):
    """One user holds most touches, half of them inside two seconds."""
    channels = CFG.channels
    rows = [(7, channels[(i * i) % 5], DAY0 + timedelta(milliseconds=10 * i)) for i in range(200)]
    rows += [(7, channels[(i * 7 + i // 3) % 5], DAY0 + timedelta(hours=5 * i)) for i in range(1, 200)]
    rows += [(u, channels[u % 5], DAY0 + timedelta(hours=u)) for u in range(100, 140) for _ in range(u % 3 + 1)]
    bought = [(7, DAY0 + timedelta(days=40))] + [(u, DAY0 + timedelta(days=30)) for u in range(100, 140, 2)]
    return touches(spark, rows), conversions(spark, bought)


def _snapshot(spark, data, cfg):
    parts = kept(spark, cfg, data)
    facts = rules.attribution_facts(parts, cfg)
    frames = [
        rules.credit_by_channel(facts, cfg).select(
            "model", "channel", *[F.round(c, 6) for c in ("conversions", "revenue", "net_revenue")]),
        facts.groupBy("from_state", "to_state").agg(F.sum("transitions")),
        facts.where("channel_mask is not null").select("channel_mask", "journeys", "conversions"),
        journeys.touch_positions(parts, cfg).select(
            "user_id", "touch_id", "pos_asc", "pos_desc", "touches", F.round("decay_total", 9)),
        journeys.journey_paths(parts, cfg).select(
            "user_id", "path", "touch_count", "distinct_channels", "first_channel", "last_channel",
            "first_touch_ts", "last_touch_ts", "net_revenue"),
        journeys.journeys(parts, cfg).drop("decay_total"),
    ]
    return [sorted(map(str, f.collect())) for f in frames]


def test_sliced_users_give_the_same_results(spark):
    data = _skewed(spark)
    plain = _snapshot(spark, data, replace(CFG, hot_user_rows=None))
    assert _snapshot(spark, data, replace(CFG, hot_user_rows=20)) == plain
    assert _snapshot(spark, data, CFG) == plain


def test_slices_are_small_and_ordered(spark):
    parts = kept(spark, replace(CFG, hot_user_rows=20), _skewed(spark))
    hot = parts.touches.where("slice > 0")
    sizes = hot.groupBy("user_id", "slice").count()
    assert sizes.count() > 15
    assert sizes.agg(F.max("count")).first()[0] <= 20
    place = F.struct("ts", "touch_id")
    bounds = hot.groupBy("slice").agg(F.min(place).alias("a"), F.max(place).alias("b")).orderBy("slice").collect()
    assert all(x.b < y.a for x, y in zip(bounds, bounds[1:]))
    assert {r.user_id for r in hot.select("user_id").distinct().collect()} == {7}
    assert parts.touches.where("slice = 0 and user_id = 7").count() == 0


def test_one_timestamp_is_cut(spark):
    """A user whose touches share one stamp is in several tasks, with the positions of one task."""
    rows = [(7, CFG.channels[(i * i) % 5], DAY0) for i in range(500)] + [(8, "meta", DAY0)]
    data = (touches(spark, rows), conversions(spark, [(7, DAY0 + timedelta(days=1))]))
    cfg = replace(CFG, hot_user_rows=40)
    parts = kept(spark, cfg, data)
    sizes = [r["count"] for r in parts.touches.where("user_id = 7").groupBy("slice").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 40
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = journeys.touch_positions(parts, cfg).where("user_id = 7").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.task for r in placed}) > 1 and sorted(r.pos_asc for r in placed) == list(range(1, 501))
    assert _snapshot(spark, data, cfg) == _snapshot(spark, data, replace(CFG, hot_user_rows=None))


def test_many_cuts_are_found_in_lists(spark):
    """More cuts than one list holds."""
    rows = [(7, "meta", DAY0 + timedelta(seconds=i // 3)) for i in range(1200)]
    cuts = slices.user_cuts(touches(spark, rows), 4)
    assert [len(part) for part in cuts.first()["cuts"]] == [256, 43]
    parts = kept(spark, replace(CFG, hot_user_rows=4), (touches(spark, rows), conversions(spark, [])))
    ordered = parts.touches.orderBy("ts", "touch_id").collect()
    assert all(x.slice <= y.slice for x, y in zip(ordered, ordered[1:]))
    assert {r["count"] for r in parts.touches.groupBy("slice").count().collect()} <= {3, 4, 5}
    assert set(r.slice for r in ordered) <= set(cuts.select(F.explode(slices.slice_numbers())).toPandas()["col"])


def test_repeated_rows_of_a_cut_user(spark):
    log = spark.createDataFrame([(i // 50, 7, "meta" if i < 100 else "email", DAY0) for i in range(200)], touches(spark, [(1, "a", DAY0)]).schema)
    cfg = replace(CFG, hot_user_rows=20)
    rows = journeys.touch_positions(kept(spark, cfg, (log, conversions(spark, []))), cfg)
    assert sorted(r.pos_asc for r in rows.collect()) == list(range(1, 201))


def test_hot_list_is_bounded_by_share_of_all_touches(spark, monkeypatch):
    monkeypatch.setattr(slices, "MAX_HEAVY_USERS", 4)
    rows = [(u, "meta", DAY0) for u in range(10) for _ in range(10)] + [(99, "meta", DAY0)] * 60
    cuts = slices.user_cuts(touches(spark, rows), 5).collect()
    assert [r.user_id for r in cuts] == [99]
    monkeypatch.setattr(slices, "MAX_CUTS", 3)
    assert sum(len(part) for r in slices.user_cuts(touches(spark, rows), 5).collect() for part in r.cuts) <= 3


def test_log_without_hot_users_has_no_cuts(spark):
    assert slices.user_cuts(touches(spark, [(u, "meta", DAY0) for u in range(50)]), 5) is None
    assert slices.user_cuts(touches(spark, []), 5) is None


def scans(df):
    """Reads of files in a plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("parquet")


def test_one_read_of_the_log(spark, tmp_path):
    """Beside the detection, which has run by then, reports read the touch log and the conversions once, cut users or not."""
    for name, frame in zip(("log", "bought"), _skewed(spark)):
        frame.write.parquet(str(tmp_path / name))
    log, bought = (spark.read.parquet(str(tmp_path / n)) for n in ("log", "bought"))
    for rows in (20, 5_000_000):
        cfg = replace(CFG, hot_user_rows=rows)
        facts = rules.attribution_facts(journeys.build_touches(log, bought, cfg), cfg)
        assert scans(rules.credit_shares(rules.credit_by_channel(facts, cfg))) == 2
        assert scans(marts.user_journeys(log, bought, cfg)) == 2


def _long_paths(spark, extra=()):
    steps = [("meta" if k % 3 else "google", DAY0 + timedelta(minutes=k)) for k in range(300)]
    end = DAY0 + timedelta(days=1)
    rows = [(u, channel, ts) for u in (7, 8) for channel, ts in steps]
    rows += [(9, c, t) for c, t in [*steps[:-1], ("email", steps[-1][1])]] + list(extra)
    users = {r[0] for r in rows}
    return steps, touches(spark, rows), conversions(spark, [(u, end) for u in users])


def test_long_equal_paths_are_one_path(spark):
    """With and without slices: two long journeys with the same channels count as one path, one that differs at its end doesn't."""
    steps, log, bought = _long_paths(spark)
    text = " > ".join(c for c, _ in steps)
    for rows in (20, None):
        cfg = replace(CFG, hot_user_rows=rows)
        parts = journeys.build_touches(log, bought, cfg)
        got = [(r.path, r.conversions, r.path_length) for r in journeys.path_summary(parts).collect()]
        other = text[: text.rindex(" ")] + " email"
        assert got == [(text, 2, 300), (other, 1, 300)]
        assert [(r.path, r.conversions, r.mean_touches) for r in marts.top_paths(log, bought, cfg, 1).collect()] == [(text, 2, 300.0)]
    pieces = journeys.path_segments(journeys.build_touches(log, bought, replace(CFG, hot_user_rows=20)))
    ordered = pieces.where("user_id = 7").orderBy("slice").collect()
    assert [c for p in ordered for c in p.channels] == [channel for channel, _ in steps]


def test_path_keys_hold_no_path(spark):
    """Keys are the same in slices and in one piece, and no row is as long as a path."""
    _, log, bought = _long_paths(spark, [(1, "meta", DAY0), (2, None, DAY0), (3, "meta", DAY0), (3, None, DAY0)])
    keys = []
    for rows in (20, 7, None):
        cfg = replace(CFG, hot_user_rows=rows)
        got = journeys.path_keys(journeys.build_touches(log, bought, cfg)).collect()
        assert max(len(r.head) for r in got) <= 11 * journeys.HEAD_CHANNELS
        keys.append({r.user_id: (tuple(r.path_key), r.head) for r in got})
    assert keys[0] == keys[1] == keys[2]
    assert keys[0][7] == keys[0][8] != keys[0][9]
    # A touch without a channel is not in the text.
    assert keys[0][1] == keys[0][3] and keys[0][2][1] == ""


def test_ties_among_long_paths_are_broken_by_whole_texts(spark):
    steps, log, bought = _long_paths(spark)
    cfg = replace(CFG, hot_user_rows=20)
    late = [("tiktok", "b"), ("referral", "c"), ("email", "d")]
    rows = [(20 + k, c, t) for k, (last, _) in enumerate(late) for c, t in [*steps[:-1], (last, steps[-1][1])]]
    log, bought = touches(spark, rows), conversions(spark, [(20 + k, DAY0 + timedelta(days=1)) for k in range(3)])
    got = [r.path.split(" > ")[-1] for r in journeys.path_summary(journeys.build_touches(log, bought, cfg), 2).collect()]
    assert got == ["email", "referral"]


def test_fingerprints_match_plain_arithmetic(spark):
    from touchtally.functions import prints

    rows = spark.createDataFrame([(k,) for k in [0, 1, 63, 64, 4095, 10**6, 2**41 + 12345]], "k long")
    for h in range(prints.HASHES):
        for r in rows.select("k", prints.power(F.col("k"), h).alias("p")).collect():
            assert r.p == pow(prints._BASES[h], r.k, prints.PRIME)
