import json
from datetime import date

import pytest

from touchtally.config import AttributionConfig
from touchtally.plans import marts
from touchtally.sources import bridge, checkpoints, tables

SF = "/root/testdata/sf0.001"


def test_missing_column_fails_when_planned(spark):
    with pytest.raises(ValueError, match="lacks columns"):
        tables.conform(spark.range(1), "touchpoints")
    with pytest.raises(KeyError):
        tables.conform(spark.range(1), "nothing")


def test_write_replaces_and_reads_back(spark, tmp_path):
    spend = spark.createDataFrame(
        [(date(2026, 1, 1), "meta", "m1", 5.0, 10, 1)],
        "date date, channel string, campaign string, spend double, impressions int, clicks int",
    )
    for _ in range(2):
        tables.write_table(spend, str(tmp_path), "spend", ["channel"])
    back = tables.read_table(spark, str(tmp_path), "spend")
    assert back.count() == 1 and dict(back.dtypes)["impressions"] == "bigint"


def test_load_experiment(spark):
    rows = bridge.experiment_assignment(spark, SF)
    one = tables.load_experiment(rows, "exp_a")
    assert one.count() * 2 == rows.count() and len(one.columns) == 6
    assert tables.require_rows(one, "exp_a") is one
    with pytest.raises(ValueError, match="no rows"):
        tables.require_rows(tables.load_experiment(rows, "exp_z"), "exp_z")


def test_ground_truth_from_json(spark, tmp_path):
    path = tmp_path / "truth.json"
    path.write_text(json.dumps({"channel_importance_true": {"a": 0.75, "b": 0.25}, "seed": 1}, indent=2))
    got = {r.channel: r.true_share for r in tables.load_ground_truth(spark, str(path)).collect()}
    assert got == {"a": 0.75, "b": 0.25}
    with pytest.raises(ValueError):
        tables.load_ground_truth(spark, str(path), "absent")


def test_experiment_settings_are_checked(spark):
    good = {"experiment_id": "e", "salt": "s", "practical_threshold": 0.01}
    assert tables.experiment_config(spark, [good]).first().current_look == 5
    for bad in ({"control_share": 1.2}, {"alpha": 0.0}):
        with pytest.raises(ValueError):
            tables.experiment_config(spark, [{**good, **bad}])


def test_bridge_tables_have_declared_types(spark):
    assert dict(bridge.touchpoints(spark, SF).dtypes)["ts"] == "timestamp_ntz"
    assert dict(bridge.spend(spark, SF).dtypes)["clicks"] == "bigint"
    assert bridge.users(spark, SF).columns == ["user_id", "signup_ts", "platform", "country", "acquisition_cohort"]


def test_marts_are_views_and_can_be_rebuilt(spark):
    cfg = AttributionConfig(channels=bridge.CHANNELS)
    for _ in range(2):
        counts = marts.build_marts(
            spark, bridge.touchpoints(spark, SF), bridge.conversions(spark, SF), bridge.spend(spark, SF),
            bridge.experiment_assignment(spark, SF), cfg,
        ).collect()
    assert {r.mart: r.row_count for r in counts} == {
        "mart_user_journeys": 322, "mart_channel_roi": 4, "mart_experiment_metrics": 4,
    }
    assert spark.table("mart_user_journeys").where("converted").count() == 84
    assert marts.channel_listing(spark.table("mart_channel_roi")).count() == 4


def test_broadcast_only_when_small(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(checkpoints.broadcast_if_small(spark.range(5), 5))
    assert not hinted(checkpoints.broadcast_if_small(spark.range(6), 5))


def test_checkpoint_is_read_back(spark):
    df = checkpoints.materialise(spark.range(10))
    assert df.count() == 10 and spark.sparkContext.getCheckpointDir()
