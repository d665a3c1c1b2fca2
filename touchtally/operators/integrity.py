"""Checks that an experiment's assignment can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchtally.functions.columns import bucket_hash, derive, guarded_ratio
from touchtally.functions.special import chi_square_quantile, chi_square_sf
from touchtally.operators.assignment import two_way_variant
from touchtally.operators.estimators import welch_test
from touchtally.sources.checkpoints import broadcast_if_small

# Significance of the integrity checks and the largest
# standardised difference that counts as balanced.
INTEGRITY_ALPHA = 0.001
MAX_STANDARDISED_DIFFERENCE = 0.1


def minimum_detectable_loss(critical: Column, arm_size: Column) -> Column:
    """Smallest loss of one arm that the ratio check flags, from its critical value."""
    k = guarded_ratio(critical, arm_size)
    return (-k + F.sqrt(k * k + 8 * k)) / 2


def srm_check(assignments: DataFrame, expected: DataFrame, alpha: float = INTEGRITY_ALPHA) -> DataFrame:
    """Chi-square test of arm sizes against ``expected`` (experiment_id, variant, weight).

    One row per experiment. Arms without any unit count; weights need not add up
    to 1. Only counts are combined: no join on the assignment table.
    """
    counted = assignments.groupBy("experiment_id", "variant").agg(F.count("*").alias("units")).withColumn(
        "weight", F.lit(None).cast("double")
    )
    declared = expected.select("experiment_id", "variant", F.lit(0).cast("long").alias("units"), "weight")
    per_arm = counted.unionByName(declared).groupBy("experiment_id", "variant").agg(
        F.sum("units").alias("units"), F.max("weight").alias("weight")
    )
    whole = Window.partitionBy("experiment_id")
    per_arm = (
        per_arm.withColumn("total", F.sum("units").over(whole))
        .withColumn("share", guarded_ratio(F.col("weight"), F.sum("weight").over(whole)))
        .withColumn("expected_units", F.col("share") * F.col("total"))
        .withColumn("gap", F.col("units") - F.col("expected_units"))
    )
    size = F.round(F.abs("gap"), 9)
    report = per_arm.groupBy("experiment_id").agg(
        F.sum("units").alias("total_units"),
        F.count("*").alias("arms"),
        F.sum(guarded_ratio(F.col("gap") * F.col("gap"), F.col("expected_units"))).alias("chi_square"),
        # The first arm by name among those furthest off.
        F.min_by("variant", F.struct(-size, F.col("variant"))).alias("worst_variant"),
        F.min_by("gap", F.struct(-size, F.col("variant"))).alias("worst_delta_units"),
        F.bool_or(F.col("weight").isNull()).alias("_undeclared"),
        F.bool_or(F.coalesce(F.col("weight") < 0, F.lit(False)) | (F.coalesce(F.col("share"), F.lit(0.0)) <= 0)).alias("_bad_weight"),
    )
    error = (
        F.when(F.col("_undeclared"), "a variant has no expected share")
        .when(F.col("arms") < 2, "needs at least two variants")
        .when(F.col("total_units") == 0, "no units assigned")
        .when(F.col("_bad_weight"), "expected shares must be positive")
    )
    dof = F.when(F.col("error").isNull(), (F.col("arms") - 1).cast("double"))
    report = derive(report.withColumnRenamed("chi_square", "_chi_square"), {
        "error": error,
        "chi_square": F.when(F.col("error").isNull(), F.col("_chi_square")),
        "degrees_of_freedom": F.col("arms") - 1,
        "p_value": chi_square_sf(F.col("chi_square"), dof),
        "critical": chi_square_quantile(F.lit(1.0 - alpha), dof),
        "passed": F.col("p_value") >= alpha,
        "minimum_detectable_loss": minimum_detectable_loss(F.col("critical"), F.col("total_units") / F.col("arms")),
    })
    return report.select(
        "experiment_id", "total_units", "arms", "chi_square", "degrees_of_freedom", "p_value", "passed",
        "worst_variant", "worst_delta_units", "minimum_detectable_loss", "error",
    )


def expected_arms(config: DataFrame) -> DataFrame:
    """(experiment_id, variant, weight) of two-armed experiments."""
    return config.select(
        "experiment_id",
        F.explode(F.array(
            F.struct(F.lit("control").alias("variant"), F.col("control_share").alias("weight")),
            F.struct(F.lit("treatment").alias("variant"), (1 - F.col("control_share")).alias("weight")),
        )).alias("arm"),
    ).select("experiment_id", "arm.*")


def covariate_balance(moments: DataFrame, alpha: float = INTEGRITY_ALPHA) -> DataFrame:
    """Add the standardised difference and Welch p-value of the covariate.

    Columns: balance_control_mean, balance_treatment_mean,
    balance_standardised_difference, balance_p_value, balance_passed,
    balance_error.
    """
    tested = welch_test(
        moments, ("x_n_c", "x_mean_c", "x_var_c"), ("x_n_t", "x_mean_t", "x_var_t"), alpha, "balance_"
    )
    spread = "sqrt((x_var_c + x_var_t) / 2)"
    return derive(tested, {
        "balance_standardised_difference":
            f"IF(balance_error IS NULL, coalesce(try_divide(x_mean_t - x_mean_c, {spread}), 0D), NULL)",
        "balance_passed": f"balance_p_value >= {alpha} AND "
                          f"abs(balance_standardised_difference) < {MAX_STANDARDISED_DIFFERENCE}",
    }).drop(*[f"balance_{c}" for c in (
        "absolute_effect", "relative_effect", "standard_error", "degrees_of_freedom", "statistic",
        "critical", "ci_low", "ci_high", "significant",
    )])


def duplicate_units(assignments: DataFrame) -> DataFrame:
    """Units assigned more than once within an experiment."""
    return (
        assignments.groupBy("experiment_id", "user_id")
        .agg(F.count("*").alias("times"))
        .where(F.col("times") > 1)
    )


def with_rederived_variant(assignments: DataFrame, config: DataFrame) -> DataFrame:
    """Assignments with the variant their hash should have given and ``drifted``."""
    settings = broadcast_if_small(config.select("experiment_id", "salt", "control_share"))
    expected = two_way_variant(bucket_hash(F.col("user_id"), F.col("salt")), F.col("control_share"))
    return assignments.join(settings, "experiment_id").withColumn("expected_variant", expected).withColumn(
        "drifted", ~F.col("variant").eqNullSafe(F.col("expected_variant"))
    )


def assignment_reproducibility(assignments: DataFrame, config: DataFrame) -> DataFrame:
    """Per experiment: how many recorded variants differ from the hash."""
    return with_rederived_variant(assignments, config).groupBy("experiment_id").agg(
        F.count("*").alias("units"),
        F.count_if("drifted").alias("mismatches"),
        F.avg(F.col("drifted").cast("double")).alias("mismatch_rate"),
        F.bool_and(~F.col("drifted")).alias("all_match"),
    )


def mismatched_units(assignments: DataFrame, config: DataFrame) -> DataFrame:
    return with_rederived_variant(assignments, config).where("drifted").select(
        "experiment_id", "user_id", "variant", "expected_variant"
    )
