"""Alpha spending, look plans and interim looks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchtally.functions.special import norm_ppf, norm_sf, normal_quantile, normal_sf
from touchtally.operators.estimators import z_statistic
from touchtally.operators.ranks import ranked
from touchtally.sources.checkpoints import is_small, materialise

# The integration grid on the B-value scale.
_GRID_LIMIT, _GRID_POINTS = 8.0, 2001


def _obrien_fleming(t: float, alpha: float) -> float:
    return 2.0 * norm_sf(norm_ppf(1.0 - alpha / 2.0) / math.sqrt(t))


def _pocock(t: float, alpha: float) -> float:
    return alpha * math.log(1.0 + (math.e - 1.0) * t)


# Alpha spent by information fraction t, for 0 < t < 1.
SPENDING = {"obrien_fleming": _obrien_fleming, "pocock": _pocock, "linear": lambda t, alpha: alpha * t}


def alpha_spent(spending: str, t: float, alpha: float) -> float:
    """Cumulative alpha spent; nothing before the start, all of it at the end."""
    if spending not in SPENDING:
        raise ValueError(f"unknown spending function {spending!r}; known: {sorted(SPENDING)}")
    if t <= 0:
        return 0.0
    return alpha if t >= 1 else SPENDING[spending](t, alpha)


def _spent_by(spending: str):
    """A registered function without a column form, for aggregated rows."""
    rule = SPENDING[spending]

    @F.pandas_udf(T.DoubleType())
    def spent(t: pd.Series, alpha: pd.Series) -> pd.Series:
        return pd.Series([rule(x, level) for x, level in zip(t, alpha)], dtype="float64")

    return spent


def spent_column(spending: str, t: Column, alpha: Column) -> Column:
    """``alpha_spent`` as a column, for any fractions and levels."""
    inside = F.greatest(F.least(t, F.lit(1.0)), F.lit(1e-12))
    forms = {
        "pocock": alpha * F.log(1 + (math.e - 1.0) * inside),
        "linear": alpha * inside,
    }
    if spending == "obrien_fleming":
        spent = 2 * normal_sf(normal_quantile(1 - alpha / 2) / F.sqrt(inside))
    elif spending in forms:
        spent = forms[spending]
    elif spending in SPENDING:
        spent = _spent_by(spending)(inside, alpha)
    else:
        raise ValueError(f"unknown spending function {spending!r}; known: {sorted(SPENDING)}")
    return F.when(t <= 0, F.lit(0.0)).when(t >= 1, alpha).otherwise(spent)


def check_fractions(fractions: Sequence[float], alpha: float) -> None:
    if not len(fractions):
        raise ValueError("at least one look is needed")
    if min(fractions) <= 0 or max(fractions) > 1:
        raise ValueError("information fractions must lie in (0, 1]")
    if any(later <= earlier for earlier, later in zip(fractions, fractions[1:])):
        raise ValueError("information fractions must increase")
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie in (0, 1)")


@lru_cache(maxsize=1024)
def boundaries(fractions: tuple[float, ...], alpha: float, spending: str) -> tuple[tuple[float, float], ...]:
    """(z boundary, cumulative alpha) per look.

    The density of paths still inside all earlier boundaries is carried from
    look to look; each boundary leaves outside just the alpha of its look. Under
    no effect B(t) = z * sqrt(t) has independent normal increments.
    """
    check_fractions(fractions, alpha)
    grid = np.linspace(-_GRID_LIMIT, _GRID_LIMIT, _GRID_POINTS)
    step = grid[1] - grid[0]
    upper = grid[_GRID_POINTS // 2:]
    lags = np.arange(-(_GRID_POINTS - 1), _GRID_POINTS) * step
    density, reached, spent, plan = None, 0.0, 0.0, []
    for t in fractions:
        increment = t - reached
        if density is None:
            density = np.exp(-grid**2 / (2 * increment)) / math.sqrt(2 * math.pi * increment)
        else:
            kernel = np.exp(-lags**2 / (2 * increment)) / math.sqrt(2 * math.pi * increment)
            density = np.convolve(density, kernel, mode="valid") * step
        total = alpha_spent(spending, t, alpha)
        if total < spent - 1e-12:
            raise ValueError(f"spending function {spending!r} falls at fraction {t}")
        # Mass at or beyond each grid point, both sides, from the outside in.
        one_side = density[_GRID_POINTS // 2:]
        beyond = 2 * step * (np.cumsum(one_side[::-1])[::-1] - one_side[-1] / 2)
        low_enough = np.nonzero(beyond <= total - spent)[0]
        first = int(low_enough[0]) if len(low_enough) else len(upper) - 1
        bound = float(upper[max(first - 1, 0)]) if len(low_enough) else _GRID_LIMIT
        density = np.where(np.abs(grid) > bound + step / 2, 0.0, density)
        plan.append((bound / math.sqrt(t), total))
        reached, spent = t, total
    return tuple(plan)


_PLAN = T.ArrayType(T.StructType([
    T.StructField("z_boundary", T.DoubleType()), T.StructField("cumulative_alpha", T.DoubleType()),
]))


@F.pandas_udf(_PLAN)
def _plan_column(looks: pd.Series, alpha: pd.Series, spending: pd.Series) -> pd.Series:
    return pd.Series([
        [{"z_boundary": z, "cumulative_alpha": a} for z, a in boundaries(tuple(map(float, t)), level, name)]
        for t, level, name in zip(looks, alpha, spending)
    ])


def with_plan(config: DataFrame) -> DataFrame:
    """Experiment settings with ``plan``, an array of boundary and spent alpha per look."""
    return config.withColumn("plan", _plan_column("looks", "alpha", "spending"))


def look_plan(config: DataFrame) -> DataFrame:
    """One row per experiment and look."""
    rows = with_plan(config).select(
        "experiment_id", "looks", F.posexplode("plan").alias("at", "entry"), "plan"
    )
    earlier = F.when(F.col("at") > 0, F.get("plan", F.col("at") - 1)["cumulative_alpha"]).otherwise(F.lit(0.0))
    return rows.select(
        "experiment_id", (F.col("at") + 1).alias("look"),
        F.get("looks", F.col("at")).alias("information_fraction"),
        "entry.z_boundary", (2 * normal_sf(F.col("entry.z_boundary"))).alias("nominal_alpha"),
        "entry.cumulative_alpha", (F.col("entry.cumulative_alpha") - earlier).alias("incremental_alpha"),
        (F.col("at") + 1 == F.size("plan")).alias("is_final"),
    )


# Bucket of units without an assignment time: after all days.
_NO_DAY = 2**31 - 1
_ARMS = ("control", "treatment")


def _units(assignments: DataFrame, metric: str) -> DataFrame:
    """Units of both arms in buckets of a day; ``y`` is the metric. Written, so that the assignments are read once."""
    return materialise(assignments.where(F.col("variant").isin(*_ARMS)).select(
        "experiment_id", "user_id", "variant", "assign_ts", F.col(metric).cast("double").alias("y"),
        F.coalesce(F.datediff("assign_ts", F.lit("1970-01-01").cast("date")), F.lit(_NO_DAY)).alias("bucket"),
    ))


def _arm_moments() -> list[Column]:
    """Per arm: units, units with a metric, its sum, mean and squared deviation."""
    out = []
    for arm, suffix in zip(_ARMS, "ct"):
        y = F.when(F.col("variant") == arm, F.col("y"))
        out += [
            F.count_if(F.col("variant") == arm).alias(f"n_{suffix}"), F.count(y).alias(f"k_{suffix}"),
            F.coalesce(F.sum(y), F.lit(0.0)).alias(f"x_{suffix}"), F.coalesce(F.avg(y), F.lit(0.0)).alias(f"m_{suffix}"),
            F.coalesce(F.var_pop(y) * F.count(y), F.lit(0.0)).alias(f"q_{suffix}"),
        ]
    return out


def _about(centre: str) -> list[Column]:
    """Moments as sums about one centre per experiment: these add up, and don't cancel."""
    return [
        column
        for s in "ct"
        for column in (
            F.expr(f"k_{s} * (m_{s} - {centre}) AS d_{s}"),
            F.expr(f"q_{s} + k_{s} * (m_{s} - {centre}) * (m_{s} - {centre}) AS e_{s}"),
        )
    ]


_SUMS = [f"{c}_{s}" for s in "ct" for c in ("n", "k", "x", "d", "e")]


def _histogram(units: DataFrame) -> DataFrame:
    """Units, and sums before the bucket, per experiment and bucket; written, a row per day of an experiment."""
    per_bucket = units.groupBy("experiment_id", "bucket").agg(*_arm_moments())
    whole = Window.partitionBy("experiment_id")
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    centre = F.sum(F.col("x_c") + F.col("x_t")).over(whole) / F.greatest(F.sum(F.col("k_c") + F.col("k_t")).over(whole), F.lit(1))
    shifted = per_bucket.withColumn("centre", centre).select("*", *_about("centre"), (F.col("n_c") + F.col("n_t")).alias("units"))
    return materialise(shifted.select(
        "experiment_id", "bucket", "centre", "units", F.sum("units").over(whole).alias("total"),
        F.coalesce(F.sum("units").over(before), F.lit(0)).alias("earlier"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in _SUMS],
    ))


def _look_targets(histogram: DataFrame, plan: DataFrame) -> DataFrame:
    """Per look: its ``target`` of units, ceil(fraction * total), the bucket it falls in, and ``need``, its rank there."""
    target = F.ceil(F.col("information_fraction").cast("decimal(20,12)") * F.col("total").cast("decimal(19,0)")).cast("long")
    return materialise(
        histogram.join(plan, "experiment_id")
        .withColumn("target", target)
        .where((F.col("target") > F.col("earlier")) & (F.col("target") <= F.col("earlier") + F.col("units")))
        .withColumn("need", F.col("target") - F.col("earlier"))
    )


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _ranked_units(units: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """The units of the buckets that a look falls in, with ``rank`` by (assign_ts, user_id); only these are sorted."""
    split = _small(targets.select("experiment_id", "bucket").distinct(), few)
    near = units.join(split, ["experiment_id", "bucket"], "left_semi")
    return ranked(near, ["experiment_id", "bucket"], ["assign_ts", "user_id", "variant", "y"], few_groups=few)


def _sums_at_looks(assignments: DataFrame, config: DataFrame, metric: str) -> DataFrame:
    """Per look: units and moments of each arm over exactly its target of units.

    Units count in order of (assign_ts, user_id); those without assignment time come last. Whole days come from a
    histogram; of the few days that a look falls in, the units up to the look are added.
    """
    units = _units(assignments, metric)
    plan = materialise(look_plan(config))
    few = is_small(plan)  # what follows per look has no more rows than the plan
    targets = _look_targets(_histogram(units), _small(plan, few))
    near = _small(targets.select("experiment_id", "bucket", "look", "need", "centre"), few)
    inside = _ranked_units(units, targets, few).join(near, ["experiment_id", "bucket"]).where("rank <= need")
    # A unit is here once for each look of its own day.
    part = inside.groupBy("experiment_id", "look").agg(
        *_arm_moments(), F.max("centre").alias("centre"), F.max("assign_ts").alias("reached_at"), F.max("bucket").alias("last")
    )
    part = part.select("experiment_id", "look", "last", "reached_at", *[c for c in _SUMS if c[0] in "nkx"], *_about("centre"))
    more = part.select("experiment_id", "look", *[F.col(c).alias(f"more_{c}") for c in _SUMS], F.when(F.col("last") != _NO_DAY, F.col("reached_at")).alias("reached_at"))
    return targets.join(more, ["experiment_id", "look"]).select(
        *[c for c in targets.columns if c not in _SUMS], "reached_at",
        *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in _SUMS],
    )


def interim_looks(assignments: DataFrame, config: DataFrame) -> DataFrame:
    """z of the conversions at every planned look, against its boundary.

    A look counts exactly ceil(fraction * n) units; ``reached_at`` is the last one's assignment time.
    """
    looks = (
        _sums_at_looks(assignments, config, "primary_metric")
        .withColumn("z", F.expr(z_statistic("x_c", "n_c", "x_t", "n_t")))
        .withColumn("crossed", _crosses())
    )
    return _judged(looks, "reached_at", "n_c", "n_t", F.col("x_c").alias("conversions_c"), F.col("x_t").alias("conversions_t"))


def mean_statistics(assignments: DataFrame, config: DataFrame, metric: str) -> DataFrame:
    """(experiment_id, look, z) of Welch's test on a metric's means at every planned look, with counts, means and variances.

    Units without the metric are counted by the look but not by the test. z is NULL until both arms have two of it and some variance.
    """
    sums = _mean_statistics(_sums_at_looks(assignments, config, metric))
    return sums.select("experiment_id", "look", "target", "reached_at", *[f"{c}_{s}" for s in "ct" for c in ("n", "mean", "var")], "z")


def _mean_statistics(sums: DataFrame) -> DataFrame:
    """``sums`` of looks, with its other columns, and counts, means, variances and z of a metric in place of the sums."""
    moments = sums.select(*[c for c in sums.columns if c not in _SUMS], *[
        F.expr(text)
        for s in "ct"
        for text in (
            f"k_{s} AS n_{s}", f"IF(k_{s} > 0, centre + d_{s} / k_{s}, NULL) AS mean_{s}",
            f"IF(k_{s} > 1, greatest(e_{s} - d_{s} * d_{s} / k_{s}, 0D) / (k_{s} - 1), NULL) AS var_{s}",
        )
    ])
    spread = F.expr("var_c / n_c + var_t / n_t")
    return moments.withColumn("z", F.when(spread > 0, (F.col("mean_t") - F.col("mean_c")) / F.sqrt(spread)))


def mean_looks(assignments: DataFrame, config: DataFrame, metric: str) -> DataFrame:
    """``interim_looks`` for the mean of any metric of the assignments."""
    # The sums carry their look's plan, which is made once.
    looks = _mean_statistics(_sums_at_looks(assignments, config, metric))
    return _judged(looks.withColumn("crossed", _crosses()), "n_c", "n_t", "mean_c", "mean_t")


def _crosses() -> Column:
    """Whether z is at or beyond its boundary; not without z."""
    return F.coalesce(F.abs("z") >= F.col("z_boundary"), F.lit(False))


def looks_of_statistics(statistics: DataFrame, config: DataFrame, *also: str) -> DataFrame:
    """The same for z computed elsewhere: ``statistics`` has experiment_id, look and z, for any metric.

    Looks that the plan does not have are left out; a look without z does not cross. Columns in ``also`` are kept.
    """
    looks = statistics.select("experiment_id", "look", "z", *also).join(look_plan(config), ["experiment_id", "look"])
    return _judged(looks.withColumn("crossed", _crosses()), *also)


def _judged(looks: DataFrame, *columns: Column | str) -> DataFrame:
    return looks.select(
        "experiment_id", "look", "information_fraction", *columns,
        "z", "z_boundary", (2 * normal_sf(F.abs("z"))).alias("nominal_p"), "crossed",
        (F.col("crossed") | F.col("is_final")).alias("stop"),
        F.when(F.col("crossed"), "STOP: boundary crossed")
        .when(F.col("is_final"), "STOP: final look without an effect")
        .otherwise("CONTINUE").alias("reason"),
    )


def sequential_decision(looks: DataFrame) -> DataFrame:
    """The look that decides: the first crossing, else the last look."""
    order = F.struct(~F.col("crossed"), F.when(F.col("crossed"), F.col("look")).otherwise(-F.col("look")))
    fields = ["look", "z", "z_boundary", "nominal_p", "crossed", "stop", "reason"]
    return looks.groupBy("experiment_id").agg(
        F.min_by(F.struct(*fields), order).alias("d")
    ).select("experiment_id", "d.*")


def _look_of_units(units: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Units with the first look that counts them; units after the last look are left out."""
    targets = _look_targets(_histogram(units), _small(plan, few))
    looks = targets.groupBy("experiment_id").agg(F.array_sort(F.collect_list(F.struct("look", "bucket", "need"))).alias("looks"))
    split = _small(targets.select("experiment_id", "bucket").distinct(), few)
    whole = units.join(split, ["experiment_id", "bucket"], "left_anti").withColumn("rank", F.lit(0).cast("long"))
    rows = whole.unionByName(_ranked_units(units, targets, few)).join(_small(looks, few), "experiment_id")
    open_ = F.filter(
        "looks",
        lambda x: (x["bucket"] > F.col("bucket")) | ((x["bucket"] == F.col("bucket")) & (x["need"] >= F.col("rank"))),
    )
    return rows.withColumn("look", F.get(open_, F.lit(0))["look"]).drop("looks", "rank").where("look IS NOT NULL")


# Widest word that a draw takes of a hash.
MAX_WORD_BITS = 16
HASH_BITS = 256


def _redrawn_sums(units: DataFrame, draws: int, bits: int) -> DataFrame:
    """(experiment_id, look, draw, n, x, n_c, x_c): units and metric of a look, and those a draw puts into control.

    ``units`` have ``words``, their hashes one after the other, and ``control_share``. A task cuts the words into draws and adds
    up per experiment and look, so it sends draws x looks rows per experiment, and no unit is ever multiplied.
    """
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            width = len(batch.column("words")[0].as_py()) if batch.num_rows else 0
            raw = np.frombuffer(b"".join(batch.column("words").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)
            cut = np.unpackbits(raw, axis=1)[:, : draws * bits].reshape(batch.num_rows, draws, bits)
            word = cut @ (1 << np.arange(bits)[::-1])
            control = word < (batch.column("control_share").to_numpy(zero_copy_only=False) * 2.0**bits)[:, None]
            y = np.nan_to_num(batch.column("y").to_numpy(zero_copy_only=False).astype(float))
            keys = pd.MultiIndex.from_arrays([batch.column("experiment_id").to_pandas(), batch.column("look").to_pandas()])
            place, groups = pd.factorize(keys)
            for at, group in enumerate(groups):
                rows = place == at
                total = sums.setdefault(group, np.zeros((4, draws)))
                total[0] += rows.sum()
                total[1] += y[rows].sum()
                total[2] += control[rows].sum(axis=0)
                total[3] += y[rows] @ control[rows]
        for (experiment, look), total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([experiment] * draws, pa.string()), pa.array(np.full(draws, look, dtype=np.int32)),
                    pa.array(np.arange(1, draws + 1, dtype=np.int32)), *[pa.array(row) for row in total],
                ],
                ["experiment_id", "look", "draw", "n", "x", "n_c", "x_c"],
            )

    kinds = "experiment_id string, look int, draw int, n double, x double, n_c double, x_c double"
    partial = units.select("experiment_id", "look", "words", "control_share", "y").mapInArrow(add_up, kinds)
    return partial.groupBy("experiment_id", "look", "draw").agg(*[F.sum(c).alias(c) for c in ("n", "x", "n_c", "x_c")])


def aa_audit(assignments: DataFrame, config: DataFrame, draws: int = 256) -> DataFrame:
    """How often re-drawn splits of the same units would stop with no effect.

    A unit's salted 256-bit hash is cut into words, one per draw: below the control share the unit is in control. A share of
    one half takes a word of one bit, so a hash is 256 draws; other shares take up to ``MAX_WORD_BITS``. Looks are at
    exact counts of units. Per experiment: the share of draws that ever cross the fixed critical
    value, and of those that ever cross the planned boundaries.
    """
    share = F.col("control_share")
    fits = [F.when(share * F.lit(2.0**w) == F.floor(share * F.lit(2.0**w)), F.lit(w)) for w in range(1, MAX_WORD_BITS)]
    needed = config.agg(F.max(F.coalesce(*fits, F.lit(MAX_WORD_BITS)))).first()[0]
    bits = 1 << max(int(needed or 1) - 1, 0).bit_length()  # words that divide a hash
    plan = materialise(look_plan(config).join(
        config.select("experiment_id", normal_quantile(1 - F.col("alpha") / 2).alias("fixed")), "experiment_id"
    ))
    few = is_small(plan)  # settings and looks have no more rows than the plan
    units = _look_of_units(_units(assignments, "primary_metric"), plan.drop("fixed"), few)
    units = units.join(_small(config.select("experiment_id", "salt", "control_share"), few), "experiment_id")
    words = [
        F.unhex(F.sha2(F.concat("salt", F.lit(f"#{block}:"), F.col("user_id").cast("string")), 256))
        for block in range(1, -(-draws * bits // HASH_BITS) + 1)
    ]
    sums = _redrawn_sums(units.withColumn("words", F.concat(*words)), draws, bits)
    so_far = Window.partitionBy("experiment_id", "draw").orderBy("look").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = sums.select(
        "experiment_id", "look", "draw", *[F.sum(c).over(so_far).alias(c) for c in ("n_c", "x_c")],
        (F.sum("n").over(so_far) - F.sum("n_c").over(so_far)).alias("n_t"), (F.sum("x").over(so_far) - F.sum("x_c").over(so_far)).alias("x_t"),
    )
    per_draw = (
        counted.join(_small(plan, few), ["experiment_id", "look"])
        .withColumn("z", F.expr(z_statistic("x_c", "n_c", "x_t", "n_t")))
        .groupBy("experiment_id", "draw")
        .agg(
            F.bool_or(F.coalesce(F.abs("z") >= F.col("fixed"), F.lit(False))).alias("peeked"),
            F.bool_or(F.coalesce(F.abs("z") >= F.col("z_boundary"), F.lit(False))).alias("crossed"),
        )
    )
    return per_draw.groupBy("experiment_id").agg(
        F.count("*").alias("draws"),
        F.avg(F.col("peeked").cast("double")).alias("fixed_level_rate"),
        F.avg(F.col("crossed").cast("double")).alias("spending_rate"),
    )
