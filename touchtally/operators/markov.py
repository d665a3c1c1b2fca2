"""Markov removal-effect credit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchtally.config import CONVERSION, NULL_STATE, START
from touchtally.functions.columns import steady_sum


def transition_counts(facts: DataFrame, segment_cols: Sequence[str] = ()) -> DataFrame:
    """Observed transitions over all journeys, absorbed ends included."""
    return facts.groupBy(*segment_cols, "from_state", "to_state").agg(
        F.sum("transitions").alias("transitions")
    )


def transition_matrix(
    facts: DataFrame, channels: Sequence[str], segment_cols: Sequence[str] = ()
) -> DataFrame:
    """Row-stochastic transitions in long form: (from_state, to_state, transitions, probability).

    Zero entries are left out. The two absorbing states return to themselves, and
    a channel nobody visited goes to the null state.
    """
    segments = list(segment_cols)
    counts = transition_counts(facts, segments)
    from_total = F.sum("transitions").over(Window.partitionBy(*segments, "from_state"))
    seen = counts.withColumn("probability", F.col("transitions") / from_total)
    # Per segment at most (channels + 2)**2 entries; adding the fixed ones needs no join.
    entry = ["from_state", "to_state", "transitions", "probability"]
    collected = seen.groupBy(*segments).agg(F.collect_list(F.struct(*entry)).alias("entries"))
    kind = T.ArrayType(T.StructType([
        T.StructField("from_state", T.StringType()), T.StructField("to_state", T.StringType()),
        T.StructField("transitions", T.LongType()), T.StructField("probability", T.DoubleType()),
    ]))

    def fixed(state: str, target: str):
        return F.struct(
            F.lit(state).alias("from_state"), F.lit(target).alias("to_state"),
            F.lit(0).cast("long").alias("transitions"), F.lit(1.0).alias("probability"),
        )

    visited = F.transform("entries", lambda e: e["from_state"])
    unvisited = F.filter(
        F.array(*[fixed(c, NULL_STATE) for c in channels]),
        lambda e: ~F.array_contains(visited, e["from_state"]),
    )
    absorbing = F.array(fixed(CONVERSION, CONVERSION), fixed(NULL_STATE, NULL_STATE))
    whole = F.concat(F.col("entries").cast(kind), unvisited.cast(kind), absorbing.cast(kind))
    return collected.select(*segments, F.explode(whole).alias("entry")).select(*segments, "entry.*")


def absorption_probabilities(
    matrix: DataFrame, channels: Sequence[str], segment_cols: Sequence[str] = ()
) -> DataFrame:
    """P(start reaches conversion) with nothing removed and with each channel removed.

    A removed channel's inbound mass goes to the null state. Every segment is one
    group of at most (channels + 2)**2 entries, so the solve is a small task;
    segments run in parallel. ``removed`` is NULL for the full chain.
    """
    segments = list(segment_cols)
    live = [START, *channels]
    index = {state: i for i, state in enumerate(live)}
    out = T.StructType([
        *[matrix.schema[s] for s in segments],
        T.StructField("removed", T.StringType()), T.StructField("probability", T.DoubleType()),
    ])

    def solve(entries: pd.DataFrame) -> pd.DataFrame:
        among = np.zeros((len(live), len(live)))
        to_conversion = np.zeros(len(live))
        for source, target, p in zip(entries["from_state"], entries["to_state"], entries["probability"]):
            if source not in index:
                continue
            if target in index:
                among[index[source], index[target]] += p
            elif target == CONVERSION:
                to_conversion[index[source]] += p
        results = []
        for removed in [None, *channels]:
            stay = [i for state, i in index.items() if state != removed]
            system = np.eye(len(stay)) - among[np.ix_(stay, stay)]
            try:
                reach = float(np.linalg.solve(system, to_conversion[stay])[0])
            except np.linalg.LinAlgError:
                reach = float("nan")
            results.append((removed, min(max(reach, 0.0), 1.0) if reach == reach else None))
        made = pd.DataFrame(results, columns=["removed", "probability"])
        for position, name in enumerate(segments):
            made.insert(position, name, entries[name].iloc[0])
        return made

    return matrix.groupBy(*segments).applyInPandas(solve, out)


def markov_attribution(
    facts: DataFrame, channels: Sequence[str], segment_cols: Sequence[str] = ()
) -> DataFrame:
    """Removal effect and share per channel.

    A segment without any path to conversion, or where no removal matters, has
    NULL shares and says why in ``reason``; the others are not affected.
    """
    segments = list(segment_cols)
    solved = absorption_probabilities(transition_matrix(facts, channels, segments), channels, segments)
    whole = Window.partitionBy(*segments)
    base = F.max(F.when(F.col("removed").isNull(), F.col("probability"))).over(whole)
    effects = (
        solved.withColumn("base_probability", base)
        .where(F.col("removed").isNotNull())
        .withColumn(
            "removal_effect",
            F.when(
                F.col("base_probability") > 0,
                (F.col("base_probability") - F.col("probability")) / F.col("base_probability"),
            ),
        )
        .withColumn("total_effect", steady_sum(F.col("removal_effect"), whole))
    )
    return effects.select(
        *segments, F.col("removed").alias("channel"), "base_probability",
        F.col("probability").alias("probability_without"), "removal_effect",
        F.when(F.col("total_effect") > 0, F.col("removal_effect") / F.col("total_effect")).alias("share"),
        F.when(F.coalesce(F.col("base_probability"), F.lit(0.0)) <= 0, "no path converts")
        .when(F.col("total_effect") <= 0, "no removal changes the outcome")
        .alias("reason"),
    )
