"""Lookups over observations and the transitions between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _edges(transitions: DataFrame, end: str) -> DataFrame:
    grouped = transitions.groupBy(F.col(end).alias("observation_id")).agg(F.count("*").alias("n"), F.min("trans_idx").alias("first_idx"), F.sort_array(F.collect_list(F.struct("trans_idx", "transition_id"))).alias("t"))
    return grouped.select("observation_id", "n", "first_idx", F.col("t.transition_id").alias("transitions"))


def outgoing(transitions: DataFrame) -> DataFrame:
    """(observation_id, n, first_idx, transitions in file order) of every observation that transitions leave."""
    return _edges(transitions, "source_observation_id")


def incoming(transitions: DataFrame) -> DataFrame:
    """The same of every observation that transitions reach."""
    return _edges(transitions, "destination_observation_id")


def outgoing_of(transitions: DataFrame, observation_id: str) -> DataFrame:
    """The transitions that leave one observation, in file order."""
    return transitions.where(F.col("source_observation_id") == observation_id).orderBy("trans_idx")


def incoming_of(transitions: DataFrame, observation_id: str) -> DataFrame:
    """The transitions that reach one observation, in file order."""
    return transitions.where(F.col("destination_observation_id") == observation_id).orderBy("trans_idx")


def group_by(observations: DataFrame, field: str) -> DataFrame:
    """(value, first_idx, observation_ids) by any field; missing is a value; order by first_idx for first-occurrence order."""
    value = F.col(field) if field in observations.columns else F.lit(None).cast("string")
    grouped = observations.groupBy(value.alias("value")).agg(F.min("obs_idx").alias("first_idx"), F.sort_array(F.collect_list(F.struct("obs_idx", "observation_id"))).alias("m"))
    return grouped.select("value", "first_idx", F.col("m.observation_id").alias("observation_ids"))


def restrict(annotations: DataFrame, representatives: DataFrame) -> DataFrame:
    """Annotations of the given observations."""
    return annotations.join(representatives.select("observation_id"), "observation_id", "left_semi")


def zip_strict(a: DataFrame, b: DataFrame, place: str) -> DataFrame:
    """a and b side by side, by place; an error where only one of them has a row."""
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), place, "full")
    paired = F.col("__a") & F.col("__b")
    checked = F.when(F.coalesce(paired, F.lit(False)), F.col(place)).otherwise(F.raise_error(F.lit("Both sides must be equally long")).cast(dict(a.dtypes)[place]))
    return both.withColumn(place, checked).drop("__a", "__b")
