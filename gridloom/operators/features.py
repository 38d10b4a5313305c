"""Embeddings of observations built from tiles and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def global_embedding(tokens: DataFrame, special: int) -> DataFrame:
    """(observation_id, global_embedding): the mean token after the first ``special`` ones. tokens has (observation_id, token_idx, vec)."""
    per = tokens.where(F.col("token_idx") >= special).select("observation_id", F.posexplode("vec").alias("k", "x")).groupBy("observation_id", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return _vector(per, "observation_id", "k", "m", "global_embedding")


def _vector(rows: DataFrame, key: str, place: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place, value))).alias("v")).select(key, F.transform("v", lambda s: s[value]).alias(name))


def grounding_embedding(tiles: DataFrame, grids: DataFrame, *, incomplete: bool = False) -> DataFrame:
    """(observation_id, embedding): global, mean, population deviation, the four quadrants' means (empty: 0), mean probabilities.

    tiles has (observation_id, tile_idx, vec, logits), tiles row by row; grids (observation_id, rows, cols,
    global_embedding). An error if tiles don't fill their grid, unless they may be ``incomplete``: then means
    are those of the tiles there are, null in a quadrant without any, and a null global embedding has no place.
    """
    placed = tiles.join(grids.select("observation_id", "rows", "cols"), "observation_id")
    row, col = F.floor(F.col("tile_idx") / F.col("cols")), F.col("tile_idx") % F.col("cols")
    half = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / 2))
    placed = placed.withColumn("q", F.when(row < half("rows"), 0).otherwise(2) + F.when(col < half("cols"), 0).otherwise(1))
    counted = placed.groupBy("observation_id").agg(F.count("*").alias("n"), *[F.avg(1 / (1 + F.exp(-F.col("logits")[c].cast("double")))).alias(f"p{c}") for c in (0, 1)])
    x = F.col("x").cast("double")
    per = placed.select("observation_id", "q", F.posexplode("vec").alias("k", "x")).groupBy("observation_id", "k").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("dev"), *[F.coalesce(F.avg(F.when(F.col("q") == q, x)), F.lit(None if incomplete else 0.0)).alias(f"q{q}") for q in range(4)]
    )
    parts = per.groupBy("observation_id").agg(F.sort_array(F.collect_list(F.struct("k", "mean", "dev", "q0", "q1", "q2", "q3"))).alias("v"))
    parts = parts.join(counted, "observation_id").join(grids, "observation_id")
    whole = F.col("global_embedding").cast("array<double>")
    full = F.concat(F.coalesce(whole, F.array().cast("array<double>")) if incomplete else whole, *[F.col("v").getField(c) for c in ("mean", "dev", "q0", "q1", "q2", "q3")], F.array("p0", "p1"))
    fits = F.col("n") <= F.col("rows") * F.col("cols") if incomplete else F.col("n") == F.col("rows") * F.col("cols")
    return parts.select("observation_id", F.when(fits, full).otherwise(F.raise_error(F.lit("Grounding patch features do not match patch_grid")).cast("array<double>")).alias("embedding"))


def _length(rows: DataFrame, vec: str) -> int:
    """How long the vectors are; they all have one model's length."""
    first = rows.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    return first[0] if first else 0


#: Sums of one aggregate, so that its row stays within what generated code takes.
_SUMS = 90


def _mean_vectors(rows: DataFrame, key: str, vec: str, name: str, length: int) -> DataFrame:
    """(key, name): the mean vector of every key, place by place, in partial aggregates of one row per key."""
    out = None
    for low in range(0, max(1, length), _SUMS):
        places = range(low, min(low + _SUMS, length))
        sums = rows.groupBy(key).agg(F.count("*").alias("__n"), *[F.sum(F.get(vec, F.lit(k)).cast("double")).alias(f"__s{k}") for k in places])
        part = sums.select(key, F.array(*[F.col(f"__s{k}") / F.col("__n") for k in places]).cast("array<double>").alias(f"__p{low}"))
        out = part if out is None else out.join(part, key)
    return out.select(key, F.concat(*[c for c in out.columns if c.startswith("__p")]).alias(name))


def event_types(transitions: DataFrame) -> list[str]:
    """The distinct event types, sorted: a handful of names, which give the histogram its length."""
    return [r[0] for r in transitions.select(F.coalesce("event_type", F.lit("unknown")).alias("t")).distinct().orderBy("t").collect()]


def transition_embedding(base: DataFrame, transitions: DataFrame) -> DataFrame:
    """(observation_id, embedding): base, mean base of destinations (or 0), event histogram, out-degree, effective ratio.

    base has (observation_id, embedding). An error if a destination has no base embedding.
    """
    types = event_types(transitions)
    out = transitions.select(F.col("source_observation_id").alias("observation_id"), F.col("destination_observation_id").alias("dest"), F.coalesce("event_type", F.lit("unknown")).alias("t"), F.coalesce("effective", F.lit(False)).alias("e"))
    stats = out.groupBy("observation_id").agg(F.count("*").alias("degree"), F.avg(F.col("e").cast("int")).alias("effective"), *[(F.count_if(F.col("t") == t) / F.count("*")).alias(f"t{k}") for k, t in enumerate(types)])
    known = out.join(base.select(F.col("observation_id").alias("dest"), F.col("embedding").alias("v")), "dest", "left")
    v = F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("No base embedding of "), "dest")).cast(dict(base.dtypes)["embedding"])).otherwise(F.col("v"))
    means = _mean_vectors(known.select("observation_id", v.alias("v")), "observation_id", "v", "near", _length(base, "embedding"))
    rows = base.join(means, "observation_id", "left").join(stats, "observation_id", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    full = F.concat(F.col("embedding").cast("array<double>"), F.coalesce("near", F.transform("embedding", lambda x: F.lit(0.0))), F.array(*[zero(f"t{k}") for k in range(len(types))], zero("degree"), zero("effective")))
    return rows.select("observation_id", full.alias("embedding"))


def check_divisible(images: DataFrame, patch: int) -> DataFrame:
    """images (h, w); an error where a side isn't a multiple of the patch size."""
    fits = (F.col("h") % patch == 0) & (F.col("w") % patch == 0)
    return images.withColumn("h", F.when(fits, F.col("h")).otherwise(F.raise_error(F.concat(F.lit("Image size must be divisible by the patch size: "), F.col("h").cast("string"), F.lit("x"), F.col("w").cast("string"))).cast("int")))
