"""Boxes on a tile grid, ragged batches, and losses over tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.plans.ordering import places


def clamp_boxes(boxes: DataFrame) -> DataFrame:
    """boxes (bbox, width, height, ...) with x1, y1, x2, y2 clamped to the image; an error unless a box has four numbers."""
    sound = (F.size("bbox") == 4) & ~F.exists("bbox", lambda x: x.isNull())
    side = lambda k, most: F.greatest(F.lit(0.0), F.least(F.col("bbox")[k].cast("double"), F.col(most).cast("double")))
    checked = boxes.withColumn("bbox", F.when(sound, F.col("bbox")).otherwise(F.raise_error(F.lit("Every bbox needs four numbers")).cast(dict(boxes.dtypes)["bbox"])))
    return checked.select("*", side(0, "width").alias("x1"), side(1, "height").alias("y1"), side(2, "width").alias("x2"), side(3, "height").alias("y2"))


def box_tiles(boxes: DataFrame, tile: int, keys: list[str]) -> DataFrame:
    """(keys, row, col) of the tiles that boxes (keys, x1, y1, x2, y2, width, height) cover, each once.

    A box covers the tiles that lie in it entirely; if there are none, those that it touches. Partial
    tiles at the right and bottom edges of the image don't count.
    """
    up = lambda c: F.ceil(F.col(c) / tile)
    down = lambda c: F.floor(F.col(c) / tile)
    across, along = F.floor(F.col("width") / tile), F.floor(F.col("height") / tile)
    spans = boxes.select(
        *keys,
        *[F.greatest(F.lit(0), up(c)).alias(f"f{c}") for c in ("x1", "y1")], F.least(across, down("x2")).alias("fx2"), F.least(along, down("y2")).alias("fy2"),
        *[F.greatest(F.lit(0), down(c)).alias(f"t{c}") for c in ("x1", "y1")], F.least(across, up("x2")).alias("tx2"), F.least(along, up("y2")).alias("ty2"),
    )
    whole = (F.col("fx1") < F.col("fx2")) & (F.col("fy1") < F.col("fy2"))
    chosen = spans.select(*keys, *[F.when(whole, F.col(f"f{c}")).otherwise(F.col(f"t{c}")).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]).where("x1 < x2 AND y1 < y2")
    rows = chosen.select(*keys, "x1", "x2", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("row"))
    return rows.select(*keys, "row", F.explode(F.sequence("x1", F.col("x2") - 1)).alias("col")).distinct()


def tile_mask(images: DataFrame, covered: DataFrame, tile: int, keys: list[str]) -> DataFrame:
    """(keys, row, col, label) of every whole tile of images (keys, width, height): 1 where covered, else 0."""
    grid = images.select(*keys, F.floor(F.col("width") / tile).cast("int").alias("c"), F.floor(F.col("height") / tile).cast("int").alias("r")).where("c > 0 AND r > 0")
    grid = grid.select(*keys, "c", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("row")).select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("col"))
    marked = covered.select(*keys, "row", "col", F.lit(1).alias("label"))
    return grid.join(marked, [*keys, "row", "col"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def ragged_chunks(samples: DataFrame, length: str, order: str, size: int) -> DataFrame:
    """samples with first_idx (of the group of equal length) and chunk: runs of up to ``size`` samples of one length, in order."""
    if size < 1:
        raise ValueError("sub_batch_size must be positive.")
    firsts = samples.groupBy(F.col(length).alias("__length")).agg(F.min(order).alias("first_idx"))
    placed = places(samples, [length], [order], "__pos", "__n").join(firsts, F.col(length).eqNullSafe(F.col("__length")))
    return placed.withColumn("chunk", F.floor(F.col("__pos") / size).cast("long")).select(*[F.col(f"`{c}`") for c in samples.columns], "first_idx", "chunk")


def bce_term(x: Column, y: Column, weight: float | None = None, pos_weight: float | None = None) -> Column:
    """Binary cross entropy of a logit, stable for large ones."""
    x, y = x.cast("double"), y.cast("double")
    soft = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    raw = (1 - y) * x + (1 + ((pos_weight if pos_weight is not None else 1.0) - 1) * y) * soft
    return raw if weight is None else raw * weight


def sample_losses(cells: DataFrame, sample: str, logit: str, target: str, weight: float | None = None, pos_weight: float | None = None) -> DataFrame:
    """(sample, loss): the mean over a sample's cells."""
    return cells.groupBy(sample).agg(F.avg(bce_term(F.col(logit), F.col(target), weight, pos_weight)).alias("loss"))


def paired_cells(logits: DataFrame, targets: DataFrame, sample: str, cell: str) -> DataFrame:
    """(sample, cell, logit, target) of logits (sample, cell, logit) and targets (sample, cell, target).

    An error unless both have the same samples, and every sample the same cells, each once, on both sides.
    """
    sides = logits.withColumn("__l", F.lit(True)).join(targets.withColumn("__t", F.lit(True)), [sample, cell], "full")
    there = sides.groupBy(sample).agg(F.count("__l").alias("__nl"), F.count("__t").alias("__nt"), F.count("*").alias("__n"))
    # The phrases "same number of samples" and "one row per patch token"
    fault = F.when((F.col("__nl") == 0) | (F.col("__nt") == 0), F.lit("Logits and targets need the same number of samples")).when((F.col("__nl") < F.col("__n")) | (F.col("__nt") < F.col("__n")), F.lit("Targets need one row per patch token"))
    checked = sides.join(there, sample).withColumn("__fault", fault)
    logit = F.when(F.col("__fault").isNull(), F.col("logit")).otherwise(F.raise_error(F.col("__fault")).cast(dict(logits.dtypes)["logit"]))
    return checked.select(sample, cell, logit.alias("logit"), "target")


def batch_loss(cells: DataFrame, sample: str, logit: str, target: str, weight: float | None = None, pos_weight: float | None = None) -> DataFrame:
    """One row: the mean of the samples' means, so that long samples don't weigh more."""
    return sample_losses(cells, sample, logit, target, weight, pos_weight).agg(F.avg("loss").alias("loss"))


def validation_loss(batches: DataFrame) -> DataFrame:
    """One row: batch losses weighted by batch size. batches has (loss, n)."""
    return batches.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def sample_targets(screens: DataFrame, shrink: float, tile: int, keys: list[str]) -> DataFrame:
    """(keys, tile_idx, row, col, clickable, scrollable): the targets of shrunk screens, tiles row by row.

    screens has (keys, width, height, clickable_elements, scrollable_elements), the elements as arrays
    of structs with a bbox; null is none. Boxes are clamped to the screen and shrunk with it.
    """
    size = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * F.lit(float(shrink))).cast("int"))
    shown = screens.select(*keys, size("width").alias("width"), size("height").alias("height"))
    out = None
    for name in ("clickable", "scrollable"):
        boxes = screens.select(*keys, "width", "height", F.explode(f"{name}_elements.bbox").alias("bbox"))
        sides = clamp_boxes(boxes).select(
            *keys, size("width").alias("w"), size("height").alias("h"), *[(F.col(c) * (size(s) / F.col(s))).alias(c) for c, s in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))]
        )
        covered = box_tiles(sides.withColumnsRenamed({"w": "width", "h": "height"}), tile, keys)
        mask = tile_mask(shown, covered, tile, keys).withColumnRenamed("label", name)
        out = mask if out is None else out.join(mask, [*keys, "row", "col"])
    across = shown.select(*keys, F.floor(F.col("width") / tile).cast("int").alias("across"))
    return out.join(across, keys).select(*keys, (F.col("row") * F.col("across") + F.col("col")).alias("tile_idx"), "row", "col", "clickable", "scrollable")
