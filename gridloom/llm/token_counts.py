"""Token counts from an exact histogram of encoded lengths.

Documents are encoded once and aggregated by length. Everything else reads the histogram, which has a
row per distinct length however many documents there are: suffix sums over it answer, for every
context limit, how many documents reach it, how many ids a truncated corpus has, and quantiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.llm.bpe import chunks, load_ranks
from gridloom.plans.lineage import cut, ship

#: Lengths of a block; sums go over blocks first, then within each.
BLOCK = 256


@cache
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def with_lengths(df: DataFrame, keep: list[str], text: str, path: str, pattern: str) -> DataFrame:
    """Columns ``keep`` and n_tokens, the number of ids of the whole text; null and empty texts have 0."""
    ship(df.sparkSession)
    keep = [c for c in keep if c.lower() != "n_tokens"]  # the new column replaces it
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = source.drop("__text").withColumn("n_tokens", F.lit(None).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            counts = [sum(len(encode(part)) for part in chunks(value.as_py() or "")) for value in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return source.mapInArrow(run, schema)


def length_histogram(df: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """(n_tokens, n_docs) over all rows, one row per distinct encoded length; an empty table gives none.

    Repeated rows count as often as they occur; documents of one length tie, and are one row. The
    histogram is cut, so that the corpus is encoded once however often it is read.
    """
    return cut(with_lengths(df, [], text, path, pattern).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "length-histogram")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with docs_at_least and tokens_at_least (sums over this length and all longer ones), and what
    truncating every document to this length leaves (truncated_tokens) and cuts (cut_docs, cut_tokens)."""
    rows = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    sums = sums.select("block", F.coalesce(F.sum("d").over(longer), zero).alias("d"), F.coalesce(F.sum("t").over(longer), zero).alias("t"), F.sum("t").over(total).alias("all_tokens"), F.sum("d").over(total).alias("all_docs"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, "block").select(
        "n_tokens", "n_docs", "all_tokens", "all_docs",
        (F.col("d") + F.sum("n_docs").over(within)).alias("docs_at_least"),
        (F.col("t") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(within)).alias("tokens_at_least"),
    )
    shorter = F.col("all_tokens") - F.col("tokens_at_least")
    truncated = shorter + F.col("n_tokens") * F.col("docs_at_least")
    return rows.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", truncated.alias("truncated_tokens"), (F.col("docs_at_least") - F.col("n_docs")).alias("cut_docs"), (F.col("all_tokens") - truncated).alias("cut_tokens"), ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_up_to"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, total_tokens) for any context limits, also such that no document has: from the next longer length's sums."""
    spark = sums.sparkSession
    at = spark.range(1).select(F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit"))
    up = sums.crossJoin(F.broadcast(at)).groupBy("limit").agg(  # a fixed list of limits, not a table
        F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("n_tokens") >= F.col("limit"), F.col("n_tokens"))).alias("up"),
        F.sum(F.col("n_docs") * F.col("n_tokens")).alias("all"),
    )
    return up.select("limit", F.when(F.col("up").isNull(), F.col("all")).otherwise(F.col("all") - F.col("up.tokens_at_least") + F.col("limit") * F.col("up.docs_at_least")).alias("total_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents doesn't exceed."""
    at = sums.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return sums.crossJoin(F.broadcast(at)).where(F.col("share_up_to") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
