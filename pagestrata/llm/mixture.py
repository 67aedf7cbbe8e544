"""Mixing sources to target shares of the total size, with a cap on repetitions.

Capped water-filling: every source is to give its share of a budget; a source that would need more than
its largest number of repetitions is clamped, and what it lacks is spread over the others in proportion to
their shares, until nothing exceeds its cap. Over sources ordered by cap / share this fixed point has a
closed form from running sums. Documents are then taken whole epochs at a time, and the fraction left is
sampled by a seeded hash up to the exact size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.runtime import written

BUCKETS = 4096


def quotas(sizes: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, quota) of each target source.

    sizes: (source, documents, tokens). Without a budget the total is the largest with which every source
    that has documents meets its share exactly. A budget beyond the sum of all caps gives every source its
    cap. Shares are normalised to sum to 1; null or non-positive ones give no quota; a null max_repeats
    counts as 1; a source listed twice has its shares added.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    every = Window.partitionBy(F.lit(0))
    base = wanted.join(sizes, "source", "left").na.fill(0, ["documents", "tokens"])
    base = base.withColumn("cap", (F.col("max_repeats") * F.col("tokens")).cast("double"))
    base = base.withColumn("target_share", F.col("share") / F.nullif(F.sum("share").over(every), F.lit(0.0)))
    live = (F.col("cap") > 0) & (F.col("target_share") > 0)
    base = base.withColumn("weight", F.when(live, F.col("target_share")).otherwise(0.0)).withColumn("room", F.when(live, F.col("cap")).otherwise(0.0))
    base = base.withColumn("ratio", F.when(live, F.col("room") / F.col("weight")))
    total = F.lit(float(budget)) if budget is not None else F.min("ratio").over(every) * F.sum("weight").over(every)
    base = base.withColumn("total", F.least(total, F.sum("room").over(every)))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("ratio").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(F.lit(0)).orderBy(F.col("ratio").asc_nulls_last(), "source").rowsBetween(0, Window.unboundedFollowing)
    base = base.withColumn("level", (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.nullif(F.sum("weight").over(onward), F.lit(0.0)))
    # The level of the first source that is not clamped holds for all after it.
    base = base.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("ratio").asc_nulls_last(), "source")))
    fits = F.col("level") <= F.col("ratio") * (1 + 1e-12)
    base = base.withColumn("level", F.min_by("level", F.when(fits, F.col("place"))).over(every))
    quota = F.when(F.col("level").isNull(), F.col("room")).otherwise(F.least("room", F.col("level") * F.col("weight")))
    return base.select("source", "target_share", "max_repeats", "documents", "tokens", F.coalesce(quota, F.lit(0.0)).alias("quota"))


def _unit(id_column: Column, seed: int) -> Column:
    """A number in 0..1 that depends on the id and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_column), 11) / float(1 << 53)


def mix(documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) for documents (doc_id, source, size) with unique ids.

    copies: (doc_id, source, size, copies) of the documents that are used. shares: one row a target source
    with its sizes and its actual share. Null sizes count as 0; documents with a null source or one without
    a target are not used. Within a source every document is used equally often up to one: the fraction of
    an epoch is cut where the running size in hash order reaches it. That order is resolved per bucket of
    hashes, so no source is ever sorted as a whole.
    """
    sized = documents.where(F.col("source").isNotNull()).select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    sized = sized.withColumn("unit", _unit(F.col("doc_id"), seed)).withColumn("bucket", F.floor(F.col("unit") * BUCKETS).cast("int"))
    by_bucket = written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"), F.count("*").alias("bucket_documents")), "mixture-buckets")
    sizes = by_bucket.groupBy("source").agg(F.sum("bucket_documents").alias("documents"), F.sum("bucket_size").alias("tokens"))
    plan = quotas(sizes, targets, budget)
    epochs = F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens")).otherwise(0.0)
    plan = written(plan.withColumn("whole", F.floor(epochs + 1e-12).cast("int")).withColumn("rest", F.greatest(F.col("quota") - F.col("whole") * F.col("tokens"), F.lit(0.0))), "mixture-plan")
    running = Window.partitionBy("source").orderBy("bucket")
    edges = by_bucket.join(plan.select("source", "whole", "rest"), "source").withColumn("upto", F.sum("bucket_size").over(running))
    edges = edges.select("source", "bucket", "whole", (F.col("upto") <= F.col("rest")).alias("all_in"), (F.col("rest") - (F.col("upto") - F.col("bucket_size"))).alias("left"))
    # At most sources x BUCKETS rows. Nothing bounds the targets table, so whether they are broadcast is left to their size; otherwise a
    # source that holds most documents meets them in BUCKETS parts.
    placed = sized.join(edges, ["source", "bucket"])
    sure = placed.where(F.col("all_in") | (F.col("left") <= 0)).select("doc_id", "source", "size", (F.col("whole") + F.col("all_in").cast("int")).alias("copies"))
    inner = Window.partitionBy("source", "bucket").orderBy("unit", "doc_id")
    edge = placed.where(~F.col("all_in") & (F.col("left") > 0)).withColumn("upto", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.select("doc_id", "source", "size", (F.col("whole") + (F.col("upto") <= F.col("left")).cast("int")).alias("copies"))
    copies = sure.unionByName(edge).where("copies > 0")
    used = copies.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    shares = plan.join(used, "source", "left").na.fill(0, ["mixed_tokens", "most_copies"])
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))
    shares = shares.select(
        "source", "target_share", "max_repeats", "documents", "tokens", "quota", "mixed_tokens", "most_copies",
        F.coalesce(F.col("mixed_tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("actual_share"),
    )
    return copies, shares
