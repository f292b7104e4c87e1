"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources share epochs x all sizes by weight; one that would exceed max_epochs x its own size stops
there and the rest is shared again by weight (water filling, in closed form). A source's target is then whole
epochs of all its documents, and a fraction: documents in the order of their keys -ln(u)/quality, u a hash of
the id, until the prefix sum would pass what is left; then the one document whose size comes nearest to the
gap, if that brings the sum nearer.

Prefix sums don't meet in one task: a source's n keys are cut into about sqrt(n) buckets, bucket sums are
prefix-summed, and only the bucket that the target falls into is sorted, so neither step sees more than about
sqrt(n) rows in a place (quality weights that differ by orders of magnitude within a source make buckets uneven).
Null sizes count as 0, null or non-positive quality as 1, the null source comes last. Documents of size 0 are
taken in whole epochs only. Repeated rows count each. An empty table gives an empty mix. Extra columns pass
through; one that is named like a column of the result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
EPOCHS, MAX_EPOCHS = 1.5, 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size sums): one row a source, so one task is enough."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(one) - 1) % len(weights)
    cases = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), nth + 1).cast("long")
    rows = sizes.withColumn("w", cases).withColumn("cap", F.col("source_size") * max_epochs)
    # sources fill up in the order of cap / weight; the level stands where the rest can take what is left
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(epochs)) - F.col("full")) / F.col("w_left"))
    fits = F.col("cap") / F.col("w") >= F.col("level")
    rows = rows.withColumn("at", F.max(F.when(fits, F.col("level"))).over(every))
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("at") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the first 13 hex digits of an MD5, so that other engines can repeat it."""
    digits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 52)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix(sized: DataFrame, seed: int = 7, scratch: Scratch | None = None, **shares) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, ...) for sized(id, source, size, quality, ...), one row a row.

    Rows with equal ids have equal keys; among them the size decides, and equal rows are exchangeable. The plan
    (a row a source), bucket sums and decisions are written once each, as several steps read them.
    """
    own = scratch or Scratch(sized.sparkSession, "mix")
    names = ["id", "source", "size", "source_size", "target", "copies", "taken"]
    extra = [c for c in sized.columns if c not in (*names, "quality")]
    quality = F.when(F.col("quality") > 0, F.col("quality")).otherwise(1.0)
    key = -F.log(uniform(F.col("id"), seed)) / F.col("quality")
    rows = sized.select("id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), quality.alias("quality"), F.struct(F.lit(0).alias("_"), *extra).alias("extra"))
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("quality").alias("level"))
    stats = own.save(stats, "sources")
    plan = targets(stats.select("source", "source_size"), **shares).join(stats.select(F.col("source").alias("_of"), "n", "level"), _same("source", "_of"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = own.save(plan.select(F.col("source").alias("_of"), "source_size", "target", "whole", "rest", "level", F.ceil(F.sqrt("n")).alias("buckets")), "plan")

    # 1 - exp(-key x mean quality) grows with the key and spreads keys over (0, 1)
    bucket = F.floor((1 - F.exp(-F.col("key") * F.col("level"))) * F.col("buckets"))
    rows = rows.withColumn("key", key).join(plan.select("_of", "level", "buckets"), _same("source", "_of")).withColumn("bucket", bucket)
    rows = own.save(rows.select("id", "source", "size", "key", "bucket", F.monotonically_increasing_id().alias("row"), "extra"), "keys")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(upto), F.lit(0))).join(plan.select("_of", "rest"), _same("source", "_of"))
    state = F.when(F.col("base") + F.col("sum") <= F.col("rest"), "below").when(F.col("base") > F.col("rest"), "above").otherwise("here")
    sums = own.save(sums.select("_of", F.col("bucket").alias("_bucket"), "base", "rest", state.alias("state")), "sums")

    placed = rows.join(sums, _same("source", "_of") & (F.col("bucket") == F.col("_bucket")))
    line = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    here = placed.where("state = 'here'").withColumn("pick", F.col("base") + F.sum("size").over(line) <= F.col("rest"))
    rest = placed.where("state <> 'here'").withColumn("pick", F.col("state") == "below")
    cut = here.unionByName(rest).select("id", "source", "size", "key", "row", "rest", (F.col("pick") & (F.col("size") > 0)).alias("pick"), "extra")
    cut = own.save(cut, "picks")
    own.drop("keys", "sums", "sources")
    got = cut.groupBy(F.col("source").alias("_of")).agg((F.max("rest") - F.sum(F.when(F.col("pick"), F.col("size")).otherwise(0))).alias("gap"))
    got = own.save(got, "gaps")
    near = F.abs(F.col("gap") - F.col("size"))
    open_ = cut.where("not pick and size > 0").join(got, _same("source", "_of")).where(near < F.col("gap"))
    last = own.save(open_.groupBy("source").agg(F.min(F.struct(near.alias("off"), "key", "id", "row")).alias("last")).select(F.col("last.row").alias("_row")), "last")
    own.drop("gaps")
    done = cut.join(plan.select("_of", "source_size", "target", "whole"), _same("source", "_of")).join(last, F.col("row") == F.col("_row"), "left")
    copies = F.col("whole") + (F.col("pick") | F.col("_row").isNotNull()).cast("long")
    return done.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col("extra")[c].alias(c) for c in extra])
