"""Score cutoffs that keep a target fraction of each source's records, by distributed quickselect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiloom.session import checkpointed, mark, release

#: Distinct values of one source that one block holds on average: the memory of a block's medians is bounded by it.
BLOCK_VALUES = 50_000
#: Halvings that one round makes: the median of a block, those of its halves, and so on.
HALVINGS = 4
#: Parts by which values are first dealt out, before the size of their source is known.
PARTS = 64


def _rank(num: int, den: int, n: Column) -> Column:
    """The least whole number k with k / n >= num / den."""
    return F.floor((n * num + (den - 1)) / F.lit(den)).cast("bigint")


def fraction_cutoffs(df: DataFrame, source: str, value: str, keep: tuple[int, int] = (3, 10), block_values: int = BLOCK_VALUES, halvings: int = HALVINGS) -> DataFrame:
    """For each source the smallest value at or below which at least ``keep`` (a fraction num / den) of its records lie.

    Returns (source, n_total, cutoff, n_kept): n_kept counts the records at or below the cutoff, ties included, so it
    may exceed the target. NULL and NaN values are no records; a NULL source is a source of its own; a source without a
    record gives no row, and so does an empty table. Repeated rows count each. Only the two named columns are read.

    Quickselect over all sources at once. Equal values are first collapsed into one weighted row, and each source's values
    are spread by hash over blocks of about ``block_values`` distinct ones. In each round a block gives its weighted median,
    the medians of its halves, and so on through ``halvings`` levels; for each of these the weighted median over the blocks
    of a source is a pivot. The records between and at the pivots are counted, and all but the stretch that holds the target
    rank are discarded. A source leaves the rounds when that stretch is a single value. Every round drops at least one value
    of every source. No source is decided in any other way, whatever its size.

    What goes by source alone are rows of blocks, pivots and counts, never of values. The state of a round is written to
    the shared folder and that of the round before deleted. The driver sees one emptiness test a round.
    """
    spark = df.sparkSession
    num, den = keep
    weighted = df.select(F.col(source).alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    # h is the key of joins: it tells a NULL source from all others.
    weighted = weighted.withColumn("v", F.col("v") + F.lit(0.0)).groupBy("g", "v").agg(F.count(F.lit(1)).alias("w")).withColumn("h", F.coalesce(F.concat(F.lit("="), F.col("g").cast("string")), F.lit("")))
    weighted = checkpointed(weighted.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")).repartition("h", "part"))
    of_source = Window.partitionBy("h")
    parts = weighted.groupBy("h", "part").agg(F.first("g").alias("g"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("m"))
    parts = checkpointed(parts.withColumn("n", F.sum("w").over(of_source)).withColumn("blocks", F.ceil(F.sum("m").over(of_source) / F.lit(block_values)).cast("int")))
    # Sources yet to be decided: the number of their records, the target rank, and the records below what is open.
    goals = parts.groupBy("h").agg(F.first("g").alias("g"), F.first("n").alias("n")).withColumn("k", _rank(num, den, F.col("n"))).withColumn("below", F.lit(0).cast("bigint"))
    block = F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks")).cast("int")
    start = mark(spark)
    state = checkpointed(weighted.join(parts.select("h", "part", "blocks"), ["h", "part"]).select("h", block.alias("b"), "v", "w").repartition("h", "b"))
    fractions = F.array(*[F.lit(i / 2**halvings) for i in range(1, 2**halvings)])
    done: list[DataFrame] = []
    while True:
        medians = state.groupBy("h", "b").agg(F.percentile("v", fractions, F.col("w")).alias("q"), F.sum("w").alias("bw"))
        each = medians.select("h", "b", "bw", F.posexplode("q").alias("j", "med"))
        alike = Window.partitionBy("h", "j")
        upto = F.sum("bw").over(alike.orderBy("med", "b").rowsBetween(Window.unboundedPreceding, 0))
        each = each.withColumn("upto", upto).withColumn("all", F.sum("bw").over(alike))
        pivots = each.where(F.col("upto") * 2 >= F.col("all")).groupBy("h", "j").agg(F.min("med").alias("p")).groupBy("h").agg(F.array_sort(F.collect_set("p")).alias("p"))
        by_block = medians.select("h", "b").join(pivots, "h")
        # Odd stretches are the pivots themselves, even ones what lies between them.
        stretch = F.size(F.filter("p", lambda x: x < F.col("v"))) * 2 + F.array_contains("p", F.col("v")).cast("int")
        counts = state.join(by_block, ["h", "b"]).groupBy("h", stretch.alias("s")).agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counts = counts.join(goals, "h").withColumn("upto", F.col("below") + F.sum("w").over(of_source.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))
        found = checkpointed(counts.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("w") < F.col("k"))).select("h", "g", "n", "k", (F.col("upto") - F.col("w")).alias("below"), "upto", "lo", "hi"))
        done.append(found.where("lo = hi").select("g", "n", "lo", "upto"))
        goals = found.where("lo < hi")
        if goals.isEmpty():
            break
        bounds = medians.select("h", "b").join(goals.select("h", "lo", "hi"), "h")
        here = mark(spark)
        kept = checkpointed(state.join(bounds, ["h", "b"]).where(F.col("v").between(F.col("lo"), F.col("hi"))).select("h", "b", "v", "w"))
        release(spark, start, start + 1)
        state, start = kept, here
        goals = goals.select("h", "g", "n", "k", "below")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select(F.col("g").alias(source), F.col("n").alias("n_total"), F.col("lo").alias("cutoff"), F.col("upto").alias("n_kept"))
