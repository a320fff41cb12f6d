"""Mixing sources to target weights by weighted fair queueing.

Every document waits in the queue of its source, in an order that depends on a digest of its id. Its virtual
finish time is the number of words its source has given up to and including it, divided by the source's target.
All queues run through up to ``max_repeats`` times. The copies of all queues are sorted by finish time in ranges,
and the mix is cut where the words of the whole prefix reach the budget.

A running sum over a source or over the whole mix would put a hot source, or everything, into one task. Both
are sums of two parts instead: the sum of all earlier slices (a small table) and the running sum within a slice.
A slice of a source is a range of digests, a slice of the mix a range of finish times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import stored, word_count

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
# Leading hex digits of the digest that name a slice of a source: 4096 slices.
SLICE_DIGITS = 3
# Slices of the mix for one unit of virtual time. Finish times from 4 on share one slice: there every source
# but one with documents larger than its target has given more than its target, so the cut lies before.
TIME_SLICES = 4096
LAST_TIME = 4


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; 0 for null and blank texts) and the shuffling digest."""
    return documents.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("digest"),
    )


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """The target of every source (source, source_size, target); ``sizes`` has one row per source.

    The budget, all sizes together, is dealt out by weight; no target exceeds ``max_repeats`` times the source's
    size, and what is cut there goes to the others by weight. Sources are ordered by how soon they fill up;
    the first one that does not reach its limit at the level that the fuller ones leave sets the level of all.
    Only this table of one row per source is ordered as a whole.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1
    )
    filling = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    fuller, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything.orderBy(F.lit(1))) - F.coalesce(F.sum("limit").over(fuller), F.lit(0))
    ) / F.sum("weight").over(rest)
    return (
        sizes.select("source", "source_size", (F.col("source_size") * max_repeats).alias("limit"), weight.alias("weight"))
        .withColumn("level", level)
        .withColumn("level", F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level")))
        # The first source, in filling order, that does not fill up at the level that is left for it and the later ones.
        .withColumn("level", F.first("level", ignorenulls=True).over(
            filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select(
            "source", "source_size",
            F.coalesce(
                F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")),
                F.col("limit").cast("double"),
            ).alias("target"),
        )
    )


def finish_time(position: Column, target: Column) -> Column:
    return position.cast("double") / target


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """How often every document enters the mix: doc_id, size, source_size, target, repeats, taken.

    One row per row of ``documents`` (columns doc_id, text, source are read; others are ignored). Null sources
    form one source, ordered last. Null, empty and blank texts have size 0 and are never taken; equal finish times
    are in or out together, so equal rows and reruns agree; without rows the result is empty.
    """
    rows = stored(sized(documents), "mix-sizes").withColumn("slice", F.substring("digest", 1, SLICE_DIGITS))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    goals = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_repeats)
    queue = (
        slices.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
        .withColumnRenamed("source", "queue").withColumnRenamed("slice", "queue_slice")
        .join(goals, F.col("queue").eqNullSafe(F.col("source")))
        .select("queue", "queue_slice", "before", "source_size", "target")
    )
    within = Window.partitionBy("source", "slice").orderBy("digest", "doc_id", "size")
    timed = stored(
        rows.withColumn("running", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(queue, F.col("source").eqNullSafe(F.col("queue")) & (F.col("slice") == F.col("queue_slice")))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("before") + F.col("running")).alias("position")),
        "mix-queues",
    )
    passes = F.transform(
        F.sequence(F.lit(0), F.lit(max_repeats - 1)),
        lambda n: finish_time(n * F.col("source_size") + F.col("position"), F.col("target")),
    )
    copies = (
        timed.filter((F.col("size") > 0) & (F.col("target") > 0))
        .select("size", F.explode(passes).alias("finish"))
        .withColumn("slice", F.floor(F.least(F.col("finish"), F.lit(float(LAST_TIME))) * TIME_SLICES))
    )
    time_slices = stored(
        copies.groupBy("slice").agg(F.sum("size").alias("slice_size")).withColumn(
            "before",
            F.coalesce(F.sum("slice_size").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        ).drop("slice_size"),
        "mix-time",
    )
    budget = slices.agg(F.sum("slice_size")).scalar()
    # The cut lies in the last slice that begins below the budget; later slices need no order.
    cut_slice = time_slices.filter(F.col("before") <= budget).agg(F.max("slice")).scalar()
    # Equal finish times are peers: their sum counts for each of them.
    running = F.sum("size").over(
        Window.partitionBy("slice").orderBy("finish").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cut = (
        copies.filter(F.col("slice") <= cut_slice).withColumn("running", running).join(time_slices, "slice")
        .filter(F.col("before") + F.col("running") <= budget)
        .agg(F.max("finish"))
    )
    last = stored(cut.toDF("cut"), "mix-cut").scalar()
    taken = timed.withColumn("cut", last).withColumn(
        "repeats",
        F.when(
            (F.col("size") > 0) & (F.col("target") > 0),
            F.size(F.filter(passes, lambda t: t <= F.col("cut"))),
        ).otherwise(F.lit(0)),
    )
    return taken.select(
        "doc_id", "source", "size", "source_size", "target", "repeats",
        (F.col("size") * F.col("repeats")).cast("long").alias("taken"),
    )


def repeated(documents: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``documents``.

    Rows that share a doc_id also share the larger number of repeats; rows without a doc_id are left out unless
    their queue takes them (they are one group like any other id).
    """
    counts = (
        mix(documents, weights, max_repeats).filter(F.col("repeats") > 0)
        .groupBy(F.col("doc_id").alias("mixed_id")).agg(F.max("repeats").alias("mixed_repeats"))
    )
    columns = documents.columns
    packed = documents.select(F.col("doc_id").alias("packed_id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("packed"))
    return (
        packed.join(counts, F.col("packed_id").eqNullSafe(F.col("mixed_id")))
        .select("packed", F.explode(F.sequence(F.lit(1), F.col("mixed_repeats"))))
        .select("packed.*")
    )
