"""Mixing sources to target weights by entropy balancing (operator 4).

The mix is the set of document rates closest (in relative entropy) to one copy of each document whose
words meet each source's target. Its dual has one variable per source, the rates are
exp(dual * size / mean size of the source), cut at ``most`` copies. The dual is solved by Newton steps
kept inside a bracket; each step is one job over the counts of documents by source and size, never
over texts. Rates become whole copies by systematic rounding, largest documents first, so that the
words taken miss a source's target by less than a document; the place of a document in that order comes from
two levels of counts and a window over a bounded bucket.

Defined results: a null text has size 0; size-0 documents keep one copy and take no words; a null
source is a source of its own, last in order; rows that repeat are mixed each on their own (equal ones
may get different copies, the multiset of results is the same in every run); null doc_ids are kept; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.plans.shared import shared_dir, stored

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of a bucket in which places are counted by a window.
BUCKET_ROWS = 50_000
#: Starting points of the rounding that are tried for each source.
STARTS = 16
TOLERANCE = 1e-7
STEPS = 60
#: Keeps sums that should be whole from falling just below it.
EDGE = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n_docs, target: the total shared out by weight, no target above ``most`` times its source.

    Sources are ranked by how soon they reach their limit; those that reach it stop there and the rest
    share what is left by weight. ``sizes`` has source, size and n (documents of that size).
    """
    by_source = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    rising = Window.orderBy(most * F.col("source_size") / F.col("weight"), "place")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onwards = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(onwards)
    levels = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    shared = levels.withColumn("share", F.min(F.when(F.col("free"), F.struct("place", "level"))).over(everything))
    first = F.min(F.when(F.col("free"), F.struct((most * F.col("source_size") / F.col("weight")).alias("at"), F.col("place").alias("p"), F.col("level").alias("level")))).over(everything)
    return (
        shared.withColumn("share", first["level"])
        .withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("share"), F.lit(0.0)) * F.col("weight")))
        .select("source", "source_size", "n_docs", "least_size", "target")
    )


def _rate(dual, size, mean, most: int):
    return F.exp(F.least(dual * size / mean, F.lit(math.log(most))))


def _exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of its terms, so that each run finds the same dual."""
    return F.sum(value.cast("decimal(32,9)")).cast("double")


def solve_dual(sizes: DataFrame, targets: DataFrame, most: int = MOST, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """``targets`` with the dual of each source (null where every document takes ``most`` copies)."""
    shared_dir(sizes.sparkSession)
    ratio = F.col("target") / F.col("source_size")
    mean = F.col("source_size") / F.col("n_docs")
    least = F.col("least_size") / mean
    bounded = (F.col("source_size") > 0) & (ratio < most * (1 - 1e-9))
    state = targets.select(
        "*",
        F.when(F.col("source_size") > 0, mean).alias("mean"),
        F.when(bounded, F.least(F.log(ratio) / least, F.lit(0.0))).alias("lo"),
        F.when(bounded, F.when(ratio > 1, F.lit(math.log(most)) / least).otherwise(0.0)).alias("hi"),
        F.when(bounded, F.lit(0.0)).alias("dual"),
        F.lit(False).alias("done"),
    ).checkpoint()
    for _ in range(steps):
        at = sizes.join(state.where("dual is not null and not done").select(F.col("source").alias("s"), "mean", "dual"), F.col("source").eqNullSafe(F.col("s")))
        rate = _rate(F.col("dual"), F.col("size"), F.col("mean"), most)
        words = F.col("n") * F.col("size") * rate
        inside = F.col("dual") * F.col("size") / F.col("mean") < math.log(most)
        sums = at.groupBy("s").agg(_exact_sum(words).alias("got"), _exact_sum(F.when(inside, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        near = F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("target")
        low = F.when(F.col("got") < F.col("target"), F.col("dual")).otherwise(F.col("lo"))
        high = F.when(F.col("got") > F.col("target"), F.col("dual")).otherwise(F.col("hi"))
        newton = F.col("dual") + (F.col("target") - F.col("got")) / F.when(F.col("slope") > 0, F.col("slope"))
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumns({"low": low, "high": high, "newton": newton})
        middle = (F.col("low") + F.col("high")) / 2
        inside_bracket = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        open_ = F.col("got").isNotNull() & ~near
        state = moved.select(
            "source", "source_size", "n_docs", "least_size", "target", "mean",
            F.when(open_, F.col("low")).otherwise(F.col("lo")).alias("lo"),
            F.when(open_, F.col("high")).otherwise(F.col("hi")).alias("hi"),
            F.when(open_, F.when(inside_bracket, F.col("newton")).otherwise(middle)).otherwise(F.col("dual")).alias("dual"),
            (F.col("done") | F.coalesce(near, F.lit(False)) | F.coalesce(F.col("high") - F.col("low") <= 1e-13 * F.abs(F.col("high")), F.lit(False))).alias("done"),
        ).checkpoint()
        if state.where("dual is not null and not done").isEmpty():
            break
    return state.select("source", "source_size", "target", "mean", "dual")


def _best_start(classes: DataFrame) -> DataFrame:
    """source, start: where in [0, 1) the rounding begins so that the words taken come nearest the target."""
    end = F.col("before") + F.col("n") * F.col("rate")
    offsets = [(2 * k + 1) / (2 * STARTS) for k in range(STARTS)]
    taken = [F.sum(F.col("size") * (F.floor(end + o + EDGE) - F.floor(F.col("before") + o + EDGE))) for o in offsets]
    misses = [F.struct(F.abs(t - F.first("target")).alias("miss"), F.lit(o).alias("start")) for t, o in zip(taken, offsets)]
    return classes.groupBy("source").agg(F.least(*misses)["start"].alias("start"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, source, source_size, target, rate, copies, taken for every row of ``docs``."""
    own = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), _size("text").alias("size")))
    sizes = stored(own.groupBy("source", "size").agg(F.count("*").alias("n")))
    buckets = max(1, -(-own.count() // bucket_rows))
    duals = solve_dual(sizes, source_targets(sizes, weights, most), most)
    rated = sizes.join(duals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when((F.col("size") == 0), 1.0).when(F.col("dual").isNull(), float(most)).otherwise(_rate(F.col("dual"), F.col("size"), F.col("mean"), most))
    by_size = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    summed = rated.withColumn("rate", rate).withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(by_size), F.lit(0.0)))
    classes = summed.join(_best_start(summed).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("before", F.col("before") + F.col("start")).drop("s", "start")
    bucketed = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    by_bucket = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = bucketed.groupBy("source", "size", "bucket").agg(F.count("*").alias("m")).withColumn("earlier", F.coalesce(F.sum("m").over(by_bucket), F.lit(0)))
    starts = parts.join(classes.withColumnRenamed("source", "s").withColumnRenamed("size", "z"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), "earlier", "before", "rate", "source_size", "target"
    )
    within = Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id")
    placed = bucketed.withColumn("place", F.row_number().over(within)).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")))
    up_to = F.col("before") + (F.col("earlier") + F.col("place")) * F.col("rate")
    up_to_last = F.col("before") + (F.col("earlier") + F.col("place") - 1) * F.col("rate")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.lit(most), F.floor(up_to + EDGE) - F.floor(up_to_last + EDGE))).cast("int")
    return placed.withColumn("copies", copies).select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with every row as many times as the mix takes it (rows it does not take go).

    Rows that agree in doc_id, source and size get their copies by their order among themselves.
    """
    key = F.xxhash64("doc_id", "source", "size").alias("key")
    taken = mix_sources(docs, weights, most).select(key, F.struct("doc_id", "source", "size", "copies").alias("one")).groupBy("key").agg(F.sort_array(F.collect_list("one")).alias("all"))
    sized = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("own"), "doc_id", F.col("source").cast("string").alias("source"), _size("text").alias("size"))
    # The join and the window have the key in common, so texts are moved once; documents of equal keys are told apart by the list.
    met = sized.select("*", key).join(taken, "key")
    same = F.filter("all", lambda x: x["doc_id"].eqNullSafe(F.col("doc_id")) & x["source"].eqNullSafe(F.col("source")) & (x["size"] == F.col("size")))
    among = Window.partitionBy("key", "doc_id", "source", "size").orderBy(F.xxhash64("own.text"))
    placed = met.withColumn("copies", same).withColumn("times", F.get("copies", F.row_number().over(among) - 1)["copies"])
    return placed.where("times > 0").withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).select("own.*")
