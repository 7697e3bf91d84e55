"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source has a target of words, and each of its documents the expected number of copies target / size of the source. The
whole part is taken for sure; the fraction is rounded by the pivotal method, weighted by the documents' sizes: two
documents with fractions meet and move words from one to the other, in a random direction chosen so that each
document's expectation is kept, until one of the two fractions is 0 or 1. The words that a source takes thus never change but
for the last residual of all. Pairs meet in buckets of about FAN documents; the residual of each bucket goes on to the
next level of a tree, so no task holds a source, however large, and each level has 1/FAN of the rows of the one before.

"Random" numbers are hashes of the ids that meet, so reruns agree.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupscan.llm.common import count_words, files_for, scratch

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its size.
MOST = 3.0
#: Documents that meet in a bucket of the tree, on average.
FAN = 24


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target): one row per source.

    sizes has (source, size). Sources in code point order, null last, weigh as weights says, repeating, and share all words;
    no target is above most times its source's size: the rest is shared by weight among the others until none is above. With w
    the weight and c the cap, a target is min(c, level * w); sources sorted by c / w fill up one after the other, so
    one running sum finds the level. One row per source passes through a single task, the documents don't.
    """
    one = F.lit(1)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    total = F.sum("source_size").over(Window.partitionBy(one))
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (total - full) / rest
    # the level is right at the first source that it doesn't fill up; those before it are at their cap
    fits = F.when(level * F.col("weight") <= F.col("cap"), level)
    per = per.withColumn("level", level).withColumn("fits", fits)
    found = F.first("fits", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.least(F.col("cap"), F.coalesce(found, F.col("level")) * F.col("weight"))
    return per.withColumn("target", target).select("source", "source_size", "n", "target")


def _uniform(*ids: Column | str) -> Column:
    """A number in [0, 1) that depends on the ids alone."""
    return (F.shiftrightunsigned(F.xxhash64(*ids), 11).cast("double")) / F.lit(float(1 << 53))


def _meet(state: Column, x: Column, level: int) -> Column:
    """One pivotal step: state is (done, key, p, w) with the bucket's residual; x is the next (key, p, w)."""
    a, wa, b, wb = state["p"], state["w"], x["p"], x["w"]
    # in words: how far the first can rise or fall while the other falls or rises
    up = F.least((1 - a) * wa, b * wb)
    down = F.least(a * wa, (1 - b) * wb)
    rises = _uniform(F.lit(level), state["key"], x["key"]) * (up + down) < down
    # exact ends, so that no rounding error leaves a fraction where there is none
    first_full, other_empty = (1 - a) * wa <= b * wb, (1 - a) * wa >= b * wb
    first_empty, other_full = a * wa <= (1 - b) * wb, a * wa >= (1 - b) * wb
    new_a = F.when(rises, F.when(first_full, 1.0).otherwise(a + up / wa)).otherwise(F.when(first_empty, 0.0).otherwise(a - down / wa))
    new_b = F.when(rises, F.when(other_empty, 0.0).otherwise(b - up / wb)).otherwise(F.when(other_full, 1.0).otherwise(b + down / wb))
    first_ends = F.when(rises, first_full).otherwise(first_empty)
    ended = F.struct(F.when(first_ends, state["key"]).otherwise(x["key"]).alias("key"), F.when(first_ends, new_a).otherwise(new_b).alias("p"))
    return F.struct(
        F.concat(state["done"], F.array(ended)).alias("done"),
        F.when(first_ends, x["key"]).otherwise(state["key"]).alias("key"),
        F.least(F.greatest(F.when(first_ends, new_b).otherwise(new_a), F.lit(0.0)), F.lit(1.0)).alias("p"),
        F.when(first_ends, wb).otherwise(wa).alias("w"),
    )


def _level(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """Meet within (source, bucket): rows (source, bucket, key, p, w) -> (source, bucket, done, key, p, w).

    In the last level a residual is rounded by itself.
    """
    one = F.struct("key", "p", "w")
    got = rows.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(one)).alias("all"))
    none = F.array().cast("array<struct<key:bigint,p:double>>")
    head = F.element_at("all", 1)
    start = F.struct(none.alias("done"), head["key"].alias("key"), head["p"].alias("p"), head["w"].alias("w"))
    # fold the rest; the residual of the pair goes on
    got = got.select("source", "bucket", F.aggregate(F.slice("all", F.lit(2), F.size("all")), start, lambda s, x: _meet(s, x, level)).alias("s")).select("source", "bucket", "s.*")
    if not last:
        return got
    taken = F.when(_uniform(F.lit(-1), "key") < F.col("p"), 1.0).otherwise(0.0)
    return got.withColumn("done", F.concat("done", F.array(F.struct(F.col("key"), taken.alias("p")))))


def copies(units: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, key, copies): how often each unit of the mix is taken.

    units has (source, key, w): key is unique within a source, w > 0 is the unit's words. An expectation of 0 words gives 0
    copies. The number of levels follows from the largest source, one number that the driver reads.
    """
    t = targets.withColumnRenamed("source", "s")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = units.join(F.broadcast(t) if _few(targets) else t, F.col("source").eqNullSafe(F.col("s"))).select("source", "key", "w", share.alias("share"), F.ceil(F.col("n") / FAN).alias("buckets"))
    rows = rows.withColumn("whole", F.floor("share").cast("int")).withColumn("p", F.col("share") - F.col("whole"))
    whole = rows.select("source", "key", "whole")
    most, docs = targets.agg(F.max("n"), F.sum("n")).first()
    most, docs = most or 1, docs or 0
    levels = max(1, ceil(log(max(most / FAN, 1)) / log(FAN)) + 1)
    now = rows.where("p > 0").select("source", F.pmod(F.xxhash64(F.lit(7), "key"), F.col("buckets")).alias("bucket"), "key", "p", "w")
    done = None
    for i in range(levels):
        last = i == levels - 1
        if last:
            now = now.withColumn("bucket", F.lit(0).cast("long"))
        met = scratch(_level(now, i, last), f"mix{i}", files_for(units.sparkSession, docs // FAN**i))
        part = met.select("source", F.explode("done").alias("d")).select("source", "d.key", F.col("d.p").cast("int").alias("extra"))
        done = part if done is None else done.union(part)
        now = met.where("p > 0 and p < 1").select("source", F.expr(f"bucket div {FAN}").alias("bucket"), "key", "p", "w")
        sure = met.where("not (p > 0 and p < 1)").select("source", "key", F.col("p").cast("int").alias("extra"))
        done = done if last else done.union(sure)
    other = done.select(F.col("source").alias("s"), F.col("key").alias("k"), "extra")
    joined = whole.join(other, (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("source", "key", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))


def _unit_key(*cols: str) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per row of docs: (doc_id, source, size, source_size, target, copies).

    size is the number of words (null and empty texts: 0; such documents are never taken). Rows that agree in id, source
    and size are one unit of the rounding, and each of them gets the unit's copies. A null source is a source of its
    own, last in order. copies is never above most. An empty table gives an empty result.
    """
    rows = scratch(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size")), "sizes")
    targets = scratch(source_targets(rows, weights, most), "targets")
    units = rows.where("size > 0").groupBy("source", _unit_key("doc_id", "size").alias("key")).agg(F.sum("size").cast("double").alias("w"))
    taken = scratch(copies(units, targets), "copies", files_for(docs.sparkSession, rows.count()))
    keyed = rows.withColumn("key", _unit_key("doc_id", "size"))
    left = keyed.join(taken.withColumnRenamed("source", "s").withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "k", "key")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    return left.join(F.broadcast(t) if _few(targets) else t, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"))


def _few(targets: DataFrame, rows: int = 50_000) -> bool:
    """Whether the table of sources, whose rows are counted here, is small enough to be broadcast."""
    return targets.count() <= rows
