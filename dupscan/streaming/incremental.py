"""Duplicates among images that keep arriving: each micro-batch is matched with all images before it.

The state is a Parquet table of first images, one row for each distinct key of a bucket, so a batch costs one equi-join with
it and never compares pairs. Batches are numbered by the stream; a batch that is run again after a failure replaces its own
rows and sees only earlier ones, so results are the same as if it had run once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from dupscan.operators import matching

_KEY = ("group_id", "lo", "hi", "key")
_STATE = "group_id int, lo int, hi int, key binary, id_a bigint, batch bigint"


def match_batch(images: DataFrame, batch: int, state: str, turns: tuple[int, ...] = matching.TURNS, same_dim: bool = True) -> DataFrame:
    """(id_a, id_b, mse) of the images of a batch that match an earlier one; adds the batch to the state.

    images has the columns of a build, ids that rise from batch to batch. Earlier images are those of the state's batches
    below this one, and those of the batch with smaller ids.
    """
    spark = images.sparkSession
    keyed = matching.exact_keys(images, turns, same_dim).persist()
    spark.createDataFrame([], _STATE).write.mode("append").partitionBy("batch").parquet(state)
    before = spark.read.schema(_STATE).parquet(state).where(F.col("batch") < batch)
    new = keyed.where("turn = 0").groupBy(*_KEY).agg(F.min("file_id").alias("id_a"))
    firsts = before.select(*_KEY, "id_a").unionByName(new).groupBy(*_KEY).agg(F.min("id_a").alias("id_a"))
    found = keyed.join(firsts, [*_KEY]).where("id_a < file_id")
    owners = found.groupBy(F.col("file_id").alias("id_b")).agg(F.min("id_a").alias("id_a")).select("id_a", "id_b", F.lit(0.0).alias("mse"))
    unseen = new.join(before.select(*_KEY), [*_KEY], "left_anti")
    owners.persist().count()
    unseen.write.mode("overwrite").parquet(f"{state}/batch={batch}")
    return owners


def match_stream(images: DataFrame, state: str, sink: Callable[[DataFrame, int], None], checkpoint: str, turns: tuple[int, ...] = matching.TURNS, same_dim: bool = True) -> DataStreamWriter:
    """A writer, to be started, that hands each batch's matches and number to sink. images: a streaming DataFrame."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(match_batch(rows, number, state, turns, same_dim), number)

    return images.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
