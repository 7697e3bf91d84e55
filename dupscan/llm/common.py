"""What the operators share: tables, words, the shared folder, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the white space that separates words; everything else is a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: The same six characters, for btrim and translate.
SPACES = " \t\n\x0b\f\r"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Rows of a narrow scratch table that go into one file at least, but for one file or two a core.
FILE_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. If it is unset, one of our own where all run on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="dupscan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """df, written as Parquet into the shared folder and read back: cuts the lineage, survives lost executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dupscan-{label}-{uuid.uuid4().hex}"
    if partitions:
        df = df.coalesce(partitions)
    df.write.parquet(path, compression="zstd")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def files_for(spark: SparkSession, rows: int) -> int:
    """Files of a scratch table of about so many narrow rows: two a core, and more where it is large.

    Without it a table of a few rows has as many files as there are shuffle partitions. On a local disk Hadoop starts a process for
    each file to set its mode, and while it starts, it counts as another copy of the executor.
    """
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a scratch table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def unmeasured_batches(spark: SparkSession) -> Iterator[None]:
    """For what is computed inside: rows go to Python in batches bounded by their number alone.

    Spark measures a batch anew for every row, which for narrow rows costs more than all else; for rows of bounded width
    the number bounds the bytes as well.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str((1 << 31) - 1))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_shuffles(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of jobs that are over, which it does as the driver collects its garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def word_chunks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about size bytes, so that a huge text is never split at once."""
    at, n = 0, len(text)
    while at < n:
        end = at + size
        if end < n:
            m = _SPACE.search(text, end)
            end = m.start() if m else n
        else:
            end = n
        yield text[at:end].split()
        at = end


def words_column(text: Column) -> Column:
    """array<string> of the words of a text, in SQL; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))


def count_words(text: Column) -> Column:
    """Number of words of a text, in SQL: 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_part(key: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def local_components(a, b, nodes: int):
    """Smallest node number of each node's component, for edges a-b over 0..nodes-1 (NumPy)."""
    import numpy as np

    label = np.arange(nodes)
    while len(a):
        low = np.minimum(label[a], label[b])
        high = np.maximum(label[a], label[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another one.

    Alternates large-star and small-star steps until the edges are stars. Every step joins two written tables on the
    node, so adaptive execution can split the rows of a hub over tasks; minima are combined before the shuffle. No
    edge list reaches the driver. Null ends and loops are ignored. rows: about how many edges there can be, if that is known.
    """
    spark = edges.sparkSession
    e = scratch(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges", rows and files_for(spark, rows)
    )
    mark = None
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark, old, files = seen, e, files_for(spark, 2 * seen[0])
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low", files)
        large = scratch(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", files)
        low2 = scratch(large.groupBy("u").agg(F.min("v").alias("m")), "low", files)
        e = scratch(large.join(low2, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v"))).distinct(), "edges", files)
        for x in (old, low, large, low2):
            drop_scratch(x)
    # a root with nothing below it is a node too
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
