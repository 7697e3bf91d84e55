"""Listing of image files: a Spark data source that walks folders, and what follows from the list."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The extensions of image files.
EXTENSIONS = (
    "apng", "bw", "cdf", "cur", "dcx", "dds", "dib", "emf", "eps", "fli", "flc", "fpx", "ftex", "fits", "gd", "gd2", "gif", "gbr", "icb", "icns",
    "iim", "ico", "im", "imt", "j2k", "jfif", "jfi", "jif", "jp2", "jpe", "jpeg", "jpg", "jpm", "jpf", "jpx", "mic", "mpo", "msp", "nc", "pbm", "pcd",
    "pcx", "pgm", "png", "ppm", "psd", "pixar", "ras", "rgb", "rgba", "sgi", "spi", "spider", "sun", "tga", "tif", "tiff", "vda", "vst", "wal",
    "webp", "xbm", "xpm",
)
UNSUPPORTED = "Unsupported file type"
_SCHEMA = "root_no int, root string, path string"


class _Part(InputPartition):
    def __init__(self, number: int, root: str, start: str, deep: bool):
        self.number, self.root, self.start, self.deep = number, root, start, deep


def _visible(name: str) -> bool:
    return not name.startswith(".")


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], recursive: bool):
        self.roots, self.recursive = roots, recursive

    def partitions(self) -> list[_Part]:
        """A part for each root, and in a recursive listing one for each of its folders."""
        parts = []
        for i, root in enumerate(self.roots):
            parts.append(_Part(i, root, root, False))
            if self.recursive and os.path.isdir(root):
                with os.scandir(root) as found:
                    parts += [_Part(i, root, x.path, True) for x in found if x.is_dir() and _visible(x.name)]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        start = partition.start
        if not os.path.isdir(start):
            yield partition.number, partition.root, os.path.normpath(start)
            return
        for folder, folders, files in os.walk(start, followlinks=True):
            folders[:] = sorted(filter(_visible, folders)) if partition.deep else []
            for name in filter(_visible, files):
                yield partition.number, partition.root, os.path.normpath(os.path.join(folder, name))


class ImageListing(DataSource):
    """spark.read.format("image_listing").option("roots", <JSON list>).option("recursive", "true" or "false")

    Files below each root, without dot-files and dot-folders; roots are taken literally, not as patterns, and may be files.
    """

    @classmethod
    def name(cls) -> str:
        return "image_listing"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(json.loads(self.options["roots"]), self.options.get("recursive", "true").lower() == "true")


def list_files(spark: SparkSession, roots: list[str], recursive: bool = True) -> DataFrame:
    """(root_no, root, path), roots numbered in the order given."""
    spark.dataSource.register(ImageListing)
    return spark.read.format("image_listing").option("roots", json.dumps(roots)).option("recursive", str(recursive).lower()).load()


def extension(path: Column) -> Column:
    """What follows the last dot of the whole path, in lower case; all of it if there is none."""
    return F.lower(F.substring_index(path, ".", -1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def numbered(rows: DataFrame, *order: str, name: str = "file_id") -> DataFrame:
    """rows with their position, from 0, in the order of the columns.

    Rows are range-partitioned and sorted; the driver gets one count a partition, so no task sees them all.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).persist()
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    starts, at = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(part, 0)
    offset = F.get(F.array(*map(F.lit, starts)), F.col("_part")) if starts else F.lit(0)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return placed.withColumn(name, (offset + place).cast("long")).drop("_part")


def listing(spark: SparkSession, roots: list[str], recursive: bool = True, in_folder: bool = False, limit_extensions: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): files (file_id, group_id, root, path, ext), skipped (path, reason).

    One list: group_id is 0, and a file below several roots counts once, for the first. in_folder: a group for each root that
    has files. Ids are positions in the order of roots and paths, undecodable files included.
    """
    found = list_files(spark, roots, recursive).persist()  # folders are walked once, so both results are of one moment
    if not in_folder:
        found = found.groupBy("path").agg(F.min(F.struct("root_no", "root")).alias("m")).select("m.root_no", "m.root", "path")
    keep = is_image(F.col("path")) if limit_extensions else F.lit(True)
    files = numbered(found.where(keep), "root_no", "path")
    group = F.lit(0)
    if in_folder:
        filled = sorted(r.root_no for r in files.select("root_no").distinct().collect())  # as many as roots at most
        groups = F.create_map(*[F.lit(x) for i, no in enumerate(filled) for x in (no, i)]) if filled else None
        group = F.lit(0) if groups is None else F.element_at(groups, F.col("root_no"))
    files = files.select("file_id", group.cast("int").alias("group_id"), "root", "path", extension(F.col("path")).alias("ext"))
    skipped = found.where(~keep).select("path", F.lit(UNSUPPORTED).alias("reason")).distinct()
    return files, skipped
