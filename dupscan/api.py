"""build() and search(): an image collection as DataFrames, and what matches in it."""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import dataclass, field
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscan import actions
from dupscan.operators import grouping, matching, stats
from dupscan.params import BuildParams, SearchParams
from dupscan.sources import decode, listing


def _progress(show: bool, done: int, of: int, task: str) -> None:
    if show:
        print(f"dupscan {task}: {done / of:.0%}", end="\n" if done == of else "\r", flush=True)


@dataclass
class ImageRepo:
    """images: one row a listed image file, with its tensor or decode_error; invalid: (path, reason) of all others."""

    spark: SparkSession
    images: DataFrame
    invalid: DataFrame
    stats: dict
    in_folder: bool = False

    def save(self, path: str) -> None:
        """Write the collection as Parquet; searches can start from load()."""
        self.images.write.mode("overwrite").parquet(f"{path}/images")
        self.invalid.write.mode("overwrite").parquet(f"{path}/invalid")
        meta = [(json.dumps({"stats": self.stats, "in_folder": self.in_folder}),)]
        self.spark.createDataFrame(meta, "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ImageRepo:
        meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/meta").collect()))
        return cls(spark, spark.read.parquet(f"{path}/images"), spark.read.parquet(f"{path}/invalid"), meta["stats"], meta["in_folder"])


def with_dim_key(images: DataFrame) -> DataFrame:
    """images with dim_key, the dimensions in either order."""
    return images.withColumn("dim_key", F.struct(F.least("width", "height").alias("lo"), F.greatest("width", "height").alias("hi")))


def build(spark: SparkSession, *directory, recursive=True, in_folder=False, limit_extensions=True, px_size=50, show_progress=True, processes=os.cpu_count(), logs=True, **other) -> ImageRepo:
    """List the image files below the directories and decode them to px_size x px_size tensors.

    directory: strings, or lists of strings, of folders or files. recursive: look into subfolders. in_folder: a group for each
    directory, within which searches stay. limit_extensions: leave out files without an image extension. processes:
    a hint for the number of partitions. Files that can't be decoded have their reason in invalid, and with logs in the statistics
    too, which the driver holds: without, these have their number alone.
    """
    params = BuildParams.of(directory, recursive, in_folder, limit_extensions, px_size, show_progress, processes, other)
    if not params.limit_extensions:
        warnings.warn("without limit_extensions, formats that are not known to be images may be listed, decoded and matched wrongly", stacklevel=2)
    start = datetime.now()
    _progress(show_progress, 0, 3, "build")
    files, skipped = listing.listing(spark, params.directory, params.recursive, params.in_folder, params.limit_extensions)
    files = files.repartition(max(params.processes, spark.sparkContext.defaultParallelism), "file_id")
    _progress(show_progress, 1, 3, "build")
    by_jvm = F.lit(decode.Image is None) & F.col("ext").isin(*decode.JVM_EXTENSIONS)
    images = decode.decode_files(files.where(~by_jvm), params.px_size)
    if decode.Image is None and not files.where(by_jvm).isEmpty():
        images = images.unionByName(decode.decode_in_jvm(spark, files.where(by_jvm), params.directory, params.px_size, params.recursive))
    images = with_dim_key(images).persist()
    failed = images.where("tensor is null").select("path", F.col("decode_error").alias("reason"))
    invalid = failed.unionByName(skipped).groupBy("path").agg(F.min("reason").alias("reason"))
    decoded = images.where("tensor is not null").count()
    _progress(show_progress, 2, 3, "build")
    reasons = {r.path: r.reason for r in invalid.orderBy("path").toLocalIterator()} if logs else {}
    report = stats.build_stats(params, start, datetime.now(), decoded, reasons, len(reasons) if logs else invalid.count())
    _progress(show_progress, 3, 3, "build")
    return ImageRepo(spark, images, invalid, report, params.in_folder)


@dataclass
class SearchResult:
    """groups: (folder, id_a, path_a, id_b, path_b, mse); lower_quality_files: (path)."""

    groups: DataFrame
    lower_quality_files: DataFrame
    stats: dict
    in_folder: bool
    moved: list[str] | None = field(default=None)

    @cached_property
    def result(self) -> dict:
        """Matches as nested dictionaries; collects them."""
        return grouping.result_infolder(self.groups) if self.in_folder else grouping.result_union(self.groups)

    @property
    def lower_quality(self) -> list[str]:
        """Paths of the lower quality images, in order; collects them. After move_to, where they have gone."""
        if self.moved is not None:
            return self.moved
        return [r.path for r in self.lower_quality_files.orderBy("path").toLocalIterator()]

    def move_to(self, destination_path: str) -> list[str]:
        self.moved = actions.move_files(self.lower_quality_files, destination_path)
        return self.moved

    def delete(self, silent_del: bool = False) -> int:
        return actions.delete_files(self.lower_quality_files, silent_del)


def search(repo: ImageRepo, similarity="duplicates", rotate=True, same_dim=True, show_progress=True, processes=os.cpu_count(), chunksize=None, metric="wrapped", algorithm="classic", all_turns=False, compat_batch=False, lower_quality="reference", **other) -> SearchResult:
    """Find the images of a repo that match an earlier one.

    similarity: "duplicates" (0), "similar" (5) or the largest mean squared error. rotate: also compare turned images.
    same_dim: only compare images of the same dimensions, in either order. metric: "wrapped" squares modulo 256, "exact" as
    they are. algorithm: "classic", or "sum_bucket" where equal pixel sums are a match. all_turns: turn by 270 degrees too.
    lower_quality: "safe" leaves out images that are the best of another group. chunksize is accepted and has no effect.
    """
    params = SearchParams.of(similarity, rotate, same_dim, show_progress, processes, chunksize, other)
    if lower_quality not in ("reference", "safe"):
        raise ValueError("lower_quality is reference or safe")
    start = datetime.now()
    _progress(show_progress, 0, 2, "search")
    owners = matching.owners(repo.images, params.similarity, params.rotate, params.same_dim, metric, algorithm, all_turns, compat_batch)
    groups = grouping.named_groups(owners, repo.images, repo.in_folder).persist()
    worse = grouping.lower_quality(groups, repo.images, lower_quality == "safe").persist()
    found = grouping.counts(groups, params.similarity).first()
    _progress(show_progress, 1, 2, "search")
    searched = repo.images.where("tensor is not null").count()
    report = stats.search_stats(repo.stats, params, start, datetime.now(), searched, found.duplicates, found.similar)
    _progress(show_progress, 2, 2, "search")
    return SearchResult(groups, worse, report, repo.in_folder)


__all__ = ["ImageRepo", "SearchResult", "build", "search"]
