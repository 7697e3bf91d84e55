"""Groups of matches: what belongs to which image, with paths and folders, and which images are of lower quality."""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dirname(path):
    """The folder of a path column: all before the last slash."""
    return F.regexp_replace(path, "/[^/]*$", "")


def folder_labels(images: DataFrame) -> DataFrame:
    """(group_id, folder): the folder of each group's first decodable image."""
    first = images.where("tensor is not null").groupBy("group_id").agg(F.min_by("path", "file_id").alias("path"))
    return first.select("group_id", dirname(F.col("path")).alias("folder"))


def named_groups(owners: DataFrame, images: DataFrame, in_folder: bool = False) -> DataFrame:
    """(folder, id_a, path_a, id_b, path_b, mse): groups with paths; folder is null unless searched by folder.

    Tensors are not carried along.
    """
    few = images.select("file_id", "group_id", "path")
    a = few.select(F.col("file_id").alias("id_a"), F.col("path").alias("path_a"), "group_id")
    b = few.select(F.col("file_id").alias("id_b"), F.col("path").alias("path_b"))
    out = owners.join(b, "id_b").join(a, "id_a")
    if in_folder:
        out = out.join(folder_labels(images), "group_id")
    else:
        out = out.withColumn("folder", F.lit(None).cast("string"))
    return out.select("folder", "id_a", "path_a", "id_b", "path_b", "mse")


def result_union(groups: DataFrame) -> dict:
    """{path: [[path, mse], ...]} in the order of ids; rows pass through the driver one partition at a time."""
    out: dict[str, list] = {}
    for r in groups.orderBy("id_a", "id_b").toLocalIterator():
        out.setdefault(r.path_a, []).append([r.path_b, r.mse])
    return out


def result_infolder(groups: DataFrame) -> dict:
    """{folder: {path: [[path, mse], ...]}}; groups whose folders are the same are one."""
    out: dict[str, dict] = {}
    for r in groups.orderBy("id_a", "id_b").toLocalIterator():
        out.setdefault(r.folder, {}).setdefault(r.path_a, []).append([r.path_b, r.mse])
    return out


def write_json(groups: DataFrame, in_folder: bool, out: TextIO) -> None:
    """The same nested dictionaries as JSON text; the driver holds one group at a time."""
    keys, last = (["folder"] if in_folder else []) + ["id_a"], None
    out.write("{")
    for r in groups.orderBy(*keys, "id_b").toLocalIterator():
        now = (r.folder if in_folder else None, r.id_a)
        if in_folder and (last is None or last[0] != now[0]):
            out.write(("]}, " if last else "") + json.dumps(now[0]) + ": {" + json.dumps(r.path_a) + ": [")
        elif last != now:
            out.write(("], " if last else "") + json.dumps(r.path_a) + ": [")
        else:
            out.write(", ")
        out.write(json.dumps([r.path_b, r.mse]))
        last = now
    out.write(("]" if last else "") + ("}" if last and in_folder else "") + "}")


def nested_json(groups: DataFrame) -> DataFrame:
    """(folder, id_a, path_a, matches): each group's matches as JSON in the order of ids, for results that are written rather than collected."""
    matches = F.array_sort(F.collect_list(F.struct("id_b", F.col("path_b").alias("path"), "mse")))
    return groups.groupBy("folder", "id_a", "path_a").agg(F.to_json(F.transform(matches, lambda m: F.struct(m["path"].alias("path"), m["mse"].alias("mse")))).alias("matches"))


def counts(groups: DataFrame, similarity: float = 0) -> DataFrame:
    """One row (duplicates, similar): members of groups; at threshold 0 all are duplicates, else those at 0."""
    same = F.lit(True) if similarity == 0 else F.col("mse") == 0
    return groups.agg(F.count_if(same).alias("duplicates"), F.count_if(~same).alias("similar"))


def lower_quality(groups: DataFrame, images: DataFrame, safe: bool = False) -> DataFrame:
    """(path): of each group all but the image of the largest width + height, ties going to the greatest path.

    An image may be best in one group and not in another: it is listed, unless safe. The best is a maximum, so a group of
    any size is aggregated before it is shuffled.
    """
    size = images.select("file_id", "path", (F.col("width") + F.col("height")).alias("extent"))
    ids = groups.select("id_a", F.col("id_b").alias("file_id")).union(groups.select("id_a", "id_a").distinct())
    members = ids.join(size, "file_id").select("id_a", "path", "extent")
    best = members.groupBy("id_a").agg(F.max(F.struct("extent", "path")).alias("best")).select("id_a", F.col("best.path").alias("best"))
    worse = members.join(best, "id_a").where("path != best").select("path").distinct()
    return worse.join(best.select(F.col("best").alias("path")), "path", "left_anti") if safe else worse
