"""Moving and deleting files, planned before it is done and done by the driver alone."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dupscan.params import check_bool, check_destination


def move_plan(paths: DataFrame, destination: str) -> DataFrame:
    """(src, dst, collision): where each file would go, and whether another one goes there as well. Touches no file."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    rows = paths.select(F.col("path").alias("src"), F.concat(F.lit(destination.rstrip("/") + "/"), name).alias("dst"))
    return rows.withColumn("collision", F.count("*").over(Window.partitionBy("dst")) > 1)


def move_files(paths: DataFrame, destination: str) -> list[str]:
    """Move files into a folder by their names, replacing what is there; the new paths of those that could be moved."""
    target = check_destination(destination)
    moved = []
    for row in move_plan(paths, str(target)).orderBy("src").toLocalIterator():
        try:
            os.replace(row.src, row.dst)
            moved.append(row.dst)
        except OSError as e:
            warnings.warn(f"not moved: {row.src} ({e})", stacklevel=2)
    print(f"{len(moved)} files moved to {target}")
    return moved


def delete_files(paths: DataFrame, silent: bool = False, ask: Callable[[str], str] = input) -> int:
    """Delete files, after asking unless silent; how many went."""
    check_bool("silent_del", silent)
    if paths.isEmpty():
        print("nothing to delete")
        return 0
    if not silent and ask("Delete all lower quality images for good? (y/n) ").strip().lower() != "y":
        print("nothing deleted")
        return 0
    gone = 0
    for row in paths.orderBy("path").toLocalIterator():
        try:
            os.remove(row.path)
            gone += 1
        except OSError as e:
            warnings.warn(f"not deleted: {row.path} ({e})", stacklevel=2)
    print(f"{gone} files deleted")
    return gone
