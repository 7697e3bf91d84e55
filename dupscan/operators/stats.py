"""Statistics of builds and searches; every search has its own, none changes another's."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscan.params import BuildParams, SearchParams


def duration(start: datetime, end: datetime) -> dict:
    return {"start": start.isoformat(), "end": end.isoformat(), "seconds_elapsed": round((end - start).total_seconds(), 4)}


def build_counts(images: DataFrame, invalid: DataFrame) -> DataFrame:
    """One row (total_files, invalid_count)."""
    decoded = images.agg(F.count("tensor").alias("n"))
    return decoded.crossJoin(invalid.agg(F.count("*").alias("invalid_count"))).select((F.col("n") + F.col("invalid_count")).alias("total_files"), "invalid_count")


def build_stats(params: BuildParams, start: datetime, end: datetime, decoded: int, reasons: dict[str, str], invalid: int) -> dict:
    kept = ("recursive", "in_folder", "limit_extensions", "px_size", "processes")
    return {
        "directory": list(params.directory),
        "total_files": decoded + invalid,
        "invalid_files": {"count": invalid, "logs": dict(reasons)},
        "process": {"build": {"duration": duration(start, end), "parameters": {k: getattr(params, k) for k in kept}}},
    }


def effective_chunksize(given: int | None, images: int) -> int | None:
    """The chunk size that a search of so many images has in the original, which chunks above 5,000; it has no effect here."""
    if given is None and images > 5000:
        return max(1, round(1_000_000 / images))
    return given


def search_stats(build: dict, params: SearchParams, start: datetime, end: datetime, searched: int, duplicates: int, similar: int) -> dict:
    parameters = {"similarity_mse": params.similarity, "rotate": params.rotate, "same_dim": params.same_dim, "processes": params.processes, "chunksize": params.chunksize}
    parameters["chunksize_effective"] = effective_chunksize(params.chunksize, searched)
    search = {"duration": duration(start, end), "parameters": parameters, "files_searched": searched, "matches_found": {"duplicates": duplicates, "similar": similar}}
    return {**build, "process": {**build["process"], "search": search}}
