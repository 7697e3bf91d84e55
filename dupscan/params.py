"""Checks of parameters, made before any plan is built."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass
from pathlib import Path

#: Similarity thresholds by name.
NAMED_SIMILARITY = {"duplicates": 0, "similar": 5}
_RETIRED_SIMILARITY = {"low", "normal", "high"}
_MOVED_KEYWORDS = {"lazy": "same_dim"}


class ParameterError(ValueError):
    """A parameter has a wrong type or value."""


def _reject(name: str, need: str) -> ParameterError:
    return ParameterError(f"{name} must be {need}")


def check_bool(name: str, value: object) -> bool:
    if type(value) is not bool:
        raise _reject(name, "True or False")
    return value


def check_directories(given: tuple) -> list[str]:
    """Roots in order: strings, or lists of strings, of folders and files that exist; none twice."""
    if not given:
        raise _reject("directory", "given at least once")
    if all(isinstance(x, list) for x in given):
        roots = [y for x in given for y in x]
    else:
        roots = list(given)
    if not roots or not all(isinstance(x, str) for x in roots):
        raise _reject("directory", "strings, or lists of strings")
    for root in roots:
        if not os.path.exists(root):
            raise FileNotFoundError(f"no such file or folder: {root}")
    if len(set(roots)) < len(roots):
        raise ParameterError("a directory is given twice")
    return sorted(roots)


def check_similarity(value: object) -> float:
    """The threshold of a name or number; numbers may be text. NaN passes and matches equal tensors alone."""
    if isinstance(value, str) and value in NAMED_SIMILARITY:
        return NAMED_SIMILARITY[value]
    if isinstance(value, str) and value in _RETIRED_SIMILARITY:
        raise ParameterError('similarity knows "duplicates" and "similar", or a number')
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        number = -1.0
    if number < 0:
        raise _reject("similarity", '"duplicates", "similar" or a number from 0')
    return number


def check_int(name: str, value: object, low: int, high: float = math.inf) -> int:
    if not isinstance(value, int):
        raise _reject(name, "an integer")
    if not low <= value <= high:
        raise _reject(name, f"from {low}" + (f" to {high}" if high < math.inf else ""))
    return value


def check_keywords(extra: dict) -> None:
    """Keywords that have moved are errors; unknown ones are ignored."""
    for old in extra.keys() & _MOVED_KEYWORDS.keys():
        raise ParameterError(f"{old} is now called {_MOVED_KEYWORDS[old]}")


def check_destination(value: object) -> Path:
    """A folder to move files to, made if it is missing."""
    if not isinstance(value, str):
        raise _reject("destination", "a string")
    path = Path(value)
    if path.exists() and not path.is_dir():
        raise _reject("destination", "a folder")
    path.mkdir(parents=True, exist_ok=True)
    return path


@dataclass(frozen=True)
class BuildParams:
    directory: list[str]
    recursive: bool = True
    in_folder: bool = False
    limit_extensions: bool = True
    px_size: int = 50
    show_progress: bool = True
    processes: int = 1

    @classmethod
    def of(cls, directory: tuple, recursive: object, in_folder: object, limit_extensions: object, px_size: object, show_progress: object, processes: object, extra: dict) -> BuildParams:
        roots = check_directories(directory)
        flags = {"recursive": recursive, "in_folder": in_folder, "limit_extensions": limit_extensions, "show_progress": show_progress}
        checked = {k: check_bool(k, v) for k, v in flags.items()}
        size = check_int("px_size", px_size, 10, 5000)
        workers = check_int("processes", processes, 1, os.cpu_count() or 1)
        check_keywords(extra)
        return cls(directory=roots, px_size=size, processes=workers, **checked)


@dataclass(frozen=True)
class SearchParams:
    similarity: float = 0
    rotate: bool = True
    same_dim: bool = True
    show_progress: bool = True
    processes: int = 1
    chunksize: int | None = None

    @classmethod
    def of(cls, similarity: object, rotate: object, same_dim: object, show_progress: object, processes: object, chunksize: object, extra: dict) -> SearchParams:
        threshold = check_similarity(similarity)
        flags = {"rotate": rotate, "same_dim": same_dim, "show_progress": show_progress}
        checked = {k: check_bool(k, v) for k, v in flags.items()}
        workers = check_int("processes", processes, 1, os.cpu_count() or 1)
        chunk = None if chunksize is None else check_int("chunksize", chunksize, 1)
        check_keywords(extra)
        return cls(similarity=threshold, processes=workers, chunksize=chunk, **checked)
