"""Command line: find images that match, write what was found, and move or delete what is of lower quality."""

from __future__ import annotations

import argparse
import json
import os
from datetime import datetime

from pyspark.sql import SparkSession

from dupscan.api import build, search
from dupscan.operators import grouping
from dupscan.params import ParameterError, check_keywords

_TRUE, _FALSE = {"yes", "true", "t", "y", "1"}, {"no", "false", "f", "n", "0"}


def yes_or_no(word: str) -> bool:
    if word.lower() in _TRUE | _FALSE:
        return word.lower() in _TRUE
    raise argparse.ArgumentTypeError("yes or no is expected")


def number_or_word(word: str) -> int | str:
    try:
        return int(word)
    except ValueError:
        return word


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="dupscan", description="Find duplicate and similar images.")
    flag = lambda short, name, default, text: out.add_argument(short, f"--{name}", type=yes_or_no, default=default, help=text)
    out.add_argument("-D", "--directory", nargs="+", default=[os.getcwd()], help="folders or files (default: the working folder)")
    out.add_argument("-Z", "--output_directory", help="folder for the results, made if missing (default: the working folder)")
    flag("-r", "recursive", True, "look into subfolders")
    flag("-i", "in_folder", False, "search every directory by itself")
    flag("-le", "limit_extensions", True, "only files with an image extension")
    out.add_argument("-px", "--px_size", type=int, default=50, help="side of the tensors that are compared")
    out.add_argument("-s", "--similarity", type=number_or_word, default="duplicates", help="duplicates, similar, or a mean squared error")
    flag("-ro", "rotate", True, "also compare turned images")
    flag("-dim", "same_dim", True, "only compare images of the same dimensions")
    out.add_argument("-mv", "--move_to", help="move lower quality images here")
    flag("-d", "delete", False, "delete lower quality images")
    flag("-sd", "silent_del", False, "delete without asking")
    flag("-p", "show_progress", True, "show progress")
    out.add_argument("-proc", "--processes", type=number_or_word, default=os.cpu_count(), help="hint for the number of partitions")
    out.add_argument("-ch", "--chunksize", type=number_or_word, default=None, help="accepted, without effect")
    flag("-la", "lazy", None, "has become --same_dim")
    return out


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Run the command; the paths of the three files written: results, lower quality images, statistics."""
    args = parser().parse_args(words)
    if args.lazy is not None:
        check_keywords({"lazy": args.lazy})
    if args.move_to is not None and args.delete:
        raise ParameterError("move_to and delete exclude each other")
    folder = args.output_directory or os.getcwd()
    os.makedirs(folder, exist_ok=True)
    spark = spark or SparkSession.builder.appName("dupscan").getOrCreate()
    repo = build(spark, args.directory, recursive=args.recursive, in_folder=args.in_folder, limit_extensions=args.limit_extensions, px_size=args.px_size, show_progress=args.show_progress, processes=args.processes)
    found = search(repo, similarity=args.similarity, rotate=args.rotate, same_dim=args.same_dim, show_progress=args.show_progress, processes=args.processes, chunksize=args.chunksize)
    stamp = datetime.now().strftime("%Y%m%d%H%M%S")
    written = [os.path.join(folder, f"dupscan_{stamp}_{name}") for name in ("results.json", "lower_quality.txt", "stats.json")]
    with open(written[0], "w", encoding="utf-8") as f:
        grouping.write_json(found.groups, found.in_folder, f)
    with open(written[1], "w", encoding="utf-8") as f:
        f.writelines(f"{r.path}\n" for r in found.lower_quality_files.orderBy("path").toLocalIterator())
    with open(written[2], "w", encoding="utf-8") as f:
        json.dump(found.stats, f)
    if args.move_to is not None:
        found.move_to(args.move_to)
    if args.delete:
        found.delete(silent_del=args.silent_del)
    print("\n".join(["written:", *written]))
    return written


if __name__ == "__main__":
    main()
