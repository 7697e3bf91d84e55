"""Queries that work on image files: each tensor of embeddings is written as a PNG file of another size, then built and searched.

The files lie in the folder that driver and executors share (spark.checkpoint.dir), in one folder a label. Every second file has
its size in the other order, ids that divide by TURN have a copy turned by 180 degrees, and those that divide by BROKEN one
that is no image.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscan import api
from dupscan.functions import tensors
from dupscan.plans.catalogue import _ROT180, _T, PX, _png, embedding_tensors, query

#: Pixels of a side of the tensors that files are resampled to.
SIDE = 12
TURN, BROKEN = 5, 7


def _folder(spark: SparkSession) -> str:
    """A new folder, which goes with the session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = shared.removeprefix("file://").removeprefix("file:") if shared else tempfile.gettempdir()
    path = os.path.join(base, f"dupscan-files-{uuid.uuid4().hex}")
    os.makedirs(path)
    weakref.finalize(spark.sparkContext, shutil.rmtree, path, True)
    return path


def _write(rows: pa.Table | pa.RecordBatch, folder: str) -> int:
    made = 0
    for vec, grp, t in zip(*(rows.column(c).to_pylist() for c in ("id", "grp", "t")), strict=True):
        image = np.array(t, np.uint8).reshape(PX, PX)
        image = np.repeat(image, 2, vec % 2)  # twice as high or as wide
        at = os.path.join(folder, f"f{grp}")
        os.makedirs(at, exist_ok=True)
        files = {f"{vec:09d}_a.png": _png(image.shape[1], image.tobytes())}
        if vec % TURN == 0:
            files[f"{vec:09d}_b.PNG"] = _png(image.shape[1], np.rot90(image, 2).tobytes())
        if vec % BROKEN == 0:
            files[f"{vec:09d}_c.png"] = b"junk"
            files[f"{vec:09d}_d.txt"] = b"text"
        for name, data in files.items():
            with open(os.path.join(at, f".{name}.part"), "wb") as f:  # a task that is run again replaces whole files
                f.write(data)
            os.replace(f.name, os.path.join(at, name))
            made += 1
    return made


def written(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the files."""
    folder = _folder(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_write(batch, folder)])], ["files"])

    embedding_tensors(spark, sf_dir).select("id", "grp", "t").mapInArrow(run, "files bigint").agg(F.sum("files")).collect()
    return folder


def _built(spark: SparkSession, sf_dir: str, in_folder: bool = False) -> tuple[api.ImageRepo, str]:
    folder = written(spark, sf_dir)
    roots = sorted(os.path.join(folder, x) for x in os.listdir(folder)) if in_folder else [folder]
    return api.build(spark, *roots, in_folder=in_folder, px_size=SIDE, show_progress=False, processes=1), folder


def _name(path: str, folder: str):
    return F.substring(F.col(path), len(folder) + 2, 1 << 20)


# ---- the same in SQL


def _resampled(rows: str, n: int) -> str:
    """SQL of bicubic resampling of the first axis of a list of n rows to SIDE rows; the weights are 22-bit fixed-point numbers."""
    first, weights = tensors._bicubic_weights(n, SIDE)
    taps = [[(int(first[i]) + k + 1, int(w)) for k, w in enumerate(weights[i]) if w] for i in range(SIDE)]
    value = "greatest(0, least(255, ({} + 2097152) >> 22))"
    row = lambda i: "list_transform(range(1, len({r}[1]) + 1), lambda j: " + value.format(" + ".join(f"{w} * {{r}}[{k}][j]" for k, w in taps[i])) + ")"
    return "[" + ", ".join(row(i).replace("{r}", rows) for i in range(SIDE)) + "]"


_TURNED_OVER = "list_transform(range(1, len({r}[1]) + 1), lambda j: list_transform(range(1, len({r}) + 1), lambda i: {r}[i][j]))"
_ROWS = "list_transform(range(8), lambda y: CAST({t}[y * 8 + 1:y * 8 + 8] AS BIGINT[]))"
#: Images as lists of their columns; after resampling these, as lists of their rows; then all resampled.
_FILES = (
    f"WITH {_T}, v AS (SELECT id, grp, 'a.png' AS kind, t FROM t UNION ALL SELECT id, grp, 'b.PNG', {_ROT180.format(t='t')} FROM t WHERE id % {TURN} = 0), "
    f"i AS (SELECT *, {_ROWS.format(t='t')} AS y FROM v), "
    "c AS (SELECT id, grp, kind, CASE WHEN id % 2 = 1 THEN 16 ELSE 8 END AS width, CASE WHEN id % 2 = 1 THEN 8 ELSE 16 END AS height, "
    "CASE WHEN id % 2 = 1 THEN list_transform(range(16), lambda x: list_transform(range(8), lambda q: y[q + 1][x // 2 + 1])) "
    "ELSE list_transform(range(8), lambda x: list_transform(range(16), lambda q: y[q // 2 + 1][x + 1])) END AS x FROM i), "
    f"w AS (SELECT id, grp, kind, width, height, CASE WHEN width = 16 THEN {_resampled('x', 16)} ELSE {_resampled('x', 8)} END AS x FROM c), "
    f"h AS (SELECT id, grp, kind, width, height, {_TURNED_OVER.format(r='x')} AS y FROM w), "
    f"z AS (SELECT id, grp, kind, width, height, CASE WHEN height = 16 THEN {_resampled('y', 16)} ELSE {_resampled('y', 8)} END AS y FROM h), "
    "b AS (SELECT id, grp, kind, NULL::INTEGER AS width, NULL::INTEGER AS height, NULL AS y FROM (SELECT id, grp, 'c.png' AS kind FROM t WHERE id % 7 = 0)), "
    "n AS (SELECT 'f' || grp || '/' || lpad(id::VARCHAR, 9, '0') || '_' || kind AS name, * FROM (SELECT * FROM z UNION ALL SELECT * FROM b)), "
    "f AS (SELECT *, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS file_id, flatten(y) AS p FROM n)"
)
_OWNED = "list_transform(f.p, lambda x: x % 16)"
_OVER = f"list_transform(range({SIDE * SIDE}), lambda i: f.p[{SIDE * SIDE} - i] % 16)"
_QUARTER = f"list_transform(range({SIDE * SIDE}), lambda i: f.p[1 + (i % {SIDE}) * {SIDE} + {SIDE - 1} - i // {SIDE}] % 16)"


def _matches(folder: bool) -> str:
    same = "AND a.grp = b.grp" if folder else ""
    keys = " UNION ALL ".join(f"SELECT file_id, grp, {k} AS k FROM f WHERE p IS NOT NULL" for k in (_OWNED, _QUARTER, _OVER))
    # the sizes are 8 x 16 and 16 x 8, which are alike
    return f"{_FILES}, k AS ({keys}), o AS (SELECT min(a.file_id) AS id_a, b.file_id AS id_b FROM k b JOIN (SELECT file_id, grp, {_OWNED} AS k FROM f WHERE p IS NOT NULL) a ON a.k = b.k AND a.file_id < b.file_id {same} GROUP BY b.file_id)"


@query(f"{_FILES} SELECT name, file_id, width, height, CAST(3 * list_sum(p) AS BIGINT) AS px_sum FROM f")
def files_built(spark, sf_dir):
    """Files as listed, numbered, decoded and resampled; broken ones have no size."""
    repo, folder = _built(spark, sf_dir)
    return repo.images.select(_name("path", folder).alias("name"), "file_id", "width", "height", "px_sum")


@query(f"WITH {_T} SELECT 'f' || grp || '/' || lpad(id::VARCHAR, 9, '0') || kind AS name FROM t, (VALUES ('_c.png'), ('_d.txt')) v(kind) WHERE id % {BROKEN} = 0")
def files_invalid(spark, sf_dir):
    """Files that are no images, by extension or as they don't decode."""
    repo, folder = _built(spark, sf_dir)
    return repo.invalid.select(_name("path", folder).alias("name"))


@query(f"{_matches(False)} SELECT a.name AS name_a, b.name AS name_b, 0.0::DOUBLE AS mse FROM o JOIN f a ON a.file_id = o.id_a JOIN f b ON b.file_id = o.id_b")
def files_searched(spark, sf_dir):
    repo, folder = _built(spark, sf_dir)
    groups = api.search(repo, show_progress=False, processes=1).groups
    return groups.select(_name("path_a", folder).alias("name_a"), _name("path_b", folder).alias("name_b"), "mse")


@query(f"{_matches(True)} SELECT 'f' || a.grp AS folder, a.name AS name_a, b.name AS name_b, 0.0::DOUBLE AS mse FROM o JOIN f a ON a.file_id = o.id_a JOIN f b ON b.file_id = o.id_b")
def files_searched_in_folder(spark, sf_dir):
    repo, folder = _built(spark, sf_dir, in_folder=True)
    groups = api.search(repo, show_progress=False, processes=1).groups
    return groups.select(_name("folder", folder).alias("folder"), _name("path_a", folder).alias("name_a"), _name("path_b", folder).alias("name_b"), "mse")


@query(f"{_matches(False)}, m AS (SELECT id_a, id_b AS id FROM o UNION SELECT id_a, id_a FROM o), ranked AS (SELECT name, row_number() OVER (PARTITION BY id_a ORDER BY width + height DESC, name DESC) AS rn FROM m JOIN f ON f.file_id = m.id) SELECT DISTINCT name FROM ranked WHERE rn > 1")
def files_lower_quality(spark, sf_dir):
    """What a search would move or delete."""
    repo, folder = _built(spark, sf_dir)
    return api.search(repo, show_progress=False, processes=1).lower_quality_files.select(_name("path", folder).alias("name"))
