import numpy as np

from dupscan.operators import matching
from dupscan.streaming.incremental import match_batch, match_stream

SCHEMA = "file_id bigint, group_id int, path string, width int, height int, tensor binary, px_sum bigint"


def _rows(n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (5, 3, 3, 3)).astype(np.uint8)
    picks = zip(rng.integers(0, 5, n), rng.integers(0, 4, n), rng.integers(0, 2, n), strict=True)
    return [(i, int(g), f"p{i}", 3, 3, bytearray(np.ascontiguousarray(np.rot90(base[b], k)).tobytes()), 0) for i, (b, k, g) in enumerate(picks)]


def _collect(df):
    return sorted((r.id_a, r.id_b) for r in df.collect())


def test_batches_are_as_one_search(spark, tmp_path):
    rows = _rows(60)
    want = _collect(matching.owners(spark.createDataFrame(rows, SCHEMA), 0))
    got = []
    for n, at in enumerate(range(0, 60, 20)):
        part = spark.createDataFrame(rows[at : at + 20], SCHEMA)
        first = _collect(match_batch(part, n, f"{tmp_path}/state"))
        assert _collect(match_batch(part, n, f"{tmp_path}/state")) == first  # run again
        got += first
    assert sorted(got) == want


def test_stream(spark, tmp_path):
    rows = _rows(40, 1)
    for n in range(2):
        spark.createDataFrame(rows[20 * n : 20 * n + 20], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        (tmp_path / f"in/{n}/_SUCCESS").unlink()
    found = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = match_stream(stream, f"{tmp_path}/state", lambda df, n: found.extend(_collect(df)), f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    assert {b for _, b in found} <= {r[0] for r in rows} and len({b for _, b in found}) == len(found)
    assert sorted(found) == _collect(matching.owners(spark.createDataFrame(rows, SCHEMA), 0))
