import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dupscan.functions import tensors as T
from dupscan.operators import grouping, matching

PX = 10


def _golden():
    """Twelve 10 x 10 RGB tensors: copies, turns, shifts, and rows swapped."""
    r, c, ch = np.meshgrid(np.arange(PX), np.arange(PX), np.arange(3), indexing="ij")
    a = ((37 * r * r + 11 * c + 5 * ch + 3 * r * c) % 251).astype(np.uint8)
    swapped = a[[1, 0, *range(2, PX)]]
    images = [a, a, np.rot90(a), np.rot90(a, 2), np.rot90(a, 3), a + np.uint8(16), a + np.uint8(1), a + np.uint8(2), a + np.uint8(3), a, swapped, a]
    sizes = [(100, 60)] * 12
    sizes[2] = sizes[4] = (60, 100)
    sizes[9] = (200, 120)
    return [np.ascontiguousarray(x) for x in images], sizes


SCHEMA = "file_id bigint, group_id int, path string, width int, height int, tensor binary, px_sum bigint"


def _images(spark, tensors, sizes, groups=None):
    rows = [(i, groups[i] if groups else 0, f"img_{i:02}.png", *sizes[i], bytearray(t.tobytes()), int(t.sum(dtype=np.int64))) for i, t in enumerate(tensors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def golden(spark):
    return _images(spark, *_golden())


# Expected groups, counts and kept ids of the golden images: algorithm, similarity, rotate, same_dim
CASES = [
    ("classic", 0, True, True, {0: [1, 3, 4, 5, 11]}, (5, 0), {2, 6, 7, 8, 9, 10, 11}),
    ("classic", 0, True, False, {0: [1, 3, 4, 5, 9, 11]}, (6, 0), {2, 6, 7, 8, 9, 10}),
    ("classic", 0, False, True, {0: [1, 5, 11]}, (3, 0), {2, 3, 4, 6, 7, 8, 9, 10, 11}),
    ("classic", 0, False, False, {0: [1, 5, 9, 11]}, (4, 0), {2, 3, 4, 6, 7, 8, 9, 10}),
    ("classic", 5, True, True, {0: [1, 3, 4, 5, 6, 7, 11], 6: [8]}, (5, 3), {2, 8, 9, 10, 11}),
    ("classic", 5, True, False, {0: [1, 3, 4, 5, 6, 7, 9, 11], 6: [8]}, (6, 3), {2, 8, 9, 10}),
    ("classic", 5, False, True, {0: [1, 5, 6, 7, 11], 6: [8]}, (3, 3), {2, 3, 4, 8, 9, 10, 11}),
    ("classic", 5, False, False, {0: [1, 5, 6, 7, 9, 11], 6: [8]}, (4, 3), {2, 3, 4, 8, 9, 10}),
    ("sum_bucket", 0, True, True, {0: [1, 2, 3, 4, 10]}, (5, 0), {5, 6, 7, 8, 9, 10, 11}),
    ("sum_bucket", 0, True, False, {0: [1, 2, 3, 4, 9, 10]}, (6, 0), {5, 6, 7, 8, 9, 11}),
    ("sum_bucket", 0, False, True, {0: [1, 2, 3, 4, 10]}, (5, 0), {5, 6, 7, 8, 9, 10, 11}),
    ("sum_bucket", 5, True, True, {0: [1, 2, 3, 4, 5, 6, 7, 10], 6: [8]}, (6, 3), {8, 9, 10, 11}),
    ("sum_bucket", 5, True, False, {0: [1, 2, 3, 4, 5, 6, 7, 9, 10], 6: [8]}, (7, 3), {8, 9, 11}),
    ("sum_bucket", 5, False, False, {0: [1, 2, 3, 4, 5, 6, 7, 9, 10], 6: [8]}, (7, 3), {8, 9, 11}),
]
MSE = {6: 1.0, 7: 4.0, 8: 4.0}


@pytest.mark.parametrize("algorithm,similarity,rotate,same_dim,groups,counts,kept", CASES)
def test_golden(golden, algorithm, similarity, rotate, same_dim, groups, counts, kept):
    owners = matching.owners(golden, similarity, rotate, same_dim, algorithm=algorithm, compat_batch=algorithm == "sum_bucket")
    named = grouping.named_groups(owners, golden).persist()
    got = {}
    for r in named.orderBy("id_a", "id_b").collect():
        got.setdefault(r.id_a, []).append(r.id_b)
        assert r.mse == MSE.get(r.id_b, 0.0)
    assert got == groups
    assert tuple(grouping.counts(named, similarity).first()) == counts
    worse = {int(r.path[4:6]) for r in grouping.lower_quality(named, golden).collect()}
    assert set(range(12)) - worse == kept


@pytest.mark.parametrize("similarity,rotate,same_dim,n", [(0, True, True, 15), (0, True, False, 21), (0, False, True, 6), (0, False, False, 10), (5, True, True, 28), (5, True, False, 36), (5, False, True, 15), (5, False, False, 21)])
def test_golden_pairs(golden, similarity, rotate, same_dim, n):
    turns = matching.TURNS if rotate else (0,)
    pairs = matching.tile_pairs(golden, similarity, turns, same_dim)
    assert pairs.count() == n
    if not similarity:
        same = matching.exact_pairs(golden, turns, same_dim)
        assert sorted(map(tuple, same.collect())) == sorted(map(tuple, pairs.collect()))


def test_all_turns_find_the_quarter_turn(golden):
    found = {r.id_b for r in matching.owners(golden, 0, all_turns=True).collect()}
    assert found == {1, 2, 3, 4, 5, 11}


def test_true_metric(golden):
    found = {r.id_b: r.mse for r in matching.owners(golden, 9, metric="exact").collect()}
    assert found == {1: 0, 3: 0, 4: 0, 6: 1, 7: 4, 8: 9, 11: 0}  # + 16 is far away
    assert {r.id_b for r in matching.owners(golden, 0, metric="exact").collect()} == {1, 3, 4, 11}


def test_nan_matches_equal_tensors_alone(golden):
    assert {r.id_b for r in matching.owners(golden, float("nan")).collect()} == {1, 11}


def test_unknown_options(golden):
    with pytest.raises(ValueError):
        matching.owners(golden, metric="other")


def _brute(tensors, sizes, groups, threshold, turns, same_dim):
    """Owners by the definition, pair by pair."""
    out = {}
    for b in range(len(tensors)):
        for a in range(b):
            if groups[a] != groups[b] or same_dim and sorted(sizes[a]) != sorted(sizes[b]):
                continue
            costs = [np.square(np.subtract(tensors[a], np.rot90(tensors[b], k))).mean() for k in turns]
            if min(costs) <= threshold:
                out[b] = (a, min(costs))
                break
    return out


@pytest.mark.parametrize("tile", [3, 1024, "bytes"])
@pytest.mark.parametrize("threshold", [0, 30])
def test_owners_as_brute_force(spark, monkeypatch, tile, threshold):
    monkeypatch.setattr(matching, *("TILE_BYTES", 500) if tile == "bytes" else ("TILE", tile))
    rng = np.random.default_rng(threshold)
    base = rng.integers(0, 256, (6, 4, 4, 3)).astype(np.uint8)
    tensors = [np.ascontiguousarray(np.rot90(base[i] + np.uint8(s), k)) for i, s, k in zip(rng.integers(0, 6, 60), rng.choice([0, 0, 1, 3, 16], 60), rng.integers(0, 4, 60), strict=True)]
    sizes = [[(8, 6), (6, 8), (9, 9)][i] for i in rng.integers(0, 3, 60)]
    groups = rng.integers(0, 2, 60).tolist()
    images = _images(spark, tensors, sizes, groups)
    for turns, rotate in ((matching.TURNS, True), ((0,), False)):
        for same_dim in (True, False):
            want = _brute(tensors, sizes, groups, threshold, turns, same_dim)
            for found in (matching.owners(images, threshold, rotate, same_dim), matching.tile_owners(images, threshold, turns, same_dim)):
                assert {r.id_b: (r.id_a, r.mse) for r in found.collect()} == want


def test_small_tables(spark, golden):
    for images in (golden.limit(0), golden.where("file_id = 3")):
        for similarity in (0, 5):
            assert matching.owners(images, similarity).collect() == []
            assert tuple(grouping.counts(matching.owners(images, similarity)).first()) == (0, 0)
    undecoded = spark.createDataFrame([(0, 0, "a", None, None, None, None), (1, 0, "b", None, None, None, None)], SCHEMA)
    assert matching.owners(undecoded).collect() == []


def test_folders_and_safe_quality(spark):
    tensors, sizes = _golden()
    images = _images(spark, tensors, sizes, [0] * 6 + [1] * 6)
    named = grouping.named_groups(matching.owners(images, 5), images, in_folder=True)
    result = grouping.result_infolder(named)
    assert {k: {a: [b for b, _ in m] for a, m in v.items()} for k, v in result.items()} == {"img_00.png": {"img_00.png": ["img_01.png", "img_03.png", "img_04.png", "img_05.png"], "img_06.png": ["img_07.png", "img_08.png", "img_11.png"]}} or list(result)
    # 0 -> 1, 2 and 2 -> 3: 2 is worse in the first group and the best of the second
    owners = spark.createDataFrame([(0, 1, 0.0), (0, 2, 1.0), (2, 3, 1.0)], "id_a bigint, id_b bigint, mse double")
    extents = [50, 1, 40, 3]
    four = spark.createDataFrame([(i, f"p{i}", e, 0) for i, e in enumerate(extents)], "file_id bigint, path string, width int, height int")
    names = lambda df: sorted(r.path for r in df.collect())
    assert names(grouping.lower_quality(owners, four)) == ["p1", "p2", "p3"]
    assert names(grouping.lower_quality(owners, four, safe=True)) == ["p1", "p3"]


# ---- tensors


def test_wrapped_cost_of_all_differences():
    a = np.arange(256, dtype=np.uint8)[:, None]
    got = T.wrapped_cost(a, np.zeros((1, 1), np.uint8))[:, 0]
    assert got.tolist() == [d * d % 256 for d in range(256)]
    assert [d for d in range(256) if not got[d]] == list(range(0, 256, 16)) and got.max() == 249


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=9, max_size=9), st.lists(st.integers(0, 255), min_size=9, max_size=9))
def test_keys_are_equal_where_the_cost_is_zero(x, y):
    a, b = np.array([x], np.uint8), np.array([y], np.uint8)
    assert (T.wrapped_cost(a, b)[0, 0] == 0) == (T.nibbles(a) == T.nibbles(b)).all()
    assert T.true_cost(a, b)[0, 0] == sum((p - q) ** 2 for p, q in zip(x, y, strict=True))


def test_turns():
    t = np.arange(27, dtype=np.uint8)[None]
    assert (T.rot90(t, 3)[0].reshape(3, 3, 3) == np.rot90(t[0].reshape(3, 3, 3))).all()
    assert (T.rot90(T.rot90(t, 3), 3, 3) == t).all()


def test_resampling():
    rng = np.random.default_rng(0)
    flat = np.full((37, 91, 3), 77, np.uint8)
    assert (T.resample(flat, 50) == 77).all()
    same = rng.integers(0, 256, (20, 20, 3)).astype(np.uint8)
    assert (T.resample(same, 20) == same).all()
    ramp = np.repeat(np.linspace(0, 255, 200)[None, :, None], 60, 0).repeat(3, 2).astype(np.uint8)
    small = T.resample(ramp, 20).astype(int)
    assert small.shape == (20, 20, 3) and (np.diff(small[:, :, 0], axis=1) >= 0).all() and abs(small.mean() - ramp.mean()) < 1
    assert T.resample(rng.integers(0, 256, (1, 1, 3)).astype(np.uint8), 10).std(axis=(0, 1)).max() == 0


@pytest.mark.parametrize("metric", ["wrapped", "exact"])
def test_close_pairs_are_those_of_whole_costs(metric, monkeypatch):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (40, 300)).astype(np.uint8)
    b = np.concatenate([a[:20] + rng.integers(0, 3, (20, 300)).astype(np.uint8), rng.integers(0, 256, (30, 300)).astype(np.uint8)])
    turned = [b, b[:, ::-1].copy()]
    cost = T.wrapped_cost if metric == "wrapped" else T.true_cost
    best = np.minimum(*(cost(a, x) for x in turned)) / 300
    for threshold in (0, 2, 80, 90, 10_000, 1e9):
        want = [(i, j, best[i, j]) for i, j in np.argwhere(best <= threshold)]
        for cut in (1, 64, 300, 512):
            monkeypatch.setattr(matching, "CUT", cut)
            assert list(zip(*matching.close_pairs(a, turned, threshold, metric), strict=True)) == want


@pytest.mark.parametrize("size", [1, 9, 64, 300])
def test_near_pairs_include_all_within_the_limit(size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(0, 256, (70, size)).astype(np.uint8), rng.integers(0, 256, (37, size)).astype(np.uint8)
    b[:20] = a[:20] + rng.integers(0, 3, (20, size)).astype(np.uint8)
    b[20], a[60] = 255, 0
    for near, cost in ((T.wrapped_near, T.wrapped_cost), (T.true_near, T.true_cost)):
        costs = cost(a, b)
        for limit in (-1, 0, 2 * size, *np.quantile(costs, [0.01, 0.5, 1]).tolist(), 1e9):
            i, j = near(a, b, limit)
            assert set(zip(*np.nonzero(costs <= limit), strict=True)) <= set(zip(i, j, strict=True))
            assert (np.diff(i * len(b) + j) > 0).all()
        few = np.quantile(costs, 0.01)
        assert len(near(a, b, few)[0]) < 0.2 * costs.size or size < 64


def test_owners_in_rounds_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(matching, "FIRST", 3)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (12, 4, 4, 3)).astype(np.uint8)
    tensors = [np.ascontiguousarray(np.rot90(base[i] + np.uint8(s), k)) for i, s, k in zip(rng.integers(0, 12, 60), rng.choice([0, 1, 3, 9, 16], 60), rng.integers(0, 4, 60), strict=True)]
    groups = (rng.random(60) < 0.1).astype(int).tolist()  # one large group and one small one
    found = matching.owners(_images(spark, tensors, [(8, 8)] * 60, groups), 20)
    assert {r.id_b: (r.id_a, r.mse) for r in found.collect()} == _brute(tensors, [(8, 8)] * 60, groups, 20, matching.TURNS, True)


def _meeting(own, tensors):
    n = len(own)
    columns = {"group_id": [0] * n, "lo": [0] * n, "hi": [0] * n, "low": [0] * n, "high": [0] * n, "own": own, "file_id": list(range(n)), "px_sum": [0] * n, "tensor": [x.tobytes() for x in tensors]}
    return pa.RecordBatch.from_pydict(columns)


def test_images_with_an_owner_are_compared_no_more(monkeypatch):
    compared, close = [], matching.close_pairs
    monkeypatch.setattr(matching, "close_pairs", lambda a, turned, *x: compared.append(len(a) * len(turned[0])) or close(a, turned, *x))
    tensors = np.random.default_rng(0).integers(0, 256, (1, 64)).astype(np.uint8).repeat(3000, 0)
    rows = _meeting([0] * 1000 + [1] * 2000, tensors)
    out = list(matching._kernel(5, (0,), "wrapped", True, False)(iter([rows])))
    assert sum(compared) <= 64 * 2000  # of 2,000,000
    assert {b: a for x in out for a, b in zip(x["id_a"].to_pylist(), x["id_b"].to_pylist(), strict=True)} == dict.fromkeys(range(1000, 3000), 0)


def test_pairs_of_a_meeting_come_in_parts(monkeypatch):
    monkeypatch.setattr(matching, "PARTS", (100, 50))
    tensors = np.zeros((400, 64), np.uint8)
    out = list(matching._kernel(5, (0,), "wrapped", False, False)(iter([_meeting([0] * 400, tensors)])))
    assert sum(map(len, out)) == 400 * 399 // 2 and max(map(len, out)) <= 100 * 50
