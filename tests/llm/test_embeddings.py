import numpy as np
import pytest

from dupscan.llm import embeddings


def brute(rows, threshold=0.95):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[k] = x / np.linalg.norm(x)
    links = {k: {j for j in good if j != k and len(good[j]) == len(good[k]) and good[j] @ good[k] >= threshold} if k in good else set() for k in range(len(rows))}
    comp = {}
    for k in links:
        if k not in comp:
            seen, todo = {k}, [k]
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            low = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
            comp |= dict.fromkeys(seen, low)
    return sorted(((rows[k][0], len(links[k]), comp[k], rows[k][0] is not None and rows[k][0] == comp[k]) for k in links), key=str)


def planted(seed, n=160, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    near = [x[i % 6] + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.3]) for i in range(n)]
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate([*x, *near])]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (2, rows[2][1]), (None, rows[4][1]), (1002, [2 * y for y in rows[5][1]])]
    return rows + [(1003, None), (1004, []), (1005, [0.0] * dim), (1006, [None] * dim), (1007, [float("nan")] * dim), (1008, [float("inf")] * dim), (1009, [1.0]), (1010, [2.0]), (None, None)]


@pytest.mark.parametrize("tile,part", [(8192, 512), (32, 512), (64, 8)])
def test_matches_brute_force(spark, monkeypatch, tile, part):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "PART", part)
    rows = planted(tile + part)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, n_links string")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_no_pair_is_missed_at_the_production_setting(spark):
    # 1,500 pairs right above the threshold, in more than one tile
    rng, dim, m = np.random.default_rng(7), 32, 1500
    x = rng.standard_normal((m, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((m, dim))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.9501 * x + np.sqrt(1 - 0.9501**2) * y
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near]).astype(np.float32))]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert min(r.n_links for r in got) >= 1


@pytest.mark.parametrize("dim", [3, 24, 700])
def test_bounds_hold(dim):
    rng = np.random.default_rng(2)
    u = embeddings._unit(rng.standard_normal(200 * dim), dim)
    t = embeddings._Tile(u, np.ones(200), np.arange(200))
    near = (t.q.astype(float) @ t.q.astype(float).T) * t.scale[:, None] * t.scale
    slack = t.lost[:, None] * (t.norm + t.lost) + t.norm[:, None] * t.lost + embeddings.EPSILON
    assert (np.abs(near - u @ u.T) <= slack).all()
    assert (np.abs(t.near @ t.near.T - near) <= embeddings._rounding(dim)).all()


def test_codes_alone_discard_most_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    t = embeddings._Tile(embeddings._unit(rng.standard_normal(600 * 64), 64), np.ones(600), np.arange(600))
    exact = t.u @ t.u.T
    i, j = embeddings._links(t, t, slice(0, 300), slice(300, 600), 0.3)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*((np.argwhere(exact[:300, 300:] >= 0.3) + [0, 300]).T.tolist()), strict=True))
    # nothing is linked that the codes don't let through
    t.near = np.zeros_like(t.near)
    assert not len(embeddings._links(t, t, slice(0, 300), slice(300, 600), 0.3)[0])


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []
