import random

import numpy as np
import pytest

from dupscan.llm import passages as P


def _words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(n)]


def _best(c, a):
    """Best chain score by trying all predecessors."""
    score = []
    for i in range(len(c)):
        gains = [score[j] - P.GAP * (c[i] - c[j] + a[i] - a[j]) for j in range(i) if c[j] < c[i] and a[j] < a[i]]
        score.append(P.SEED + max([0, *gains]))
    return max(score)


def test_chains_are_the_best_ones():
    rng = random.Random(1)
    for n in (1, 2, 5, 40):
        c = sorted(rng.sample(range(500), n))
        a = [rng.randrange(500) for _ in range(n)]
        found = P.chains(c, a)
        assert sorted(i for x in found for i in x) == list(range(n))
        score = P.SEED
        for i, j in zip(found[0], found[0][1:], strict=False):
            assert c[i] < c[j] and a[i] < a[j]
            score = P.SEED + max(0, score - P.GAP * (c[j] - c[i] + a[j] - a[i]))
        assert score == pytest.approx(_best(c, a))


def test_equal_stretches_share_a_seed():
    rng = random.Random(2)
    for _ in range(50):
        common = _words(rng, P.SEED + P.WINDOW - 1)
        one, two = (P.seeds(P.word_hashes(" ".join(_words(rng, rng.randint(0, 60)) + common + _words(rng, rng.randint(0, 60)))))[0] for _ in range(2))
        assert set(one.tolist()) & set(two.tolist())
    assert len(P.seeds(P.word_hashes("a b c"))[0]) == len(P.seeds(P.word_hashes(None))[0]) == 0


def test_seeds_of_all_are_those_of_each():
    rng = random.Random(14)
    texts = [_words(rng, rng.randint(50, 400)) for _ in range(30)] + [["a"] * 500, ["x", "y", "z"] * 300, [rng.choice("ab") for _ in range(900)], ["la"] * 50, [rng.choice("qwe") for _ in range(51)]]
    texts += [_words(rng, 70) + [rng.choice("ab") for _ in range(40)] + _words(rng, 30)]
    rng.shuffle(texts)
    words = [P.word_hashes(" ".join(t)) for t in texts]
    of, keys, places = P.seeds_of_all(words)
    for i, x in enumerate(words):
        key, at = P.seeds(x)
        first = np.isin(np.arange(len(key)), np.unique(key, return_index=True)[1])
        assert (keys[of == i] == key).all() and (places[of == i] == np.where(first, at, ~at)).all()


def _smallest_edit(x, y):
    n = P.RESUME
    ways = [(i + j, i, j) for i in range(P.EDIT + 1) for j in range(P.EDIT + 1) if i + j and len(x) >= i + n and len(y) >= j + n and x[i : i + n] == y[j : j + n]]
    return min(ways)[1:] if ways else None


def test_smallest_edits_by_brute_force():
    rng = random.Random(15)
    for _ in range(5000):
        x, y = ([rng.randrange(3) for _ in range(rng.randint(0, 16))] for _ in range(2))
        assert P._resume(np.array(x, int), np.array(y, int)) == _smallest_edit(x, y)


def test_alignment_over_edits():
    rng = random.Random(3)
    text = _words(rng, 120)
    for edit in (lambda t: t[:60] + ["new"] + t[60:], lambda t: t[:60] + t[62:], lambda t: [*t[:60], "new", *t[61:]]):
        c, a = (np.array(P.word_hashes(" ".join(t))) for t in (_words(rng, 20) + edit(list(text)) + _words(rng, 20), _words(rng, 7) + text + _words(rng, 9)))
        runs = P.align(c, a, [(40, 27)])
        ((x, u, y, v, found),) = P.passages(runs)
        assert (x, y, v) == (20, 7, 127) and abs(u - 140) <= 2 and found >= P.SIMILARITY


def _found(spark, texts):
    df = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id bigint, text string, node string").repartition(3)
    rows = P.repeated_passages(df).collect()
    for r in rows:
        assert r.n_words >= P.MIN_WORDS and r.similarity >= P.SIMILARITY
    return df, rows


def test_planted_passages(spark):
    rng = random.Random(4)
    shared, fuzzy, short, line = _words(rng, 60), _words(rng, 150), _words(rng, 40), _words(rng, 9)
    texts = {i: _words(rng, rng.randint(0, 300)) + line for i in range(40)}
    for i in (1, 5, 9, 30):
        texts[i] = _words(rng, 50) + shared + _words(rng, 90)
    texts[12] = texts[12] + fuzzy
    texts[13] = [*texts[13][:10], *fuzzy[:70], "edited", *fuzzy[71:], *texts[13][10:]]
    texts[20], texts[21] = short + texts[20], short + texts[21]
    texts[22] = _words(rng, 3000)
    texts[23] = [*_words(rng, 1000), *texts[22][990:1080], *_words(rng, 700)]
    texts[24] = list(texts[22])
    texts[25] = texts[26] = texts[25] + _words(rng, 60)
    texts[27] = texts[27] + _words(rng, 55) * 2  # repeated in itself alone
    rows_in = [(i, " ".join(t) if i % 2 else "\n".join(t).upper()) for i, t in texts.items()] + [(50, None), (51, ""), (None, " ".join(shared)), (25, " ".join(texts[25]))]
    df, rows = _found(spark, rows_in)
    pairs = {frozenset((r.doc_id, r.first_doc_id)) for r in rows}
    groups = [{1, 5, 9, 30, None}, {12, 13}, {22, 23, 24}, {25, 26}]
    for g in groups:
        own = [p for p in pairs if p & g]
        assert set().union(*own) == g and all(p <= g for p in own)
    assert set().union(*pairs) == set().union(*groups)
    # what is cut: all but one copy of each passage, to the word
    found = P.find_passages(df)
    left = {r.doc_id: r for r in P.cut_passages(df, found).collect() if r.doc_id is not None}
    words = lambda i: (left[i].text or "").lower().split()
    kept = [i for i in (1, 5, 9, 30) if " ".join(shared) in " ".join(words(i))]
    assert len(kept) <= 1
    for i in (0, 2, 20, 21, 27):
        assert left[i].text == dict(rows_in)[i] and left[i].cut_words == 0
    assert left[50].text is None and left[51].text == ""
    for i in (1, 5, 9, 30):
        assert i in kept or abs(len(words(i)) - 140) <= 1 and words(i)[:49] == texts[i][:49] and words(i)[-89:] == texts[i][-89:]
    assert sorted(len(words(i)) for i in (25, 26)) == [0, len(texts[25])]
    # 23 may be the one that keeps what it shares with both
    assert sum(len(words(i)) for i in (22, 24)) in (3000, 2910) and left[22].node == "z"


def test_hot_passage_makes_a_row_a_copy(spark):
    rng = random.Random(5)
    hot = _words(rng, 80)
    df, rows = _found(spark, [(i, " ".join(_words(rng, 30) + hot + _words(rng, 30))) for i in range(60)])
    # seeds at the passage's ends depend on what is beside it, so a copy may meet some more
    assert len({r.doc_id for r in rows}) == 59 and len(rows) < 4 * 59 and len({r.first_doc_id for r in rows}) < 8
    assert all(r.n_words >= 80 for r in rows)


def test_runs_of_few_words(spark):
    rng = random.Random(6)
    run = lambda words, n: (words * n)[:n]
    texts = [_words(rng, 20) + run(w, n) + _words(rng, 20) for w in (["to"], ["la", "le", "lo"]) for n in (30, 45, 60, 90, 75)]
    for seed in range(3):  # whichever has the smallest key
        _, rows = _found(spark, [(10 * i + seed, " ".join(t)) for i, t in enumerate(texts)])
        pairs = [{r.doc_id // 10, r.first_doc_id // 10} for r in rows]
        assert set().union(*(p for p in pairs if p <= {2, 3, 4})) == {2, 3, 4} and set().union(*(p for p in pairs if p <= {7, 8, 9})) == {7, 8, 9}
        assert all(p <= {2, 3, 4} or p <= {7, 8, 9} for p in pairs)


def test_passage_whose_seeds_all_have_firsts_elsewhere(spark):
    rng = random.Random(8)
    common = _words(rng, 60)
    texts = [(i, _words(rng, 30) + (common[:40], common[20:])[i % 2] + _words(rng, 30)) for i in range(60)]
    texts += [(i, _words(rng, 30) + common + _words(rng, 30)) for i in (100, 101)]
    _, rows = _found(spark, [(i, " ".join(t)) for i, t in texts])
    assert {frozenset((r.doc_id, r.first_doc_id)) for r in rows} == {frozenset((100, 101))}
    assert all(r.n_words >= 60 for r in rows)


def test_chain_without_a_passage_hides_no_other():
    import pyarrow as pa

    rng = random.Random(9)
    exact = _words(rng, 100)
    edited = [w if i % 20 != 19 else w + "x" for i, w in enumerate(exact)]
    c, a = ((P.word_hashes(" ".join(t)) >> np.uint64(32)).astype("<u4") for t in (exact, edited + _words(rng, 40) + exact))
    flat = [5, *(x for k in range(5) for x in (20 * k + 2, 20 * k + 2)), 1, 25, 165]
    rows = [{"link": 0, "side": 0, "node": 2, "seg": 0, "words": c.tobytes(), "chains": np.array(flat, np.int32).tobytes()}, {"link": 0, "side": 1, "node": 1, "seg": 0, "words": a.tobytes(), "chains": None}]
    found = list(P._aligned(iter([pa.RecordBatch.from_pylist(rows, pa.schema({"link": pa.int64(), "side": pa.int32(), "node": pa.int64(), "seg": pa.int32(), "words": pa.binary(), "chains": pa.binary()}))])))
    got = [tuple(r.values()) for b in found for r in b.to_pylist()]
    assert [r[1:6] for r in got if r[6] < P.EXACT] == [(0, 100, 1, 140, 240)]
    # the run is the whole text, so it goes beyond both ends
    assert [r[1:6] for r in got if r[6] == P.EXACT] == [(-2 * P.FAR, 100 + 2 * P.FAR, 1, 140, 240)]


def test_fifty_words_have_seeds_far_enough_apart():
    rng = random.Random(10)
    for n in (50, 51, 70):
        for _ in range(50):
            _, at = P.seeds(P.word_hashes(" ".join(_words(rng, n))))
            assert at[0] < P.WINDOW and at[-1] >= n - P.SEED - P.WINDOW + 1 and at[-1] - at[0] >= P.NEAR and (np.diff(at) <= P.WINDOW).all()


def test_long_keys_are_all_windows():
    rng = random.Random(11)
    text = _words(rng, 300)
    words = P.word_hashes(" ".join(text))
    keys, at = P.seeds(words)
    none = np.empty((0, 2), np.int64)
    got = P.long_keys(words, keys, at, np.full(len(at), P.OPEN), none)
    windows = {int(p): bool(o) for p, s, o in zip(got[1], got[2], got[3], strict=True) if s == P.MIN_WORDS - P.SEED and o}
    assert set(range(300 - P.MIN_WORDS + 1)) <= set(windows)
    only = np.where(np.arange(len(at)) == len(at) // 2, 1, 0)
    some = P.long_keys(words, keys, at, only, none)
    assert 0 < len(some[0]) < len(got[0]) and not some[3].any() and not len(P.long_keys(words, keys, at, only * 0, none)[0])
    # what lies in an exact stretch has none
    outside = P.long_keys(words, keys, at, np.full(len(at), P.OPEN), np.array([[20, 90], [100, 220]]))
    key = lambda x: {(int(p), int(n)) for p, n in zip(x[1], x[2], strict=True)}
    assert key(outside) == {(p, n) for p, n in key(got) if not any(s <= p and p + n + P.SEED <= e for s, e in ((20, 90), (100, 220)))}
    # keys depend on the words alone
    more = P.word_hashes(" ".join(_words(rng, 31) + text[40:150]))
    k2, a2 = P.seeds(more)
    assert len(set(got[0].tolist()) & set(P.long_keys(more, k2, a2, np.full(len(a2), 1), none)[0].tolist())) >= 110 - P.MIN_WORDS + 1


def _uncovered(texts, found, nodes):
    """Words of windows that a document of smaller key has too, but for SEED words at either end, outside all passages."""
    windows, out = {}, []
    for i, t in texts.items():
        for k in range(len(t) - P.MIN_WORDS + 1):
            windows.setdefault(" ".join(t[k : k + P.MIN_WORDS]), []).append((nodes[i], i, k))
    spans = {}
    for r in found:
        spans.setdefault(r.c_node, set()).update(range(r.c_start, r.c_end))
    for holders in windows.values():
        for node, i, k in holders:
            if node > min(holders)[0]:
                miss = [w for w in range(k + P.SEED, k + P.MIN_WORDS - P.SEED) if w not in spans.get(node, ())]
                out += [(i, w) for w in miss if w + 1 in miss]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_shared_windows_by_brute_force(spark, seed):
    rng = random.Random(20 + seed)
    lines, blocks = [_words(rng, rng.randint(8, 49)) for _ in range(12)], [_words(rng, rng.randint(50, 130)) for _ in range(12)]
    texts = {}
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            part = list(rng.choice(lines)) if kind < 0.45 else list(rng.choice(blocks)) if kind < 0.65 else _words(rng, rng.randint(1, 60))
            if kind < 0.65 and rng.random() < 0.4:
                part = part[rng.randrange(len(part)) :]
            parts += part
        texts[i] = parts
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string").repartition(5)
    nodes = {r.doc_id: r.node for r in df.select("doc_id", P.node_key("doc_id", "text").alias("node")).collect()}
    found = P.find_passages(df).collect()
    by = {n: [w.encode() for w in texts[i]] for i, n in nodes.items()}
    for r in found:
        assert r.a_node < r.c_node and min(r.c_end - r.c_start, r.a_end - r.a_start) >= P.MIN_WORDS
        shingles = [{tuple(by[n][x : x + 5]) for x in range(s, e - 4)} for n, s, e in ((r.c_node, r.c_start, r.c_end), (r.a_node, r.a_start, r.a_end))]
        assert len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) >= 0.75
    assert _uncovered(texts, found, nodes) == []


def test_links_grow_with_the_holders_of_a_run(spark):
    rng = random.Random(12)
    run = _words(rng, 40)
    _, rows = _found(spark, [(i, " ".join(_words(rng, 20) + run + _words(rng, 20))) for i in range(120)])
    assert rows == []


def test_edited_passage_whose_seeds_have_firsts_elsewhere(spark):
    rng = random.Random(13)
    left, right = _words(rng, 45), _words(rng, 45)
    texts = [(i, " ".join(_words(rng, 30) + (left, right)[i % 2] + _words(rng, 30))) for i in range(60)]
    texts += [(100, " ".join(_words(rng, 30) + left + ["one"] + right + _words(rng, 30))), (101, " ".join(_words(rng, 30) + left + ["other"] + right + _words(rng, 30)))]
    _, rows = _found(spark, texts)
    assert {frozenset((r.doc_id, r.first_doc_id)) for r in rows} == {frozenset((100, 101))}


def test_merging_looks_at_all_open_parts():
    import pyarrow as pa

    rows = [(2, 0, 400, 1, 0, 400, 1.0)] + [(2, 10 + k, 70 + k, 1, 1000 + 100 * k, 1060 + 100 * k, 1.0) for k in range(20)] + [(2, 350, 500, 1, 350, 500, 1.0)]
    rows.sort(key=lambda r: r[1])
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), P._PASSAGE_TYPES, strict=True)], list(P._PASSAGE))
    out = [tuple(r.values()) for b in P._merged(iter([batch])) for r in b.to_pylist()]
    assert (2, 0, 500, 1, 0, 500, 1.0) in out and len(out) == 21


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert P.repeated_passages(df).collect() == []
    assert P.cut_passages(df, P.find_passages(df)).collect() == []


@pytest.mark.parametrize("text,spans,out", [("a b  c\nd", [(1, 3)], "a d"), (" a b", [(0, 1)], " b"), ("a b", [(0, 2)], ""), ("a b c d", [(0, 1), (0, 2), (3, 4)], "c ")])
def test_cut_words(text, spans, out):
    assert P.cut_words(text, spans) == out
