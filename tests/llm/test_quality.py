import random
import re
from collections import Counter
from math import log

import pytest

from dupscan.llm import quality

JUNK = "#*$%&|<>"


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered |= set(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in JUNK for c in text), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t ", "a\n\na\nb \nb \n", "x " * 7, "x " * 8, "x " * 9, "é ü b", "# $%\n# $%", " ".join(map(str, range(30))) * 2, "w%d " * 3000]
    for _ in range(60):
        out.append(" ".join(rng.choice(["a", "b", "#c", "d\ne", "ß", "\x1f"]) for _ in range(rng.randrange(80))))
    base = [str(i) for i in range(40)]
    out += [" ".join(base + base[5:20] + base[:9]), " ".join(base + ["y"] + base[30:]), " ".join(base) + " " + " ".join(base)]
    return out


def test_base_columns_match_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string"), [0.0] * quality.BUCKETS).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert r.kept == (not r.base_failed)


def test_ratios_and_verdicts(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "of", "to"]) for _ in range(60)) for _ in range(60)]
    junk = [" ".join(rng.choice(["ab", "zq", "xx"]) + rng.choice(["###", "!!"]) for _ in range(60)) for _ in range(20)]
    rows = list(enumerate(clean + junk)) + [(None, clean[0]), (0, clean[0])]
    docs = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id bigint, text string, kept string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(None,), (0,)], "doc_id bigint")
    ratios = quality.fit(docs, trusted)
    out = quality.judge(docs, ratios).collect()
    assert len(out) == len(rows) and all(r.kept == (r.doc_id is None or r.doc_id < 60) for r in out)
    tokens = [re.findall(r"\w+|[^\w\s]+", t.lower()) for _, t in rows]
    uni = Counter(t for x in tokens for t in x)
    h = {r.w: r.b for r in spark.createDataFrame([(w,) for w in uni], "w string").selectExpr("w", f"pmod(xxhash64(w), {quality.BUCKETS}) b").collect()}
    good = Counter(t for x, (i, _) in zip(tokens, rows, strict=True) if i is not None and i < 60 and i % 2 == 0 for t in x)
    n, m = 2 * sum(uni.values()), 2 * sum(good.values())
    k = quality.BUCKETS
    want = log(((good["###"] + (uni["###"] + 1) * k / (n + k)) / (m + k)) / ((uni["###"] + 1) / (n + k)))
    assert ratios[h["###"]] == pytest.approx(want, abs=1e-6) and ratios[h["###"]] < -0.2 < 0 < ratios[h["of"]]


def test_no_trusted_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint")
    assert set(quality.fit(docs, none)) == {0.0} and set(quality.fit(docs.where("false"), none)) == {0.0}
    assert quality.judge(docs.where("false"), [0.0] * quality.BUCKETS).collect() == []


def test_base_columns_are_not_fitted(spark, monkeypatch, tmp_path):
    from dupscan.llm import q_quality

    spark.createDataFrame([(1, "a b # c")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(quality, "fit", lambda *x: pytest.fail("base columns need no ratios"))
    assert [tuple(r) for r in q_quality.quality_base(spark, str(tmp_path)).collect()] == [(1, 4, 4, 1, 0, 0, True)]
