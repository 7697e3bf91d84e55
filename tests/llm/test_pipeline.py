import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from dupscan.llm import common, mixing, passages, quality, simhash


def _text(rng, n):
    common = "the of and to in is that it for on was as with be by".split()
    words = [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("abcdefghij", k=rng.randint(4, 8))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    shared = " ".join("".join(rng.choices("klmnopqrs", k=6)) for _ in range(70))
    rows = [(i, _text(rng, rng.randint(60, 200)), "en", f"src{i % 3}", 0) for i in range(60)]
    for i in (3, 17, 41):
        rows[i] = (i, f"{rows[i][1]}\n{shared}\n{_text(rng, 60)}", *rows[i][2:])
    rows += [(100 + i, rows[7][1], "en", None, 0) for i in range(4)]  # copies
    rows += [(200, rows[8][1] + " more", "en", "src1", 0)]  # a near copy
    rows += [(300, "too few words", "en", "src0", 0), (301, None, "en", "src0", 0), (302, "", None, None, None), (5, rows[5][1], "en", "src2", 0)]
    rows += [(303, "the same eight words again and again here " * 30, "en", "src1", 0)]
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in [*range(60), 100, 101, 102, 103, 200]], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), rows


def test_stages_one_by_one(spark, tables, tmp_path):
    where, rows = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, where).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    one, two, three, four, five = seen.values()
    # 1: rows are judged one by one
    bad = {300, 301, 302, 303}
    assert {r.doc_id for r in one} == {r[0] for r in rows} - bad and len(one) == len(rows) - len(bad)
    # 2: groups of fingerprints at 3 bits or fewer, by trying all pairs
    fp = {r.doc_id: simhash.fingerprint(r.text) for r in one}
    near = lambda a, b: bin((fp[a] ^ fp[b]) & (2**64 - 1)).count("1") <= simhash.MAX_BITS
    label = {i: i for i in fp}
    for _ in fp:
        label = {i: min(label[j] for j in fp if near(i, j)) for i in fp}
    assert sorted(r.doc_id for r in two) == sorted(set(label.values()))
    assert not {100, 101, 102, 103} & {r.doc_id for r in two}
    # 3: the shared passage stays in one document, all else as it was
    text = {r.doc_id: r.text for r in two}
    word = rows[3][1].split("\n")[1].split()[5]
    holders = [r for r in three if word in (r.text or "")]
    assert len(holders) == 1 and holders[0].doc_id in (3, 17, 41)
    for r in three:
        if r.doc_id in (8, 200):
            continue  # too different for one group, alike enough for one passage
        if r.doc_id not in (3, 17, 41):
            assert r.text == text[r.doc_id]
        elif r.doc_id != holders[0].doc_id:
            assert abs(len(r.text.split()) - (len(text[r.doc_id].split()) - 70)) <= 2 and r.n_chars == len(r.text)
    # 4: copies of whole documents, words near the targets
    before = {r.doc_id: r for r in three}
    taken = {}
    for r in four:
        assert r.text == before[r.doc_id].text
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    size = lambda r: len((r.text or "").split())
    total, sources = sum(map(size, three)), sorted({r.source for r in three} - {None}) + [None] * any(r.source is None for r in three)
    assert max(taken.values()) <= mixing.MOST
    for s, w in zip(sources, mixing.WEIGHTS, strict=False):
        own = [r for r in three if r.source == s]
        assert abs(sum(taken.get(r.doc_id, 0) * size(r) for r in own) - total * w / sum(mixing.WEIGHTS[: len(sources)])) <= max(map(size, own))
    # 5: as the public library encodes
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, tuple(r.ids)) for r in five) == sorted((r.doc_id, tuple(real.encode_ordinary(r.text))) for r in four)
    for r in five:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(before[r.doc_id].text.encode()).hexdigest()


def test_extra_columns_and_a_long_text(spark, tables, tmp_path):
    from pyspark.sql import functions as F

    where, rows = tables
    rng = random.Random(3)
    long = _text(rng, 40_000)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([*rows[:12], (900, long, "en", "src1", 0), (901, None, None, None, None)], schema)
    clash = ("fp", "_fp", "component_id", "size", "copies", "_copy", "target", "kept", "n_words", "log_ratio", "cut_words", "_node", "c_node", "ids", "packed", "decoded", "n_tokens", "_words")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs.withColumns({c: F.lit("x") for c in clash}), where).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "encode_texts" or docs.columns == list(corpus_pipeline.COLUMNS)
        if k < 3:
            assert [r.text for r in docs.where("doc_id = 900").collect()] == [long]


def test_run_is_the_stages(spark, tables):
    where, _ = tables
    rows = corpus_pipeline.run(spark, where).collect()
    assert rows and {"doc_id", "n_tokens", "ids"} <= set(rows[0].asDict())


def test_an_empty_table(spark, tables, tmp_path):
    where, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, where).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.collect() == []


def test_parameters_are_the_operators():
    assert (passages.SHINGLE, passages.SIMILARITY, simhash.MAX_BITS, quality.WINDOW) == (5, 0.8, 3, 8)


def test_a_text_is_cut_once(spark, tables):
    where, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    plan = corpus_pipeline.substring_dedup(spark, docs, where)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_small_tables_go_into_few_files(spark, tables, monkeypatch):
    where, _ = tables
    files, real = {}, common.scratch

    def scratch(df, label, *more):
        out = real(df, label, *more)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        return out

    for module in (common, simhash, passages, mixing, corpus_pipeline):
        monkeypatch.setattr(module, "scratch", scratch)
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        docs = spark.read.parquet(f"{where}/documents.parquet")
        for stage in (corpus_pipeline.simhash_dedup, corpus_pipeline.substring_dedup, corpus_pipeline.mix_sources):
            stage(spark, docs, where)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"distinct", "edges", "labels", "firsts", "links", "parts", "passages", "copies"} <= set(files)
    # rows with whole texts may be large, however few they are
    assert max(n for label, n in files.items() if label != "open") <= 2 * spark.sparkContext.defaultParallelism, files
