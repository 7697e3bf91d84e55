from types import SimpleNamespace

import pytest

from dupscan.llm import common


def _session(master, conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


def test_no_folder_of_one_machine_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(_session(master, {}))
        assert common.shared_dir(_session(master, {"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"


def test_a_folder_of_our_own_where_all_run_on_one_machine(tmp_path, monkeypatch):
    monkeypatch.setattr(common.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    for master in ("local", "local[4]", "local[*]", "local[4,2]"):
        conf = {}
        assert common.shared_dir(_session(master, conf)) == conf["spark.checkpoint.dir"] == str(tmp_path)


def test_components_of_random_links(spark):
    import random

    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1, None), (5, 5), (1000, 1001)] + [(2000, 2000 + i) for i in range(1, 60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}


def test_few_links_go_into_few_files(spark, monkeypatch):
    files, real = [], common.scratch

    def scratch(df, label, *more):
        out = real(df, label, *more)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common, "scratch", scratch)
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
        assert {r.component for r in common.connected_components(links, rows=300).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 5 and max(files) <= 2 * spark.sparkContext.defaultParallelism
    # large tables are not squeezed
    assert common.files_for(spark, 10**9) == 10**9 // common.FILE_ROWS
