"""Settled tables: where they are, and when they go."""

import os
from types import SimpleNamespace

import pytest

from fabula.llm import scratch


def place(df):
    return df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]


def test_tables_go_when_they_are_cleared(spark):
    before = scratch.tables()
    one, two, three = (scratch.settle(spark.range(5), name) for name in ("one", "two", "three"))
    paths = [place(t) for t in (one, two, three)]
    assert all(map(os.path.isdir, paths)) and len(scratch.tables() - before) == 3
    scratch.drop(one)
    scratch.clear(before, keep=three)
    assert [os.path.isdir(p) for p in paths] == [False, False, True] and three.count() == 5
    inner = scratch.tables()
    scratch.clear(inner)
    assert os.path.isdir(paths[2])
    scratch.clear(before)
    assert not os.path.isdir(paths[2]) and scratch.tables() == before


def session(master, named=None, directory=None):
    made = []
    context = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: directory, setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default: named), sparkContext=context), made


def test_a_cluster_must_name_its_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.folder(session(master)[0])
        assert scratch.folder(session(master, named="hdfs://a/b/")[0]) == "hdfs://a/b"
    fake, made = session("local[4]")
    assert scratch.folder(fake) == made[0] and made[0].startswith("file://")
    assert scratch.folder(session("local[4]", directory="file:/x/")[0]) == "file:/x"


def test_results_read_later_go_to_workers_in_small_batches(spark, tmp_path):
    import pyarrow as pa

    import corpus_pipeline as P

    def largest(df):
        count = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
        return max(r["n"] for r in df.mapInArrow(count, "n long").collect())

    most = {k: spark.conf.get(k, None) for k in scratch.BATCHES}
    before, rows = scratch.tables(), int(scratch.BATCHES["spark.sql.execution.arrow.maxRecordsPerBatch"])
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.range(3 * rows, numPartitions=1).selectExpr("id doc_id", "concat('one text of number ', id) text")
    assert largest(docs) > rows
    for stage in (P.classify_quality, P.dedup_lines, P.pack_sequences):
        stage(spark, docs, str(tmp_path))
        assert largest(docs) <= rows, stage
        scratch.clear(before)
        assert {k: spark.conf.get(k, None) for k in scratch.BATCHES} == most
    # what a session has set itself stays
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        scratch.hold_batches(spark)
        scratch.clear(before)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.unset(key)
