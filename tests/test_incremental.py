"""Replaying a batch, or the whole run, adds no rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from storylens.session import shared_dir
from storylens.streaming import incremental as T
from storylens.streaming.commits import CommitLog


def test_replay_is_idempotent(spark):
    src = shared_dir(spark, f"src-{uuid.uuid4().hex}")
    out = shared_dir(spark, f"out-{uuid.uuid4().hex}")
    ckpt = shared_dir(spark, f"ck-{uuid.uuid4().hex}")
    df = spark.range(0, 40).select(F.col("id").alias("p_ind"), (F.col("id") * 2).alias("v"))
    df.repartition(4).write.parquet(src)

    def fn(batch, batch_id):
        return batch.select("p_ind", "v")

    first = T.run_batches(spark, src, df.schema, out, ckpt, fn, files_per_batch=1).count()
    again = T.run_batches(spark, src, df.schema, out, ckpt, fn, files_per_batch=1).count()
    assert first == again == 40
    # a batch replayed after a crash between its commit and the checkpoint adds nothing
    log = CommitLog(spark, out)
    batch = spark.read.parquet(src).select("*", F.col("_metadata.file_path").alias("_source_file"))
    T.committing_writer(log, fn)(batch, 0)
    assert T.run_batches(spark, src, df.schema, out, ckpt, fn).count() == 40 and len(log.numbers()) == 4


def _three_files(spark):
    src = shared_dir(spark, f"src-{uuid.uuid4().hex}")
    for i in (1, 2, 3):
        spark.createDataFrame([(i,)], "x long").coalesce(1).write.mode("append").parquet(src)
    return src


def test_a_new_checkpoint_folder_never_duplicates(spark):
    src, out = _three_files(spark), shared_dir(spark, f"out-{uuid.uuid4().hex}")

    def run(size, src=src):
        ckpt = shared_dir(spark, f"ck-{uuid.uuid4().hex}")
        return sorted(r[0] for r in T.run_batches(spark, src, "x long", out, ckpt, lambda b, i: b.select("x"), size).collect())

    assert run(1) == run(3) == run(2) == [1, 2, 3]
    spark.createDataFrame([(4,)], "x long").coalesce(1).write.mode("append").parquet(src)
    assert run(4) == [1, 2, 3, 4]  # a batch of old files and a new one adds the new one


def test_an_empty_source_gives_an_empty_table(spark):
    src = shared_dir(spark, f"src-{uuid.uuid4().hex}")
    path = spark._jvm.org.apache.hadoop.fs.Path(src)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    got = T.run_batches(spark, src, "x long", shared_dir(spark, f"out-{uuid.uuid4().hex}"),
                        shared_dir(spark, f"ck-{uuid.uuid4().hex}"), lambda b, i: b.select((F.col("x") * 2).alias("y")))
    assert got.columns == ["y"] and got.count() == 0


def test_a_batch_that_fails_is_unseen_and_made_again(spark):
    """Rows written before a crash belong to no commit."""
    src, out = _three_files(spark), shared_dir(spark, f"out-{uuid.uuid4().hex}")
    ckpt = shared_dir(spark, f"ck-{uuid.uuid4().hex}")
    log, calls = CommitLog(spark, out), []

    def crashing(batch, batch_id):
        calls.append(batch_id)
        if len(calls) == 2:
            log.write(batch.select("x"))  # written, but never committed
            raise RuntimeError("lost")
        return batch.select("x")

    with pytest.raises(Exception, match="lost"):
        T.run_batches(spark, src, "x long", out, ckpt, crashing, 1)
    schema = spark.createDataFrame([], "x long").schema
    assert log.read(schema).count() == 1
    assert sorted(r[0] for r in T.run_batches(spark, src, "x long", out, ckpt, lambda b, i: b.select("x"), 1).collect()) == [1, 2, 3]


def test_commits_of_two_writers_take_different_numbers(spark):
    out = shared_dir(spark, f"out-{uuid.uuid4().hex}")
    one, two = CommitLog(spark, out), CommitLog(spark, out)
    df = spark.createDataFrame([(1,)], "x long")
    names = [one.write(df), two.write(df)]
    two.numbers = lambda: []  # looked before the first one committed
    assert [one.commit(names[0], ["a"]), two.commit(names[1], ["b"])] == [0, 1]
    assert one.done() == {"a", "b"} and one.read(df.schema).count() == 2


def test_skip_finished(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "writer string, p_ind long")
    done = spark.createDataFrame([("a", 2)], "writer string, p_ind long")
    assert sorted(tuple(r) for r in T.skip_finished(df, done).collect()) == [("a", 1), ("b", 2), ("b", 3)]
    assert T.skip_finished(df, done.limit(0)).count() == 4


def test_done_stories(spark):
    folder = shared_dir(spark, f"done-{uuid.uuid4().hex}")
    assert T.done_stories(spark, folder).count() == 0
    log = CommitLog(spark, folder)
    rows = spark.createDataFrame([("a", 1, 0, 0.5)], "writer string, p_ind long, s_ind long, score double")
    log.write(rows.union(rows.selectExpr("writer", "p_ind + 1", "s_ind", "score")))  # never committed
    log.commit(log.write(rows), ["file"])
    assert [tuple(r) for r in T.done_stories(spark, folder).collect()] == [("a", 1, 0)]


def test_scoring_batches_keep_all_stories_and_replay(spark):
    """Two files share prompt 0, and both writers have it; a replayed batch
    writes the same rows again."""
    src = shared_dir(spark, f"src-{uuid.uuid4().hex}")
    out = shared_dir(spark, f"out-{uuid.uuid4().hex}")
    ckpt = shared_dir(spark, f"ck-{uuid.uuid4().hex}")
    rows = [(0, 0, 0, "human", "0-0", "good day"), (1, 0, 1, "human", "0-1", "bad day"),
            (2, 0, 0, "gpt-3.5", "0-0", "good good"), (3, 0, 1, "gpt-3.5", "0-1", "none")]
    df = spark.createDataFrame(rows, "s_key long, p_ind long, s_ind long, writer string, s_id string, text string")
    for i in range(4):
        df.where(F.col("s_key") == i).coalesce(1).write.mode("append").parquet(src)
    ws = spark.createDataFrame([("good", "valence", "avg", 1.0), ("bad", "valence", "avg", -1.0)],
                               "w string, dim string, sm string, wscore double")
    modes = spark.createDataFrame([("valence", False)], "dim string, unipolar boolean")
    fn = T.scoring_batch(ws, modes, dims=["valence"], sms=["avg"])
    got = T.run_batches(spark, src, df.schema, out, ckpt, fn, files_per_batch=1)
    want = {(0, 1.0), (1, -1.0), (2, 1.0), (3, 0.0)}
    assert {(r["s_key"], r["score"]) for r in got.collect()} == want and got.count() == 4
    replayed = spark.read.parquet(src).select("*", F.col("_metadata.file_path").alias("_source_file"))
    T.committing_writer(CommitLog(spark, out), fn)(replayed, 1)
    again = CommitLog(spark, out).read(got.schema)
    assert {(r["s_key"], r["score"]) for r in again.collect()} == want and again.count() == 4
