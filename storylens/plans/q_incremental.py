"""Queries for resumable and incremental processing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storylens.functions.text import whitespace_words
from storylens.operators.lexicon import lexicon_modes
from storylens.operators.score import word_score_table
from storylens.plans.oracle_fixtures import with_ctes
from storylens.plans.registry import query
from storylens.plans.sqlparts import SQL_ATTRS_ALL, sql_avg_scores
from storylens.session import shared_dir
from storylens.sources import fixtures as fx
from storylens.streaming import incremental as T

SQL_DONE = """SELECT DISTINCT s.writer, s.p_ind FROM fx_stories s JOIN labels b ON b.doc_id = s.s_key
WHERE b.quality = 1 AND s.s_ind = 0"""


def _done(spark, sf):
    st = fx.stories(spark, sf).filter(F.col("s_ind") == 0)
    lab = fx.read_table(spark, sf, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("s_key"))
    return st.join(lab, "s_key", "left_semi").select("writer", "p_ind").distinct()


@query("t01_skip_finished", with_ctes(["fx_stories"], f"""
SELECT writer, p_ind, s_ind FROM fx_stories s
WHERE NOT EXISTS (SELECT 1 FROM ({SQL_DONE}) d WHERE d.writer = s.writer AND d.p_ind = s.p_ind)"""))
def t01(spark, sf):
    """Stories of prompts not in their writer's done list (prompts whose
    first story is labelled quality 1 count as done)."""
    st = fx.stories(spark, sf).select("writer", "p_ind", "s_ind")
    return T.skip_finished(st, _done(spark, sf))


BATCHES = 4
FILE_CHARS = 1 << 25


def _write_source(spark, df, name: str, file_chars: int = FILE_CHARS) -> tuple[str, int]:
    """New story files for the stream, of about ``file_chars`` characters each,
    ``BATCHES`` at least; a prompt's stories are in several. Returns the folder
    and how many files make a batch, so that files, not batches, grow in number."""
    path = shared_dir(spark, f"{name}-{uuid.uuid4().hex}")
    chars = df.agg(F.sum(F.length("text"))).first()[0] or 0
    per_batch = max(1, -(-chars // (file_chars * BATCHES)))
    df.repartition(BATCHES * per_batch, "s_id").write.parquet(path)
    return path, per_batch


@query("t02_batch_commit_replay", with_ctes(["fx_stories"], """
SELECT writer, p_ind, s_ind, s_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_words
FROM fx_stories"""))
def t02(spark, sf):
    """Stories arrive as files, whose results are committed batch by
    batch; then the run is replayed with the same checkpoint folder, and with a
    new one and another batch size, which must add nothing."""
    st = fx.stories(spark, sf).select("writer", "p_ind", "s_ind", "s_id", "text")
    src, per_batch = _write_source(spark, st, "t02-src")
    out = shared_dir(spark, f"t02-out-{uuid.uuid4().hex}")
    ckpt = shared_dir(spark, f"t02-ckpt-{uuid.uuid4().hex}")

    def fn(batch, batch_id):
        return batch.select("writer", "p_ind", "s_ind", "s_id", F.size(whitespace_words("text")).cast("bigint").alias("n_words"))

    T.run_batches(spark, src, st.schema, out, ckpt, fn, files_per_batch=per_batch)
    T.run_batches(spark, src, st.schema, out, ckpt, fn, files_per_batch=per_batch)
    return T.run_batches(spark, src, st.schema, out, f"{ckpt}-new", fn, files_per_batch=3 * per_batch)


@query("t03_incremental_scoring", with_ctes(["fx_stories", "fx_lexicon"],
                                           "SELECT writer, s_id, am, dim, sm, score FROM scores",
                                           [("attrs", SQL_ATTRS_ALL), *sql_avg_scores(["all"])]), floats=["score"])
def t03(spark, sf):
    """New story files scored batch by batch against static lexicon
    word scores (prepared once); files of committed batches are not read again."""
    st = fx.stories(spark, sf).select("s_key", "p_ind", "s_ind", "writer", "s_id", "s_pov", "p_pov", "text")
    src, per_batch = _write_source(spark, st, "t03-src")
    out = shared_dir(spark, f"t03-out-{uuid.uuid4().hex}")
    ckpt = shared_dir(spark, f"t03-ckpt-{uuid.uuid4().hex}")
    lex = fx.lexicon(spark, sf)
    ws = word_score_table(lex, None, sms=["avg"]).checkpoint()
    modes = lexicon_modes(lex).checkpoint()
    fn = T.scoring_batch(ws, modes, sms=["avg"])
    res = T.run_batches(spark, src, st.schema, out, ckpt, fn, files_per_batch=per_batch)
    return res.select("writer", "s_id", "am", "dim", "sm", "score")
