"""Queries for cleaning (P*) and text sources/sinks (S*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storylens.constants import GENERATION_INSTRUCTION, GENERATION_ROLE, TAG_PATTERN, WRITERS
from storylens.functions import text as T
from storylens.operators import cleaning as P
from storylens.operators import attrs as A
from storylens.plans import common as C
from storylens.plans.oracle_fixtures import with_ctes
from storylens.plans.registry import query
from storylens.plans.sqlparts import SQL_ATTRS_ALL, SQL_E06, sql_avg_scores
from storylens.session import shared_dir
from storylens.sources import fixtures as fx
from storylens.sources import io

SQL_ROLE = "'" + GENERATION_ROLE.replace("'", "''") + "'"
SQL_INSTRUCTION = "'" + GENERATION_INSTRUCTION.replace("'", "''") + "'"
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
SQL_CLEAN_PROMPT = STRIP.format(x=f"regexp_replace(prompt, '{TAG_PATTERN}', '', 'g')")


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


@query("p01_strip_tags", with_ctes(["fx_prompts"], f"""
SELECT conv_id, turn, {SQL_CLEAN_PROMPT} AS prompt FROM fx_prompts"""))
def p01(spark, sf):
    """Tag strip on prompts (every prompt of the conversation turn pairs)."""
    return P.clean_prompts(fx.prompts(spark, sf)).select("conv_id", "turn", "prompt")


@query("p02_combine_lines", with_ctes(["fx_prompts"], f"""
SELECT conv_id, turn, {SQL_CLEAN_PROMPT} || ' <endprompt> ' || story AS line FROM fx_prompts"""))
def p02(spark, sf):
    """Cleaned prompt and story joined by the delimiter."""
    return P.combine(P.clean_prompts(fx.prompts(spark, sf))).select("conv_id", "turn", "line")


@query("s02_delimited_lines", with_ctes(["fx_prompts"], f"""
SELECT conv_id, turn,
       regexp_replace(string_split(line, ' <endprompt> ')[1], '\\s+$', '') AS prompt,
       regexp_replace(string_split(line, ' <endprompt> ')[2], '\\s+$', '') AS story
FROM (SELECT conv_id, turn, {SQL_CLEAN_PROMPT} || ' <endprompt> ' || story AS line FROM fx_prompts)
WHERE NOT regexp_matches(line, '^\\s*$') AND len(string_split(line, ' <endprompt> ')) >= 2"""))
def s02(spark, sf):
    """Parse the combined lines back into (prompt, story), rejects aside."""
    lines = P.combine(P.clean_prompts(fx.prompts(spark, sf))).select("conv_id", "turn", "line")
    rows, _rejects = io.parse_delimited(lines, "line")
    return rows


SQL_P03 = """
SELECT p.p_ind, CAST(row_number() OVER (PARTITION BY l.prompt ORDER BY l.line_no) - 1 AS BIGINT) AS s_ind,
       l.prompt, l.line_no
FROM fx_lines l JOIN (SELECT prompt, row_number() OVER (ORDER BY min(line_no)) - 1 AS p_ind
                      FROM fx_lines GROUP BY prompt) p ON p.prompt = l.prompt"""


@query("p03_index_stories", with_ctes(["fx_lines"], SQL_P03))
def p03(spark, sf):
    """Prompt index by first-seen order, story index by line order."""
    return P.index_stories(fx.lines(spark, sf)).select("p_ind", "s_ind", "prompt", "line_no")


@query("p04_prompt_window", with_ctes(["fx_lines"], f"""
SELECT * FROM ({SQL_P03}) WHERE p_ind BETWEEN 5 AND 5 + 10000 - 1"""))
def p04(spark, sf):
    """The prompt window start=5, window=10000 (the reference default)."""
    idx = P.index_stories(fx.lines(spark, sf)).select("p_ind", "s_ind", "prompt", "line_no")
    return P.prompt_window(idx, 5, 10000)


SQL_TRUNC = """CASE WHEN len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')) > 500
     THEN array_to_string(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')[1:500], ' ')
     ELSE {x} END"""


@query("p05_truncate_words", f"""
SELECT doc_id, {SQL_TRUNC.format(x='text')} AS text FROM documents""")
def p05(spark, sf):
    """More than 500 whitespace words -> first 500 joined by one space."""
    d = fx.read_table(spark, sf, "documents")
    return d.select("doc_id", T.truncate_words("text").alias("text"))


@query("p06_newline_markers", f"""
SELECT doc_id, replace(replace({SQL_TRUNC.format(x='text')}, '<newline>', chr(10)), '< newline >', chr(10)) AS text
FROM documents""")
def p06(spark, sf):
    """P05 then P06: truncation, then newline markers to line breaks."""
    d = fx.read_table(spark, sf, "documents").withColumnRenamed("text", "story")
    return P.truncate_story(d, "story").select("doc_id", F.col("story").alias("text"))


SQL_DONE = """SELECT DISTINCT p.p_ind FROM ({p03}) p JOIN labels b ON b.doc_id = p.line_no
WHERE b.quality = 1 AND p.s_ind = 0"""


@query("p07_generation_requests", with_ctes(["fx_lines"], f"""
SELECT q.p_ind, {SQL_ROLE} AS role,
       {SQL_INSTRUCTION} || trim(q.prompt) AS full_prompt
FROM (SELECT DISTINCT p_ind, prompt FROM ({SQL_P03})) q
WHERE q.p_ind BETWEEN 0 AND 9999 AND q.p_ind NOT IN ({SQL_DONE.format(p03=SQL_P03)})"""))
def p07(spark, sf):
    """Generation requests for prompts of the window not yet done; the
    done list is the prompts whose first line is labelled quality 1."""
    idx = P.index_stories(fx.lines(spark, sf))
    labels = fx.read_table(spark, sf, "labels").filter(F.col("quality") == 1)
    first = idx.filter(F.col("s_ind") == 0)
    done = first.join(labels, first.line_no == labels.doc_id).select("p_ind").distinct()
    prompts = idx.select("p_ind", "prompt").distinct()
    return P.generation_requests(prompts, done, 0, 10000)


@query("p08_story_id", with_ctes(["fx_stories"], "SELECT writer, p_ind, s_ind, s_id FROM fx_stories"))
def p08(spark, sf):
    """Composite story id ``p-s``."""
    st = fx.stories(spark, sf).select("writer", "p_ind", "s_ind")
    return P.with_story_id(st)


@query("p09_project_info", with_ctes(["fx_stories"], "SELECT writer, p_ind, s_ind, s_id, s_pov FROM fx_stories"))
def p09(spark, sf):
    """The info columns used for merging, per writer."""
    st = fx.stories(spark, sf)
    return st.select("writer", *P.project_info(st).columns)


# --- round trips through files derived from the driver tables ------------------

@query("s14_s05_processed_story_roundtrip", with_ctes(["fx_stories"], """
SELECT CAST(p_ind AS INTEGER) AS p_ind, CAST(s_ind AS INTEGER) AS s_ind,
       regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, writer
FROM fx_stories"""))
def s14_s05(spark, sf):
    """S14 then S05: stories written as headerless multi-line CSV under
    prompt-range folders, one root per writer, then scanned back (subfolder
    rule, last row wins, text stripped)."""
    roots = _processed_roots(spark, sf)
    return _per_writer({w: io.read_processed_stories(spark, path) for w, path in roots.items()})


def _processed_roots(spark, sf) -> dict[str, str]:
    """Processed stories of each writer, written under a root of its own."""
    roots = {}
    for w in WRITERS:
        roots[w] = _scratch(spark, "processed")
        st = fx.stories(spark, sf).filter(F.col("writer") == w)
        io.write_processed_stories(st.select(F.col("p_ind").cast("int"), F.col("s_ind").cast("int"), "text"), roots[w],
                                   window=20)
    return roots


def _per_writer(parts: dict):
    """Tables read from the writers' roots, as one with its ``writer``."""
    out = None
    for w, d in parts.items():
        d = d.withColumn("writer", F.lit(w))
        out = d if out is None else out.unionByName(d)
    return out


@query("s06_processed_story_range", with_ctes(["fx_stories"], """
SELECT CAST(p_ind AS INTEGER) AS p_ind, CAST(s_ind AS INTEGER) AS s_ind,
       regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, writer
FROM fx_stories WHERE p_ind >= 10 AND p_ind < 10 + 10000"""))
def s06(spark, sf):
    """The S05 scan restricted to prompts ``start <= p_ind < start + len``
    (start 10, the reference's default length 10000), pushed into the scan."""
    roots = _processed_roots(spark, sf)
    return _per_writer({w: io.read_processed_stories(spark, path, start=10, length=10000) for w, path in roots.items()})


@query("s04_s03_story_mapping_roundtrip", with_ctes(["fx_lines"], f"""
SELECT CAST(p_ind AS INTEGER) AS p_ind, CAST(s_ind AS INTEGER) AS s_ind, prompt, l.story
FROM ({SQL_P03}) i JOIN fx_lines l USING (line_no, prompt)"""))
def s04_s03(spark, sf):
    """P03 -> S04 (one JSON line per story with its indices) -> S03 scan back to
    ``(p_ind, s_ind, prompt, story)``."""
    path = _scratch(spark, "mapping")
    idx = P.index_stories(fx.lines(spark, sf))
    io.write_story_mapping(idx, path)
    return io.read_story_lines(spark, path)


@query("s01_paired_lines", with_ctes(["fx_prompts"], """
SELECT regexp_replace(replace(prompt, chr(10), ' <newline> '), '^\\s+|\\s+$', '', 'g') AS prompt,
       replace(story, chr(10), ' <newline> ') AS story
FROM fx_prompts"""))
def s01(spark, sf):
    """Prompts and stories written as line-aligned text files (line
    breaks inside a text as ``<newline>`` markers), then paired by file and
    line number."""
    p = fx.prompts(spark, sf).select(
        "conv_id", "turn",
        F.replace("prompt", F.lit("\n"), F.lit(" <newline> ")).alias("prompt"),
        F.replace("story", F.lit("\n"), F.lit(" <newline> ")).alias("story"))
    long = p.select("conv_id", "turn", F.lit("prompt").alias("kind"), F.col("prompt").alias("line")).unionByName(
        p.select("conv_id", "turn", F.lit("story").alias("kind"), F.col("story").alias("line")))
    path = _scratch(spark, "lines")
    # one write, partitioned by kind: the same task writes a prompt file and a
    # story file with the same name and the same row order
    long.repartition(4, "conv_id").sortWithinPartitions("conv_id", "turn", "kind").select("kind", "line").write.partitionBy(
        "kind").text(path)
    return io.read_paired_lines(spark, f"{path}/kind=prompt", f"{path}/kind=story").select("prompt", "story")


SQL_E06_KEYED = """
SELECT writer, CAST(p_ind AS INTEGER) AS p_ind, CAST(s_ind AS INTEGER) AS s_ind, CAST(ph_no AS INTEGER) AS ph_no,
       CAST(w_no AS INTEGER) AS w_no, attr
FROM (SELECT s.writer, s.p_ind, s.s_ind, e.* FROM ({e06}) e JOIN fx_stories s ON s.s_key = e.s_key)"""


@query("s15_s07_inferred_attrs_roundtrip", with_ctes(["fx_stories", "fx_phrases"], SQL_E06_KEYED.format(e06=SQL_E06)))
def s15_s07(spark, sf):
    """S15 then S07: phrase lists written as Python list literals in CSV,
    parsed back (never evaluated), then normalised (E06)."""
    st = fx.stories(spark, sf).select("s_key", "writer", "p_ind", "s_ind")
    ph = fx.phrases(spark, sf).join(st, "s_key").select(
        "writer", F.col("p_ind").cast("int"), F.col("s_ind").cast("int"), F.col("phrases").alias("attrs"))
    parts = {}
    for w in WRITERS:
        path = _scratch(spark, "attrs")
        io.write_inferred_attrs(ph.filter(F.col("writer") == w), path, as_csv=True, window=20)
        parts[w] = io.read_inferred_attrs(spark, path)
    return _normalise_keyed(_per_writer(parts))


def _normalise_keyed(back):
    """E06 on ``(writer, p_ind, s_ind, attrs)``."""
    p = back.select("writer", "p_ind", "s_ind", F.posexplode("attrs").alias("ph_no", "ph"))
    w = p.select("writer", "p_ind", "s_ind", "ph_no", F.posexplode(T.whitespace_words(F.lower(T.strip_ascii_punctuation("ph")))).alias(
        "w_no", "attr"))
    return w.select("writer", "p_ind", "s_ind", F.col("ph_no").cast("int"), F.col("w_no").cast("int"), "attr")


@query("s08_lexicon_scan", with_ctes(["fx_lexicon"], """
SELECT 'mixed' AS dim, word, score, ord FROM fx_lexicon WHERE dim = 'arousal'"""), floats=["score"])
def s08(spark, sf):
    """A header CSV lexicon (the valence rows, then the same words again
    with arousal scores) read back: last duplicate wins at the first one's
    position."""
    lex = fx.lexicon(spark, sf)
    rows = lex.filter(F.col("dim") == "valence").select("word", "score", F.lit(0).alias("blk"), "ord").unionByName(
        lex.filter(F.col("dim") == "arousal").select("word", "score", F.lit(1).alias("blk"), "ord"))
    path = _scratch(spark, "lexicon")
    # a lexicon file is one small file (bounded by the vocabulary)
    rows.orderBy("blk", "ord").coalesce(1).select("word", "score").write.option("header", "true").csv(path)
    return io.read_lexicon(spark, path, "mixed")


@query("s09_vector_lookup", with_ctes(["fx_stories", "fx_vocab"], """
SELECT w, w IN (SELECT word FROM fx_vocab) AS has_vec
FROM (SELECT DISTINCT lower(attr) AS w FROM (
  SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS attr FROM fx_stories))"""))
def s09(spark, sf):
    """Vector lookup of every distinct lower-cased story token."""
    words = A.all_attrs(fx.stories(spark, sf)).select(F.lower("attr").alias("w")).distinct()
    return io.lookup_vectors(words, fx.vectors(spark, sf), "w").select("w", F.col("vec").isNotNull().alias("has_vec"))


@query("s10_story_info_scan", with_ctes(["fx_stories"], """
SELECT writer, CAST(p_ind AS INTEGER) AS p_ind, CAST(s_ind AS INTEGER) AS s_ind, s_id, p_pov, s_pov FROM fx_stories"""))
def s10(spark, sf):
    """Story info written as gzip CSV with a header and read back."""
    parts = {}
    for w in WRITERS:
        info = fx.story_info(spark, sf).filter(F.col("writer") == w).select(
            F.col("p_ind").cast("int"), F.col("s_ind").cast("int"), "s_id", "p_pov", "s_pov")
        path = _scratch(spark, "info")
        info.write.option("header", "true").option("compression", "gzip").csv(path)
        parts[w] = io.read_story_info(spark, path)
    return _per_writer(parts)


@query("s13_scores_by_pov", with_ctes(["fx_stories", "fx_lexicon"], """
SELECT writer, dim, s_pov AS pov, CAST(p_ind AS INTEGER) AS p_ind, CAST(s_ind AS INTEGER) AS s_ind, score FROM scores""", [("attrs", SQL_ATTRS_ALL), *sql_avg_scores(["all"])]), floats=["score"])
def s13(spark, sf):
    """Scores of each dimension written one folder per POV label, under a
    root per writer, and read back."""
    sc = C.grid_scores(spark, sf, ams=["all"], sms=["avg"]).select(
        "writer", "dim", F.col("s_pov").alias("pov"), F.col("p_ind").cast("int"), F.col("s_ind").cast("int"), "score")
    parts = {}
    for w in WRITERS:
        path = _scratch(spark, "bypov")
        io.write_scores_by_pov(sc.filter(F.col("writer") == w), path)
        parts[w] = spark.read.parquet(path).select("dim", "pov", "p_ind", "s_ind", "score")
    return _per_writer(parts)


@query("s17_generated_story_sink", with_ctes(["fx_lines"], f"""
SELECT r.p_ind, {SQL_ROLE} AS role,
       {SQL_INSTRUCTION} || trim(r.prompt) AS full_prompt, r.story
FROM ({SQL_P03}) r0 JOIN (SELECT i.p_ind, i.prompt, l.story FROM ({SQL_P03}) i JOIN fx_lines l USING (line_no)
                          WHERE i.s_ind = 0) r ON r.p_ind = r0.p_ind AND r0.s_ind = 0
WHERE r.p_ind NOT IN ({SQL_DONE.format(p03=SQL_P03)})"""))
def s17(spark, sf):
    """Generation requests (P07) with a story attached (each prompt's
    first human-written line stands in for the external generator) appended
    to the generated-story table and read back."""
    idx = P.index_stories(fx.lines(spark, sf))
    labels = fx.read_table(spark, sf, "labels").filter(F.col("quality") == 1)
    first = idx.filter(F.col("s_ind") == 0)
    done = first.join(labels, first.line_no == labels.doc_id).select("p_ind").distinct()
    req = P.generation_requests(idx.select("p_ind", "prompt").distinct(), done, 0, 10000)
    gen = req.join(first.select("p_ind", "story"), "p_ind")
    path = _scratch(spark, "generated")
    io.write_generated(gen, path)
    return spark.read.parquet(path).select("p_ind", "role", "full_prompt", "story")


@query("s03_story_mapping_objects", with_ctes(["fx_lines"], f"""
SELECT CAST(i.p_ind AS INTEGER) AS p_ind, CAST(i.s_ind AS INTEGER) AS s_ind, i.prompt, l.story
FROM ({SQL_P03}) i JOIN fx_lines l USING (line_no, prompt)"""))
def s03(spark, sf):
    """P03 -> S04 as JSON objects (prompt -> ordered stories, a few prompts per
    file) -> S03 scan with prompts numbered by file then object order."""
    path = _scratch(spark, "mapping-obj")
    idx = P.index_stories(fx.lines(spark, sf))
    io.write_story_mapping_objects(idx, path, prompts_per_file=7)
    return io.read_story_mapping(spark, path)
