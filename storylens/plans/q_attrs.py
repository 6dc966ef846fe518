"""Queries for attribute extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from storylens.operators import attrs as A
from storylens.plans.oracle_fixtures import with_ctes
from storylens.plans.registry import query
from storylens.plans.sqlparts import (
    PROT_SQL,
    SQL_ATTRS_ALL,
    SQL_ATTRS_COMET,
    SQL_ATTRS_SUB,
    SQL_E02,
    SQL_E03,
    SQL_E03_ANC,
    SQL_E06,
)
from storylens.sources import fixtures as fx


@query("e01_all_attrs", with_ctes(["fx_stories"], """
SELECT s_key, CAST(ord AS INTEGER) AS ord, attr
FROM (SELECT s_key, unnest(ws) AS attr, unnest(range(len(ws))) AS ord
      FROM (SELECT s_key, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM fx_stories))"""))
def e01(spark, sf):
    """Every whitespace token of every story, original case."""
    return A.all_attrs(fx.stories(spark, sf)).select("s_key", F.col("ord").cast("int").alias("ord"), "attr")


@query("e02_subject_heads", with_ctes(["fx_tokens"], f"SELECT s_key, ord, attr FROM ({SQL_E02})"))
def e02(spark, sf):
    """Protagonist nsubj -> head text when the head is VB* or JJ."""
    s = A.sub_attrs_from_sentences(fx.sentences(spark, sf), fx.FIXTURE_PROTAGONIST)
    return s.filter(F.col("rule") == "E02").select("s_key", "ord", "attr")


@query("e03_amod_ancestors", with_ctes(["fx_tokens"], f"SELECT s_key, ord, attr FROM ({SQL_E03})",
                                       [("anc", SQL_E03_ANC)], recursive=True))
def e03(spark, sf):
    """Amod tokens with a protagonist among their ancestors."""
    s = A.sub_attrs_from_sentences(fx.sentences(spark, sf), fx.FIXTURE_PROTAGONIST)
    return s.filter(F.col("rule") == "E03").select("s_key", "ord", "attr")


@query("e04_sub_attrs", with_ctes(["fx_tokens"], f"""
SELECT s_key, ord, attr, rule FROM ({SQL_E02}) UNION ALL SELECT s_key, ord, attr, rule FROM ({SQL_E03})""",
                                  [("anc", SQL_E03_ANC)], recursive=True))
def e04(spark, sf):
    """The sub attribute list (E02 and E03 in token order, duplicates
    kept), from the long token table (one shuffle into sentences)."""
    return A.sub_attrs(fx.tokens(spark, sf), fx.FIXTURE_PROTAGONIST)


@query("e05_gated_sentences", with_ctes(["fx_tokens"], f"""
SELECT r.s_key, r.sent_id, s.sentence
FROM fx_tokens r
JOIN (SELECT s_key, sent_id, string_agg(text, ' ' ORDER BY pos) AS sentence FROM fx_tokens GROUP BY s_key, sent_id) s
  ON s.s_key = r.s_key AND s.sent_id = r.sent_id
WHERE r.dep = 'ROOT' AND EXISTS (
  SELECT 1 FROM fx_tokens c WHERE c.s_key = r.s_key AND c.head_pos = r.pos AND c.pos <> r.pos
    AND c.dep IN ('nsubj', 'nsubjpass') AND c.text IN ({PROT_SQL}))"""))
def e05(spark, sf):
    """Sentences whose root has a protagonist subject: the request table
    for the commonsense model."""
    return A.gated_from_sentences(fx.sentences(spark, sf), fx.FIXTURE_PROTAGONIST)


@query("e06_phrase_words", with_ctes(["fx_phrases"], SQL_E06))
def e06(spark, sf):
    """Inferred phrases -> punctuation removed, lower-cased, split, flattened."""
    w = A.normalise_phrases(fx.phrases(spark, sf))
    return w.select("s_key", F.col("ph_no").cast("int").alias("ph_no"), F.col("w_no").cast("int").alias("w_no"), "attr")


@query("e07_align_stories", with_ctes(["fx_stories"], """
SELECT s.writer, s.p_ind, s.s_ind, coalesce(p.text, '') AS text
FROM fx_stories s
LEFT JOIN (SELECT f.writer, f.p_ind, f.s_ind, f.text FROM fx_stories f JOIN labels b ON b.doc_id = f.s_key) p
  ON p.writer = s.writer AND p.p_ind = s.p_ind AND p.s_ind = s.s_ind"""))
def e07(spark, sf):
    """Every story of the mapping gets its processed text, or ''
    when none was produced (processed = the labelled stories)."""
    st = fx.stories(spark, sf)
    labels = fx.read_table(spark, sf, "labels").select(F.col("doc_id").alias("s_key"))
    processed = st.join(labels, "s_key", "left_semi").select("writer", "p_ind", "s_ind", "text")
    return A.align_to_stories(st.select("writer", "p_ind", "s_ind"), processed, "text", F.lit(""))


METHOD_NAMES = ["full", "all", "sub", "comet"]


@query("e08_method_choice", with_ctes(["fx_stories", "fx_tokens", "fx_phrases"], """
SELECT m.method, m.am, a.s_key, count(*) AS n_attrs
FROM (VALUES ('full', 'all'), ('all', 'all'), ('sub', 'sub'), ('comet', 'comet')) m(method, am)
JOIN attrs a ON a.am = m.am
GROUP BY m.method, m.am, a.s_key""", [("anc", SQL_E03_ANC), ("attrs", f"""
{SQL_ATTRS_ALL}
UNION ALL {SQL_ATTRS_SUB.format(e02=SQL_E02, e03=SQL_E03)}
UNION ALL {SQL_ATTRS_COMET.format(e06=SQL_E06)}""")], recursive=True))
def e08(spark, sf):
    """Method names resolved by the method check (``full`` is ``all``;
    unknown names raise), then attribute counts per story for each name."""
    from storylens.plans.common import attrs_for

    resolved = [(name, A.check_attr_method(name)) for name in METHOD_NAMES]
    names = spark.createDataFrame(resolved, "method string, am string")
    counts = attrs_for(spark, sf).groupBy("am", "s_key").agg(F.count(F.lit(1)).alias("n_attrs"))
    return F.broadcast(names).join(counts, "am").select("method", "am", "s_key", "n_attrs")
