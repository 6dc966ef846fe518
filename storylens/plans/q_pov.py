"""Queries for point of view (V01-V06, P13), character replacement
(A01-A07) and the annotation contract (U01)."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import functions as F

from storylens.constants import CHARACTER_PRONOUNS, PLACEHOLDER_PREFIX
from storylens.operators import cleaning as P
from storylens.operators import pov as V
from storylens.operators import replace as R
from storylens.operators.annotate import TOKENS_SCHEMA, annotate_with_model
from storylens.plans.oracle_fixtures import CTES, with_ctes
from storylens.plans.registry import query
from storylens.sources import fixtures as fx


def _fixture_pronouns(spark, lists=fx.FIXTURE_POV_PRONOUNS):
    return V.pronoun_table(spark, lists=lists)


SQL_PRON = """SELECT * FROM (VALUES ('first', 'click'), ('second', 'view'), ('male', 'purchase'),
                              ('female', 'signup')) p(cls, surface)"""

SQL_V01 = """
SELECT s_key, cluster_id, n FROM (
  SELECT s_key, cluster_id, count(*) AS n,
         row_number() OVER (PARTITION BY s_key ORDER BY count(*) DESC, cluster_id ASC) AS rk
  FROM fx_pov_mentions GROUP BY s_key, cluster_id) WHERE rk = 1"""

SQL_V03 = f"""
SELECT u.s_key, coalesce(l.pov, 'unknown') AS pov FROM fx_pov_stories u LEFT JOIN (
  SELECT s_key, CASE
      WHEN n_first > n // 2 THEN 'first_person'
      WHEN n_second > n // 2 THEN 'second_person'
      WHEN has_male AND NOT has_female THEN 'male'
      WHEN has_female AND NOT has_male THEN 'female'
      ELSE 'unknown' END AS pov
  FROM (SELECT m.s_key, count(*) AS n, count(*) FILTER (WHERE p.cls = 'first') AS n_first,
               count(*) FILTER (WHERE p.cls = 'second') AS n_second,
               bool_or(coalesce(p.cls = 'male', false)) AS has_male, bool_or(coalesce(p.cls = 'female', false)) AS has_female
        FROM fx_pov_mentions m JOIN ({SQL_V01}) b ON b.s_key = m.s_key AND b.cluster_id = m.cluster_id
        LEFT JOIN ({SQL_PRON}) p ON p.surface = m.surface GROUP BY m.s_key)) l ON l.s_key = u.s_key"""


@query("v01_largest_cluster", with_ctes(["fx_pov_mentions"], SQL_V01))
def v01(spark, sf):
    """The cluster with most mentions per story, first on a tie."""
    return V.largest_cluster(fx.pov_mentions(spark, sf))


@query("v02_mention_surfaces", with_ctes(["fx_tokens", "fx_mentions"], """
SELECT m.s_key, m.cluster_id, m.mention_no, m.start, m."end", string_agg(t.text, ' ' ORDER BY t.pos) AS surface,
       m.start AS span_start, CASE WHEN m.start = m."end" THEN m.start ELSE m."end" + 1 END AS span_end
FROM fx_mentions m JOIN fx_tokens t ON t.s_key = m.s_key AND t.pos BETWEEN m.start AND m."end"
GROUP BY m.s_key, m.cluster_id, m.mention_no, m.start, m."end\""""))
def v02(spark, sf):
    """Mention surface from the token range, and the half-open span."""
    m = fx.mentions(spark, sf).drop("surface")
    return V.mention_surfaces(fx.tokens(spark, sf), m)


@query("v03_pov_extended", with_ctes(["fx_pov_stories", "fx_pov_mentions"], SQL_V03))
def v03(spark, sf):
    """The POV rule on the largest cluster (pronoun table as a parameter;
    the fixture table maps event types to the four classes)."""
    return V.pov_labels(fx.pov_stories(spark, sf), fx.pov_mentions(spark, sf), _fixture_pronouns(spark))


SQL_V04 = SQL_V03.replace(SQL_PRON, SQL_PRON + " WHERE cls <> 'female'")


@query("v04_pov_basic", with_ctes(["fx_pov_stories", "fx_pov_mentions"], SQL_V04))
def v04(spark, sf):
    """The rule of the story fallback with its own, shorter pronoun table
    (in the stand-in table: no female surface)."""
    return V.pov_labels(fx.pov_stories(spark, sf), fx.pov_mentions(spark, sf),
                        _fixture_pronouns(spark, fx.FIXTURE_POV_BASIC))


@query("v05_prompt_pov", with_ctes(["fx_pov_stories", "fx_pov_mentions"],
                                  f"SELECT s_key AS p_key, pov FROM ({SQL_V03})"))
def v05(spark, sf):
    """The rule on prompt texts (units keyed ``p_key``)."""
    units = fx.pov_stories(spark, sf).withColumnRenamed("s_key", "p_key")
    m = fx.pov_mentions(spark, sf).withColumnRenamed("s_key", "p_key")
    return V.pov_labels(units, m, _fixture_pronouns(spark), key="p_key")


@query("p13_pov_label_map", with_ctes(["fx_pov_stories", "fx_pov_mentions"], f"""
SELECT s_key, pov, CASE pov WHEN 'male' THEN 'TP-M' WHEN 'female' THEN 'TP-F' WHEN 'first_person' THEN 'FP'
                   WHEN 'second_person' THEN 'SP' WHEN 'unknown' THEN 'Other' END AS s_pov FROM ({SQL_V03})"""))
def p13(spark, sf):
    """Rule labels mapped to analysis labels."""
    lab = V.pov_labels(fx.pov_stories(spark, sf), fx.pov_mentions(spark, sf), _fixture_pronouns(spark))
    return P.map_pov_label(lab)


# V06 inputs: stories keyed by document with prompt = source and s_ind from
# P03; the cache holds the labelled documents (prompt spelled with a leading
# space when toxic = 1; story altered when quality = 0; label by quality).
SQL_V06 = """
WITH idx AS (
  SELECT l.line_no AS s_key, l.prompt, CAST(row_number() OVER (PARTITION BY l.prompt ORDER BY l.line_no) - 1 AS BIGINT) AS s_ind,
         l.story FROM fx_lines l),
cache AS (
  SELECT CASE WHEN b.toxic = 1 THEN ' ' || i.prompt ELSE i.prompt END AS prompt, i.s_ind,
         CASE WHEN b.quality = 1 THEN i.story ELSE i.story || ' (edited)' END AS story,
         CASE WHEN b.quality = 1 THEN 'female' ELSE 'male' END AS pov
  FROM idx i JOIN labels b ON b.doc_id = i.s_key),
keys AS (SELECT DISTINCT prompt FROM cache),
chosen AS (
  SELECT i.*, CASE WHEN i.prompt IN (SELECT prompt FROM keys) THEN i.prompt
                   WHEN ' ' || i.prompt IN (SELECT prompt FROM keys) THEN ' ' || i.prompt END AS ck FROM idx i),
computed AS (SELECT * FROM (%s))
SELECT ch.s_key,
       CASE WHEN c.story IS NOT NULL AND regexp_replace(ch.story, '^\\s+|\\s+$', '', 'g') = regexp_replace(c.story, '^\\s+|\\s+$', '', 'g')
            THEN c.pov ELSE coalesce(cp.pov, 'unknown') END AS pov,
       CASE WHEN c.story IS NOT NULL AND regexp_replace(ch.story, '^\\s+|\\s+$', '', 'g') = regexp_replace(c.story, '^\\s+|\\s+$', '', 'g')
            THEN 'cache' ELSE 'computed' END AS source
FROM chosen ch LEFT JOIN cache c ON c.prompt = ch.ck AND c.s_ind = ch.s_ind
LEFT JOIN computed cp ON cp.s_key = ch.s_key"""


def _v06_sql() -> str:
    base = with_ctes(["fx_lines", "fx_pov_stories", "fx_pov_mentions"], "SELECT 1")
    ctes = base[len("WITH "):base.rindex("\nSELECT 1")]
    body = SQL_V06 % SQL_V04
    return "WITH " + ctes + ",\n" + body[len("WITH "):]


@query("v06_cached_pov", _v06_sql())
def v06(spark, sf):
    """Cached label when the prompt (or space + prompt) and the stripped
    story match the cache; the misses alone, truncated, get the rule's label
    (from the stand-in mentions of their keys)."""
    idx = P.index_stories(fx.lines(spark, sf)).select(
        F.col("line_no").alias("s_key"), "prompt", "s_ind", "story")
    labels = fx.read_table(spark, sf, "labels")
    cache = idx.join(labels, idx.s_key == labels.doc_id).select(
        F.when(F.col("toxic") == 1, F.concat(F.lit(" "), F.col("prompt"))).otherwise(F.col("prompt")).alias("prompt"),
        "s_ind",
        F.when(F.col("quality") == 1, F.col("story")).otherwise(F.concat(F.col("story"), F.lit(" (edited)"))).alias("story"),
        F.when(F.col("quality") == 1, F.lit("female")).otherwise(F.lit("male")).alias("pov"),
    )

    def label(misses):
        mentions = fx.pov_mentions(spark, sf).join(misses.select("s_key"), "s_key", "left_semi")
        return V.pov_labels(misses, mentions, _fixture_pronouns(spark, fx.FIXTURE_POV_BASIC))

    return V.cached_pov(idx, cache, label)


# --- replacement ----------------------------------------------------------------

def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


NARROW = _quoted(CHARACTER_PRONOUNS["narrow"])
SQL_A02 = f"""
SELECT s_key, cluster_id, CAST(row_number() OVER (PARTITION BY s_key ORDER BY cluster_id) - 1 AS INTEGER) AS letter_no
FROM (SELECT DISTINCT m.s_key, m.cluster_id FROM fx_mentions m
      WHERE m.surface IN ({NARROW})
         OR EXISTS (SELECT 1 FROM fx_entities e WHERE e.s_key = m.s_key AND e.text = m.surface AND e.label = 'PERSON'))"""


@query("a01_person_entities", with_ctes(["fx_entities"], "SELECT DISTINCT s_key, text FROM fx_entities WHERE label = 'PERSON'"))
def a01(spark, sf):
    """Distinct PERSON entities per story."""
    return R.person_entities(fx.entities(spark, sf))


@query("a02_character_clusters", with_ctes(["fx_entities"], f"SELECT s_key, cluster_id FROM ({SQL_A02})"))
def a02(spark, sf):
    """Clusters with a PERSON mention or a listed pronoun (narrow list)."""
    return R.character_clusters(spark, fx.mentions(spark, sf), fx.entities(spark, sf)).select("s_key", "cluster_id")


@query("a02_character_clusters_wide", with_ctes(["fx_entities"], f"SELECT s_key, cluster_id FROM ({SQL_A02})".replace(
    NARROW, _quoted(CHARACTER_PRONOUNS["wide"]))))
def a02_wide(spark, sf):
    """A02 with the wide pronoun list."""
    return R.character_clusters(spark, fx.mentions(spark, sf), fx.entities(spark, sf), "wide").select("s_key", "cluster_id")


@query("a03_cluster_letters", with_ctes(["fx_entities"], f"""
SELECT s_key, cluster_id, letter_no, 'Protagonist' || chr(65 + letter_no) AS label FROM ({SQL_A02})"""))
def a03(spark, sf):
    """The n-th surviving cluster is ``Protagonist`` + chr(65 + n)."""
    return R.character_clusters(spark, fx.mentions(spark, sf), fx.entities(spark, sf)).select(
        "s_key", "cluster_id", "letter_no", "label")


# --- U01 ------------------------------------------------------------------------

def _load_fixture_parser():
    """A stand-in model: the fixture's tags and dependencies."""
    return {"tags": ["VBD", "JJ", "VBZ", "NN", "NN"], "deps": {0: "nsubj", 1: "amod", 2: "poss", 3: "nsubjpass"}}


def _run_fixture_parser(model, texts: list[str]) -> list[list[tuple]]:
    """Whitespace tokens, 32-token sentences, heap-shaped heads."""
    out = []
    for text in texts:
        rows = []
        for pos, tok in enumerate(text.split()):
            k = pos % 32 + 1
            head = pos if k == 1 else (pos // 32) * 32 + k // 2 - 1
            dep = "ROOT" if k == 1 else model["deps"].get(pos % 7, "dep")
            rows.append((pos // 32, pos, tok, model["tags"][pos % 5], dep, head))
        out.append(rows)
    return out


@query("u01_annotate_tokens", with_ctes(["fx_tokens"], "SELECT * FROM fx_tokens"))
def u01(spark, sf):
    """Stories annotated by a caller-supplied model (here a stand-in
    parser with the fixture's rules), loaded once a worker."""
    return annotate_with_model(fx.stories(spark, sf), "fixture-parser", _load_fixture_parser, _run_fixture_parser, TOKENS_SCHEMA)


__all__ = ["CTES"]


SQL_A04 = f"""
WITH RECURSIVE {{ctes}},
keep AS ({SQL_A02}),
spans AS (SELECT m.s_key, k.letter_no, m.mention_no, m.start, m."end" FROM fx_mentions m JOIN keep k USING (s_key, cluster_id)),
ncl AS (SELECT s_key, max(letter_no) AS mx FROM keep GROUP BY s_key),
walk AS (
  SELECT t.s_key, t.pos AS p, 0 AS r, CAST(t.pos AS BIGINT) AS cur, -1 AS lab, CAST(-1 AS BIGINT) AS labpos
  FROM fx_tokens t JOIN ncl USING (s_key)
  UNION ALL
  SELECT w.s_key, w.p, w.r + 1, coalesce(w.tgt, w.cur),
         CASE WHEN w.tgt IS NOT NULL AND w.tgt > w.labpos THEN w.r ELSE w.lab END,
         CASE WHEN w.tgt IS NOT NULL AND w.tgt > w.labpos THEN w.tgt ELSE w.labpos END
  FROM (SELECT w.*, (SELECT CASE WHEN sp.start <= w.cur AND w.cur < sp."end" THEN sp."end" ELSE sp.start END
                     FROM spans sp WHERE sp.s_key = w.s_key AND sp.letter_no = w.r
                       AND ((sp.start <= w.cur AND w.cur < sp."end") OR sp.start = w.cur)
                     ORDER BY sp.mention_no LIMIT 1) AS tgt
        FROM walk w JOIN ncl n ON n.s_key = w.s_key WHERE w.r <= n.mx) w)
SELECT w.s_key, CAST(w.p AS INTEGER) AS pos, w.cur AS final, CAST(w.lab AS INTEGER) AS letter_no
FROM walk w JOIN ncl n ON n.s_key = w.s_key AND w.r = n.mx + 1
UNION ALL
SELECT t.s_key, t.pos, CAST(t.pos AS BIGINT), -1 FROM fx_tokens t WHERE t.s_key NOT IN (SELECT s_key FROM ncl)"""


def _a04_sql() -> str:
    base = with_ctes(["fx_tokens", "fx_mentions", "fx_entities"], "SELECT 1")
    ctes = base[len("WITH "):base.rindex("\nSELECT 1")]
    return SQL_A04.replace("{ctes}", ctes)


@query("a04_span_steps", _a04_sql())
def a04(spark, sf):
    """For every token position, the position the span step moves to and
    the cluster whose placeholder is written there (-1: none)."""
    return R.span_steps(spark, fx.tokens(spark, sf), fx.mentions(spark, sf), fx.entities(spark, sf))


def _a05_sql(doublings: int = 15) -> str:
    """From the steps of A04: every position's output and successor, the
    positions reached from 0 by pointer doubling, and their outputs in order.
    A story fails if a reached step ends past its tokens."""
    base = with_ctes(["fx_tokens", "fx_mentions", "fx_entities", "fx_stories"], "SELECT 1")
    a04 = SQL_A04.replace("{ctes}", base[len("WITH "):base.rindex("\nSELECT 1")])
    cut = a04.rindex("\nSELECT w.s_key, CAST(w.p AS INTEGER)")
    ctes = [f"""
steps AS MATERIALIZED ({a04[cut:]}),
outs AS MATERIALIZED (
  SELECT t.s_key, CAST(t.pos AS BIGINT) AS pos, CASE WHEN st.letter_no < 0 THEN t.pos + 1 ELSE st.final + 1 END AS nxt,
         CASE WHEN st.letter_no < 0 THEN t.text
              ELSE '{PLACEHOLDER_PREFIX}' || chr(65 + st.letter_no)
                   || CASE WHEN e.dep IN ('poss', 'case') THEN chr(39) || 's' ELSE '' END END AS out,
         st.letter_no >= 0 AND e.pos IS NULL AS failed
  FROM fx_tokens t JOIN steps st ON st.s_key = t.s_key AND st.pos = t.pos
  LEFT JOIN fx_tokens e ON e.s_key = t.s_key AND e.pos = st.final),
j0 AS MATERIALIZED (SELECT s_key, pos, nxt FROM outs),
v0 AS MATERIALIZED (SELECT DISTINCT s_key, CAST(0 AS BIGINT) AS pos FROM outs)"""]
    for k in range(doublings):
        ctes.append(f"""
v{k + 1} AS MATERIALIZED (SELECT s_key, pos FROM v{k} UNION SELECT v.s_key, j.nxt FROM v{k} v JOIN j{k} j USING (s_key, pos)),
j{k + 1} AS MATERIALIZED (SELECT a.s_key, a.pos, b.nxt FROM j{k} a JOIN j{k} b ON b.s_key = a.s_key AND b.pos = a.nxt)""")
    return a04[:cut] + "," + ",".join(ctes) + f"""
SELECT s.s_key, coalesce(r.text, '') AS text FROM fx_stories s LEFT JOIN (
  SELECT o.s_key, CASE WHEN bool_or(o.failed) THEN '' ELSE string_agg(o.out, ' ' ORDER BY o.pos) || chr(10) END AS text
  FROM outs o JOIN v{doublings} v ON v.s_key = o.s_key AND v.pos = o.pos GROUP BY o.s_key) r ON r.s_key = s.s_key"""


@query("a05_replace_characters", _a05_sql())
def a05(spark, sf):
    """The rewritten text of every story (placeholders, possessives,
    failures as ''), over the fixture annotations."""
    st = fx.stories(spark, sf)
    return R.replace_characters(spark, st, fx.token_arrays(spark, sf), fx.mentions(spark, sf), fx.entities(spark, sf))
