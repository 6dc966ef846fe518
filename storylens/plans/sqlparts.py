"""SQL building blocks shared by the DuckDB twins."""

from __future__ import annotations

from storylens.constants import DIMENSIONS

# --- SQL building blocks -------------------------------------------------------

DIMS_SQL = ", ".join(f"('{d}')" for d in DIMENSIONS)

SQL_ATTRS_ALL = """
SELECT s_key, 'all' AS am, attr
FROM (SELECT s_key, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS attr
      FROM fx_stories)"""

SQL_COUNTS = """SELECT s_key, am, lower(attr) AS w, count(*) AS n FROM attrs GROUP BY s_key, am, lower(attr)"""
SQL_TOTALS = """SELECT s_key, am, sum(n) AS n_all FROM counts GROUP BY s_key, am"""
SQL_MODES = """SELECT dim, count(DISTINCT score) = 1 AS unipolar FROM fx_lexicon GROUP BY dim"""
SQL_AVG_FOUND = """
SELECT c.s_key, c.am, l.dim, 'avg' AS sm, sum(c.n * l.score) AS num, sum(c.n) AS den
FROM counts c JOIN fx_lexicon l ON c.w = l.word GROUP BY c.s_key, c.am, l.dim"""


def sql_avg_scores(ams: list[str]) -> list[tuple[str, str]]:
    ams_sql = ", ".join(f"('{a}')" for a in ams)
    return [
        ("counts", SQL_COUNTS),
        ("totals", SQL_TOTALS),
        ("modes", SQL_MODES),
        ("found", SQL_AVG_FOUND),
        ("scores", f"""
SELECT g.s_key, g.p_ind, g.s_ind, g.writer, g.s_id, g.s_pov, g.p_pov, g.am, g.dim, 'avg' AS sm,
       CASE WHEN m.unipolar THEN coalesce(CASE WHEN t.n_all > 0 THEN f.num / t.n_all END, 0.0)
            ELSE coalesce(CASE WHEN f.den > 0 THEN f.num / f.den END, 0.0) END AS score
FROM (SELECT s.*, a.am, d.dim FROM fx_stories s, (VALUES {ams_sql}) a(am), (VALUES {DIMS_SQL}) d(dim)) g
LEFT JOIN found f ON f.s_key = g.s_key AND f.am = g.am AND f.dim = g.dim
LEFT JOIN totals t ON t.s_key = g.s_key AND t.am = g.am
LEFT JOIN modes m ON m.dim = g.dim"""),
    ]


SQL_Z = """
SELECT *, CASE WHEN stddev_pop(score) OVER (PARTITION BY dim, am, sm) > 0
               THEN (score - avg(score) OVER (PARTITION BY dim, am, sm))
                    / stddev_pop(score) OVER (PARTITION BY dim, am, sm) END AS z_score
FROM scores"""




# --- attribute extraction over fx_tokens / fx_phrases ---------------------------

PROT_SQL = "'the', 'The', 'of', 'de', 'la'"

SQL_E02 = f"""
SELECT t.s_key, t.pos AS ord, h.text AS attr, 'E02' AS rule
FROM fx_tokens t JOIN fx_tokens h ON h.s_key = t.s_key AND h.pos = t.head_pos
WHERE t.dep = 'nsubj' AND t.text IN ({PROT_SQL}) AND (starts_with(h.tag, 'VB') OR h.tag = 'JJ')"""

SQL_E03_ANC = """
SELECT s_key, pos, head_pos AS cur FROM fx_tokens WHERE dep = 'amod'
UNION ALL
SELECT a.s_key, a.pos, t.head_pos FROM anc a JOIN fx_tokens t ON t.s_key = a.s_key AND t.pos = a.cur
WHERE t.head_pos <> t.pos"""

SQL_E03 = f"""
SELECT t.s_key, t.pos AS ord, t.text AS attr, 'E03' AS rule
FROM fx_tokens t
WHERE t.dep = 'amod' AND EXISTS (
  SELECT 1 FROM anc a JOIN fx_tokens x ON x.s_key = a.s_key AND x.pos = a.cur
  WHERE a.s_key = t.s_key AND a.pos = t.pos AND x.text IN ({PROT_SQL}))"""

PUNCT_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"

SQL_E06 = f"""
SELECT s_key, CAST(ph_no AS INTEGER) AS ph_no, CAST(w_no AS INTEGER) AS w_no, attr
FROM (SELECT s_key, ph_no, unnest(ws) AS attr, unnest(range(len(ws))) AS w_no
      FROM (SELECT s_key, ph_no,
                   list_filter(regexp_split_to_array(lower(translate(ph, {PUNCT_SQL}, '')), '\\s+'),
                               lambda x: x <> '') AS ws
            FROM (SELECT s_key, unnest(phrases) AS ph, unnest(range(len(phrases))) AS ph_no FROM fx_phrases)))"""


# --- vector scoring ----------------------------------------------------------------

def _unit(col: str) -> str:
    return (f"CASE WHEN list_dot_product({col}, {col}) > 0 "
            f"THEN list_transform({col}, lambda x: x / sqrt(list_dot_product({col}, {col}))) "
            f"ELSE list_transform({col}, lambda x: 0.0) END")


def _cos(a: str, b: str) -> str:
    return (f"CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 "
            f"THEN list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) "
            f"ELSE 0.0 END")


SQL_VECTOR_BASE = [
    ("vecs", "SELECT word, CAST(vec AS DOUBLE[]) AS vec FROM fx_vocab"),
    ("bounds", """SELECT dim, quantile_cont(score, 0.25) AS lb, quantile_cont(score, 0.75) AS ub
FROM fx_lexicon GROUP BY dim"""),
    ("poles", """
SELECT l.dim, 'low' AS side, l.word, l.ord, v.vec FROM fx_lexicon l JOIN bounds b ON b.dim = l.dim
JOIN vecs v ON v.word = lower(l.word) WHERE l.score <= b.lb AND l.word IN (SELECT word FROM vecs)
UNION ALL
SELECT l.dim, 'high' AS side, l.word, l.ord, v.vec FROM fx_lexicon l JOIN bounds b ON b.dim = l.dim
JOIN vecs v ON v.word = lower(l.word) WHERE l.score >= b.ub AND l.word IN (SELECT word FROM vecs)"""),
    ("upoles", f"SELECT dim, side, word, ord, vec, {_unit('vec')} AS u FROM poles"),
]

# sequential greedy choice (the definition), as a recursive CTE: the smaller
# pole chooses in lexicon order; each takes its most similar free partner.
SQL_PAIRS = [
    ("sizes", """SELECT dim, count(*) FILTER (WHERE side = 'low') AS n_low,
       count(*) FILTER (WHERE side = 'high') AS n_high FROM poles GROUP BY dim
HAVING count(*) FILTER (WHERE side = 'low') > 0 AND count(*) FILTER (WHERE side = 'high') > 0"""),
    ("roles", "SELECT dim, CASE WHEN n_low <= n_high THEN 'low' ELSE 'high' END AS chooser FROM sizes"),
    ("ch", """SELECT u.dim, u.word, u.ord, u.u, row_number() OVER (PARTITION BY u.dim ORDER BY u.ord) AS k
FROM upoles u JOIN roles r ON r.dim = u.dim AND u.side = r.chooser"""),
    ("pa", "SELECT u.dim, u.word, u.ord, u.u FROM upoles u JOIN roles r ON r.dim = u.dim AND u.side <> r.chooser"),
    ("sims", """SELECT c.dim, c.k, p.ord AS pord, list_dot_product(c.u, p.u) AS sim
FROM ch c JOIN pa p ON p.dim = c.dim"""),
    ("nch", "SELECT dim, max(k) AS mk FROM ch GROUP BY dim"),
    ("greedy", """
SELECT dim, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken FROM roles
UNION ALL
SELECT g.dim, g.k + 1, list_append(g.taken, (
    SELECT s.pord FROM sims s WHERE s.dim = g.dim AND s.k = g.k + 1 AND NOT list_contains(g.taken, s.pord)
    ORDER BY s.sim DESC, s.pord DESC LIMIT 1))
FROM greedy g JOIN nch n ON n.dim = g.dim WHERE g.k < n.mk"""),
    ("picks", """SELECT g.dim, unnest(g.taken) AS pord, unnest(range(1, len(g.taken) + 1)) AS k
FROM greedy g JOIN nch n ON n.dim = g.dim AND g.k = n.mk"""),
    ("pairs", """
SELECT p.dim,
       CASE WHEN r.chooser = 'low' THEN c.word ELSE a.word END AS low_word,
       CASE WHEN r.chooser = 'low' THEN a.word ELSE c.word END AS high_word,
       s.sim
FROM picks p JOIN ch c ON c.dim = p.dim AND c.k = p.k JOIN pa a ON a.dim = p.dim AND a.ord = p.pord
JOIN roles r ON r.dim = p.dim JOIN sims s ON s.dim = p.dim AND s.k = p.k AND s.pord = p.pord"""),
]


def sql_axis(name: str, contrast: bool) -> list[tuple[str, str]]:
    """``name(dim, i, a)`` = mean(high) - mean(low) per vector element."""
    if contrast:
        src = """
SELECT pr.dim, 'low' AS side, v.vec FROM pairs pr JOIN poles v ON v.dim = pr.dim AND v.side = 'low' AND v.word = pr.low_word
UNION ALL
SELECT pr.dim, 'high' AS side, v.vec FROM pairs pr JOIN poles v ON v.dim = pr.dim AND v.side = 'high' AND v.word = pr.high_word"""
    else:
        src = "SELECT dim, side, vec FROM poles"
    return [
        (f"{name}_src", src),
        (f"{name}_m", f"""SELECT dim, side, i, avg(x) AS m
FROM (SELECT dim, side, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM {name}_src) GROUP BY dim, side, i"""),
        (name, f"""SELECT h.dim, h.i, h.m - l.m AS a FROM {name}_m h
JOIN {name}_m l ON l.dim = h.dim AND l.i = h.i AND l.side = 'low' WHERE h.side = 'high'"""),
        (f"{name}_vec", f"SELECT dim, list(a ORDER BY i) AS axis FROM {name} GROUP BY dim"),
    ]


SQL_SIM_BASE = [
    ("seeds", """SELECT l.dim, l.word, v.vec FROM fx_lexicon l JOIN bounds b ON b.dim = l.dim
JOIN vecs v ON v.word = lower(l.word) WHERE l.score >= b.ub"""),
    ("cen", f"""SELECT dim, i, avg(x) AS c
FROM (SELECT dim, unnest(u) AS x, unnest(range(len(u))) AS i FROM (SELECT dim, {_unit('vec')} AS u FROM seeds))
GROUP BY dim, i"""),
    ("cenvec", "SELECT dim, list(c ORDER BY i) AS centroid FROM cen GROUP BY dim"),
]


def sql_word_scores(axis_name: str | None, sim: bool) -> list[tuple[str, str]]:
    parts = []
    sel = []
    if axis_name:
        parts.append(("w_axis", f"""SELECT v.word AS w, x.dim, 'axis' AS sm, {_cos('v.vec', 'x.axis')} AS wscore
FROM vecs v, {axis_name}_vec x"""))
        sel.append("SELECT * FROM w_axis")
    if sim:
        parts.append(("w_sim", f"""SELECT v.word AS w, c.dim, 'sim' AS sm,
       list_dot_product({_unit('v.vec')}, c.centroid) AS wscore
FROM vecs v, cenvec c"""))
        sel.append("SELECT * FROM w_sim")
    parts.append(("wscores", " UNION ALL ".join(sel)))
    return parts


SQL_VFOUND = """
SELECT c.s_key, c.am, ws.dim, ws.sm, sum(c.n * ws.wscore) AS num, sum(c.n) AS den
FROM counts c JOIN wscores ws ON ws.w = c.w GROUP BY c.s_key, c.am, ws.dim, ws.sm"""


def sql_vector_scores(ams: list[str], sms: list[str]) -> str:
    """Grid rows for vector methods; needs counts + vfound."""
    ams_sql = ", ".join(f"('{a}')" for a in ams)
    sms_sql = ", ".join(f"('{m}')" for m in sms)
    return f"""
SELECT g.s_key, g.p_ind, g.s_ind, g.writer, g.s_id, g.s_pov, g.p_pov, g.am, g.dim, g.sm,
       CASE WHEN f.den > 0 THEN f.num / f.den END AS score
FROM (SELECT s.*, a.am, d.dim, m.sm FROM fx_stories s, (VALUES {ams_sql}) a(am), (VALUES {DIMS_SQL}) d(dim),
      (VALUES {sms_sql}) m(sm)) g
LEFT JOIN vfound f ON f.s_key = g.s_key AND f.am = g.am AND f.dim = g.dim AND f.sm = g.sm"""


SQL_ATTRS_SUB = "SELECT s_key, 'sub' AS am, attr FROM ({e02}) UNION ALL SELECT s_key, 'sub' AS am, attr FROM ({e03})"
SQL_ATTRS_COMET = "SELECT s_key, 'comet' AS am, attr FROM ({e06})"


def sql_t_p(src: str, keys: str, name: str = "tp") -> list[tuple[str, str]]:
    """Recursive CTEs ``<name>(keys, p)``: two-sided p of Student's t for rows
    ``keys, t, dof`` by the continued fraction of the incomplete beta function."""
    swap = "1 - y >= (a + 1) / (a + 2.5)"
    k = ", ".join(f"q.{c.strip()}" for c in keys.split(","))
    return [
        (f"{name}_in", f"""SELECT {keys}, CAST(t AS DOUBLE) AS t, dof / 2 AS a, t * t / (dof + t * t) AS y,
       -dof / 2 * ln(1 + t * t / dof) + 0.5 * ln(t * t / (dof + t * t)) - lgamma(0.5) - lgamma(dof / 2) + lgamma(dof / 2 + 0.5) AS ls
FROM ({src}) WHERE t IS NOT NULL AND NOT isnan(t) AND t <> 0 AND dof > 0"""),
        (f"{name}_ab", f"""SELECT {keys}, ls, {swap} AS sw, CASE WHEN {swap} THEN 0.5 ELSE a END AS a,
       CASE WHEN {swap} THEN a ELSE 0.5 END AS b, CASE WHEN {swap} THEN y ELSE 1 - y END AS x FROM {name}_in"""),
        (f"{name}_cf", f"""
SELECT {keys}, ls, sw, a, b, x, 0 AS m, CAST(1 AS DOUBLE) AS c, CAST(1 / (1 - (a + b) * x / (a + 1)) AS DOUBLE) AS d,
       CAST(1 / (1 - (a + b) * x / (a + 1)) AS DOUBLE) AS h FROM {name}_ab
UNION ALL
SELECT {keys}, ls, sw, a, b, x, m, (1 + k2 / c), 1 / (1 + k2 * d), h * (1 + k2 / c) / (1 + k2 * d) FROM (
  SELECT * REPLACE (1 + k1 / c AS c, 1 / (1 + k1 * d) AS d, h * (1 + k1 / c) / (1 + k1 * d) AS h),
         -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m)) AS k2 FROM (
    SELECT * REPLACE (m + 1 AS m), (m + 1) * (b - m - 1) * x / ((a + 1 + 2 * m) * (a + 2 + 2 * m)) AS k1
    FROM {name}_cf WHERE m < 60 + ceil(4 * sqrt(greatest(a, b)))))"""),
        (name, f"""SELECT {k}, CASE WHEN q.t = 0 THEN 1.0 ELSE r.p END AS p FROM ({src}) q LEFT JOIN (
  SELECT {keys}, CASE WHEN sw THEN 1 - exp(ls) * 2 * max_by(h, m) ELSE exp(ls) * max_by(h, m) / a END AS p
  FROM {name}_cf GROUP BY {keys}, sw, ls, a) r ON {" AND ".join(f"r.{c.strip()} = q.{c.strip()}" for c in keys.split(","))}"""),
    ]
