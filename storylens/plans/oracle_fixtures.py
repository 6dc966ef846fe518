"""DuckDB twins of ``storylens.sources.fixtures`` as CTEs.

Each entry is (dependencies, body). ``with_ctes`` assembles a WITH clause in
dependency order so a query names only what it reads.
"""

from __future__ import annotations

CTES: dict[str, tuple[list[str], str]] = {
    "fx_stories": ([], """
SELECT doc_id AS s_key, doc_id // 20 AS p_ind, (doc_id % 20) // 2 AS s_ind,
       CASE WHEN doc_id % 2 = 0 THEN 'human' ELSE 'gpt-3.5' END AS writer,
       concat_ws('-', CAST(doc_id // 20 AS VARCHAR), CAST((doc_id % 20) // 2 AS VARCHAR)) AS s_id,
       CASE lang WHEN 'en' THEN 'TP-M' WHEN 'fr' THEN 'TP-F' WHEN 'de' THEN 'FP' WHEN 'es' THEN 'SP'
                 ELSE 'Other' END AS s_pov,
       CASE (doc_id // 20) % 5 WHEN 0 THEN 'TP-M' WHEN 1 THEN 'TP-F' WHEN 2 THEN 'FP' WHEN 3 THEN 'SP'
                 ELSE 'Other' END AS p_pov,
       text
FROM documents"""),
    "fx_words": ([], """
SELECT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents)
WHERE regexp_matches(w, '^[a-z]+$')"""),
    "fx_vocab": (["fx_words"], """
SELECT r.word, r.vec_id, e.embedding AS vec, e.label
FROM (SELECT word, row_number() OVER (ORDER BY cnt DESC, word ASC) - 1 AS vec_id
      FROM (SELECT word, count(*) AS cnt FROM fx_words GROUP BY word)) r
JOIN embeddings e ON e.vec_id = r.vec_id"""),
    "fx_lexicon": (["fx_vocab"], """
SELECT 'valence' AS dim, word, CAST(label AS DOUBLE) / 9.0 AS score, vec_id AS ord FROM fx_vocab
UNION ALL SELECT 'arousal', word, CAST((label * 7) % 10 AS DOUBLE) / 9.0, vec_id FROM fx_vocab
UNION ALL SELECT 'dominance', word, CAST((label * 3) % 10 AS DOUBLE) / 9.0, vec_id FROM fx_vocab
UNION ALL SELECT 'power', word, CAST(label % 2 AS DOUBLE), vec_id FROM fx_vocab
UNION ALL SELECT 'appearance', word, 1.0::DOUBLE, vec_id FROM fx_vocab WHERE label = 3
UNION ALL SELECT 'intellect', word, 1.0::DOUBLE, vec_id FROM fx_vocab WHERE label IN (5, 6)"""),
    "fx_tokens": ([], """
SELECT s_key, CAST(pos // 32 AS INTEGER) AS sent_id, CAST(pos AS INTEGER) AS pos, text,
       CASE pos % 5 WHEN 0 THEN 'VBD' WHEN 1 THEN 'JJ' WHEN 2 THEN 'VBZ' ELSE 'NN' END AS tag,
       CASE WHEN pos % 32 = 0 THEN 'ROOT' WHEN pos % 7 = 0 THEN 'nsubj' WHEN pos % 7 = 1 THEN 'amod'
            WHEN pos % 7 = 2 THEN 'poss' WHEN pos % 7 = 3 THEN 'nsubjpass' ELSE 'dep' END AS dep,
       CAST(CASE WHEN pos % 32 = 0 THEN pos ELSE (pos // 32) * 32 + (pos % 32 + 1) // 2 - 1 END AS INTEGER)
         AS head_pos
FROM (SELECT doc_id AS s_key, unnest(toks) AS text, unnest(range(len(toks))) AS pos
      FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS toks
            FROM documents))"""),
    "fx_doc_toks": ([], """
SELECT doc_id AS s_key, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS toks
FROM documents"""),
    "fx_mentions": (["fx_doc_toks"], """
SELECT s_key, CAST(cluster_id AS INTEGER) AS cluster_id,
       CAST(row_number() OVER (PARTITION BY s_key, cluster_id ORDER BY start, "end") - 1 AS INTEGER) AS mention_no,
       CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end",
       array_to_string(toks[start + 1 : "end" + 1], ' ') AS surface
FROM (
  SELECT s_key, toks, s AS start, least(s + s % 3, len(toks) - 1) AS "end", (s // 11) % 4 AS cluster_id
  FROM (SELECT s_key, toks, unnest(range(0, len(toks), 11)) AS s FROM fx_doc_toks)
  UNION ALL
  SELECT s_key, toks, s, least(s + s % 4, len(toks) - 1), 4 + (s // 13) % 3
  FROM (SELECT s_key, toks, unnest(range(0, len(toks), 13)) AS s FROM fx_doc_toks)
)"""),
    "fx_entities": (["fx_mentions"], """
SELECT DISTINCT s_key, surface AS text, CASE WHEN length(surface) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS label
FROM fx_mentions WHERE start = "end" AND length(surface) > 6"""),
    "fx_pov_mentions": ([], """
SELECT s_key, CAST(cluster_id AS INTEGER) AS cluster_id,
       CAST(row_number() OVER (PARTITION BY s_key, cluster_id ORDER BY event_id) - 1 AS INTEGER) AS mention_no,
       surface
FROM (SELECT event_id // 6 AS s_key,
             CASE WHEN (event_id // 6) % 2 = 0 THEN (event_id % 6) % 2 ELSE (event_id % 6) % 3 END AS cluster_id,
             event_id, event_type AS surface FROM events)"""),
    "fx_pov_stories": ([], "SELECT DISTINCT event_id // 6 AS s_key FROM events"),
    "fx_prompts": ([], """
SELECT u.conv_id, u.turn,
       CASE u.conv_id % 3 WHEN 0 THEN '[ WP ] ' WHEN 1 THEN '( EU ] ' ELSE '' END || u.text AS prompt,
       a.text AS story
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'"""),
    "fx_lines": ([], "SELECT doc_id AS line_no, source AS prompt, text AS story FROM documents"),
    "fx_phrases": ([], "SELECT doc_id AS s_key, string_split_regex(text, '\\.') AS phrases FROM documents"),
}


def with_ctes(names: list[str], body: str, extra: list[tuple[str, str]] | None = None,
              recursive: bool = False) -> str:
    """Assemble ``WITH a AS (...), b AS (...) body`` with dependencies first."""
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in order]
    for n, sql in extra or []:
        parts.append(f"{n} AS ({sql}\n)")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body
