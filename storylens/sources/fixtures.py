"""Stand-in inputs built from the driver tables.

These views only give rows in the schemas the library's operators expect
(stories, annotations, lexicons, vectors). They do none of the operators'
work; the same rules are written as CTEs in ``storylens.plans.oracle``.
Every view covers whole tables and whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storylens.functions.indexing import sequential_index
from storylens.functions.text import whitespace_words
from storylens.sources.tables import read_table

POV_BY_LANG = {"en": "TP-M", "fr": "TP-F", "de": "FP", "es": "SP"}
# prompt POV by p_ind mod 5 (fixture rule)
P_POV_CYCLE = ["TP-M", "TP-F", "FP", "SP", "Other"]
# test protagonist set over the fixture tokens
FIXTURE_PROTAGONIST = ["the", "The", "of", "de", "la"]
# fixture pronoun table for fx_pov_mentions: class -> surfaces
FIXTURE_POV_PRONOUNS = {"first": ["click"], "second": ["view"], "male": ["purchase"], "female": ["signup"]}
# a shorter table, as the basic lists are shorter than the extended ones
FIXTURE_POV_BASIC = {"first": ["click"], "second": ["view"], "male": ["purchase"], "female": []}
SENTENCE_LEN = 32

# Small stand-in tables (vocabulary, lexicon) are built once per session and
# kept as reliable checkpoints, the way a user would read them from storage.
_MEMO: dict = {}


def _memo(spark: SparkSession, sf_dir: str, name: str, build):
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _MEMO:
        _MEMO[key] = build().checkpoint()
    return _MEMO[key]


def _case(col, mapping: dict, default) -> "F.Column":
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_stories: (s_key, p_ind, s_ind, writer, s_id, s_pov, p_pov, text)."""
    d = read_table(spark, sf_dir, "documents")
    p_ind = F.expr("doc_id div 20")
    s_ind = F.expr("(doc_id % 20) div 2")
    return d.select(
        F.col("doc_id").alias("s_key"),
        p_ind.alias("p_ind"),
        s_ind.alias("s_ind"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("human")).otherwise(F.lit("gpt-3.5")).alias("writer"),
        F.concat_ws("-", p_ind.cast("string"), s_ind.cast("string")).alias("s_id"),
        _case(F.col("lang"), POV_BY_LANG, "Other").alias("s_pov"),
        _case(p_ind % 5, dict(enumerate(P_POV_CYCLE)), "Other").alias("p_pov"),
        F.col("text"),
    )


def story_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14 story info without the text."""
    return stories(spark, sf_dir).drop("text")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_prompts: user turn + next assistant turn, with a tag prefix by conv_id mod 3."""
    c = read_table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("u_text"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("story")
    )
    prefix = _case(F.col("conv_id") % 3, {0: "[ WP ] ", 1: "( EU ] "}, "")
    return u.join(a, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.concat(prefix, F.col("u_text")).alias("prompt"), "story"
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_lines: (line_no, prompt, story) with many stories per prompt."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("line_no"), F.col("source").alias("prompt"), F.col("text").alias("story"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_words: lower-cased whitespace words kept if all ASCII letters."""
    d = read_table(spark, sf_dir, "documents")
    w = d.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    return w.filter(F.col("word").rlike("^[a-z]+$"))


# Bytes of text whose words are counted at a time (a longer text alone).
COUNTED_BYTES = 2 << 20


def _counted(batches, most: int = COUNTED_BYTES):
    """Batches ``(text)`` -> distinct pieces between whitespace and their counts, a slice of texts at a time."""
    for rb in batches:
        texts = rb.column("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            found = pc.value_counts(pc.ascii_split_whitespace(texts.slice(start, end - start)).flatten())
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])
            start = end


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``words`` counted, ``(word, cnt)``: a word meets the letters' test once a
    slice of texts, and no row is made for each time that it comes."""
    d = read_table(spark, sf_dir, "documents").select(F.lower("text").alias("text")).filter(F.col("text").isNotNull())
    w = d.mapInArrow(_counted, "word string, n long").filter(F.col("word").rlike("^[a-z]+$"))
    return w.groupBy("word").agg(F.sum("n").alias("cnt"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_vocab: (word, vec_id, vec, label); vec_id = frequency rank - 1.

    Materialised with a reliable checkpoint: it is a stand-in input table
    (bounded by the embedding count) read by several operators of one query.
    """
    def build():
        # distinct words with counts, written once: the ranking reads it twice
        counts = word_counts(spark, sf_dir).checkpoint()
        ranked = sequential_index(counts, ["cnt", "word"], "vec_id", descending=("cnt",))
        emb = read_table(spark, sf_dir, "embeddings")
        return ranked.join(emb, "vec_id").select("word", "vec_id", F.col("embedding").alias("vec"), "label")

    return _memo(spark, sf_dir, "vocab", build)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12 word vectors (word, vec)."""
    return vocab(spark, sf_dir).select("word", "vec")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_lexicon: (dim, word, score, ord) for the six dimensions, one pass
    over the vocabulary."""
    v = vocab(spark, sf_dir)
    lab = F.col("label")
    parts = [
        ("valence", lab / 9.0, F.lit(True)),
        ("arousal", ((lab * 7) % 10) / 9.0, F.lit(True)),
        ("dominance", ((lab * 3) % 10) / 9.0, F.lit(True)),
        ("power", (lab % 2).cast("double"), F.lit(True)),
        ("appearance", F.lit(1.0), lab == 3),
        ("intellect", F.lit(1.0), lab.isin(5, 6)),
    ]
    rows = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), sc.cast("double").alias("score"), keep.alias("keep"))
        for d, sc, keep in parts
    ]))
    lx = v.select("word", F.col("vec_id").alias("ord"), rows.alias("r")).filter(F.col("r.keep"))
    return _memo(spark, sf_dir, "lexicon",
                 lambda: lx.select(F.col("r.dim").alias("dim"), "word", F.col("r.score").alias("score"), "ord"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_tokens: one row per whitespace word with a synthetic parse.

    sent_id = pos div 32; inside a sentence a binary-heap tree (k = pos mod 32 + 1,
    head k div 2, the root is its own head); dep by pos mod 7, tag by pos mod 5.
    """
    d = read_table(spark, sf_dir, "documents")
    t = d.select(F.col("doc_id").alias("s_key"), F.posexplode(whitespace_words("text")).alias("pos", "text"))
    k = F.col("pos") % SENTENCE_LEN + 1
    sent = F.expr(f"pos div {SENTENCE_LEN}")
    dep = (
        F.when(k == 1, "ROOT")
        .when(F.col("pos") % 7 == 0, "nsubj")
        .when(F.col("pos") % 7 == 1, "amod")
        .when(F.col("pos") % 7 == 2, "poss")
        .when(F.col("pos") % 7 == 3, "nsubjpass")
        .otherwise("dep")
    )
    tag = _case(F.col("pos") % 5, {0: "VBD", 1: "JJ", 2: "VBZ", 3: "NN"}, "NN")
    head = F.when(k == 1, F.col("pos")).otherwise(sent * SENTENCE_LEN + F.expr(f"(pos % {SENTENCE_LEN} + 1) div 2") - 1)
    return t.select(
        "s_key",
        sent.cast("int").alias("sent_id"),
        F.col("pos").cast("int").alias("pos"),
        "text",
        tag.alias("tag"),
        dep.alias("dep"),
        head.cast("int").alias("head_pos"),
    )


def _parse_struct(pos):
    """The fixture parse of one position (same rules as ``tokens``)."""
    k = pos % SENTENCE_LEN + 1
    sent = F.floor(pos / SENTENCE_LEN)
    dep = (
        F.when(k == 1, F.lit("ROOT")).when(pos % 7 == 0, F.lit("nsubj")).when(pos % 7 == 1, F.lit("amod"))
        .when(pos % 7 == 2, F.lit("poss")).when(pos % 7 == 3, F.lit("nsubjpass")).otherwise(F.lit("dep"))
    )
    tag = F.when(pos % 5 == 0, "VBD").when(pos % 5 == 1, "JJ").when(pos % 5 == 2, "VBZ").otherwise("NN")
    head = F.when(k == 1, pos).otherwise(sent * SENTENCE_LEN + F.floor(k / 2) - 1)
    return tag, dep, head


SENTENCE_SCHEMA = ("s_key long, sent_id int, base int, pos array<int>, text array<string>, tag array<string>, "
                   "dep array<string>, head array<int>")
_TAGS = pa.array(["VBD", "JJ", "VBZ", "NN", "NN"])
_DEPS = pa.array(["nsubj", "amod", "poss", "nsubjpass", "dep", "dep", "dep", "ROOT"])


# Tokens that the stand-in parser holds at a time (a longer text alone).
PARSER_TOKENS = 1 << 16


def _word_chunks(batches, most: int):
    """Keys, words and numbers of words of consecutive texts, up to ``most`` words at a
    time whatever the size of an Arrow batch; a longer text comes alone."""
    for rb in batches:
        keys, texts = rb.column("s_key"), pc.fill_null(rb.column("text"), "")
        # a word takes two bytes of text at least, but for the last of a text
        ends = np.cumsum((pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // 2)
        start = 0
        while start < rb.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            split = pc.utf8_split_whitespace(texts.slice(start, end - start))
            words = split.flatten()
            some = pc.greater(pc.binary_length(words), 0)  # none before and after outer whitespace
            of = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
            lens = np.bincount(of[some.to_numpy(zero_copy_only=False)], minlength=len(split))
            yield keys.slice(start, end - start), words.filter(some), lens
            start = end


def _sentence_parser(batches, most: int = PARSER_TOKENS):
    """Stand-in parser emitting one row per sentence (fixture rules), built
    from flat numpy arrays per chunk of texts."""
    for keys, toks, lens in _word_chunks(batches, most):
        keys = keys.to_numpy(zero_copy_only=False)
        lens = lens.astype(np.int64)
        total = int(lens.sum())
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
        pos = np.arange(total, dtype=np.int64) - np.repeat(starts, lens)
        k = pos % SENTENCE_LEN + 1
        tag = _TAGS.take(pa.array(pos % 5))
        dep = _DEPS.take(pa.array(np.where(k == 1, 7, pos % 7)))
        head = np.where(k == 1, pos, (pos // SENTENCE_LEN) * SENTENCE_LEN + k // 2 - 1)
        first = np.flatnonzero(pos % SENTENCE_LEN == 0)
        offsets = pa.array(np.append(first, total).astype(np.int32))
        doc_of = np.repeat(np.arange(len(lens)), lens)[first]

        def lst(values):
            return pa.ListArray.from_arrays(offsets, values)

        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys[doc_of].astype(np.int64)),
                pa.array((pos[first] // SENTENCE_LEN).astype(np.int32)),
                pa.array(pos[first].astype(np.int32)),
                lst(pa.array(pos.astype(np.int32))),
                lst(toks.cast(pa.string())),
                lst(tag),
                lst(dep),
                lst(pa.array(head.astype(np.int32))),
            ],
            names=["s_key", "sent_id", "base", "pos", "text", "tag", "dep", "head"],
        )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_tokens in the per-sentence form an annotator emits:
    ``(s_key, sent_id, base, pos[], text[], tag[], dep[], head[])``, produced
    per document by a stand-in parser (no shuffle)."""
    return parser_input(spark, sf_dir).mapInArrow(_sentence_parser, SENTENCE_SCHEMA)


def parser_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(s_key, text)``, what the stand-in parser reads."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("s_key"), "text")


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_tokens per story as arrays ``(s_key, toks, deps)`` (no shuffle)."""
    d = read_table(spark, sf_dir, "documents")
    t = d.select(F.col("doc_id").alias("s_key"), whitespace_words("text").alias("toks"))
    deps = F.transform(F.sequence(F.lit(0), F.size("toks") - 1), lambda p: _parse_struct(p)[1])
    return t.select("s_key", "toks", F.when(F.size("toks") > 0, deps).otherwise(F.array().cast("array<string>")).alias("deps"))


MENTION_SCHEMA = "s_key long, cluster_id int, mention_no int, start int, end int, surface string"


def _mention_model(batches):
    """Stand-in coreference output (fixture rules), from flat numpy arrays
    per Arrow batch: family 1 starts every 11 tokens (length 1 + pos mod 3,
    cluster (pos div 11) mod 4), family 2 every 13 tokens (length 1 + pos mod
    4, cluster 4 + (pos div 13) mod 3); ends clamped to the text; mentions
    numbered per cluster by (start, end)."""
    for rb in batches:
        out = {k: [] for k in ("s_key", "cluster_id", "mention_no", "start", "end", "surface")}
        for key, txt in zip(rb.column("s_key").to_pylist(), rb.column("text").to_pylist()):
            toks = (txt or "").split()
            n = len(toks)
            if n == 0:
                continue
            s1 = np.arange(0, n, 11)
            s2 = np.arange(0, n, 13)
            start = np.concatenate([s1, s2])
            end = np.minimum(np.concatenate([s1 + s1 % 3, s2 + s2 % 4]), n - 1)
            cl = np.concatenate([(s1 // 11) % 4, 4 + (s2 // 13) % 3])
            order = np.lexsort((end, start, cl))
            start, end, cl = start[order], end[order], cl[order]
            first = np.concatenate([[True], cl[1:] != cl[:-1]])
            grp_start = np.maximum.accumulate(np.where(first, np.arange(len(cl)), 0))
            out["s_key"].append(np.full(len(cl), key, dtype=np.int64))
            out["cluster_id"].append(cl.astype(np.int32))
            out["mention_no"].append((np.arange(len(cl)) - grp_start).astype(np.int32))
            out["start"].append(start.astype(np.int32))
            out["end"].append(end.astype(np.int32))
            out["surface"].append(np.array([" ".join(toks[a:b + 1]) for a, b in zip(start, end)], dtype=object))
        if not out["s_key"]:
            continue
        cols = {k: np.concatenate(v) for k, v in out.items()}
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols["s_key"]), pa.array(cols["cluster_id"]), pa.array(cols["mention_no"]),
             pa.array(cols["start"]), pa.array(cols["end"]), pa.array(cols["surface"], type=pa.string())],
            names=["s_key", "cluster_id", "mention_no", "start", "end", "surface"],
        )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_mentions: two overlapping span families over fx_tokens (inclusive
    ends), from a stand-in coreference model per document; kept for the
    session like the other stand-in tables (several operators read it)."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("s_key"), "text")
    return _memo(spark, sf_dir, "mentions", lambda: d.mapInArrow(_mention_model, MENTION_SCHEMA))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_entities: distinct single-token mention surfaces longer than 6 chars."""
    m = mentions(spark, sf_dir).filter((F.col("start") == F.col("end")) & (F.length("surface") > 6))
    return m.select(
        "s_key",
        F.col("surface").alias("text"),
        F.when(F.length("surface") % 2 == 0, "PERSON").otherwise("ORG").alias("label"),
    ).distinct()


def pov_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_pov_mentions: (s_key, cluster_id, mention_no, surface) from events."""
    e = read_table(spark, sf_dir, "events")
    s_key = F.expr("event_id div 6")
    cl = F.when(s_key % 2 == 0, (F.col("event_id") % 6) % 2).otherwise((F.col("event_id") % 6) % 3)
    m = e.select(s_key.alias("s_key"), cl.cast("int").alias("cluster_id"), "event_id", F.col("event_type").alias("surface"))
    w = Window.partitionBy("s_key", "cluster_id").orderBy("event_id")
    return m.select("s_key", "cluster_id", (F.row_number().over(w) - 1).cast("int").alias("mention_no"), "surface")


def pov_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Story keys for the POV views: every s_key that events can produce."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.expr("event_id div 6").alias("s_key")).distinct()


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_phrases: document text split on '.', as the inferred-phrase list."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("s_key"), F.split("text", r"\.").alias("phrases"))
