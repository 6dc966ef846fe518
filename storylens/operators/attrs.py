"""Attribute extraction: all tokens (E01), protagonist-subject heads (E02),
adjective modifiers under a protagonist (E03), their union (E04), the
commonsense sentence gate (E05), inferred-phrase normalisation (E06),
alignment to all stories (E07) and method choice (E08).

Tokens: ``(s_key, sent_id, pos, text, tag, dep, head_pos)``, heads inside the
sentence, the root its own head; or the same one row per sentence with
arrays (what an annotator emits). Dependency work is done per sentence: a
long token table is collected into sentences with one shuffle; E02/E03 run
on Arrow batches of sentences with numpy (no token self-join, no recursion
cap); E05 is a higher-order ``exists`` per sentence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylens.constants import ATTR_METHODS, PROTAGONIST_TOKENS
from storylens.functions.text import strip_ascii_punctuation, whitespace_words

ALL_METHODS = ATTR_METHODS + ["full"]


def check_attr_method(method: str | None, default: str = "all") -> str:
    """No method -> default; ``full`` is ``all``; unknown -> error."""
    m = method or default
    if m not in ALL_METHODS:
        raise ValueError(f"unknown attribute method {m!r}; expected one of {ALL_METHODS}")
    return "all" if m == "full" else m


def all_attrs(stories: DataFrame, text_col: str = "text", exploded: bool = True) -> DataFrame:
    """E01 without annotations: every whitespace token, original case.
    Returns ``(s_key, ord, attr)``; unexploded ``(s_key, attrs)``, a story's
    attributes as one text with whitespace between them."""
    if not exploded:
        return stories.select("s_key", F.col(text_col).alias("attrs"))
    return stories.select("s_key", F.posexplode(whitespace_words(text_col)).alias("ord", "attr"))


def all_attrs_from_tokens(tokens: DataFrame) -> DataFrame:
    """E01 with annotations: every token text."""
    return tokens.select("s_key", F.col("pos").alias("ord"), F.col("text").alias("attr"))


def sentences(tokens: DataFrame) -> DataFrame:
    """One row per sentence: tokens sorted by position, as parallel arrays."""
    g = tokens.groupBy("s_key", "sent_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text", "tag", "dep", "head_pos"))).alias("t")
    )
    return g.select(
        "s_key", "sent_id",
        F.col("t")[0]["pos"].alias("base"),
        F.col("t.pos").alias("pos"), F.col("t.text").alias("text"), F.col("t.tag").alias("tag"),
        F.col("t.dep").alias("dep"), F.col("t.head_pos").alias("head"),
    )


def _in(col: Column, values: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(v) for v in values]), col) if values else F.lit(False)


def sub_attrs(tokens: DataFrame, prot: list[str] = PROTAGONIST_TOKENS) -> DataFrame:
    """E04 = E02 + E03 in token order, duplicates kept. Returns ``(s_key, ord, attr, rule)``.

    One shuffle into sentences, to which a token brings its position, its head,
    a byte of flags, and its word if a rule can return it: four plain lists in
    the same order, a fraction of the bytes of all columns as structs. A token
    without a head is a root."""
    tag, dep, text = F.col("tag"), F.col("dep"), F.col("text")
    tests = [(PROT, _in(text, prot)), (NSUBJ, dep == "nsubj"), (AMOD, dep == "amod"),
             (HEAD, tag.startswith("VB") | (tag == "JJ")), (NO_WORD, text.isNull())]
    flags = sum(F.when(F.coalesce(is_, F.lit(False)), F.lit(bit)).otherwise(F.lit(0)) for bit, is_ in tests)
    t = tokens.filter(F.col("pos").isNotNull()).select(
        "s_key", "sent_id", F.col("pos").cast("int"), F.coalesce("head_pos", "pos").cast("int").alias("head"),
        flags.cast("byte").alias("flags"), "text")
    returned = F.col("flags").bitwiseAND(F.lit(AMOD | HEAD).cast("byte")) != 0
    t = t.withColumn("text", F.when(returned & text.isNotNull(), text).otherwise(""))
    lists = [F.collect_list(c).alias(c) for c in ("pos", "head", "flags", "text")]
    cols = t.groupBy("s_key", "sent_id").agg(*lists).select("s_key", "pos", "head", "flags", "text")
    return cols.mapInArrow(_flagged_batch, SUB_SCHEMA)


# Flags of a token.
PROT, NSUBJ, AMOD, HEAD, NO_WORD = 1, 2, 4, 8, 16

SUB_SCHEMA = "s_key long, ord int, attr string, rule string"
_SUB_ARROW = pa.schema([("s_key", pa.int64()), ("ord", pa.int32()), ("attr", pa.string()), ("rule", pa.string())])
# Sentences whose tokens are Python objects at a time, and tokens of them.
SLICE = 1024
SLICE_TOKENS = 1 << 16


def _sentence_runs(batches: Iterator[pa.RecordBatch], rows: int = SLICE, most: int = SLICE_TOKENS) -> Iterator[pa.RecordBatch]:
    """Runs of sentences, bounded in sentences and in tokens (a longer sentence
    comes alone), whatever the size of an Arrow batch."""
    for rb in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(rb.column("pos")), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < rb.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + most, side="right"))))
            yield rb.slice(start, end - start)
            start = end


def _sentence_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, most: int = SLICE_TOKENS) -> Iterator[pd.DataFrame]:
    """``_sentence_runs`` as pandas."""
    for run in _sentence_runs(batches, rows, most):
        yield run.to_pandas()


def _rules(lens, parent, is_prot, nsubj, amod, under_head) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a slice that E02 and E03 take; ``parent``: index of each token's head."""
    # Protagonist nsubj -> head text when the head is VB* or JJ
    m2 = nsubj & is_prot & under_head
    # Amod with a protagonist ancestor; ancestor flags by pointer
    # doubling (the root points to itself and is not its own ancestor)
    root = parent == np.arange(len(parent))
    flag = np.where(root, False, is_prot[parent])
    jump = parent.copy()
    for _ in range(int(np.ceil(np.log2(max(2, lens.max())))) + 1):
        flag = flag | flag[jump]
        jump = jump[jump]
    return m2, amod & flag


def _sub_rows(key, pos, lens, text, parent, is_prot, nsubj, amod, under_head) -> pa.RecordBatch:
    """E02 and E03 for the tokens of a slice."""
    m2, m3 = _rules(lens, parent, is_prot, nsubj, amod, under_head)
    out2 = pd.DataFrame({"s_key": key[m2], "ord": pos[m2].astype(np.int32), "attr": text[parent[m2]], "rule": "E02"})
    out3 = pd.DataFrame({"s_key": key[m3], "ord": pos[m3].astype(np.int32), "attr": text[m3], "rule": "E03"})
    return pa.RecordBatch.from_pandas(pd.concat([out2, out3], ignore_index=True), schema=_SUB_ARROW, preserve_index=False)


def _flagged_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences as lists of positions, heads, flags and words, in any order of tokens."""
    for pdf in _sentence_slices(batches):
        lens = pdf["pos"].map(len).to_numpy()
        offs = np.concatenate([[0], np.cumsum(lens)[:-1]])
        key = np.repeat(pdf["s_key"].to_numpy(), lens)
        pos, head = (np.concatenate(pdf[c].to_numpy()).astype(np.int64) for c in ("pos", "head"))
        flags = np.concatenate(pdf["flags"].to_numpy()).astype(np.int8)
        text = np.concatenate(pdf["text"].to_numpy()).astype(object)
        of = np.repeat(np.arange(len(lens)), lens)
        order = np.lexsort((pos, of))
        if (np.diff(pos[order]) + np.diff(of[order]) == 0).any():  # positions that come twice: by their words too
            order = np.array(sorted(range(len(pos)), key=lambda i: (of[i], pos[i], text[i], flags[i], head[i])))
        pos, head, flags, text = pos[order], head[order], flags[order], text[order]
        text[(flags & NO_WORD) > 0] = None
        parent = np.repeat(offs, lens) + head - np.repeat(pos[offs], lens)
        has = [(flags & bit) > 0 for bit in (PROT, NSUBJ, AMOD, HEAD)]
        yield _sub_rows(key, pos, lens, text, parent, *has[:3], has[3][parent])


LIST_SCHEMA = "s_key long, attrs array<string>"
_LIST_ARROW = pa.schema([("s_key", pa.int64()), ("attrs", pa.list_(pa.string()))])


def _listed(keys: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """Words as one list for each run of rows with the same key."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)).astype(np.int32)), words)
    return pa.RecordBatch.from_arrays([pa.array(keys[first]), lists], schema=_LIST_ARROW)


def _sub_batch(prot: list[str], exploded: bool = True):
    prot_set = pa.array(sorted(set(prot)), pa.string())

    def true(found) -> np.ndarray:
        return pc.fill_null(found, False).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # strings stay in Arrow: no Python object for a token
        for rb in _sentence_runs(batches):
            lens = pc.list_value_length(rb.column("pos")).to_numpy(zero_copy_only=False)
            offs = np.concatenate([[0], np.cumsum(lens)[:-1]])
            text, tag, dep = (rb.column(c).flatten().cast(pa.string()) for c in ("text", "tag", "dep"))
            pos, head = (rb.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "head"))
            base = np.repeat(rb.column("base").to_numpy(zero_copy_only=False).astype(np.int64), lens)
            parent = np.repeat(offs, lens) + (head - base)  # global index of the head
            # Protagonist nsubj -> head text when the head is VB* or JJ
            heads = true(pc.or_kleene(pc.starts_with(tag, "VB"), pc.equal(tag, "JJ")))
            m2, m3 = _rules(lens, parent, true(pc.is_in(text, value_set=prot_set)), true(pc.equal(dep, "nsubj")),
                            true(pc.equal(dep, "amod")), heads[parent])
            at2, at3 = np.flatnonzero(m2), np.flatnonzero(m3)
            at = np.concatenate([at2, at3])
            of = np.repeat(np.arange(len(lens)), lens)[at]
            if not exploded:
                # a sentence without a key comes back from Arrow as rows do: on its own
                order, taken = np.argsort(of, kind="stable"), np.concatenate([parent[at2], at3])
                key = rb.column("s_key").cast(pa.int64()).take(pa.array(of[order]))
                for null in (False, True):
                    mine = pc.equal(pc.is_null(key), null).to_numpy(zero_copy_only=False)
                    keys = pc.fill_null(key.filter(pa.array(mine)), 0).to_numpy(zero_copy_only=False)
                    got = _listed(keys, text.take(pa.array(taken[order][mine])))
                    yield got if not null else got.set_column(0, "s_key", pa.nulls(len(got), pa.int64()))
                continue
            yield pa.RecordBatch.from_arrays([
                rb.column("s_key").cast(pa.int64()).take(pa.array(of)), pa.array(pos[at].astype(np.int32)),
                text.take(pa.array(np.concatenate([parent[at2], at3]))),
                pa.array(["E02", "E03"]).take(pa.array(np.repeat([0, 1], [len(at2), len(at3)])))], schema=_SUB_ARROW)

    return run


def sub_attrs_from_sentences(s: DataFrame, prot: list[str] = PROTAGONIST_TOKENS, parser=None,
                             exploded: bool = True) -> DataFrame:
    """E04 over the per-sentence form ``(s_key, sent_id, base, pos[], text[],
    tag[], dep[], head[])`` (what an annotator emits; no shuffle needed).

    Arrow batches of sentences are flattened slice by slice, so a worker's memory
    does not follow the batch; E02 is
    a lookup of each token's head, and E03's "any ancestor is a protagonist"
    is computed for every token at once by pointer doubling (log2 of the
    sentence length passes), so no per-token climb.

    ``parser``: an annotator (Arrow batches of ``s`` -> batches of that form) whose
    sentences the rules read in its own task: its tokens, several strings each, do
    not pass through the JVM in between. Unexploded ``(s_key, attrs)``: lists of
    attributes, of which a story has one or more."""
    rules, schema = _sub_batch(list(prot), exploded), SUB_SCHEMA if exploded else LIST_SCHEMA
    if parser is not None:
        return s.mapInArrow(lambda batches: rules(parser(batches)), schema)
    cols = s.select("s_key", "base", "pos", "text", "tag", "dep", "head")
    return cols.mapInArrow(rules, schema)


def gated_sentences(tokens: DataFrame, prot: list[str] = PROTAGONIST_TOKENS) -> DataFrame:
    """Sentences whose ROOT has a child ``nsubj``/``nsubjpass`` that is a
    protagonist token. Returns the model request table ``(s_key, sent_id, sentence)``."""
    return gated_from_sentences(sentences(tokens), prot)


def gated_from_sentences(s: DataFrame, prot: list[str] = PROTAGONIST_TOKENS) -> DataFrame:
    """E05 over the per-sentence form."""
    n = F.size("pos")
    hit = F.exists(
        F.sequence(F.lit(1), n),
        lambda i: F.element_at("dep", i).isin("nsubj", "nsubjpass")
        & _in(F.element_at("text", i), prot)
        & (F.element_at("head", i) != F.element_at("pos", i))
        & (F.element_at("dep", (F.element_at("head", i) - F.col("base") + 1).cast("int")) == "ROOT"),
    )
    return s.filter(hit).select("s_key", "sent_id", F.array_join("text", " ").alias("sentence"))


def normalise_phrases(phrases: DataFrame, col: str = "phrases", exploded: bool = True) -> DataFrame:
    """Remove ASCII punctuation, lower-case, split on whitespace, flatten.
    ``(s_key, phrases array<string>)`` -> ``(s_key, ord, attr)``; unexploded
    ``(s_key, attrs)``, a story's words as one text with whitespace between them
    (which also parts phrases, so that none goes on in the next)."""
    if not exploded:
        return phrases.select("s_key", F.lower(strip_ascii_punctuation(F.array_join(col, " "))).alias("attrs"))
    p = phrases.select("s_key", F.posexplode(col).alias("ph_no", "ph"))
    w = p.select("s_key", "ph_no", F.posexplode(whitespace_words(F.lower(strip_ascii_punctuation("ph")))).alias("w_no", "attr"))
    return w.select("s_key", "ph_no", "w_no", "attr")


def align_to_stories(stories: DataFrame, processed: DataFrame, value_col: str, empty) -> DataFrame:
    """Every story keeps its row; missing processed values become `empty`.
    Stories of several writers are told apart by ``writer``, if it is there."""
    keys = [k for k in ("writer", "p_ind", "s_ind") if k in stories.columns]
    j = stories.join(processed, keys, "left")
    return j.withColumn(value_col, F.coalesce(F.col(value_col), empty))
