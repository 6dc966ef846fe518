"""Registered queries of the training-data operators: each applies its
operator to whole tables and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from storylens.llm import conversation_trie, ctw, decontaminate, imatch, licenses, merkle, pieces, pii, quality, simhash, suffix_dedup, token_count, token_files
from storylens.llm.common import crc_remainder, crc_sql, table, texts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@query("op1_quality_classifier")
def op1(spark, sf):
    """Quality scores of all documents; learned from labels of training rows."""
    docs = texts(table(spark, sf, "documents"))
    model = quality.fit(docs, quality.training_labels(table(spark, sf, "labels")))
    s = quality.scored(docs, model)
    return s.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
                    F.col("quality_score").alias("score"),
                    (F.col("quality_score") >= quality.ACCEPT).cast("int").alias("predicted"))


@query("op3_token_counts")
def op3(spark, sf):
    """Token counts of all documents by distinct pre-tokens."""
    n = token_count.token_counts(table(spark, sf, "documents"))
    return n.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op4_license_scan")
def op4(spark, sf):
    """Licence labels of all documents by the positional rare-token index."""
    s = licenses.scan(texts(table(spark, sf, "documents")))
    one = F.col("licenses")
    return s.select("doc_id", one["n_words"].alias("n_words"), one["n_base"].alias("n_base"),
                    one["first_word"].alias("first_word"), one["last_word"].alias("last_word"),
                    F.array_join(one["base_labels"], ",").alias("base_labels"),
                    F.array_join(one["labels"], ",").alias("labels"), one["score"].alias("score"))


@query("op5_decontaminate")
def op5(spark, sf):
    """Benchmark windows in all documents by Wu-Manber search."""
    s = decontaminate.contamination(texts(table(spark, sf, "documents")), table(spark, sf, "benchmark"))
    c = F.col("contamination")
    return s.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
                    F.size(c["items"]).cast("long").alias("n_items"), c["items_sha256"].alias("items_sha256"),
                    c["contaminated"].alias("contaminated"))


@query("op6_sentencepiece")
def op6(spark, sf):
    """Ids and decoded texts of all documents by distinct chunks."""
    docs = texts(table(spark, sf, "documents"))
    return docs.select("doc_id", pieces.digests(F.col("text")).alias("d")).select("doc_id", "d.*")


@query("op8_token_files")
def op8(spark, sf):
    """Token-id files of all documents in doc_id order, read back."""
    docs = table(spark, sf, "documents")
    folder = token_files.shared_folder(spark)
    return token_files.read_ids(spark, folder, token_files.write_ids(docs, folder))


@query("op10_simhash_near_dedup")
def op10(spark, sf):
    """Fingerprints and components of all documents."""
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op9_ctw_score")
def op9(spark, sf):
    """Context-tree-weighting scores of all documents, with the base scores."""
    docs = texts(table(spark, sf, "documents"))
    s = ctw.scores(docs, docs.where(crc_remainder(F.col("doc_id"), 7) != 2))
    return s.select("doc_id", (crc_remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
                    "train_tokens", "base_score", "score", "bits_per_byte")


@query("op2_suffix_array_dedup")
def op2(spark, sf):
    """Bytes of all documents that repeat 50-byte strings of earlier ones."""
    cut = suffix_dedup.cut_repeats(table(spark, sf, "documents"), with_kept=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op7_imatch_fingerprints", imatch.ORACLE)
def op7(spark, sf):
    """I-Match fingerprints of all documents and of their edited texts."""
    return imatch.fingerprints(table(spark, sf, "documents"))


@query("op11_merkle_manifest", merkle.ORACLE)
def op11(spark, sf):
    """Merkle proofs of all documents, folded from leaves of which a third are
    tampered with."""
    docs = table(spark, sf, "documents")
    tampered = crc_remainder(F.col("doc_id"), 3) == 0
    seen = F.when(tampered, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    return merkle.proofs(merkle.leaves(docs, seen), with_siblings=False).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_conversation_trie", conversation_trie.oracle(crc_sql("conv_id")))
def op12(spark, sf):
    """Prefix trie of all rebuilt conversations."""
    own = conversation_trie.turns(table(spark, sf, "conversations"))
    return conversation_trie.trie(conversation_trie.rebuilt(own)).drop("turn_id")


@query("op13_pii")
def op13(spark, sf):
    """Personal data in all documents: fixed patterns, and what the random
    field adds."""
    docs = pii.found(texts(table(spark, sf, "documents")))
    base = F.filter("pii", lambda x: x["base"])

    def count(kind):
        return F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return docs.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
                       pii.listed(F.col("pii")).alias("spans"))
