"""Quality classifier, context-tree weighting and I-Match."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storylens.llm import ctw, imatch, quality
from tests.llm import odd


def labelled_docs(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("aeioustnr", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.7
        text = " ".join(words) + "." if good else rng.choice(["!! ", " | ", "&&& "]).join(words).upper()
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return odd.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_separates_held_out_rows(spark):
    docs, labels = labelled_docs(spark)
    model = quality.fit(docs, quality.training_labels(labels))
    got = quality.scored(docs, model).join(labels.select("doc_id", "quality"), "doc_id")
    held = got.where(quality.crc_remainder(F.col("doc_id"), 5) == 0).collect()
    assert len(held) > 50 and all(0 <= r["quality_score"] <= 1 for r in held)
    assert np.mean([(r["quality_score"] >= quality.ACCEPT) == (r["quality"] == 1) for r in held]) > 0.95


def test_quality_reads_texts_alone(spark):
    """Labels of held-out rows, and other columns, change nothing."""
    docs, labels = labelled_docs(spark, 200)
    held = quality.crc_remainder(F.col("doc_id"), 5) == 0
    wrong = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.scored(docs, quality.fit(docs, quality.training_labels(labels)))
    b = quality.scored(docs.withColumn("lang", F.lit("x")).repartition(5), quality.fit(docs, quality.training_labels(wrong)))
    left, right = ({r["doc_id"]: r["quality_score"] for r in x.collect()} for x in (a, b))
    assert left.keys() == right.keys() and all(math.isclose(left[k], right[k], abs_tol=1e-9) for k in left)


def test_quality_edge_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["quality_score"] for r in quality.scored(docs, quality.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (3, 1), (3, 1), (None, 0), (6, None)], "doc_id long, quality int")
    assert {r["quality_score"] for r in quality.scored(docs, quality.fit(docs, one)).collect()} == {1.0}
    two = spark.createDataFrame([(0, 1), (3, 0), (6, 1)], "doc_id long, quality int")
    model = quality.fit(docs, two)
    assert all(0 <= r["quality_score"] <= 1 for r in quality.scored(docs, model).collect())
    assert quality.scored(odd.empty(spark), model).count() == 0
    same = {r["quality_score"] for r in quality.scored(odd.repeated(spark), model).where("doc_id = 1").collect()}
    assert len(same) == 1


def test_isotonic_is_the_monotone_fit():
    rng = np.random.default_rng(0)
    n, good = rng.integers(1, 9, 40).astype(float), None
    good = np.minimum(n, rng.integers(0, 9, 40)).astype(float)
    level = quality.isotonic(n, good)
    assert (np.diff(level) >= -1e-12).all()

    def loss(x):
        return (n * (good / n - x) ** 2).sum()

    for _ in range(300):
        other = np.sort(np.clip(level + rng.normal(0, 0.1, 40), 0, 1))
        assert loss(level) <= loss(other) + 1e-9


def test_fourier_features_approximate_the_kernel():
    x = np.random.default_rng(1).normal(0, 1, (40, 10))
    z = quality.fourier(x, features=20_000)[:, :20_000]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-d / (2 * quality.WIDTH**2))).max() < 0.05


# --- context-tree weighting ---------------------------------------------------------

def brute_tree(texts, depth, share):
    """CTW of each of the 255 decisions by recursion over contexts."""
    mark = bytes([ctw.END])
    counts = [Counter() for _ in range(depth + 1)]
    for t in texts:
        x = mark * depth + (t or "").encode().lower() + mark
        for i in range(depth, len(x)):
            for d in range(depth + 1):
                counts[d][x[i - d:i], x[i]] += 1
    total = sum(counts[0].values())
    size = [Counter() for _ in counts]
    for d, c in enumerate(counts):
        for (s, _), n in c.items():
            size[d][s] += n
    kept = [{s for s, n in z.items() if n * share >= total} for z in size]
    kept[0] = {b""}

    def pair(table, s, low, high):
        mid = (low + high) // 2
        return sum(table[s, b] for b in range(low, mid)), sum(table[s, b] for b in range(mid, high))

    def log_kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - 2 * math.lgamma(.5) - math.lgamma(a + b + 1)

    def node(s, low, high):
        """log weighted probability, KT pair, rest pair, kept children."""
        d = len(s)
        a, b = pair(counts[d], s, low, high)
        kids = [bytes([c]) + s for c in range(256) if d < depth and bytes([c]) + s in kept[d + 1]]
        if not kids:
            return log_kt(a, b), (a, b), None, kids
        inner = [pair(counts[d + 1], k, low, high) for k in kids]
        rest = (a - sum(x for x, _ in inner), b - sum(y for _, y in inner))
        split = log_kt(*rest) + sum(node(k, low, high)[0] for k in kids)
        return np.logaddexp(log_kt(a, b), split) + math.log(.5), (a, b), rest, kids

    def p_one(context, low, high, s=b""):
        w, (a, b), rest, kids = node(s, low, high)
        own = (b + .5) / (a + b + 1)
        if not kids:
            return own
        g = math.exp(math.log(.5) + log_kt(a, b) - w)
        longer = context[len(context) - len(s) - 1:]
        if longer in kids:
            return g * own + (1 - g) * p_one(context, low, high, longer)
        return g * own + (1 - g) * (rest[1] + .5) / (sum(rest) + 1)

    def score(t):
        x = mark * depth + (t or "").encode().lower() + mark
        log = 0.0
        for i in range(depth, len(x)):
            low, high = 0, 256
            while high - low > 1:
                p, mid = p_one(x[i - depth:i], low, high), (low + high) // 2
                low, high, q = (mid, high, p) if x[i] >= mid else (low, mid, 1 - p)
                log += math.log10(q)
        return log

    return score


@pytest.mark.parametrize("depth,share", [(2, 40), (3, 12)])
def test_ctw_equals_recursion(spark, depth, share):
    train = ["abracadabra", "", None, "Ab ab ba é", "bar bar abra"]
    df = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string").repartition(3)
    tree = ctw.fit(df, depth, share)
    want = brute_tree(train, depth, share)
    texts = ["abra", "", "xyz é", "BAR ab"]
    assert np.allclose(tree.score(texts), [want(t) for t in texts], atol=1e-4)


def test_ctw_probabilities_sum_to_one(spark, docs):
    tree = ctw.fit(docs, 3, 500)
    assert np.allclose((10.0 ** tree.log10p.astype(float)).sum(1), 1, atol=1e-3)


@pytest.mark.parametrize("head", [ctw.HEAD, 8])
def test_scores(spark, docs, rows, monkeypatch, head):
    monkeypatch.setattr(ctw, "HEAD", head)
    training = docs.where(quality.crc_remainder(F.col("doc_id"), 7) != 2)
    words = {r[0]: [*(r[1] or "").encode().lower().split(), b" "] for r in rows}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    tree = ctw.fit(training)
    got = {r["doc_id"]: r for r in ctw.scores(docs, training).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, ws = got[r[0]], words[r[0]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(g["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs_tol=1e-6)
        assert math.isclose(g["score"], float(tree.score([r[1]])[0]), rel_tol=1e-6)


def test_scores_use_every_context(spark, monkeypatch):
    """Contexts far rarer than one in 2^16 bytes are nodes; in many slices."""
    monkeypatch.setattr(ctw, "SLICE", 8)
    rng = random.Random(5)
    common = ["".join(rng.choices("ab ", k=4000)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*common, "Qwxyz Qwxyz é", None])), "doc_id long, text string").repartition(3)
    some = spark.createDataFrame(list(enumerate(["Qwxyz", "ab ba", "qwxzz", "", "ÿ"])), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.scores(some, df, 3).collect()}
    want = brute_tree([*common, "Qwxyz Qwxyz é", None], 3, 1 << 60)
    for i, t in enumerate(["Qwxyz", "ab ba", "qwxzz", "", "ÿ"]):
        assert math.isclose(got[i], want(t), rel_tol=1e-5), (t, got[i], want(t))


def test_scores_of_repeated_and_empty(spark):
    df = odd.repeated(spark)
    assert ctw.scores(df, df).count() == 6 and ctw.scores(odd.empty(spark), df).count() == 0
    untrained = ctw.scores(df, odd.empty(spark)).where("doc_id = 2").first()
    assert untrained["train_tokens"] == 0 and untrained["n_known"] == 0 and untrained["base_score"] == 0
    assert math.isclose(untrained["bits_per_byte"], 8, abs_tol=1e-4)


def test_strings_of_a_chunk_take_few_times_its_bytes():
    """All positions of a chunk at once took over 25 times the chunk's bytes."""
    rng = np.random.default_rng(3)
    raw = [rng.choice(np.frombuffer(b"abc de", np.uint8), n).tobytes() for n in [0, 3 << 20, *[5000] * 1000, 1, 0]]
    joined = np.frombuffer(b"".join(raw), np.uint8)
    data = ctw.pack(np.arange(len(raw)), np.zeros(len(raw), np.uint8), np.cumsum([len(r) for r in raw]), joined)
    tracemalloc.start()
    chunk = ctw.Strings(data, 3, 2, 7)
    value = {k: float(k % 1009) for k in chunk.keys.tolist()}
    got = chunk.sums(np.array(list(value.values()), np.float32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(joined)
    for i in (0, 1, 2, 500, len(raw) - 2, len(raw) - 1):
        x, at, _ = ctw.byte_rows([raw[i]], 3)
        keys = sum(x[at - d].astype(int) << 8 * d for d in range(4))
        assert got[i] == sum(value[k] for k in keys.tolist())


def test_strings_are_counted_in_few_times_their_bytes():
    """Blocks of strings took over 25 times the bytes of their texts."""
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(97, 101, 1 << 15))) for _ in range(16)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])] * 18
    tracemalloc.start()
    got = [(s, n) for b in ctw._strings(5)(iter(batches)) for s, n in zip(b["s"].to_pylist(), b["n"].to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 22 * ctw.BLOCK
    x, at, _ = ctw.byte_rows(texts, 5)
    want = Counter(sum(x[at - d].astype(int) << 8 * d for d in range(6)).tolist())
    assert dict(got) == {s: 18 * n for s, n in want.items()}


def test_log_gammas_of_small_and_large_counts():
    n = np.array([[0, 1, 7, ctw.TABLE - 1], [ctw.TABLE, ctw.TABLE + 1, 10**9, 3]])
    for more in (0.5, 1.0):
        assert np.allclose(ctw._log_gamma(n, more), [[math.lgamma(x + more) for x in r] for r in n.tolist()], rtol=1e-12)


# --- I-Match -------------------------------------------------------------------------

def test_imatch_equals_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    want = {r[0]: r for r in con.execute(imatch.ORACLE).fetchall()}
    got = {r["doc_id"]: tuple(r) for r in imatch.fingerprints(docs).collect()}
    assert got == want


def test_imatch_edited_texts_and_equal_texts(spark, docs, rows):
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs).collect()}
    order = sorted(rows)
    import hashlib

    seen = {}
    for k, (i, t, *_) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want = t[:len(t) - half] + following[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(want.encode()).hexdigest())
        assert seen.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1


def test_imatch_runs_without_python(spark, docs):
    plan = imatch.fingerprints(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


def test_imatch_of_repeated_and_empty(spark):
    got = imatch.fingerprints(odd.repeated(spark)).collect()
    assert len(got) == 6 and {r["n_chars"] for r in got if r["doc_id"] == 1} == {23}
    assert imatch.fingerprints(odd.empty(spark)).count() == 0
    one = imatch.fingerprints(odd.frame(spark, [(1, "a b c d", "e", "s", 1)], 1)).first()
    assert one["near_next"] == 1.0


def test_imatch_covers_every_term_and_counts_copies_once(spark):
    """A text of which half of all rows are copies keeps its band terms; texts of
    long or rare words alone have fingerprints of their own."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    texts = [" ".join(rng.sample(words, 8)) for _ in range(100)] + ["copied text " + " ".join(words[:12])] * 100
    texts += ["x" * 300, "y" * 300, "x" * 300 + " " + "y" * 300, "z " * 40]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = imatch.fingerprints(odd.frame(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["fingerprint"], set()).add(" ".join(sorted(set(texts[r["doc_id"]].split()))))
    assert all(len(x) == 1 for x in by.values())
    copied = next(r for r in got if r["doc_id"] == 100)
    subsets = [copied["fingerprint"][i:i + imatch.DIGITS] for i in range(0, len(copied["fingerprint"]), imatch.DIGITS)]
    assert len(subsets) == imatch.SUBSETS + 1 and sum(h != imatch.EMPTY for h in subsets) > 4
    lex = {r["term"]: [int(r["ks"][i:i + imatch.NUMBER]) for i in range(0, len(r["ks"]), imatch.NUMBER)] for r in imatch.lexicon(imatch.texts(odd.frame(spark, rows))).collect()}
    assert {"x" * 300, "y" * 300, "z"} <= set(lex)
    for ks in lex.values():
        assert [sum(i * imatch.DEALT <= k < (i + 1) * imatch.DEALT for k in ks) for i in range(imatch.DEALS)] == [1] * imatch.DEALS


def test_imatch_query_equals_its_twin(spark, sf_small):
    from storylens.llm import queries

    got = queries.QUERIES["op7_imatch_fingerprints"](spark, sf_small).collect()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_small}/documents.parquet'")
    want = {r[0]: r for r in con.execute(queries.ORACLE["op7_imatch_fingerprints"]).fetchall()}
    assert {r["doc_id"]: tuple(r)[:5] for r in got} == {k: v[:5] for k, v in want.items()}
    assert all(math.isclose(r[i], want[r["doc_id"]][i], abs_tol=1e-12) for r in got for i in (5, 6))
