"""Loads, batches, order and failures of a model."""

import os
import random

import pandas as pd

from storylens.operators import annotate as A


def _stories(spark, n=120, parts=6):
    rng = random.Random(1)
    rows = [(i, " ".join("word" for _ in range(rng.randint(0, 40)))) for i in range(n)] + [(n, None), (n + 1, "x" * 5000)]
    return spark.createDataFrame(rows, "s_key long, text string").repartition(parts), dict(rows)


def _run(model, texts):
    return [[(len(t), len(texts), max(map(len, texts)))] for t in texts]


SCHEMA = "s_key long, n int, batch int, longest int"


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(os.path.join(folder, f"{os.getpid()}"), "a") as f:
            f.write("x")
        return os.getpid()

    df, rows = _stories(spark, parts=24)
    for _ in range(2):  # more tasks than workers, and a second job
        got = A.annotate_with_model(df, f"count-{folder}", load, lambda model, texts: [[(model,)] for _ in texts],
                                    "s_key long, pid int").collect()
        assert {r["s_key"] for r in got} == set(rows)
    loads = {name: len((tmp_path / name).read_text()) for name in os.listdir(folder)}
    assert loads and set(loads.values()) == {1} and {r["pid"] for r in got} <= set(map(int, loads))


def test_batches_hold_texts_of_similar_length(spark):
    df, rows = _stories(spark)
    got = A.annotate_with_model(df, "lengths", lambda: None, _run, SCHEMA, batch_chars=600).collect()
    assert {r["s_key"]: r["n"] for r in got} == {k: len(t or "") for k, t in rows.items()}
    assert all(r["batch"] * r["longest"] <= 600 or r["batch"] == 1 for r in got) and max(r["batch"] for r in got) > 3


def test_results_do_not_depend_on_order_and_partitions(spark):
    df, _ = _stories(spark)
    a, b = (sorted((r["s_key"], r["n"]) for r in A.annotate_with_model(x, "order", lambda: None, _run, SCHEMA, gather_chars=c).collect())
            for x, c in ((df.orderBy("s_key").coalesce(1), 1 << 20), (df.orderBy("text").repartition(9), 50)))
    assert a == b


def test_a_story_that_fails_does_not_take_its_batch_along(spark):
    df, rows = _stories(spark)

    def run(model, texts):
        if any(len(t) == 5000 for t in texts):
            raise ValueError("too long")
        return _run(model, texts)

    got = A.annotate_with_model(df, "fails", lambda: None, run, SCHEMA, batch_chars=1 << 20).collect()
    assert {r["s_key"] for r in got} == set(rows) - {121}
    told = A.annotate_with_model(df, "fails", lambda: None, run, SCHEMA, batch_chars=1 << 20, error_col="error").collect()
    assert {r["s_key"]: r["error"] for r in told if r["error"]} == {121: "ValueError: too long"}
    assert len(told) == len(rows) and all(r["n"] is None for r in told if r["error"])


def test_short_answers_and_no_stories(spark):
    df, rows = _stories(spark, 5)
    told = A.annotate_with_model(df, "short", lambda: None, lambda m, t: [], SCHEMA, error_col="error").collect()
    assert len(told) == len(rows) and all("0 results for 1" in r["error"] for r in told)
    assert A.annotate_with_model(df.limit(0), "none", lambda: None, _run, SCHEMA).count() == 0


def test_a_function_over_batches(spark):
    df, rows = _stories(spark, 5)

    def fn(batches):
        for b in batches:
            yield pd.DataFrame({"s_key": b["s_key"], "n": b["text"].fillna("").str.len()})

    assert {r["s_key"]: r["n"] for r in A.annotate(df, fn, "s_key long, n long").collect()} == {k: len(t or "") for k, t in rows.items()}
