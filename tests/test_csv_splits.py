"""Multi-line CSV files read by many tasks equal the one-task read."""

import csv
import random

import pytest

from storylens.sources import io

SCHEMA = "p_ind INT, s_ind INT, text STRING"


def _texts(n):
    rng = random.Random(n)
    bits = ["plain", "line\nbreak", 'a "quoted" word', '"', "\n\n", ",", "", "é\nü", 'ends"', '"starts', "\r\nwindows", "x" * 300,
            "\n".join('"q"' for _ in range(60))]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 5))).strip("\r\n") for _ in range(n)]


def _write(folder, name, texts, first=0, end="\n"):
    with open(f"{folder}/{name}", "w", newline="") as f:
        writer = csv.writer(f, lineterminator=end)
        for i, t in enumerate(texts, first):
            writer.writerow([i // 3, i % 3, t])


def _one_task(spark, folder):
    """Spark's own multi-line reader, which never splits a file."""
    rows = spark.read.schema(SCHEMA).option("multiLine", "true").option("escape", '"').csv(str(folder))
    return sorted((r["p_ind"], r["s_ind"], r["text"] or "") for r in rows.collect())


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0",
             "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_split_files_equal_the_one_task_read(spark, tmp_path, small_splits):
    texts = _texts(60)
    _write(tmp_path, "prompts_0.csv", texts)
    _write(tmp_path, "prompts_1.csv", texts[:7], first=300)
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    got = io.read_csv_rows(spark, str(tmp_path), io.STORY_ROW_SCHEMA).collect()
    assert sorted((r["p_ind"], r["s_ind"], r["text"] or "") for r in got) == _one_task(spark, tmp_path)
    first = sorted((r for r in got if r["_file"].endswith("prompts_0.csv")), key=lambda r: r["_row"])
    assert [3 * r["p_ind"] + r["s_ind"] for r in first] == list(range(60))  # rows in file order


def test_one_record_over_many_splits_and_line_ends(spark, tmp_path, small_splits):
    texts = ["short", "\n".join(f'line "{i}"' for i in range(200)), "after", ""]
    _write(tmp_path, "prompts_0.csv", texts, end="\r\n")
    got = io.read_csv_rows(spark, str(tmp_path), io.STORY_ROW_SCHEMA)
    assert [r["text"] or "" for r in sorted(got.collect(), key=lambda r: r["_row"])] == texts
    assert io.read_processed_stories(spark, str(tmp_path), 0, 1).count() == 3


def test_empty_files(spark, tmp_path):
    open(tmp_path / "prompts_0.csv", "w").close()
    assert io.read_csv_rows(spark, str(tmp_path), io.STORY_ROW_SCHEMA).count() == 0


def test_the_last_row_of_a_key_wins(spark, tmp_path, small_splits):
    _write(tmp_path, "prompts_0.csv", ["a", "b", "c"])
    with open(tmp_path / "prompts_0.csv", "a") as f:
        f.write('0,1,"new\nb"\n' + "".join(f"9,{i},x\n" for i in range(40)) + '0,1,"newest ""b"""\n')
    got = {(r["p_ind"], r["s_ind"]): r["text"] for r in io.read_processed_stories(spark, str(tmp_path)).collect()}
    assert got[0, 1] == 'newest "b"' and got[0, 0] == "a" and len(got) == 43
