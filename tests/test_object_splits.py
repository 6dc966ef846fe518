"""JSON object files read by many tasks equal json.load."""

import json
import random

import pytest

from storylens.sources import io


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "61", "spark.sql.files.openCostInBytes": "0",
             "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _mapping(seed, n):
    rng = random.Random(seed)
    bits = ["plain ", 'a "quote" ', "back\\slash", "\\", '\\"', "[x], ", "{", "]: [", "line\nbreak", "é日本", "", "y" * 150, '"' * 80]

    def text():
        return "".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))

    return {f"{i} {text()}": [text() for _ in range(rng.choice([0, 1, 2, 7]))] for i in range(n)}


@pytest.mark.parametrize("form", [{}, {"indent": 1}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_split_files_equal_a_whole_read(spark, tmp_path, small_splits, form):
    files = {"a.json": _mapping(1, 25), "b.json": {}, "c.json": _mapping(2, 9)}
    for name, m in files.items():
        (tmp_path / name).write_text(json.dumps(m, **form), encoding="utf-8")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = sorted(map(tuple, io.read_story_mapping(spark, str(tmp_path)).collect()))
    want, p = [], 0
    for m in files.values():
        for prompt, stories in m.items():
            want += [(p, s, prompt, story) for s, story in enumerate(stories)]
            p += 1
    assert got == want


def test_one_long_list(spark, tmp_path, small_splits):
    stories = [f"story {i}" for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps({"one": [], "two": stories, "three": ["x"]}))
    got = sorted(map(tuple, io.read_story_mapping(spark, str(tmp_path)).collect()))
    assert got == [*[(1, i, "two", s) for i, s in enumerate(stories)], (2, 0, "three", "x")]
