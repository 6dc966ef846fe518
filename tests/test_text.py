"""Golden rows: tag strip, truncation, newline markers, delimited lines, list literals."""

from pyspark.sql import functions as F

from storylens.functions import text as T
from storylens.sources import io


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_tag_strip(spark):
    cases = {
        "[ WP ] A prompt": "A prompt",
        "( EU ) Another": "Another",
        "( WP ] Mixed brackets": "Mixed brackets",
        "[WP] kept": "[WP] kept",
        "[ WPX ] kept": "[ WPX ] kept",
        "[ WP ] [ EU ] two tags": "two tags",
        "  \n padded \n": "padded",
    }
    for src, want in cases.items():
        assert _one(spark, T.strip_tags, src) == want, src


def test_truncation_500(spark):
    five = " ".join(["w"] * 500)
    assert _one(spark, T.truncate_words, five) == five
    with_spaces = "a  b " + " ".join(["w"] * 498)  # 500 words, inner double space kept
    assert _one(spark, T.truncate_words, with_spaces) == with_spaces
    long = "a  b " + " ".join(["w"] * 499)  # 501 words: collapsed
    out = _one(spark, T.truncate_words, long)
    assert out == " ".join(["a", "b"] + ["w"] * 498)
    assert len(out.split()) == 500


def test_newline_markers(spark):
    assert _one(spark, T.normalise_newlines, "a <newline> b < newline > c") == "a \n b \n c"


def test_delimited_lines(spark):
    df = spark.createDataFrame(
        [(1, "A prompt  <endprompt> A story \n"), (2, "   "), (3, "no delimiter"), (4, "p <endprompt> s <endprompt> t")],
        "k int, line string")
    rows, rej = io.parse_delimited(df, "line")
    got = {r["k"]: (r["prompt"], r["story"]) for r in rows.collect()}
    assert got == {1: ("A prompt", "A story"), 4: ("p", "s")}
    assert [r["k"] for r in rej.collect()] == [3]


def test_list_literals(spark):
    cases = [
        ("['a', 'b']", ["a", "b"]),
        ('["a", "b"]', ["a", "b"]),
        ("['a', \"it's\"]", ["a", "it's"]),
        ("['it\\'s', 'x']", ["it's", "x"]),
        ("[]", []),
        ("['']", [""]),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["a"] for r in df.select("i", io.parse_list_literal(F.col("t")).alias("a")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, cases[i]


def test_python_list_literal_round_trip(spark):
    items = ["plain", "it's", 'say "hi"', "both ' and \"", "back\\slash", "line\nbreak"]
    df = spark.createDataFrame([(items,)], "a array<string>")
    lit = df.select(io.python_list_literal(F.col("a")).alias("t")).first()["t"]
    assert lit == repr(items)
    back = spark.createDataFrame([(lit,)], "t string").select(io.parse_list_literal(F.col("t")).alias("a")).first()["a"]
    assert back == items
