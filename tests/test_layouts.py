"""Sources on files in the layouts that other tools write."""

from storylens.sources import io


def test_score_grid_reference_layout(spark, tmp_path):
    """``<root>/<dim>/<am>/<sm>/out_scores.csv``: headerless p_ind, s_ind, score."""
    roots = {}
    for writer, value in (("human", "0.25"), ("gpt-3.5", "nan")):
        root = tmp_path / writer
        for dim in ("valence", "power"):
            f = root / dim / "comet" / "axis" / "out_scores.csv"
            f.parent.mkdir(parents=True)
            f.write_text(f"0,0,{value}\n3,1,1.5\n")
        roots[writer] = str(root)
    got = {(r["writer"], r["dim"], r["am"], r["sm"], r["s_id"]): r["score"]
           for r in io.read_score_grid(spark, roots).collect()}
    want = {(w, d, "comet", "axis", s): v for w, first in (("human", 0.25), ("gpt-3.5", None))
            for d in ("valence", "power") for s, v in (("0-0", first), ("3-1", 1.5))}
    assert got == want


def test_processed_story_layouts(spark, tmp_path):
    """Files named ``prompts_*`` in the folder, or one level down; others are
    left alone; the last row of the last file wins."""
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "prompts_0_9.csv").write_text('0,0," a\nb "\n0,1,c\n')
    (flat / "prompts_9_19.csv").write_text("0,1,d\n")
    (flat / "other_0_9.csv").write_text("0,1,e\n")
    want = {(0, 0): "a\nb", (0, 1): "d"}
    assert {(r["p_ind"], r["s_ind"]): r["text"] for r in io.read_processed_stories(spark, str(flat)).collect()} == want
    deep = tmp_path / "deep"
    deep.mkdir()
    flat.rename(deep / "run1")
    assert {(r["p_ind"], r["s_ind"]): r["text"] for r in io.read_processed_stories(spark, str(deep)).collect()} == want


def test_sinks_read_back_without_renaming(spark, tmp_path):
    rows = [(0, 0, "a"), (25, 1, 'say "x", y'), (25, 2, "l1\nl2")]
    df = spark.createDataFrame(rows, "p_ind int, s_ind int, text string")
    io.write_processed_stories(df, str(tmp_path / "p"), window=20)
    got = io.read_processed_stories(spark, str(tmp_path / "p")).select("p_ind", "s_ind", "text").collect()
    assert sorted(tuple(r) for r in got) == rows
    attrs = spark.createDataFrame([(0, 0, ["a b", "it's"]), (30, 0, [])], "p_ind int, s_ind int, attrs array<string>")
    io.write_inferred_attrs(attrs, str(tmp_path / "a"), as_csv=True, window=20)
    got = io.read_inferred_attrs(spark, str(tmp_path / "a")).select("p_ind", "s_ind", "attrs").collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, ["a b", "it's"]), (30, 0, [])]


def test_lines_of_split_files(spark, tmp_path):
    """Line numbers hold when a file is read in several splits."""
    lines = [f"{'x' * (i % 37)} line {i}" if i % 11 else "" for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\r\n\ntwo")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = io.read_lines(spark, str(tmp_path))
        rows = sorted((r["file"], r["line_no"], r["text"]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == [("a.txt", i, t) for i, t in enumerate(lines)] + [
        ("b.txt", 0, "one\r"), ("b.txt", 1, ""), ("b.txt", 2, "two")]


def test_lines_of_files_with_equal_names_stay_apart(spark, tmp_path):
    for side in ("prompts", "stories"):
        for folder in ("a", "b c+d"):
            (tmp_path / side / folder).mkdir(parents=True)
            (tmp_path / side / folder / "x.txt").write_text("\n".join(f"{side} {folder} {i}" for i in range(3)) + "\n")
    lines = {(r["file"], r["line_no"]): r["text"] for r in io.read_lines(spark, str(tmp_path / "prompts")).collect()}
    assert lines == {(f"{f}/x.txt", i): f"prompts {f} {i}" for f in ("a", "b c+d") for i in range(3)}
    one = io.read_lines(spark, str(tmp_path / "stories" / "a" / "x.txt")).collect()
    assert {r["file"] for r in one} == {"x.txt"} and len(one) == 3
