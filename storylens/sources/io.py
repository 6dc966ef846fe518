"""Scans and sinks.

Each text format has a parse step (DataFrame -> DataFrame) and a reader
(path -> DataFrame) so the same logic runs on files and on derived columns.
Sinks write partitioned tables; the resumable forms live in
``storylens.streaming.incremental``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
)

from storylens.constants import PROMPT_DELIMITER
from storylens.functions.indexing import scan_order_index, sequential_index
from storylens.operators.lexicon import dedupe_last_wins
from storylens.session import ensure_checkpoint_dir

STORY_ROW_SCHEMA = StructType([
    StructField("p_ind", IntegerType()), StructField("s_ind", IntegerType()), StructField("text", StringType()),
])
SCORE_ROW_SCHEMA = "p_ind INT, s_ind INT, score DOUBLE"


def _strip(col) -> "F.Column":
    """Python ``str.strip()``: leading and trailing whitespace of any kind."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


# --- S01 / S02: text lines ----------------------------------------------------

def _below(spark: SparkSession, path: str) -> "F.Column":
    """Path of a row's file below `path` (of the file itself: its name)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath().rstrip("/")
    full = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^[a-zA-Z0-9+.-]+:(//[^/]*)?", ""),
                                  F.lit("+"), F.lit("%2B")))
    return F.when(full.startswith(root + "/"), F.substring(full, len(root) + 2, 1 << 20)).otherwise(F.col("_metadata.file_name"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every file under `path`: ``(file, line_no, text)``, ``file`` by
    its path below `path`, 0-based line numbers in file order. Large files are split; a line's number is its
    place in its split plus the lines of the file's splits before it. The
    scan is stored with its places first, so both come from the same splits."""
    ensure_checkpoint_dir(spark)
    d = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path).select(
        _below(spark, path).alias("file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text")).checkpoint()
    splits = d.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # a row for each split: the window is over the splits of one file
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return d.join(splits, ["file", "_split"]).select(
        "file", (F.col("_id") - F.col("_first") + F.col("_off")).cast("int").alias("line_no"), "text")


def pair_lines(prompts: DataFrame, stories: DataFrame) -> DataFrame:
    """Pair prompt and story lines by (file, line number); the story side
    drives the length and a missing prompt line is an error. Prompt stripped,
    story kept."""
    j = stories.select("file", "line_no", F.col("text").alias("story")).join(
        prompts.select("file", "line_no", F.col("text").alias("prompt")), ["file", "line_no"], "left"
    )
    return j.select(
        "file", "line_no",
        F.when(F.col("prompt").isNull(), F.raise_error(F.lit("prompt file is shorter than story file")))
        .otherwise(_strip(F.col("prompt"))).alias("prompt"),
        "story",
    )


def read_paired_lines(spark: SparkSession, prompt_path: str, story_path: str) -> DataFrame:
    """S01 on two folders (or files) of line-aligned text."""
    return pair_lines(read_lines(spark, prompt_path), read_lines(spark, story_path))


def parse_delimited(lines: DataFrame, col: str = "line") -> tuple[DataFrame, DataFrame]:
    """Split on `` <endprompt> ``; piece 0 = prompt, piece 1 = story,
    later pieces dropped, both right-trimmed. Blank lines are dropped; lines
    without the delimiter go to the rejects table. Returns (rows, rejects)."""
    d = lines.filter(~F.col(col).rlike(r"^\s*$"))
    d = d.withColumn("_p", F.split(F.col(col), r"\Q" + PROMPT_DELIMITER + r"\E"))
    ok = d.filter(F.size("_p") >= 2)
    rej = d.filter(F.size("_p") < 2).drop("_p")
    rows = ok.select(
        *[c for c in lines.columns if c != col],
        F.regexp_replace(F.element_at("_p", 1), r"\s+$", "").alias("prompt"),
        F.regexp_replace(F.element_at("_p", 2), r"\s+$", "").alias("story"),
    )
    return rows, rej


# --- S03 / S04: story mapping -------------------------------------------------

def parse_story_mapping(doc: DataFrame, col: str = "value") -> DataFrame:
    """A JSON object prompt -> [stories] to ``(p_ind, s_ind, prompt, story)``;
    indices follow object order and list order."""
    m = doc.select(F.from_json(F.col(col), MapType(StringType(), ArrayType(StringType()))).alias("m"))
    e = m.select(F.posexplode(F.map_entries("m")).alias("p_ind", "kv"))
    s = e.select("p_ind", F.col("kv.key").alias("prompt"), F.posexplode("kv.value").alias("s_ind", "story"))
    return s.select(F.col("p_ind").cast("int"), F.col("s_ind").cast("int"), "prompt", "story")


_STRINGS = "_file string, _split long, _seq long, kind string, key boolean, keys long, elems long, base long, parts array<string>"


def _strings(batches):
    """Pieces between quotes of whole splits, in order, to strings and parts of
    strings, with how many keys and list elements began in the split so far."""
    at, out = None, []
    inside = here = key = False
    parts, seq, keys, elems, base = [], 0, 0, 0, None

    def put(kind):
        out.append((*at, seq, kind, key if here else None, keys, elems, base, parts))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_file", "_split", "_odd", "value")]
        for file, split, starts_inside, piece in zip(*columns, strict=True):
            if (file, split) != at:
                if at is not None and inside:
                    put("opens" if here else "inside")
                at, inside, here = (file, split), starts_inside, False
                parts, seq, keys, elems, base = [], 0, 0, 0, None
            if inside:
                parts.append(piece)
                if (len(piece) - len(piece.rstrip("\\"))) % 2 == 0:  # else the quote is escaped
                    put("whole" if here else "ends")
                    inside, here, parts, seq = False, True, [], seq + 1
            else:  # what stands before a string tells what it is
                mark = max("[]{", key=piece.rfind)
                key = mark != "[" and mark in piece
                if key:
                    keys, base = keys + 1, elems
                else:
                    elems += 1
                inside = here = True
        yield _string_batch(out)
        out = []
    if at is not None and inside:
        put("opens" if here else "inside")
    yield _string_batch(out)


def _string_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      [c.split()[0] for c in _STRINGS.split(", ")])


def read_story_mapping(spark: SparkSession, path: str) -> DataFrame:
    """S03 on JSON object files (prompt -> [stories]), each read by many tasks:
    ``(p_ind, s_ind, prompt, story)``, prompts numbered in file-name order, then
    object order, a prompt that stands twice as two.

    Files are split at quotes. A split reports the parity of its quotes that no
    backslash escapes, a prefix over a file's splits tells whether a split begins
    inside a string, and the marks between strings tell keys (after ``{`` or
    ``]``) from list elements. Splits count both, sums over earlier splits give
    the indices, and stories meet their prompt in a join, so neither an object
    nor a prompt's list is ever one row."""
    ensure_checkpoint_dir(spark)
    d = spark.read.option("lineSep", '"').text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), "value")
    splits = Window.partitionBy("_file").orderBy("_split")
    before = splits.rowsBetween(Window.unboundedPreceding, -1)
    closes = (F.length(F.regexp_extract("value", r"(\\*)$", 1)) % 2 == 0).cast("int")
    # one row for each split of a file: small windows, and the bound of the broadcasts
    odd = d.groupBy("_file", "_split").agg(F.sum(closes).alias("_q")).select(
        "_file", "_split", (F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2 == 1).alias("_odd"))
    found = d.join(F.broadcast(odd), ["_file", "_split"]).mapInArrow(_strings, _STRINGS).checkpoint()
    n = found.groupBy("_file", "_split").agg(F.max("keys").alias("keys"), F.max("elems").alias("elems"), F.max("base").alias("base"))
    n = n.select("_file", "_split", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("keys", "elems")], "base")
    n = n.select("_file", "_split", "_keys", "_elems", F.max(F.col("base") + F.col("_elems")).over(before).alias("_base"))
    # a string over a border is put together from its parts
    so_far = Window.partitionBy("_file").orderBy("_split", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    cut = found.filter("kind != 'whole'").withColumn("_own", F.sum((F.col("kind") == "opens").cast("int")).over(so_far))
    joined = cut.groupBy("_file", "_own").agg(
        F.array_sort(F.collect_list(F.struct("_split", "_seq", "parts"))).alias("_p"),
        F.max(F.when(F.col("kind") == "opens", F.struct("_split", "key", "keys", "elems", "base"))).alias("_o"),
        F.max(F.col("kind") == "ends").alias("_closed"))
    # the end of a file looks like the opening of one more string
    joined = joined.filter("_closed").select("_file", "_o.*", F.flatten(F.col("_p.parts")).alias("parts"))
    strings = found.filter("kind = 'whole'").select(*joined.columns).union(joined).join(F.broadcast(n), ["_file", "_split"])
    text = F.from_json(F.concat(F.lit('["'), F.array_join("parts", '"'), F.lit('"]')), "array<string>")[0]
    strings = strings.select("_file", "key", (F.col("_keys") + F.col("keys") - 1).alias("_p"), (
        F.col("_elems") + F.col("elems") - 1 - F.coalesce(F.col("base") + F.col("_elems"), F.col("_base"))).alias("s_ind"),
        text.alias("text"))
    prompts = strings.filter("key").select("_file", "_p", F.col("text").alias("prompt"))
    # one row for each file
    files = prompts.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(
        Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    prompts = prompts.join(F.broadcast(files), "_file").withColumn("p_ind", F.col("_first") + F.col("_p"))
    return strings.filter("not key").join(prompts, ["_file", "_p"]).select(
        F.col("p_ind").cast("int"), F.col("s_ind").cast("int"), "prompt", F.col("text").alias("story"))


def write_story_mapping_objects(stories: DataFrame, path: str, prompts_per_file: int = 1000) -> None:
    """S04 in the object form: one JSON object (prompt -> ordered stories) per
    file of `prompts_per_file` consecutive prompts, a line for each story, so
    that neither an object nor a prompt's list is ever one row."""
    d = stories.withColumn("_file", F.coalesce(F.format_string("%09d", F.floor(F.col("p_ind") / prompts_per_file)), F.lit("")))
    order = Window.partitionBy("_file").orderBy("p_ind", "s_ind")
    d = d.select("*", F.lag("p_ind").over(order).alias("_before"), F.lead("p_ind").over(order).alias("_after"))

    def text(c):  # a JSON string, or null
        j = F.to_json(F.array(c))
        return F.substring(j, F.lit(2), F.length(j) - 2)

    opens = F.col("_before").isNull() | (F.col("_before") != F.col("p_ind"))
    key = F.when(F.col("prompt").isNull(), F.raise_error(F.lit("a prompt is null")).cast("string")).otherwise(text("prompt"))
    value = F.concat(
        F.when(F.col("_before").isNull(), "{").when(opens, "], ").otherwise(", "),
        F.when(opens, F.concat(key, F.lit(": ["))).otherwise(""),
        text("story"),
        F.when(F.col("_after").isNull(), "]}").otherwise(""))
    # the window leaves each file's rows in order, and the writer keeps it
    d.select(value.alias("value"), "_file").write.partitionBy("_file").text(path)


STORY_LINES_SCHEMA = StructType([
    StructField("p_ind", IntegerType()), StructField("s_ind", IntegerType()), StructField("prompt", StringType()),
    StructField("story", StringType()),
])


def read_story_lines(spark: SparkSession, path: str) -> DataFrame:
    """S03 at scale: JSON Lines, one story per line with its indices."""
    return spark.read.schema(STORY_LINES_SCHEMA).json(path)


def group_story_mapping(stories: DataFrame) -> DataFrame:
    """S04's interchange form: one row per prompt with its stories in order.
    A prompt's stories must fit in one row; ``write_story_mapping`` has no
    such limit."""
    g = stories.groupBy("p_ind", "prompt").agg(F.array_sort(F.collect_list(F.struct("s_ind", "story"))).alias("_s"))
    return g.select(F.col("p_ind").cast("long"), "prompt", F.col("_s.story").alias("stories"))


def write_story_mapping(stories: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines, one story per row with its indices (readable by
    ``read_story_lines``), so a prompt may have any number of stories."""
    stories.select(F.col("p_ind").cast("int").alias("p_ind"), F.col("s_ind").cast("int").alias("s_ind"), "prompt",
                   "story").write.mode(mode).json(path)


# --- S05 / S06 / S07: processed-story directories ------------------------------

def _list_dirs(spark: SparkSession, path: str) -> list[str]:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [st.getPath().toString() for st in fs.listStatus(p) if st.isDirectory()]


def _story_dir_glob(spark: SparkSession, path: str) -> str:
    """Files one level down when the directory has a subfolder, else the directory."""
    base = path.rstrip("/")
    return f"{base}/*/" if _list_dirs(spark, base) else base


def _pieces(batches):
    """Lines of whole splits, in order, to records and parts of records."""
    key, odd, lines, seq, here, out = None, False, [], 0, True, []

    def close():
        if lines:  # the record goes on in the next split
            out.append((*key, seq, "\n".join(lines), "opens" if here else "inside"))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_file", "_split", "_odd", "value")]
        for file, split, starts_odd, text in zip(*columns, strict=True):
            if (file, split) != key:
                close()
                key, odd, lines, seq, here = (file, split), starts_odd, [], 0, not starts_odd
            lines.append(text)
            odd ^= bool(text.count('"') % 2)
            if not odd:
                out.append((file, split, seq, "\n".join(lines), "whole" if here else "ends"))
                lines, seq, here = [], seq + 1, True
        yield _piece_batch(out)
        out = []
    close()
    yield _piece_batch(out)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      ["_file", "_split", "_seq", "record", "kind"])


def csv_records(lines: DataFrame) -> DataFrame:
    """Records of multi-line CSV files from ``spark.read.text`` lines:
    ``(_file, _row, record)``, ``_row`` by place in the file.

    Files are split. A line ends a record if an even number of quotes stands
    before its end (doubled quotes count twice), so each split reports the parity
    of its quotes, a prefix over a file's splits tells whether a split begins
    inside quotes, and its lines are then cut where they close. A record over a
    border is put together from its parts, two for each split at most."""
    d = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # one row for each split of a file: small windows, and the bound of the broadcast
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    odd = d.groupBy("_file", "_split").agg(F.sum(quotes).alias("_q")).select(
        "_file", "_split", (F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2 == 1).alias("_odd"))
    pieces = d.join(F.broadcast(odd), ["_file", "_split"]).mapInArrow(
        _pieces, "_file string, _split long, _seq long, record string, kind string")
    so_far = Window.partitionBy("_file").orderBy("_split", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = pieces.filter("kind != 'whole'").withColumn("_own", F.sum((F.col("kind") == "opens").cast("int")).over(so_far))
    joined = parts.groupBy("_file", "_own").agg(F.array_sort(F.collect_list(F.struct("_split", "_seq", "record"))).alias("_p"))
    joined = joined.select("_file", F.struct(F.col("_p")[0]["_split"].alias("_split"), F.col("_p")[0]["_seq"].alias("_seq")).alias("_row"),
                           F.array_join(F.col("_p.record"), "\n").alias("record"))
    whole = pieces.filter("kind = 'whole'").select("_file", F.struct("_split", "_seq").alias("_row"), "record")
    return whole.union(joined).withColumn("record", F.regexp_replace("record", r"\r$", "")).filter("record != ''")


def read_csv_rows(spark: SparkSession, path: str, schema, prefix: str = "prompts") -> DataFrame:
    """Headerless multi-line CSV rows with the source file and row order kept:
    of files whose name up to the first ``_`` is `prefix`, or of the range
    folders ``<prefix>_range=...`` that the sinks here write. Fields with line
    breaks or quotes are quoted, quotes inside them doubled; one large file is
    read by many tasks."""
    reader = spark.read.option("lineSep", "\n")
    base = path.rstrip("/")
    if any(d.rsplit("/", 1)[-1].startswith(f"{prefix}_range=") for d in _list_dirs(spark, base)):
        lines = reader.text(f"{base}/{prefix}_range=*/")
    else:
        lines = reader.option("pathGlobFilter", f"{prefix}_*").text(_story_dir_glob(spark, base))
    ddl = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    parsed = F.from_csv("record", ddl, {"escape": '"', "multiLine": "true"})
    d = csv_records(lines).withColumn("_r", parsed)
    return d.select("_r.*", "_file", "_row")


def last_read_wins(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the last row of the last file by name."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]),
                                          F.struct("_file", "_row")).alias("_b"))
    return best.select(*keys, "_b.*").drop("_file", "_row")


def read_processed_stories(spark: SparkSession, path: str, start: int | None = None,
                           length: int | None = None) -> DataFrame:
    """S05 (and S06 with a prompt range): ``(p_ind, s_ind, text)``, text stripped."""
    d = read_csv_rows(spark, path, STORY_ROW_SCHEMA)
    if start is not None:
        d = d.filter(F.col("p_ind") >= start)
        if length is not None:
            d = d.filter(F.col("p_ind") < start + length)
    d = d.withColumn("text", _strip(F.coalesce(F.col("text"), F.lit(""))))
    return last_read_wins(d, ["p_ind", "s_ind"])


def parse_list_literal(col) -> "F.Column":
    """A Python list literal of strings (single, double or mixed quotes,
    backslash escapes) to ``array<string>``, parsed and never evaluated."""
    return F.from_json(
        col, ArrayType(StringType()),
        {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true",
         "allowUnquotedControlChars": "true"},
    )


def read_inferred_attrs(spark: SparkSession, path: str) -> DataFrame:
    """``(p_ind, s_ind, attrs array<string>)``."""
    d = read_csv_rows(spark, path, STORY_ROW_SCHEMA)
    d = d.withColumn("text", parse_list_literal(F.col("text")))
    return last_read_wins(d, ["p_ind", "s_ind"]).withColumnRenamed("text", "attrs")


# --- S08 / S09: lexicons and vectors --------------------------------------------

def parse_lexicon(rows: DataFrame, dim: str) -> DataFrame:
    """S08 on ``(line_no, word, score)``: rows with a missing word or score are
    dropped; the last duplicate wins at the first one's position."""
    d = rows.select(F.lit(dim).alias("dim"), "word", F.col("score").cast("double").alias("score"),
                    F.col("line_no").alias("ord"))
    d = d.filter(F.col("word").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    return dedupe_last_wins(d)


def read_lexicon(spark: SparkSession, path: str, dim: str) -> DataFrame:
    """Header CSV with ``word`` and ``score`` columns (CRLF handled)."""
    raw = spark.read.option("header", "true").csv(path)
    missing = {"word", "score"} - set(raw.columns)
    if missing:
        raise ValueError(f"lexicon {path} lacks columns {sorted(missing)}")
    raw = scan_order_index(raw.select("word", F.expr("try_cast(score AS DOUBLE)").alias("score")), "line_no")
    return parse_lexicon(raw, dim)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Parquet ``(word, vec array<float>)``."""
    return spark.read.parquet(path).select("word", "vec")


def lookup_vectors(words: DataFrame, vectors: DataFrame, col: str = "word") -> DataFrame:
    """Vector of the lower-cased word, null when absent."""
    v = vectors.select(F.col("word").alias("_vw"), "vec")
    return words.join(v, F.lower(F.col(col)) == F.col("_vw"), "left").drop("_vw")


# --- S10 / S11: analysis inputs -------------------------------------------------

INFO_SCHEMA = "p_ind INT, s_ind INT, s_id STRING, p_pov STRING, s_pov STRING"


def read_story_info(spark: SparkSession, path: str, schema: str = INFO_SCHEMA) -> DataFrame:
    """Gzip CSV with header (``.csv.gzip`` files are decompressed)."""
    return (
        spark.read.schema(schema).option("header", "true").option("multiLine", "true")
        .option("escape", '"').csv(path)
    )


def read_score_grid(spark: SparkSession, roots: dict[str, str], layout: str = "reference") -> DataFrame:
    """Score files per writer root, coordinates from the file path.

    ``reference`` layout: ``<root>/<dim>/<am>/<sm>/out_scores.csv``;
    ``hive`` layout: ``<root>/dim=<dim>/am=<am>/sm=<sm>/*.csv`` (as written by
    ``write_score_grid(fmt="csv")``). ``nan`` is read as NaN and folded to null.
    """
    out = None
    for writer, root in roots.items():
        base = root.rstrip("/")
        if layout == "reference":
            glob, pat = f"{base}/*/*/*/out_scores.csv", r"/([^/]+)/([^/]+)/([^/]+)/out_scores\.csv$"
        else:
            glob, pat = f"{base}/dim=*/am=*/sm=*/*.csv", r"/dim=([^/]+)/am=([^/]+)/sm=([^/]+)/[^/]+$"
        d = (
            spark.read.schema(SCORE_ROW_SCHEMA).option("header", "false").option("nanValue", "nan")
            .csv(glob)
        )
        fp = F.col("_metadata.file_path")
        d = d.select(
            F.lit(writer).alias("writer"),
            F.regexp_extract(fp, pat, 1).alias("dim"),
            F.regexp_extract(fp, pat, 2).alias("am"),
            F.regexp_extract(fp, pat, 3).alias("sm"),
            "p_ind", "s_ind",
            F.concat_ws("-", F.col("p_ind").cast("string"), F.col("s_ind").cast("string")).alias("s_id"),
            F.nanvl(F.col("score"), F.lit(None).cast("double")).alias("score"),
        )
        out = d if out is None else out.unionByName(d)
    return out


# --- sinks ------------------------------------------------------------------------

def write_score_grid(scores: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    """S12 layout: one directory per (writer, dim, am, sm); ``fmt="csv"``
    writes headerless ``p_ind, s_ind, score`` with ``nan`` for NaN."""
    w = scores.select("writer", "dim", "am", "sm", "p_ind", "s_ind", "score").write.mode(mode).partitionBy(
        "writer", "dim", "am", "sm")
    if fmt == "csv":
        w.option("header", "false").option("nanValue", "nan").csv(path)
    else:
        w.parquet(path)


def write_scores_by_pov(scores: DataFrame, path: str, mode: str = "append") -> None:
    """Rows (dim, pov, p_ind, s_ind, score), one folder per POV label."""
    scores.select("dim", "pov", "p_ind", "s_ind", "score").write.mode(mode).partitionBy("pov").parquet(path)


def _prompts_range(window: int) -> "F.Column":
    low = F.floor(F.col("p_ind") / window) * window
    return F.format_string("%d_%d", low, low + window - 1)


def write_processed_stories(stories: DataFrame, path: str, window: int = 10000, mode: str = "overwrite") -> None:
    """Headerless CSV ``p_ind, s_ind, text`` under one folder per prompt
    range of `window` prompts (the reference's file naming by index range)."""
    d = stories.select("p_ind", "s_ind", "text").withColumn("prompts_range", _prompts_range(window))
    d.write.mode(mode).partitionBy("prompts_range").option("escape", '"').option("quoteAll", "true").csv(path)


def python_list_literal(col) -> "F.Column":
    """An ``array<string>`` as Python's ``str(list)`` text (the reference's
    file format): single quotes, or double quotes when the item holds a
    single quote and no double quote; backslash and line breaks escaped."""

    def item(x):
        esc = F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")),
                                  F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
        dq = (F.instr(x, "'") > 0) & (F.instr(x, '"') == 0)
        return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(col, item), ", "), F.lit("]"))


def write_inferred_attrs(attrs: DataFrame, path: str, as_csv: bool = False, mode: str = "overwrite",
                         window: int = 10000) -> None:
    """``(p_ind, s_ind, attrs array<string>)`` as parquet, or headerless
    CSV with the list as a Python list literal, in the range folders of S14."""
    if as_csv:
        d = attrs.select("p_ind", "s_ind", python_list_literal(F.col("attrs")).alias("attrs"),
                         _prompts_range(window).alias("prompts_range"))
        d.write.mode(mode).partitionBy("prompts_range").option("escape", '"').option("quoteAll", "true").csv(path)
    else:
        attrs.select("p_ind", "s_ind", "attrs").write.mode(mode).parquet(path)


def write_eval_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``sp_corr, sp_p`` per trial, one folder per (dim, method)."""
    results.write.mode(mode).partitionBy("dim", "method").parquet(path)


def write_generated(stories: DataFrame, path: str) -> None:
    """Append ``(p_ind, role, full_prompt, story)``."""
    stories.select("p_ind", "role", "full_prompt", "story").write.mode("append").parquet(path)
