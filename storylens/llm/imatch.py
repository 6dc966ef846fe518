"""I-Match document fingerprints, with DataFrame functions alone.

The lexicon holds the terms whose inverse document frequency lies in a band:
those in one of ``RARE`` texts at least and one of ``COMMON`` at most. A text
that is one in ``COPIED`` of all rows or more counts once however often it is
there (rarer copies, each under 1 / COPIED of all rows, count as texts: they
cannot take a term over a bound that is far higher). Each band term is in one of ``DEALT`` subsets of
each of ``DEALS`` random deals of the lexicon, and by its own hash in further
subsets at lower rates, which suit long texts. A text's fingerprint is the hash,
for each subset, of its distinct sorted terms in it, and one more of all its
distinct sorted terms, whatever their frequency.

Size bound of the broadcast lexicon: a term in one of RARE texts is counted
N / RARE times, and all N texts have N x (mean distinct terms) counts, so it has
RARE x (mean distinct terms) terms at most, of RARE x (mean text length) bytes,
however many documents there are.

Likeness of two fingerprints: of each rate's subsets in which either text has
terms, the share with equal hashes; then the mean over rates. If neither text
has a band term, 1 if all their own terms are equal (or they have none), else 0.

Documents are dealt by quantiles of doc_id, so a window finds the next one in
its part, and the first document of the following part is added at the end.
Null texts are empty ones: no terms, all subsets empty. Null doc_ids come
first. Rows with equal doc_id follow in the order of their texts, each with
its own result. The only document is its own next; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storylens.llm.common import prepare, shuffle_width, staged, texts

RARE = 2000
COMMON = 20
# At most so many texts are one in so many of all rows: the bound of a broadcast.
COPIED = 1 << 16
# Deals of all band terms to so many subsets each: a term is in one of each deal.
DEALS, DEALT = 2, 32
# Further subsets, and their rates: first three hex digits of a term's hash below.
MORE = 16
BELOW = ("020", "008", "002")
# Subsets of one rate stand together; the last hash is that of all terms.
RATES = [(0, DEALS * DEALT), *[(DEALS * DEALT + i * MORE, MORE) for i in range(len(BELOW))]]
SUBSETS = DEALS * DEALT + MORE * len(BELOW)
# A subset's hash: so many hex digits; these zeros where it has no term.
DIGITS = 8
# Digits of a subset's number.
NUMBER = 3
EMPTY = "0" * DIGITS
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def terms(text: Column) -> Column:
    """Distinct words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lowered."""
    words = F.split(F.translate(text, _UPPER, _UPPER.lower()), "[\\x20\\x09-\\x0D]+")
    return F.array_remove(F.array_distinct(words), "")


def _hash(salt, term: Column, digits: int) -> Column:
    return F.substring(F.md5(F.concat(salt, F.lit(":"), term).cast("binary")), 1, digits)


def subsets_of(term: Column) -> Column:
    """Numbers of the subsets that take a band term."""
    dealt = [F.conv(_hash(F.lit(f"deal {i}"), term, 4), 16, 10).cast("int") % DEALT + i * DEALT for i in range(DEALS)]
    more = F.sequence(F.lit(DEALS * DEALT), F.lit(SUBSETS - 1))
    below = F.array(*[F.lit(b) for b in BELOW])
    taken = F.filter(more, lambda k: _hash(k.cast("string"), term, 3) < F.get(
        below, F.floor((k - DEALS * DEALT) / MORE).cast("int")))
    return F.concat(F.array(*dealt), taken)


def lexicon(docs: DataFrame) -> DataFrame:
    """``term, ks``: terms of the band, and the numbers of the subsets that take
    each, ``NUMBER`` digits a subset."""
    keyed = docs.select("text", F.md5(F.col("text").cast("binary")).alias("h"))
    copies = staged(keyed.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    copied = F.broadcast(copies.where(F.col("copies") * COPIED >= docs.count()))
    # a text's copies have a weight of 1 together; sums are rounded to whole texts
    weight = F.lit(1.0) / F.coalesce("copies", F.lit(1))
    each = keyed.join(copied, "h", "left").select(weight.alias("w"), F.explode(F.concat(
        F.array(F.lit("")), terms(F.col("text")))).alias("term"))
    df = staged(each.groupBy("term").agg(F.round(F.sum("w")).cast("long").alias("df")), "frequencies")
    # every text has the empty term
    n = df.where("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    band = df.where((F.col("term") != "") & (F.col("df") * RARE >= n) & (F.col("df") * COMMON <= n))
    numbers = F.transform(subsets_of(F.col("term")), lambda k: F.lpad(k.cast("string"), NUMBER, "0"))
    return band.select("term", F.array_join(numbers, "").alias("ks"))


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` dealt to ``part`` by quantiles of doc_id, numbered by ``at``,
    with ``next_text``; the following part's first document is in each part
    once more, as ``extra``."""
    n = shuffle_width(docs.sparkSession)
    rows = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    shares = [i / n for i in range(1, n)]
    cuts = sorted(set(rows.select(F.percentile_approx("key", shares, 100 * n)).first()[0] or [])) if n > 1 else []
    held = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    rows = rows.withColumn("part", F.size(F.filter(held, lambda c: c <= F.col("key"))))
    # one row for each part
    least = sorted((r["part"], r["key"]) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())
    before = {key: least[i - 1][0] for i, (_, key) in enumerate(least)}
    rows = rows.withColumn("extra", F.lit(0))
    if before:
        to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        firsts = rows.where(F.col("key").isin(list(before))).select(
            "doc_id", "text", "key", F.element_at(to, F.col("key")).alias("part"), F.lit(1).alias("extra"))
        rows = rows.select("doc_id", "text", "key", "part", "extra").unionByName(firsts)
    w = Window.partitionBy("part").orderBy("extra", "key", "text")
    return rows.select("part", "extra", "doc_id", "text", F.row_number().over(w).alias("at"),
                       F.coalesce(F.lead("text").over(w), F.lit("")).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points, rounded down, replaced by the first as
    many of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def likeness(a: Column, b: Column) -> Column:
    """Mean over rates of the share of equal hashes among subsets where either
    has terms; see the module."""
    shares = []
    for first, many in RATES:
        both = F.arrays_zip(F.slice(a, first + 1, many).alias("a"), F.slice(b, first + 1, many).alias("b"))
        full = F.filter(both, lambda x: (x["a"] != EMPTY) | (x["b"] != EMPTY))
        same = F.size(F.filter(full, lambda x: x["a"] == x["b"]))
        shares.append(F.when(F.size(full) > 0, same / F.size(full)))
    filled = F.filter(F.array(*shares), lambda x: x.isNotNull())
    total = F.aggregate(filled, F.lit(0.0), lambda acc, x: acc + x)
    whole = F.when(F.element_at(a, -1) == F.element_at(b, -1), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.size(filled) > 0, total / F.size(filled)).otherwise(whole)


def _whole(own: Column) -> Column:
    """The hash of all terms."""
    joined = F.array_join(F.sort_array(own), " ")
    return F.when(F.size(own) == 0, F.lit(EMPTY)).otherwise(F.substring(F.md5(joined.cast("binary")), 1, DIGITS))


def _entries(met: Column) -> Column:
    """Sorted strings of a subset's number and a term, of all subsets and terms."""
    return F.sort_array(F.flatten(F.transform(met, lambda x: F.transform(
        F.sequence(F.lit(1), F.length(x["ks"]), F.lit(NUMBER)), lambda i: F.concat(F.substring(x["ks"], i, F.lit(NUMBER)), x["term"])))))


def _hashes(entries: Column) -> Column:
    """Number and hash of each subset that has terms. Neighbours of one subset are
    joined by spaces, subsets by line breaks; terms have neither."""
    before = F.slice(F.concat(F.array(F.lit("")), entries), F.lit(1), F.size(entries))
    after = F.lit(NUMBER + 1)
    pieces = F.zip_with(entries, before, lambda x, p: F.when(
        F.left(x, F.lit(NUMBER)) == F.left(p, F.lit(NUMBER)), F.concat(F.lit(" "), F.substring(x, after, F.length(x)))).otherwise(
        F.concat(F.lit("\n"), x)))
    subsets = F.array_remove(F.split(F.array_join(pieces, ""), "\n"), "")
    return F.transform(subsets, lambda g: F.struct(
        F.left(g, F.lit(NUMBER)).cast("int").alias("k"),
        F.substring(F.md5(F.substring(g, after, F.length(g)).cast("binary")), 1, DIGITS).alias("h")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` of every row of ``docs``."""
    prepare(docs.sparkSession)
    docs = texts(docs)
    # bounded as the module says
    lex = F.broadcast(staged(lexicon(docs), "lexicon"))
    rows = in_order(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("part", "at", F.col("extra").cast("string").alias("extra"), "doc_id", terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("other"),
                       F.char_length("text").cast("string").alias("n_chars"),
                       F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    about = F.concat_ws(":", "n_chars", "edited_sha256", _whole(F.col("own")), _whole(F.col("other")), "extra",
                        F.col("doc_id").cast("string"))
    # one row for each term of the text (side 0), of the edited text (1), and
    # one that carries what is known of the document (2)
    pos = rows.select("part", "at", F.size("own").alias("n0"), (F.size("own") + F.size("other")).alias("n1"),
                      F.posexplode(F.concat("own", "other", F.array(about))).alias("pos", "term"))
    side = F.when(F.col("pos") < F.col("n0"), 0).when(F.col("pos") < F.col("n1"), 1).otherwise(2)
    each = pos.select("part", "at", side.alias("side"), F.col("term"))
    met = each.join(lex, "term", "left").where("ks is not null or side = 2")
    # a row for each band term of a text is all that is sorted
    doc = met.groupBy("part", "at").agg(
        F.split(F.max(F.when(F.col("side") == 2, F.col("term"))), ":").alias("about"),
        *[F.collect_list(F.when(F.col("side") == s, F.struct("ks", "term"))).alias(f"m{s}") for s in (0, 1)])
    doc = doc.select("part", "at", "about", *[_entries(F.col(f"m{s}")).alias(f"m{s}") for s in (0, 1)])
    doc = doc.select("part", "at", "about", *[_hashes(F.col(f"m{s}")).alias(f"m{s}") for s in (0, 1)])

    def filled(m: str, whole: int) -> Column:
        own = F.col(m)  # named twice: a single use inside a lambda would be computed once for each element
        absent = F.array_except(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), F.transform(own, lambda x: x["k"]))
        found = F.sort_array(F.concat(own, F.transform(absent, lambda k: F.struct(k.alias("k"), F.lit(EMPTY).alias("h")))))
        return F.concat(F.transform(found, lambda x: x["h"]), F.array(F.col("about")[whole]))

    doc = doc.select("part", "at", F.col("about")[4].cast("int").alias("extra"), F.try_element_at("about", F.lit(6)).cast(
        "long").alias("doc_id"), "about", filled("m0", 2).alias("f0"), filled("m1", 3).alias("f1"))
    following = F.lead("f0").over(Window.partitionBy("part").orderBy("at"))
    doc = doc.withColumn("f2", F.coalesce(following, "f0")).where("extra = 0")
    return doc.select(
        "doc_id", F.col("about")[0].cast("long").alias("n_chars"), F.col("about")[1].alias("edited_sha256"),
        F.array_join("f0", "").alias("fingerprint"), F.array_join("f1", "").alias("edited_fingerprint"),
        likeness(F.col("f0"), F.col("f1")).alias("near_edited"), likeness(F.col("f0"), F.col("f2")).alias("near_next"))


_WORDS = "list_distinct(regexp_extract_all(translate({0}, '" + _UPPER + "', '" + _UPPER.lower() + "'), '[^\\x20\\x09-\\x0D]+'))"
_DEALT = [f"('0x' || substr(md5('deal {i}:' || term), 1, 4))::INT % {DEALT} + {i * DEALT} = k" for i in range(DEALS)]
_MORE = " WHEN ".join(f"k < {first + many} THEN substr(md5(k::VARCHAR || ':' || term), 1, 3) < '{b}'"
                      for (first, many), b in zip(RATES[1:], BELOW, strict=True))


def _likeness(other: str) -> str:
    """SQL for the likeness of the hash lists ``l`` and ``other``."""
    shares = []
    for first, many in RATES:
        z = f"list_zip(l[{first + 1}:{first + many}], {other}[{first + 1}:{first + many}])"
        full = f"list_filter({z}, lambda x: x[1] <> '{EMPTY}' OR x[2] <> '{EMPTY}')"
        shares.append(f"len(list_filter({full}, lambda x: x[1] = x[2]))::DOUBLE / nullif(len({full}), 0)")
    return f"coalesce(list_avg([{', '.join(shares)}]), CASE WHEN l[-1] = {other}[-1] THEN 1.0 ELSE 0.0 END)::DOUBLE"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id),
             first_value(text) OVER (ORDER BY doc_id)) AS following,
             coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
e AS (SELECT doc_id, next_id, text, length(text) AS n_chars,
             left(text, length(text) - length(text) // 2) || left(following, length(text) // 2) AS edited FROM n),
u AS (SELECT text, CASE WHEN count(*) * {COPIED} >= (SELECT count(*) FROM d) THEN 1 ELSE count(*) END AS copies FROM d GROUP BY text),
t AS (SELECT term, sum(copies) AS df FROM (SELECT copies, unnest({_WORDS.format('text')}) AS term FROM u) GROUP BY term),
lex AS (SELECT term, k FROM t, range(0, {SUBSETS}) AS r(k)
        WHERE df * {RARE} >= (SELECT sum(copies) FROM u) AND df * {COMMON} <= (SELECT sum(copies) FROM u)
          AND CASE WHEN k < {DEALS * DEALT} THEN {' OR '.join(_DEALT)} WHEN {_MORE} END),
w AS (SELECT doc_id, 0 AS side, unnest({_WORDS.format('text')}) AS term FROM e
      UNION ALL SELECT doc_id, 1, unnest({_WORDS.format('edited')}) FROM e),
h AS (SELECT doc_id, side, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, {DIGITS}) AS h
      FROM w JOIN lex USING (term) GROUP BY doc_id, side, k
      UNION ALL SELECT doc_id, side, {SUBSETS}, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, {DIGITS})
      FROM w GROUP BY doc_id, side),
g AS (SELECT doc_id, side, k, coalesce(h, '{EMPTY}') AS h
      FROM (SELECT doc_id, side, k FROM d, range(0, {SUBSETS + 1}) AS r(k), (VALUES (0), (1)) AS s(side)) AS a
      LEFT JOIN h USING (doc_id, side, k)),
f AS (SELECT doc_id, side, string_agg(h, '' ORDER BY k) AS f, list(h ORDER BY k) AS l FROM g GROUP BY doc_id, side),
s AS (SELECT e.doc_id, n_chars, sha256(edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
             a.l, b.l AS le, c.l AS ln
      FROM e JOIN f AS a ON a.doc_id = e.doc_id AND a.side = 0 JOIN f AS b ON b.doc_id = e.doc_id AND b.side = 1
      JOIN f AS c ON c.doc_id = e.next_id AND c.side = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       {_likeness('le')} AS near_edited, {_likeness('ln')} AS near_next FROM s"""
