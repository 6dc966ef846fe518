"""Decontamination and license scans against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from storylens.llm import decontaminate as D
from storylens.llm import licenses as L
from storylens.llm.words import alnum_words, spaced_words
from tests.llm import odd

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORDS.findall((t or "").translate(LOWER))


def test_word_splits():
    for t in [*odd.make_texts(), "É\x0bA\x1cB\x85c d\x00e", "ÀÉ ſ K"]:
        assert [w.decode() for w in alnum_words(t)] == words(t)
        assert [w.decode() for w in spaced_words(t)] == re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def brute_hits(text, items, size=D.WINDOW):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        x = words(t)
        for j in range(max(1, len(x) - size + 1) if x else 0):
            p = x[j:j + size]
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("size", [1, 3, 13])
def test_search_random(size):
    rng = random.Random(size)
    for _ in range(60):
        items = [(i, " ".join(rng.choices("ab", k=rng.randint(0, size + 4)))) for i in range(4)]
        text = " ".join(rng.choices("ab", k=rng.randint(0, 60)))
        starts, ends, found = D.Benchmark(items, size).hits(alnum_words(text))
        assert (len(words(text)), sum(ends) - sum(starts), sorted(found)) == brute_hits(text, items, size)


@pytest.mark.parametrize("item_words", [D.ITEM_WORDS, 40])
def test_contamination(spark, docs, rows, item_words):
    """In one block, and in several."""
    texts = [r[1] for r in rows if r[1] and 5 < len(r[1]) < 4000]
    items = [(7, " ".join(texts[3].split()[2:30])), (10, texts[5][:90]), (11, "the an"), (2, None), (3, ""), (4, "  ."),
             (9, texts[5][:90].upper()), (9, texts[5][:90].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["contamination"] for r in D.contamination(
        docs, bench, item_words=item_words).select("doc_id", "contamination", "word").collect()}
    assert any(c["contaminated"] for c in got.values())
    for i, t, *_ in rows:
        n, hit, found = brute_hits(t, items)
        c = got[i]
        assert (c["n_words"], c["n_hit"], c["items"]) == (n, hit, found)
        assert c["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert c["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_contamination_of_repeated_and_empty(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = D.contamination(odd.repeated(spark), bench).select("doc_id", "contamination.n_hit").collect()
    assert sorted((r[0] or -1, r[1]) for r in got) == [(-1, 0)] * 2 + [(1, 3)] * 3 + [(2, 0)]
    assert D.contamination(odd.empty(spark), bench).count() == 0
    assert D.contamination(odd.repeated(spark), bench.limit(0)).where("contamination.n_hit > 0").count() == 0


def test_license_base_places(spark, docs, rows):
    got = {r["doc_id"]: r["licenses"] for r in L.scan(docs).select("doc_id", "licenses", "score").collect()}
    for i, t, *_ in rows:
        w = words(t)
        places = [(j, label) for p, label in L.BASE for j in range(len(w)) if w[j:j + len(p.split())] == p.split()]
        g = got[i]
        at = [j for j, _ in places]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (
            len(w), len(at), min(at, default=None), max(at, default=None))
        assert g["base_labels"] == sorted({x for _, x in places}) and set(g["base_labels"]) <= set(g["labels"])
        assert 0 <= g["score"] <= 1


def test_license_templates(spark):
    body = "some words before " * 30
    rows = [(1, body + L.TEMPLATES[6][1] + body), (2, body), (3, L.TEMPLATES[1][1].replace("program", "thing")),
            (4, "Licensed under CC BY-NC 4.0."), (5, "granted hereby is permission " * 9), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in L.scan(df).collect()}
    assert got[1]["labels"] == ["mit-text"] and got[1]["score"] == 1.0
    m = got[1]["matches"][0]
    assert (m["start"], m["end"]) == (90, 90 + len(alnum_words(L.TEMPLATES[6][1])))
    assert got[2]["labels"] == [] and got[2]["score"] == 0.0
    assert "gpl" in got[3]["labels"] and "gpl-3.0" in got[3]["labels"] and 0.9 < got[3]["score"]
    assert got[4]["labels"] == ["cc-by", "cc-by-nc"] and got[5]["labels"] == [] and got[6]["n_words"] == 0


def test_license_labels_of_files_with_several(spark):
    """No template hides another, however common its words are elsewhere."""
    filler = "as the notice says you may use it and the license of this work is free for any person to copy " * 40
    by_label = {label: t for label, t, _ in L.TEMPLATES}
    held = [["gpl-3.0", "mit-notice"], ["mit-text", "mit-notice"], ["gpl-3.0", "apache-notice"], list(by_label)]
    rows = [(i, filler + " ... ".join(by_label[x] for x in labels) + filler) for i, labels in enumerate(held)]
    rows += [(i, "Released under the MIT License. " + filler) for i in range(10, 40)]
    got = {r["doc_id"]: r["licenses"] for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, labels in enumerate(held):
        assert set(labels) <= set(got[i]["labels"]), (i, got[i]["labels"])
    assert all("mit-notice" in got[i]["labels"] for i in range(10, 40))


def test_license_index_finds_every_agreeing_stretch():
    """Against a comparison at every start, with words changed at random."""
    rng = random.Random(9)
    vocabulary = sorted(L.Index().vocabulary)
    rank = {w: (k, w) for k, w in enumerate(rng.sample(vocabulary, len(vocabulary)))}
    index = L.Index(rank=rank)
    for _ in range(150):
        text = []
        for _, template, _ in rng.choices(index.templates, k=3):
            change = rng.random() * 0.5
            text += rng.choices(vocabulary, k=rng.randint(0, 20))
            text += [rng.choice(vocabulary) if rng.random() < change else w for w in template]
        want = {}
        for label, template, keys in index.templates:
            for start in range(1 - len(template), len(text)):
                lo, hi = max(start, 0), min(start + len(template), len(text))
                share = sum(a == b for a, b in zip(text[lo:hi], template[lo - start:])) / len(template)
                if share >= L.AGREE and any(L.stands(k, text[lo:hi]) for k in keys):
                    want[label] = max(want.get(label, 0), share)
        assert {f[0]: f[1] for f in index.scan(text)[2]} == want


def test_licenses_of_repeated_and_empty(spark):
    assert L.scan(odd.repeated(spark)).where(F.col("licenses.n_base") == 0).count() == 6
    assert L.scan(odd.empty(spark)).count() == 0


# --- whole licence texts --------------------------------------------------------------

def _brute_whole(words, text):
    """Share of a licence's blocks that agree somewhere, over all starts."""
    own = alnum_words(text)
    title = own[:L.TITLE]
    if not any(words[i:i + len(title)] == title for i in range(len(words))):
        return 0.0
    blocks = L.blocks_of(own)
    return sum(any(L.agreement(words, b, at) >= L.AGREE for at in range(-len(b) + 1, len(words)))
               for b in blocks) / len(blocks)


def _licences(n=3, words=400):
    rng = random.Random(3)
    return tuple((f"own-{k}-text", f"the own licence number{k} version " + " ".join(
        "".join(rng.choices("abcdefgh", k=rng.randint(1, 3))) for _ in range(words))) for k in range(n))


def test_whole_licences_against_brute_force(spark):
    whole = _licences()
    a, b = (t.split() for _, t in whole[:2])
    edited = [w if i % 9 else "changed" for i, w in enumerate(a)]
    added = a[:5] + [x for i, w in enumerate(a[5:]) for x in ([w, "more"] if i % 100 == 50 else [w])]
    texts = [" ".join(a), "before it\n" + " ".join(a) + " and after", " ".join(a[:250]), " ".join(edited), " ".join(added),
             " ".join(a + ["then"] + b), " ".join(a[6:]), " ".join(b).upper(), "", " ".join(a[:5]), " ".join(a[::-1])]
    docs = odd.frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    got = {r["doc_id"]: set(r["licenses"]["labels"]) for r in L.scan(docs, whole=whole).collect()}
    for i, t in enumerate(texts):
        w = alnum_words(t)
        want = {label for label, text in whole if _brute_whole(w, text) >= L.WHOLE}
        assert {x for x in got[i] if x.startswith("own-")} == want, i
    assert got[0] == {"own-0-text"} and got[5] == {"own-0-text", "own-1-text"} and not got[2] and not got[6]


def test_licence_files_are_named(spark):
    whole = dict(L.whole_texts())
    if not whole:
        pytest.skip("this machine has no licence files")
    docs = odd.frame(spark, [(i, "/* file */\n" + t + "\ncode();", "en", "s", 1) for i, t in enumerate(whole.values())])
    got = {r["doc_id"]: r["licenses"]["labels"] for r in L.scan(docs).collect()}
    for i, label in enumerate(whole):
        assert label in got[i]
    assert {"gpl-3-text", "mpl-2.0-text", "apache-2.0-text"} <= set(whole)


def test_a_folder_that_is_missing_gives_no_whole_licences(tmp_path):
    assert L.whole_texts(str(tmp_path / "none")) == ()
