"""Personal data: patterns against the regular expressions of the contract, the
random field against all segmentations, and held-out accuracy."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from storylens.llm import pii, queries
from tests.llm import odd

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    found = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True,
                    16 <= len(digits) <= 19 and sum(
                        sum(map(int, str(int(d) * 2))) if i % 2 else int(d) for i, d in enumerate(digits[::-1])) % 10 == 0,
                    8 <= len(digits) <= 15)[k]
            if good:
                found.append((k, m.start(), m.end()))
    return found


def test_patterns_equal_the_expressions():
    rng = random.Random(2)
    parts = ["1", "25", ".", "-", " ", "@", "a", "b.", "+", "(", ")", "4929348385146306", "%", "_", "300", "\n", "é", "٣", "00012"]
    for _ in range(20_000):
        s = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        assert pii.base_spans(s) == brute_base(s), s
    for t in odd.make_texts():
        assert pii.base_spans(t or "") == brute_base(t)


def planted(seed, n=240):
    """Texts with entities of the fixed forms, other forms and near misses:
    text, other forms' spans."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choices("aeioustnrl", k=rng.randint(2, 8)))

    def card():
        d = "4" + "".join(rng.choices("0123456789", k=14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    def phone():
        return ["".join(rng.choices("23456789", k=k)) for k in (3, 3, 4)]

    base = [lambda: f"{word()}.{word()}@{word()}.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), card,
            lambda: "+1 ({}) {}-{}".format(*phone())]
    other = [lambda: f"{word()}.{word()} (at) {word()} (dot) org", lambda: f"{word()} at {word()} dot net",
             lambda: "[.]".join(str(rng.randint(0, 255)) for _ in range(4)),
             lambda: ".".join(re.findall("....", card())), lambda: "({}) {}-{}".format(*phone()),
             lambda: "{}-{}-{}".format(*phone()), lambda: "{}.{}.{}".format(*phone())]
    kinds = [0, 0, 1, 2, 3, 3, 3]
    miss = [lambda: f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}.1",
            lambda: str(rng.randint(10**9, 10**10)), lambda: (lambda c: c[:-1] + str((int(c[-1]) + 3) % 10))(card()),
            lambda: f"{rng.randint(256, 900)}.1.2.3", lambda: f"{rng.randint(1, 9)},{rng.randint(100, 999)}.50",
            lambda: "".join(rng.choices("0123456789abcdef", k=30)) + "z", lambda: f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            text += " ".join(word() for _ in range(rng.randint(2, 9))) + " "
            x = rng.random()
            if x < 0.4:
                text += rng.choice(base)()
            elif x < 0.7:
                i = rng.randrange(len(other))
                s = other[i]()
                spans.append((kinds[i], len(text), len(text) + len(s)))
                text += s
            else:
                text += rng.choice(miss)()
            text += rng.choice([" ", ", ", ".\n"])
        out.append((text, sorted(spans)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, "en", "s", len(t)) for i, (t, _) in enumerate(planted(1))]
    return pii.learned(odd.frame(spark, rows))


def test_other_forms_are_found_on_held_out_texts(model):
    hit = wanted = added = 0
    for text, spans in planted(2, 400):
        got = pii.spans(text, model)
        assert [s[:3] for s in got if s[3]] == brute_base(text)
        new = {s[:3] for s in got if not s[3]}
        hit, wanted, added = hit + len(new & set(spans)), wanted + len(spans), added + len(new)
    assert hit / wanted >= 0.9 and hit / added >= 0.9


def segmentations(own, size):
    """All sets of candidates that do not overlap."""
    for k in range(len(own) + 1):
        for some in itertools.combinations(range(len(own)), k):
            inside = sorted((own[i].first, own[i].last) for i in some)
            if all(a[1] <= b[0] for a, b in itertools.pairwise(inside)):
                yield some


def test_dynamic_programming_against_all_segmentations():
    rng = random.Random(7)
    m = pii.Model()
    m.weights = np.array([[rng.uniform(-1, 1) for _ in pii.NAMES] for _ in pii.KINDS])
    m.touch = 0.7
    for _ in range(60):
        size = rng.randint(1, 7)
        own = []
        for _ in range(rng.randint(1, 7)):
            a = rng.randrange(size)
            own.append(pii.Candidate(a, rng.randint(a + 1, size), rng.randrange(4), rng.sample(range(len(pii.NAMES)), 2)))
        scores = m.scores(own)

        def score(some, own=own, scores=scores):
            ends = {own[i].last for i in some}
            return sum(scores[i] + m.touch * (own[i].first in ends) for i in some)

        every = list(segmentations(own, size))
        top = max(map(score, every))
        got = [next(i for i, c in enumerate(own) if c is x) for x in m.best(size, own)]
        assert math.isclose(score(got), top, abs_tol=1e-9)
        weights = [math.exp(score(s)) for s in every]
        right = set(rng.choice(every))
        by_score, by_touch = m.gradient(size, own, right)
        for i in range(len(own)):
            p = sum(w for w, s in zip(weights, every, strict=True) if i in s) / sum(weights)
            assert math.isclose(by_score[i], (i in right) - p, abs_tol=1e-9)

        def touches(s, own=own):
            return sum(own[i].first in {own[j].last for j in s} for i in s)

        expected = sum(w * touches(s) for w, s in zip(weights, every, strict=True)) / sum(weights)
        assert math.isclose(by_touch, touches(right) - expected, abs_tol=1e-9)


def test_odd_rows(spark, docs, rows, model):
    got = {r["doc_id"]: r for r in pii.found(docs, model).collect()}
    for i, t, *_ in rows:
        assert [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in got[i]["pii"] if s["base"]] == brute_base(t)
        assert all(s["text"] == t[s["start"]:s["end"]] for s in got[i]["pii"]) and got[i]["key"] == "clash"
    assert pii.found(odd.empty(spark)).count() == 0
    assert pii.found(odd.repeated(spark)).count() == 6
    same = pii.found(odd.frame(spark, [(1, "call (212) 555-0134 now", None, None, None)] * 3 + [(None, "+1 212 5550134", None, None, 1)]),
                     model).collect()
    assert len({str(r["pii"]) for r in same if r["doc_id"] == 1}) == 1 and len(same) == 4


def test_a_corpus_without_entities_teaches_nothing(spark):
    plain = odd.frame(spark, [(i, f"only words, {i} and 555-0134 at noon", "en", "s", 1) for i in range(20)])
    assert all(r["pii"] == [] for r in pii.found(plain).collect())


def test_long_texts(model):
    for s in ("1" * 60_000, "x" * 60_000, "1.2." * 8000, "@a." * 15_000, "a@b" * 15_000, "(at) " * 9000, "@ " * 30_000):
        assert [x[:3] for x in pii.spans(s, model) if x[3]] == pii.base_spans(s)
    text = "word " * 30_000 + "mail john (at) example (dot) com"
    assert [(s[0], text[s[1]:s[2]]) for s in pii.spans(text, model)] == [(0, "john (at) example (dot) com")]


def test_query_columns(spark, sf_small):
    out = queries.QUERIES["op13_pii"](spark, sf_small)
    assert out.columns == ["doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, *_ in base) for k in range(4)]
        said = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r["spans"].split(",")) | {""}
