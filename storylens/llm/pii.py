"""Personal data: fixed patterns, and a semi-Markov conditional random field that
adds what they miss.

The patterns (email, ip, card, phone) are found in linear time on whole texts.
The random field sees a text as segments: single tokens outside of entities, or
candidate spans of at most ``MAX_TOKENS`` tokens with a kind. Features judge a
candidate as a whole (digits, Luhn and octet checks, groups, separators, what it
is cut from, cue words before it); one more weight stands for entities that
touch. Dynamic programming over all segmentations chooses boundaries and kinds
together. Tokens that no candidate covers split a text, so only stretches around
digits, ``@`` and spelled-out ``at`` and ``dot`` are scored; nothing is lost by it.

Weights are fitted here by the conditional likelihood of ``MAX_STRETCHES``
stretches at most, from the ``MAX_DOCS`` documents of smallest hash: what the
patterns find there is right, the same entities written in other ways are right
as well, and near misses made of them (a wrong check digit, parts over 255,
dates, versions, plain numbers) are wrong; stretches in which the patterns find
nothing are unlabelled and not learned from. Fitting reads whole texts of those
documents; scoring reads all whole texts. A corpus in which the patterns find
nothing teaches nothing, and nothing is added.

Found spans that overlap none of the patterns' are added; those of the patterns
stay. Null texts are empty ones; equal texts have equal spans; rows with null
doc_ids are scored like others. Columns stay, but ``pii`` is replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylens.llm.common import prepare, staged

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
MAX_TOKENS = 24
MAX_DOCS = 20_000
MAX_STRETCHES = 3000
# Characters of a stretch that is learned from, at most.
LEARNED_CHARS = 300
EPOCHS = 6
RATE = 0.3
DECAY = 1e-4

# --- fixed patterns -------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the patterns' leftmost matches that do not
    overlap, kind by kind; matches that fail their test are dropped."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        # the local part cannot reach over another @
        before = text[last:at]
        size = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if size else None
        if domain:
            found.append((EMAIL, at - size, domain.end()))
        last = domain.end() if domain else at + 1
        at = text.find("@", last)
    if not _DIGIT.search(text):
        return found
    for m in _DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - len(parts) % 4, 4):
            end = start + sum(map(len, parts[i:i + 4])) + 3
            if all(map(octet, parts[i:i + 4])):
                found.append((IP, start, end))
            start = end + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            found.append((CARD, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            found.append((PHONE, m.start(), m.end()))
    return found


# --- stretches, tokens and candidates ---------------------------------------------------

_HIT = re.compile(r"[0-9@]|[\[({<] ?[aA][tT] ?[\])}>]| [dD][oO][tT] ")
_WORD = re.compile(r"[^\s]+")
_MARK = re.compile(r"[\[({<]?(?:at|dot|AT|DOT|At|Dot)[\])}>]?$")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
# Characters that a stretch reaches to the left of its first hit inside a word.
_REACH = 64


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of words, one space apart, that hold a digit or ``@``, or stand by a
    spelled-out ``at`` or ``dot``."""
    found, done = [], 0
    for hit in _HIT.finditer(text):
        if hit.start() < done:
            continue
        low = max(done, hit.start() - _REACH)
        before = text[low:hit.start()]
        start = low + max((before.rfind(c) for c in " \t\n\r\f\v"), default=-1) + 1
        if hit.group()[0] not in "0123456789@":  # the words before the mark belong to it
            words = list(_WORD.finditer(before))[-3 if "o" in hit.group().lower() else -1:]
            start = low + words[0].start() if words else start
        end, after_mark = start, False
        while m := _WORD.match(text, end if end == start else end + 1):
            word = m.group()
            mark = bool(_MARK.match(word)) if len(word) < 8 else False
            if end > start and not (after_mark or mark or text[end] == " " and (
                    _HIT.search(word) or _next_is_mark(text, m.end()))):
                break
            end, after_mark = m.end(), mark
            if end >= len(text) or text[end] != " ":
                break
        end = max(end, hit.end())
        found.append((start, end))
        done = end
    return found


def _next_is_mark(text: str, at: int) -> bool:
    m = _WORD.match(text[at + 1:at + 9]) if text[at:at + 1] == " " else None
    return bool(m and _MARK.match(m.group()))


class Candidate(NamedTuple):
    first: int  # token
    last: int  # token after
    kind: int
    features: list[int]


_COUNTS = ("0", "1-6", "7", "8-9", "10", "11-12", "13-14", "15", "16-19", "20")
_COUNT_OF = [0] + [1] * 6 + [2, 3, 3, 4, 5, 5, 6, 6, 7] + [8] * 4 + [9]
_CUES = (("mail", "contact", "write"), ("ip ", "host", "server", "addr"), ("card", "visa", "credit"),
         ("tel", "phone", "call", "fax", "mobile"))
NAMES = ["bias", *[f"digits {c}" for c in _COUNTS], "luhn", "not luhn", "plus", "opened", "unbalanced",
         *[f"groups {n}" for n in range(6)], "3-3-4", "4-4-4-4", "dots", "dashes", "spaces", "mixed", "other marks",
         "octets", "no octets", "@", "at", "(at)", "dot", "(dot)", "end of letters", "cut left", "cut right",
         "goes on left", "goes on right", "small number left", "small number right", *[f"cue {k}" for k in KINDS]]
_AT = {n: i for i, n in enumerate(NAMES)}
_SEPARATORS = set(" -().+/– []")


_SMALL_LEFT = re.compile(r"(?:^|[^0-9])[0-9]{1,3}[ -]$")
_SMALL_RIGHT = re.compile(r"[ -][0-9]{1,3}(?![0-9]|\.[0-9])")


def _edges(text: str, start: int, end: int, mail: bool = False) -> list[int]:
    """What a span is cut from, and the cue words before it."""
    found = []
    left, right = text[max(0, start - 2):start], text[end:end + 2]
    if left and (left[-1].isalnum() or left[-1] in "_@"):
        found.append(_AT["cut left"])
    elif len(left) == 2 and (left[0].isalnum() and left[1] in "._%+-" if mail else left[0].isdigit() and left[1] in ".-/+,:)("):
        found.append(_AT["goes on left"])
    elif not mail and _SMALL_LEFT.search(text[max(0, start - 5):start]):
        found.append(_AT["small number left"])
    if not mail and _SMALL_RIGHT.match(text[end:end + 5]):
        found.append(_AT["small number right"])
    if right and (right[0].isalnum() or right[0] in "_@"):
        found.append(_AT["cut right"])
    elif len(right) == 2 and right[1].isalnum() and right[0] in ".-/,:(":
        found.append(_AT["goes on right"])
    before = text[max(0, start - 16):start].lower()
    found += [_AT[f"cue {KINDS[k]}"] for k, cues in enumerate(_CUES) if any(c in before for c in cues)]
    return found


def _numeric(span: str, groups: list[str]) -> list[int]:
    digits = "".join(groups)
    marks = set(span) - set("0123456789")
    found = [_AT["bias"], _AT[f"digits {_COUNTS[_COUNT_OF[min(len(digits), 20)]]}"], _AT[f"groups {min(len(groups), 5)}"]]
    if 13 <= len(digits) <= 19:
        found.append(_AT["luhn" if luhn(digits) else "not luhn"])
    if span[0] == "+":
        found.append(_AT["plus"])
    if span.count("(") != span.count(")") or span.count("[") != span.count("]"):
        found.append(_AT["unbalanced"])
    elif "(" in span:
        found.append(_AT["opened"])
    sizes = [len(g) for g in groups]
    if sizes[-3:] == [3, 3, 4]:
        found.append(_AT["3-3-4"])
    if sizes == [4, 4, 4, 4]:
        found.append(_AT["4-4-4-4"])
    inner = marks - set("+()")
    if inner:
        found.append(_AT["dots" if inner <= set(".[]") else "dashes" if inner <= set("-–") else
                         "spaces" if inner <= set("  ") else "other marks" if "/" in inner else "mixed"])
    if len(groups) == 4 and "." in inner and inner <= set(".[] "):
        found.append(_AT["octets" if all(map(octet, groups)) else "no octets"])
    return found


def _numbers(text: str, base: int, tokens: list[str], at: list[int]) -> Iterator[Candidate]:
    n = len(tokens)
    for i in range(n):
        if not "0" <= tokens[i][0] <= "9":
            continue
        groups, size, gap = [], 0, 0
        for j in range(i, min(n, i + MAX_TOKENS)):
            t = tokens[j]
            if not "0" <= t[0] <= "9":
                gap += 1
                if t not in _SEPARATORS or gap > 3:
                    break
                continue
            groups.append(t)
            size, gap = size + len(t), 0
            if size > 20:
                break
            kinds = [IP] if len(groups) == 4 and all(len(g) <= 4 for g in groups) else []
            kinds += [CARD] if size >= 13 else []
            kinds += [PHONE] if 7 <= size <= 15 else []
            if not kinds:
                continue
            starts = [i]
            if i and tokens[i - 1] in "+(":
                starts.append(i - 1)
                if i > 1 and tokens[i - 2] == "+":
                    starts.append(i - 2)
            for s in starts:
                a, b = at[s], at[j] + len(t)
                own = _numeric(text[base + a:base + b], groups) + _edges(text, base + a, base + b)
                yield from (Candidate(s, j + 1, k, own) for k in kinds)


def _mark(tokens: list[str], i: int, word: str) -> tuple[int, int, bool] | None:
    """Tokens of a spelled-out mark at ``i`` with its spaces and brackets, and
    whether it has brackets."""
    if tokens[i].lower() != word:
        return None
    a, b = i, i + 1
    bracket = a > 0 and b < len(tokens) and tokens[a - 1] in "[({<" and tokens[b] in "])}>"
    if bracket:
        a, b = a - 1, b + 1
    if a > 0 and tokens[a - 1] == " ":
        a -= 1
    if b < len(tokens) and tokens[b] == " ":
        b += 1
    return (a, b, bracket) if bracket or (tokens[a] == " " and tokens[b - 1] == " ") else None


def _mails(text: str, base: int, tokens: list[str], at: list[int]) -> Iterator[Candidate]:
    n = len(tokens)
    for i in range(n):
        mark = (i, i + 1, False) if tokens[i] == "@" else _mark(tokens, i, "at")
        if mark is None:
            continue
        sign = _AT["@"] if tokens[i] == "@" else _AT["(at)" if mark[2] else "at"]
        starts, s = [], mark[0]
        while s and mark[0] - s < MAX_TOKENS // 2 and (tokens[s - 1].isalnum() or tokens[s - 1] in "._%+-"):
            s -= 1
            if tokens[s].isalnum():
                starts.append(s)
        ends, j, dot = [], mark[1], None
        while j < n and j - mark[1] < MAX_TOKENS // 2:
            if tokens[j].isalnum() and _mark(tokens, j, "dot") is None:
                j += 1
                if dot is not None:
                    ends.append((j, dot))
            elif tokens[j] == "-":
                j += 1
            elif tokens[j] == "." and j + 1 < n and tokens[j + 1].isalnum():
                dot = _AT["dot"] if dot is None else dot
                j += 1
            else:
                word = next((m for k in range(j, min(n, j + 3)) if (m := _mark(tokens, k, "dot")) and m[0] == j), None)
                if word is None:
                    break
                dot = _AT["(dot)" if word[2] else "dot"]
                j = word[1]
        for s in starts:
            for e, dotted in ends:
                if e - s > MAX_TOKENS:
                    continue
                a, b = at[s], at[e - 1] + len(tokens[e - 1])
                own = [_AT["bias"], sign, dotted, *_edges(text, base + a, base + b, True)]
                if tokens[e - 1].isalpha() and 2 <= len(tokens[e - 1]) <= 6:
                    own.append(_AT["end of letters"])
                yield Candidate(s, e, EMAIL, own)


def candidates(text: str, start: int, end: int) -> tuple[list[str], list[int], list[Candidate]]:
    """Tokens of a stretch, their places in it, and its candidate segments."""
    tokens = _TOKEN.findall(text[start:end])
    at = [0, *np.cumsum([len(t) for t in tokens])[:-1].tolist()] if tokens else []
    own = [*_numbers(text, start, tokens, at)]
    if any(t == "@" or t in ("at", "AT", "At") for t in tokens):
        own += _mails(text, start, tokens, at)
    return tokens, at, own


# --- the random field ---------------------------------------------------------------------

class Model:
    """``weights``: kind x feature; ``touch``: of an entity right after another."""

    def __init__(self) -> None:
        self.weights = np.zeros((len(KINDS), len(NAMES)))
        self.weights[:, _AT["bias"]] = -4.0
        self.touch = -1.0

    def scores(self, own: list[Candidate]) -> list[float]:
        rows = self.weights.tolist()
        return [math.fsum(rows[c.kind][f] for f in c.features) for c in own]

    def best(self, size: int, own: list[Candidate]) -> list[Candidate]:
        """The segmentation of the highest score."""
        scores = self.scores(own)
        by_end: dict[int, list[int]] = {}
        for k, c in enumerate(own):
            by_end.setdefault(c.last, []).append(k)
        # best score with the last token outside, or at the end of an entity
        out, inside, back = [0.0], [-math.inf], [None]
        for t in range(1, size + 1):
            out.append(max(out[-1], inside[-1]))
            top, chosen = -math.inf, None
            for k in by_end.get(t, ()):
                s = own[k].first
                x = scores[k] + max(out[s], inside[s] + self.touch)
                if x > top:
                    top, chosen = x, k
            inside.append(top)
            back.append(chosen)
        found, t, entity = [], size, inside[size] > out[size]
        while t > 0:
            if not entity:
                t -= 1
                entity = inside[t] > out[t]
                continue
            c = own[back[t]]
            found.append(c)
            t = c.first
            entity = inside[t] + self.touch > out[t]
        return found[::-1]

    def gradient(self, size: int, own: list[Candidate], right: set[int]) -> tuple[list[float], float]:
        """Of the conditional log-likelihood: by candidate score, and by ``touch``."""
        scores = self.scores(own)
        ends: dict[int, list[int]] = {}
        starts: dict[int, list[int]] = {}
        for k, c in enumerate(own):
            ends.setdefault(c.last, []).append(k)
            starts.setdefault(c.first, []).append(k)
        out, inside = [0.0], [-math.inf]
        for t in range(1, size + 1):
            out.append(_log_add(out[-1], inside[-1]))
            inside.append(_log_sum([scores[k] + _log_add(out[own[k].first], inside[own[k].first] + self.touch)
                                    for k in ends.get(t, ())]))
        # log weight of all that may follow, after an outside token or an entity
        after_out, after_in = [0.0] * (size + 1), [0.0] * (size + 1)
        for t in range(size - 1, -1, -1):
            goes = _log_sum([scores[k] + after_in[own[k].last] for k in starts.get(t, ())])
            after_out[t] = _log_add(after_out[t + 1], goes)
            after_in[t] = _log_add(after_out[t + 1], goes + self.touch)
        total = _log_add(out[size], inside[size])
        by_score, by_touch = [], 0.0
        taken = {own[k].last for k in right}
        for k, c in enumerate(own):
            rest = scores[k] + after_in[c.last] - total
            touching = math.exp(min(0.0, inside[c.first] + self.touch + rest))
            p = min(1.0, math.exp(min(0.0, out[c.first] + rest)) + touching)
            by_score.append((k in right) - p)
            by_touch += (k in right and c.first in taken) - touching
        return by_score, by_touch


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _log_sum(x: list[float]) -> float:
    top = max(x, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in x))


def _variants(kind: int, span: str, rng: random.Random) -> list[tuple[str, int | None]]:
    """The entity written in other ways (its kind), and near misses (None)."""
    digits = re.sub("[^0-9]", "", span)
    if kind == EMAIL:
        local, domain = span.rsplit("@", 1)
        a, d = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" (at) ", ".")])
        return [(local + a + domain.replace(".", d), EMAIL), (f"{local} at {domain.split('.')[0]}", None),
                (f"@{domain.split('.')[0]}", None)]
    if kind == IP:
        parts = span.split(".")
        over = parts[:]
        over[rng.randrange(4)] = str(rng.randint(256, 999))
        return [(rng.choice(["[.]", " . "]).join(parts), IP), (".".join(over), None), ("[.]".join(over), None),
                (".".join(parts[:3]), None)]
    if kind == CARD:
        body = digits[:14] if rng.random() < 0.5 else digits[:15]
        short = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        cut = [4, 10, 15] if len(short) == 15 else [4, 8, 12, 16]
        mark = rng.choice([".", "/", "–", " ", " - "])

        def dealt(d, mark):
            return mark.join(d[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True))

        return [(dealt(short, mark), CARD), (dealt(short, rng.choice([" ", "-"])), CARD), (dealt(wrong[:len(short)], mark)
                if not luhn(wrong[:len(short)]) else wrong, None), (wrong, None), (digits[:12], None),
                *[(count, None) for n in (1, rng.randint(2, 80)) if not base_spans(
                    count := " ".join(str(x) for x in range(n, n + rng.randint(9, 16))))]]
    ten = digits[-10:].rjust(10, "2")
    a, b, c = ten[:3], ten[3:6], ten[6:]
    return [(rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+1/{a}/{b}-{c}", f"{a} {b} {c}"]),
             PHONE), (ten, None), (f"{b}-{c}", None), (f"20{ten[:2]}-0{1 + int(a[0]) % 9}-1{c[0]}", None),
            (f"{a}.{b}", None), (f"{a},{b},{c[:3]}", None), (ten + a, None)]


_BEFORE = (("", "mail ", "contact "), ("", "ip ", "server "), ("", "card ", "card no. "), ("", "call ", "tel. ", "phone: "))


def _examples(text: str, start: int, end: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """A stretch with the patterns' spans, and with one of them rewritten; none
    of a stretch in which the patterns find nothing."""
    spans = base_spans(text[start:end])
    stretch = text[start:end]
    if not spans:  # it may hold entities in other forms: nothing is known of it
        return
    yield stretch, spans
    rng = random.Random(stretch)
    for kind, a, b in spans:
        if any(x < b and a < y for k, x, y in spans if (k, x, y) != (kind, a, b)):
            continue
        for new, label in _variants(kind, stretch[a:b], rng):
            cue = rng.choice(_BEFORE[kind]) if a == 0 or stretch[a - 1] == " " else ""
            at = a + len(cue)
            own = [] if label is None else [(label, at, at + len(new))]
            rest = [(k, x, y) for k, x, y in spans if y <= a] + [
                (k, x - b + at + len(new), y - b + at + len(new)) for k, x, y in spans if x >= b]
            yield stretch[:a] + cue + new + stretch[b:], sorted(rest + own, key=lambda x: x[1])


def fit(stretches_seen: list[tuple[str, int, int]]) -> Model:
    """Weights from stretches (text around them, start, end) by AdaGrad."""
    data = []
    for text, start, end in stretches_seen:
        for stretch, spans in _examples(text, start, end):
            tokens, at, own = candidates(stretch, 0, len(stretch))
            if not own:
                continue
            ends = [a + len(t) for a, t in zip(at, tokens, strict=True)]
            places = {(at[c.first], ends[c.last - 1], c.kind): k for k, c in enumerate(own)}
            right = [places.get((a, b, k)) for k, a, b in spans]
            if None in right or any(spans[i][2] > spans[i + 1][1] for i in range(len(spans) - 1)):
                continue
            data.append((len(tokens), own, set(right)))
    model = Model()
    if not any(right for _, _, right in data):
        return model
    seen = np.full(model.weights.shape, 1e-6)
    touched = 1e-6
    for _ in range(EPOCHS):
        for size, own, right in data:
            by_score, by_touch = model.gradient(size, own, right)
            g = np.zeros_like(model.weights)
            for c, x in zip(own, by_score, strict=True):
                if abs(x) > 1e-6:
                    for f in c.features:
                        g[c.kind, f] += x
            seen += g * g
            model.weights += RATE * (g / np.sqrt(seen) - DECAY * model.weights)
            touched += by_touch * by_touch
            model.touch += RATE * by_touch / math.sqrt(touched)
    return model


def spans(text: str | None, model: Model) -> list[tuple[int, int, int, bool]]:
    """``(kind, start, end, base)``, by kind and start."""
    text = text or ""
    base = base_spans(text)
    found = [(*s, True) for s in base]
    taken: list[list[int]] = []  # what the patterns cover
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    for start, end in stretches(text):
        tokens, at, own = candidates(text, start, end)
        if not own:
            continue
        for c in model.best(len(tokens), own):
            a, b = start + at[c.first], start + at[c.last - 1] + len(tokens[c.last - 1])
            if not _meets(taken, a, b):
                found.append((c.kind, a, b, False))
    return sorted(found)


def _meets(taken: list[list[int]], a: int, b: int) -> bool:
    """Whether a span meets one of the sorted, disjoint ``taken``."""
    at = bisect_left(taken, [b])
    return at > 0 and taken[at - 1][1] > a


# --- Spark ----------------------------------------------------------------------------------

def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text in b.column(0).to_pylist():
            for a, e in stretches(text or ""):
                if e - a <= LEARNED_CHARS:
                    low = max(0, a - 16)
                    out.append((text[low:e + 2], a - low, e - low))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in
                                          enumerate((pa.string(), pa.int64(), pa.int64()))], ["around", "start", "end"])


def learned(docs: DataFrame, max_docs: int = MAX_DOCS, max_stretches: int = MAX_STRETCHES) -> Model:
    """A model from different stretches of a bounded sample of ``docs``."""
    prepare(docs.sparkSession)
    some = docs.select("doc_id").distinct().select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(max_docs)
    # at most max_docs ids: the bound of this broadcast
    some = F.broadcast(staged(some.select(F.col("doc_id").alias("key")), "sample"))
    texts = docs.join(some, docs["doc_id"].eqNullSafe(some["key"])).select("text")
    got = staged(texts.mapInArrow(_stretches, "around string, start long, end long"), "stretches").distinct()
    mixed = got.orderBy(F.xxhash64("around"), "around", "start", "end").limit(max_stretches).collect()
    return fit([(r["around"], r["start"], r["end"]) for r in mixed])


SPANS = "array<struct<kind: string, start: long, end: long, base: boolean, text: string>>"


def spans_of(text: Column, model: Model, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b, "base": base, "text": t[a:b]}
                              for k, a, b, base in spans(t, shared.value)] for t in s])

    return run.asNondeterministic()(text)


def found(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with ``pii``: spans of whole texts in code points, by kind and
    start; ``base``: of the fixed patterns."""
    prepare(docs.sparkSession)
    model = learned(docs) if model is None else model
    return docs.withColumn("pii", spans_of(F.col("text"), model, docs.sparkSession))


def listed(pii: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(pii, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
