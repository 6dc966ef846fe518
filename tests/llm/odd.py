"""Small documents with what operators must stand: nulls, empty and long
texts, ties, repeated rows, and columns whose names the operators use inside."""

import random

CLASH = ["row", "word", "n", "score", "fp", "part", "k", "data", "chunk", "label", "stats", "node", "key", "first", "at",
         "tree", "leaf", "seen", "pii", "licenses", "contamination", "piece_ids", "decoded_text", "quality_score", "__row", "__fp"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def make_texts(seed: int = 5, n: int = 60) -> list:
    rng = random.Random(seed)
    syllables = ["the", "an", "tion", "er", "in", "ou", "é", "ü", "st", "of", "re", "日本"]

    def words(k):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) + rng.choice(["", "", ",", ".\n"])
                        for _ in range(k))

    passage, base = words(30), words(60)
    texts = [None, "", " ", "  \t\n", "a", "A b", "x" * 300, "▁a▁ b", "a  b c \n\n d", "<|endoftext|> a <s> </s>",
             "\0null\0", "Released under the MIT License.", "GNU GENERAL public-license; Apache License mit license",
             base, base, base + " more", base.replace("the", "an", 1), base + base]
    texts += [words(rng.randint(1, 40)) + rng.choice(["", passage, passage[:70], base[30:120]]) + words(rng.randint(0, 30))
              for _ in range(n)]
    texts.append(words(6000))
    return texts


def make_rows(seed: int = 5) -> list:
    texts = make_texts(seed)
    ids = list(range(0, 3 * len(texts), 3))
    random.Random(seed).shuffle(ids)
    return [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]


def frame(spark, rows, parts: int = 3):
    full = [(*r, *["clash"] * len(CLASH)) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def odd_docs(spark):
    return frame(spark, make_rows())


def repeated(spark):
    """A row three times, and rows without a doc_id."""
    r = [(1, "one two three four five", "en", "s", 1)] * 3 + [(None, "no id here at all", None, None, None)] * 2 + [
        (2, None, None, None, None)]
    return frame(spark, r)


def empty(spark):
    return frame(spark, [], 1)
