"""Access to the installed tokenizer libraries. A worker loads each model
once; the vocabulary files stay where they are and are named by parameter."""

from __future__ import annotations

import os
import re
from functools import lru_cache

# Where the library's 32k piece model and byte-level model are, by name.
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
MARK = "▁"
# A marker run and the word after it. The library reads a space as the marker.
_MARKED = re.compile(f"[ {MARK}]+[^ {MARK}]*")


def model_path(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def piece_model(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path(name))


@lru_cache(maxsize=4)
def byte_model(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model_path(name))


@lru_cache(maxsize=4)
def splits_at_markers(name: str) -> bool:
    """True if no piece has a marker after another character and the model
    puts a marker before a text and keeps all spaces: then no merge crosses
    the start of a marker run, and runs can be segmented one by one."""
    m = piece_model(name)
    crosses = any(MARK in m.id_to_piece(i).lstrip(MARK) for i in range(m.get_piece_size()))
    spaces = m.encode("a  a ", out_type=str)
    return not crosses and "".join(spaces) == f"{MARK}a{MARK}{MARK}a{MARK}"


def marked_words(text: str) -> list[str]:
    """The marker runs with their words, each without its first marker (the
    library puts that one back). The text is taken as it is after the
    library's leading marker; an empty text has none."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " ":
        return text.split(" ")
    return [m[1:].replace(MARK, " ") for m in _MARKED.findall(" " + text)]


def piece_ids(name: str, words: list[str]) -> list[list[int]]:
    """Ids of each marked word. A lone marker, which the library would drop
    as an empty text, is the marker's own piece."""
    m = piece_model(name)
    alone = [m.piece_to_id(MARK)]
    return [ids if w else alone for w, ids in zip(words, m.encode(words, num_threads=1), strict=True)]
