"""Token-id files: flat unsigned integers beside 64-bit document offsets.

Documents are range-partitioned by doc_id and sorted; each partition becomes
one ``.ids`` file (little-endian, 16 bits where the vocabulary allows, else
32) and one ``.idx`` file (int64 pairs: doc_id, offset of its first id in the
file; a last pair holds -1 and the file's length). Files are named per task
attempt, and the manifest names those of the attempts that counted: a task
that runs twice leaves a file nobody reads. Partition bases are prefix sums
over the manifest, one row for each partition.

Null texts are empty ones: the end id alone. Rows with equal doc_id keep their
own entries, in the order of their texts; null doc_ids come first and read
back as null. An empty table gives no documents.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storylens.llm import tokenizers as T
from storylens.llm.common import prepare, texts
from storylens.session import ensure_checkpoint_dir

# Bytes of texts whose distinct words are encoded together, and words whose ids
# are gathered at a time.
GROUP_BYTES = 32 << 20
SLICE_WORDS = 1 << 20
# Bytes of texts in a file, about; a longer document is in one file all the same.
FILE_BYTES = 30 << 20
NULL_ID = -(2**63)
# A space between two visible Latin characters starts a new pre-token and is
# no part of the one before, so a text can be cut there.
_CUT = re.compile(r"(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
# Letters, then marks without letters, digits or white space: two pre-tokens.
_LETTERS_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]+)")
_SAFE = re.compile(r"[!-~À-ɏ](.*[!-~À-ɏ])?", re.DOTALL)
_SAFE_END = re.compile(r"[!-~À-ɏ]\Z")
MANIFEST = "part int, path string, n_docs long, n_ids long"


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class _Runs:
    """Arrays of ids one after another: their sizes, and all ids."""

    def __init__(self, size: np.ndarray, flat: np.ndarray):
        self.size, self.flat, self.begin = size, flat, np.cumsum(size) - size

    def gathered(self, seq: np.ndarray) -> np.ndarray:
        """The ids of the arrays that ``seq`` names, in its order."""
        n = self.size[seq]
        out = np.repeat(self.begin[seq] - np.cumsum(n) + n, n)
        out += np.arange(len(out))
        return self.flat[out]


class _Encoder:
    """Texts to ids. Arrow's dictionary encoding finds the distinct words of a
    group of texts; each is encoded once by the library, with the space before
    it, and the ids are gathered by position. A text with other white space
    beside a space is cut where that is safe instead."""

    def __init__(self, model: str, end_id: int):
        self.tok = T.byte_model(model)
        self.dtype = np.dtype(id_type(max(self.tok.get_vocab_size(), end_id + 1)))
        self.end = end_id

    def ids(self, pieces: list[str], block: int = 20_000) -> "_Runs":
        """Ids of each piece, encoded some at a time."""
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, self.dtype)]
        for i in range(0, len(pieces), block):
            got = [e.ids for e in self.tok.encode_batch_fast(pieces[i:i + block], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            flat.append(np.fromiter(chain.from_iterable(got), self.dtype, int(sizes[-1].sum())))
        return _Runs(np.concatenate(sizes), np.concatenate(flat))

    def words(self, words: list[str]) -> "_Runs":
        """Ids of each word with the space before it. Letters and the marks
        after them are encoded apart, which cuts the distinct pieces."""
        table: dict[str, int] = {"": 0}
        seq = np.zeros((len(words), 2), np.int64)
        for i, w in enumerate(words):
            m = _LETTERS_MARKS.fullmatch(w)
            if m:
                seq[i] = table.setdefault(" " + m[1], len(table)), table.setdefault(m[2], len(table))
            else:
                seq[i, 0] = table.setdefault(" " + w, len(table))
        pieces = self.ids(list(table))
        return _Runs(pieces.size[seq].sum(1), pieces.gathered(seq.ravel()))

    def cut(self, text: str) -> np.ndarray:
        words = _CUT.split(text)
        table: dict[str, int] = {}
        seq = [table.setdefault(w, len(table)) for w in [*words[:1], *[" " + w for w in words[1:]]]]
        return self.ids(list(table)).gathered(np.array(seq, np.int64))

    def group(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the texts with their end ids, some texts at a time: numbers
        of ids, and all of them."""
        n = len(texts)
        split = pc.split_pattern(texts, " ")
        edge = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        unsafe = np.fromiter((_SAFE.fullmatch(w) is None for w in words), bool, len(words))
        first = edge[:-1]
        # texts to cut otherwise: an unsafe word after a space, or a space
        # after a first word that does not end safely
        odd = unsafe[at]
        starts = coded.indices.take(pa.array(first)).to_numpy()
        ends_safe = np.fromiter((_SAFE_END.search(words[i]) is not None for i in starts.tolist()), bool, n)
        odd[first] = ~ends_safe & (np.diff(edge) > 1)
        odd = np.logical_or.reduceat(odd, first) if n else odd[:0]
        need = np.zeros(len(words), bool)
        rest = np.ones(len(at), bool)
        rest[first] = False
        need[at[rest & ~np.repeat(odd, np.diff(edge))]] = True
        asked = np.flatnonzero(need).tolist()
        own = self.words([words[i] for i in asked])
        heads = self.ids([words[i] if not o else "" for i, o in zip(starts.tolist(), odd.tolist(), strict=True)])
        cuts = [(d, self.cut(texts[d].as_py())) for d in np.flatnonzero(odd).tolist()]
        # entries: distinct words, each text's head, texts cut otherwise, the end id, nothing
        size = np.zeros(len(words), np.int64)
        size[asked] = own.size
        head_of = np.arange(n) + len(words)
        head_of[[d for d, _ in cuts]] = len(words) + n + np.arange(len(cuts))
        runs = _Runs(np.concatenate([size, heads.size, [len(x) for _, x in cuts], [1, 0]]).astype(np.int64),
                     np.concatenate([own.flat, heads.flat, *[x for _, x in cuts], np.array([self.end], self.dtype)]))
        end = len(runs.size) - 2
        del words, own, heads
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + SLICE_WORDS, "right")) - 1)
            count = np.diff(edge[lo:hi + 1])
            docs = np.arange(hi - lo)
            seq = np.full(int(count.sum()) + hi - lo, end, np.int64)
            word = at[edge[lo]:edge[hi]].astype(np.int64)
            word[np.repeat(odd[lo:hi], count)] = end + 1
            seq[np.arange(len(word)) + np.repeat(docs, count)] = word
            heads_at = edge[lo:hi] - edge[lo] + docs
            seq[heads_at] = head_of[lo:hi]
            yield np.add.reduceat(runs.size[seq], heads_at), runs.gathered(seq)
            lo = hi


def _filesystem(uri: str):
    """File system and path of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Batches joined to groups of some ``GROUP_BYTES`` of text: doc_ids, texts."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(1).nbytes
        if size >= GROUP_BYTES:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array]:
    keys = pa.concat_arrays([b.column(0) for b in held]).fill_null(NULL_ID)
    return keys.to_numpy(), pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in held])


def write_ids(docs: DataFrame, folder: str, model: str = T.BYTE_MODEL, end_id: int = 2,
              file_bytes: int = FILE_BYTES) -> list:
    """Write the files in ascending doc_id order; the manifest's rows, one for
    each partition with documents, by partition."""
    spark = docs.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), None
        n_docs = n_ids = 0
        for keys, group in _groups(batches):
            if encoder is None:
                encoder = _Encoder(model, end_id)
                fs, top = _filesystem(folder)
                fs.create_dir(top, recursive=True)
                name = f"{part:06d}-{uuid.uuid4().hex}"
                ids, idx = fs.open_output_stream(f"{top}/{name}.ids"), fs.open_output_stream(f"{top}/{name}.idx")
            done = 0
            for sizes, flat in encoder.group(group):
                own = keys[done:done + len(sizes)]
                idx.write(np.stack([own, np.cumsum(sizes) - sizes + n_ids], 1).astype("<i8").tobytes())
                ids.write(flat.tobytes())
                done, n_ids = done + len(sizes), n_ids + len(flat)
            n_docs += done
        if encoder is not None:
            idx.write(np.array([-1, n_ids], "<i8").tobytes())
            ids.close()
            idx.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f"{name}:{encoder.dtype.str}"]), pa.array([n_docs], pa.int64()),
                 pa.array([n_ids], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    rows = texts(docs)
    files = -(-(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // file_bytes)
    ordered = rows.repartitionByRange(max(1, files), "doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(ordered.mapInArrow(run, MANIFEST).collect())


def _mapped(fs, path: str, dtype: str):
    """The file's integers, memory-mapped where the folder is a local mount."""
    from pyarrow import fs as pfs

    if isinstance(fs, pfs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    return np.frombuffer(fs.open_input_file(path).read_buffer(), dtype)


def read_ids(spark: SparkSession, folder: str, manifest: list, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files;
    with ``with_ids`` the ids too. Bases are prefix sums over the manifest."""
    prepare(spark)
    bases = [0, *accumulate(m["n_ids"] for m in manifest)]
    rows = [(m["path"], base) for m, base in zip(manifest, bases, strict=False)]
    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fs, top = _filesystem(folder)
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name, _, dtype = path.partition(":")
                idx = _mapped(fs, f"{top}/{name}.idx", "<i8").reshape(-1, 2)
                ids = _mapped(fs, f"{top}/{name}.ids", dtype)
                for at in range(0, len(idx) - 1, 1024):
                    part = np.asarray(idx[at: min(at + 1025, len(idx))])
                    own = [np.asarray(ids[s:e]).astype("<u4") for s, e in zip(part[:-1, 1], part[1:, 1], strict=True)]
                    cols = [pa.array([None if d == NULL_ID else d for d in part[:-1, 0].tolist()], pa.int64()),
                            pa.array(part[:-1, 1] + base), pa.array(np.diff(part[:, 1])),
                            pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols, names = [*cols, pa.array([x.tolist() for x in own], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"
                            + ", ids array<long>" * with_ids)


def shared_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-ids-{uuid.uuid4().hex}"
