"""A commit log for tables that are written batch by batch.

A table folder holds ``data/`` with one folder for each attempt to write a
batch, and ``log/`` with one small manifest for each commit. Only folders that
a manifest names belong to the table: what a lost or repeated attempt left
behind is never read. A manifest is written under another name and then renamed
to ``<number>.json``, so a half-written one is never seen. Where a rename fails
if the name is taken (HDFS), of two writers that want a number one gets it and
the other takes the next; elsewhere a table should have one writer at a time.

A manifest also names what the batch was made of (its ``inputs``, for a file
source the files' paths). Inputs that some commit names are done, whichever
run, checkpoint folder or batch size committed them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class CommitLog:
    """The log of one table folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._known: dict[int, dict] = {}  # manifests never change
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        log = self._path("log")
        if not self._fs.exists(log):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commits(self) -> list[dict]:
        """All manifests, oldest first: one small file for each batch, read once."""
        numbers = self.numbers()
        paths = [f"{self.folder}/log/{n:012}.json" for n in numbers if n not in self._known]
        if paths:
            new = self.spark.read.text(paths, wholetext=True).selectExpr("value", "_metadata.file_path as file")
            self._known |= {int(r["file"][-17:-5]): json.loads(r["value"]) for r in new.collect()}
        return [self._known[n] for n in numbers]

    def done(self) -> set[str]:
        """Inputs of all commits."""
        return {x for c in self.commits() for x in c["inputs"]}

    def write(self, df: DataFrame) -> str:
        """Write the rows of one attempt; they are not in the table yet."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def commit(self, name: str, inputs: list[str]) -> int:
        """Make a written folder part of the table, with what it was made of."""
        text = json.dumps({"folder": name, "inputs": sorted(inputs)})
        self._fs.mkdirs(self._path("log"))
        draft = self._path(f"log/.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        number = max(self.numbers(), default=-1) + 1
        while self._fs.exists(self._path(f"log/{number:012}.json")) or not self._fs.rename(
                draft, self._path(f"log/{number:012}.json")):
            number += 1
        return number

    def read(self, schema: StructType) -> DataFrame:
        """Rows of the committed folders; an empty table if there are none."""
        folders = list(dict.fromkeys(c["folder"] for c in self.commits()))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in folders])
