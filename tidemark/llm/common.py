"""Helpers shared by the corpus operators."""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import session

#: Texts are handled in slices of at most this many bytes of Arrow data, so that a batch of very long ones stays small.
SLICE_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def body(column: str = "text"):
    """The text, or the empty string where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``SLICE_BYTES`` in each; no row is dropped."""
    for batch in batches:
        n, size = batch.num_rows, batch.column(column).nbytes
        if not n:
            continue
        step = n if size <= SLICE_BYTES else max(1, n * SLICE_BYTES // size)
        for i in range(0, n, step):
            yield batch.slice(i, min(step, n - i))


def map_texts(df: DataFrame, text_col: str, fn: Callable, fields: list[T.StructField], keep: list[str]) -> DataFrame:
    """Apply ``fn(list of texts) -> list of columns`` to every row, Arrow batch by Arrow batch.

    ``keep`` columns pass through; columns of the same name as a new field are replaced. Null texts reach ``fn`` as None.
    """
    fresh = {f.name for f in fields}
    keep = [c for c in keep if c not in fresh]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + fields)

    def run(batches):
        for part in slices(batches, "__text"):
            made = fn(part.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [_array(v, f.dataType) for v, f in zip(made, fields, strict=True)], names=keep + [f.name for f in fields])

    return session.arrow_map(source, run, schema)


def _array(values, kind: T.DataType) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    return values if isinstance(values, pa.Array) else pa.array(values, type=to_arrow_type(kind))


#: Entries of a table of a memo, and the length of a key that is kept.
MEMO_KEYS, MEMO_LONGEST = 60_000, 64


class Memo:
    """Ids of what was seen: in a table of what came again, kept for good, and one of what is new, emptied when full."""

    def __init__(self, keys: int | None = None):
        self.keys = keys or MEMO_KEYS
        self.often: dict = {}
        self.new: dict = {}

    def recall(self, key):
        if (ids := self.new.get(key)) is not None and len(self.often) < self.keys:
            self.often[key] = ids
        return ids

    def get(self, key):
        ids = self.often.get(key)
        return self.recall(key) if ids is None else ids

    def add(self, key, ids: bytes) -> bytes:
        if len(key) <= MEMO_LONGEST:
            if len(self.new) >= self.keys:
                self.new.clear()
            self.new[key] = ids
        return ids


# Files in the shared folder: readable from the driver and from every executor.


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write whole or not at all, so that a second attempt of a task can't leave a torn file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(data)
    fs.move(draft, path)


def map_file(uri: str):
    """The file's bytes: memory-mapped where the folder is mounted, else read through the store's client."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with fs.open_input_file(path) as f:
        return f.read()
