"""Token ids in Arrow IPC files of fixed-size lists, for zero-copy random access.

Documents are dealt by ranges of their id and sorted, so shard after shard holds the ids of all
documents in ascending order. A shard is two files in the shared folder: ``tokens.arrow``, whose
record batches hold equal-length sequences (``tokens``) and what of them is filled (``mask``), and
``docs.arrow`` with the id, first token and number of tokens of each document. A sequence is found by
its number alone: batch number // BATCH, row number % BATCH. Ids take 16 bits where the
vocabulary fits.

A task writes under a name of its own attempt and the manifest lists what succeeded, so lost executors
and repeated attempts leave no half-written shard in use.

Defined results: NULL and empty texts have the end id alone; NULL ids come first; rows of one id are
ordered by a digest of their text; repeated rows are written each; an empty table gives no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.llm import tokens as K
from cohortia.llm import words as W
from cohortia.session import cut, scratch_path

LENGTH = 2048
BATCH = 256


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


class ShardWriter:
    """Writes one shard; ids come in any portions and leave in full sequences, the last one masked."""

    def __init__(self, path: str, kind: np.dtype, length: int = LENGTH):
        self.path, self.length, self.kind = path, length, np.dtype(kind)
        fs, where = _place(path)
        fs.create_dir(where, recursive=True)
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = fs.open_output_stream(f"{where}/tokens.arrow"), fs.open_output_stream(f"{where}/docs.arrow")
        self.tokens = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], self.index)
        self.rest = np.zeros(0, self.kind)
        self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(at[:-1] + self.n_tokens), pa.array(np.diff(at))], schema=self.index))
        self.n_docs, self.n_tokens = self.n_docs + len(doc_ids), self.n_tokens + len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(self.kind)])
        step = self.length * BATCH
        full = len(self.rest) // step * step
        for i in range(0, full, step):
            self._write(self.rest[i:i + step])
        self.rest = self.rest[full:].copy()

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        mask = np.arange(rows * self.length) < len(ids)
        ids = np.pad(ids, (0, rows * self.length - len(ids)))
        self.tokens.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            self._write(self.rest)
        for x in (self.tokens, self.docs, *self.sinks):
            x.close()


class Shard:
    """A written shard. Local files are mapped into memory; nothing is read before it is asked for."""

    def __init__(self, path: str):
        fs, where = _place(path)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.reader, self.index = (pa.ipc.open_file(pa.memory_map(f"{where}/{x}.arrow") if local else fs.open_input_file(f"{where}/{x}.arrow"))
                                   for x in ("tokens", "docs"))

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, mask) of a sequence; the tokens are a view of the file."""
        batch = self.reader.get_batch(number // BATCH)
        row = number % BATCH
        size = batch.schema.field("tokens").type.list_size
        return (batch.column(0).flatten().slice(row * size, size).to_numpy(),
                batch.column(1).flatten().slice(row * size, size).to_numpy(zero_copy_only=False))

    def batches(self) -> Iterator[np.ndarray]:
        """Token ids, without filling, of one record batch after the other."""
        for i in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(i)
            filled = int(batch.column(1).flatten().true_count)
            yield batch.column(0).flatten().to_numpy()[:filled]

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for i in range(self.index.num_record_batches):
            batch = self.index.get_batch(i)
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def write(df: DataFrame, vocabulary: str, folder: str | None = None, id_col: str = "doc_id", text: str = "text",
          end: int = 2, length: int = LENGTH) -> DataFrame:
    """Write all texts of ``df``; the manifest: path, shard (in order), n_docs, n_tokens, start (ids before the shard)."""
    folder = folder or scratch_path(df.sparkSession, "tokens")
    run_id = uuid.uuid4().hex[:8]
    docs = df.select(df[id_col].alias("doc_id"), df[text].alias("text"), F.xxhash64(df[text]).alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        path, out = f"{folder}/{run_id}-{shard:06d}-{context.taskAttemptId()}", None
        encoder = K.WordEncoder.of(vocabulary)
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                out = out or ShardWriter(path, encoder.kind, length)
                out.add(batch.column(0).slice(first, texts.n), *K.with_end(*encoder.encode(texts), end))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([shard]), pa.array([out.n_docs]), pa.array([out.n_tokens])],
                                             ["path", "shard", "n_docs", "n_tokens"])

    manifest = cut(dealt.mapInArrow(run, "path string, shard long, n_docs long, n_tokens long"))
    # one row for each shard
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that ``manifest`` lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple[int | None, int, int, int]] = []
                shard = Shard(path)
                parts = shard.batches()
                part = np.zeros(0, np.uint32)
                for doc_id, start, n in shard.documents():
                    crc, left = 0, n
                    while left:
                        if not len(part):
                            part = next(parts)
                        crc = zlib.crc32(part[:left].astype("<u4").tobytes(), crc)
                        left, part = left - len(part[:left]), part[left:]
                    rows.append((doc_id, begin + start, n, crc))
                    if len(rows) >= 20_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    shards = cut(manifest.select("path", "start", "shard"))
    # a number of its own, as the few bytes of the manifest would be put together in one task
    return (shards.repartition(max(shards.count(), 1), "shard").select("path", "start")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def _batch(rows: list[tuple[int | None, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])
