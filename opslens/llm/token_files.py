"""Token ids as Arrow stream files of fixed-size lists.

Documents are range-partitioned and sorted by doc_id. Each partition writes one pair of stream files into a
shared folder: sequences (`ids` and `mask`, fixed-size lists of `width`; every record batch but the last holds
ROWS sequences, so sequence i is row i % ROWS of batch i // ROWS and is read from a memory map without a copy) and
an index (doc_id, start within the file, n_tokens). Ids take 16 bits if the vocabulary allows. The mask is
false where the last sequence is padded.

A task names its files anew on every attempt, and only the names that successful tasks return get into
the manifest, so attempts that were lost or repeated leave no trace in the data. Reading takes a task per file.

A null or empty text is just the end id. Repeated rows are written as often as they occur; null doc_ids
come first. An empty table writes no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.llm.common import shuffle_partitions
from opslens.llm.tokens import tokenizer
from opslens.session import shared_dir, stage

WIDTH = 2048
ROWS = 64
END_ID = 1
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(width: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), width)), ("mask", pa.list_(pa.bool_(), width))])


def _sequences(ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of whole sequences, the last one padded with 0."""
    width, kind = schema.field("ids").type.list_size, schema.field("ids").type.value_type
    rows = -(-len(ids) // width)
    flat = np.zeros(rows * width, kind.to_pandas_dtype())
    flat[: len(ids)] = ids
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), width) for x in (flat, np.arange(rows * width) < len(ids))]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def write(docs: DataFrame, folder: str, path: str, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """Write the files; the manifest: part, sequences, index (paths), n_docs, n_tokens, base (ids in the parts before)."""
    wide = tokenizer(path).whole.get_vocab_size() > 1 << 16

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (b for b in stream if b.num_rows)
        first = next(stream, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        schema, step = sequence_schema(width, wide), width * ROWS
        n_docs = n_tokens = 0
        held, size = [], 0
        with fs.open_output_stream(f"{name}.tokens") as a, fs.open_output_stream(f"{name}.index") as b:
            with pa.ipc.new_stream(a, schema) as tokens, pa.ipc.new_stream(b, INDEX) as index:
                batch = first
                while batch is not None:
                    encoded = [np.append(x, np.uint32(end_id)) for x in tokenizer(path).encode(batch.column("text"))]
                    sizes = np.array([len(x) for x in encoded])
                    starts = n_tokens + np.cumsum(sizes) - sizes
                    index.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(starts), pa.array(sizes)], schema=INDEX))
                    n_docs, n_tokens = n_docs + len(sizes), n_tokens + int(sizes.sum())
                    held, size = held + encoded, size + int(sizes.sum())
                    if size >= step:
                        flat = np.concatenate(held)
                        for k in range(0, size - size % step, step):
                            tokens.write_batch(_sequences(flat[k:k + step], schema))
                        held, size = [flat[size - size % step:]], size % step
                    batch = next(stream, None)
                if size:
                    tokens.write_batch(_sequences(np.concatenate(held), schema))
        yield pa.record_batch([pa.array([part]), pa.array([f"{name}.tokens"]), pa.array([f"{name}.index"]),
                               pa.array([n_docs]), pa.array([n_tokens])],
                              names=["part", "sequences", "index", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    files = stage(ranged.mapInArrow(batches, "part long, sequences string, index string, n_docs long, n_tokens long"), "manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_sequences(source: pa.NativeFile) -> list[pa.RecordBatch]:
    """The record batches of a token file; from a memory map they are views of it."""
    return list(pa.ipc.open_stream(source))


def sequence(batches: list[pa.RecordBatch], i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence i of a file."""
    row = batches[i // ROWS].slice(i % ROWS, 1)
    width = row.schema.field("ids").type.list_size
    at = row.column("ids").offset * width
    ids = row.column("ids").values.to_numpy()[at:at + width]
    mask = row.column("mask").values.slice(at, width).to_numpy(zero_copy_only=False)
    return ids, mask


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                fs, _ = pa.fs.FileSystem.from_uri(folder)
                with fs.open_input_stream(row["sequences"]) as a, fs.open_input_stream(row["index"]) as b:
                    tokens = iter(pa.ipc.open_stream(a))
                    held, first = np.zeros(0, "<u4"), 0  # ids of the file from position `first` on
                    for index in pa.ipc.open_stream(b):
                        sums = []
                        for start, n in zip(index.column("start").to_pylist(), index.column("n_tokens").to_pylist()):
                            more, size = [held[start - first:]], len(held) - (start - first)
                            while size < n:
                                got = next(tokens)
                                ids = got.column("ids").flatten().to_numpy()
                                real = got.column("mask").flatten().to_numpy(zero_copy_only=False)
                                more.append(ids[real].astype("<u4"))
                                size += len(more[-1])
                            held, first = np.concatenate(more) if len(more) > 1 else more[0], start
                            sums.append(zlib.crc32(np.ascontiguousarray(held[:n]).tobytes()))
                        yield pa.record_batch([
                            index.column("doc_id"), pa.array(index.column("start").to_numpy() + row["base"]),
                            index.column("n_tokens"), pa.array(sums, pa.int64()),
                        ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("part", "sequences", "index", "base")
    dealt = files.repartition(shuffle_partitions(manifest.sparkSession), "part")
    return dealt.mapInArrow(batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, path: str) -> DataFrame:
    folder = shared_dir(docs.sparkSession)
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = f"{folder}/tokens-{uuid.uuid4().hex}"
    return read(write(docs, folder, path), folder)
