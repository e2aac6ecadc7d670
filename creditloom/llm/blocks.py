"""Documents packed into blocks, and exchanging keys between blocks.

Corpus-wide questions ("who else has this window?", "how often does this token
occur?") are asked per block of documents instead of per row. Each block sends
every distinct key once, with its own partial value, to the bucket the key
belongs to; the bucket combines the values of all blocks and answers each block.
A key that is in a third of all documents therefore costs one entry per block,
not one per document, and no task ever holds more than one bucket or one block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import configure, settle

BLOCK_BYTES = 4_000_000  # text in a block; a longer document is a block of its own
KEYS_PER_BUCKET = 2_000_000
BATCH_ROWS = 2_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: smaller Arrow batches, as a document can be long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def release() -> None:
    """Give back what Arrow and the allocator hold on to, so that a worker waiting for its next task is small."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Row by row, as a row can be a whole block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)
    release()


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroup batches into tables holding about `limit` bytes of `column`, one row at least."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n + 16
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
    release()


def _pack(batches):
    for table in pieces(batches, "text"):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.combine_chunks())
        yield pa.RecordBatch.from_arrays(
            [pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([table["text"].nbytes], pa.int64())],
            ["payload", "n_bytes"])


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def to_blocks(docs: DataFrame, *columns: str) -> DataFrame:
    """(block, payload, n_bytes): the named columns of all rows, packed; `text` has to be one of them.

    The blocks are written once, so a block keeps its number in every later pass.
    """
    packed = docs.select(*columns).mapInArrow(_pack, "payload binary, n_bytes long")
    return settle(packed.withColumn("block", F.monotonically_increasing_id()))


def n_buckets(blocks: DataFrame, bytes_per_key: float) -> int:
    """Buckets for about one key per `bytes_per_key` bytes of text, each of bounded size."""
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shuffles = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(shuffles, total // 100_000 + 1), int(total / bytes_per_key) // KEYS_PER_BUCKET)


KEYED = "bucket int, block long, keys binary, amounts binary"


def keyed_rows(block: int, keys: np.ndarray, amounts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket for a block's distinct sorted uint64 keys and their int64 amounts."""
    where = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    keys, amounts, where = keys[order], amounts[order], where[order]
    edges = np.flatnonzero(np.diff(where, prepend=-1)) if len(where) else np.empty(0, np.int64)
    parts = list(zip(edges, [*edges[1:], len(where)]))
    return pa.RecordBatch.from_arrays([
        pa.array([int(where[a]) for a, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()),
        pa.array([keys[a:b].tobytes() for a, b in parts], pa.binary()),
        pa.array([amounts[a:b].tobytes() for a, b in parts], pa.binary())], ["bucket", "block", "keys", "amounts"])


def combine(bucket: pa.Table, how: np.ufunc):
    """Of a bucket's rows: keys, the blocks' own amounts, the amounts combined per key, and each row's [start, end)."""
    blobs = bucket["keys"].to_pylist()
    ends = np.cumsum([len(b) // 8 for b in blobs])
    keys = np.frombuffer(b"".join(blobs), np.uint64)
    own = np.frombuffer(b"".join(bucket["amounts"].to_pylist()), np.int64)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] - np.uint64(1)))
    combined = np.empty(len(keys), np.int64)
    combined[order] = np.repeat(how.reduceat(own[order], first), np.diff(np.append(first, len(keys))))
    return keys, own, combined, list(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())), order[first]


def answers(keyed: DataFrame, how: np.ufunc, answer: Callable[[np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """Combine the amounts of each key over all blocks and answer every block.

    `answer(own, combined)` gets, for the keys of one block in one bucket, the
    block's amounts and the combined ones. Returns (block, answers), the answers
    as an array of (bucket, out); `aligned` puts them back in key order.
    """
    def run(bucket: pa.Table) -> pa.Table:
        _, own, combined, parts, _ = combine(bucket, how)
        out = [answer(own[a:b], combined[a:b]) for a, b in parts]
        return pa.table({"block": bucket["block"], "bucket": bucket["bucket"], "out": pa.array(out, pa.binary())})

    return by_block(keyed.groupBy("bucket").applyInArrow(run, "block long, bucket int, out binary"))


def by_block(out: DataFrame) -> DataFrame:
    return out.groupBy("block").agg(F.collect_list(F.struct("bucket", "out")).alias("answers"))


def aligned(keys: np.ndarray, found, buckets: int, decode: Callable[[bytes, int], np.ndarray], kind: type) -> np.ndarray:
    """The answers of a block in the order of its keys. `decode(out, n)` gives n values."""
    where = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    sizes = np.bincount(where, minlength=buckets)
    got = {x["bucket"]: x["out"] for x in found or []}
    values = [decode(got[b], n) for b, n in enumerate(sizes.tolist()) if n]
    out = np.empty(len(keys), kind)
    out[order] = np.concatenate(values) if values else np.empty(0, kind)
    return out


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(out: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(out, np.uint8), count=n).astype(bool)


def keeping(docs: DataFrame, added: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`run` on `docs`, returned with exactly the columns of `docs`, also where `run` adds columns of the same names."""
    aside = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if c in added}
    out = run(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
