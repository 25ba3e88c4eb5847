"""Shared plumbing of the corpus operators.

Texts are handled as whole UTF-8 byte strings (null counts as empty).  Two ideas are used by several
operators:

* *blocks*: documents are dealt by a hash of ``doc_id`` into blocks of a bounded number of bytes; a block is
  shipped as a few compressed Arrow payloads, so that moving texts costs about a third of their size;
* *shards*: sorted 64-bit keys of a block are cut by key range into shards.  A shard sees each block's distinct
  keys once, so a very common key costs one entry per block however often it occurs.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
pa.set_memory_pool(pa.system_memory_pool())  # the other pools keep what is freed, and workers live long


def tidy(f):
    """A group function that gives freed memory back after each group, so that a worker's size is one group's."""

    def trim(out):
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library
            pass
        return out

    if f.__code__.co_argcount == 1:  # Spark counts the arguments
        return lambda group: trim(f(group))
    return lambda left, right: trim(f(left, right))


BLOCK_BYTES = 3_000_000
MIN_BLOCKS = 64
#: ASCII white space that separates words: 0x20 and 0x09-0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; where that is unset, a folder
    of this machine if Spark runs on it alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/kindred-checkpoints"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def written() -> int:
    """How many folders are there that ``materialize`` wrote and nobody dropped."""
    return len(_WRITTEN)


def drop_written(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the folders written after the first ``since``, but for the last ``keep``.  Only what was read from them
    into something that is itself written may be dropped."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Bytes of all texts: sizes blocks and shards, which therefore grow in number, not in size."""
    return docs.agg(F.sum(F.octet_length(col))).first()[0] or 0


def n_blocks(total: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(MIN_BLOCKS, -(-total // block_bytes))


def fold_of(id_col="doc_id", mod: int = 10):
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["p"]) < n:
        n = max(n, 1 << 16)
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POW[key] = np.cumprod(x, dtype=np.uint64)
    return _POW["p"], _POW["i"]


def buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary array; nulls become empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = _SPACE):
    """Starts, ends and document index of the maximal runs of non-separators; none crosses a document."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    gap = sep[data]
    word = ~gap
    before = cut[:n].copy()
    before[1:] |= gap[:-1]
    after = cut[1:].copy()
    after[:-1] |= gap[1:]
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each span, by differences of a running polynomial sum; spans are in order and disjoint."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        p, q = _powers(b - a + 1)
        run = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_TABLE[data[a:b]] * p[: b - a], out=run[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((run[e] - run[s]) * q[s] + (e - s).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        i = j
    return out


# Blocks -----------------------------------------------------------------------------------------------------


def with_block(docs: DataFrame, blocks: int, *cols: str) -> DataFrame:
    """Rows with a block each; id and text decide, so that many texts of one id (or of none) span many blocks."""
    return docs.withColumn("block", F.pmod(F.xxhash64(*(cols or ("doc_id", "text"))), F.lit(blocks)).cast("int"))


def pack_blocks(docs: DataFrame, cols: list[str], flush: int = 12_000_000) -> DataFrame:
    """Rows (block, payload) from rows that have a column block: payload is a compressed Arrow stream of cols."""

    def pack(batches):
        held, size = [], 0

        def emit():
            t = pa.Table.from_batches(held)
            b = t.column("block").to_numpy()
            order = np.argsort(b, kind="stable")
            t, b = t.drop_columns(["block"]).take(order), b[order]
            edge = np.flatnonzero(np.diff(b, prepend=b[0] - 1 if len(b) else 0))
            rows = []
            for x, y in zip(edge, [*edge[1:], len(b)], strict=True):
                rows.append((int(b[x]), encode_table(t.slice(x, y - x).combine_chunks())))
            step = max(1, len(rows) // 8)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], ["block", "payload"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= flush:
                yield from emit()
                held, size = [], 0
        if held:
            yield from emit()

    return docs.select("block", *cols).mapInArrow(pack, "block int, payload binary")


def encode_table(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def decode_table(payloads: pa.ChunkedArray) -> pa.Table:
    parts = [pa.ipc.open_stream(p.as_buffer()).read_all() for c in payloads.chunks for p in c]
    return pa.concat_tables(parts)


def pieces(offsets: np.ndarray, most: int = 1 << 19):
    """Index ranges of documents of together at most this many bytes (one longer document stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def planes(keys: np.ndarray) -> bytes:
    """Sorted keys by byte planes, most significant first, which compresses far better."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(a.T).view(">u8").reshape(-1).astype(np.uint64)


def gather(data: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches one behind the other."""
    ends = np.cumsum(size)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(pos - (ends - size), size)]


def binary_column(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Binary cells over the items (or rows) values[edge[i]:edge[i + 1]], without a copy."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * int(np.prod(values.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * width).astype(np.int32)), pa.py_buffer(values)])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Which of equal ranges of the 64-bit space each key lies in; never falls as keys rise."""
    return (((keys >> U(32)) * U(shards)) >> U(32)).astype(np.int64)


def shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Positions that cut sorted keys into equal ranges of the 64-bit space."""
    bounds = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds, "left"), [len(keys)])).astype(np.int64)
