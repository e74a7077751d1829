"""Helpers that the corpus operators share: text slices, symbol streams, cut lineage, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker expands into arrays at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19


def lean(run: Callable) -> Callable:
    """`run`, after which a worker returns the memory that it no longer uses; workers live long and serve many stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Returns memory that this process no longer uses to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Within, Arrow batches hold at most `size` bytes: long texts and sets come in few rows, and buffers grow by doubling."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets (one more than rows) and bytes of a string column; a null has no bytes."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most `limit` bytes together, or one row that is longer."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def sliced(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that one holds at most `limit` bytes of text or one row."""
    for batch in batches:
        offsets, _ = utf8(batch.column(batch.schema.get_field_index(text)))
        for start, stop in slices(offsets, limit):
            yield batch.slice(start, stop - start)


def unique(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; sorting numbers is several times as fast as np.unique, which hashes them."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


_LETTER: dict[bool, np.ndarray] = {}


def letters(digits: bool = False) -> np.ndarray:
    """For each code point whether it is a letter (or a decimal digit, if `digits`); made once in a worker."""
    if digits not in _LETTER:
        _LETTER[digits] = np.fromiter((chr(c).isalpha() or digits and chr(c).isdecimal() for c in range(0x110000)), bool, 0x110000)
    return _LETTER[digits]


#: Bits of a symbol: code points under 2048 keep their value, the others share the upper half by a hash.
SYMBOL_BITS = 12


def symbols(texts: list[str | None], pad: int, digits: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts as one stream of 12-bit letter symbols, each run of other characters as one 0.

    Before each text stand `pad` zeros and after it one, so that windows never cross documents. Digits are symbols
    too if `digits`. Returns the stream, the row of each symbol, and the number of letters of each row.
    """
    gap = "\0" * pad
    low = [(t or "").lower() for t in texts]
    size = np.fromiter((len(t) for t in low), np.int64, len(low)) + pad + 1
    code = np.frombuffer("".join(gap + t + "\0" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int32), size)
    letter = letters(digits)[code]
    count = np.bincount(row[letter], minlength=len(low))
    value = np.where(code < 2048, code, 2048 + ((code * np.uint32(2654435761)) >> np.uint32(21))).astype(np.uint16)
    value[~letter] = 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = np.cumsum(size) - size
    keep[(starts[:, None] + np.arange(pad)).ravel()] = True
    keep[starts + size - 1] |= True
    return value[keep], row[keep], count


def grams(stream: np.ndarray, row: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each position from `order` - 1 on, and its row, within one text."""
    key = np.zeros(max(0, len(stream) - order + 1), np.int64)
    for i in range(order):
        key = (key << SYMBOL_BITS) | stream[i : i + len(key)].astype(np.int64)
    own = row[: len(key)] == row[order - 1 :]
    return key[own], row[order - 1 :][own]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal first `keys` columns, over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        cols = [np.asarray(b.column(i)) for i in range(keys)]
        change = np.zeros(len(b), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), len(b)]
        for s, e in zip(starts, starts[1:], strict=False):
            key = tuple(c[s] for c in cols)
            if key != last and held:
                whole, held = [pa.Table.from_batches(held)], []
                yield whole.pop()  # what is handed on is held no longer
            held.append(b.slice(s, e - s))
            last = key
    if held:
        whole, held = [pa.Table.from_batches(held)], []
        yield whole.pop()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors reach; unset, a temporary one in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/doculith-checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the cluster's checkpoint folder and read again, so that a lost executor costs no long recomputation."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps that no DataFrame refers to any more; it learns of them from the garbage collectors of both sides."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediates through Spark's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Intermediate tables as compressed Parquet in the shared folder, until `drop`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, rows: DataFrame) -> DataFrame:
        """The rows, written and read again: what made them is not needed any more."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        remove_folder(self.spark, self.folder)


def fresh(name: str, *taken: list[str]) -> str:
    """`name`, with as many underscores behind it as no column of `taken` has; names are compared as Spark does."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over rows (u, v): each u sends its neighbours, sorted behind it, to the least of them.

    The large step takes both directions, counts u itself and moves the neighbours above u; the small one has v < u and
    moves u and all others. Neighbours come in order, so the least is the first, and no neighbourhood is held.
    """
    rows = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    dealt = rows.repartition("u").sortWithinPartitions("u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_u = last_v = last_m = None
        for b in batches:
            if not len(b):
                continue
            u, v = (np.asarray(b.column(i)) for i in (0, 1))
            start = np.append(True, u[1:] != u[:-1])
            again = np.append(False, (v[1:] == v[:-1]) & ~start[1:])
            first = np.flatnonzero(start)
            m = np.minimum(u[first], v[first]) if large else v[first].copy()
            if last_u is not None and u[0] == last_u:
                m[0], again[0] = last_m, v[0] == last_v
            last_u, last_v, last_m = u[-1], v[-1], m[-1]
            m = m[np.cumsum(start) - 1]
            out = v if large else np.where(v == m, u, v)
            keep = ~again & (out != m) & ((v > u) if large else True)
            yield pa.RecordBatch.from_arrays([pa.array(out[keep]), pa.array(m[keep])], names=["u", "v"])

    return dealt.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node that links reach, for each node of an edge.

    Alternates large-star and small-star steps until no edge changes. Nothing is collected, no neighbourhood is held,
    and the rounds grow with the logarithm of the longest path.
    """
    pairs = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    pairs = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        pairs = cut(_stars(_stars(pairs, True), False).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    rooted = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rooted.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
