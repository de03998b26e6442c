"""Shared parts of the training-data operators: shared tables, Arrow text access, hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys below this stand for rows without an id; they sort before every id.
NULL_ID = -(2**63)
NO_ID_END = NULL_ID + 2**60
#: Bytes of text that one vectorised step works on.
CHUNK_BYTES = 1_000_000

_made: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset: a folder of an own on the cluster's default file system, or, if driver and
    executors are one local process, a temporary one. A cluster with neither raises ValueError, as
    a folder of one machine would lose tables with it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if not default.startswith("file:"):
            _own_dir[app] = f"{default.rstrip('/')}/tmp/checkpoints/{app}"
        elif spark.sparkContext.master.startswith("local["):
            _own_dir[app] = f"file:///tmp/checkpoints/{app}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir[app]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(name)
    atexit.register(Path(name).unlink, missing_ok=True)  # the driver serves it as long as it runs
    _shipped.add(context.applicationId)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; removed when the program ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def made_so_far() -> int:
    """A mark for drop_since()."""
    return len(_made)


def made_since(mark: int) -> list[tuple[SparkSession, str]]:
    """What was written since the mark, for drop()."""
    return _made[mark:]


def drop(made: list[tuple[SparkSession, str]], keep: list[DataFrame]) -> None:
    """Delete these tables, but those that `keep` still reads."""
    read = {f.rsplit("/", 2)[-2] for df in keep for f in df.inputFiles()}
    for spark, path in [x for x in made if x in _made and x[1].rsplit("/", 1)[-1] not in read]:
        drop_path(spark, path)
        _made.remove((spark, path))


def drop_since(mark: int, keep: list[DataFrame]) -> None:
    """Delete the tables written since the mark, but those that `keep` still reads."""
    drop(made_since(mark), keep)


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may already be gone
            return


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: While a table is written: its own shuffle files go with it, and small tables become few files.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


#: Rows that a file of a small table holds at least, and files that any table may have.
FILE_ROWS, FILES = 500_000, 8


def written(df: DataFrame, label: str, release: bool = False, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The write's own shuffle files go when it is done, as the table stands in their place.
    release: also let Spark's cleaner run for what earlier steps left. rows: about how many there
    will be, so that a small table does not become a file for each of many partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(FILES, -(-rows // FILE_ROWS)))
    path = new_path(spark, label)
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def ided(column: str, text: str | None = None) -> Column:
    """The id as a join key. A null id becomes NULL_ID or, with the text's column, a key of its text below NO_ID_END.

    So rows without an id are documents of their own, told apart by their text; an id that
    lies in that range itself raises an error.
    """
    key = F.col(column).cast("long")
    none = F.lit(NULL_ID)
    if text:
        none = none + F.xxhash64(text).bitwiseAND(F.lit(2**60 - 1))
    sound = F.when(key < NO_ID_END, F.raise_error(F.lit(f"{column} below {NO_ID_END} is kept for rows without an id")).cast("long")).otherwise(key)
    return F.when(key.isNull(), none).otherwise(sound)


def un_ided(column: str) -> Column:
    return F.when(F.col(column) >= NO_ID_END, F.col(column))


def doc_frame(docs: DataFrame) -> DataFrame:
    """Only the key and the text, whatever else the table holds."""
    return docs.select(ided("doc_id", "text").alias("doc_key"), F.col("text"))


_libc = ctypes.CDLL(None) if os.name == "posix" else None


def trim() -> None:
    """Give memory that this Python worker freed back to the machine: an idle worker beside the next stage costs little."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


# ---------------------------------------------------------------- Arrow text


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offs


def row_chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text each; a longer row stands alone."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of rows: byte spans, row of each, first word of each row."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        base = int(offs[0])
        self.data = raw[base : int(offs[-1])]
        self.offs = offs - base
        n = len(self.data)
        used = ~_SEP[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offs] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~used[:-1]
            after[-1], after[:-1] = True, ~used[1:]
        self.used = used
        self.starts = np.flatnonzero(used & (before | edge[:-1]))
        self.ends = np.flatnonzero(used & (after | edge[1:])) + 1
        self.row = np.searchsorted(self.offs, self.starts, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(offs)))  # of each row, and the end

    def hashes(self, seed: int, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; lower folds A-Z.

        A polynomial in the word's bytes modulo the prime 2**61 - 1, in a base of the seed's own.
        """
        lens = self.ends - self.starts
        if not len(lens):
            return np.zeros(0, np.uint64)
        first = np.cumsum(lens) - lens
        low, high = _powers(seed)
        codes = (_LOWER if lower else _PLAIN)[self.data[self.used]]
        if int(lens.max()) <= SEGMENT:
            parts, word = first, None
            place = np.arange(len(codes)) - np.repeat(first, lens)
        else:  # long words in segments
            many = -(-lens // SEGMENT)
            word = np.repeat(np.arange(len(lens)), many)
            turn = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
            parts = first[word] + turn * SEGMENT
            place = np.arange(len(codes)) - np.repeat(parts, np.diff(np.concatenate((parts, [len(codes)]))))
        value = _reduced(np.add.reduceat(codes * high[place], parts), np.add.reduceat(codes * low[place], parts))
        if word is not None:
            value = _joined(value, word, turn, seed)
        with np.errstate(over="ignore"):
            return mix(value + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


PRIME = 2**61 - 1
#: Bytes of a word that are summed before a reduction.
SEGMENT = 1 << 14
_PLAIN = np.arange(1, 257, dtype=np.uint64)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_cached: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _base(seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"base {seed}".encode(), digest_size=8).digest(), "little") % (PRIME - 2**32) + 2**31


def _powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the seed's base modulo PRIME: their lower 32 bits, the rest."""
    if seed not in _cached:
        base, x, powers = _base(seed), 1, []
        for _ in range(SEGMENT):
            powers.append(x)
            x = x * base % PRIME
        p = np.array(powers, np.uint64)
        _cached[seed] = p & np.uint64(2**32 - 1), p >> np.uint64(32)
    return _cached[seed]


def _reduced(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(high * 2**32 + low) modulo PRIME, for sums of a segment: high under 2**53, low under 2**56."""
    x = (high >> np.uint64(29)) + ((high & np.uint64(2**29 - 1)) << np.uint64(32)) + low
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def _joined(value: np.ndarray, word: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    """The polynomials of words from those of their segments."""
    out = value[turn == 0]
    step, power, at = pow(_base(seed), SEGMENT, PRIME), {}, None
    for i in np.flatnonzero(turn):
        k = int(turn[i])
        if k not in power:
            power[k] = pow(step, k, PRIME)
        at = word[i]
        out[at] = (int(out[at]) + int(value[i]) * power[k]) % PRIME
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: a bijection on 64-bit values."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def run_hash(h: np.ndarray, at: np.ndarray, width: int, tag: int) -> np.ndarray:
    """Hash of the `width` symbols from each position in `at`."""
    out = np.full(len(at), tag, np.uint64)
    factor = 0x9FB21C651E98DF25
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0xF1357AEA2E62A9C5) + h[at + k] * np.uint64((factor + 2 * k) % 2**64)
    return mix(out)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def lists(flat: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    """flat split by row (ascending), for rows 0..n-1."""
    return np.split(flat, np.searchsorted(row, np.arange(1, n)))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a list<int64> column; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), sizes)
