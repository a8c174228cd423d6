"""What the operators of this package share: words, the shared folder, folds."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as Java's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
#: The C library's way to return freed memory, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Odd multipliers of the multilinear hashes (drawn once, any odd numbers do).
ODD = np.random.default_rng(20).integers(0, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


#: Rows of an Arrow batch. Texts are long: with Spark's default of 10,000, batches alone would take an executor's memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS, if they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(data: bytes | None) -> list[bytes]:
    """The runs of bytes outside 0x20 and 0x09-0x0D; bytes.split() cuts at exactly those. None has none."""
    return data.split() if data else []


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), U64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on all of x."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def windows(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of all k consecutive items; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, ODD[(salt + 63 - k) % 64], U64)
    for j in range(k):
        out += h[j : j + n] * ODD[(salt + j) % 60]
    return mixed(out)


def binaries(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes, row by row."""
    return column.cast(pa.large_binary()).to_pylist()


def release() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which releases memory when a partition ends."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """True in the fold that no label is learnt from: crc32(doc_id as text) mod 5 is 0. A null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one of our own where that is unset and all runs in one process, as in tests.

    On a cluster an unset folder raises: each executor would write to its own disk.
    """
    set_to = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parcelry-"))
        set_to = spark.sparkContext.getCheckpointDir()
    return set_to


def kept(df: DataFrame, files: int | None = None) -> DataFrame:
    """df written to the shared folder and read back: later steps read files that outlive any executor.

    Without `files`, as many files as df's last stage has tasks, which adaptive execution fits to its size; with `files`,
    for small tables, that many at most.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/parcelry-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete what kept() wrote, once all that read it is kept itself. Only folders of kept() go."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.fullmatch(r"parcelry-[0-9a-f]{32}", folder.rsplit("/", 1)[1]):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucket_count(spark: SparkSession, per_partition: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * per_partition


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size; 0 where it has none (a source without statistics)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def buckets_for(df: DataFrame, bytes_each: int) -> int:
    """How many buckets to deal df's content into: they grow in number with the input, not in size."""
    return max(4 * bucket_count(df.sparkSession), -(-input_bytes(df) // bytes_each))


#: The key of a document among spans: its id, and a hash of its text in case that rows share an id.
KEY = ("doc_key", "text_key")


def keys(of: str = "") -> tuple[Column, Column]:
    """The columns of KEY. Of 64 bits, as one id, or null, may be that of millions of rows. of: "row." for what whole() packed."""
    return F.coalesce(F.col(f"{of}doc_id").cast("long"), F.lit(-(2**63)).cast("long")), F.xxhash64(f"{of}text")


def whole(docs: DataFrame) -> DataFrame:
    """docs as one column `row`, so that columns of ours can't meet one of the same name; select("row.*") unpacks it."""
    return docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_key, text_key, doc_id and text; a null doc_id sorts before all others."""
    return docs.select(*(c.alias(k) for c, k in zip(keys(), KEY, strict=True)), "doc_id", "text")


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as maximal, ascending, separate ones; intervals that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]
    return s[new], e[last]


def runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of an array that is True where a run begins (at 0 too): each run's first place, and the place after its last."""
    first = np.flatnonzero(breaks)
    return first, np.r_[first[1:], len(breaks)]


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int, seed: int) -> tuple[list[bytes], list[int]]:
    """Texts and labels outside the held-out fold, for the driver to learn from: the first `rows` labelled ids by a hash.

    Of these only as many as have most_bytes of text together (the first always). Ids that are labelled twice count
    once, with the larger label; of rows that share an id, the shortest text. Null labels and null texts are left out.
    Rows are chosen by their sizes before any text moves, so no task or driver gets more text than most_bytes.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    first = one.withColumn("rank", F.xxhash64(F.lit(seed), "doc_id")).orderBy("rank", "doc_id").limit(rows)
    own = docs.where("text is not null").select("doc_id", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("fp"))
    sizes = own.join(F.broadcast(first), "doc_id").groupBy("doc_id", "rank", "y").agg(F.min(F.struct("size", "fp")).alias("t")).select("doc_id", "rank", "y", "t.*").collect()
    take, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["rank"], r.doc_id)):
        total += r.size
        if not take or total <= most_bytes:
            take.append(r)
    if not take:
        return [], []
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = spark.createDataFrame([(r.doc_id, r.fp, i) for i, r in enumerate(take)], f"doc_id {kind}, fp long, nth int")
    got = own.join(F.broadcast(asked), ["doc_id", "fp"]).groupBy("nth").agg(F.min(F.col("text").cast("binary")).alias("text")).collect()
    text = {r.nth: bytes(r.text) for r in got}
    return [text[i] for i in range(len(take))], [r.y for r in take]
