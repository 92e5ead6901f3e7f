"""Shared pieces: tables written to the shared folder, word splitting and hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Entries a worker's word cache may hold.
CACHE = 1 << 19
#: Spark removes a query's shuffle files at its end; a written table doesn't need them any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and executors are threads of the driver, as in tests, a temporary one is set."""
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codelake-")
        spark.conf.set(key, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """``df`` written to the shared folder, in at most ``parts`` files, and read again: later steps start from files that outlive executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the two columns, whatever else the table has; the text as string."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of words, computed once for each word while the bounded cache holds it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split() cuts at exactly the white space of the word rule."""
    return text.lower().split() if text else []


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of the whole, where there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        odd = np.uint64(((0x9E3779B97F4A7C15 * (2 * i + 3)) | 1) & M64)
        total = mix(total * np.uint64(0xD1342543DE82EF95) + hashes[i : n - width + 1 + i] * odd)
    return np.unique(total)
