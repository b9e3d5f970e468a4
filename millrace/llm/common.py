"""Pieces shared by the training-data operators: words, folds, scratch tables, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of [\x20\x09-\x0D], which separate words.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A side with at most this many small rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.lower() touches A-Z alone and bytes.split() cuts at just those six characters."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes] | np.ndarray) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def give_back() -> None:
    """Returns freed memory to the system, which allocators else keep for a worker's whole life."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts_word_hashes(texts: pa.Array, lower: bool = True, at_once: int = 4 << 20) -> Iterator[np.ndarray]:
    """For each text what word_hashes(words_of(text, lower)) gives; about at_once bytes of text are split at a time, and
    each distinct word among them is hashed once."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(sizes, np.arange(at_once, sizes[-1], at_once)), [len(texts)]])) if len(texts) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = texts[lo:hi].fill_null("")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(part) if lower else part)
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        coded = flat.filter(pa.array(full)).dictionary_encode()
        hashes = word_hashes(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        del part, lists, flat, full, coded
        for a, z in zip([0, *ends[:-1]], ends, strict=True):
            yield hashes[a:z]
        del hashes
        give_back()


def sorted_distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and how often each occurs; much quicker than np.unique."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` words; with fewer words the whole sequence is one window."""
    n = len(h)
    if n == 0:
        return h
    k = min(width, n)
    out = h[: n - k + 1].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : n - k + 1 + j]
    return mix(out + np.uint64(k))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain lower() where the text is ASCII, which is quicker."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fold(doc_id: Column, of: int) -> Column:
    """True where crc32(doc_id as text) mod `of` is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors. It is deleted when the session's JVM ends."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    schema = df.schema
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    return out


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Within it, Python workers get at most about so many bytes of rows at a time, however long the texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def discard(df: DataFrame) -> None:
    """Deletes a table that written() made, once what is built on it has been written itself."""
    fs, where = _file_system(df.sparkSession, df._scratch)
    fs.delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of plans that nothing refers to any more; else they stay until a collection happens."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a stored table, as Spark's statistics have them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast behind a check of rows and stored bytes; beyond either Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit and stored_bytes(df) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't: the given one, with underscores before it while it clashes (case ignored)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, gone: DataFrame, id_col: str, key: Column) -> DataFrame:
    """docs without the rows whose (id, key) is in gone (doc_id, tkey), a stored table; null ids match null ids."""
    i, t = fresh(docs, "i"), fresh(docs, "t")
    gone = gone.select(F.col("doc_id").alias(i), F.col("tkey").alias(t))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (key == F.col(t))
    return docs.join(maybe_broadcast(gone, gone.count()), same, "left_anti")


def text_key(text: Column) -> Column:
    """A 64-bit hash that, beside the id, names a text; null and empty texts are one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _few_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, label) of all the edges (u, v) of one task: labels hook onto lesser ones and take their labels' labels."""
    both = [b for b in batches if b.num_rows]
    if not both:
        return
    u, v = (np.concatenate([b.column(i).to_numpy() for b in both]) for i in (0, 1))
    nodes = sorted_distinct(np.concatenate([u, v]))[0]
    u, v = np.searchsorted(nodes, u), np.searchsorted(nodes, v)
    label = np.arange(len(nodes))
    while (differ := label[u] != label[v]).any():
        high, low = np.maximum(label[u], label[v])[differ], np.minimum(label[u], label[v])[differ]
        np.minimum.at(label, high, low)
        while (up := label[label])[label != up].size:
            label = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def components(links: DataFrame, tag: str = "cc", most_rounds: int = 60, in_one: int = 1 << 20) -> DataFrame:
    """Connected components of links (a, b): rows (node, label), label the least node that can be reached.

    At most in_one links (16 bytes each) are a single task's work. More take large-star and small-star steps in turn, each a
    shuffle on nodes; rounds grow with the logarithm of a component's width, and components that do not settle in
    most_rounds raise. Self links and repeated links change nothing; no links, no rows.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), tag)
    if edges.count() <= in_one:
        return edges.coalesce(1).mapInArrow(_few_components, "node long, label long")
    last = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, written(small, tag)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
