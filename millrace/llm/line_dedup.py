"""Line deduplication with SQL functions only.

Every line becomes a 128-bit hash of its key; text is not shuffled to decide. Rows (hash, document, position) are dealt by
range of (hash, document), so that a line in a third of all documents lies across many tasks, and sorted by position
within. A window that streams over that order, without a shuffle or sort of its own, marks each document's first occurrence
of a line; first occurrences are summed per hash before the second shuffle. What comes back per document is a keep bitmap
compressed into run containers: a binary with eight bytes for each run of zeros (dropped lines), its start and its length as
big-endian 32-bit numbers, in order.

Defined cases: a null or empty text is one empty line. The empty key is never dropped while min_chars >= 1. Rows with equal
id and text count as one document and get the same bitmap; equal ids with other texts are other documents; null ids are
allowed. Other columns are ignored, but columns of docs that have the names of the two counts give way to them. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, ascii_lower, fresh, maybe_broadcast, text_key, written


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def packed(runs: Column) -> Column:
    """Runs (start, len) as a bitmap of run containers."""
    word = lambda n: F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.array_join(F.transform(runs, lambda r: F.concat(word(r["start"]), word(r["len"]))), ""))


def unpacked(bitmap: Column) -> Column:
    """The runs (start, len) of a bitmap."""
    word = lambda x, at: F.conv(F.substring(x, at, 8), 16, 10).cast("int")
    return F.transform(F.regexp_extract_all(F.hex(bitmap), F.lit(".{16}"), F.lit(0)), lambda x: F.struct(word(x, 1).alias("start"), word(x, 9).alias("len")))


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Rows (doc_id, tkey, bitmap) for the documents that lose lines; tkey = text_key(text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tkey", text_key(F.col("text")))
    lines = texts.select("doc_id", "tkey", F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "tkey", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "tkey", "pos")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = hashed.repartitionByRange(n, "h1", "h2", "doc_id", "tkey").sortWithinPartitions("h1", "h2", "doc_id", "tkey", "pos")
    before = F.lag(F.lit(True)).over(W.partitionBy("h1", "h2", "doc_id", "tkey").orderBy("pos"))
    dealt = written(ordered.withColumn("first", before.isNull()), "lines")
    often = written(dealt.where("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"), "often")
    lost = dealt.join(maybe_broadcast(often, often.count()), ["h1", "h2"], "left_semi").select("doc_id", "tkey", "pos")
    # Rows that repeat a document give its positions once, before the shuffle already.
    found = lost.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    return found.select("doc_id", "tkey", F.get(F.transform(F.array("at"), lambda at: packed(runs_of(at))), 0).alias("bitmap"))


def runs_of(at: Column) -> Column:
    """The runs (start, len) of positions in order."""
    starts = F.filter(at, lambda x, i: F.coalesce(F.get(at, i - 1) != x - 1, F.lit(True)))
    ends = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) != x + 1, F.lit(True)))
    return F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("start"), (z - a + 1).alias("len")))


def kept_lines(text: Column, dropped: Column) -> Column:
    """The text without its dropped runs, one stretch of kept lines after another."""
    lines = F.split(text, "\n")
    froms = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda r: r["start"] + r["len"]))
    tos = F.concat(F.transform(dropped, lambda r: r["start"]), F.array(F.size(lines)))
    bound = F.array(F.struct(lines.alias("lines"), F.arrays_zip(froms.alias("a"), tos.alias("b")).alias("kept")))
    # Bound to a lambda variable, so that the lines are split once a text and not once a stretch.
    return F.get(F.transform(bound, lambda x: F.array_join(F.flatten(F.transform(x["kept"], lambda k: F.slice(x["lines"], k["a"] + 1, k["b"] - k["a"]))), "\n")), 0)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, lines_as: str = "n_lines", dropped_as: str = "n_dropped") -> DataFrame:
    """Every row of docs with its columns, the text without its repeated lines, and two counts, lines_as and dropped_as."""
    i, t, m = (fresh(docs, c) for c in "itm")
    bitmaps = written(keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_chars=min_chars), "bitmaps")
    side = maybe_broadcast(bitmaps, bitmaps.count(), 200_000).select(F.col("doc_id").alias(i), F.col("tkey").alias(t), F.col("bitmap").alias(m))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.join(side, (text_key(F.col(text_col)) == F.col(t)) & F.col(id_col).cast("long").eqNullSafe(F.col(i)), "left")
    gone = F.aggregate(unpacked(F.col(m)), F.lit(0), lambda s, r: s + r["len"])
    kept = [c for c in docs.columns if c.lower() not in (text_col.lower(), lines_as.lower(), dropped_as.lower())]
    short = F.get(F.transform(F.array(unpacked(F.col(m))), lambda dropped: kept_lines(text, dropped)), 0)
    return joined.select(*kept, F.when(F.col(m).isNull(), text).otherwise(short).alias(text_col), F.size(F.split(text, "\n")).cast("long").alias(lines_as), F.coalesce(gone, F.lit(0)).cast("long").alias(dropped_as))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY k.doc_id
"""
