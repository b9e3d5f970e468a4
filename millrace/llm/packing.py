"""Length buckets of least padding, and batches of a token budget inside each.

The histogram of lengths over all documents goes to the driver (lengths beyond `exact` are rounded up by at most 0.1 %, so
it has a bounded number of entries). Dynamic programming over it finds the `buckets` boundaries for which the padding, the
sum of boundary minus length, is least: cost of a bucket is a line in its boundary, so each layer takes one pass of the
convex hull trick. Documents are put in order of (length, id) by range, numbered by partition offsets, and each bucket's
documents fill batches of floor(budget / boundary) rows, at least one.

Defined cases: a null or empty text has 0 tokens and goes into the bucket of least boundary. Ties in length go by id, then by
text hash; null ids come first. Repeated rows are packed each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import written


def token_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rounded(n: Column, exact: int) -> Column:
    """Lengths over `exact` go up to a multiple of 2 ** (floor(log2 n) - 10)."""
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(F.greatest(n, F.lit(1)))) - 10)).cast("long")
    return F.when(n <= exact, n).otherwise(F.ceil(n / unit).cast("long") * unit)


def best_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper boundaries, least padding; histogram has (length, documents), lengths ascending."""
    n = len(histogram)
    if n <= buckets:
        return [length for length, _ in histogram]
    count, total = [0] * (n + 1), [0] * (n + 1)
    for i, (length, c) in enumerate(histogram):
        count[i + 1] = count[i] + c
        total[i + 1] = total[i] + length * c
    prev = [0] + [None] * n
    back: list[list[int]] = []
    for _ in range(buckets):
        now: list[int | None] = [None] * (n + 1)
        choice = [0] * (n + 1)
        hull: deque[tuple[int, int, int]] = deque()  # slope, intercept, i; slopes fall, queries rise
        for j in range(1, n + 1):
            i = j - 1
            if prev[i] is not None:
                line = (-count[i], prev[i] + total[i], i)
                while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - line[0]) >= (line[1] - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append(line)
            x = histogram[j - 1][0]
            while len(hull) >= 2 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            if hull:
                now[j] = hull[0][0] * x + hull[0][1] + x * count[j] - total[j]
                choice[j] = hull[0][2]
        back.append(choice)
        prev = now
    out, j = [], n
    for choice in reversed(back):
        out.append(histogram[j - 1][0])
        j = choice[j]
        if not j:
            break
    return sorted(out)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), buckets: int = 16, budget: int = 65_536, exact: int = 32_768) -> DataFrame:
    """Per row: doc_id, n_tokens, bucket, boundary (padded length), batch (number within the bucket), slot (row of the batch).

    carry: columns of docs, such as the text, that come along behind these; one of the names above can't be carried.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    own = [F.col(id_col).cast("long").alias("doc_id"), token_count(text).alias("n_tokens"), F.xxhash64(text).alias("tkey")]
    held = [f"c{k}" for k in range(len(carry))]
    rows = docs.select(*own, *[F.col(c).alias(k) for c, k in zip(carry, held, strict=True)]).withColumn("size", rounded(F.col("n_tokens"), exact))
    if not carry:
        rows = written(rows, "sizes")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["size", "n_tokens", "doc_id", "tkey"]
    ordered = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*order, *held, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "ordered")
    histogram = [tuple(r) for r in ordered.groupBy("size").count().orderBy("size").collect()]
    bounds = best_boundaries(histogram, buckets)
    bucket = F.lit(max(len(bounds) - 1, 0))
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("size") <= bounds[k], k).otherwise(bucket)
    # A partition is a stretch of the order: its first row's rank is what lies in partitions before it.
    starts, seen = [], 0
    for r in ordered.groupBy("p").agg(F.max("i").alias("n")).orderBy("p").collect():
        starts.append((r["p"], seen))
        seen += r["n"] + 1
    first, seen, low = [], 0, -1
    for b in bounds:
        first.append(seen)
        seen += sum(c for size, c in histogram if low < size <= b)
        low = b
    # One row a partition: as many as there are shuffle partitions.
    begins = F.broadcast(spark.createDataFrame(starts, "p int, begin long"))
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in (xs or [0])])
    out = ordered.join(begins, "p").withColumn("bucket", bucket.cast("int")).withColumn("boundary", F.get(array(bounds), F.col("bucket")))
    out = out.withColumn("at", F.col("begin") + F.col("i") - F.get(array(first), F.col("bucket"))).withColumn("rows", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1)))).cast("long"))
    mine = [F.floor(F.col("at") / F.col("rows")).cast("long").alias("batch"), (F.col("at") % F.col("rows")).cast("long").alias("slot")]
    return out.select("doc_id", "n_tokens", "bucket", "boundary", *mine, *[F.col(k).alias(c) for c, k in zip(carry, held, strict=True)])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
