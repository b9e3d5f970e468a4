"""Quality by compression: a Zstandard dictionary of good text and one of bad text; the one that compresses a text better.

Dictionaries are trained on a bounded sample of labelled rows outside the held-out fold. Every whole text is compressed with
either one. The only input of the score is their normalised difference, (size with the bad dictionary - size with the good
one) / (bytes of the text + 60). It is calibrated on other labelled rows, also outside the held-out fold: a monotone
(isotonic) curve from the difference to the share of good rows, with a small part of a logistic curve so that it rises strictly.

The sample has at most `per_class` rows a label for the dictionaries and `calibrate` for the curve, those with the least
hashes, whole texts of at most `class_bytes` / 16 bytes, `class_bytes` in all for each label and use; sizes are looked at
before any text goes to the driver.

Defined cases: null and empty texts are compressed as empty texts. With one label only, or none, every score is that
label's share (0.5 without labels). Of rows that share a labelled id the shortest text is learned from. Repeated rows get
equal scores; null ids and other columns are never looked at. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, fold, written


def _dictionary(texts: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, texts, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


class Sizes:
    """Compressed sizes of a text under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int) -> None:
        self.packers = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        raw = (text or "").encode("utf-8", "surrogatepass")
        good, bad = (len(p.compress(raw)) for p in self.packers)
        return (bad - good) / (len(raw) + 60)


class Curve:
    """From a difference to the probability of a good label."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float) -> None:
        """x, y: differences and labels (0 or 1) of the calibration rows; prior: share of good rows among all labelled ones,
        to which the rows are weighted."""
        share = y.mean()
        weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []  # weight, weighted good, weighted x; neighbours that fall are pooled
        for i in order:
            blocks.append([weight[i], weight[i] * y[i], weight[i] * x[i]])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                top = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
        b = np.array(blocks)
        self.at = b[:, 2] / b[:, 0]
        self.share = (b[:, 1] + 0.02) / (b[:, 0] + 0.04)
        self.share = np.maximum.accumulate(self.share)
        self.mid, self.scale = float(np.average(x, weights=weight)), max(float(x.std()), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        steady = np.interp(x, self.at, self.share)
        return 0.98 * steady + 0.02 / (1 + np.exp(-np.clip((x - self.mid) / self.scale, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, calibrate: int, class_bytes: int) -> tuple[dict, dict, dict]:
    """Texts for the dictionaries and for the curve, by label, and the number of labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q")).where("q in (0, 1) and doc_id is not null").where(~fold(F.col("doc_id"), 5)).distinct()
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int")
    order = F.xxhash64("doc_id")
    picked = None
    for q in (0, 1):
        for use, most in ((0, per_class), (1, calibrate)):
            one = known.where((F.col("q") == q) & (half == use)).orderBy(order, "doc_id").limit(most).select("doc_id", "q", F.lit(use).alias("use"))
            picked = one if picked is None else picked.union(one)
    texts = docs.where(F.octet_length("text") <= class_bytes // 16)
    # At most per_class + calibrate rows a label, one text each.
    rows = written(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "q", "use").agg(F.min(F.struct(F.octet_length("text").alias("size"), "text")).alias("x")).select("doc_id", "q", "use", "x.size", "x.text"), "labelled")
    room = {(q, use): class_bytes for q in (0, 1) for use in (0, 1)}
    chosen = []
    for r in rows.orderBy(order, "doc_id", "q").select("doc_id", "q", "use", "size").collect():
        room[r.q, r.use] -= r.size
        if room[r.q, r.use] >= 0:
            chosen.append((r.doc_id, r.q))
    out: dict[int, dict[int, list[bytes]]] = {0: {0: [], 1: []}, 1: {0: [], 1: []}}
    if chosen:
        small = docs.sparkSession.createDataFrame(chosen, "doc_id long, q int")
        for r in rows.join(F.broadcast(small), ["doc_id", "q"], "left_semi").orderBy(order, "doc_id", "q").collect():
            out[r.use][r.q].append(r.text.encode("utf-8", "surrogatepass"))
    discard(rows)
    return out[0], out[1], {int(r.q): r["count"] for r in known.groupBy("q").count().collect()}


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1_500, calibrate: int = 1_500, class_bytes: int = 4 << 20, dict_bytes: int = 262_144, level: int = 3, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels has doc_id and quality (0 or 1, else ignored)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts, rest, n = _sample(docs, labels, per_class, calibrate, class_bytes)
    share = n.get(1, 0) / sum(n.values()) if n else 0.5
    curve, good, bad = None, b"", b""
    if all(parts[q] and rest[q] for q in (0, 1)):
        good, bad = (_dictionary(parts[q], dict_bytes) for q in (1, 0))
        sizes = Sizes(good, bad, level)
        x = np.array([sizes.difference(t.decode("utf-8", "surrogatepass")) for q in (0, 1) for t in rest[q]])
        curve = Curve(x, np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])]), share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad, level) if curve is not None else None
        for b in batches:
            score = curve.score(np.array([sizes.difference(t.as_py()) for t in b.column(2)])) if sizes and b.num_rows else np.full(b.num_rows, share)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", fold(F.col("doc_id"), 5).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
