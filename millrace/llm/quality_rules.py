"""Rule statistics of whole texts, and an isolation forest over them.

One pass over the texts gives counts; the forest and its threshold work on the small table of counts. Each of `trees` trees
is grown by random splits on `size` rows of its own, drawn by hash from all rows that pass the base rules; a document's path
lengths over all trees give its anomaly score. The threshold comes from the scores of all labelled rows outside the held-out
fold: of those that reject at most `max_good_loss` of the rows labelled good, the one where the share of bad rows rejected
exceeds that of good rows most.

The forest sees plain ratios, each smoothed by `SMOOTH` words of ordinary text so that a short text's chance values are no
anomaly. No ratio is clipped and none has a limit of its own.

Defined cases: a null or empty text has no words and fails the base rules. Without labels of both kinds nothing but the base
rules rejects. Repeated rows get equal verdicts and are drawn once; null ids are allowed; other columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, fold, sorted_distinct, text_key, texts_word_hashes, windows_hash, word_hashes, words_of, written

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_stutters"]
_WS = list(SPACES.encode())
_SYM = list(SYMBOLS)


def text_counts(text: str | None, hashes: np.ndarray | None = None) -> tuple[int, ...]:
    """COUNTS, then MORE, of a whole text; hashes: those of its words, if they are known."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    hashes = word_hashes(words_of(text, lower=False)) if hashes is None else hashes
    n = len(hashes)
    repeated = 0
    if n > 5:
        w = windows_hash(hashes, 5)
        order = np.argsort(w)
        same = w[order][1:] == w[order][:-1]
        if same.any():
            mark = np.zeros(n + 1, np.int32)
            twice = sorted_distinct(np.concatenate([order[1:][same], order[:-1][same]]))[0]
            mark[twice] += 1
            mark[twice + 5] -= 1
            repeated = int((np.cumsum(mark) > 0).sum())
    lines = text.split("\n")
    full = [x for x in lines if x.strip(SPACES)]
    return (n, len(text) - int(hist[_WS].sum()), int(hist[_SYM].sum()), len(full) - len(set(full)), repeated, len(lines), int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[48:58].sum()), int(hist[33:48].sum() + hist[58:65].sum()), int((hashes[1:] == hashes[:-1]).sum()))


def rule_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tkey = xxhash64(text) and the counts of every row."""
    names = COUNTS + MORE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.array([text_counts(t.as_py(), h) for t, h in zip(b.column(2), texts_word_hashes(b.column(2), lower=False), strict=True)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c) for c in np.ascontiguousarray(counts.T)]], ["doc_id", "tkey", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tkey long, " + ", ".join(f"{c} long" for c in names))


def base_failed(min_words: int = 10, percent: int = 20):
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * percent)


#: Words of ordinary text (5.5 characters each) added to every document's ratios.
SMOOTH = 10.0


def features(t: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios a word, a letter or a line; none of them grows with the length of a text."""
    words, letters = t["n_words"] + SMOOTH, t["n_upper"] + t["n_lower"] + 5 * SMOOTH
    each = [t[k] / words for k in ("n_symbols", "n_stutters", "n_repeat_words", "n_digits", "n_marks")]
    return np.stack([*each, t["n_upper"] / letters, t["n_dup_lines"] / (t["n_lines"] + SMOOTH / 2), (t["word_chars"] + 5.5 * SMOOTH) / words], 1)


def _depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A tree over the rows of x, as arrays (feature or -1, cut, left child, path length at a leaf)."""
    limit = int(np.ceil(np.log2(max(len(x), 2)))) + 2
    nodes: list[list[float]] = [[-1, 0, 0, 0]]
    todo = [(np.arange(len(x)), 0, 0)]
    while todo:
        rows, depth, at = todo.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(high > low)
        if len(rows) <= 1 or depth >= limit or not len(open_):
            nodes[at] = [-1, 0, 0, depth + _depth(len(rows))]
            continue
        f = int(rng.choice(open_))
        cut = float(high[f] - rng.uniform(0, 1) * (high[f] - low[f]))  # above low, so that neither side is empty
        cut = cut if cut > low[f] else float(high[f])
        nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
        nodes[at] = [f, cut, len(nodes) - 2, 0]
        side = x[rows, f] < cut
        todo += [(rows[side], depth + 1, len(nodes) - 2), (rows[~side], depth + 1, len(nodes) - 1)]
    a = np.array(nodes)
    return a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3]


def grow_forest(x: np.ndarray, trees: int, size: int, seed: int) -> tuple[list[tuple[np.ndarray, ...]], int]:
    """The trees, each from `size` rows that no other tree has while there are enough; and the rows a tree."""
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    order = np.concatenate([rng.permutation(len(x)) for _ in range(-(-trees * size // max(len(x), 1)))]) if size else np.zeros(0, int)
    return [grow_tree(x[order[k * size : (k + 1) * size]], rng) for k in range(trees)] if size else [], size


def anomaly(forest: list[tuple[np.ndarray, ...]], x: np.ndarray, size: int) -> np.ndarray:
    """2 ** -(mean path length / expected length): higher is more anomalous."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, cut, left, depth in forest:
        at = np.zeros(len(x), np.int32)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            at = np.where(inner, left[at] + (x[rows, np.maximum(f, 0)] >= cut[at]), at)
        total += depth[at]
    return 2.0 ** -(total / len(forest) / max(_depth(size), 1e-9))


def best_limit(seen: list[tuple[int, int, int]], max_good_loss: float) -> int | None:
    """From (bin, label, rows): the bin from which rows are rejected, None to reject nothing. Ties go to the higher bin."""
    total = {q: sum(n for _, k, n in seen if k == q) for q in (0, 1)}
    if not all(total.values()):
        return None
    lost = {0: 0, 1: 0}
    best, edge = 0.0, None
    for b in sorted({b for b, _, _ in seen}, reverse=True):
        for k, q, n in seen:
            lost[q] += n if k == b else 0
        good, bad = lost[1] / total[1], lost[0] / total[0]
        if good > max_good_loss:
            break
        if bad - good > best:
            best, edge = bad - good, b
    return edge


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trees: int = 100, size: int = 256, max_good_loss: float = 0.01, seed: int = 7, bins: int = 2_000) -> DataFrame:
    """doc_id, tkey, the counts, base_failed, anomaly and kept of every row."""
    stats = written(rule_statistics(docs, id_col=id_col, text_col=text_col), "stats").withColumn("base_failed", base_failed())
    names = COUNTS + MORE
    passed = stats.where("not base_failed")
    wide = 2.0**62 * min(1.0, 1.5 * trees * size / max(passed.count(), 1))
    drawn = passed.withColumn("o", F.xxhash64("doc_id", "tkey", F.lit(seed))).where(F.abs(F.col("o") / 2) <= wide).groupBy("o").agg(F.first(F.struct(*names)).alias("x"))
    rows = drawn.orderBy("o").limit(trees * size).select("x.*").toArrow()
    x = features({c: rows.column(c).to_numpy() for c in names})
    forest, held = grow_forest(x, trees, size, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = {c: b.column(b.schema.get_field_index(c)).to_numpy() for c in names}
            score = anomaly(forest, features(t), held) if forest else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "anomaly"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", anomaly double"
    scored = stats.mapInArrow(run, schema)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q")).where("q in (0, 1)").where(~fold(F.col("doc_id"), 5))
    seen = scored.where("not base_failed").join(known, "doc_id").groupBy(F.floor(F.col("anomaly") * bins).alias("bin"), "q").count().collect()
    edge = best_limit([(r["bin"], r["q"], r["count"]) for r in seen], max_good_loss)
    limit = edge / bins if edge is not None else 2.0
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
