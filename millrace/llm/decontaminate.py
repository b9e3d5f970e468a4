"""Benchmark passages in documents, copied with few edits.

Texts and items are lower-cased (A-Z) and their words joined by single spaces. A document has an item if the item is within
max_edit * length edits of some stretch of the text. For each class of item lengths, windows of that size begin at every
word of every text:

1. A window within k edits of an item shares at least length - 7 - 8 k of its 8-grams; windows with fewer hits in the items'
   8-grams (of a few classes together) cannot match and are passed over. This bound loses nothing.
2. The rest is embedded by CGK random walks, which turn edit distance into Hamming distance; several samples of a few
   positions from each of several embeddings are looked up among the items' own (REPEATS). Enough repetitions reach the
   target recall, 0.9.
3. Each (text, item) that meets in a table is verified by its exact edit distance (bit-parallel, semi-global).

Items so short that the bound says nothing are verified wherever one of edits + 1 pieces of them occurs, which loses nothing,
and need no spaces around them. Items go in blocks, each with its own tables, so any
number of items works.

Defined cases: null and empty texts have no passage; null and blank items are ignored. Repeated rows each get their rows;
null ids are allowed, and a null item id comes out as -1. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import mix, text_key, without, words_of, written

Q = 8
PAD = 64
BUCKETS = 22
#: Bytes of text that are scanned at once, and those whose hashes are made at once.
BLOCK, SLICE = 8 << 20, 1 << 19
FIELDS = "doc_id long, tkey long, item_id long, edits int, start int, end int"


def normal(text: str | None) -> bytes:
    return b" ".join(words_of(text))


def edit_match(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where the first such stretch ends (Myers 1999)."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of all 8-grams of a byte array."""
    words = np.ndarray((len(data) - Q + 1,), dtype="<u8", buffer=data.data, strides=(1,))
    return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS)).astype(np.int64)


#: Up to so many edits: walks, tables of each and sampled bits. More edits let embeddings drift further apart, so longer
#: items take more repetitions and then fewer bits; each row reaches a recall of 0.95 or more at the full number of edits.
REPEATS = [(20, 6, 6, 5), (40, 10, 10, 5), (math.inf, 10, 12, 3)]


class Index:
    """Tables of one block of items."""

    def __init__(self, items: list[tuple[int, bytes]], max_edit: float, seed: int) -> None:
        self.max_edit = max_edit
        self.items = items
        self.short = [k for k, (_, t) in enumerate(items) if self.need(len(t)) < 4]
        long = sorted((len(t), k) for k, (_, t) in enumerate(items) if self.need(len(t)) >= 4)
        self.classes = []
        self.mask = np.zeros(1 << BUCKETS, np.uint8)
        rng = np.random.default_rng(seed)
        while long:
            size = long[0][0]
            group = [k for n, k in long if n <= size * 1.12]
            long = long[len(group) :]
            bit = np.uint8(1 << len(self.classes) % 8)
            for k in group:
                self.mask[grams(np.frombuffer(items[k][1], np.uint8))] |= bit
            walks, tables, bits = next(r[1:] for r in REPEATS if self.edits(size) <= r[0])
            steps = 2 * size
            moves = rng.integers(0, 2, (walks, steps, 256), dtype=np.int8)
            picks = [[np.sort(rng.choice(steps, min(bits, steps), replace=False)) for _ in range(tables)] for _ in range(walks)]
            data = np.zeros(len(group) * size, np.uint8)
            for i, k in enumerate(group):
                data[i * size : (i + 1) * size] = np.frombuffer(items[k][1][:size], np.uint8)
            keys = self.keys(data, np.arange(len(group)) * size, size, moves, picks)
            order = [np.argsort(k) for k in keys]
            self.classes.append((size, np.array(group), moves, picks, [(k[o], o) for k, o in zip(keys, order, strict=True)]))

    def edits(self, n: int) -> int:
        return int(self.max_edit * n)

    def need(self, n: int) -> int:
        return n - Q + 1 - Q * self.edits(n)

    def keys(self, data: np.ndarray, starts: np.ndarray, size: int, moves: np.ndarray, picks: list) -> list[np.ndarray]:
        """For each table: the hash of the sampled symbols of each window's CGK embedding."""
        out = []
        for walk, chosen in zip(moves, picks, strict=True):
            where: dict[int, list[int]] = {}
            for t, positions in enumerate(chosen):
                for p in positions.tolist():
                    where.setdefault(p, []).append(t)
            keys = [np.full(len(starts), t + 1, np.uint64) for t in range(len(chosen))]
            at = starts.copy()
            end = starts + size
            last = len(data) - 1
            for j in range(len(walk)):
                c = data[np.minimum(at, last)]
                c[at >= end] = 0
                for t in where.get(j, ()):
                    keys[t] = (keys[t] ^ c) * np.uint64(0x100000001B3) + np.uint64(j)
                at += walk[j][c]
            out += [mix(k) for k in keys]
        return out

    def candidates(self, data: np.ndarray, masks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts and the items that they meet in some table; masks has the groups of classes of each 8-gram."""
        found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sums = np.zeros(len(masks) + 1, np.int32)
        for c, (size, group, moves, picks, tables) in sorted(enumerate(self.classes), key=lambda x: x[0] % 8):
            if c < 8:
                np.cumsum((masks >> np.uint8(c)) & np.uint8(1), out=sums[1:])
            longest = max(len(self.items[k][1]) for k in group)
            wide = longest + self.edits(longest) - Q + 1
            w = starts[sums[np.minimum(starts + wide, len(masks))] - sums[starts] >= min(self.need(len(self.items[k][1])) for k in group)]
            if not len(w):
                continue
            for key, (table, order) in zip(self.keys(data, w, size, moves, picks), tables, strict=True):
                lo, hi = np.searchsorted(table, key), np.searchsorted(table, key, side="right")
                n = hi - lo
                some = np.flatnonzero(n)
                for k in range(int(n.max())):
                    some = some[n[some] > k]
                    found_at.append(w[some])
                    found.append(group[order[lo[some] + k]])
        return np.concatenate(found_at), np.concatenate(found)


def short_match(item: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the nearest stretch within `most` edits. Of most + 1 pieces of the item one is in it unchanged."""
    m = len(item)
    if (p := text.find(item)) >= 0:
        return 0, p, p + m
    best = None
    cuts = [i * m // (most + 1) for i in range(most + 2)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True) if most else ():
        p = text.find(item[a:z])
        while p >= 0:
            lo = max(0, p - a - most)
            edits, end = edit_match(item, text[lo : p - a + m + most])
            if edits <= most and (best is None or edits < best[0]):
                back = edit_match(item[::-1], text[lo : lo + end][::-1])[1]
                best = edits, lo + end - back, lo + end
            p = text.find(item[a:z], p + 1)
    return best


def scan_block(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of all passages; start and end are byte offsets in the normal form."""
    begins = np.cumsum([0, *[len(t) + PAD for t in texts]])
    raw = (b"\0" * PAD).join(texts) + b"\0" * (PAD + 2048)
    data = np.frombuffer(raw, np.uint8)
    masks = np.zeros(len(data) - Q + 1, np.uint8)
    for a in range(0, len(masks), SLICE):
        masks[a : a + SLICE] = index.mask[grams(data[a : min(a + SLICE, len(masks)) + Q - 1])]
    starts = np.flatnonzero((data[:-2048] == 32) | (data[:-2048] == 0)) + 1
    starts = np.concatenate([[0], starts[data[starts] != 0]]) if texts else starts[:0]
    starts = starts[data[starts] > 32]
    at, item = index.candidates(data, masks, starts)
    rows = []
    if len(at):
        text = np.searchsorted(begins, at, side="right") - 1
        order = np.lexsort((at, item, text))
        at, item, text = at[order], item[order], text[order]
        # Neighbouring windows of one text that meet one item are one stretch.
        size = np.array([len(t) for _, t in index.items])
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > size[item[1:]])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        for a, z in zip(first, last, strict=True):
            pattern = index.items[item[a]][1]
            k = index.edits(len(pattern))
            base = int(begins[text[a]])
            lo, hi = max(0, int(at[a]) - base - k - 8), int(at[z]) - base + len(pattern) + k + 8
            part = texts[text[a]][lo:hi]
            edits, end = (0, p + len(pattern)) if (p := part.find(pattern)) >= 0 else edit_match(pattern, part)
            if edits <= k:
                back = edit_match(pattern[::-1], part[:end][::-1])[1] if edits else len(pattern)
                rows.append((int(text[a]), int(item[a]), edits, lo + end - back, lo + end))
    for k in index.short:
        pattern = index.items[k][1]
        most = index.edits(len(pattern))
        rows += [(i, k, *hit) for i, t in enumerate(texts) if (hit := short_match(pattern, t, most))]
    return rows


def find_passages(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = 32 << 20, **params) -> DataFrame:
    """Rows (doc_id, tkey, item_id, edits, start, end), one for each text and item that it has, at its nearest stretch.

    Items go to the workers at most about item_bytes at a time; more of them are found in several passes over docs.
    """
    known = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    passes = -(-(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes) or 1
    share = F.pmod(F.xxhash64("text"), F.lit(passes))
    found = [_one_pass(docs, known.where(share == k), id_col, text_col, **params) for k in range(passes)]
    return reduce(DataFrame.union, found)


def _one_pass(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, max_edit: float = 0.08, block_items: int = 2_000, seed: int = 11) -> DataFrame:
    known = sorted({(-1 if i is None else i, t) for i, t in ((r[0], normal(r[1])) for r in items.toLocalIterator()) if t})
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        indexes = [Index(known[i : i + block_items], max_edit, seed) for i in range(0, len(known), block_items)]
        for b in batches:
            ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            best: dict[tuple[int, int], tuple] = {}
            held: list[bytes] = []
            size = base = 0

            def flush(base: int, held: list[bytes], best: dict = best) -> None:
                for index in indexes:
                    for text, item, edits, start, end in scan_block(index, held):
                        key = (base + text, index.items[item][0])
                        best[key] = min(best.get(key, (1 << 30,)), (edits, start, end))

            for k, text in enumerate(b.column(2)):
                t = normal(text.as_py())
                held.append(t)
                size += len(t)
                if size > BLOCK:
                    flush(base, held)
                    held, size, base = [], 0, k + 1
            if held:
                flush(base, held)
            if best:
                rows = [(ids[k], keys[k], item, *v) for (k, item), v in sorted(best.items())]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.int32()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "tkey", "item_id", "edits", "start", "end"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, FIELDS)


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs without those that have a passage of any item."""
    found = written(find_passages(docs, items, id_col=id_col, text_col=text_col, **params).select("doc_id", "tkey").distinct(), "passages")
    return without(docs, found, id_col, text_key(F.col(text_col)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("tkey")
