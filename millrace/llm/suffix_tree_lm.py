"""Language model scores from a probabilistic suffix tree over the characters of words.

Symbols are characters; a word's end is a symbol, and so is the text's end. What precedes a symbol is its history: the last
`depth` symbols of its word, word start included, and for the first `REACH` symbols of a word also the last `REACH`
characters of the word before. A context is a suffix of a history. Training needs two kinds of keys alone, the distinct words
(for the symbols behind the first REACH) and the distinct joints (end of a word, first REACH symbols of the next; a text's
first word has a joint with nothing before it), each with counts that combine before they shuffle.

A context is retained if it occurs `least` times in training and its next-symbol distribution diverges from what shorter
retained contexts say (count times Kullback-Leibler divergence above `gain` nats for each symbol seen in it). Its
distribution is smoothed towards theirs with weight T / (n + T), T the distinct symbols seen (Witten and Bell), and the
root's towards all code points evenly. Each symbol is scored in its longest retained context.

The tree is never in one place, and it grows with the corpus: no bound but `least` limits it. Distinct keys are written in
blocks. A block's distinct pairs of history and symbol, those of held-out texts alone with count 0, are dealt by the last two
symbols of their histories and one of `SUBS` classes of the third, so that all contexts of three symbols and more that a
symbol needs lie in one task with it; the probabilities from contexts of none, one and two symbols are sent to the tasks that
need them. A task sorts its histories, in which every context is a stretch, and prices each pair. Prices go back to the
block, which sums them per key. What is dealt and what comes back is packed by columns, a row for each block and task.

Keys that hold at least 1 / `share` of all words or joints are at most `share` each; their hashes and prices, 25 bytes each,
are broadcast. All others are joined by hash, after each text has counted its own. Keys are named by 64-bit hashes.

The base score is the add-0.1 unigram score of the contract.

Defined cases: null and empty texts have one token, the end. Repeated rows are scored each; null ids count as training
rows. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, fold, mix, release, sorted_distinct, written

START, END = 0x110000, 0x110001
CODE_POINTS = 0x110002
#: Symbols on either side of a joint.
REACH = 3
#: The longest history that three 63-bit numbers hold, and the bits of a symbol.
LONGEST, WIDTH = 8, 21
#: Bytes of words in a block, words of texts that are worked on at once, and edges that are priced at once.
BLOCK, WORDS, SYMBOLS = 1_000_000, 800_000, 4_000_000
#: Bytes of words whose edges are dealt to a task, and classes of the third symbol of a history.
DEALT, SUBS = 1_000_000, 16


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words, START before and END after each; each symbol's distance from its word's START; and its word."""
    plain = [w.decode("utf-8", "surrogatepass") for w in words]
    codes = np.frombuffer((" " + "  ".join(plain) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, plain), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    codes[starts] = START
    codes[ends - 1] = END
    return codes, np.arange(len(codes)) - np.repeat(starts, sizes), np.repeat(np.arange(len(words)), sizes)


def _joint_symbols(joints: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all joints, each one's place behind START (0 or less before it), its index in the joint, and its joint."""
    parts = [j.decode("utf-8", "surrogatepass") for j in joints]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts)), sizes)
    index = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mid = np.repeat(np.fromiter((p.index(" ") for p in parts), np.int64, len(parts)), sizes)
    codes[index == mid] = START
    codes[codes == 10] = END
    return codes, index - mid, index, owner


def symbols_of(keys: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of words, then of joints: each scored symbol's key (index in keys), the symbol, and its history, nearest first [depth,
    symbols], 0 where it has ended and else the symbol's code plus 1."""
    is_joint = np.fromiter((b" " in k for k in keys), bool, len(keys))
    for joints in (False, True):
        own = np.flatnonzero(is_joint == joints)
        if not len(own):
            continue
        if joints:
            codes, place, reach, owner = _joint_symbols([keys[i] for i in own])
            at = np.flatnonzero(place > 0)
        else:
            codes, reach, owner = _flat([keys[i] for i in own])
            at = np.flatnonzero(reach > REACH)
        back = [np.where(reach[at] >= j, codes[np.maximum(at - j, 0)] + 1, 0) for j in range(1, depth + 1)]
        yield own[owner[at]], codes[at], np.array(back, np.int64).reshape(depth, len(at))


class Texts:
    """The words of some texts and the joints between them, by number, with a hash for each."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        flat = lists.flatten()
        text = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        full = pc.greater(pc.binary_length(flat), 0)
        if not pc.all(full, min_count=0).as_py():
            flat, text = flat.filter(full), text[full.to_numpy(zero_copy_only=False)]
        self.sizes = np.bincount(text, minlength=len(texts))
        self.text = text
        coded = flat.dictionary_encode()
        self.words = coded.dictionary
        codes = self.codes = coded.indices.to_numpy().astype(np.int64)
        self.hashes = key_hashes(self.words)
        tails = pc.utf8_slice_codeunits(self.words, -REACH).dictionary_encode()
        heads = pc.utf8_slice_codeunits(pc.binary_join_element_wise(self.words, "\n", ""), 0, REACH).dictionary_encode()
        # The last tail is that of no word.
        self.tails, self.heads = pa.concat_arrays([tails.dictionary, pa.array([""], tails.dictionary.type)]), heads.dictionary
        before = np.full(len(codes), len(self.tails) - 1, np.int64)
        inner = np.flatnonzero(text[1:] == text[:-1])
        before[inner + 1] = tails.indices.to_numpy()[codes[inner]]
        self.pairs = before << 32 | heads.indices.to_numpy()[codes]

    def joints(self, pairs: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(self.tails.take(pa.array(pairs >> 32)), self.heads.take(pa.array(pairs & 0xFFFFFFFF)), " ")

    def joint_hashes(self, pairs: np.ndarray) -> np.ndarray:
        tails, heads = key_hashes(self.tails).view(np.uint64), key_hashes(self.heads).view(np.uint64)
        return mix(tails[pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + heads[pairs & 0xFFFFFFFF]).view(np.int64)


def key_hashes(keys: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(keys)).view(np.int64)


def in_parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts with about WORDS words each."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False) // 6 + 1)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(sizes, np.arange(WORDS, sizes[-1], WORDS)), [len(texts)]])) if len(texts) else [0]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def word_counts(docs: DataFrame, held_out: int) -> DataFrame:
    """h (hash), word, c (occurrences in training rows) and a (in all rows). The word '' stands for the texts' ends; a word with
    a space is a joint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h: np.ndarray, words: pa.Array, n: np.ndarray, trained: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h), words.cast(pa.binary()), pa.array(n if trained else np.zeros(len(n), np.int64)), pa.array(n)], ["h", "word", "c", "a"])

        for b in batches:
            texts = b.column(1)
            outs = np.array(b.column(0).to_pylist(), bool)
            for lo, hi in in_parts(texts):
                t = Texts(texts[lo:hi])
                for trained, mine in ((True, ~outs[lo:hi]), (False, outs[lo:hi])):
                    here = mine[t.text]
                    n = np.bincount(t.codes[here], minlength=len(t.words))
                    some = np.flatnonzero(n)
                    yield out(t.hashes[some], t.words.take(pa.array(some)), n[some], trained)
                    pairs, n = sorted_distinct(t.pairs[here])
                    yield out(t.joint_hashes(pairs), t.joints(pairs), n, trained)
                    yield out(np.zeros(1, np.int64), pa.array([""]), np.array([mine.sum()], np.int64), trained)

    rows = docs.select(fold(F.col("doc_id"), held_out).alias("h"), "text").mapInArrow(run, "h long, word binary, c long, a long")
    return rows.groupBy("h", "word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, bytes of equal weight side by side, compressed."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True) if len(columns[0]) else b""


def unpack(blob: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(blob, n * sum(widths), codec="zstd", asbytes=True) if n else b"", np.uint8)
    ends = np.cumsum(widths) * n
    return [np.ascontiguousarray(raw[z - w * n : z].reshape(w, n).T).view(k).reshape(n) for k, w, z in zip(kinds, widths, ends, strict=True)]


def key_blocks(counts: DataFrame) -> DataFrame:
    """Keys (h, word, c, a) in blocks of about BLOCK bytes, a row each: block (a number), n (keys), size (bytes of their words),
    numbers (h, c, a and the words' sizes, packed), words; and of the block's words, not its joints, the sums of c and a and the
    number of those with c, and c of the texts' ends, which is no key."""
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = itertools.count()
        held, size = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.take(pc.sort_indices(t.column("word")))
            words = t.column("word").combine_chunks()
            c, a = (t.column(k).to_numpy() for k in ("c", "a"))
            joint = pc.match_substring(words, b" ").to_numpy(zero_copy_only=False)
            full = pc.binary_length(words).to_numpy()
            keys = full > 0
            plain = b"".join(words.to_pylist())
            row = {
                "block": task << 32 | next(number), "n": int(keys.sum()), "size": len(plain), "numbers": pack(*(x[keys] for x in (t.column("h").to_numpy(), c, a, full))), "words": pa.compress(plain, codec="zstd", asbytes=True) if plain else b"",
                "trained": int(c[~joint].sum()), "all": int(a[~joint].sum()), "kinds": int((c[~joint] > 0).sum()), "ends": int(c[~keys].sum()),
            }
            return pa.RecordBatch.from_pylist([row])

        for b in batches:
            ends = size + np.cumsum(pc.binary_length(b.column(1)).to_numpy().astype(np.int64))
            lo = 0
            while lo < b.num_rows:
                hi = min(int(np.searchsorted(ends, most)) + 1, b.num_rows)
                held.append(b.slice(lo, hi - lo))
                size, lo = int(ends[hi - 1]), hi
                if size >= most:
                    yield out()
                    ends -= size
                    held, size = [], 0
        if held:
            yield out()

    return counts.mapInArrow(run, BLOCK_SCHEMA)


BLOCK_SCHEMA = "block long, n long, size long, numbers binary, words binary, trained long, all long, kinds long, ends long"
BLOCK_COLUMNS = ("block", "n", "size", "numbers", "words")


def block_keys(n: int, size: int, numbers: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """A block's hashes, counts in training rows, counts in all rows, and words."""
    h, c, a, sizes = unpack(numbers, n, np.int64, np.int64, np.int64, np.int32)
    plain = pa.decompress(words, size, codec="zstd", asbytes=True) if size else b""
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return h, c, a, [plain[i:j] for i, j in zip([0, *ends], ends)]


def bucket_of(h12: np.ndarray, sub: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(mix(h12.astype(np.uint64)) + sub.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def sub_of(symbol: np.ndarray) -> np.ndarray:
    return mix(symbol.astype(np.uint64)) % np.uint64(SUBS)


def distinct_edges(words: list[bytes], depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each scored symbol its key (index in words) and its edge; of each edge, a distinct pair of history and symbol, the
    history, nearest first [depth, edges], the symbol, and the bucket. Edges come by bucket, then by history."""
    found = list(symbols_of(words, depth))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((depth, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    own, sym, back = (np.concatenate(x, axis=-1) for x in zip(*found, strict=True))
    # Numbers of the codes that occur, so that few integers hold a history.
    seen = np.zeros(END + 2, bool)
    for x in (*back, sym + 1):
        seen[x] = True
    small = np.cumsum(seen) - 1
    bits = max(1, int(small[-1]).bit_length())
    keys = []
    for i, x in enumerate((*back, sym + 1)):
        if i % (63 // bits) == 0:
            keys.append(np.zeros(len(sym), np.int64))
        keys[-1] <<= bits
        keys[-1] |= small[x]
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys]) if len(order) else True
    edge = np.empty(len(order), np.int64)
    edge[order] = np.cumsum(new) - 1
    first = order[new]
    back, sym = back[:, first], sym[first]
    bucket = bucket_of(back[0] << WIDTH | back[1], sub_of(back[2]), buckets)
    by = np.argsort(bucket, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return own, place[edge], back[:, by], sym[by], bucket[by]


def stretches(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each bucket of a sorted array, and where it lies."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=False):
        yield int(bucket[lo]), lo, hi


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(b.column(k)[i].as_py() for k in range(b.num_columns))


def short_prices(blocks: DataFrame, least: int, gain: float) -> DataFrame:
    """Rows (h12, sym, p2): the probability of each symbol behind each two symbols, from contexts of two, one and none."""

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n, _, words in (block_keys(*r) for r in block_rows(batches)):
            for own, sym, back in symbols_of(words, 2):
                key = back[0] << 2 * WIDTH | back[1] << WIDTH | sym
                order = np.argsort(key)
                key, n_key = key[order], n[own][order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                total = np.add.reduceat(n_key, first) if len(key) else n_key
                yield pa.RecordBatch.from_arrays([pa.array(key[first] >> WIDTH), pa.array((key[first] & ((1 << WIDTH) - 1)).astype(np.int32)), pa.array(total)], ["h12", "sym", "n"])

    some = F.col("n") > 0

    def smoothed(edges: DataFrame, state: str, p: str, q: str, allowed=F.lit(True)) -> DataFrame:
        """edges (state, sym, n, p) with q, from the states that are retained; p: from shorter contexts."""
        diverge = F.sum(F.when(some, F.col("n") * (F.ln(F.when(some, F.col("n"))) - F.ln(p)))) - F.sum("n") * F.ln(F.sum("n"))
        states = edges.groupBy(state).agg(F.sum("n").alias("t"), F.count(F.when(some, 1)).alias("kinds"), diverge.alias("gained"))
        stays = allowed & (F.col("t") >= least) & (F.col("gained") > gain * F.col("kinds"))
        return edges.join(states, state).withColumn(q, F.when(stays, (F.col("n") + F.col("kinds") * F.col(p)) / (F.col("t") + F.col("kinds"))).otherwise(F.col(p)))

    edges = written(blocks.select(*BLOCK_COLUMNS[1:]).mapInArrow(triples, "h12 long, sym int, n long").groupBy("h12", "sym").agg(F.sum("n").alias("n")), "triples")
    root = edges.groupBy("sym").agg(F.sum("n").alias("n0"))
    total, kinds = root.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.count(F.when(F.col("n0") > 0, 1))).first()
    # At most one row a code point.
    root = F.broadcast(root.select("sym", ((F.col("n0") + kinds / CODE_POINTS) / max(total + kinds, 1)).alias("p0") if kinds else F.lit(1 / CODE_POINTS).alias("p0")))
    h1 = F.shiftright("h12", WIDTH)
    one = smoothed(edges.groupBy(h1.alias("h1"), "sym").agg(F.sum("n").alias("n")).join(root, "sym"), "h1", "p0", "p1").select("h1", "sym", "p1")
    two = edges.withColumn("h1", h1).join(one, ["h1", "sym"])
    return smoothed(two, "h12", "p1", "p2", F.col("h12").bitwiseAND(F.lit((1 << WIDTH) - 1)) > 0).select("h12", "sym", "p2")


def price_symbols(e0: np.ndarray, e1: np.ndarray, e2: np.ndarray, sym: np.ndarray, n: np.ndarray, p: np.ndarray, depth: int, least: int, gain: float) -> np.ndarray:
    """The probability of each symbol from its longest retained context; p: that from contexts of two symbols at most.

    The histories, packed nearest symbol first, must hold all of training that ends in their last three symbols.
    """
    order = np.lexsort((e2, e1, e0))
    e0, e1, e2, sym, n, p = (x[order] for x in (e0, e1, e2, sym, n.astype(np.float64), p.astype(np.float64)))
    mask = (1 << WIDTH) - 1
    active = np.flatnonzero((e0 & mask) > 0)
    new = np.ones(len(e0), bool)
    if len(new):
        new[1:] = e0[1:] != e0[:-1]
    for d in range(3, depth + 1):
        if d > 3:
            own = (e1 if d < 7 else e2) >> WIDTH * (2 - (d - 4) % 3)
            new[1:] |= own[1:] != own[:-1]
            active = active[(own[active] & mask) > 0]
        if not len(active):
            break
        context = np.cumsum(new)[active]
        key = context << WIDTH | sym[active]
        by = np.argsort(key, kind="stable")
        key, rows = key[by], active[by]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n_edge, p_edge = np.add.reduceat(n[rows], edge), p[rows[edge]]
        state = np.flatnonzero(np.concatenate([[True], (key[edge[1:]] >> WIDTH) != (key[edge[:-1]] >> WIDTH)]))
        total, kinds = np.add.reduceat(n_edge, state), np.add.reduceat((n_edge > 0).astype(np.float64), state)
        wide = np.diff(np.append(state, len(edge)))
        t_edge = np.repeat(total, wide)
        gained = np.add.reduceat(n_edge * np.log(np.where(n_edge > 0, n_edge / np.maximum(t_edge, 1) / p_edge, 1.0)), state)
        often = total >= least
        stays = np.repeat(often & (gained > gain * kinds), wide)
        k_edge = np.repeat(kinds, wide)
        p_edge = np.where(stays, (n_edge + k_edge * p_edge) / np.maximum(t_edge + k_edge, 1), p_edge)
        size = np.diff(np.append(edge, len(rows)))
        p[rows] = np.repeat(p_edge, size)
        # A longer context is no more frequent than its suffix.
        active = np.sort(rows[np.repeat(np.repeat(often, wide), size)])
    out = np.empty(len(p))
    out[order] = p
    return out


def key_prices(blocks: DataFrame, depth: int, least: int, gain: float) -> DataFrame:
    """blocks: of key_blocks, stored. Rows (h, c, a, joint, ls): ls is the sum of log10 of the probabilities of a key's scored
    symbols."""
    if not 3 <= depth <= LONGEST:
        raise ValueError(f"histories have 3 to {LONGEST} symbols")
    spark = blocks.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, (blocks.agg(F.sum("size")).first()[0] or 0) // DEALT)
    kinds = [np.int32] * (depth + 1) + [np.int64]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, *packed in block_rows(batches):
            _, c, _, words = block_keys(*packed)
            own, edge, back, sym, bucket = distinct_edges(words, depth, buckets)
            n = np.bincount(edge, c[own], len(sym)).astype(np.int64)
            back, sym = back.astype(np.int32), sym.astype(np.int32)
            rows = [(k, block, hi - lo, pack(*back[:, lo:hi], sym[lo:hi], n[lo:hi])) for k, lo, hi in stretches(bucket)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), BLOB_TYPES, strict=True)], names)

    def spread_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h12, sym, p = (b.column(i).to_numpy() for i in range(3))
            at = np.repeat(np.arange(len(h12)), SUBS)
            bucket = bucket_of(h12[at], np.tile(np.arange(SUBS), len(h12)), buckets)
            # With few buckets several classes of a history's third symbol share one.
            both = sorted_distinct(bucket.astype(np.int64) << 32 | at)[0]
            bucket, at = both >> 32, both & 0xFFFFFFFF
            key = h12 << WIDTH | sym
            rows = [(k, -1, hi - lo, pack(key[at[lo:hi]], p[at[lo:hi]])) for k, lo, hi in stretches(bucket)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), BLOB_TYPES, strict=True)], names)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, mine = [], []
        for row in block_rows(batches):
            (near if row[1] < 0 else mine).append(row)
        if not mine:
            return
        key, p_near = (np.concatenate(x) for x in zip(*(unpack(blob, n, np.int64, np.float64) for _, _, n, blob in near), strict=True))
        order = np.argsort(key)
        key, p_near = key[order], p_near[order]
        ends = np.cumsum([n for _, _, n, _ in mine])
        prices = np.empty(ends[-1])
        passes = int(-(-ends[-1] // SYMBOLS))
        for turn in range(passes):
            cols, at = [], []
            for (_, _, n, blob), end in zip(mine, ends, strict=True):
                *back, sym, count = unpack(blob, n, *kinds)
                back = [x.astype(np.int64) for x in back] + [np.zeros(n, np.int64)] * (9 - depth)
                e = [back[i] << 2 * WIDTH | back[i + 1] << WIDTH | back[i + 2] for i in (0, 3, 6)]
                # All histories that end in the same three symbols have the same turn.
                here = np.arange(n) if passes == 1 else np.flatnonzero(mix(e[0].astype(np.uint64)) % np.uint64(passes) == turn)
                cols.append([x[here] for x in (*e, sym.astype(np.int64), count)])
                at.append(here + (end - n))
            e0, e1, e2, sym, count = (np.concatenate(x) for x in zip(*cols, strict=True))
            wanted = e0 >> WIDTH << WIDTH | sym
            found = find(key, wanted)
            if len(found) and found.min() < 0:
                raise RuntimeError("a symbol without a probability from its last two symbols")
            prices[np.concatenate(at)] = np.log10(price_symbols(e0, e1, e2, sym, count, p_near[found], depth, least, gain))
        for (bucket, block, n, _), end in zip(mine, ends, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([n], pa.int64()), pa.array([pack(prices[end - n : end])], pa.binary())], ["block", "bucket", "n", "numbers"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each block its own row comes first, then its prices by bucket.
        for _, (own_row, *priced) in itertools.groupby(block_rows(batches), lambda r: r[0]):
            h, c, a, words = block_keys(*own_row[2:])
            own, edge, _, sym, _ = distinct_edges(words, depth, buckets)
            p = np.concatenate([np.zeros(0), *(unpack(blob, n, np.float64)[0] for _, _, n, _, blob, _ in priced)])
            if own_row[1] != -1 or len(p) != len(sym):
                raise RuntimeError("a block's prices are not those of its symbols")
            joint = np.fromiter((b" " in w for w in words), bool, len(words))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(a), pa.array(joint), pa.array(np.bincount(own, p[edge], len(words)))], ["h", "c", "a", "joint", "ls"])

    names = ["bucket", "block", "n", "blob"]
    schema = "bucket int, block long, n long, blob binary"
    near = written(short_prices(blocks, least, gain), "short")
    dealt = blocks.select(*BLOCK_COLUMNS).mapInArrow(spread, schema).union(near.mapInArrow(spread_near, schema))
    priced = dealt.repartitionById(buckets, "bucket").mapInArrow(price, "block long, bucket int, n long, numbers binary")
    none = F.lit(None).cast("binary")
    both = blocks.select("block", F.lit(-1).alias("bucket"), "n", "size", "numbers", "words").union(priced.select("block", "bucket", "n", F.lit(0).cast("long"), "numbers", none))
    # A block's number is that of the task that made it, and how many that task had made before.
    turn = F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(7919)
    return both.repartitionById(tasks, F.pmod(turn, F.lit(tasks)).cast("int")).sortWithinPartitions("block", "bucket").mapInArrow(summed, "h long, c long, a long, joint boolean, ls double")


BLOB_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary())


def find(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted hash among the sorted ones, -1 where it is none of them."""
    if not len(hashes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[at] == wanted, at, -1)


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: int = 10, depth: int = 8, least: int = 10, gain: float = 0.7, share: int = 1_000_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = written(key_blocks(word_counts(docs, held_out)), "keys")
    release(spark)
    total, everything, distinct, texts = (x or 0 for x in blocks.agg(F.sum("trained"), F.sum("all"), F.sum("kinds"), F.sum("ends")).first())
    base = math.log10(total + 0.1 * (distinct + 1))
    # A text is words and an end: the end's share among training tokens is its probability, the others' go to words.
    end = math.log10((texts + 0.5) / (total + 1))
    go = math.log10((total - texts + 0.5) / (total + 1))
    end_base = math.log10(texts + 0.1) - base

    def unless_joint(x: Column) -> Column:
        return F.when(F.col("joint"), 0.0).otherwise(x)

    found = key_prices(blocks, depth, least, gain)
    prices = written(found.select("h", "a", (~F.col("joint") & (F.col("c") > 0)).alias("known"), unless_joint(F.log10(F.col("c") + F.lit(0.1)) - base).alias("lb"), (unless_joint(F.lit(go)) + F.col("ls")).alias("ls")), "prices")
    discard(blocks)
    floor = max(1, everything // share)
    often = prices.where(F.col("a") >= floor).select("h", "known", "lb", "ls").toArrow()
    order = np.argsort(often.column("h").to_numpy())
    heavy = spark.sparkContext.broadcast([often.column("h").to_numpy()[order], *(often.column(k).to_numpy().astype(np.float64)[order] for k in ("known", "lb", "ls"))])
    release(spark)
    names = ["rid", "doc_id", "h", "k", "n_tokens", "n_known", "base_score", "score"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, *by_price = heavy.value
        for b in batches:
            texts_here = b.column(2)
            rids = b.column(0).to_numpy()
            for lo, hi in in_parts(texts_here):
                t = Texts(texts_here[lo:hi])
                rid = rids[lo:hi]
                m = len(rid)
                sums = np.zeros((3, m))
                pairs = sorted_distinct(t.pairs)[0]
                for h, code in ((t.hashes, t.codes), (t.joint_hashes(pairs), np.searchsorted(pairs, t.pairs))):
                    at = find(hashes, h)
                    here = at[code] >= 0
                    for i, price in enumerate(by_price):
                        sums[i] += np.bincount(t.text[here], price[at[code[here]]] if here.any() else None, m)
                    rare, n = sorted_distinct(t.text[~here] << 32 | code[~here])
                    if len(rare):
                        none, zero = pa.array(np.zeros(len(rare))), pa.array(np.zeros(len(rare), np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(rid[rare >> 32]), pa.nulls(len(rare), pa.int64()), pa.array(h[rare & 0xFFFFFFFF]), pa.array(n.astype(np.int32)), zero, zero, none, none], names)
                known, lb, ls = sums
                # The text's own row: k is 0, so that no price counts, and its hash spreads over the join's tasks.
                yield pa.RecordBatch.from_arrays([pa.array(rid), b.column(1)[lo:hi], pa.array(mix(rid.astype(np.uint64)).view(np.int64)), pa.array(np.zeros(m, np.int32)), pa.array(t.sizes + 1), pa.array((known + (texts > 0)).astype(np.int64)), pa.array(lb + end_base), pa.array(ls + end)], names)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    parts = rows.mapInArrow(counted, "rid long, doc_id long, h long, k int, n_tokens long, n_known long, base_score double, score double")
    light = prices.where(F.col("a") < floor).select("h", "known", "lb", "ls")
    joined = parts.join(light, "h", "left").select("rid", "doc_id", "n_tokens", (F.col("n_known") + F.when(F.col("known"), F.col("k")).otherwise(0)).alias("n_known"), (F.col("base_score") + F.coalesce(F.col("k") * F.col("lb"), F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce(F.col("k") * F.col("ls"), F.lit(0.0))).alias("score"))
    out = joined.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return out.select("doc_id", fold(F.col("doc_id"), held_out).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out=10)
