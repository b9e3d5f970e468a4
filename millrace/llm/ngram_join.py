"""Exact Jaccard join on word shingles by vertical partitioning of the global shingle order.

1. Each text gives its set of 64-bit shingle hashes; texts with equal sets are one class, named by a 64-bit signature. A
   second signature is kept beside it, and where two sets share the first their names come from both.
2. The global order puts ordinary shingles first, by hash, and the most frequent ones last. Two sets with Jaccard >= t share
   a shingle within their prefixes of n - ceil(t n) + 1, so prefixes alone are shuffled and give the candidates. Rows of a
   frequent shingle are dealt over many tasks by a salt.
3. Of each set a parity sketch of one to two bits a shingle is kept. Two sketches differ in no more bits than the sets do in
   shingles, which bounds the overlap from above; a pair whose bound is below the threshold cannot link and goes no further.
4. The global order is cut into fragments: equal ranges of the ordinary shingles, and the frequent ones as the last. Each set
   lies in one row a fragment; the overlap of a pair is counted in every fragment apart and summed per pair.
5. Links make components. Each member of a bucket is first compared with one pivot (then with 4, 16 ... while buckets hold many
   more pairs than rows); members that are then known to be connected need no comparison. All pairs that remain across
   components are compared, so no link is lost.

A group of n near copies so costs about n comparisons, not n squared. Equal sets never meet in pairs at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import components, discard, maybe_broadcast, release, sorted_distinct, text_key, texts_word_hashes, windows_hash, word_hashes, words_of, written

#: At most so many frequent shingles (8 bytes each) are sent to the workers.
MOST_HEAVY = 1 << 20
#: Buckets of at most so many sets may give a pair at each of its common tokens.
FEW = 40
#: Occurrences gathered in a Python worker before they are counted.
BLOCK = 1_000_000
#: Tasks over which a frequent shingle's rows are dealt.
SALTS = 64


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    return sorted_distinct(windows_hash(word_hashes(words_of(text)), width))[0]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """shingle_set() of each text."""
    for words in texts_word_hashes(texts):
        yield sorted_distinct(windows_hash(words, width))[0]


def signature(found: np.ndarray) -> int:
    """Of a set: an order-free 64-bit sum of its hashes and size."""
    with np.errstate(over="ignore"):
        return int((found * np.uint64(0xD6E8FEB86659FD93) ^ (found >> np.uint64(29))).sum(dtype=np.uint64) ^ np.uint64(len(found) * 0x9E3779B97F4A7C15 % 2**64))


def second_signature(found: np.ndarray) -> int:
    """Of a set: another such sum, of other products, so that the two together name a set by 128 bits."""
    with np.errstate(over="ignore"):
        return int(((found ^ found >> np.uint64(32)) * np.uint64(0x9FB21C651E98DF25) ^ (found >> np.uint64(35))).sum(dtype=np.uint64))


def name_of(found: np.ndarray, shared: frozenset[int]) -> int:
    """The signature that names a set; shared: signatures that unlike sets have, as signed numbers."""
    sig = signature(found)
    if shared and (sig if sig < 1 << 63 else sig - (1 << 64)) in shared:
        return sig ^ second_signature(found)
    return sig


def sketch(found: np.ndarray) -> np.ndarray:
    """Of a set: for each of 2^k > n residues (64 at least) the parity of the hashes that have it, as 64-bit words."""
    bits = max(64, 1 << len(found).bit_length())
    odd = (np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _sets(docs: DataFrame, width: int, at_least: int) -> DataFrame:
    """Rows of two kinds: kind 0, a text (doc_id, n, sig, sig2, tkey, sketch); kind 1, a shingle (sig) and how often (n) a block of texts has it."""

    names = ["kind", "doc_id", "n", "sig", "sig2", "tkey", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            tokens, n = sorted_distinct(np.concatenate(held))
            keep = n >= at_least
            tokens, n = signed(tokens[keep]), n[keep]
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), none, pa.array(n), pa.array(tokens), none, none, pa.nulls(len(n), pa.list_(pa.int64()))], names)

        for b in batches:
            sizes, sigs, seconds, sketches = [], [], [], []
            for found in shingle_sets(b.column(1), width):
                sizes.append(len(found))
                sigs.append(signature(found) if len(found) else 0)
                seconds.append(second_signature(found) if len(found) else 0)
                sketches.append(sketch(found))
                held.append(found)
                size += len(found)
                if size >= BLOCK:
                    yield counted()
                    held, size = [], 0
            if sketches:
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sketches])]).astype(np.int32))
                kept = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sketches)))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), b.column(0), pa.array(sizes, pa.int64()), pa.array(signed(np.array(sigs, np.uint64))), pa.array(signed(np.array(seconds, np.uint64))), b.column(2), kept], names)
        if size:
            yield counted()

    return docs.mapInArrow(run, "kind int, doc_id long, n long, sig long, sig2 long, tkey long, sketch array<long>")


def is_late(found: np.ndarray, heavy: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted frequent ones; maybe has their first 22 bits, which rule most others out."""
    late = maybe[found >> np.uint64(42)]
    if late.any():
        late[late] = heavy[np.minimum(np.searchsorted(heavy, found[late]), len(heavy) - 1)] == found[late]
    return late


def first_bits(heavy: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << 22, bool)
    maybe[heavy >> np.uint64(42)] = True
    return maybe


def _prefixes(docs: DataFrame, width: int, percent: int, heavy: np.ndarray, shared: frozenset[int]) -> DataFrame:
    """Rows (sig, n, pos, token, salt) of each distinct set's prefix in the global order; salt is 0 but for frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        maybe = first_bits(heavy)
        for b in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            size = 0
            for found in shingle_sets(b.column(0), width):
                n = len(found)
                if not n or (sig := name_of(found, shared)) in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(sig)
                late = is_late(found, heavy, maybe)
                k = n - needed(n, percent) + 1
                prefix = np.concatenate([found[~late], found[late]])[:k]
                salt = np.where(np.arange(k) < n - int(late.sum()), 0, 1 + sig % SALTS).astype(np.int32)
                parts.append((np.full(k, sig, np.uint64), np.full(k, n, np.int32), np.arange(k, dtype=np.int32), prefix, salt))
                size += k
                if size > 200_000:
                    yield batch(parts)
                    parts, size = [], 0
            if parts:
                yield batch(parts)

    def batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        sig, n, pos, token, salt = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(n), pa.array(pos), pa.array(signed(token)), pa.array(salt)], ["sig", "n", "pos", "token", "salt"])

    return docs.select("text").mapInArrow(run, "sig long, n int, pos int, token long, salt int")


def _fragments(docs: DataFrame, width: int, fragments: int, short: bool, heavy: np.ndarray, shared: frozenset[int]) -> DataFrame:
    """Rows (sig, grp, part): of each set its stretch of every fragment of the global order that it has a shingle in.
    short: of each hash the low half alone, which takes half the room and may merge two shingles now and then."""
    kind = "int" if short else "long"
    cuts = np.array([i * 2**64 // (fragments - 1) for i in range(1, fragments - 1)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        maybe = first_bits(heavy)
        for b in batches:
            sigs, groups, parts = [], [], []
            for found in shingle_sets(b.column(0), width):
                if not len(found) or (sig := name_of(found, shared)) in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(sig)
                late = is_late(found, heavy, maybe)
                early = found[~late]
                for g, part in enumerate([*np.split(early, np.searchsorted(early, cuts)), found[late]]):
                    if len(part):
                        sigs.append(sig)
                        groups.append(g)
                        parts.append(part)
            if sigs:
                flat = np.concatenate(parts)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.uint32).view(np.int32) if short else signed(flat)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.array(sigs, np.uint64))), pa.array(groups, pa.int32()), lists], ["sig", "grp", "part"])

    return docs.select("text").mapInArrow(run, f"sig long, grp int, part array<{kind}>")


def _overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, na, b, nb) with their overlaps, counted fragment by fragment and summed; 0 where no fragment has any."""
    left = parts.select(F.col("sig").alias("a"), "grp", F.col("part").alias("pa"))
    right = parts.select(F.col("sig").alias("b"), "grp", F.col("part").alias("pb"))
    partial = pairs.join(left, "a").join(right, ["b", "grp"]).select("a", "b", "na", "nb", "grp", F.size(F.array_intersect("pa", "pb")).alias("o"))
    # Dealt by pair once, which serves both groupings. Texts that repeat give a fragment twice, hence the first.
    partial = partial.repartition("a", "b").groupBy("a", "b", "na", "nb", "grp").agg(F.max("o").alias("o"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("overlap"))


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, na, b, nb) that can reach the threshold by their sketches: overlap <= (na + nb - differing bits) / 2."""
    left = sketches.select(F.col("sig").alias("a"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("sig").alias("b"), F.col("sketch").alias("sb"))
    words = F.least(F.size("sa"), F.size("sb"))

    def folded(s):
        """A longer sketch as one of `words` words: the parities of residues of a smaller power of two."""
        zero = F.array_repeat(F.lit(0).cast("long"), words)
        folds = F.sequence(F.lit(0), (F.size(s) / words).cast("int") - 1)
        return F.when(F.size(s) == words, F.col(s)).otherwise(F.aggregate(folds, zero, lambda x, k: F.zip_with(x, F.slice(s, k * words + 1, words), lambda p, q: p.bitwiseXOR(q))))

    differ = F.aggregate(F.zip_with(folded("sa"), folded("sb"), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long")), F.lit(0).cast("long"), lambda x, k: x + k)
    both = (F.col("na") + F.col("nb")).cast("long")
    return pairs.join(left, "a").join(right, "b").where((both - differ) * (100 + percent) >= both * 2 * percent).select("a", "na", "b", "nb")


def _verified(pairs: DataFrame, sketches: DataFrame, parts_of, percent: int) -> DataFrame:
    """The pairs whose overlap reaches the threshold. Sketches rule out most that don't. Half hashes decide all other pairs
    but those near the threshold, which whole hashes decide."""
    pairs = written(_close(pairs, sketches, percent), "close")
    parts = parts_of(pairs, True)
    seen = written(_overlaps(pairs, parts), "overlaps")
    discard(parts)
    release(pairs.sparkSession)
    room = (3 + F.floor(F.greatest("na", "nb") / 2_000)) * (100 + percent)
    over = F.col("overlap") * (100 + percent) - (F.col("na") + F.col("nb")) * percent
    sure = seen.where(over >= room).select("a", "b")
    near = written(seen.where((over < room) & (over >= -room)).select("a", "na", "b", "nb"), "near")
    if near.isEmpty():
        return sure
    parts = parts_of(near, False)
    out = written(sure.union(_overlaps(near, parts).where(over >= 0).select("a", "b")), "links")
    discard(parts)
    return out


def _may_link(percent: int):
    """Length and position filters on a shared token at positions xp and yp of sets of xn and yn shingles."""
    least = F.ceil((F.col("xn") + F.col("yn")).cast("long") * percent / (100 + percent) - 1e-9)
    rest = F.least(F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp"))
    return (F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent) & (rest >= least)


def _linked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, fragments: int = 4, rounds: int = 5) -> DataFrame:
    """Every row's doc_id, tkey = text_key(text), n (size of its set) and label, which the rows of one component share.

    rounds: at most so many rounds compare sets with pivots before what remains is compared in full.
    """
    if fragments < 2:
        raise ValueError("the order is cut into two fragments at least")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tkey", text_key(F.col("text")))
    both = written(_sets(docs, width, 4), "sets")
    texts = both.where("kind = 0").select("doc_id", "n", "sig", "sig2", "tkey", "sketch")
    often = both.where("kind = 1").groupBy("sig").agg(F.sum("n").alias("n"))
    least, seen = 1 << 62, 0
    for r in often.groupBy("n").count().orderBy(F.desc("n")).limit(1 << 16).collect():
        seen += r["count"]
        if seen > MOST_HEAVY:
            break
        least = r["n"]
    rows = often.where(F.col("n") >= least).select("sig").toArrow()
    heavy = np.sort(rows.column(0).to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)

    def classes(texts: DataFrame) -> DataFrame:
        """A text of each set, and whether the sets of its name are one."""
        of = texts.where("n > 0").groupBy("sig").agg(F.min(F.struct("doc_id", "tkey")).alias("x"), F.first("sketch").alias("sketch"), (F.min("sig2") < F.max("sig2")).alias("mixed"))
        return written(of.select("sig", "x.*", "sketch", "mixed"), "one")

    one = classes(texts)
    # About n * n / 2^65 of n sets: none in most corpora.
    shared = frozenset(r.sig for r in one.where("mixed").select("sig").toLocalIterator())
    if shared:
        texts = texts.withColumn("sig", F.when(F.col("sig").isin(*shared), F.col("sig").bitwiseXOR(F.col("sig2"))).otherwise(F.col("sig")))
        one = classes(texts)

    same = W.partitionBy("token", "salt")
    prefix = _prefixes(docs, width, percent, heavy, shared).repartition("token", "salt")
    bucket = prefix.withColumn("lo", F.min("sig").over(same)).withColumn("hi", F.max("sig").over(same)).where("salt > 0 or lo <> hi")
    bucket = written(bucket.select("token", "salt", "sig", "n", "pos").distinct(), "buckets").drop("salt")

    def parts_of(pairs: DataFrame, short: bool) -> DataFrame:
        """Fragments of the sets in the pairs, from one text of each."""
        keys = written(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct().join(one.drop("sketch", "mixed"), "sig").select("doc_id", "tkey"), "keys").alias("k")
        chosen = docs.join(maybe_broadcast(keys, keys.count()), (docs.tkey == F.col("k.tkey")) & docs.doc_id.eqNullSafe(F.col("k.doc_id")), "left_semi")
        return written(_fragments(chosen, width, fragments, short, heavy, shared), "fragments")

    release(spark)
    size = bucket.count()
    may = lambda t: t.where("xl <> yl").where(_may_link(percent)).select("a", F.col("xn").alias("na"), "b", F.col("yn").alias("nb"))
    label = None
    links = None
    last = None
    for turn in range(rounds + 1):
        now = bucket if label is None else bucket.join(maybe_broadcast(label, label.count()), bucket.sig == label.node, "left").drop("node")
        now = now.withColumn("label", F.col("sig") if label is None else F.coalesce("label", "sig"))
        per = now.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        left = (per.agg(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2)).first()[0] or 0) if size else 0
        if not left:
            break
        whole = turn == rounds or (last is not None and (left <= 8 * size or left > 0.7 * last))
        last = left
        xs = lambda t, *more: t.select("token", F.col("sig").alias("a"), F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("label").alias("xl"), *more)
        ys = lambda t, *more: t.select("token", F.col("sig").alias("b"), F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("label").alias("yl"), *more)
        if whole:
            live = written(now.join(per.select("token", F.col("all").alias("c")), "token"), "live")
            few = live.where(F.col("c") <= FEW)
            pairs = xs(few).join(ys(few), "token").where("a < b").transform(may)
            # In large buckets a pair comes out at its first common token alone: what lies before on either side doesn't overlap.
            lists = live.where(F.col("c") > FEW).groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("all"), F.first("n").alias("n"), F.first("label").alias("label"))
            rows = lists.select("sig", "n", "label", F.col("all.token").alias("tokens"), F.posexplode("all").alias("i", "t"))
            large = rows.select(F.col("t.token").alias("token"), "sig", "n", "label", F.col("t.pos").alias("pos"), F.slice("tokens", 1, F.col("i")).alias("before"))
            met = xs(large, F.col("before").alias("xb")).join(ys(large, F.col("before").alias("yb")), "token").where("a < b and not arrays_overlap(xb, yb)")
            pairs = pairs.union(met.transform(may)).distinct()
        else:
            # Pivots are the sets whose tokens most others share: an original before its copies.
            popular = now.join(per.select("token", "all"), "token").groupBy("sig").agg(F.sum("all").alias("pop"))
            x, y = xs(now.join(popular, "sig"), "pop"), ys(now)
            many = 4**turn
            pivot = x.join(per.select("token"), "token", "left_semi")
            if turn:  # the most popular of each label; then the first of those, so that no long list is made
                pivot = pivot.groupBy("token", "xl").agg(F.max(F.struct("pop", "a", "xn", "xp")).alias("p")).select("token", "xl", "p.*")
                pivot = pivot.withColumn("at", F.row_number().over(W.partitionBy("token").orderBy(F.desc("pop"), "a"))).where(F.col("at") <= many).drop("at")
            else:
                pivot = pivot.groupBy("token").agg(F.max(F.struct("pop", "a", "xn", "xp", "xl")).alias("p")).select("token", "p.*")
            pairs = y.join(pivot.drop("pop"), "token").where("a <> b").transform(may).distinct()
        pairs = written(pairs, "pairs")
        release(spark)
        more = _verified(pairs, one.select("sig", "sketch"), parts_of, percent)
        links = more if links is None else links.union(more)
        release(spark)
        label = written(components(links), "labels")
        if whole:
            break

    texts = texts.select("doc_id", "tkey", "n", "sig")
    if label is None:
        return texts.withColumnRenamed("sig", "label")
    return texts.join(maybe_broadcast(label, label.count()), texts.sig == label.node, "left").select("doc_id", "tkey", "n", F.coalesce("label", "sig").alias("label"))


def jaccard_components(docs: DataFrame, **params) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least id reachable by links with Jaccard >= percent / 100).

    Texts without words (null, empty, blank) have n_shingles 0 and are their own component. Rows with a null id take part; a
    component with null ids only has a null id. Repeated rows are equal sets, so one component. An empty table gives no rows.
    Other columns of docs are not looked at. params: those of _linked.
    """
    rows = written(_linked(docs, **params), "linked")
    several = written(rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "components")
    named = rows.join(maybe_broadcast(several, several.count()), "label", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_copies(docs: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    """Two stored tables of (doc_id, tkey): those that go so that one of each component stays, and those that stay but stand
    in several rows of docs. The least id stays, a null one last; of an id's texts the one with the least tkey. Texts without
    words are in neither."""
    rows = written(_linked(docs, **params).where("n > 0"), "linked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("x")
    several = written(rows.groupBy("label").agg(first, F.count(F.lit(1)).alias("k")).where("k > 1").select("label", F.col("x.doc_id").alias("i"), F.col("x.tkey").alias("t")), "components")
    marked = rows.join(maybe_broadcast(several, several.count()), "label").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tkey") == F.col("t")))
    gone = written(marked.where("not stays").select("doc_id", "tkey").distinct(), "copies")
    repeats = written(marked.where("stays").groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "repeats")
    return gone, repeats


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes k ON k.doc_id = p.b WHERE 100 * p.o >= 80 * (m.n + k.n - p.o)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, z.n
"""
