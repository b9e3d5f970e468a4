"""Language spans of mixed text: scripts narrow the candidates, words are scored, and Viterbi's algorithm labels them.

Letters are the code points of Unicode's categories L*. A word's score under a language is the log-likelihood of its
character n-grams (1 to 4, with word boundaries, in hashed tables with smoothing). A language is a candidate for a word if at
least `script_share` of its training letters are of the word's script; where no language is, all are. Over a text's words the best path pays `switch` for each change of language;
equal neighbours on it make spans. The language with most letters on the path is predicted.

Training takes a bounded sample: about `per_lang` distinct texts of each language outside the held-out fold, chosen by hash
among whole texts of up to `train_chars` characters; every language is learned, however rare. Workers count the sample's
n-grams, and the counts, at most 2^18 a language, make the tables (1 MB a language). All texts are predicted, whole.

Defined cases: null texts and texts without a letter are `und` with score 0. Without training rows every text is `und`.
A training text whose words have no letter teaches n-grams alone.
Ties go to the language that sorts first. Repeated rows get equal answers; null ids count as training rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, fold, maybe_broadcast, mix, written

# First code point of each range and its script.
SCRIPTS = [(0x0, "Common"), (0x41, "Latin"), (0x5B, "Common"), (0x61, "Latin"), (0x7B, "Common"), (0xC0, "Latin"), (0x250, "Latin"), (0x2B0, "Common"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Syriac"), (0x780, "Thaana"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1400, "Common"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Common"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Common"), (0x3040, "Kana"), (0x3100, "Common"), (0x3130, "Hangul"), (0x3190, "Common"), (0x3400, "Han"), (0xA000, "Common"), (0xAC00, "Hangul"), (0xD7B0, "Common"), (0xF900, "Han"), (0xFB00, "Common"), (0x20000, "Han"), (0x30000, "Common")]
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({"Other", *(n for _, n in SCRIPTS)})
SCRIPT = np.array([NAMES.index(n) for _, n in SCRIPTS], np.int8)
COMMON, OTHER = NAMES.index("Common"), NAMES.index("Other")
BITS = 16
ORDERS = 4


def script_table() -> np.ndarray:
    """Script of every code point: Common if it is no letter, Other if it is one outside the ranges' scripts."""
    points = range(0x110000)
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in points), bool, len(points))
    script = SCRIPT[np.searchsorted(STARTS, np.arange(len(points)), side="right") - 1]
    return np.where(letter, np.where(script == COMMON, OTHER, script), COMMON).astype(np.int8)


def chars_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each word between two spaces, and the words' starts."""
    text = " ".join(["", *words, ""])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return codes, np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]


def gram_buckets(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket of the n-gram that begins at each code point, and whether it lies within one word's spaces."""
    word = np.zeros(len(codes), np.int64)
    word[starts[1:]] = 1
    word = np.cumsum(word)
    space = np.zeros(len(codes), bool)
    space[starts] = True
    space[-1:] = True
    h = np.zeros(len(codes), np.uint64)
    gaps = np.concatenate([[0], np.cumsum(space)])
    for n in range(1, ORDERS + 1):
        h = h[: len(codes) - n + 1]
        h = h * np.uint64(1_000_003) + codes[n - 1 :].astype(np.uint64)
        at = np.arange(len(h))
        inner = gaps[at + n - 1] - gaps[np.minimum(at + 1, at + n - 1)] == 0 if n > 1 else ~space
        yield (mix(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64), inner


def word_scores(words: list[str], tables: np.ndarray, allowed: np.ndarray, scripts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores [word, language], 0 for words without letters, and each word's number of letters."""
    k = tables.shape[2]
    if not words:
        return np.zeros((0, k), np.float32), np.zeros(0, np.int64)
    codes, starts = chars_of(words)
    kinds = scripts[codes]
    letter = kinds != COMMON
    letters = np.add.reduceat(letter, starts).astype(np.int64)
    score = np.zeros((len(words), k), np.float32)
    for n, (bucket, inner) in enumerate(gram_buckets(codes, starts)):
        rows = tables[n][bucket]
        rows[~inner] = 0
        if len(rows) < len(codes):
            rows = np.concatenate([rows, np.zeros((len(codes) - len(rows), k), np.float32)])
        score += np.add.reduceat(rows, starts, axis=0)
    first = np.full(len(words), COMMON, np.int64)
    at = np.flatnonzero(letter)
    owner = np.searchsorted(starts, at, side="right") - 1
    first[owner[::-1]] = kinds[at[::-1]]
    may = allowed[first]
    score = np.where(may | ~may.any(1, keepdims=True), score / ORDERS, np.float32(-50) * np.maximum(letters, 1)[:, None])
    score[letters == 0] = 0
    return score, letters


def viterbi(score: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word of many texts at once; score has the words of all texts, one text after another."""
    n, k = score.shape
    order = np.argsort(-sizes, kind="stable")
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
    lengths = sizes[order]
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    back = np.zeros((n, k), np.int8 if k < 128 else np.int16)
    own = np.arange(k)
    v = np.zeros((len(order), k), np.float32)
    for t, m in enumerate(active):
        at = begins[:m] + t
        if t == 0:
            v[:m] = score[at]
            continue
        best = v[:m].argmax(1)
        top = v[np.arange(m), best] - np.float32(switch)
        stay = v[:m] >= top[:, None]
        back[at] = np.where(stay, own, best[:, None])
        v[:m] = np.where(stay, v[:m], top[:, None]) + score[at]
    path = np.zeros(n, back.dtype)
    now = v.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = begins[:m] + t
        path[at] = now[:m]
        now[:m] = back[at, now[:m]]
    return path


def gram_counts(sample: DataFrame) -> DataFrame:
    """Rows (lang, kind, bucket, n) of texts (lang, text): kind 0 to 3 counts n-grams of that order, kind 4 letters by script."""
    scripts = script_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                found = [np.zeros(1 << BITS, np.int64) for _ in range(ORDERS)] + [np.zeros(len(NAMES), np.int64)]
                for text in own:
                    if words := text.lower().split():
                        codes, starts = chars_of(words)
                        found[ORDERS] += np.bincount(scripts[codes], minlength=len(NAMES))
                        for n, (bucket, inner) in enumerate(gram_buckets(codes, starts)):
                            found[n] += np.bincount(bucket[inner], minlength=1 << BITS)
                for kind, counts in enumerate(found):
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "kind", "bucket", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    """From gram_counts: languages in order, log-probability tables [order, bucket, language], shares [script, language]."""
    langs = sorted(set(rows.column("lang").to_pylist()))
    number = {lang: j for j, lang in enumerate(langs)}
    j = np.array([number[x] for x in rows.column("lang").to_pylist()], np.int64)
    kind, bucket, n = (rows.column(k).to_numpy() for k in ("kind", "bucket", "n"))
    tables = np.zeros((ORDERS, 1 << BITS, len(langs)), np.float32)
    for order in range(ORDERS):
        m = kind == order
        tables[order, bucket[m], j[m]] = n[m]
    total = tables.sum(1, keepdims=True, dtype=np.float64)
    used = (tables.any(2)).sum(1)[:, None, None] + 1
    for order in range(ORDERS):  # one order at a time, to hold little more than the tables themselves
        tables[order] = np.log((tables[order] + 0.5) / (total[order] + 0.5 * used[order]))
    letters = np.zeros((len(NAMES), len(langs)))
    m = (kind == ORDERS) & (bucket != COMMON)
    letters[bucket[m], j[m]] = n[m]
    return langs, tables, letters / np.maximum(letters.sum(0), 1)


def language_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, train_chars: int = 20_000, script_share: float = 0.01, switch: float = 6.0, words_at_once: int = 600_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the letters that the path gives to lang_pred) and spans (lang, first word, words)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = docs.where("text is not null and lang is not null").where(~fold(F.col("doc_id"), 5)).where(F.length("text").between(1, train_chars))
    many = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("many")), "languages")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    # Repeated texts hash alike and are learned once, so no crowd of copies outgrows the sample.
    sample = known.join(maybe_broadcast(many, many.count()), "lang").where(place * F.col("many") < per_lang).select("lang", "text").distinct()
    found = written(gram_counts(sample), "grams")
    langs, tables, share = fit(found.toArrow())
    discard(found)
    sent = docs.sparkSession.sparkContext.broadcast((tables, script_table()))
    allowed = share >= script_share

    def labelled(texts: list[str | None]) -> tuple[list, list, list]:
        words, sizes = [], []
        for t in texts:
            w = t.lower().split() if t else []
            words += w
            sizes.append(len(w))
        codes, unique = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, int), np.zeros(0, object))
        score, letters = word_scores(list(unique), sent.value[0], allowed, sent.value[1])
        letters = letters[codes]
        sizes = np.array(sizes)
        path = viterbi(score[codes], sizes, switch)
        ends = np.cumsum(sizes)
        pred, conf, spans = [], [], []
        edge = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])) if len(path) else np.zeros(0, int)
        for lo, hi in zip(ends - sizes, ends, strict=True):
            mass = np.bincount(path[lo:hi], letters[lo:hi], minlength=len(langs))
            if hi == lo or not mass.any():
                pred.append("und"), conf.append(0.0), spans.append([])
                continue
            pred.append(langs[int(mass.argmax())])
            conf.append(float(mass.max() / mass.sum()))
            cuts = np.concatenate([[lo], edge[np.searchsorted(edge, lo, side="right") : np.searchsorted(edge, hi)], [hi]])
            spans.append([{"lang": langs[path[a]], "first": int(a - lo), "words": int(b - a)} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return pred, conf, spans

    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            sizes = np.cumsum([len(t or "") // 6 + 1 for t in texts])
            cuts = np.unique(np.concatenate([[0], np.searchsorted(sizes, np.arange(words_at_once, sizes[-1] if len(sizes) else 0, words_at_once)), [len(texts)]]))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                part = texts[a:z]
                pred, conf, spans = labelled(part) if langs else (["und"] * len(part), [0.0] * len(part), [[]] * len(part))
                yield pa.RecordBatch.from_arrays([b.column(0)[a:z], b.column(1)[a:z], pa.array(pred, pa.string()), pa.array(conf, pa.float64()), pa.array(spans, kind)], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return docs.select("doc_id", fold(F.col("doc_id"), 5).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<lang:string,first:int,words:int>>")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))
