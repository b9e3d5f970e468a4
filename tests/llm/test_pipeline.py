"""The pipeline against a brute-force version, row by row: repeated rows, repeated and null ids, columns with odd names."""

import random
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from millrace.llm import decontaminate, packing, quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_i", "__i", "_d", "n_lines", "n_dropped", "label"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _i int, __i int, _d string, n_lines long, n_dropped int, label string"


def signed(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def make_rows():
    random.seed(12)
    vocabulary = ["".join(random.choice("aeioutnrsl") for _ in range(random.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    shared = prose(30)
    items = [(1, prose(25)), (2, prose(40)), (3, None), (None, prose(20))]
    texts = []
    for k in range(40):
        texts.append(prose(random.randrange(12, 90)) + ("\n" + shared if k % 3 == 0 else "") + "\n" + prose(15))
    texts += [prose(20) + " " + items[0][1] + " " + prose(10), prose(30) + " " + items[3][1].replace("a", "e", 1)]
    rows = [(i, t) for i, t in enumerate(texts)]
    near = texts[5].split()
    near[-1] = "other"
    rows += [(100, " ".join(near)), (101, texts[5]), (5, texts[5]), (5, texts[5]), (None, texts[5])]  # copies, repeated rows, a null id
    rows += [(None, texts[7]), (None, texts[7] + " end"), (None, prose(50)), (8, prose(60)), (8, texts[9])]  # copies with null ids; an id of several texts
    rows += [(200, None), (201, ""), (202, " \n "), (203, "few words"), (204, "a b c d e " * 40), (205, "### $$$ " * 30)]
    rows += [(300, prose(3_000))]
    out = []
    for n, (i, t) in enumerate(rows):
        out.append((i, t, random.choice(["en", None]), "s", None if t is None else len(t), n, 7, "d", 77, n % 3, "clash"))
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(204, 0, 0), (205, 0, 0), (203, 0, 1), (None, 1, 0), (1, None, None)]
    return out, labels, items


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    seen = Counter(k for i, t in {(r[0], r[1] or "") for r in rows} for k in {key(x) for x in t.split("\n")})
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < 10]
        text = "\n".join(kept)
        out.append((r[0], text, *r[2:4], len(text) if len(kept) < len(lines) else r[4], *r[5:]))
    return out


def brute_near(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for k, r in enumerate(rows):
        rank = (r[0] is None, r[0] or 0, signed(r[1]), [(x is not None, x) for x in r])
        if sets[k] and (group[k] not in first or rank < first[group[k]][0]):
            first[group[k]] = rank, k
    stay = {k for _, k in first.values()}
    return [r for k, r in enumerate(rows) if not sets[k] or k in stay]


def brute_clean(rows, items):
    known = [decontaminate.normal(t) for _, t in items if t]
    hit = lambda text: any(decontaminate.edit_match(p, decontaminate.normal(text))[0] <= int(0.08 * len(p)) for p in known)
    return [r for r in rows if not hit(r[1])]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels, items = make_rows()
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items


def test_pipeline_is_brute_force(spark, tables):
    at, rows, items = tables
    verdicts = quality_rules.quality_verdicts(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{at}/labels.parquet")).collect()
    kept = {(v.doc_id, v.tkey): v.kept for v in verdicts}
    for r in rows:  # the base rules, by hand
        words = (r[1] or "").split()
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
        if len(words) < 10 or 100 * len(again) > 20 * len(words):
            assert not kept[r[0], signed(r[1])]
    want = [r for r in rows if kept[r[0], signed(r[1])]]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:4], (lambda x: want, brute_lines, brute_near, lambda x: brute_clean(x, items)), strict=True):
        want = brute(want)
        got = stage(spark, docs, at)
        assert got.columns == COLUMNS, name
        assert in_order(got.collect()) == in_order(want), name
        docs = spark.createDataFrame(want, SCHEMA).repartition(2)
    assert 20 < len(want) < 50
    out = corpus_pipeline.run(spark, at).collect()
    assert in_order((r.doc_id, r.text) for r in out) == in_order((r[0], r[1]) for r in want)
    sizes = Counter(len((r[1] or "").encode().split()) for r in want)
    bounds = packing.best_boundaries(sorted(sizes.items()), 16)
    assert all(r.n_tokens == len(r.text.encode().split()) and r.boundary == min(b for b in bounds if b >= r.n_tokens) for r in out)


def test_texts_without_words_all_stay(spark, tables):
    at, _, _ = tables
    rows = [(1, None), (1, None), (2, ""), (None, " "), (None, " "), (3, "a b"), (3, "a b"), (4, "A b")]
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), at).collect()
    assert in_order(out) == in_order([*rows[:5], (3, "a b")])


def test_stages_on_empty_tables(spark, tables):
    at, _, _ = tables
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        assert docs.collect() == []
