"""Secret scan with SQL functions only: three fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a run of at least `window` characters of [A-Za-z0-9+/_=-] that has a letter and a digit, or letters of both
cases. Placeholder words cut it into pieces, and each piece that is still a candidate is scored. Its class (hex or
base64) gives the alphabet and the threshold. A window moves over it one character at a time. Its counts lie in a few
64-bit words, five bits a character; the character that leaves and the one that enters change one word each, and the sum of
n log2 n, in fixed point, changes by those two terms alone. The run with a piece that reaches the threshold is kept unless an
allow-list pattern matches the run or the piece, or a fixed pattern's span covers it.

Work grows with a text's length: no pattern backtracks over a repeated group, and where matches are numbered by position the
sums are taken in two levels of blocks, so that many matches in one text cost little either.

Defined cases: a null text is an empty one and has no spans. Repeated rows give repeated rows. Ties in the order of spans
go by start, then kind as listed. Other columns are ignored. Whole texts are scanned.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the contract (kind, pattern, group that is measured, least length).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
FIXED = [("assign", ASSIGN, 1, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16)]
KINDS = ["assign", "access", "hex", "entropy"]
MIXED = r"(?:(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])|(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z]))[A-Za-z0-9+/_=-]{%d,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])" + MIXED
#: Not secrets: UUIDs, dotted or dashed dates and versions, paths of plain words, capitalised words without digits.
ALLOWED = [r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^v?\d++(?:[-_/]\d++)*+[-_/]?$", r"^/?(?:[a-z]++[0-9]{0,4}[/_-])*+(?:[a-z]++[0-9]{0,4})?$", r"^[+/_=-]*+(?:[A-Z]?+[a-z]{2,}+[+/_=-]*+|[A-Za-z][a-z]?+[+/_=-]++)*+(?:[A-Za-z][a-z]?+)?$"]
#: Windows over these words do not count; the rest of the run does.
PLACEHOLDER = r"(?i)example|changeme|placeholder|x{6,}|0123456789|abcdefghijklmnopqrstuvwxyz"


#: Matches in a block of the sums of lengths.
BLOCK = 128
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Characters are numbered from '+' to 'z', twelve to a word of five-bit counts.
FIRST, PER_WORD, BITS = ord("+"), 12, 5
WORDS = -(-(ord("z") + 1 - FIRST) // PER_WORD)
#: One bit of entropy times the window, in fixed point.
UNIT = 1 << 40


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def running(numbers: Column) -> Column:
    """Of an array with at least one number: the sum of those before each."""
    zero = F.lit(0)
    add = lambda s, x: s + x
    block = lambda i: F.floor(i / BLOCK).cast("int")

    def of(xs: Column) -> Column:
        sums = F.transform(F.sequence(zero, block(F.size(xs) - 1)), lambda k: F.aggregate(F.slice(xs, k * BLOCK + 1, BLOCK), zero, add))
        bases = let(sums, lambda all_: F.transform(all_, lambda _, k: F.aggregate(F.slice(all_, 1, k), zero, add)))
        return let(bases, lambda base: F.transform(xs, lambda _, i: F.get(base, block(i)) + F.aggregate(F.slice(xs, block(i) * BLOCK + 1, i % BLOCK), zero, add)))

    return let(numbers, of)


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, part) of the matches whose group, the part, has `least` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    table = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("size"), part.alias("part"))

    def placed(rows: Column) -> Column:
        def of(before: Column) -> Column:
            return F.transform(rows, lambda r, i: F.struct((F.get(before, i) + r["gap"]).alias("start"), (F.get(before, i) + r["gap"] + r["size"]).alias("end"), r["part"].alias("part")))

        return let(running(F.transform(rows, lambda r: r["gap"] + r["size"])), of)

    # Behind the last match lies one gap more.
    found = F.filter(let(F.filter(table, lambda r: r["size"].isNotNull()), placed), lambda m: F.length(m["part"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,part:string>>"))


def as_spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"))).cast(SPAN)


def uncovered(runs: Column, spans: Column) -> Column:
    """The runs that no one span covers; both lists are in order, and neither overlaps itself."""
    none = F.lit(None).cast("string")
    both = F.concat(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(0).alias("is_run"), m["end"].alias("end"), none.alias("part"))), F.transform(runs, lambda m: F.struct(m["start"].alias("start"), F.lit(1).alias("is_run"), m["end"].alias("end"), m["part"].alias("part"))))

    def of(events: Column) -> Column:
        # Spans that begin before a run or with it: the last of them alone can reach its end.
        count = running(F.transform(events, lambda e: 1 - e["is_run"]))
        return let(count, lambda n: F.transform(events, lambda e, i: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["part"].alias("part"), e["is_run"].alias("is_run"), F.get(n, i).alias("n"))))

    free = lambda known: F.filter(let(F.array_sort(both), of), lambda e: (e["is_run"] == 1) & F.coalesce(F.get(known, e["n"] - 1)["end"] < e["end"], F.lit(True)))
    plain = lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["part"].alias("part"))
    return F.when((F.size(spans) == 0) | (F.size(runs) == 0), runs).otherwise(F.transform(let(spans, free), plain))


def fixed_term(n: int) -> int:
    return round(n * math.log2(n) * UNIT) if n > 1 else 0


def least_sum(text: Column, window: int) -> Column:
    """The least sum of n log2 n over the character counts of any window, in fixed point, by incremental counts."""
    terms = F.array(*[F.lit(fixed_term(n)).cast("long") for n in range(window + 2)])
    shift = lambda name, x, n: F.call_function(name, x, n)

    def coded(c: Column) -> Column:
        code = F.ascii(c) - FIRST
        at = ((code % PER_WORD) * BITS).cast("int")
        return F.struct(F.floor(code / PER_WORD).cast("int").alias("word"), at.alias("at"), shift("shiftleft", F.lit(1).cast("long"), at).alias("one"))

    moves = lambda xs: F.transform(xs, lambda x, i: F.struct(x.alias("come"), F.get(xs, i - window).alias("gone"), (i >= window - 1).alias("full")))
    count = lambda acc, x: shift("shiftright", F.get(acc["counts"], x["word"]), x["at"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    change = lambda x, word: F.when(x["word"] == word, x["one"]).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, m: Column) -> Column:
        come, gone = m["come"], m["gone"]
        went, came = F.get(terms, count(acc, gone) - 1) - F.get(terms, count(acc, gone)), F.get(terms, count(acc, come) + 1) - F.get(terms, count(acc, come))
        same = gone.isNotNull() & (gone["word"] == come["word"]) & (gone["at"] == come["at"])
        total = F.when(same, acc["total"]).otherwise(acc["total"] + came + F.coalesce(went, F.lit(0).cast("long")))
        counts = F.when(same, acc["counts"]).otherwise(F.transform(acc["counts"], lambda n, k: n + change(come, k) - change(gone, k)))
        return F.struct(counts.alias("counts"), total.alias("total"), F.when(m["full"], F.least(acc["low"], total)).otherwise(acc["low"]).alias("low"))

    long = lambda n: F.lit(n).cast("long")
    start = F.struct(F.array_repeat(long(0), WORDS).alias("counts"), long(0).alias("total"), long(1 << 62).alias("low"))
    return let(F.transform(F.split(text, ""), coded), lambda xs: F.aggregate(moves(xs), start, step, lambda acc: acc["low"]))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, hex_bits: float = 3.0, base64_bits: float = 3.7) -> DataFrame:
    """Per row: doc_id, base (spans of the fixed patterns) and found (spans by entropy), arrays of (start, rank, kind, end)."""
    if not 2 <= window < 1 << BITS:
        raise ValueError(f"the window has 2 to {(1 << BITS) - 1} characters")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.select("*", *[matches(F.col("text"), pattern, group, least).alias(kind) for kind, pattern, group, least in FIXED], matches(F.col("text"), CANDIDATE % window, 0, window).alias("runs"))
    allowed = lambda x: x.rlike("|".join(f"(?:{p})" for p in ALLOWED))
    most = lambda bits: round((math.log2(window) - bits) * window * UNIT)

    def dense(piece: Column) -> Column:
        limit = F.when(piece.rlike("^[0-9a-fA-F]+$"), F.lit(most(hex_bits))).otherwise(F.lit(most(base64_bits)))
        plain = allowed(F.btrim(piece, F.lit("+/_=-")))
        return F.when(~piece.rlike(f"^{MIXED % window}$") | plain, F.lit(False)).otherwise(least_sum(piece, window) <= limit)

    def secret(run: Column) -> Column:
        # A fixed span other than an assignment lies within one run, so it covers the run if it is the run.
        fixed = run["part"].rlike("^(?:AKIA[A-Z0-9]{14,}|[0-9a-f]{16,})$")
        return F.when(fixed | allowed(run["part"]), F.lit(False)).otherwise(F.exists(F.split(run["part"], PLACEHOLDER, -1), dense))

    found = F.when(F.size("runs") > 0, as_spans(F.filter(uncovered(F.col("runs"), F.col("assign")), secret), "entropy")).otherwise(F.array().cast(SPAN))
    return docs.select("doc_id", F.concat(*[as_spans(F.col(kind), kind) for kind in KINDS[:3]]).alias("base"), found.alias("found"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    many = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "found")).alias("spans"))
