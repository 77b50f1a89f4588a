"""Operator 8, quality rules with adaptive thresholds, in SQL functions only.

Each document's features are computed from its whole text. Per (language, source) a
mergeable quantile sketch summarises each ratio: counts of buckets whose width is a fixed
step for small values and a 4,096th of the value for large ones. Sketches merge by adding
counts, in any order and without random numbers, so reruns agree, and a sketch has at most
some 100,000 counts whatever it has seen. The sketches of a language and of the corpus
stand in for groups with few documents.

A threshold is a quartile plus a multiple of the group's spread: the distance of the
quartiles, or, for ratios that are zero for most documents, the distance from the median to
the ninth decile if that is larger. On top comes what a single text varies by chance: a few
symbols or lines, or for the mean word length a part that falls with the root of the number
of words. So a group without any spread doesn't reject a text for one symbol. The
thresholds, one row per group, are joined to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, salted_join

WINDOW = 8
#: How many spreads a document may be outside.
REACH = 4
#: What one text varies by chance: symbols, repeated lines, and characters of the mean word
#: length of a text of one word.
CHANCE = {"symbols": 3, "doubled": 3, "length": 3}
#: Steps in one of each ratio.
STEPS = {"symbols": 10_000, "doubled": 1_000, "length": 100}
#: Documents below which a group takes its language's thresholds, or the corpus'.
FEW = 100
#: Values from which a sketch's buckets widen.
FINE = 4096
#: Groups up to which the thresholds are broadcast; more are joined by a shuffle.
SMALL = 100_000


def features(docs: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines and
    n_repeat_words of whole texts; a null text has none of anything."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(*kept, text.alias("text")).withColumn("words", F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    n = F.size("words")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<long>"))
    two = one.select(*kept, n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("hashes"))
    # Only texts in which a window comes twice are sorted.
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    three = two.withColumn("by_hash", F.when(twice, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("hashes")
    same = lambda x, k: F.coalesce(F.get(F.col("by_hash"), k)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.filter(F.transform("by_hash", lambda x, k: F.when(F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1), x["i"])), lambda i: i.isNotNull()))
    four = three.withColumn("starts", starts).drop("by_hash")
    covered = F.aggregate("starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last")), lambda a: a["n"])
    return four.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("starts")


#: Each ratio as (part, whole).
RATIOS = {"symbols": ("n_symbols", "word_chars"), "doubled": ("n_dup_lines", "n_lines"), "length": ("word_chars", "n_words")}


def bucket(part: Column, whole: Column, steps: int) -> Column:
    """The lower end of a ratio's bucket, in steps; whole numbers only."""
    q = F.floor(part * steps / F.greatest(whole, F.lit(1))).cast("long")
    wide = F.greatest(F.length(F.bin(q)) - (FINE.bit_length() - 1), F.lit(0))
    return q - F.pmod(q, F.pow(F.lit(2.0), wide).cast("long"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, r, b, n): counts of the buckets b of each ratio r of every group."""
    each = F.array(*[F.struct(F.lit(r).alias("r"), bucket(F.col(p), F.col(w), STEPS[r]).alias("b")) for r, (p, w) in RATIOS.items()])
    return measured.select("lang", "source", F.explode(each).alias("x")).groupBy("lang", "source", "x.r", "x.b").agg(F.count("*").alias("n"))


def bars(sketch: DataFrame, *group: str) -> DataFrame:
    """(group, n, and r_lo and r_hi of each ratio r, in steps) from the sketches of groups.
    A window's partition is one sketch, whose size is bounded."""
    merged = sketch.groupBy(*group, "r", "b").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*group, "r")
    ranked = merged.withColumns({"upto": F.sum("n").over(of.orderBy("b")), "all": F.sum("n").over(of)})
    q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("b")))
    per = ranked.groupBy(*group, "r").agg(F.max("all").alias("n"), q(25).alias("q25"), q(50).alias("q50"), q(75).alias("q75"), q(90).alias("q90"))
    spread = F.col("q75") - F.col("q25")
    tail = F.greatest(spread, F.when(F.col("r") != "length", F.col("q90") - F.col("q50")).otherwise(0))
    per = per.select(*group, "r", "n", (F.col("q25") - REACH * spread).alias("lo"), (F.col("q75") + REACH * tail).alias("hi"))
    pick = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{r}_{c}")
    return per.groupBy(*group).agg(F.max("n").alias("n"), *[pick(r, c) for r in RATIOS for c in ("lo", "hi")])


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, n, and r_lo and r_hi of each ratio r, in steps) of every group; those
    of a group with few documents are its language's, or the corpus'."""
    own = cut(sketches(measured))
    names = [f"{r}_{c}" for r in RATIOS for c in ("lo", "hi")]
    by_lang = bars(own, "lang").select(F.col("lang").alias("_lang"), F.col("n").alias("n_l"), *[F.col(c).alias(f"{c}_l") for c in names])
    whole = bars(own).first()  # one row of numbers
    wide = bars(own, "lang", "source").join(by_lang, F.col("lang") == F.col("_lang"))
    pick = lambda c: F.when(F.col("n") >= FEW, F.col(c)).when(F.col("n_l") >= FEW, F.col(f"{c}_l")).otherwise(F.lit(whole[c]))
    return cut(wide.select("lang", "source", "n", *[pick(c).alias(c) for c in names]))


def inside() -> Column:
    """Whether a document is within its group's thresholds; null without thresholds."""
    most = lambda r: F.col(RATIOS[r][0]) * STEPS[r] <= F.col(f"{r}_hi") * F.col(RATIOS[r][1]) + CHANCE[r] * STEPS[r]
    mean = F.floor(F.col("word_chars") * STEPS["length"] / F.greatest("n_words", F.lit(1)))
    slack = CHANCE["length"] * STEPS["length"] / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))
    return most("symbols") & most("doubled") & (mean >= F.col("length_lo") - slack) & (mean <= F.col("length_hi") + slack)


def judge(docs: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns, the features, base_failed and kept for every row.

    Null, empty and wordless texts have zeros, fail the base rule and teach no threshold.
    A null language or source is a group of its own; an empty name is none that differs
    from it. Equal ratios share a bucket. Repeated rows get equal results; an empty table
    gives an empty result; further columns are ignored, and a kept column that is named
    like a result gives way to it."""
    results = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    kept = [c for c in kept if c not in (*results, "lang", "source")]
    named = docs.select(*kept, F.col("text"), *[F.concat(F.lit("="), F.col(c)).alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")])
    named = named.withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source")})
    measured = cut(features(named, *kept, "lang", "source"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = thresholds(measured.where("n_words >= 20"))
    if found.count() <= SMALL:
        joined = measured.join(F.broadcast(found.drop("n")), ["lang", "source"], "left")
    else:
        joined = salted_join(measured, found.drop("n"), ["lang", "source"], found.select("lang", "source", "n"), ["word_chars", "n_words", "n_symbols"], "left")
    return joined.select(*kept, *results[:3], "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(inside(), F.lit(True))).alias("kept"), "n_lines")
