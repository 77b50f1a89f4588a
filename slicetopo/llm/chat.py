r"""Operator 6, chat formatting in budgeted windows, in SQL functions only.

Template: a window is `<s>` and turns; a turn is `[role]text</s>`. In roles and texts
`\`, `[`, `]` and `<` are written `\\`, `\b`, `\c` and `\l`, so no text can hold a
control string, and reading back is exact.

A turn's cost is its words and four marks. Prefix sums of costs choose spans of whole
turns: a span ends before the turn that would pass the budget; a turn over the budget
is a span of its own. Each window holds the conversation's first turn if its role is
system, then as many of the turns before the span as fit into the history budget, then
the span. The loss mask covers the texts of assistant turns of the span; repeated turns
are masked, so each assistant text counts once.

A conversation is one row, an array of turns. Prefix sums and the walk from span to span
are folds whose state is copied in chunks, and where a span or a history ends is found by
halving, so the work grows with the number of turns (times its logarithm), not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import n_words

BUDGET, HISTORY, MARKS = 512, 128, 4
#: Entries that a fold copies at most for each new one.
CHUNK = 256
#: How characters are written; the backslash first.
WRITTEN = (("\\", "\\\\"), ("[", "\\b"), ("]", "\\c"), ("<", "\\l"))
BEGIN, END = "<s>", "</s>"


def escape(x: Column) -> Column:
    for plain, written in WRITTEN:
        x = F.replace(x, F.lit(plain), F.lit(written))
    return x


def unescape(x: Column) -> Column:
    """Pairs of backslashes are found from the left, the rest between them is undone."""

    def rest(p: Column) -> Column:
        for plain, written in WRITTEN[1:]:
            p = F.replace(p, F.lit(written), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(x, r"\\\\", -1), rest), "\\")


def _chunked(items: Column, kind: str, state: dict[str, Column], step) -> Column:
    """A fold over an array that gives an array of a ``kind``. ``step``: from the state's
    fields and an item to (whether there is an entry, the entry, the new fields). Entries are
    kept in chunks, so that a long result isn't copied for each of them."""
    none, empty = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    begin = F.struct(empty.alias("full"), none.alias("part"), *[c.alias(k) for k, c in state.items()])

    def one(a: Column, item: Column) -> Column:
        here, entry, new = step(a, item)
        grown = F.concat(a["part"], F.array(entry.cast(kind)))
        over = here & (F.size(a["part"]) >= CHUNK - 1)
        full = F.when(over, F.concat(a["full"], F.array(grown))).otherwise(a["full"])
        part = F.when(over, none).when(here, grown).otherwise(a["part"])
        return F.struct(full.alias("full"), part.alias("part"), *[c.alias(k) for k, c in new.items()])

    return F.aggregate(items, begin, one, lambda a: F.concat(F.flatten(a["full"]), a["part"]))


def _running(values: Column) -> Column:
    """Prefix sums of an array of longs, from 0; one longer than the array."""
    step = lambda a, v: (F.lit(True), a["sum"] + v, {"sum": a["sum"] + v})
    return F.concat(F.array(F.lit(0).cast("long")), _chunked(values, "bigint", {"sum": F.lit(0).cast("long")}, step))


def _chain(nexts: Column, first: Column, n: Column) -> Column:
    """first, nexts[first], nexts[nexts[first]] ... below n."""
    step = lambda a, goal: (a["at"] == a["goal"], a["at"], {"goal": F.when(a["at"] == a["goal"], goal).otherwise(a["goal"]), "at": a["at"] + 1})
    found = _chunked(nexts, "int", {"goal": first.cast("int"), "at": F.lit(0)}, step)
    # A conversation of nothing but a system turn is one span without turns.
    return F.when(first < n, found).otherwise(F.array(first.cast("int")))


def _last_below(rising: str, n: Column, most: Column) -> Column:
    """The last place, 0 to n, of a rising array at which it is ``most`` at most; 0 if none."""

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"] + 1, 1)
        fits = F.get(F.col(rising), mid) <= most
        return F.struct(F.when(fits, mid).otherwise(a["lo"]).alias("lo"), F.when(fits, a["hi"]).otherwise(F.greatest(mid - 1, a["lo"])).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(n))), F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi")), halve, lambda a: a["lo"])


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, n_turns, windows) with windows array<struct<window int, text string,
    new_from int, loss array<struct<start int, end int>>, n_tokens long, n_repeated int>>.
    Offsets count code points; new_from is where the span's turns begin.

    Rows are ordered by turn, then role and text; null turns come first. A null role or
    text is empty. Rows that repeat a turn are turns of their own. Rows with a null conv_id
    are one conversation. An empty table gives an empty result; further columns are
    ignored. A conversation is put together in one row, as its digest needs it whole."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    conv = conv.select("conv_id", "t", F.size("t").alias("n"), F.when(F.col("t")[0]["role"] == "system", 1).otherwise(0).alias("head"), F.transform("t", lambda t: F.concat(F.lit("["), escape(t["role"]), F.lit("]"))).alias("mark"), F.transform("t", lambda t: escape(t["text"])).alias("body"), F.transform("t", lambda t: (n_words(t["text"]) + MARKS).cast("long")).alias("cost"))
    whole = F.transform(F.arrays_zip("mark", "body"), lambda x: F.concat(x["mark"], x["body"], F.lit(END)))
    conv = conv.withColumn("whole", whole)
    conv = conv.withColumn("cp", _running(F.col("cost"))).withColumn("lp", _running(F.transform("whole", lambda x: F.length(x).cast("long"))))
    free = F.lit(budget) - F.when(F.col("head") == 1, F.col("cost")[0]).otherwise(0) - history
    conv = conv.withColumn("free", F.greatest(free, F.lit(1)))
    at = lambda arr, i: F.get(F.col(arr), i)
    # A span from a turn takes turns as long as their costs fit, and one at least.
    nexts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.greatest(_last_below("cp", F.col("n"), at("cp", i) + F.col("free")), i + 1))
    conv = conv.withColumn("starts", _chain(nexts, F.col("head"), F.col("n")))

    def window(a: Column, w: Column) -> Column:
        b = F.coalesce(F.get(F.col("starts"), w + 1), F.col("n"))
        # The history begins with the first turn, but for the system turn, whose costs up to
        # the span fit.
        past = _last_below("cp", F.col("n"), at("cp", a) - history - 1)
        first_in = F.when(at("cp", a) > history, past + 1).otherwise(0)
        h = F.when(w == 0, a).otherwise(F.greatest(first_in, F.col("head")))
        top = F.lit(len(BEGIN)) + F.when(F.col("head") == 1, at("lp", F.lit(1))).otherwise(0)
        first = F.when(F.col("head") == 1, F.col("whole")[0]).otherwise("")
        text = F.concat(F.lit(BEGIN), first, F.array_join(F.slice("whole", h + 1, b - h), ""))
        begin = lambda i: (top + at("lp", i) - at("lp", h) + F.length(at("mark", i))).cast("int")
        new = F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
        taught = F.filter(new, lambda i: at("t", i)["role"] == "assistant")
        loss = F.transform(taught, lambda i: F.struct(begin(i).alias("start"), (begin(i) + F.length(at("body", i))).alias("end")))
        tokens = F.when(F.col("head") == 1, F.col("cost")[0]).otherwise(0) + at("cp", b) - at("cp", h)
        return F.struct(w.alias("window"), text.alias("text"), (top + at("lp", a) - at("lp", h)).cast("int").alias("new_from"), loss.alias("loss"), tokens.alias("n_tokens"), (a - h).alias("n_repeated"))

    return conv.select("conv_id", F.col("n").alias("n_turns"), F.transform("starts", window).alias("windows"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss string, formatted_chars) from what
    :func:`windows` wrote, by its texts, offsets and masks only."""
    own = lambda x: F.when(x["window"] == 0, F.substr(x["text"], F.lit(len(BEGIN) + 1), F.length(x["text"]))).otherwise(F.substr(x["text"], x["new_from"] + 1, F.length(x["text"])))
    flow = formatted.select("conv_id", F.array_join(F.transform("windows", own), "").alias("flow"), "windows")
    parts = F.split("flow", END, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    turn = lambda p: F.struct(unescape(F.regexp_extract(p, r"(?s)^\[([^\]]*)\]", 1)).alias("role"), unescape(F.regexp_replace(p, r"(?s)^\[[^\]]*\]", "")).alias("text"))
    masked = F.array_join(F.flatten(F.transform("windows", lambda x: F.transform(x["loss"], lambda s: unescape(F.substr(x["text"], s["start"] + 1, s["end"] - s["start"]))))), "")
    chars = F.aggregate("windows", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    return flow.select("conv_id", F.transform(parts, turn).alias("turns"), masked.alias("loss"), chars.alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of each conversation, read back from the windows."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
