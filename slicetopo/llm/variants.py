"""Operator 11, spelling variant grouping: minimal acyclic automata of the vocabulary,
forward and backward, with perfect-hash word numbers.

Words of one error differ in one half only. So a near word either begins with the first half
of a word or ends with its second half: the half is matched exactly, forward in an automaton
of the words or backward in one of the reversed words, and the rest is completed with one
inserted, deleted or replaced code point. Paths through an automaton number its words in
order, so a number gives the count of the word that was reached. What both directions find
is taken once.

The vocabulary grows with the corpus, so it is dealt over shards: a word asks in the shard of
its exact half, and it can be found in the shards of the halves of all words that are one
error away, which are those of its own half and of one that is a code point shorter or
longer. Every shard has its own automaton of about ``SHARD`` words; nothing is broadcast.

Counting is done by SQL functions with a partial count in every task. ``doc_id`` and run
decide whether and where a code point is deleted; a null doc_id counts as no text. Null and
empty texts have no words. Repeated rows count as often as they stand; other columns are not
read. Words of equal counts are ordered by code points."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, tune

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, TIMES, DELETES = 6, 5, 5, 199
#: Words of a shard, each in one direction and for one of its halves.
SHARD = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(doc_id: Column, run: Column) -> Column:
    """``run`` without one code point, where the checksum of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(h % DELETES == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n). Runs that are too short to make a word are not read out."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least_length},}})"), 1)).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), F.translate("run", _UPPER, _LOWER)).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Numbered:
    """A minimal acyclic automaton of sorted distinct words. Every state knows how many words
    end below it, so a path counts the words before it."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.below: list[int] = []
        self._same: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        said = ""
        for word in words:
            common = 0
            while common < min(len(said), len(word)) and said[common] == word[common]:
                common += 1
            self._fold(path, said, common)
            for _ in word[common:]:
                path.append(({}, False))
            path[-1] = path[-1][0], True
            said = word
        self._fold(path, said, 0)
        self.start = self._state(*path[0])

    def _fold(self, path: list, said: str, upto: int) -> None:
        while len(path) > upto + 1:
            state = self._state(*path.pop())
            path[-1][0][said[len(path) - 1]] = state

    def _state(self, edges: dict[str, int], final: bool) -> int:
        """The state with these edges; equal states are one."""
        key = (final, *edges.items())
        found = self._same.get(key)
        if found is None:
            found = self._same[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(final)
            self.below.append(final + sum(self.below[x] for x in edges.values()))
        return found

    def step(self, state: int, number: int, letter: str) -> tuple[int, int] | None:
        """Where ``letter`` leads, and the number of words before that."""
        if letter not in self.edges[state]:
            return None
        number += self.final[state]
        for c, to in self.edges[state].items():
            if c == letter:
                return to, number
            number += self.below[to]

    def walk(self, state: int, number: int, rest: str) -> int | None:
        """The number of the word that ends after ``rest``."""
        for letter in rest:
            to = self.step(state, number, letter)
            if to is None:
                return None
            state, number = to
        return number if self.final[state] else None

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with ``half`` letters of ``word`` and differ from
        it by one error after them."""
        state, number, found = self.start, 0, set()
        for letter in word[:half]:
            to = self.step(state, number, letter)
            if to is None:
                return found
            state, number = to
        for i in range(half, len(word) + 1):
            rest, after = word[i:], word[i + 1 :]
            if rest:
                found.add(self.walk(state, number, after))  # the letter is deleted
            at = number + self.final[state]
            for c, to in self.edges[state].items():
                found.add(self.walk(to, at, rest))  # c is inserted
                if rest and c != rest[0]:
                    found.add(self.walk(to, at, after))  # c stands instead
                at += self.below[to]
            to = self.step(state, number, rest[0]) if rest else None
            if to is None:
                break
            state, number = to
        return found - {None}


def _pairs(table: pa.Table) -> pa.Table:
    """(word, n, near, near_n) of one shard."""
    counts = dict(zip(table.column("key").to_pylist(), table.column("n").to_pylist(), strict=True))
    words = sorted(counts)
    automaton = Numbered(words)
    back = table.column("back")[0].as_py()
    out: list[tuple] = []
    for key, n, half, asks in zip(*(table.column(c).to_pylist() for c in ("key", "n", "half", "asks")), strict=True):
        if asks:
            for number in automaton.near(key, half):
                other = words[number]
                if other != key:
                    out.append((key, n, other, counts[other]))
    if back:
        out = [(w[::-1], n, o[::-1], m) for w, n, o, m in out]
    word, n, near, near_n = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"word": pa.array(word, type=pa.string()), "n": pa.array(n, type=pa.int64()), "near": pa.array(near, type=pa.string()), "near_n": pa.array(near_n, type=pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): pairs of words of one error, in both orders. ``words``: (word,
    n). Forward a word asks with its first half and is found by the halves of words one
    shorter to one longer; backward likewise from its end, where the half is the longer."""
    length = F.length("word")
    shards = max(1, -(-2 * words.count() // SHARD))

    def side(back: bool) -> DataFrame:
        key = F.reverse("word") if back else F.col("word")
        own = F.ceil(length / 2) if back else F.floor(length / 2)
        # Halves with which words one shorter, equal and one longer ask.
        halves = F.array_distinct(F.array(*[(F.ceil((length + d) / 2) if back else F.floor((length + d) / 2)).cast("int") for d in (-1, 0, 1)]))
        rows = words.select(key.alias("key"), "n", own.cast("int").alias("own"), F.explode(halves).alias("half"))
        shard = F.pmod(F.xxhash64("half", F.substring("key", F.lit(1), F.col("half"))), F.lit(shards))
        return rows.select("key", "n", "half", (F.col("half") == F.col("own")).alias("asks"), F.lit(back).alias("back"), shard.alias("shard"))

    found = side(False).unionByName(side(True)).groupBy("back", "shard").applyInArrow(_pairs, "word string, n long, near string, near_n long")
    return found.distinct()


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n): of a word's near words the one of largest n, of equal
    ones the first in code-point order, if its n is ``times`` the word's or more."""
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.m") >= times * F.col("n")
    return words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n). Counts rise ``times`` with every form, so there
    are few steps to a root; each round doubles them until no root has a form."""
    tune(docs.sparkSession)
    words = cut(vocabulary(docs))
    found = cut(forms(words, times))
    drop(words)
    steps = found.where("form is not null").select(F.col("word").alias("_at"), F.col("form").alias("_to"))
    rows = found.withColumn("root", F.coalesce("form", "word"))
    while True:
        far = rows.join(steps, F.col("root") == F.col("_at"), "left")
        rows = cut(far.select(*found.columns, F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")))
        if not rows.where("_moved").limit(1).count():
            return rows.select("word", "form", "root", "n", "n_near", "form_n")
        ahead = steps.toDF("_a", "_b").join(steps.toDF("_c", "_d"), F.col("_b") == F.col("_c"), "left")
        steps = cut(ahead.select(F.col("_a").alias("_at"), F.coalesce("_d", "_b").alias("_to")))
        rows = rows.drop("_moved")
