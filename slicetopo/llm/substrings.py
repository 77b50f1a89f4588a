"""Operator 12, substring dedup: suffix automata of reference shards, matching statistics
of the documents' passages, and removal of the maximal spans that were met before.

A window is ``k`` consecutive words of one document. A word goes if a window that covers it
also starts in a document with a smaller doc_id. Every document is a reference of the later
ones, so the automata together have no size bound and are not sent to every task: a passage
is sent to the one automaton that can match it.

* Each window names its anchor, the run of ``GRAM`` words in it with the least hash. Windows
  side by side with one anchor make a segment. Equal windows have equal anchors wherever
  they stand.
* Anchors that only one document has are dropped; that leaves the segments that can match.
* Equal segments become one row with the least and the greatest doc_id that has them.
  Segments of an anchor met more than ``COMMON`` times are cut to their windows first, and
  these are dealt by their own hash, so no anchor gathers many contexts in one shard.
* A shard takes about ``SHARD`` segments by their anchors. By rising doc_ids they are
  streamed through the suffix automaton of those before and then added: where the matched
  length reaches ``k``, the state of the last ``k`` words has the least doc_id of the window.
* Windows with a smaller doc_id go back to the documents that hold their segment, and the
  union of a document's windows is its removed spans.

For a reference of bounded size :func:`found_in` broadcasts the automata instead and streams
whole documents through all of them.

Anchors are 64-bit hashes and can only bring segments together in vain; segments are
compared by 128-bit digests and their words.

Null texts and texts without words have no words and keep nothing; the hash is that of the
empty text. A null doc_id counts as the largest number: such rows lose what any document
with an id has, and nothing to each other. Rows of one doc_id don't remove each other's
words. Repeated rows come out as often as they come in. Other columns are not read."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, free, mix, salted_join, tune
from .minhash import KEEP_HASHES, Hashes

#: Words of a window, of an anchor; occurrences from which an anchor is common; segments of a
#: shard, and of an automaton in it.
WINDOW, GRAM, COMMON, SHARD, BUNDLE = 13, 6, 4096, 4000, 64
#: Words that a broadcast reference holds at most, and those of one of its shards.
REFERENCE_WORDS, SHARD_WORDS = 100_000, 10_000
LAST = 2**63 - 1

_hashes = Hashes()


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words as they stand, and the number of words of each text."""
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    if len(_hashes) > KEEP_HASHES:
        _hashes.clear()
    return np.fromiter((_hashes[w] for words in split for w in words), dtype=np.uint64, count=int(counts.sum())), counts


def anchors(h: np.ndarray, counts: np.ndarray, k: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts whose word hashes stand one after the other in ``h``: (text, first
    word in the text, number of windows, hash of the anchor). A run of windows with one
    anchor is cut after as many windows as an anchor can serve where it stands once."""
    none = np.zeros(0, dtype=np.int64)
    if len(h) < k:
        return none, none, none, none
    rolled = np.zeros(len(h) - gram + 1, dtype=np.uint64)
    for j in range(gram):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += h[j : j + len(rolled)]
    least, reach, wanted = mix(rolled), 1, k - gram + 1
    while reach < wanted:
        step = min(reach, wanted - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    n = len(h) - k + 1
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)[:n]
    at = np.flatnonzero(np.arange(n) + k <= ends[text])
    if not len(at):
        return none, none, none, none
    value, text = least[at], text[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(place % wanted == 0)
    runs = np.diff(np.append(first, len(at)))
    return text[first], at[first] - (ends - counts)[text[first]], runs, value[first].view(np.int64)


def _segments(k: int, gram: int):
    def run(batches):
        for b in batches:
            h, counts = word_hashes(b.column("text").to_pylist())
            text, at, n, anchor = anchors(h, counts, k, gram)
            rows = pa.array(text)
            spot = at << 5 | n << 1
            yield pa.RecordBatch.from_arrays([pa.array(anchor), b.column("key").take(rows), b.column("nameless").take(rows), pa.array(spot)], names=["anchor", "key", "nameless", "spot"])

    return run


def _passages(k: int):
    """The words of marked segments; those of common anchors window by window."""

    def run(batches):
        for b in batches:
            marks = b.column("marks")
            ends = np.append(marks.offsets.to_numpy(), 0)[: len(b) + 1].tolist()
            anchor, spot, common = (marks.values.field(c).to_pylist() for c in ("anchor", "spot", "common"))
            owner, at, seg, route, said = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                for m in range(ends[i], ends[i + 1]):
                    start, n = spot[m] >> 5, spot[m] >> 1 & 15
                    for a in range(start, start + n) if common[m] else (start,):
                        what = b" ".join(words[a : a + k] if common[m] else words[a : a + k + n - 1])
                        owner.append(i)
                        at.append(a)
                        seg.append(digest := xxhash.xxh3_128_digest(what))
                        route.append(int.from_bytes(digest[:8], "little", signed=True) if common[m] else anchor[m])
                        said.append(what)
            rows = pa.array(owner, type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("row").take(rows), pa.array(at, type=pa.int32()), pa.array(seg, type=pa.binary()), pa.array(route, type=pa.int64()), pa.array(said, type=pa.binary())], names=["id", "row", "at", "seg", "route", "said"])

    return run


class Automaton:
    """A suffix automaton of word sequences. They are added by rising numbers, so a state that
    is made has the least number of the sequences that hold its words from the start, and one
    that is split off has that of the state it comes from."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [LAST]

    def add(self, said: list[bytes], number: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for word in said:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            self.least.append(number)
            link.append(0)
            p = last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            last = new

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A state for the shorter sequences of ``q`` that end in ``p`` and ``word``."""
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(nxt[q].copy())
        self.length.append(self.length[p] + 1)
        self.least.append(self.least[q])
        link.append(link[q])
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = new
            p = link[p]
        link[q] = new
        return new

    def lengths(self, said: list[bytes]):
        """Matching statistics: how many words that end at each place the automaton holds."""
        state = size = 0
        for word in said:
            to = self.next[state].get(word)
            while to is None and state:
                state = self.link[state]
                size = self.length[state]
                to = self.next[state].get(word)
            if to is not None:
                state = to
                size += 1
            yield size

    def windows(self, said: list[bytes], k: int):
        """Matching statistics, word by word: (start, least number) of the windows of ``k``
        words that the automaton holds."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for i, word in enumerate(said):
            to = nxt[state].get(word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(word)
            if to is not None:
                state = to
                size += 1
                while length[link[state]] >= k:
                    state = link[state]
                    size = length[state]
                if size >= k:
                    yield i - k + 1, self.least[state]


def _shard(k: int):
    """Streams a shard's segments through the automaton of those with smaller documents, then
    adds them. An automaton takes the segments of a few anchors, so that it stays in a
    processor's cache; what it doesn't hold, the segment's own first document has first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bundle", "ascending"), ("low", "ascending")])
        bundle, low, high, key, said = (table.column(c).to_pylist() for c in ("bundle", "low", "high", "seg", "said"))
        seg, off, least = [], [], []
        automaton, at = Automaton(), None
        for b, first, last, name, words in zip(bundle, low, high, key, said, strict=True):
            if b != at:
                automaton, at = Automaton(), b
            words = words.split(b" ")
            met = dict(automaton.windows(words, k))
            for start in range(len(words) - k + 1) if first < last else met:
                seg.append(name)
                off.append(start)
                least.append(met.get(start, first))
            automaton.add(words, first)
        return pa.table({"seg": pa.array(seg, type=pa.binary()), "off": pa.array(off, type=pa.int32()), "least": pa.array(least, type=pa.int64())})

    return run


def _kept(k: int):
    def run(batches):
        for b in batches:
            n_words, n_removed, digest = [], [], []
            for text, starts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                if starts:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.unique(np.array(starts))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + k, -1)
                    kept = [w for w, gone in zip(words, (np.cumsum(edge)[:-1] > 0).tolist(), strict=True) if not gone]
                else:
                    kept = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append((b" ".join(kept)).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, type=pa.int64()), pa.array(n_removed, type=pa.int64()), pa.array(digest, type=pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def repeated_windows(rows: DataFrame, k: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, row, starts): windows that also start in a row with a smaller id. ``rows`` has
    text, id, row, which tells different texts of one id apart, and key, by which a row finds
    what was learnt of its segments; nameless says that the id is no number of its own. A
    segment's place and length travel as one number."""
    spark = rows.sparkSession
    found = cut(rows.mapInArrow(_segments(k, gram), "anchor long, key long, nameless boolean, spot long").select("anchor", "key", (F.col("spot") + F.col("nameless").cast("long")).alias("spot")))
    who = F.when(F.col("spot") % 2 == 1, F.lit(LAST)).otherwise(F.col("key"))
    shared = cut(found.groupBy("anchor").agg(F.min(who).alias("low"), F.max(who).alias("high"), F.count("*").alias("n")).where("low < high").select("anchor", "n"))
    free(spark)
    marks = salted_join(found, shared.select("anchor", (F.col("n") > COMMON).alias("common")), ["anchor"], shared, ["key", "spot"])
    marks = cut(marks.groupBy("key").agg(F.collect_set(F.struct("anchor", "spot", "common")).alias("marks")))
    drop(found)
    drop(shared)
    free(spark)
    passages = cut(rows.join(marks, "key").mapInArrow(_passages(k), "id long, row long, at int, seg binary, route long, said binary"))
    drop(marks)
    free(spark)
    segs = cut(passages.groupBy("seg", "route", "said").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")))
    free(spark)
    shards = max(1, -(-segs.count() // SHARD))
    place = F.pmod("route", F.lit(shards))
    bundle = F.pmod(F.shiftright("route", 20), F.lit(SHARD // BUNDLE))
    hits = segs.select("seg", "low", "high", "said", place.alias("shard"), bundle.alias("bundle")).groupBy("shard").applyInArrow(_shard(k), "seg binary, off int, least long")
    hits = cut(hits.groupBy("seg").agg(F.collect_list(F.struct("off", "least")).alias("hits")))
    free(spark)
    met = salted_join(passages.select("id", "row", "at", "seg"), hits, ["seg"], segs.select("seg", "n"), ["id", "row", "at"])
    met = met.select("id", "row", F.explode(F.transform(F.filter("hits", lambda h: h["least"] < F.col("id")), lambda h: F.col("at") + h["off"])).alias("start"))
    out = cut(met.groupBy("id", "row").agg(F.collect_set("start").alias("starts")))
    for t in (passages, segs, hits):
        drop(t)
    free(spark)
    return out


def without_repeats(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` has the words that stay, joined by one
    space."""
    spark = docs.sparkSession
    tune(spark)
    # A join's smaller side is held as a map where its partitions are small, without sorting.
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "32m")
    number, text = F.col("doc_id").cast("long"), F.xxhash64("text")
    rows = docs.select("doc_id", "text", F.coalesce(number, F.lit(LAST)).alias("id"), text.alias("row"), F.coalesce(number, text).alias("key"), number.isNull().alias("nameless"))
    spans = repeated_windows(rows.where("text is not null").select("text", "id", "row", "key", "nameless"), k)
    return rows.join(spans, ["id", "row"], "left").select("doc_id", "text", "starts").mapInArrow(_kept(k), "doc_id long, n_words long, n_removed long, kept string")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _automata(table: pa.Table) -> pa.Table:
    automaton = Automaton()
    for text in table.column("text").to_pylist():
        automaton.add(text.encode("utf-8", "surrogatepass").split(), 0)
    return pa.table({"automaton": pa.array([pickle.dumps((automaton.next, automaton.link, automaton.length))], type=pa.binary())})


def found_in(docs: DataFrame, reference: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, start, length): the maximal runs of ``k`` words or more that a document shares
    with a text of ``reference`` (text), which may hold ``REFERENCE_WORDS`` words and raises
    beyond that. Automata of its shards are broadcast, and whole documents stream through
    all of them; a run within another of the same shard or of another is left out. Null and
    empty texts share nothing; repeated rows come out as often as they come in."""
    spark = docs.sparkSession
    tune(spark)
    own = reference.where("text is not null").select("text").distinct()
    n = own.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if n > REFERENCE_WORDS:
        raise ValueError(f"a reference of {n} words is larger than {REFERENCE_WORDS}; use without_repeats")
    shard = F.pmod(F.xxhash64("text"), F.lit(max(1, -(-n // SHARD_WORDS))))
    built = own.withColumn("shard", shard).groupBy("shard").applyInArrow(_automata, "automaton binary").collect()
    shared = spark.sparkContext.broadcast([bytes(r["automaton"]) for r in built])

    def run(batches):
        automata = []
        for packed in shared.value:
            a = Automaton()
            a.next, a.link, a.length = pickle.loads(packed)
            automata.append(a)
        for b in batches:
            row, start, length = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                longest = np.zeros(len(words) + 1, dtype=np.int64)
                for a in automata if len(words) >= k else ():
                    longest[: len(words)] = np.maximum(longest[: len(words)], np.fromiter(a.lengths(words), dtype=np.int64, count=len(words)))
                # A run ends where the next word does not make it longer.
                ends = np.flatnonzero((longest[:-1] >= k) & (longest[1:] <= longest[:-1]))
                row += [i] * len(ends)
                start += (ends - longest[ends] + 1).tolist()
                length += longest[ends].tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, type=pa.int64())), pa.array(start, type=pa.int64()), pa.array(length, type=pa.int64())], names=["doc_id", "start", "length"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long")
