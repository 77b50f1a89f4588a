"""Operator 3, toxicity: a linear-chain conditional random field tags toxic words;
forward-backward marginals give document scores and the offending offsets.

A token is a run of letters; a chain ends with a sentence or after ``CHAIN`` tokens. The
field has weights of hashed features of the word (itself, its prefixes, its length class),
a bias, and transition weights between the labels of neighbours. All are trained together
by gradient steps on the chains' likelihood: forward-backward gives the expected labels and
the expected pairs of labels, and the gradient is what was expected less what was given.
Training and scoring use the same tokens, chains and features.

Labels are given for documents, not for tokens. Token labels are derived from them:
stems (word prefixes of four to seven letters, and whole words) that occur in toxic
documents far oftener than chance allows, and not in clean ones, mark the tokens of
toxic documents that carry them; every token of a clean document is clean.

A document's score is the chance that one of its ``TOP`` likeliest tokens is toxic, taken
as independent: 1 - product of (1 - marginal). Marginals of all tokens are computed; taking
the likeliest keeps the score from growing with a clean text's length.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, tune
from .minhash import forget_words, shingle_sets

#: Training uses at most this many toxic and this many clean labelled documents, chosen
#: by hash, with at most so many characters in each class.
SAMPLE = {1: 1500, 0: 3500}
SAMPLE_CHARS = 6_000_000
WIDTH = 1 << 18
CHAIN = 64
BAR = 0.7
TOP = 4
#: Tokens that are scored at once; a longer text is scored alone.
AT_ONCE = 250_000
KEEP_WORDS = 400_000
#: A word, or the end of a sentence.
TOKEN = re.compile(r"[^\W\d_]+|[.!?](?=\s|$)")
END = ".!?"


def stems(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in range(4, 8) if n <= len(word))]


def features(word: str) -> list[int]:
    names = [f"={word}", f"#{min(len(word), 9)}", *(word[:n] for n in range(3, 8) if n <= len(word))]
    return [xxhash.xxh32_intdigest(x) % WIDTH for x in names]


def stems_of(text: str) -> set:
    return {x for w in {t.lower() for t in set(TOKEN.findall(text)) if t not in END} for x in stems(w)}


def cues(docs: list[tuple[str, int]]) -> set:
    """Stems that mark toxic documents, from (text, label) pairs: those that chance would
    hardly put into so many toxic and so few clean documents. Below the strict bar a whole
    word must not be in any clean document, and a beginning of words must explain toxic
    documents that no better one explains. Only stems of three toxic
    documents or more are kept while counting, which bounds the memory."""
    n, pos = len(docs), sum(y for _, y in docs)
    if not pos or pos == n:
        return set()
    rate = pos / n
    toxic: Counter = Counter()
    for text, y in docs:
        if y:
            toxic.update(stems_of(text))
    toxic = Counter({x: t for x, t in toxic.items() if t >= 3})
    clean: Counter = Counter()
    for text, y in docs:
        if not y:
            clean.update(x for x in stems_of(text) if x in toxic)
    able = {x for x, t in toxic.items() if clean[x] <= 0.02 * t}
    where: dict[str, set] = defaultdict(set)
    left = set()
    for i, (text, y) in enumerate(docs):
        if y:
            left.add(i)
            for x in stems_of(text) & able:
                where[x].add(i)

    def odds(t: int, c: int) -> float:
        """Log of the chance of t toxic ones among t + c documents, by Chernoff."""
        q = t / (t + c)
        if q <= rate:
            return 0.0
        return (t + c) * (q * math.log(q / rate) + ((1 - q) * math.log((1 - q) / (1 - rate)) if q < 1 else 0))

    seen = math.log(len(toxic) + 1)
    strict, loose = seen + 5, seen + 2
    out = set()
    ranked = sorted(((odds(toxic[x], clean[x]), x) for x in able), key=lambda r: (-r[0], len(r[1]), r[1]))
    for o, x in ranked:
        if o >= strict or (o >= loose and not clean[x] and (x.startswith("=") or len(where[x] & left) >= 3)):
            out.add(x)
            left -= where[x]
    return out


def chains(tokens: list[str]) -> tuple[list[str], list[int]]:
    """Words, and where chains of them start; ends of sentences are none."""
    words, starts, fresh, since = [], [], True, 0
    for t in tokens:
        if t in END:
            fresh = True
            continue
        if fresh or since == CHAIN:
            starts.append(len(words))
            fresh, since = False, 0
        words.append(t)
        since += 1
    return words, starts


class Layout:
    """Chains side by side, the longest first: the tokens at place t of all chains that have
    one are a run of ``order`` from ``at[t]`` to ``at[t + 1]``."""

    def __init__(self, starts: np.ndarray, lens: np.ndarray):
        by = np.argsort(-lens, kind="stable")
        n = lens[by]
        self.longest = int(n[0]) if len(n) else 0
        alive = np.searchsorted(-n, -np.arange(self.longest), side="left")  # chains longer than t
        self.at = np.concatenate([[0], np.cumsum(alive)])
        self.order = np.concatenate([starts[by[:k]] + t for t, k in enumerate(alive)]) if self.longest else np.zeros(0, dtype=np.int64)

    def run(self, t: int) -> slice:
        return slice(int(self.at[t]), int(self.at[t + 1]))


def forward_backward(e: np.ndarray, layout: Layout, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of label 1, expected numbers of pairs of labels, and the logarithm of all
    chains' sums. ``e``: log potentials of label 1 against label 0."""
    x = np.exp(np.clip(e[layout.order], -30, 30))
    m = np.exp(trans)
    f0, f1 = np.ones(len(x)), x.copy()
    total = 0.0
    for t in range(layout.longest):
        now = layout.run(t)
        if t:
            before = layout.run(t - 1)
            k = now.stop - now.start
            p0, p1 = f0[before][:k], f1[before][:k]
            f0[now] = p0 * m[0, 0] + p1 * m[1, 0]
            f1[now] = (p0 * m[0, 1] + p1 * m[1, 1]) * x[now]
        z = f0[now] + f1[now]
        f0[now] /= z
        f1[now] /= z
        total += float(np.log(z).sum())
    marg = np.zeros(len(x))
    pairs = np.zeros((2, 2))
    b0, b1 = np.ones(len(x)), np.ones(len(x))
    for t in range(layout.longest - 1, -1, -1):
        now = layout.run(t)
        if t + 1 < layout.longest:
            after = layout.run(t + 1)
            k = after.stop - after.start
            n0, n1 = b0[after], b1[after] * x[after]
            u0, u1 = f0[now][:k], f1[now][:k]
            joint = [[u0 * m[0, 0] * n0, u0 * m[0, 1] * n1], [u1 * m[1, 0] * n0, u1 * m[1, 1] * n1]]
            z = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
            pairs += [[float((c / z).sum()) for c in row] for row in joint]
            c0, c1 = m[0, 0] * n0 + m[0, 1] * n1, m[1, 0] * n0 + m[1, 1] * n1
            b0[now][:k], b1[now][:k] = c0 / (c0 + c1), c1 / (c0 + c1)
        p0, p1 = f0[now] * b0[now], f1[now] * b1[now]
        marg[now] = p1 / (p0 + p1)
    out = np.zeros(len(e))
    out[layout.order] = marg
    return out, pairs, total


def one_of_each(docs: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without near copies of earlier texts, whose shared words would look like cues:
    a text goes if one of eight minima over its three-word shingles was seen."""
    seen: set = set()
    out = []
    for text, y in docs:
        s = shingle_sets([text], 3)[0]
        if len(s):
            low = {(j, y, int(mix(s + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64)).min())) for j in range(8)}
            if not low & seen:
                out.append((text, y))
            seen |= low
    forget_words()
    return out


class Field:
    """Chains of words with features, their labels, and the likelihood of weights."""

    def __init__(self, texts):
        """``texts``: (words, starts of chains, labels) of each text; only distinct words stay."""
        ids: dict[str, int] = {}
        rows, gold, starts = array("i"), array("b"), array("q")
        for words, begin, labels in texts:
            starts.extend(len(rows) + s for s in begin)
            rows.extend(ids.setdefault(w, len(ids)) for w in words)
            gold.extend(labels)
        self.rows = np.array(rows, dtype=np.int32)
        self.gold = np.array(gold, dtype=np.float64)
        begin = np.array(starts, dtype=np.int64)
        self.layout = Layout(begin, np.diff(np.append(begin, len(self.rows))))
        own = [features(w) for w in ids]
        self.flat = np.array([f for fs in own for f in fs], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(own)), [len(f) for f in own])
        self.n_words = len(ids)
        later = np.ones(len(self.rows), dtype=bool)
        later[begin] = False
        later = np.flatnonzero(later)
        self.seen = np.zeros((2, 2))
        np.add.at(self.seen, (self.gold[later - 1].astype(int), self.gold[later].astype(int)), 1)

    def gradient(self, w: np.ndarray, bias: float, trans: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        """Log likelihood of the labels, and its gradient by weights, bias and transitions."""
        logit = np.bincount(self.owner, weights=w[self.flat], minlength=self.n_words) + bias
        e = logit[self.rows]
        marg, pairs, total = forward_backward(e, self.layout, trans)
        off = self.gold - marg
        by_word = np.bincount(self.rows, weights=off, minlength=self.n_words)
        like = float((e * self.gold).sum() + (self.seen * trans).sum()) - total
        return like, np.bincount(self.flat, weights=by_word[self.owner], minlength=len(w)), float(off.sum()), self.seen - pairs


def train(docs: list[tuple[str, int]], epochs: int = 25, rate: float = 1.0, keep: float = 1e-3) -> dict:
    """Field weights from (text, label) pairs: gradient steps with a step size of each
    weight that shrinks with its past gradients; ``keep`` pulls weights to 0."""
    docs = one_of_each(docs)
    bad = cues(docs)
    w, trans = np.zeros(WIDTH), np.zeros((2, 2))
    marks: dict[str, int] = {}

    def texts():
        for text, y in docs:
            words, starts = chains(TOKEN.findall(text))
            words = [x.lower() for x in words]
            if y:
                for x in set(words).difference(marks):
                    marks[x] = int(any(z in bad for z in stems(x)))
            yield words, starts, [marks[x] for x in words] if y else [0] * len(words)

    field = Field(texts()) if bad else None
    if field is None or not len(field.rows):
        return {"w": w.astype(np.float32), "bias": -30.0, "trans": trans}
    bias, w2, b2, t2 = -6.0, np.full(WIDTH, 1e-2), 1.0, np.ones((2, 2))
    for _ in range(epochs):
        _, gw, gb, gt = field.gradient(w, bias, trans)
        gw -= keep * w
        w2 += gw**2
        w += rate * gw / np.sqrt(w2)
        b2 += gb**2
        bias += 0.4 * rate * gb / math.sqrt(b2)
        gt[:, 0] = 0  # going to label 0 is the measure
        t2 += gt**2
        trans += 0.4 * rate * gt / np.sqrt(t2)
    return {"w": w.astype(np.float32), "bias": float(bias), "trans": trans}


def sample(docs: DataFrame, labels: DataFrame, most: dict | None = None, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most ``most[y]`` documents of each class y, in hash order of
    their ids, and at most ``chars`` characters of each class: a bound that does not grow
    with the input. Ids are chosen from ``labels`` (_id, y) alone, and only the chosen
    ones, a bounded set, meet the texts."""
    most = most or SAMPLE
    rows = []
    for y in (1, 0):
        picked = labels.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most[y])
        own = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select(F.xxhash64("_id").alias("h"), "_id", "text")
        room = chars
        for r in own.orderBy("h", "_id", "text").limit(most[y]).toLocalIterator():
            if len(r["text"]) <= room:  # a text that doesn't fit is left out, later ones may
                room -= len(r["text"])
                rows.append((r["text"], y))
    return rows


class Scorer:
    """Scores and spans of texts by a trained field."""

    def __init__(self, model: dict):
        self.w, self.bias, self.trans = model["w"].astype(np.float64), model["bias"], model["trans"]
        self.known: dict[str, float] = {}

    def odds(self, words: list[str]) -> np.ndarray:
        """Log odds of tokens by themselves; those of words that were met are kept."""
        if len(self.known) > KEEP_WORDS:
            self.known.clear()
        new = list(set(words).difference(self.known))
        if new:
            at = [features(x.lower()) for x in new]
            size = np.array([len(x) for x in at])
            own = np.add.reduceat(self.w[np.array([f for x in at for f in x])], np.cumsum(size) - size) + self.bias
            self.known.update(zip(new, own.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.float64, count=len(words))

    def score(self, texts: list) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        scores, spans = np.zeros(len(texts)), [[] for _ in texts]
        words: list[str] = []
        starts: list[int] = []
        held: list[tuple[int, int]] = []  # text, number of its words
        for i, t in enumerate(texts):
            if t:
                own, begin = chains(TOKEN.findall(t))
                starts += [len(words) + s for s in begin]
                words += own
                held.append((i, len(own)))
            if words and (len(words) >= AT_ONCE or i + 1 == len(texts)):
                self._score(texts, words, starts, held, scores, spans)
                words, starts, held = [], [], []
        return scores, spans

    def _score(self, texts, words, starts, held, scores, spans) -> None:
        begin = np.array(starts, dtype=np.int64)
        marg, _, _ = forward_backward(self.odds(words), Layout(begin, np.diff(np.append(begin, len(words)))), self.trans)
        at = 0
        for i, n in held:
            own = marg[at : at + n]
            at += n
            if not n:
                continue
            top = own if n <= TOP else np.partition(own, n - TOP)[n - TOP :]
            scores[i] = -math.expm1(float(np.log1p(-np.minimum(top, 1 - 1e-9)).sum()))
            hit = set(np.flatnonzero(own >= 0.5).tolist())
            if hit:
                places = [m.span() for m in TOKEN.finditer(texts[i]) if m.group() not in END]
                spans[i] = [places[j] for j in sorted(hit)]


def _scorer(shared, with_text: bool):
    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            score, spans = scorer.score(b.column("_text").to_pylist())
            flat = [{"start": s, "end": t} for x in spans for s, t in x]
            offs = np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int32)
            kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            kept = [c for c in b.schema.names if with_text or c != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(score), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, type=kind))], names=[*kept, "_score", "_spans"])

    return run


def _scored(docs: DataFrame, labels: DataFrame, keep: list[str], text: bool) -> DataFrame:
    """Columns ``_0``, ``_1`` ... of ``keep``, _text if ``text``, _score and _spans. The
    input's names don't matter, so none can clash."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(train(sample(docs, labels)))
    own = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if text or f.name != "_text")
    return own.mapInArrow(_scorer(shared, text), f"{kinds}, _score double, _spans array<struct<start:int,end:int>>")


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, bar: float = BAR) -> DataFrame:
    """``keep`` columns of ``docs``, score, spans (offsets of toxic words, in code points)
    and predicted. ``labels`` has (_id, y); ids without a text teach nothing. Null, empty
    and wordless texts score 0; without a toxic example every score is as good as 0. A
    score that equals the bar is predicted 1. Repeated rows score alike; an empty table
    gives an empty result. A kept column that is named like a result gives way to it."""
    keep = [c for c in keep or ["doc_id"] if c.lower() not in ("score", "spans", "predicted")]
    out = _scored(docs, labels, keep, False)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.col("_score").alias("score"), F.col("_spans").alias("spans"), F.when(F.col("_score") >= bar, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, bar: float = BAR) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the bar."""
    keep = [c for c in docs.columns if c != "text"]
    out = _scored(docs, labels, keep, True).where(F.col("_score") < bar)
    return out.select(*[(F.col("_text") if c == "text" else F.col(f"_{keep.index(c)}")).alias(c) for c in docs.columns])


def fold_of(doc_id, folds: int):
    """crc32 of the id's text, modulo ``folds``; -1, no fold, for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def usable_labels(labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(_id, y) outside the held-out fold, one row per id; null ids and labels drop out, and
    of conflicting labels toxic counts."""
    y = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("y"))
    return y.where(fold_of(F.col("_id"), folds) != held)
