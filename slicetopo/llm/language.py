"""Operator 2, language identification by mixture inference.

Training counts letter trigrams (with word ends) per language over all training rows.
For a document every word has, per language, a likelihood: the product of its trigrams'
probabilities, relative to the word's best language, never below exp(-40), and mixed with
a 0.1 % share that any language may have any word. Expectation-maximisation over the words
estimates the proportions of the languages. The language set is chosen by penalised
likelihood: starting from all languages, the one with the smallest proportion (the first of
equal ones) is left out as long as the likelihood, less a penalty for each language, does
not fall. The label is the language with the largest proportion (the first of equal ones),
the score its proportion times how surely it beats the others.

Words are counted in parts of a text of bounded size; a text's repeated words are one row
with a count, so the memory follows the distinct words of a part, times the languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ragged, tune

#: Trigram classes; a model has this many numbers for each language.
WIDTH = 1 << 16
PENALTY = 4.0
STEPS = 8
#: Characters that are handled at once.
CHUNK = 1_500_000

_letters: list = []


def letters() -> np.ndarray:
    """A number for each code point: 0 for what is no letter, else a hash of its lower
    case form."""
    if not _letters:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = (ord(ch.lower()[0]) * 2654435761) % (1 << 32) or 1
        _letters.append(table)
    return _letters[0]


def grams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram classes of all words, the number of trigrams of each word and the number
    of words of each text. A word of n letters has n trigrams: each letter with its
    neighbours, ends being letters too."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = letters()[cp]
    is_letter = x != 0
    at = np.flatnonzero(is_letter)
    if not len(at):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(texts), dtype=np.int64)
    prev = np.where(at > 0, x[at - 1], 0)
    nxt = x[at + 1]
    g = (prev * np.uint32(0x85EBCA6B)) ^ (x[at] * np.uint32(0xC2B2AE35)) ^ (nxt * np.uint32(0x27D4EB2F))
    g ^= g >> np.uint32(15)
    g = ((g * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64) % WIDTH
    first = np.flatnonzero(prev == 0)
    sizes = np.diff(np.append(first, len(at)))
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    words = np.diff(np.concatenate([[0], np.searchsorted(at[first], ends)]))
    return g, sizes, words


def parts(texts: list, most: int = CHUNK):
    """Runs of texts with about ``most`` characters, so that very long texts don't add up."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size > most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _count(batches):
    """Partial counts of one task, a row for each language and trigram class."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        by: dict[str, list] = {}
        for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).append(t)
        for lang, texts in by.items():
            for part in parts(texts):
                total[lang] = total.get(lang, 0) + np.bincount(grams(part)[0], minlength=WIDTH)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), type=pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "gram", "n"])


def train(rows: DataFrame) -> dict:
    """Log probabilities (trigram class x language) from (text, lang). What reaches the
    driver has at most WIDTH numbers for each language."""
    tune(rows.sparkSession, 1024)
    counts = rows.select("text", "lang").mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    at = {x: i for i, x in enumerate(names)}
    table = np.full((WIDTH, max(1, len(names))), 0.3)
    if len(names):
        table[counts.column("gram").to_numpy(), [at[x] for x in counts.column("lang").to_pylist()]] += counts.column("n").to_numpy()
    return {"names": names, "logp": np.log(table / table.sum(axis=0)).astype(np.float32)}


def _loglik(p: np.ndarray, like: np.ndarray, times: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return np.add.reduceat(times * np.log(np.maximum((like * p[doc]).sum(axis=1), 1e-300)), starts)


def _em(like: np.ndarray, times: np.ndarray, starts: np.ndarray, doc: np.ndarray, n: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Proportions of the languages of ``on`` in each document. ``times``: how often each
    word stands in its document, ``n``: words of the documents."""
    p = on / on.sum(axis=1, keepdims=True)
    for _ in range(STEPS):
        r = like * p[doc]
        r *= (times / np.maximum(r.sum(axis=1), 1e-300))[:, None]
        p = np.add.reduceat(r, starts, axis=0) / n[:, None]
    return p


def _folded(g: np.ndarray, sizes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first occurrence of each distinct (document, word), by document, and how often it
    stands there. Words are told apart by two digests of their trigram classes."""
    begin = np.cumsum(sizes) - sizes
    place = (np.arange(len(g)) - np.repeat(begin, sizes) + 1).astype(np.uint64)
    mixed = g.astype(np.uint64) + place * np.uint64(1 << 20)
    digests = [np.add.reduceat(mix(mixed + np.uint64(salt)), begin) for salt in (1, 2)]
    order = np.lexsort((digests[1], digests[0], doc))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for x in (doc, *digests):
        new[1:] |= x[order][1:] != x[order][:-1]
    return order[new], np.diff(np.append(np.flatnonzero(new), len(order)))


def infer(model: dict, texts: list) -> tuple[list[str], np.ndarray, list[dict]]:
    """Label, score and proportions of each text."""
    names, logp = model["names"], model["logp"]
    labels, scores, mixes = ["und"] * len(texts), np.zeros(len(texts)), [{} for _ in texts]
    g, sizes, words = grams(texts)
    has = np.flatnonzero(words)
    if not len(names) or not len(has):
        return labels, scores, mixes
    n = words[has]
    doc = np.repeat(np.arange(len(has)), n)
    at, times = _folded(g, sizes, doc)
    begin = np.cumsum(sizes) - sizes
    doc, own = doc[at], ragged(begin[at], sizes[at])
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    ll = np.add.reduceat(logp[g[own]], np.cumsum(sizes[at]) - sizes[at], axis=0).astype(np.float64)
    ll -= ll.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(ll, -40))
    like = 0.999 * like + 0.001  # a word may be in no language
    on = np.ones((len(has), len(names)))
    p = _em(like, times, starts, doc, n, on)
    best = _loglik(p, like, times, starts, doc) - PENALTY * on.sum(axis=1)
    # Documents that still lose languages, and their words.
    open_, rows = np.arange(len(has)), np.arange(len(doc))
    while len(open_) and len(names) > 1:
        less = on[open_].copy()
        low = np.where(less > 0, p[open_], np.inf).argmin(axis=1)
        less[np.arange(len(open_)), low] = 0
        some = less.sum(axis=1) > 0
        open_, less = open_[some], less[some]
        keep = np.isin(doc[rows], open_)
        rows = rows[keep]
        if not len(rows):
            break
        number = np.searchsorted(open_, doc[rows])
        begin_ = np.flatnonzero(np.diff(number, prepend=-1))
        q = _em(like[rows], times[rows], begin_, number, n[open_], less)
        new = _loglik(q, like[rows], times[rows], begin_, number) - PENALTY * less.sum(axis=1)
        better = new >= best[open_]
        open_ = open_[better]
        on[open_], p[open_], best[open_] = less[better], q[better], new[better]
    top = p.argmax(axis=1)
    one = np.add.reduceat(times[:, None] * np.log(like), starts, axis=0)
    one -= one.max(axis=1, keepdims=True)
    post = np.exp(np.maximum(one, -60))
    post = post[np.arange(len(has)), top] / post.sum(axis=1)
    own = p[np.arange(len(has)), top]
    for i, j in enumerate(has.tolist()):
        labels[j] = names[top[i]]
        mixes[j] = {names[k]: float(p[i, k]) for k in np.flatnonzero(on[i] * p[i] > 1e-3)}
    scores[has] = np.clip(own * np.maximum(post, own), 0, 1)
    return labels, scores, mixes


def _run(shared):
    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            labels, scores, mixes = [], [], []
            for part in parts(texts, CHUNK // max(1, len(m["names"]) // 16)):
                x, y, z = infer(m, part)
                labels += x
                scores += y.tolist()
                mixes += z
            flat = [list(x.items()) for x in mixes]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(labels, type=pa.string()), pa.array(scores, type=pa.float64()), pa.array(flat, type=pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, mixture) for every row.

    Null texts and texts without a letter are `und` with score 0 and an empty mixture; so
    is every text when no language was learned. Rows with a null lang teach nothing. Of
    languages that fit alike the last in order stays. Repeated rows get equal results; an empty
    table gives an empty result; further columns are ignored."""
    spark = docs.sparkSession
    tune(spark, 1024)
    shared = spark.sparkContext.broadcast(model)
    own = docs.select("doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_run(shared), f"doc_id {kind}, lang_pred string, score double, mixture map<string,double>")
