"""Spelling variants, repeated passages and vector codes against brute force; odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicetopo.llm import codes, substrings, variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", size long, h long, rank int, key string, row long, word string, n long, root string, anchor long, spot long, seg string, id long"


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "xx", "s", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, clashing column names."""
    said = " ".join(f"word{i % 700}abcdef" for i in range(9000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, said), (4, said), (4, "other text"), (None, said), (None, said + " end"), (5, "x"), (6, "a" * 30000), (7, said)]
    return spark.createDataFrame([(i, t, None, None, None, *((1, 2, 3, "k", 4, "w", 5, "r", 6, 7, "s", 8))) for i, t in rows], SCHEMA + CLASH)


# 11 --------------------------------------------------------------------------


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def naive_variants(rows, times=5):
    counts = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if run and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
            run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        out[w] = (n, len(others), best if best is not None and counts[best] >= times * n else None)
    root = {}
    for w in counts:
        r = w
        while out[r][2] is not None:
            r = out[r][2]
        root[w] = r
    return {w: (out[w][2], root[w], out[w][0], out[w][1], counts[out[w][2]] if out[w][2] else None) for w in counts}


def test_variants_against_all_pairs(spark):
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    texts = []
    for _ in range(400):
        words = []
        for _ in range(30):
            w = stems[min(int(rng.expovariate(0.2)), 24)]
            if rng.random() < 0.12:
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice("abcé") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice((" ", ", ", "-", "1")).join(words))
    # A chain of forms: 5 lead to 30, and these to 160.
    texts[7] += " abccabcc" * 160
    texts[8] += " abccabbc" * 30 + " abccabbb" * 5
    ids = [None if i % 50 == 0 else i for i in range(400)]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(docs_of(spark, texts, ids)).collect()}
    want = naive_variants(list(zip(ids, texts, strict=True)))
    assert got == want and len({v[1] for v in got.values()}) < len(got)
    assert got["abccabbb"][:2] == ("abccabbc", "abccabcc")


def test_numbers_of_words_are_perfect_and_errors_are_found_from_both_ends():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(300)})
    there, back = variants.Numbered(words), variants.Numbered(sorted(w[::-1] for w in words))
    mirrored = sorted(w[::-1] for w in words)
    assert [there.walk(there.start, 0, w) for w in words] == list(range(len(words))) and there.walk(there.start, 0, "zz") is None
    assert len(there.edges) < sum(map(len, words)) / 3  # equal ends are shared
    for w in words[::7]:
        found = {words[k] for k in there.near(w, len(w) // 2)} | {mirrored[k][::-1] for k in back.near(w[::-1], (len(w) + 1) // 2)}
        assert found - {w} == {v for v in words if near(w, v)}


def test_variants_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(odd).collect()}
    assert got == naive_variants(rows)
    assert variants.variants(odd.limit(0)).count() == 0


# 12 --------------------------------------------------------------------------


def naive_substrings(rows, k=13):
    first = {}
    words = [(math.inf if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for a in range(len(w) - k + 1):
            g = tuple(w[a : a + k])
            first[g] = min(first.get(g, math.inf), i)
    out = []
    for (i, w), (given, _) in zip(words, rows, strict=True):
        gone = {p for a in range(len(w) - k + 1) if first[tuple(w[a : a + k])] < i for p in range(a, a + k)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((given, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def removed(df):
    return Counter(tuple(r) for r in substrings.digests(substrings.without_repeats(df)).collect())


def passages(rng, n_docs):
    """Texts of few words with shared passages, near copies, repeats in a text and short ones."""
    word = lambda: rng.choice(["a", "b", "cc", "d'", "é", "F"]) + str(rng.randrange(40))
    pool = [[word() for _ in range(rng.randint(13, 60))] for _ in range(12)]
    texts = []
    for _ in range(n_docs):
        w = []
        for _ in range(rng.randrange(5)):
            w += [word() for _ in range(rng.randrange(25))]
            p = rng.choice(pool)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            w += p if rng.random() < 0.5 else p[a:b]
        if rng.random() < 0.2 and w:
            w[rng.randrange(len(w))] = "X"
        texts.append(rng.choice((" ", "\n", "\t ")).join(w))
    return texts


@pytest.mark.parametrize(("common", "bundle"), [(4096, 64), (3, 1)])
def test_repeats_against_all_windows(spark, monkeypatch, common, bundle):
    monkeypatch.setattr(substrings, "COMMON", common)
    monkeypatch.setattr(substrings, "BUNDLE", bundle)
    texts = passages(random.Random(common), 250)
    ids = [None if i % 40 == 7 else i // 2 if i % 9 == 0 else i for i in range(250)]
    got = removed(docs_of(spark, texts, ids))
    assert got == naive_substrings(list(zip(ids, texts, strict=True))) and sum(c[2] > 0 for c in got) > 80


def test_repeats_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert removed(odd) == naive_substrings(rows)
    assert substrings.without_repeats(odd.limit(0)).count() == 0


def test_a_text_that_repeats_itself(spark):
    # One anchor over and over: its run is cut, and nothing is lost.
    texts = ["go " * 100, "go " * 40 + "stop", "a " + "go " * 13, "go " * 12]
    assert removed(docs_of(spark, texts)) == naive_substrings(list(enumerate(texts)))


def test_automaton_against_all_places():
    rng = random.Random(6)
    said = sorted((rng.randrange(9), [rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randint(1, 14))]) for _ in range(80))
    automaton = substrings.Automaton()
    for number, words in said:
        automaton.add(words, number)
    holds = lambda g, words: any(words[i : i + len(g)] == g for i in range(len(words)))
    for _ in range(200):
        words = [rng.choice([b"x", b"y", b"z", b"w"]) for _ in range(12)]
        want = {a: least for a in range(12 - 4) if (least := min((n for n, w in said if holds(words[a : a + 5], w)), default=None)) is not None}
        assert dict(automaton.windows(words, 5)) == want


def test_runs_shared_with_a_reference(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 60)
    rng = random.Random(21)
    texts = passages(rng, 60)
    held = [t for t in texts[:20] if t]
    got = {(r.doc_id, r.start, r.length) for r in substrings.found_in(docs_of(spark, [*texts[20:], None, ""]), docs_of(spark, [*held, None])).collect()}
    want = set()
    for i, t in enumerate(texts[20:]):
        w = t.split()
        longest = [max((n for r in held for ref in [r.split()] for n in range(1, e + 2) if any(ref[p : p + n] == w[e + 1 - n : e + 1] for p in range(len(ref) - n + 1))), default=0) for e in range(len(w))] if len(w) >= 13 else []
        want |= {(i, e - n + 1, n) for e, n in enumerate(longest) if n >= 13 and (e + 1 == len(w) or longest[e + 1] <= n)}
    assert got == want and want
    monkeypatch.setattr(substrings, "REFERENCE_WORDS", 10)
    with pytest.raises(ValueError, match="larger"):
        substrings.found_in(docs_of(spark, ["a"]), docs_of(spark, held))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.array([100, 5, 0, 150, 145])
    text, at, n, anchor = substrings.anchors(h, counts, 13, 6)
    starts = np.concatenate([[0], np.cumsum(counts)])
    seen, found = {}, set()
    for t, a, m, v in zip(text.tolist(), at.tolist(), n.tolist(), anchor.tolist(), strict=True):
        assert 1 <= m <= 8
        for p in range(a, a + m):
            found.add((t, p))
            window = h[starts[t] + p : starts[t] + p + 13].tobytes()
            assert seen.setdefault(window, v) == v
    assert found == {(t, p) for t, c in enumerate(counts.tolist()) for p in range(c - 12)}


# 13 --------------------------------------------------------------------------


def naive_codes(rows, parts=8, entries=16, rounds=6):
    """Plain lists of Python's integers."""
    kept = [(i, label, [math.floor(4096 * x) if abs(x) < 1e300 else int(x) * 4096 for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for length in {len(v) for _, _, v in kept}:
        own = [(i, label, v + [0] * (-length % parts)) for i, label, v in kept if len(v) == length]
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        s = len(own[0][2]) // parts
        cut = [[v[p * s : (p + 1) * s] for p in range(parts)] for _, _, v in own]
        books = [[c[p] for c in cut[:entries]] for p in range(parts)]
        far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
        nearest = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
        for _ in range(rounds):
            near_ = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
            for p in range(parts):
                for k in range(len(books[p])):
                    members = [c[p] for c, a in zip(cut, near_, strict=True) if a[p] == k]
                    if members:
                        books[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
        sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
        for (i, label, _), c in zip(own, cut, strict=True):
            a = [nearest(c[p], books[p]) for p in range(parts)]
            out.append([i, label, "".join(f"{x:02x}" for x in a), sum(far(c[p], books[p][a[p]]) for p in range(parts)), sha])
    totals = Counter()
    for r in out:
        totals[r[1]] += r[3]
    top = 2**63 - 1
    return Counter((i, label, code, min(e, top), min(totals[label], top), sha) for i, label, code, e, sha in out)


VECTORS = "vec_id long, embedding array<double>, label int"


def coded(df):
    return Counter((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(df).collect())


def test_codes_against_plain_lists(spark):
    rng = random.Random(13)
    rows = [(i, rng.choice([None, 1, 2, 2, 2]), [rng.gauss(0, 1) for _ in range(24)]) for i in rng.sample(range(1000), 150)]
    rows += [(5000 + i, 3, list(rows[i][2])) for i in range(20)]  # ties: equal vectors
    got = coded(spark.createDataFrame([(i, v, label) for i, label, v in rows], VECTORS).repartition(7))
    assert got == naive_codes(rows)


def test_codes_of_odd_rows(spark):
    rng = random.Random(3)
    v = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(1, 1, None), (2, 1, [None, 1.0]), (3, 1, [math.nan] * 16), (4, 1, [math.inf] * 16), (5, None, [0.0] * 16), (5, None, [0.0] * 16), (5, 2, v(16)), (None, 2, v(16)), (6, 2, []), (7, 2, []), (8, 3, v(13)), (9, 3, v(13)), (10, 3, v(3)), (11, 4, [-1e-9] * 16)]
    rows += [(20 + i, 5, [x * 1e4 for x in v(8)]) for i in range(30)] + [(60, 6, [1e200] * 8), (61, 6, [-1e308] * 8)]
    df = spark.createDataFrame([(i, e, label) for i, label, e in rows], VECTORS)
    clash = df.withColumns({c: F.lit(1) for c in ("length", "code", "error", "rank", "n", "block", "_label", "large")})
    assert coded(clash) == naive_codes(rows)
    assert codes.compress(df.limit(0)).count() == 0 and codes.compress(df.where("vec_id < 5")).count() == 0
    with pytest.raises(ValueError, match="numbers"):
        codes.first_books(codes.usable(df).withColumn("length", F.lit(codes.MOST_NUMBERS)))
