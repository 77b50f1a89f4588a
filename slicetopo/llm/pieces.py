"""Operator 1, SentencePiece encoding and decoding with seeded merge-dropout.

A model's pieces are merged by their scores, the best candidate first; of equal ones the
leftmost. A candidate, that is two neighbouring symbols whose concatenation is a piece, is
skipped when a keyed hash of (seed, document, place of the segment, place of the candidate,
piece) is below the dropout rate. So every occurrence of a word draws its own segmentation,
reruns agree, and every segmentation is made of merges alone. Characters without a piece
become byte pieces. Decoding gives the text back exactly, whatever the segmentation: a
space and the literal character U+2581 stay apart, the latter is written in bytes.

A text's segments end where no piece can go across: before a space that follows
another character, and around line ends; a model with pieces that do is refused. A
segment's result depends on nothing but which of its possible candidates are skipped. So
results are kept by (segment, skipped candidates), and an occurrence whose skips were seen
before costs a look-up. Short segments are merged side by side in numpy arrays, long ones,
and those with more candidates than a key holds, with a heap and without a memory.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, ragged, tune

DROPOUT, SEED = 0.1, 1
SEGMENT = re.compile(r" *[^ \n]+| +|\n")
#: Longest segment that is merged in arrays; most candidates of a segment that is kept.
SHORT, CANDIDATES = 32, 40
#: Segments and results that a task keeps.
MOST_SEGMENTS, MOST_RESULTS = 150_000, 300_000
NONE = np.int32(2**31 - 1)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    """The public vocabulary file of the installed tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The tables of a model, small enough for a broadcast: they have a model's size."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.raw = [b""] * size
        self.byte = np.full(256, -1, dtype=np.int32)
        ids = {}
        for i in range(size):
            if sp.is_byte(i):
                self.byte[int(names[i][3:5], 16)] = i
                self.raw[i] = bytes([int(names[i][3:5], 16)])
        for i in plain:
            ids[names[i].replace("▁", " ")] = i
            self.raw[i] = names[i].replace("▁", " ").encode()
        self.raw_bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.raw_size = np.array([len(x) for x in self.raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        crossing = [p for p in ids if SEGMENT.fullmatch(p) is None and not p.isspace()] + [p for p in ids if "\n" in p and p != "\n"]
        if crossing:
            raise ValueError(f"pieces go across segments: {crossing[:5]}")
        pairs = sorted((ids[p[:k]] << 20 | ids[p[k:]], rank[i], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.keys = np.array([k for k, _, _ in pairs], dtype=np.int64)
        self.rank = np.array([r for _, r, _ in pairs], dtype=np.int32)
        self.made = np.zeros(len(rank) + 1, dtype=np.int32)
        for i, r in rank.items():
            self.made[r] = i
        self.merge = {k: r for k, r, _ in pairs}
        # What a merge can make, by its text; by a hash of its characters for whole arrays.
        made = {r for _, r, _ in pairs}
        self.makes = {p: rank[i] for p, i in ids.items() if rank[i] in made}
        self.longest = max(map(len, self.makes), default=1)
        table = sorted((rolled([ord(c) for c in p]), r) for p, r in self.makes.items())
        self.hashes = np.array([h for h, _ in table], dtype=np.uint64)
        self.hash_rank = np.array([r for _, r in table], dtype=np.int64)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[_short(self.hashes)] = True
        self.maybe_pair = np.zeros(1 << 20, dtype=bool)
        self.maybe_pair[_short(self.keys.astype(np.uint64))] = True

    def candidates(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All that merges can make in words, as place << 20 | rank, one word after the other,
        and their number for each word. A chance equality of hashes adds one that no merge
        makes, which changes no result."""
        order = np.argsort(size, kind="stable")
        row, cand = [], []
        for part in np.array_split(order, max(1, len(order) // 20_000)):
            if not len(part):
                continue
            width = max(1, int(size[part].max()))
            cp = np.array([words[i] for i in part], dtype=f"U{width}").view(np.uint32).reshape(len(part), width).astype(np.uint64)
            h, own = cp, size[part]
            for n in range(2, min(width, self.longest) + 1):
                h = h[:, :-1] * BASE + cp[:, n - 1 :]
                wide = width - n + 1
                flat = np.flatnonzero(self.maybe[_short(h)])
                r = flat // wide
                a = flat - r * wide
                fits = a + n <= own[r]
                r, a, flat = r[fits], a[fits], flat[fits]
                x = h.ravel()[flat]
                at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
                real = self.hashes[at] == x
                row.append(part[r[real]])
                cand.append(a[real] << 20 | self.hash_rank[at[real]])
        row, cand = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (row, cand))
        return cand[np.lexsort((cand, row))].astype(np.uint64), np.bincount(row, minlength=len(words))


BASE = np.uint64(0x100000001B3)


def rolled(codes: list[int]) -> int:
    """The hash of characters that :meth:`Pieces.candidates` rolls over words."""
    h = 0
    for c in codes:
        h = (h * int(BASE) + c) % (1 << 64)
    return h


def _short(h: np.ndarray) -> np.ndarray:
    return (h * GOLD >> np.uint64(44)).view(np.int64)


def _skip(salt, place, rank, limit: int):
    """Whether candidates are skipped. salt: of a segment's occurrence."""
    return _skipped(salt, place.astype(np.uint64) << np.uint64(20) | rank.astype(np.uint64), limit)


def _skipped(salt, candidate, limit: int):
    return mix(salt + GOLD * candidate) < np.uint64(limit)


def _look(m: Pieces, left, right, salt, place, limit: int):
    """Ranks of the pieces that pairs of symbols make, NONE for no or a skipped one."""
    key = left.astype(np.int64) << 20 | right.astype(np.int64)
    rank = np.full(len(key), NONE, dtype=np.int32)
    # Characters without a piece are negative, and so is their key or its part.
    some = np.flatnonzero(m.maybe_pair[_short(key.view(np.uint64))])
    some = some[(left[some] >= 0) & (right[some] >= 0)]
    at = np.minimum(np.searchsorted(m.keys, key[some]), len(m.keys) - 1)
    real = m.keys[at] == key[some]
    hit, own = some[real], m.rank[at[real]]
    if limit:
        kept = ~_skip(salt[hit], place[hit], own, limit)
        hit, own = hit[kept], own[kept]
    rank[hit] = own
    return rank


def _merge_short(m: Pieces, words: list[str], lens: np.ndarray, salt: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words, one after the other, and their number for each word; a
    character without a piece is -1 - its code point."""
    width = int(lens.max())
    cp = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.int64)
    cols = np.arange(width)
    inside = cols[None, :] < lens[:, None]
    sym = np.where(m.char[cp] >= 0, m.char[cp], -1 - cp).astype(np.int32)
    alive = inside.copy()
    nxt = np.broadcast_to(cols + 1, sym.shape).astype(np.int32).copy()
    prv = np.broadcast_to(cols - 1, sym.shape).astype(np.int32).copy()
    rank = np.full(sym.shape, NONE, dtype=np.int32)
    if width > 1:
        flat = np.flatnonzero(inside[:, 1:])
        r = flat // (width - 1)
        c = flat - r * (width - 1)
        rank[r, c] = _look(m, sym[r, c], sym[r, c + 1], salt[r], c, limit)
    rows = np.arange(len(words))
    while len(rows):
        j = rank[rows].argmin(axis=1)
        best = rank[rows, j]
        ok = best != NONE
        rows, j, best = rows[ok], j[ok], best[ok]
        if not len(rows):
            break
        k = nxt[rows, j]
        sym[rows, j] = m.made[best]
        alive[rows, k] = False
        rank[rows, k] = NONE
        n = nxt[rows, k]
        nxt[rows, j] = n
        rank[rows, j] = NONE
        has = n < lens[rows]
        r, a, b = rows[has], j[has], n[has]
        prv[r, b] = a
        rank[r, a] = _look(m, sym[r, a], sym[r, b], salt[r], a, limit)
        p = prv[rows, j]
        has = p >= 0
        r, a, b = rows[has], p[has], j[has]
        rank[r, a] = _look(m, sym[r, a], sym[r, b], salt[r], a, limit)
    return sym[alive], alive.sum(axis=1)


def _merge_long(m: Pieces, word: str, salt: np.uint64, limit: int) -> list[int]:
    """The same with an agenda, for one long word."""
    sym = [int(m.char[ord(c)]) if m.char[ord(c)] >= 0 else -1 - ord(c) for c in word]
    nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    agenda: list = []
    one = np.array([salt], dtype=np.uint64)

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < len(sym) and sym[a] >= 0 and sym[b] >= 0:
            r = m.merge.get(sym[a] << 20 | sym[b])
            if r is not None and not (limit and _skip(one, np.array([a]), np.array([r]), limit)[0]):
                heapq.heappush(agenda, (r, a, b, sym[a], sym[b]))

    for i in range(len(sym) - 1):
        offer(i, i + 1)
    dead = bytearray(len(sym))
    while agenda:
        r, a, b, x, y = heapq.heappop(agenda)
        if dead[a] or dead[b] or sym[a] != x or sym[b] != y or nxt[a] != b:
            continue
        sym[a] = int(m.made[r])
        dead[b] = 1
        nxt[a] = nxt[b]
        if nxt[a] < len(sym):
            prv[nxt[a]] = a
        offer(prv[a], a)
        offer(a, nxt[a])
    return [s for s, d in zip(sym, dead, strict=True) if not d]


#: Marks of segments without candidates: never kept, or met once only.
NEVER, ONCE = -1, -2


class Numbers(dict):
    """Numbers segments in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Memo:
    """What a task has merged: segments with their candidates, and results by segment and
    skipped candidates. Both are emptied when they are full, so memory is bounded."""

    def __init__(self, m: Pieces):
        self.m = m
        self.clear()

    def clear(self) -> None:
        self.ids = Numbers()
        self.size = np.zeros(0, dtype=np.int64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.cands = np.zeros(0, dtype=np.uint64)
        self.empty_results()

    def empty_results(self) -> None:
        self.slots = Numbers()
        self.start = np.zeros(0, dtype=np.int64)
        self.lens = np.zeros(0, dtype=np.int64)
        self.store = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0

    def rows(self, segs: list[str], limit: int) -> np.ndarray:
        """Numbers of segments. A segment's candidates are looked up when it is met for the
        second time; until then it has ONCE candidates, and NEVER if it is not kept, being
        long, rich in candidates, or holding a zero character."""
        if len(self.ids) > MOST_SEGMENTS:
            self.clear()
        elif len(self.slots) > MOST_RESULTS:
            self.empty_results()
        old = len(self.ids)
        out = np.fromiter(map(self.ids.__getitem__, segs), dtype=np.int64, count=len(segs))
        if len(self.ids) > old:
            new = list(itertools.islice(self.ids, old, None))
            size = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
            if "\0" in "".join(new):  # arrays of text would lose it
                size[np.array(["\0" in w for w in new])] = SHORT + 1
            n = np.where(size > SHORT, NEVER, ONCE)
            self.size = np.concatenate([self.size, size])
            self.count = np.concatenate([self.count, n])
            self.begin = np.concatenate([self.begin, np.zeros(len(new), dtype=np.int64)])
        times = np.bincount(out, minlength=len(self.ids))
        times[:old] *= 2
        again = np.flatnonzero((self.count == ONCE) & (times > 1))
        if len(again):
            at = np.empty(len(self.ids), dtype=np.int64)
            at[out] = np.arange(len(out))
            flat, n = np.zeros(0, dtype=np.uint64), np.zeros(len(again), dtype=np.int64)
            if limit:
                flat, n = self.m.candidates([segs[i] for i in at[again].tolist()], self.size[again])
                many = n > CANDIDATES
                flat, n = flat[np.repeat(~many, n)], np.where(many, NEVER, n)
            held = np.maximum(n, 0)
            self.begin[again] = len(self.cands) + np.cumsum(held) - held
            self.count[again] = n
            self.cands = np.concatenate([self.cands, flat])
        return out

    def add(self, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Keep results; their places in the store."""
        need = self.used + len(flat)
        if need > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(need - len(self.store), len(self.store) // 2), dtype=np.int32)])
        self.store[self.used : need] = flat
        start = self.used + np.cumsum(lens) - lens
        self.used = need
        return start


def _in_bytes(m: Pieces, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece as the pieces of their bytes."""
    bare = np.flatnonzero(flat < 0)
    if not len(bare):
        return flat, lens
    parts = [m.byte[list(chr(-1 - x).encode("utf-8", "surrogatepass"))] for x in flat[bare].tolist()]
    reps = np.ones(len(flat), dtype=np.int64)
    reps[bare] = [len(x) for x in parts]
    owner = np.repeat(np.repeat(np.arange(len(lens)), lens), reps)
    wide = np.repeat(flat, reps)
    wide[wide < 0] = np.concatenate(parts)
    return wide, np.bincount(owner, minlength=len(lens))


def _merged(m: Pieces, words: list[str], size: np.ndarray, salt: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, one after the other, and their numbers; each with its own salt. Words
    of a size over SHORT are merged one by one."""
    at_all, flats, counts = [], [], []
    for lo, hi in ((0, 5), (5, 8), (8, 12), (12, 18), (18, SHORT)):
        at = np.flatnonzero((size > lo) & (size <= hi))
        for part in np.array_split(at, max(1, len(at) // 10000)):
            if len(part):
                flat, n = _in_bytes(m, *_merge_short(m, [words[i] for i in part.tolist()], size[part], salt[part], limit))
                at_all.append(part)
                flats.append(flat)
                counts.append(n)
    for i in np.flatnonzero(size > SHORT).tolist():
        own = np.array(_merge_long(m, words[i], salt[i], limit), dtype=np.int32)
        flat, n = _in_bytes(m, own, np.array([len(own)]))
        at_all.append(np.array([i]))
        flats.append(flat)
        counts.append(n)
    if not at_all:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    at, flat, n = np.concatenate(at_all), np.concatenate(flats), np.concatenate(counts)
    begin = np.cumsum(n) - n
    order = np.argsort(at, kind="stable")
    return flat[ragged(begin[order], n[order])], n[order]


def encode(m: Pieces, texts: list, keys: np.ndarray, dropout: float = DROPOUT, seed: int = SEED, memo: Memo | None = None) -> list[np.ndarray]:
    """Ids of each text; ``keys`` vary the segmentation between texts."""
    limit = min(int(dropout * 2**64), 2**64 - 1)
    memo = memo or Memo(m)
    out: list[np.ndarray] = []
    for lo, hi in parts_of(texts):
        out += _encode(m, texts[lo:hi], keys[lo:hi], limit, seed, memo)
    return out


#: Characters that are encoded at once; a longer text is encoded alone.
AT_ONCE = 500_000


def parts_of(texts: list) -> list[tuple[int, int]]:
    """Ranges of texts of about AT_ONCE characters."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > AT_ONCE:
            out.append((lo, i + 1))
            lo, size = i + 1, 0
    return out + [(lo, len(texts))] if lo < len(texts) else out


def _encode(m: Pieces, texts: list, keys: np.ndarray, limit: int, seed: int, memo: Memo) -> list[np.ndarray]:
    segs: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            own = SEGMENT.findall(" " + t)
            counts[i] = len(own)
            segs += own
    if not segs:
        return [np.zeros(0, dtype=np.int32) for _ in texts]
    rows = memo.rows(segs, limit)
    place = ragged(np.zeros(len(counts), dtype=np.int64), counts)
    salt = mix(np.repeat(keys.astype(np.uint64), counts) + GOLD * (place.astype(np.uint64) + np.uint64(1000 + seed)))
    n = memo.count[rows]
    kept = np.flatnonzero(n >= 0)
    # Which candidates of each occurrence are skipped, as bits of a number.
    bits = np.zeros(len(segs), dtype=np.int64)
    if limit:  # sums of distinct powers under 2^53 are exact
        own = n[kept]
        cand = memo.cands[ragged(memo.begin[rows[kept]], own)]
        hit = np.flatnonzero(_skipped(np.repeat(salt[kept], own), cand, limit))
        owner = np.repeat(kept, own)[hit]
        bit = ragged(np.zeros(len(own), dtype=np.int64), own)[hit]
        bits = np.bincount(owner, weights=2.0**bit, minlength=len(segs)).astype(np.int64)
    key = rows[kept] << CANDIDATES | bits[kept]
    uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
    old = len(memo.slots)
    slot = np.fromiter(map(memo.slots.__getitem__, uniq.tolist()), dtype=np.int64, count=len(uniq))
    new = np.flatnonzero(slot >= old)
    if len(new):
        at = kept[first[new]]  # new slots are numbered in this order
        flat, made = _merged(m, [segs[i] for i in at.tolist()], memo.size[rows[at]], salt[at], limit)
        memo.start = np.concatenate([memo.start, memo.add(flat, made)])
        memo.lens = np.concatenate([memo.lens, made])
    start, lens = np.zeros(len(segs), dtype=np.int64), np.zeros(len(segs), dtype=np.int64)
    start[kept], lens[kept] = memo.start[slot][back], memo.lens[slot][back]
    # Those that are not kept go behind the store.
    loose = np.flatnonzero(n < 0)
    more, made = _merged(m, [segs[i] for i in loose.tolist()], memo.size[rows[loose]], salt[loose], limit)
    start[loose], lens[loose] = memo.used + np.cumsum(made) - made, made
    source = np.concatenate([memo.store[: memo.used], more]) if len(more) else memo.store
    flat = source[ragged(start, lens)]
    upto = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
    return [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def decode(m: Pieces, ids) -> str:
    """The text of ids; the space that encoding puts in front is taken away."""
    text = b"".join(map(m.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
    return text[1:] if text[:1] == " " else text


def same_again(m: Pieces, ids: list[np.ndarray], texts: list) -> list[bool]:
    """Whether decoding ids gives their texts, for all of a batch at once."""
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    size = m.raw_size[flat]
    got = m.raw_bytes[ragged(m.raw_start[flat], size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, ids)])].tolist()
    want = ((" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts)
    return [got[a:b] == w for a, b, w in zip(ends[:-1], ends[1:], want, strict=True)]


def _run(shared, dropout: float, seed: int):
    def run(batches):
        m = shared.value
        memo = Memo(m)
        for b in batches:
            texts = b.column("text").to_pylist()
            keys = np.fromiter((xxhash.xxh3_64_intdigest(repr(x)) for x in b.column("doc_id").to_pylist()), dtype=np.uint64, count=len(texts))
            ids = encode(m, texts, keys, dropout, seed, memo)
            n = np.array([len(x) for x in ids], dtype=np.int64)
            first, last = int(m.byte.min()), int(m.byte.max())
            in_bytes = np.array([int(((x >= first) & (x <= last)).sum()) for x in ids], dtype=np.int64)
            lossless = same_again(m, ids, texts)
            digest = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]
            offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(in_bytes), pa.array(digest), pa.array(lossless), pa.ListArray.from_arrays(pa.array(offs), flat)], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "lossless", "ids"])

    return run


def encode_docs(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_sha256, lossless, ids): every whole text in
    pieces. Null and empty texts have no ids, and decode to an empty text. ``lossless``:
    decoding gave the text back (for a null text: an empty one).
    Rows that repeat a doc_id and text get the same ids; an empty table gives an empty
    result; further columns are ignored. The model is read on the driver and broadcast;
    its size doesn't depend on the documents."""
    spark: SparkSession = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(Pieces(model or default_model()))
    own = docs.select("doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_run(shared, dropout, seed), f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_sha256 string, lossless boolean, ids array<int>")


def _back(shared):
    def run(batches):
        m = shared.value
        for b in batches:
            texts = [None if x is None else decode(m, np.array(x, dtype=np.int32)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return run


def decode_docs(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text, no ids an empty one.
    Further columns are ignored; repeated rows stay."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(Pieces(model or default_model()))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_back(shared), f"doc_id {kind}, text string")
