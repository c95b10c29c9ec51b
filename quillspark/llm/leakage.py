"""Evaluation passages inside a corpus: latent semantic retrieval of passages, then alignment.

Texts are cut into overlapping passages of words and pairs of words, weighted by TF-IDF; the document frequencies of
all terms of the items are counted over all documents. A randomised SVD of the items' passages, whose products are
computed in parallel and added up, gives the latent space; the passages of one item are one cell of it. A passage of a
document is placed in it and compared by cosine with the passages of those cells with which it shares as many word
pairs as a stretch changed as much as may be still keeps (a bound that rules out no such stretch). Pairs that come near
are aligned by the longest common subsequence of their words, and the rare words of the passage, which carry its answer,
must be among them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from quillspark.session import spread

#: Dimensions of the latent space, and the cosine from which two passages are aligned. Measured against brute force
#: over 1,500 documents: 0.98 of the leaks have a passage above it.
RANK, NEAR = 256, 0.35
#: Words of a passage, and characters of one in a script without spaces.
WORDS, CHARACTERS = 25, 50
#: Steps between passages: of documents, and of items; doubled for characters.
STEP, ITEM_STEP = 8, 5
#: Share of words that may be changed in a stretch.
LOST = 0.16
#: Words, and characters, of a run; a stretch that is changed as much as may be keeps at least one run. A run is stock if
#: so large a share of the documents, and at least so many, hold it without the rest of its stretch.
RUN, RUN_CHARACTERS = 4, 5
STOCK, STOCK_LEAST = 1 / 2000, 2
#: Share of its weight that a stretch must hold of which only stock runs are left: little changed, and as much as may be.
CHANGED, HELD, HELD_NEARLY = 0.12, 0.7, 0.9

_CHARACTERS = r"฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
_PLAIN = re.compile(r"[^\W_]+")
_MIXED = regex.compile(rf"[{_CHARACTERS}]|(?:(?![{_CHARACTERS}_])[\w\p{{M}}])+")
_NEEDS = re.compile(rf"[{_CHARACTERS}ऀ-ൿ؀-ۿ]")
_WITHOUT_SPACES = re.compile(rf"[{_CHARACTERS}]")
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Signs that part words and stand in many texts that are plain ASCII without them.
_SIGNS = "–—‘’“”…•−×→·§«»\u00a0\u2009\u202f"
_HYPHEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\n\s*(?=[^\W\d_])")


class Tokens:
    """Words as 32-bit numbers, remembered for the life of a task."""

    def __init__(self) -> None:
        self.known: tuple[dict[bytes, int], dict[str, int]] = ({}, {})

    def __call__(self, text: str | None) -> tuple[np.ndarray, bool]:
        """(numbers, whether the text is mainly in a script without spaces, whose characters are the words)."""
        if not text:
            return np.zeros(0, np.uint32), False
        wide = False
        if not text.isascii():
            for c in _SIGNS:
                text = text.replace(c, " ")
        if text.isascii() and "-\n" not in text:
            known, words = self.known[0], text.encode("ascii").translate(_ASCII).split()
        else:
            known, s = self.known[1], text.lower()
            if "-\n" in s:
                s = _HYPHEN.sub("", s)
            if s.isascii() or not _NEEDS.search(s):
                words = _PLAIN.findall(s)
            else:
                words = [w for w in _MIXED.findall(s) if w[0] not in "_"]
                wide = 2 * len(_WITHOUT_SPACES.findall(s)) > len(words)
        try:
            out = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > 1_000_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = zlib.crc32(w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass"))
            out = list(map(known.__getitem__, words))
        return np.array(out, np.uint32), wide


class Lookup:
    """Places of 64-bit numbers in a sorted array, by a table over their leading bits; its length for a number that it doesn't hold."""

    def __init__(self, known: np.ndarray) -> None:
        self.known, bits = known, max(8, min(22, int(len(known)).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        lead = (known >> self.shift).astype(np.int64)
        self.first = np.full(1 << bits, len(known), np.int32)
        self.first[lead[::-1]] = np.arange(len(known), dtype=np.int32)[::-1]
        self.shared = np.zeros(1 << bits, bool)
        self.shared[lead[1:][lead[1:] == lead[:-1]]] = True
        self.padded = np.r_[known, np.uint64(0)]

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        lead = (numbers >> self.shift).astype(np.int64)
        at = self.first[lead]
        wrong = self.padded[at] != numbers
        at[wrong] = len(self.known)
        again = np.flatnonzero(wrong & self.shared[lead])
        if len(again):
            at[again] = _local(numbers[again], self.known)
        return at


_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(1000003)


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each position the word, and the pair of it and the next word, as 64-bit numbers."""
    a = ids.astype(np.uint64)
    return a * _MIX, np.r_[(a[:-1] * _TURN + a[1:]) * _MIX, np.zeros(min(1, len(a)), np.uint64)]


def _runs(ids: np.ndarray, size: int) -> np.ndarray:
    """Each run of `size` words as a 64-bit number."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a, h = ids.astype(np.uint64), np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ a[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _local(terms: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of terms in the sorted vocabulary of the items; its length for a term that no item has."""
    at = np.searchsorted(known, terms)
    at[at == len(known)] = 0
    return np.where(known[at] == terms, at, len(known))


def _starts(n: int, size: int, step: int) -> np.ndarray:
    if n <= size:
        return np.zeros(1, np.int64)
    s = np.arange(0, n - size + 1, step)
    return s if s[-1] == n - size else np.r_[s, n - size]


def _sums(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    c = np.zeros((len(x) + 1, *x.shape[1:]), x.dtype)
    np.cumsum(x, axis=0, out=c[1:])
    return c[hi] - c[lo]


def document_frequency(texts: DataFrame, text: str, known: np.ndarray, runs: dict[int, np.ndarray]) -> tuple[np.ndarray, dict[int, np.ndarray], int]:
    """How many of all documents hold each term of the sorted vocabulary `known`, each of the sorted runs by their size, and how many documents have words.

    Each task counts for itself; the counts, of the size of the vocabulary, are added up in Spark.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, df, n = Tokens(), np.zeros(len(known) + 1, np.int64), 0
        places, run_places = Lookup(known), {size: Lookup(x) for size, x in runs.items()}
        more = {size: np.zeros(len(x) + 1, np.int64) for size, x in runs.items()}
        width = 1 + max(len(known), *map(len, runs.values())) if runs else 1 + len(known)
        docs_at_once = max(1, min(256, 2_000_000 // width))
        held = np.zeros((docs_at_once, width), bool)

        def add(some: list[tuple[np.ndarray, bool]]) -> None:
            lengths = np.array([len(x) for x, _ in some])
            ids, row = np.concatenate([x for x, _ in some]), np.repeat(np.arange(len(some)), lengths)
            end = np.cumsum(lengths)

            def runs_of(ids: np.ndarray, end: np.ndarray, size: int, look: Lookup) -> np.ndarray:
                at = look(_runs(ids, size))
                for k in range(1, size):  # a run ends with its text
                    past = end - k
                    at[past[(past >= 0) & (past < len(at))]] = len(look.known)
                return at

            def tell(counts: np.ndarray, *at: np.ndarray) -> None:
                held[: len(some)] = False
                for x in at:
                    held[row[: len(x)], x] = True
                counts += held[: len(some), : len(counts)].sum(0, dtype=np.uint16)

            one, two = (places(x) for x in _terms(ids))
            two[end - 1] = len(known)  # a pair ends with its text
            tell(df, one, two)
            for size, look in run_places.items():
                if size == RUN:
                    tell(more[size], runs_of(ids, end, size, look))
                elif own := [x for x in some if x[1]]:
                    row = np.repeat(np.arange(len(own)), [len(x) for x, _ in own])
                    tell(more[size], runs_of(np.concatenate([x for x, _ in own]), np.cumsum([len(x) for x, _ in own]), size, look))

        waiting: list[tuple[np.ndarray, bool]] = []
        words = 0
        for b in batches:
            for t in b["t"]:
                ids, _ = tok(t)
                if len(ids):
                    n += 1
                    waiting.append((ids, not t.isascii() and _WITHOUT_SPACES.search(t) is not None))
                    words += len(ids)
                    if len(waiting) == docs_at_once or words > 100_000:
                        add(waiting)
                        waiting, words = [], 0
        if waiting:
            add(waiting)
        every = np.concatenate([df[:-1], *(x[:-1] for x in more.values())])
        at = np.flatnonzero(every)
        yield pd.DataFrame({"k": np.r_[at, -1].astype("int64"), "n": np.r_[every[at], n].astype("int64")})

    got = texts.select(F.col(text).alias("t")).filter("t is not null").mapInPandas(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(known) + sum(map(len, runs.values())), np.int64)
    df[got.k[got.k >= 0].to_numpy()] = got.n[got.k >= 0].to_numpy()
    parts = np.split(df, np.cumsum([len(known), *map(len, runs.values())])[:-1])
    return parts[0], dict(zip(runs, parts[1:])), int(got.n[got.k == -1].sum())


def latent_space(texts: DataFrame, text: str, known: np.ndarray, idf: np.ndarray, rank: int = RANK, seed: int = 5, passes: int = 2, parts: int = 4) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the TF-IDF passages of `texts`, by randomised subspace iteration.

    Each pass computes A'(A q) over the passages A of each task; the products, of fixed size, are added up.
    """
    rng = np.random.default_rng(seed)
    width = min(rank + 8, len(known))
    q = np.linalg.qr(rng.standard_normal((len(known), width)))[0].astype(np.float32)
    rows = texts.select(F.col(text).alias("t")).filter("t is not null").repartition(parts)
    for _ in range(passes):
        basis = q

        def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tok, out = Tokens(), np.zeros((len(known), width), np.float32)
            for b in batches:
                for t in b["t"]:
                    ids, wide = tok(t)
                    if not len(ids):
                        continue
                    one, two = _placed(ids, known)
                    size = CHARACTERS if wide else WORDS
                    for at in _starts(len(ids), size, ITEM_STEP * (2 if wide else 1)):
                        k = np.r_[one[at : at + size], two[at : at + size - 1]]
                        k = k[k < len(known)]
                        w = idf[k] / max(1e-9, float(np.sqrt((idf[k] ** 2).sum())))
                        np.add.at(out, k, w[:, None] * (w @ basis[k])[None, :])
            yield pd.DataFrame({"m": [out.tobytes()]})

        y = np.zeros((len(known), width))
        for r in rows.mapInPandas(product, "m binary").toLocalIterator():
            y += np.frombuffer(r["m"], np.float32).reshape(y.shape)
        q = np.linalg.qr(y + 1e-9 * rng.standard_normal(y.shape))[0].astype(np.float32)
    return q[:, :rank]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = where.get(y)
        if m:
            m &= v
            v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


def common_subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for each row of a (at most 63 words) and of b."""
    full = np.uint64((1 << a.shape[1]) - 1)
    where = np.zeros(b.shape, np.uint64)
    for i in range(a.shape[1]):
        where |= (a[:, i, None] == b).astype(np.uint64) << np.uint64(i)
    v = np.full(len(a), full)
    for j in range(b.shape[1]):
        m = where[:, j] & v
        v = ((v + m) | (v - m)) & full
    return a.shape[1] - np.bitwise_count(v).astype(np.int64)


def _is_stock(words: list[int], part: list[int], counts: list[int], run: int, often: float) -> bool:
    """Whether all runs of the stretch that the document keeps are held by many more documents than the stretch can be, whose rarest run tells how many that is."""
    there = {tuple(part[k : k + run]) for k in range(len(part) - run + 1)}
    kept = [n for k, n in enumerate(counts) if tuple(words[k : k + run]) in there]
    return not kept or min(kept) - min(counts) >= often


def _agrees(item: np.ndarray, rare: np.ndarray, counts: np.ndarray, run: int, often: float, doc: np.ndarray, at: int, near: int, size: int, reach: int) -> bool:
    """Whether a stretch of `size` words of the item that starts within `reach` of `at` stands in the document around `near`: in order, close together, with few words changed, and if nothing but stock runs is left, its rare words kept."""
    around = doc[max(0, near - size // 2) : near + size + size // 2].tolist()
    need = size - int(size * LOST + 0.999)
    spread = size + max(2, int(size * LOST))
    # a stretch that starts within `reach` shares all but so many words with the one that starts at `at`
    if common_subsequence(item[at : at + size].tolist(), around) < need - reach:
        return False
    held = set(around)
    for o in sorted(range(max(0, at - reach), min(len(item) - size, at + reach) + 1), key=lambda x: abs(x - at)):
        words = item[o : o + size].tolist()
        if sum(w in held for w in words) < need or common_subsequence(words, around) < need:
            continue
        for p in range(0, max(1, len(around) - spread + 2), 2):
            part = around[p : p + spread]
            same = common_subsequence(words, part)
            if same >= need:
                if not _is_stock(words, part, counts[o : o + size - run + 1].tolist(), run, often):
                    return True
                there = set(part)
                w = rare[o : o + size]
                enough = HELD if same >= size - int(size * CHANGED + 0.999) else HELD_NEARLY
                if sum(float(x) for x, y in zip(w, words) if y in there) >= enough * float(w.sum()):
                    return True
    return False


def least_runs(length: int, size: int) -> int:
    """Runs of `size` words that a stretch keeps at least: it keeps all words but those that may be changed, and is cut in no more pieces than one word in four, changed, added or lost, can cut it in."""
    return max(1 if size == 2 else 0, length - int(length * LOST + 0.999) - (size - 1) * (1 + length // 4))


class _Cells:
    """What a search needs of the items of words, or of those of characters: the passages of each item, placed in the latent space, and which items hold a pair of words."""

    def __init__(self, members: list[int], kept: list[tuple[object, np.ndarray, bool]], wide: bool, known: np.ndarray, triples: np.ndarray, place: np.ndarray) -> None:
        self.size, self.step = (CHARACTERS, 2 * STEP) if wide else (WORDS, STEP)
        self.reach = ITEM_STEP * (2 if wide else 1)
        self.members = members
        starts, vectors, words, runs, held = [], [], [], [], []
        for k in members:
            one, two = _placed(kept[k][1], known)
            at = _starts(len(one), self.size, self.reach)
            v = _sums(place[one] + place[two], at, np.minimum(at + self.size, len(one)))
            vectors.append(v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9))
            starts.append(at)
            spot = at[:, None] + np.arange(min(self.size, len(one)))
            wider = ((0, 0), (0, self.size - spot.shape[1]))
            words.append(np.pad(one[spot], wider, constant_values=len(known)))
            runs.append(np.pad(_local(_runs(kept[k][1], 3), triples)[spot[:, :-2]], wider, constant_values=len(triples)) + len(known) + 2)
            held.append(np.unique(two[two < len(known)]))
        # passages of all items, in one row; those of item c from cut[c] to cut[c + 1]
        self.cut = np.cumsum([0, *map(len, starts)])
        self.cell = np.repeat(np.arange(len(members)), np.diff(self.cut))
        self.starts = np.concatenate(starts)
        self.vectors = np.ascontiguousarray(np.concatenate(vectors).T.astype(np.float32))
        self.words, self.runs = np.concatenate(words).astype(np.int32), np.concatenate(runs).astype(np.int32)
        # a term can't come so often: it stands for no word or run
        self.words_nth = np.where(self.words < len(known), _times(self.words), 255).astype(np.uint8)
        self.runs_nth = np.where(self.runs < len(known) + 2 + len(triples), _times(self.runs), 255).astype(np.uint8)
        # what a passage shares at least with a stretch that starts within half a step of it
        self.lengths = np.array([min(self.size, len(kept[k][1])) for k in members])
        self.most = (self.lengths - (self.lengths * LOST + 0.999).astype(int) - self.reach // 2)[self.cell]
        self.least = np.array([least_runs(x, 2) for x in self.lengths.tolist()], np.int16)
        self.few = np.array([least_runs(x, 3) for x in self.lengths.tolist()], np.int32)[self.cell] - (self.reach + 1) // 2
        term, owner = np.concatenate(held), np.repeat(np.arange(len(held)), list(map(len, held)))
        order = np.argsort(term, kind="stable")
        self.first, self.owner = np.searchsorted(term[order], np.arange(len(known) + 3)), owner[order].astype(np.int64)

    def near(self, two: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages (rows of `at`) and items that share enough pairs of words. `two`: the pairs of many texts, with at least 2 x STEP places between them that hold nothing."""
        n, bins = len(self.members), -(-len(two) // STEP)
        count = self.first[two + 1] - self.first[two]
        pos = np.flatnonzero(count)
        count = count[pos]
        ends = np.cumsum(count)
        first = self.first[two[pos]] - (ends - count)
        # 16 bits will do: sums may run over, their differences over a passage can't
        held = np.zeros((bins + 1, n), np.int16)
        some = max(1, 100_000 // n)  # bins, and passages, at once: what stays in a processor's cache
        for lo in range(0, bins, some):
            hi = min(bins, lo + some)
            here = slice(*np.searchsorted(pos, [lo * STEP, hi * STEP]))
            if here.start < here.stop:
                begin = int(ends[here.start] - count[here.start])
                entry = np.arange(begin, int(ends[here.stop - 1])) + np.repeat(first[here], count[here])
                key = np.repeat((pos[here] // STEP - lo) * n, count[here]) + self.owner[entry]
                held[lo + 1 : hi + 1] = np.bincount(key, minlength=(hi - lo) * n).reshape(hi - lo, n)
        np.cumsum(held, axis=0, dtype=np.int16, out=held)
        # a stretch that starts within half a step of a passage ends, with the words that may be added, in these bins
        lo, hi = np.maximum(0, at - STEP) // STEP, np.minimum(bins, -(-(at + self.size + self.size // 6 + self.step // 2) // STEP))
        rows, items = [], []
        for k in range(0, len(at), some):
            r, c = np.nonzero(held[hi[k : k + some]] - held[lo[k : k + some]] >= self.least)
            rows.append(r + k)
            items.append(c)
        return (np.concatenate(rows), np.concatenate(items)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _times(rows: np.ndarray) -> np.ndarray:
    """At each place of each row, how many times its term has come so far in the row."""
    return (np.tril(rows[:, :, None] == rows[:, None, :])).sum(2)


def _placed(ids: np.ndarray, known: np.ndarray | Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Places of words and of pairs in the vocabulary: its length for a term that no item has, one more where no pair is."""
    one, two = (known(x) if isinstance(known, Lookup) else _local(x, known) for x in _terms(ids))
    two[-1:] = (len(known.known) if isinstance(known, Lookup) else len(known)) + 1
    return one, two


#: Evaluation items that are searched at once; more are searched in blocks.
BLOCK_ITEMS = 2000
#: Words of the texts that a task looks at together, and cells of its table of passages and items.
_CHUNK_WORDS, _CHUNK_CELLS = 64_000, 4_000_000


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, near: float = NEAR, rank: int = RANK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id) of every document that holds an item's passage, or a stretch of it of at least 25 words (50 characters in a script without spaces).

    Items and documents may be any number and none is left out: more than `block_items` items are searched in blocks,
    each of which reads the documents. Null and blank texts hold nothing. An item shorter than a stretch is looked for
    whole, and one of less than 5 words only as it is. Repeated rows give their pairs once.
    """
    own = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    blocks = -(-own.count() // block_items)
    if blocks <= 1:
        return _find_in_block(docs, doc_id, text, own, dict(items.dtypes)[item_id], item_id, near, rank)
    out = None
    for k in range(blocks):
        some = own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        found = _find_in_block(docs, doc_id, text, some, dict(items.dtypes)[item_id], item_id, near, rank)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _find_in_block(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_type: str, item_id: str, near: float, rank: int) -> DataFrame:
    held = items.toPandas()
    spark = docs.sparkSession
    doc_type = dict(docs.dtypes)[doc_id]
    docs = spread(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter("t is not null"), "d")
    tok = Tokens()
    kept: list[tuple[object, np.ndarray, bool]] = []
    short: dict[int, dict[bytes, list[object]]] = {}
    for i, t in zip(held["i"], held["t"]):
        ids, wide = tok(t)
        if len(ids):
            kept.append((i, ids, wide))
        if 0 < len(ids) < (CHARACTERS if wide else WORDS):
            short.setdefault(len(ids), {}).setdefault(ids.tobytes(), []).append(i)
    kinds = f"{doc_id} {doc_type}, {item_id} {item_type}"
    if not kept:
        return spark.createDataFrame([], kinds)
    known = np.unique(np.concatenate([x for _, ids, _ in kept for x in _terms(ids)]))
    known = known[known != 0]  # stands where no pair is
    run_of = {wide: RUN_CHARACTERS if wide else RUN for wide in (False, True)}
    numbers = [_runs(ids, run_of[wide]) for _, ids, wide in kept]
    runs = {run_of[w]: np.unique(np.concatenate(x)) for w in (False, True) if (x := [y for (_, _, wide), y in zip(kept, numbers) if wide == w and len(y)])}
    df, held_by, n = document_frequency(docs, "t", known, runs)
    counts = [held_by[run_of[wide]][_local(x, runs[run_of[wide]])] if len(x) else np.zeros(0, np.int64) for (_, _, wide), x in zip(kept, numbers)]
    often = max(STOCK_LEAST, n * STOCK)
    idf = np.maximum(np.log((1 + n) / (1 + df)), 0.02).astype(np.float32)
    basis = latent_space(items, "t", known, idf, rank)
    # a term that no item has weighs as much as the items' terms do in the middle, and lies outside the space
    weight = np.r_[idf, np.median(idf), 0].astype(np.float32)
    place = np.r_[idf[:, None] * basis, np.zeros((2, basis.shape[1]))].astype(np.float32)
    triples = np.unique(np.concatenate([_runs(ids, 3) for _, ids, _ in kept]))
    cells = {w: _Cells(x, kept, w, known, triples, place) for w in (False, True) if (x := [k for k, (_, ids, wide) in enumerate(kept) if wide == w and len(ids) >= 5])}
    shared = spark.sparkContext.broadcast((kept, known, triples, counts, short, cells, weight, place))
    id_type = held["i"].dtype

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, known, triples, counts, short, cells, weight, place = shared.value
        tok, places, places3 = Tokens(), Lookup(known), Lookup(triples)
        rare = [weight[_local(_terms(ids)[0], known)] for _, ids, _ in kept]
        square = (weight**2).astype(np.float64)
        first = {size: np.array([np.frombuffer(x, np.uint32)[0] for x in of], np.uint32) for size, of in short.items()}
        kinds_of_terms = len(known) + 3 + len(triples)
        table = np.zeros(max(kinds_of_terms, _CHUNK_CELLS), np.uint8)
        found_d: list[object] = []
        found_i: list[object] = []

        def look(texts: list[tuple[object, np.ndarray, bool]], wide: bool) -> None:
            of = cells[wide]
            lengths = np.array([len(ids) for _, ids, _ in texts])
            gaps = 2 * STEP + -lengths % STEP
            begin = np.cumsum(lengths + gaps) - lengths - gaps
            inside = np.repeat(np.tile([True, False], len(texts)), np.stack([lengths, gaps], 1).ravel())
            words = np.zeros(len(inside), np.uint32)
            words[inside] = np.concatenate([ids for _, ids, _ in texts])
            one, two = _placed(words, places)
            one[~inside] = two[~inside] = len(known) + 1
            two[:-1][~inside[1:]] = len(known) + 1  # runs end with their text
            three = np.full(len(words), len(triples), np.int32)
            whole = inside[:-2] & inside[2:]
            three[:-2][whole] = places3(_runs(words, 3)[whole])
            at = [_starts(n, of.size, of.step) for n in lengths.tolist()]
            whose = np.repeat(np.arange(len(texts)), list(map(len, at)))
            at = np.concatenate(at) + begin[whose]
            rows, items = of.near(two, at)
            if not len(rows):
                return
            new = np.r_[True, rows[1:] != rows[:-1]]  # rows come in order
            used, back = rows[new], np.cumsum(new) - 1
            hi = np.minimum(at[used] + of.size, len(one))
            norm = np.sqrt(np.maximum(_sums(square[one] + square[two], at[used], hi), 1e-9)).astype(np.float32)
            v = np.empty((len(used), place.shape[1]), np.float32)
            for k in range(0, len(used), 512):  # in pieces that stay in a processor's cache
                spot = at[used[k : k + 512], None] + np.arange(of.size)
                np.minimum(spot, len(one) - 1, out=spot)
                v[k : k + 512] = _gathered(place, one, two, spot)
            v /= norm[:, None]
            order = np.argsort(items, kind="stable")
            rows, items, back = rows[order], items[order], back[order]
            cut = np.flatnonzero(np.r_[True, items[1:] != items[:-1], True])
            close: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi_ in zip(cut[:-1].tolist(), cut[1:].tolist()):
                c = int(items[lo])
                score = v[back[lo:hi_]] @ of.vectors[:, of.cut[c] : of.cut[c + 1]]
                r, g = np.nonzero(score >= near)
                close.append((rows[lo + r], of.cut[c] + g))
            row_, passage_ = (np.concatenate(x) for x in zip(*close))
            order = np.argsort(row_, kind="stable")
            row_, passage_ = row_[order], passage_[order]
            done: set[tuple[int, int]] = set()
            need = of.lengths - (of.lengths * LOST + 0.999).astype(int) - (of.reach + 1) // 2
            # the words around each passage; runs in a table of passages and runs, as many passages as it has room for
            step = max(1, len(table) // kinds_of_terms)
            for lo in range(0, len(used), step):
                some = slice(*np.searchsorted(row_, [used[lo], used[min(lo + step, len(used)) - 1] + 1]))
                if some.start == some.stop:
                    continue
                few, at_few = np.unique(row_[some], return_inverse=True)
                at_few = at_few.astype(np.int32)
                g = passage_[some]
                left = np.maximum(at[few] - of.size // 2, begin[whose[few]])
                spot = left[:, None] + np.arange(2 * of.size)
                out = spot >= np.minimum(at[few] + of.size + of.size // 2, (begin + lengths)[whose[few]])[:, None]
                np.minimum(spot, len(words) - 1, out=spot)
                one_, three_ = one[spot], three[spot]
                one_[out] = len(known) + 1
                three_[:, :-2][out[:, 2:]] = three_[:, -2:] = len(triples)
                cell = (np.arange(len(few))[:, None] * kinds_of_terms + np.concatenate([one_, len(known) + 2 + three_], 1)).ravel()
                cell.sort()
                run = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
                cell = cell[run[:-1]]
                table[cell] = np.minimum(np.diff(run), 254)
                ok = np.arange(len(g))
                for terms, nth, least in ((of.runs, of.runs_nth, of.few), (of.words, of.words_nth, of.most)):
                    x = g[ok]
                    ok = ok[np.count_nonzero(table[at_few[ok, None] * np.int32(kinds_of_terms) + terms[x]] >= nth[x], axis=1) >= least[x]]
                table[cell] = 0
                if not len(ok):
                    continue
                ok = ok[common_subsequences(of.words[g[ok]], one_[at_few[ok]]) >= need[of.cell[g[ok]]]]
                for row, j in zip(few[at_few[ok]].tolist(), g[ok].tolist()):
                    x, c = int(whose[row]), int(of.cell[j])
                    k = of.members[c]
                    if (x, k) in done:
                        continue
                    d, ids, _ = texts[x]
                    if _agrees(kept[k][1], rare[k], counts[k], RUN_CHARACTERS if wide else RUN, often, ids, int(of.starts[j]), int(at[row] - begin[x]), int(of.lengths[c]), (of.reach + 1) // 2):
                        done.add((x, k))
                        found_d.append(d)
                        found_i.append(kept[k][0])

        def all_of(texts: list[tuple[object, np.ndarray, bool]]) -> None:
            for wide in cells:
                some = [x for x in texts if x[2]] if wide else texts
                if some:
                    look(some, wide)

        limit = max(2000, min(_CHUNK_WORDS, _CHUNK_CELLS * STEP // max([1, *(len(x.members) for x in cells.values())])))
        for b in batches:
            waiting: list[tuple[object, np.ndarray, bool]] = []
            words = 0
            for d, t in zip(b["d"], b["t"]):
                ids, mainly = tok(t)
                for size, of in short.items():
                    if len(ids) >= size:
                        for p in np.flatnonzero(np.isin(ids[: len(ids) - size + 1], first[size])).tolist():
                            for i in of.get(ids[p : p + size].tobytes(), ()):
                                found_d.append(d)
                                found_i.append(i)
                if len(ids) < 5:
                    continue
                some = mainly or not t.isascii() and len(_WITHOUT_SPACES.findall(t)) >= CHARACTERS // 2
                waiting.append((d, ids, some))
                words += len(ids)
                if words > limit:
                    all_of(waiting)
                    waiting, words = [], 0
            if waiting:
                all_of(waiting)
            yield pd.DataFrame({doc_id: pd.Series(found_d, dtype=b["d"].dtype), item_id: pd.Series(found_i, dtype=id_type)})
            found_d.clear()
            found_i.clear()

    return docs.select("d", "t").mapInPandas(search, kinds).distinct()


def _gathered(place: np.ndarray, one: np.ndarray, two: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Sum of the places of the words and pairs at `spot` (passage x word). The pair that leaves a passage counts, as it does for the items' passages."""
    v = place[one[spot[:, 0]]] + place[two[spot[:, 0]]]
    for k in range(1, spot.shape[1]):
        v += place[one[spot[:, k]]]
        v += place[two[spot[:, k]]]
    return v
