"""Passages of test items inside a corpus, by greedy string tiling.

Items are indexed by Karp-Rabin hashes of their word n-grams (seeds). Every document is read once; its seeds are found
by a rolling hash over all its words and joined with the index. Where enough seeds of one item lie close together, the
stretch of the document and the item are tiled: the longest common run of words not yet covered is marked again and
again, found by running Karp-Rabin with falling lengths. The tiles' coverage of the item, in any stretch of `passage`
of its words, decides; tiles may lie apart by masked words or page headers. A document whose tiles, in any order, cover
most of the whole item comes out too, marked as not in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.words import words

SEED = 4
PASSAGE = 30
#: Words of a passage that must be found: all but one in eight.
SHARE = 7 / 8
#: Share of an item's words from which its tiles count in any order. In sf0.1 documents without a passage of the item
#: reach 0.55; with one word in eight lost, and some more at the cuts between pieces, above 0.7 are left.
COVERAGE = 0.7
#: Words by which a page header may push a passage's rest down the document.
DRIFT = 20
#: Seeds that a passage keeps at least, with one word in eight lost and one interruption. Short items have fewer.
LEAST_SEEDS = 8
#: Items, and characters of theirs, indexed at once; more are read block by block, each block against all documents.
BLOCK_ITEMS = 20_000
BLOCK_CHARACTERS = 8_000_000
#: Pairs of positions, or of a position and an item, that are looked at together.
TOGETHER = 4_000_000

BASE = np.uint64(1_000_003)


def gram_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of all runs of `size` ids, put together from those of runs of 1, 2, 4, ... ids."""
    if len(ids) < size or size < 1:
        return np.zeros(0, np.uint64)
    block, power, length = ids.astype(np.uint64), BASE, 1
    out, held = np.zeros(0, np.uint64), 0
    with np.errstate(over="ignore"):
        while True:
            if size & length:
                n = len(ids) - held - length + 1
                out = out[:n] * power + block[held : held + n] if held else block.copy()
                held += length
            if held == size:
                return out
            block = block[:-length] * power + block[length:]
            power, length = power * power, length * 2


def tiles(a: np.ndarray, b: np.ndarray, shortest: int = 2, low: int | None = None, high: int | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of id arrays: (start in a, start in b, length), longest first, no word used twice.
    With `low` and `high` only tiles whose start in b less that in a lies between them.

    Ties go to the earlier start in a, then in b. Ids below zero match nothing. Karp-Rabin runs with lengths that fall
    from that of the shorter array by halves, so that all runs of one pass are at least as long as those of the next."""
    free_a, free_b = a >= 0, b >= 0
    found: list[tuple[int, int, int]] = []
    size = max(shortest, min(len(a), len(b)))
    while True:
        i, j, n = _runs(a, b, free_a, free_b, size)
        if low is not None:
            place = (j - i >= low) & (j - i <= high)
            i, j, n = i[place], j[place], n[place]
        order = np.lexsort((j, i, -n))
        i, j, n = i[order], j[order], n[order]
        left = False
        while len(i):
            x, y, k = int(i[0]), int(j[0]), int(n[0])
            free_a[x : x + k] = free_b[y : y + k] = False
            found.append((x, y, k))
            # of the other runs those stay that share no word with it
            apart = ((i >= x + k) | (i + n <= x)) & ((j >= y + k) | (j + n <= y))
            left |= not apart[1:].all()
            i, j, n = i[apart], j[apart], n[apart]
        if left:
            continue
        if size == shortest:
            return found
        size = max(shortest, size // 2)


def _runs(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal common runs of free words of at least `size`: starts in a and b, lengths."""

    def opened(free: np.ndarray) -> np.ndarray:
        if len(free) < size:
            return np.zeros(0, np.int64)
        total = np.r_[0, np.cumsum(free)]
        return np.flatnonzero(total[size:] - total[:-size] == size)

    nothing = np.zeros(0, np.int64)
    open_a, open_b = opened(free_a), opened(free_b)
    if not len(open_a) or not len(open_b):
        return nothing, nothing, nothing
    ha, hb = gram_hashes(a, size)[open_a], gram_hashes(b, size)[open_b]
    order = np.argsort(ha, kind="stable")
    lo, hi = np.searchsorted(ha[order], hb, "left"), np.searchsorted(ha[order], hb, "right")
    some = np.flatnonzero(hi > lo)
    parts = []
    for block in np.array_split(some, max(1, -(-int((hi - lo)[some].sum()) // TOGETHER))):
        reps = (hi - lo)[block]
        j = np.repeat(open_b[block], reps)
        i = open_a[order[np.repeat(lo[block] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())]] if len(block) else nothing
        longer = (i > 0) & (j > 0) & (a[i - 1] == b[j - 1]) & free_a[i - 1] & free_b[j - 1]  # inside a longer run
        i, j = i[~longer], j[~longer]
        for k in range(size):  # equal hashes of unequal words fall away
            same = a[i + k] == b[j + k]
            if not same.all():
                i, j = i[same], j[same]
        n = np.full(len(i), size)
        on = np.arange(len(i))
        while len(on):
            x, y = i[on] + n[on], j[on] + n[on]
            on, x, y = (z[(x < len(a)) & (y < len(b))] for z in (on, x, y))
            on = on[(a[x] == b[y]) & free_a[x] & free_b[y]]
            n[on] += 1
        parts.append((i, j, n))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _most(a: np.ndarray, b: np.ndarray, marks: list[tuple[int, int, int]], width: int, drift: int) -> int:
    """Most words of a stretch of `width` words of `a` that tiles within `drift` diagonals cover, single words beside
    them on the tiles' diagonals included."""
    best = 0
    diagonals = sorted({j - i for i, j, _ in marks})
    for d in diagonals:
        near = [x for x in diagonals if d <= x <= d + drift]
        hit = np.zeros(len(a), bool)
        for i, j, n in marks:
            if d <= j - i <= d + drift:
                hit[i : i + n] = True
        close = np.convolve(hit, np.ones(9, int), "same")[: len(a)] > 0 if len(a) >= 9 else np.full(len(a), hit.any())
        for x in near:
            i = np.arange(max(0, -x), min(len(a), len(b) - x))
            hit[i] |= (a[i] == b[i + x]) & close[i] & (a[i] >= 0)
        total = np.r_[0, np.cumsum(hit)]
        best = max(best, int((total[width:] - total[:-width]).max()))
    return best


def verdict(a: np.ndarray, b: np.ndarray, passage: int = PASSAGE, drift: int = DRIFT, need: int | None = None) -> tuple[int, float]:
    """Most words of a stretch of `passage` words of item `a` that tiles lying in one place of `b` cover (single words
    on the tiles' diagonals included), and the share of the item that all tiles cover.

    Where tiles lie in several places, as those of two quotations do that lack different words, and none shows `need`
    words, every place is tiled by itself as well, so that none takes another's words."""
    shortest = min(2, len(a))
    marks = tiles(a, b, shortest) if len(a) else []
    if not marks:
        return 0, 0.0
    covered = sum(n for _, _, n in marks) / len(a)
    width = min(passage, len(a))
    best = _most(a, b, marks, width, drift)
    diagonals = np.array(sorted({j - i for i, j, _ in marks}))
    cuts = np.flatnonzero(np.diff(diagonals) > drift) + 1
    if best < (width if need is None else need) and len(cuts):
        for place in np.split(diagonals, cuts):
            low, high = int(place[0]) - drift, int(place[-1]) + drift
            if most_possible(a, b[max(0, low) : max(0, high + len(a))], width, drift) > best:
                best = max(best, _most(a, b, tiles(a, b, shortest, low, high), width, drift))
    return best, covered


def most_possible(a: np.ndarray, b: np.ndarray, width: int, drift: int = DRIFT, low: int | None = None, high: int | None = None) -> int:
    """A bound on the words `verdict` can find: most words of a stretch of `width` words of a that stand anywhere on
    drift+1 neighbouring diagonals of b, the first of which lies between `low` and `high`."""
    begin, end = -len(a) + 1 if low is None else low, len(b) if high is None else high + 1
    best, size = 0, max(drift + 1, TOGETHER // max(1, len(a)))
    for lo in range(begin, end, size):
        diagonals = np.arange(lo, min(lo + size, end) + drift)
        at = diagonals[:, None] + np.arange(len(a))
        equal = (at >= 0) & (at < len(b)) & (a >= 0)
        equal &= b[np.clip(at, 0, len(b) - 1)] == a
        upto = np.zeros((len(equal) + 1, len(a)), np.int32)
        np.cumsum(equal, 0, out=upto[1:])
        some = upto[drift + 1 :] > upto[: -drift - 1]
        total = np.zeros((len(some), len(a) + 1), np.int32)
        np.cumsum(some, 1, out=total[:, 1:])
        best = max(best, int((total[:, width:] - total[:, : len(a) + 1 - width]).max()))
    return best


def places(ha: np.ndarray, order: np.ndarray, hb: np.ndarray, size: int, least: int, drift: int = DRIFT) -> tuple[int, int] | None:
    """The first and the last diagonal from which `least` seeds lie within `drift` diagonals; None without any. ha: the
    item's seeds in order, order: their places, hb: the text's seeds, size: words of the item."""
    lo, hi = np.searchsorted(ha, hb, "left"), np.searchsorted(ha, hb, "right")
    some = np.flatnonzero(hi > lo)
    lo, reps = lo[some], (hi - lo)[some]
    upto = np.cumsum(reps)
    if not len(some) or upto[-1] < least:
        return None
    i = order[np.repeat(lo - upto + reps, reps) + np.arange(upto[-1])]
    on = np.zeros(size + len(hb) + drift + 1, np.int64)
    np.cumsum(np.bincount(np.repeat(some, reps) - i + size - 1, minlength=len(on) - 1), out=on[1:])
    enough = np.flatnonzero(on[drift + 1 :] - on[: -drift - 1] >= least)
    # bands that begin before the first diagonal with a seed hold no more than the one that begins there
    return (int(enough[0]) - size + 1, int(enough[-1]) - size + 1) if len(enough) else None


def may_pass(a: np.ndarray, b: np.ndarray, need: int, least_coverage: float, low: int, high: int, passage: int = PASSAGE, drift: int = DRIFT) -> bool:
    """Whether tiles of a in b can reach `need` words in a place that begins between the diagonals `low` and `high`, or
    `least_coverage` of an a of at least `passage` words. No tiling exceeds these bounds, so nothing is lost."""
    if len(a) < SEED or most_possible(a, b, min(passage, len(a)), drift, low - drift, high + drift) >= need:
        return True
    pairs = np.isin(gram_hashes(a, 2), gram_hashes(b, 2))  # every tile has two words at least
    return len(a) >= passage and (np.r_[pairs, False] | np.r_[False, pairs]).mean() >= least_coverage


def least_words(n: int, passage: int = PASSAGE, share: float = SHARE) -> int:
    """Words that must be found of an item of n words; all of them if it has fewer than eight."""
    return int(share * min(passage, n)) if n >= 8 else max(1, n)


def least_seeds(n: int, seed: int = SEED) -> int:
    """Seeds that an item of n words keeps at least with one word in eight lost."""
    return max(1, min(LEAST_SEEDS, n - seed + 1 - seed * (n // 8)))


class ItemIndex:
    """Seeds of a block of items; items too short for a seed by themselves."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED) -> None:
        self.seed = seed
        self.vocabulary: dict[str, int] = {}
        self.names = np.array([i for i, _ in items], np.int64)
        self.ids = []
        for _, text in items:
            self.ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")], np.int64))
        hashes = [gram_hashes(x, seed) for x in self.ids]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        order = np.lexsort((item, every))
        every, item = every[order], item[order]
        new = np.ones(len(every), bool)  # an item once per seed
        new[1:] = (every[1:] != every[:-1]) | (item[1:] != item[:-1])
        self.item = item[new]
        self.keys, self.start = np.unique(every[new], return_index=True)
        self.count = np.diff(np.r_[self.start, len(self.item)])
        orders = [np.argsort(h, kind="stable") for h in hashes]
        self.seeds = [(h[o], o) for h, o in zip(hashes, orders, strict=True)]
        self.least = np.array([least_seeds(len(x), seed) for x in self.ids], np.int64)
        self.room = np.array([len(x) for x in self.ids], np.int64)
        self.tiny = {n: np.flatnonzero(self.room == n) for n in range(1, seed) if (self.room == n).any()}

    def stretches(self, texts: list[str | None], drift: int = DRIFT, passage: int = PASSAGE) -> Iterator[tuple[int, int, np.ndarray, int, int]]:
        """(text number, item number, ids of the text's stretch, first and last diagonal of its places) wherever seeds of
        the item lie close enough: as many as a passage keeps, on different words of the text, within the words of a
        passage and an interruption, and within `drift` diagonals."""
        get, gap = self.vocabulary.get, np.full(self.seed, -1, np.int64)
        parts: list[np.ndarray] = []
        for t in texts:
            w = words(t) if t else []
            parts.append(np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)))
            parts.append(gap)
        ids = np.concatenate(parts) if parts else gap
        begin = np.r_[0, np.cumsum([len(p) for p in parts])]
        for n, some in self.tiny.items():
            own = gram_hashes(np.concatenate([self.ids[i] for i in some]), n)[::n]
            h = gram_hashes(ids, n)
            for i, x in zip(some, own, strict=True):
                at = np.flatnonzero(h == x)
                at = at[[bool((ids[k : k + n] == self.ids[i]).all()) for k in at]] if len(at) else at
                for t in np.unique(np.searchsorted(begin, at, "right") - 1 >> 1):
                    yield int(t), int(i), self.ids[i], 0, 0
        if not len(self.keys):
            return
        known = np.flatnonzero(np.convolve(ids >= 0, np.ones(self.seed, int), "valid") == self.seed)
        every = gram_hashes(ids, self.seed)
        h = every[known]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        same = self.keys[at] == h
        known, at = known[same], at[same]
        if not len(known):
            return
        slices = max(1, -(-int(self.count[at].sum()) // TOGETHER))
        for some in np.array_split(np.arange(len(self.names)), min(slices, len(self.names))):
            yield from self._near(ids, every, begin, known, at, int(some[0]), int(some[-1]) + 1, passage - self.seed + drift, drift)

    def _near(self, ids: np.ndarray, every: np.ndarray, begin: np.ndarray, known: np.ndarray, at: np.ndarray, low: int, high: int, reach: int, drift: int) -> Iterator[tuple[int, int, np.ndarray, int, int]]:
        """The stretches of the items `low` to `high` (exclusive); every: hashes of the texts, known: places of seeds
        among them, at: their numbers."""
        mine = (self.item >= low) & (self.item < high)
        upto = np.r_[0, np.cumsum(mine)]
        first, last = upto[self.start], upto[self.start + self.count]
        items = self.item[mine]
        reps = (last - first)[at]
        pos = np.repeat(known, reps)
        item = items[np.repeat(first[at] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())]
        text = np.searchsorted(begin, pos, "right") - 1 >> 1
        pair = text * len(self.names) + item
        order = np.argsort(pair, kind="stable")
        pair, pos, item = pair[order], pos[order], item[order]
        end = np.arange(len(pos)) + self.least[item] - 1
        ok = end < len(pos)
        end = np.minimum(end, max(0, len(pos) - 1))
        ok &= (pair[end] == pair) & (pos[end] - pos <= reach)
        pair, lo, hi, item = pair[ok], pos[ok], pos[end[ok]], item[ok]
        if not len(pair):
            return
        text = pair // len(self.names)
        lo = np.maximum(begin[2 * text], lo - self.room[item] - drift)
        hi = np.minimum(begin[2 * text + 1], hi + self.room[item] + drift)
        new = np.r_[True, (pair[1:] != pair[:-1]) | (lo[1:] > hi[:-1])]
        firsts = np.flatnonzero(new)
        lasts = np.r_[firsts[1:] - 1, len(pair) - 1]
        for f, g in zip(firsts, lasts, strict=True):
            i = int(item[f])
            place = places(*self.seeds[i], every[lo[f] : hi[g] - self.seed + 1], len(self.ids[i]), int(self.least[i]), drift)
            if place:
                yield int(text[f]), i, ids[lo[f] : hi[g]], *place


def _blocks(items: DataFrame, size: int, characters: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of `size` items and about `characters` characters at most (one longer item is a block by itself),
    each small enough for a worker; the driver holds one block at a time."""
    block: list[tuple[int, str]] = []
    held = 0
    for r in items.where("item_id is not null").groupBy("item_id").agg(F.max("text").alias("text")).orderBy("item_id").toLocalIterator():
        n = len(r["text"] or "")
        if block and (len(block) >= size or held + n > characters):
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += n
    if block:
        yield block


LEAKED = "item_id bigint, doc_id bigint, words_found int, coverage double, in_order boolean"


def leaked(documents: DataFrame, items: DataFrame, passage: int = PASSAGE, share: float = SHARE, block: int = BLOCK_ITEMS, least_coverage: float = COVERAGE) -> DataFrame:
    """Documents that hold a passage of an item: item_id, doc_id, words_found (most words of a stretch of `passage`
    words of the item found in one place of the document), coverage (share of the item's words tiled there), in_order.

    A pair comes out in order if a stretch of `passage` consecutive words of the item is found but for 1-`share` of its
    words. Else it comes out, not in order, if tiles cover `least_coverage` of an item of at least `passage` words: its
    pieces stand in another order, no further apart than the item's length. Pieces need 11 words or more to be seen.
    Items shorter than `passage` words are found if so much of the whole item is, and items of fewer than eight words if
    all of it is. Case, punctuation, spacing, typography
    and line breaks play no part; masked or replaced words and a page header between the words are borne. Null or empty
    texts hold nothing; null ids are left out; an item_id given twice counts with its greater text; a doc_id given twice
    comes out once with its greatest figures. Empty tables give no rows, extra columns are ignored. Items are
    broadcast in blocks of `block` items and BLOCK_CHARACTERS characters, and every block is held against all documents.
    """
    found: DataFrame | None = None
    rows = documents.where("doc_id is not null").select("doc_id", "text")
    context = documents.sparkSession.sparkContext
    for some in _blocks(items, block, BLOCK_CHARACTERS):
        index = context.broadcast(ItemIndex(some))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            ix = index.value
            for pdf in batches:
                ids, out = pdf["doc_id"].to_numpy(), []
                for t, i, stretch, low, high in ix.stretches(pdf["text"].to_list(), passage=passage):
                    need = least_words(len(ix.ids[i]), passage, share)
                    if not may_pass(ix.ids[i], stretch, need, least_coverage, low, high, passage):
                        continue
                    n, covered = verdict(ix.ids[i], stretch, passage, need=need)
                    in_order = n >= need
                    if in_order or covered >= least_coverage and len(ix.ids[i]) >= passage:
                        out.append((ix.names[i], ids[t], n, covered, in_order))
                yield pd.DataFrame(out, columns=["item_id", "doc_id", "words_found", "coverage", "in_order"])

        part = rows.mapInPandas(run, LEAKED)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.sparkSession.createDataFrame([], LEAKED)
    return found.groupBy("item_id", "doc_id").agg(*[F.max(c).alias(c) for c in ("words_found", "coverage", "in_order")])
