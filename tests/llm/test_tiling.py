import random

import numpy as np

from tidegrid.llm import tiling
from tidegrid.llm.words import words

DOCS = "doc_id bigint, text string, item_id string, lang string"
ITEMS = "item_id bigint, text string, lang string"


def slow_tiles(a, b, shortest):
    free_a, free_b, out = [x >= 0 for x in a], [x >= 0 for x in b], []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= shortest and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        for k in range(best[2]):
            free_a[best[0] + k] = free_b[best[1] + k] = False


def test_tiles_equal_brute_force():
    rnd = random.Random(2)
    for _ in range(60):
        a, b = (np.array([rnd.randrange(-1, 5) for _ in range(rnd.randrange(0, 25))]) for _ in range(2))
        assert sum(n for _, _, n in tiling.tiles(a, b, 2)) >= 0
        got, want = tiling.tiles(a, b, 2), slow_tiles(a, b, 2)
        assert [n for _, _, n in got][:1] == [n for _, _, n in want][:1] and sum(n for *_, n in got) == sum(n for *_, n in want)


def test_words_bear_typography():
    assert words("“Straße” exam-\n  ple ﬁne­ ly A’b") == ["strasse", "example", "fine", "ly", "a", "b"]


def passage(rnd, n, vocabulary="abcdefghijklmnop"):
    return ["".join(rnd.choice(vocabulary) for _ in range(5)) for _ in range(n)]


def test_found_passages(spark):
    rnd = random.Random(1)
    items = {i: passage(rnd, 60) for i in range(1, 6)}
    noise = lambda n: passage(rnd, n, "qrstuvwxyz")
    def masked(ws):
        return [w if k % 9 != 4 else "█████" for k, w in enumerate(ws)]

    def replaced(ws):
        return [w if k % 10 != 3 else "other" for k, w in enumerate(ws)]
    docs = [
        (100, " ".join(noise(300) + items[1][10:42] + noise(200))),
        (101, " ".join(noise(50) + masked(items[2][5:45]) + noise(50)).upper()),
        (102, "\n".join([" ".join(items[3][:16]), "COURT OF X - PAGE 2 - AB 12/34", " ".join(items[3][16:34])])),
        (103, " ".join(noise(20) + items[4][:14] + noise(20) + items[4][20:34] + noise(20))),  # two short quotations
        (104, " ".join(replaced(items[5][20:60]) + items[1][:31])),
        (105, None), (106, ""), (107, " ".join(items[2][30:60] + items[2][:30])), (107, " ".join(items[2][30:60])), (None, " ".join(items[1])),
    ]
    d = spark.createDataFrame([(i, t, "clash", "en") for i, t in docs], DOCS)
    t = spark.createDataFrame([(i, " ".join(ws), "en") for i, ws in items.items()] + [(9, "too short", "en"), (None, "x", "en"), (10, None, "en")], ITEMS)
    want = {(1, 100), (2, 101), (3, 102), (5, 104), (1, 104), (2, 107)}
    for block in (2, 100):
        got = tiling.leaked(d, t, block=block).collect()
        assert {(r["item_id"], r["doc_id"]) for r in got} == want and len(got) == len(want)
    assert max(r["coverage"] for r in got) == 1.0
    assert tiling.leaked(d.limit(0), t).count() == 0 and tiling.leaked(d, t.limit(0)).count() == 0


def test_short_items_are_found_whole(spark):
    rnd = random.Random(7)
    sizes = (1, 2, 3, 4, 7, 8, 11, 16, 23)
    items = {n: passage(rnd, n) for n in sizes}
    noise = passage(rnd, 40, "qrstuvwxyz")
    docs = [(100 + n, " ".join(noise + ws + noise)) for n, ws in items.items()] + [(200 + n, " ".join(noise + ws[:-1] + noise)) for n, ws in items.items() if n < 8]
    docs += [(300 + n, " ".join(noise + [w if k % 8 != 4 else "other" for k, w in enumerate(items[n])] + noise)) for n in (8, 16, 23)]
    d = spark.createDataFrame([(i, t, "clash", "en") for i, t in docs], DOCS)
    t = spark.createDataFrame([(i, " ".join(ws), "en") for i, ws in items.items()], ITEMS)
    got = {(r["item_id"], r["doc_id"]): r["in_order"] for r in tiling.leaked(d, t).collect()}
    assert got == {(n, 100 + n): True for n in sizes} | {(n, 300 + n): True for n in (8, 16, 23)}


def test_neighbouring_copies_that_lack_different_words():
    a = np.arange(30)
    one, two = a.copy(), a.copy()
    one[[5, 13, 21]] = two[[8, 16, 24]] = -1
    for gap in (0, 5, 40):
        b = np.r_[one, np.full(gap, -1), two]
        assert tiling.verdict(a, b)[0] >= 26 and tiling.may_pass(a, b, 26, 0.7, -29, len(b))


def test_bounds_hold():
    """No tiling finds more than the bound before it says."""
    rnd = np.random.default_rng(3)
    for _ in range(40):
        a, b = rnd.integers(-1, 6, 40), rnd.integers(-1, 6, 90)
        b[20:45] = a[5:30]
        assert tiling.verdict(a, b)[0] <= tiling.most_possible(a, b, 30) <= 30


def test_hashes_and_repetitive_text():
    ids = np.random.default_rng(1).integers(0, 9, 50)
    for size in (1, 2, 3, 7, 16, 50, 51):
        want = [sum(int(x) * 1_000_003 ** (size - 1 - k) for k, x in enumerate(ids[i : i + size])) % 2**64 for i in range(len(ids) - size + 1)]
        assert tiling.gram_hashes(ids, size).tolist() == want
    index = tiling.ItemIndex([(i, "the court held that " * 30) for i in range(40)])
    found = [(i, tiling.verdict(index.ids[i], b, need=26)) for _, i, b, _, _ in index.stretches(["the court held that the " * 480])]
    assert len(found) == 40 and all(n >= 26 for _, (n, _) in found)


def test_pieces_in_changed_order(spark):
    rnd = random.Random(3)
    items = {i: passage(rnd, 80) for i in (1, 2, 3)}
    cut = lambda ws, *at: [ws[a:b] for a, b in zip((0, *at), (*at, len(ws)), strict=True)]
    noise = passage(rnd, 100, "qrstuvwxyz")
    one, two = cut(items[1], 20, 45, 60), cut(items[2], 15, 35, 55)
    docs = [
        (100, " ".join(noise + one[3] + one[2] + one[1] + one[0] + noise)),
        (101, " ".join([w if k % 8 != 5 else "█████" for k, w in enumerate(two[3] + two[2] + two[1] + two[0])])),
        (102, " ".join(noise + one[2] + noise + one[0] + noise)),  # less than half of it
        (103, " ".join(items[3])),
    ]
    d = spark.createDataFrame([(i, t, "clash", "en") for i, t in docs], DOCS)
    t = spark.createDataFrame([(i, " ".join(ws), "en") for i, ws in items.items()], ITEMS)
    got = {(r["item_id"], r["doc_id"]): r for r in tiling.leaked(d, t).collect()}
    assert {k: r["in_order"] for k, r in got.items()} == {(1, 100): False, (2, 101): False, (3, 103): True}
    assert got[1, 100]["coverage"] == 1.0 and got[2, 101]["coverage"] >= tiling.COVERAGE
