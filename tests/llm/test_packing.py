import os

import numpy as np
import pytest

from tidegrid.llm import packing

pytestmark = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="the tokenizer file isn't here")
DOCS = "doc_id bigint, text string, capacity string, unit string"
CUPS = "profile_id int, profile_name string, capacity_tokens int"


def plain_level(levels, capacity, size):
    """The best fill level by trying all of them."""
    def total(changed):
        return sum(n * n for h, n in changed.items() if 0 < h < capacity)

    options = []
    for h in [0, *sorted((h for h, n in levels.items() if n and h + size <= capacity), reverse=True)]:
        after = dict(levels)
        if h:
            after[h] -= 1
        after[h + size] = after.get(h + size, 0) + 1
        options.append((total(after), h == 0, -h, h))
    return min(options)[3]


def test_places_like_brute_force():
    rng = np.random.default_rng(0)
    for capacity in (1, 7, 20, 50):
        shelf, levels = packing.Shelf(capacity), {}
        for size in rng.integers(1, capacity + 1, 300):
            want = plain_level(levels, capacity, int(size))
            assert shelf._level(int(size)) == want
            shelf.place(int(size))
            if want:
                levels[want] -= 1
            if want + size < capacity:
                levels[want + size] = levels.get(want + size, 0) + 1
        assert {h: n for h, n in levels.items() if n} == {h: len(s) for h, s in shelf.stacks.items() if s}


def test_every_document_once_and_nothing_overfull(spark):
    rng = np.random.default_rng(1)
    docs = [(i, "word " * int(rng.integers(1, 90)), "", "") for i in range(400)] + [(900, None, "", ""), (901, "", "", ""), (902, "a b c " * 400, "", ""), (903, "same", "", ""), (904, "same", "", ""), (None, "x", "", "")]
    cups = [(1, "s", 50), (2, "l", 300), (3, "none", 0), (4, "null", None)]
    args = spark.createDataFrame(docs, DOCS), spark.createDataFrame(cups, CUPS)
    sizes = {r["doc_id"]: r["tokens"] for r in packing.token_sizes(args[0]).collect()}
    assert sizes[900] == sizes[901] == 0 and sizes[902] > 1000
    got = packing.packed(*args, shard_docs=60, regroup=3).toPandas()
    assert set(got["profile_id"]) == {1, 2}
    for (profile, capacity), part in got.groupby(["profile_id", "capacity"]):
        assert part.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes
        assert not part.duplicated(["doc_id", "part"]).any()
        assert (part.loc[part["doc_id"].map(sizes) <= capacity].groupby("doc_id").size() == 1).all()
        fills = part.groupby("container_id")["n_tokens"].sum()
        assert fills.max() <= capacity and (part.set_index("container_id")["fill"] == fills.reindex(part["container_id"]).to_numpy()).all()
        least = -(-sum(sizes.values()) // capacity)
        assert (fills > 0).sum() <= 1.25 * least + 3


def test_a_packing_can_be_repeated(spark):
    """Rows in another order and other partitions, documents given twice among them, lie in the same containers."""
    rng = np.random.default_rng(4)
    docs = [(i % 290, "word " * int(rng.integers(1, 60)), "", "") for i in range(300)]
    cups = spark.createDataFrame([(1, "s", 64)], CUPS)
    some = [sorted(map(tuple, packing.packed(spark.createDataFrame(rows, DOCS).repartition(n), cups, shard_docs=50, regroup=2).collect())) for rows, n in ((docs, 3), (docs[::-1], 7))]
    assert some[0] == some[1]


def test_profiles_are_a_short_list(spark):
    cups = spark.range(packing.MOST_PROFILES + 1).selectExpr("cast(id as int) as profile_id", "'x' as profile_name", "100 + cast(id as int) as capacity_tokens")
    with pytest.raises(ValueError):
        packing.packed(spark.createDataFrame([(1, "a", "", "")], DOCS), cups)


def test_empty_tables(spark):
    docs, cups = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "s", 50)], CUPS)
    assert packing.packed(docs, cups).count() == 0
    assert packing.packed(spark.createDataFrame([(1, "a", "", "")], DOCS), cups.limit(0)).count() == 0
