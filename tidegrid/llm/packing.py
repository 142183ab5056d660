"""Filling containers of fixed capacity with documents, by sum-of-squares online packing.

Documents are sized in tokens of a public tokenizer and dealt by a hash into shards of bounded size. Inside a shard each
document is placed where it minimises the sum over levels of (number of open containers filled to that level) squared;
the counts stand in one array over the levels. A document larger than a container is cut into full containers and a
rest. Containers left open by the shards are dealt once more into fewer shards and packed together as if each were one
item, so that a shard's border leaves little unused space. Inside a shard documents come in an order that follows from
their ids alone, so a packing can be repeated, and a task run again gives what it gave before.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_DOCS = 20_000
REGROUP = 8
#: Profiles that a packing may have; they are a short list by their meaning.
MOST_PROFILES = 1000

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tiktoken encoding of a vocabulary file of ranks; one per process and path."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, tokens: the whole text's length in tokens; a null text has none. The vocabulary file `tokenizer` need only
    be on the driver: executors get it with the job."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(SparkFiles.get(name)).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(encode(t)) if t else 0 for t in pdf["text"]]})

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, tokens bigint")


class Shelf:
    """Open containers by fill level. levels[h] holds how many are filled to h; stacks[h] which ones."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.stacks: dict[int, list[int]] = {}
        self.made = 0

    def place(self, size: int) -> int:
        """Puts an item of 1..capacity into a container and returns the container's number."""
        cap, levels = self.capacity, self.levels
        target = self._level(size)
        if target:
            stack = self.stacks[target]
            box = stack.pop()
            levels[target] -= 1
        else:
            box = self.made
            self.made += 1
        full = target + size
        if full < cap:
            levels[full] += 1
            self.stacks.setdefault(full, []).append(box)
        return box

    def _level(self, size: int) -> int:
        """The level to add to (0: a new container). Moving one container from h to h+s changes the sum of squares by
        2*(levels[h+s] - levels[h] + 1), filling one up by 1 - 2*levels[h], a new one by 1 + 2*levels[s]."""
        cap, levels = self.capacity, self.levels
        if size == cap:
            return 0
        fits = levels[1 : cap - size + 1]
        open_at = np.flatnonzero(fits)
        if not len(open_at):
            return 0
        h = open_at + 1
        change = 2 * (levels[h + size] - levels[h] + 1)
        if h[-1] == cap - size:
            change[-1] = 1 - 2 * levels[h[-1]]
        best = len(change) - 1 - int(np.argmin(change[::-1]))  # ties: the fuller container
        return int(h[best]) if change[best] <= 1 + 2 * levels[size] else 0

    def open_boxes(self) -> dict[int, int]:
        """Container -> fill of those not full."""
        return {box: h for h, stack in self.stacks.items() for box in stack}


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard of one profile: rows (unit, part, size, turn) in order of (turn, unit, part, size) to rows with box
    (number) and fill. turn is a hash of the unit, so that sizes come as if by chance."""
    pdf = pdf.sort_values(["turn", "unit", "part", "size"], kind="stable", ignore_index=True)
    capacity = int(pdf["capacity"].iloc[0])
    shelf, boxes = Shelf(capacity), np.empty(len(pdf), np.int64)
    for i, size in enumerate(pdf["size"].to_numpy()):
        boxes[i] = shelf.place(int(size))
    fills = np.full(max(shelf.made, 1), capacity, np.int64)
    for box, h in shelf.open_boxes().items():
        fills[box] = h
    return pd.DataFrame({"profile_id": key[0], "shard": key[1], "unit": pdf["unit"], "part": pdf["part"], "size": pdf["size"], "box": boxes, "fill": fills[boxes], "capacity": capacity})


PACKED = "profile_id int, shard bigint, unit string, part int, size bigint, box bigint, fill bigint, capacity int"


def packed(documents: DataFrame, profiles: DataFrame, tokenizer: str = TOKENIZER, shard_docs: int = SHARD_DOCS, regroup: int = REGROUP) -> DataFrame:
    """Every document in a container of every profile: profile_id, container_id, doc_id, part, n_tokens, fill, capacity.

    A document of at most `capacity` tokens has one row (part 0). A larger one has rows part 0, 1, ...: full containers
    of its own, and its rest packed like another document. Empty and null texts need no space: they have one row with
    n_tokens 0 in a container named `empty`, which holds nothing else. Equal documents are packed each for itself; a
    doc_id given twice is packed twice. Null doc_ids, and profiles without a capacity of at least one token, are left
    out; more than MOST_PROFILES profiles are a ValueError. container_id is unique in its profile; fill is the container's total. Empty tables give no rows, extra columns
    are ignored. Shards number one per `shard_docs` documents, so the work of a task doesn't follow the data.
    """
    from tidegrid.plans.session import written

    sizes = written(token_sizes(documents, tokenizer))
    shards = max(1, -(-sizes.count() // shard_docs))
    cups = profiles.where("capacity_tokens >= 1").select(F.col("profile_id").cast("int").alias("profile_id"), F.col("capacity_tokens").cast("int").alias("capacity"))
    # pack_profiles is a small fixed table; each size row is repeated once per profile
    pairs = [(r["profile_id"], r["capacity"]) for r in cups.distinct().limit(MOST_PROFILES + 1).collect()]
    if len(pairs) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile_id"), F.lit(c).alias("capacity")) for p, c in pairs])) if pairs else F.explode(F.array().cast("array<struct<profile_id:int,capacity:int>>"))
    rows = sizes.select("doc_id", "tokens", each.alias("p")).select("doc_id", "tokens", "p.profile_id", "p.capacity")
    empty = rows.where("tokens = 0").select("profile_id", F.lit("empty").alias("container_id"), "doc_id", F.lit(0).alias("part"), F.col("tokens").alias("n_tokens"), F.lit(0).cast("bigint").alias("fill"), "capacity")
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    rest = (F.col("tokens") % F.col("capacity")).cast("bigint")
    rows = rows.where("tokens > 0").withColumn("full", full).withColumn("rest", rest)
    whole = rows.where("full > 0").select("profile_id", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"))
    whole = whole.select("profile_id", F.concat_ws("-", F.lit("w"), "doc_id", "part").alias("container_id"), "doc_id", "part", F.col("capacity").cast("bigint").alias("n_tokens"), F.col("capacity").cast("bigint").alias("fill"), "capacity")
    hashed = F.xxhash64("doc_id")
    items = rows.where("rest > 0").select("profile_id", "capacity", F.pmod(hashed, F.lit(shards)).alias("shard"), F.col("doc_id").cast("string").alias("unit"), F.col("full").alias("part"), F.col("rest").alias("size"), hashed.alias("turn"))
    first = written(items.groupBy("profile_id", "shard").applyInPandas(_pack, PACKED))
    name = F.concat_ws("-", F.lit("s"), "shard", "box")
    fewer = max(1, -(-shards // regroup))
    left = first.where("fill < capacity").select("profile_id", "capacity", F.pmod(F.col("shard"), F.lit(fewer)).alias("shard"), name.alias("unit"), F.lit(0).alias("part"), F.col("fill").alias("size"), F.xxhash64(name).alias("turn")).distinct()
    again = written(left.groupBy("profile_id", "shard").applyInPandas(_pack, PACKED))
    moved = again.select("profile_id", F.col("unit").alias("old"), F.concat_ws("-", F.lit("m"), "shard", "box").alias("new"), F.col("fill").alias("new_fill"))
    inside = first.withColumn("old", name).join(moved, ["profile_id", "old"], "left")
    inside = inside.select("profile_id", F.coalesce("new", "old").alias("container_id"), F.col("unit").cast("bigint").alias("doc_id"), "part", F.col("size").alias("n_tokens"), F.coalesce("new_fill", "fill").alias("fill"), "capacity")
    return inside.unionByName(whole).unionByName(empty)
