"""Filling containers of fixed capacity with texts measured in tokens."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
MOST_CAPACITIES = 1000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_counts(df: DataFrame, *, row_id: str, text: str, tokenizer_path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id, n_tokens) of each row: tokens of the whole text, 0 for a null or empty one. The vocabulary (fixed size) is broadcast."""
    sent = df.sparkSession.sparkContext.broadcast(load_ranks(tokenizer_path))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.text]
            yield pd.DataFrame({"id": batch.id, "n_tokens": np.array(sizes, dtype=np.int64)})

    return df.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(count, "id long, n_tokens long")


def pack_items(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (0..k-1). Sizes are at least 1 and at most capacity.

    Items above a third of the capacity go at most two to a container: the largest unmatched one takes the largest other
    that fits. The rest, in falling order, go where they leave the smallest gap; a new container only where none fits.
    """
    order = np.argsort(-sizes, kind="stable")
    where = np.full(len(sizes), -1, dtype=np.int64)
    gaps: list[int] = []
    large = [int(i) for i in order if sizes[i] * 3 > capacity]
    rising = large[::-1]
    keys = [int(sizes[i]) for i in rising]
    taken = [False] * len(rising)
    alive = list(range(len(rising)))  # union-find to the left over taken items

    def free(at: int) -> int:
        while at >= 0 and taken[at]:
            step = alive[at] = alive[at] - 1 if alive[at] == at else alive[alive[at]] if alive[at] >= 0 else -1
            at = step
        return at

    for at in range(len(rising) - 1, -1, -1):
        if taken[at]:
            continue
        taken[at] = True
        item, bin_id = rising[at], len(gaps)
        where[item] = bin_id
        left = capacity - int(sizes[item])
        mate = free(bisect_right(keys, left) - 1)
        if mate >= 0:
            taken[mate] = True
            where[rising[mate]] = bin_id
            left -= keys[mate]
        gaps.append(left)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for bin_id, gap in enumerate(gaps):
        by_gap[gap].append(bin_id)
        mask |= 1 << gap
    opened = len(gaps)
    for i in order[len(large) :]:
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            bin_id = by_gap[gap].pop()
            if not by_gap[gap]:
                mask ^= 1 << gap
        else:
            gap, bin_id = capacity, opened
            opened += 1
        where[i] = bin_id
        by_gap[gap - size].append(bin_id)
        mask |= 1 << (gap - size)
    return where


def pack_documents(
    documents: DataFrame,
    capacities: DataFrame,
    *,
    row_id: str = "doc_id",
    text: str = "text",
    capacity_id: str = "capacity_id",
    capacity: str = "capacity_tokens",
    tokenizer_path: str = DEFAULT_TOKENIZER,
    items_per_shard: int = 16_384,
) -> DataFrame:
    """(capacity_id, container_id, doc_id, piece, token_start, n_tokens): which document lies in which container of each capacity.

    Only a text longer than the capacity is cut, into full containers and one remaining piece, which is packed like a
    document; piece counts from 0. Null and empty texts get one row with a null container and 0 tokens. Repeated rows are
    packed each. Rows are spread by a hash over shards of about items_per_shard documents, each packed in one task: the
    group a task holds stays the same however many rows there are, and each shard leaves only its last containers underfull.
    Capacities that are null or below 1 are an error, as are more than MOST_CAPACITIES of them.
    """
    rows = capacities.select(F.col(capacity_id).cast("int").alias("c"), F.col(capacity).cast("int").alias("n")).limit(MOST_CAPACITIES + 1).collect()
    if len(rows) > MOST_CAPACITIES or any(r.n is None or r.n < 1 for r in rows):
        raise ValueError(f"pack_documents takes up to {MOST_CAPACITIES} capacities of at least one token")
    schema = "capacity_id int, container_id long, doc_id long, piece int, token_start long, n_tokens long"
    if not rows:
        return documents.sparkSession.createDataFrame([], schema)
    shards = max(1, -(-documents.count() // items_per_shard))
    sizes = token_counts(documents, row_id=row_id, text=text, tokenizer_path=tokenizer_path)
    wanted = F.explode(F.array(*[F.struct(F.lit(r.c).alias("capacity_id"), F.lit(r.n).alias("capacity")) for r in rows])).alias("w")
    spread = sizes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    items = spread.select("id", "n_tokens", "shard", wanted).select("id", "n_tokens", "shard", "w.capacity_id", "w.capacity")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        cap, base = int(group.capacity.iloc[0]), int(group.shard.iloc[0]) << 32
        group = group.sort_values(["id", "n_tokens"], kind="stable")
        ids, sizes = group.id.to_numpy(), group.n_tokens.to_numpy()
        full, rest = sizes // cap, sizes % cap
        has = rest > 0
        bins = pack_items(rest[has], cap)
        next_bin = int(bins.max()) + 1 if len(bins) else 0
        n_full = int(full.sum())
        owner = np.repeat(np.arange(len(ids)), full)
        nth = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
        none = sizes == 0
        container = pd.array(np.concatenate([base + bins, base + next_bin + np.arange(n_full), np.zeros(int(none.sum()), dtype=np.int64)]), dtype="Int64")
        if none.any():
            container[-int(none.sum()) :] = pd.NA
        return pd.DataFrame(
            {
                "capacity_id": int(group.capacity_id.iloc[0]),
                "container_id": container,
                "doc_id": pd.array(np.concatenate([ids[has], ids[owner], ids[none]]), dtype="Int64"),
                "piece": np.concatenate([full[has], nth, full[none]]).astype("int32"),
                "token_start": np.concatenate([full[has] * cap, nth * cap, full[none]]),
                "n_tokens": np.concatenate([rest[has], np.full(n_full, cap), sizes[none]]),
            }
        )

    return items.groupBy("capacity_id", "shard").applyInPandas(pack, schema)


def fill_report(containers: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers used, tokens held, the fewest containers any packing could use for so many tokens, and the filled share."""
    per = containers.where("container_id IS NOT NULL").groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    totals = per.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("items").alias("items"))
    joined = totals.join(capacities.select(F.col("capacity_id").cast("int"), F.col("capacity_tokens").cast("long")), "capacity_id")
    return joined.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
