"""Filling containers of fixed capacity: first-fit decreasing over a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.plans.lineage import group_bounds, whole_groups

GROUP_ITEMS = 20_000


def byte_sizes(text: str = "text") -> Column:
    """Size under a byte-level tokenizer without merges: one token per UTF-8 byte, nothing added."""
    return F.octet_length(F.col(text)).cast("long")


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(path: str, pattern: str, text: str = "text") -> Column:
    """Size in tokens of a byte-level BPE whose ranks stand in the file ``path`` on every executor."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(path, pattern)
        return pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count(F.col(text))


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bins of items in the order given: each goes to the first bin with room, found in a tree of the bins' free space.

    Every inner node holds the largest free space below it, so that the first bin with room is one descent from the root.
    """
    bins = 2
    while bins < 2 * sum(sizes) / capacity + 2:  # first fit never half fills two bins, so it needs no more than this
        bins *= 2
    tree = [capacity] * (2 * bins)
    out = []
    for size in sizes:
        at = 1
        while at < bins:
            at *= 2
            if tree[at] < size:
                at += 1
        out.append(at - bins)
        tree[at] -= size
        at //= 2
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            most = a if a > b else b
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
    return out


def pack_group(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> pd.DataFrame:
    """Pieces of one group with their bins. What exceeds the capacity is cut into full pieces, which fill bins of their own, and a rest."""
    full, rest = sizes // capacity, sizes % capacity
    order = np.lexsort((ids, -rest))
    order = order[(rest[order] > 0) | (full[order] == 0)]
    bins = np.array(first_fit(rest[order].tolist(), capacity), np.int64)
    used = int(bins.max()) + 1 if bins.size else 0
    owner = np.repeat(np.arange(len(ids)), full)
    piece = np.arange(owner.size) - np.repeat(np.cumsum(full) - full, full)
    who = np.r_[owner, order]
    return pd.DataFrame(
        {
            "bin": np.r_[used + np.arange(owner.size), bins], "doc_id": ids[who], "piece": np.r_[piece, full[order]],
            "pieces": (full + (rest > 0) + (sizes == 0))[who], "start_token": np.r_[piece, full[order]] * capacity, "tokens": np.r_[np.full(owner.size, capacity), rest[order]],
        }
    )


def pack(documents: DataFrame, containers: DataFrame, size: Column | None = None, group_items: int = GROUP_ITEMS, seed: int = 17) -> DataFrame:
    """Every document in a bin of every kind of container: container_id, bin_id, doc_id, piece, pieces, start_token, tokens.

    ``size`` is a column of ``documents`` (bytes by default). Documents are dealt at random into groups of about ``group_items``,
    and each group is packed by first-fit decreasing (ties by doc_id). A document is cut only if it exceeds the capacity: then ``pieces``
    is above 1. An empty text is an item of no tokens; a null text, doc_id or capacity, or a capacity below 1, takes no part;
    repeated rows count once. Empty tables give an empty result; other columns are ignored. Only ids and sizes are shuffled.
    """
    kinds = containers.where("container_id is not null and capacity_tokens > 0").groupBy("container_id").agg(F.min("capacity_tokens").alias("capacity")).limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of container")
    items = documents.select("doc_id", (size if size is not None else byte_sizes()).alias("size")).where("doc_id is not null and size is not null")
    groups = max(1, ceil(documents.count() / group_items))
    offers = F.array(*[F.struct(F.lit(k.container_id).cast("int").alias("container_id"), F.lit(k.capacity).cast("long").alias("capacity")) for k in kinds]) if kinds else F.array().cast("array<struct<container_id:int,capacity:bigint>>")
    dealt = items.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).cast("long"))
    offered = dealt.withColumn("offer", F.explode(offers)).select("offer.container_id", "offer.capacity", "part", "doc_id", "size")
    keys = ["container_id", "part"]
    ready = offered.repartition(*keys).sortWithinPartitions(*keys, "doc_id")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, keys):
            edge = group_bounds(b, keys)
            for i, j in zip(edge[:-1], edge[1:]):
                g = b.iloc[i:j]
                ids = g.doc_id.to_numpy()
                once = np.r_[True, ids[1:] != ids[:-1]]
                out = pack_group(ids[once], g["size"].to_numpy()[once], int(g.capacity.iloc[0]))
                out.insert(0, "container_id", g.container_id.iloc[0])
                out["bin_id"] = (int(g.part.iloc[0]) << 32) + out.pop("bin")
                yield out[["container_id", "bin_id", "doc_id", "piece", "pieces", "start_token", "tokens"]]

    return ready.mapInPandas(fill, "container_id int, bin_id long, doc_id long, piece long, pieces long, start_token long, tokens long")
