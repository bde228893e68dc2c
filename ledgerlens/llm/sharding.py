"""Sharding by best-fit-decreasing bin packing: indivisible groups of equal texts go to shards of a fixed capacity.

Groups are sorted by size and enter the shard with the tightest remaining capacity that still takes them, found in a
balanced tree; a shard opens when none does. Groups of one size are handled together, so the driver needs the histogram
of group sizes only, in exact bytes. A corpus of T bytes has at most sqrt(2T) distinct sizes (1 + 2 + ... + n <= T), and
no more than its longest text has bytes plus the groups of copies: 0.25 million rows of the driver's memory at 30 GB.
Given a number of shards instead of a capacity, the least capacity is searched with which they suffice, by halving.

Groups are ranked within their size in chunks and find their shard by rank; documents find it through their group, and
their slot by a rank within the shard, again in chunks.

Texts are equal if their bytes are; null is a text of its own, of size 1 like the empty one. Documents that repeat are
of one group and have a slot each. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_within, written

SHARDS, CHUNK_ROWS = 8, 10_000


class Tree:
    """Ordered pairs in leaves of bounded size under one sorted root: insert, take out, and the least pair from a bound on."""

    LEAF = 512

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]

    def _leaf(self, pair: tuple[int, int]) -> int:
        return min(bisect_left(self.leaves, pair, key=lambda x: x[-1] if x else pair), len(self.leaves) - 1)

    def insert(self, pair: tuple[int, int]) -> None:
        at = self._leaf(pair)
        leaf = self.leaves[at]
        insort(leaf, pair)
        if len(leaf) > 2 * self.LEAF:
            self.leaves[at : at + 1] = [leaf[: self.LEAF], leaf[self.LEAF :]]

    def remove(self, pair: tuple[int, int]) -> None:
        at = self._leaf(pair)
        self.leaves[at].pop(bisect_left(self.leaves[at], pair))
        if not self.leaves[at] and len(self.leaves) > 1:
            self.leaves.pop(at)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least (remaining capacity, bin) with a capacity of size or more."""
        leaf = self.leaves[self._leaf((size, -1))]
        at = bisect_left(leaf, (size, -1))
        return leaf[at] if at < len(leaf) else None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Rows (size, rank from, rank to, bin) and the number of bins; a group above the capacity gets a bin of its own."""
    tree, rows, bins = Tree(), [], 0
    for size in sorted(histogram, reverse=True):
        n, rank = histogram[size], 0
        while rank < n:
            found = tree.tightest(size)
            if found is None:
                found = (max(capacity, size), bins)
                bins += 1
            else:
                tree.remove(found)
            left, into = found
            took = min(n - rank, left // size)
            rows.append((size, rank, rank + took, into))
            tree.insert((left - took * size, into))
            rank += took
    return rows, bins


def least_capacity(histogram: dict[int, int], shards: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """The packing of the least capacity found, by halving, that needs no more than `shards` bins."""
    if not histogram:
        return [], 0
    total = sum(s * n for s, n in histogram.items())
    low, high = max(-(-total // shards), max(histogram)), -(-total // shards) + max(histogram)
    best = best_fit_decreasing(histogram, high)
    while best[1] > shards:  # cannot be: bins that are left open would all be above the mean
        high *= 2
        best = best_fit_decreasing(histogram, high)
    while low < high:
        mid = (low + high) // 2
        tried = best_fit_decreasing(histogram, mid)
        if tried[1] <= shards:
            best, high = tried, mid
        else:
            low = mid + 1
    return best


def keyed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, _key): the key is a digest of the text's bytes, so texts are not shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    return docs.select(F.col(id_col), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("00"))).alias("_key"))


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot): every document, with equal texts in one shard.

    With a capacity (bytes), as few shards of it as best-fit-decreasing finds; else `shards` shards of near equal bytes.
    """
    spark = docs.sparkSession
    keyed = written(keyed_documents(docs, id_col, text_col), "keyed")
    groups = written(keyed.groupBy("_key").agg(F.sum("size").alias("bytes")), "groups")
    histogram = {r["bytes"]: r["n"] for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()}  # distinct sizes: see above
    plan, _ = best_fit_decreasing(histogram, capacity) if capacity else least_capacity(histogram, shards)
    placed = spark.createDataFrame(plan, "_bytes long, _from long, _to long, shard int")
    ranked = rank_within(groups, "bytes", ["_key"], chunk_rows, "_rank")
    on = (F.col("bytes") == F.col("_bytes")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    homes = ranked.join(placed, on).select("_key", "shard")
    out = written(keyed.join(homes, "_key").drop("_key"), "placed")
    return rank_within(out, "shard", [id_col, "text_crc32"], chunk_rows, "slot")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
