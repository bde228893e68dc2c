"""SimHash near-duplicates by a segment-popcount embedding.

Embedding: the 64 bits form 32 segments of two neighbouring bits; a fingerprint becomes the vector of their bit counts
(0, 1 or 2). A flipped bit moves one count by one, so the Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints: it may reject a pair but never lose one. Counts are kept in unary (00, 01, 11), which makes
the Manhattan distance the number of differing bits of two embeddings.

Grid range join: the segments form blocks of neighbours. Embeddings within Manhattan distance 4 have equal counts in all
but 4 blocks at least, so each choice of the other blocks is a grid over their counts, and a pair within the distance
shares a cell of one choice or more. In a cell the pairs within Manhattan distance 4 over all segments are candidates;
the exact Hamming distance decides. There are 8 blocks (70 choices), and more where cells would hold above 4 rows on
average: a finer grid gives the same links. Wider segments say too little: on 236 thousand fingerprints of 0.5 GB, with
8 blocks, segments of 2 bits give 0.5 million pairs that share a cell, of 4 bits 60 million, of 8 bits 2850 million.

Cells stream through tasks in sorted order. Inside a cell a search from a fingerprint takes away all it reaches, so that
a cell yields a spanning forest, at most one link a fingerprint, and never all pairs. Cells above `cell_rows` leave the
first pass untouched and are dealt anew as pairs of parts of bounded size: no link is lost and no task holds a hot cell.

Nulls and texts without a word get fingerprint zero, linked like any other. Repeated rows and equal texts share one
fingerprint. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, small, written

SEGMENTS, DISTANCE = 32, 4
#: Blocks of segments, and how many rows a cell holds on average before there are more.
BLOCKS, MOST_BLOCKS, CELL_MEAN = 8, 20, 4
LOW, HIGH = 0x5555555555555555, 0xAAAAAAAAAAAAAAAA


def embedded(fps: np.ndarray) -> np.ndarray:
    """The bit counts of the segments of two bits, in unary."""
    one = np.uint64(1)
    return ((fps | fps >> one) & np.uint64(LOW)) | (fps & fps << one & np.uint64(HIGH))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """embedded() as an expression."""
    low = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(fp.bitwiseAND(F.shiftleft(fp, 1)).bitwiseAND(F.lit(signed(HIGH))))


def grids(blocks: int, distance: int = DISTANCE) -> list[int]:
    """One mask over the embedding for each choice of the blocks that a cell is made of."""
    cuts = [SEGMENTS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - distance)]


def blocks_for(fingerprints: int) -> int:
    """The fewest blocks with which a cell holds CELL_MEAN rows at most, were bits fair; two fair counts agree with probability 3/8."""
    fits = (b for b in range(BLOCKS, MOST_BLOCKS) if fingerprints <= CELL_MEAN * (8 / 3) ** (SEGMENTS * (b - DISTANCE) / b))
    return next(fits, MOST_BLOCKS)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of the word shingles of a text, repeats included; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k, hashed = min(shingle, len(words)), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.array([hashed(joined[a:b], 42) for a, b in spans], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp): the fingerprint of each row's text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    source = docs.select(F.col(id_col), F.col(text_col))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


class Cells:
    """Spanning forests of the links inside grid cells, for cells that come as sorted runs of rows."""

    SQUARE = 128  # cells up to this size compare all their fingerprints at once

    def __init__(self, distance: int, limit: int | None):
        self.distance, self.limit = distance, limit

    def forest(self, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        links, left, emb = [], fps, embedded(fps)
        if len(left) <= self.SQUARE:
            near = np.argwhere(np.triu(np.bitwise_count(emb[:, None] ^ emb) <= self.distance, 1))
            a, b = left[near[:, 0]], left[near[:, 1]]
            hit = np.bitwise_count(a ^ b) <= self.distance
            if hit.sum() < len(left):
                return [(a[hit], b[hit])]
        while len(left) > 1:
            todo, left, emb = [(left[0], emb[0])], left[1:], emb[1:]
            while todo and len(left):
                one, at = todo.pop()
                hit = np.bitwise_count(emb ^ at) <= self.distance  # the bound of the embedding
                hit[hit] = np.bitwise_count(left[hit] ^ one) <= self.distance  # exact
                if hit.any():
                    links.append((np.full(hit.sum(), one), left[hit]))
                    todo.extend(zip(left[hit], emb[hit], strict=True))
                    left, emb = left[~hit], emb[~hit]
        return links

    def links(self, rows: np.ndarray) -> pa.RecordBatch:
        """The links of whole runs: all runs of two at once, larger ones by forest()."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        starts = np.concatenate(([0], np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1, [rows.shape[1]]))
        size, fps = np.diff(starts), rows[2].view(np.uint64)
        at = starts[:-1][size == 2]
        a, b = fps[at], fps[at + 1]
        for hit in (lambda: np.bitwise_count(embedded(a) ^ embedded(b)) <= self.distance, lambda: np.bitwise_count(a ^ b) <= self.distance):
            low = hit()
            a, b = a[low], b[low]
        found.append((a, b))
        for k in np.flatnonzero(size > 2):
            found += self.forest(fps[starts[k] : starts[k + 1]])
        a, b = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1))
        return pa.record_batch([pa.array(np.zeros(len(a), bool)), pa.array(np.zeros(len(a), np.int64)), pa.array(a), pa.array(b)], names=self.OUT)

    def passed(self, rows: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.ones(rows.shape[1], bool)), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[2])], names=self.OUT)

    OUT = ["open", "cell", "a", "b"]
    SCHEMA = "open boolean, cell bigint, a bigint, b bigint"

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (part, cell, fp) sorted in that order in; links (a, b) and the untouched (open) rows of cells above the limit out."""
        held, over = np.empty((3, 0), np.int64), False  # the last run, which may go on; if over, one row of it that is out already
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])], axis=1)
            new = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            first, last = (int(new[0]), int(new[-1])) if len(new) else (rows.shape[1], 0)
            if over:
                yield self.passed(rows[:, 1:first])
            if over and not last:
                held = rows[:, :1]
                continue
            yield self.links(rows[:, first * over : last])
            held = rows[:, last:]
            over = bool(self.limit) and held.shape[1] > self.limit
            if over:
                yield self.passed(held)
                held = held[:, :1]
        if not over:
            yield self.links(held)


def similar_links(fps: DataFrame, cell_rows: int = 20_000, blocks: int | None = None) -> DataFrame:
    """(a, b): links among the distinct fingerprints in fps.fp that connect all that lie within DISTANCE bits.

    Every link holds, and whatever is linked is connected by the links returned; within dense groups a spanning part
    of the links stands for all of them. A cell is named by a hash of its choice and counts; cells of one name would be
    compared as one, and the exact distance still decides.
    """
    emb = F.col("_e")
    cells = F.array(*[F.xxhash64(F.lit(k), emb.bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(grids(blocks or blocks_for(fps.count())))])
    keyed = fps.select("fp", embedding(F.col("fp")).alias("_e")).select(F.lit(0).cast("long").alias("part"), F.explode(cells).alias("cell"), "fp")
    first = keyed.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(Cells(DISTANCE, cell_rows).run, Cells.SCHEMA)
    first = written(first, "links")
    links, over = first.where("NOT open").select("a", "b"), first.where("open").select("cell", F.col("a").alias("fp"))
    if over.limit(1).count():
        parts = over.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).alias("parts"))
        placed = over.join(parts, "cell").withColumn("own", F.pmod(F.xxhash64("fp"), "parts"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        paired = placed.withColumn("other", other).select((F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("part"), "cell", "fp")
        more = paired.repartition("part", "cell").sortWithinPartitions("part", "cell", "fp").mapInArrow(Cells(DISTANCE, None).run, Cells.SCHEMA)
        links = links.unionByName(written(more.select("a", "b").distinct(), "links"))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, cell_rows: int = 20_000) -> DataFrame:
    """(id_col, fp, component_id): one row a document; component_id is the smallest id that its links reach, itself included."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min(id_col).alias("least_id")), "classes")
    roots = components(similar_links(classes.select("fp"), cell_rows)).select(F.col("node").alias("fp"), "root")
    rooted = written(classes.join(roots, "fp", "left"), "rooted")
    # Fingerprints without links are their own component; only the others look for the least id of theirs.
    least = written(rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    label = written(rooted.join(small(least), "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id")), "labels")
    return fps.join(label, "fp").select(id_col, "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of docs stays: that with the smallest id, one without an id only where no row of the group has one.

    Groups are of rows and not of ids, so texts that share an id, or have none, stay if they are in different groups. Of
    a group's rows with the same id the one with the smallest hash of its text stays; rows equal in id and text count once.
    """
    text = F.coalesce(text_col, F.lit(""))
    key = {"_a": F.xxhash64(id_col, text), "_b": F.crc32(text)}
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *[c.alias(k) for k, c in key.items()])
    found = near_duplicates(docs.select(row.alias("_row"), text_col), "_row", text_col)
    keep = found.select("component_id._a", "component_id._b").distinct()
    # Repeated rows are combined before the shuffle: however often a row is there, no task gets all of them.
    single = docs.groupBy(*[c.alias(k) for k, c in key.items()]).agg(F.min(F.struct(*docs.columns)).alias("_kept"))
    return single.join(keep, list(key), "left_semi").select("_kept.*")
