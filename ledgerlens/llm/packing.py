"""Best-fit packing of token sequences: vector best-fit over tokens, documents and attention cost.

Documents are tokenized and cut into pieces; the first piece of a longer one takes the remainder. A sequence has three
capacities: tokens, documents, and attention cost. The cost of a piece is the number of TILE by TILE squares of its causal
attention, t(t + 1)/2 for t = ceil(length / TILE), so many short pieces cost more than their tokens say and all three
capacities decide. What a piece needs follows from its length alone, so all pieces of one length are a class and the
driver packs classes: a histogram of at most `capacity` rows comes in, whatever the size of the corpus. Lengths are
taken from the longest; a piece goes to the sequence, among those it fits in every dimension, with the least weighted
residual norm (or the largest weighted dot product), equal ones by their number. Equal sequences are handled together as
ranges: with the norm this is what one-by-one best-fit does, as a sequence that takes a piece stays the best for the next
of the same length; with the dot product a class stays with a sequence while it fits.

The plan (length, ranks, sequences, places) has a size bounded by the capacity, so it is broadcast. Pieces are ranked
within their length in chunks and find sequence and offset by rank.

Null and empty texts are one piece with the end token. Documents that repeat are packed one by one. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_within, written

CAPACITY, END = 1024, 2
#: A task holds at most so many rows of one length to rank them.
CHUNK_ROWS = 10_000


class Encoder:
    """Token ids of texts, with a cache of what stands between lone spaces.

    The pre-tokenizer starts a new piece at a lone space between two characters that are not white space, so a text may
    be cut there and each part encoded by itself, once. `path` is the tokenizer. `ranks` may name the same vocabulary
    as ranks: new parts of plain characters, on whose classes all pre-tokenizers agree, then go through the faster
    library in one call and are cut apart by the tokens' lengths in bytes; all others, and texts that hold an added
    token, go through the tokenizer itself.
    """

    LONE = re.compile(r"(?<=\S)(?= \S)")
    PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\n]+")

    def __init__(self, path: str, ranks: str | None = None, held: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.held, self.cache, self.fast = Tokenizer.from_file(path), held, {}, None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.sizes = np.zeros(max(table.values()) + 1, np.int64)
            self.sizes[list(table.values())] = [len(t) for t in table]

    def slow(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Adds the ids of parts that follow a lone space; the space is theirs."""
        plain = [p for p in new if self.PLAIN.fullmatch(p)] if self.fast else []
        if plain:
            joined = " " + " ".join(plain)
            ids = np.array(self.fast.encode_ordinary(joined), "<u4")
            ends = np.cumsum([len(p.encode()) + 1 for p in plain])
            have = np.cumsum(self.sizes[ids])
            at = np.searchsorted(have, ends)
            if at[-1] == len(ids) - 1 and (have[at] == ends).all():
                data, at = ids.tobytes(), (4 * (at + 1)).tolist()
                self.cache.update(zip(plain, (data[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)), strict=True))
                new = [p for p in new if p not in self.cache]
        self.cache.update(zip(new, self.slow([" " + p for p in new]), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for at in range(0, len(texts), 200):
            group = texts[at : at + 200]
            if len(self.cache) > self.held:
                self.cache.clear()
            cut = [t.split(" ") for t in group]
            new = set().union(*cut) - self.cache.keys()
            odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
            self.learn(list(new - odd))
            firsts = self.slow([c[0] for c in cut])
            for text, parts, first in zip(group, cut, firsts, strict=True):
                if any(a in text for a in self.added):
                    yield self.slow([text])[0]
                elif odd and not odd.isdisjoint(parts):
                    yield b"".join(self.slow(self.LONE.split(text)))
                else:
                    yield first + b"".join(map(self.cache.__getitem__, islice(parts, 1, None)))


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None) -> Encoder:
    """One for each Python worker, so that tasks share its cache."""
    return Encoder(path, ranks)


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]): the pieces of each document's ids and the end token.

    ids are little-endian unsigned 32-bit integers; the first piece is the shorter one.
    """
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, last = encoder(tokenizer, ranks), np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                where, rows, ids = [], [], []
                for k, own in enumerate(own_encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    own = memoryview(own + last)
                    n = len(own) // 4
                    count = -(-n // capacity)
                    ends = [n - (count - 1 - i) * capacity for i in range(count)]
                    for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                        where.append(k)
                        rows.append((i, a, b - a, zlib.crc32(own[4 * a : 4 * b])))
                        if keep_ids:
                            ids.append(bytes(own[4 * a : 4 * b]))
                cols = list(zip(*rows, strict=True))
                out = [part.column(0).take(pa.array(where)), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]]
                yield pa.record_batch([*out, *[pa.array(ids, pa.binary())] * keep_ids], names=names)

    source = docs.select(F.col(id_col), F.col(text_col))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids)


@dataclass
class Limits:
    """Capacities of a sequence, and what each dimension weighs when sequences are compared."""

    tokens: int = CAPACITY
    documents: int = 40
    cost: int = 48
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "norm"  # or "dot"
    tile: int = 128

    def caps(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.cost], np.int64)

    def need(self, length: int) -> np.ndarray:
        """What a piece takes of each capacity: its tokens, one document, the tiles of its causal attention."""
        tiles = -(-length // self.tile)
        return np.array([length, 1, tiles * (tiles + 1) // 2], np.int64)


@dataclass
class Plan:
    """Where the pieces of each length go, by rank; sequences are numbered from 0."""

    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, rank from, rank to, first sequence, pieces in each, offset
    sequences: int = 0


def best_fit(histogram: dict[int, int], limits: Limits) -> Plan:
    """Packs `histogram` (pieces by length). State: ranges of equal sequences with their residual capacities."""
    caps, weights, plan = limits.caps(), np.array(limits.weights), Plan()
    left, first, count = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for length in sorted(histogram, reverse=True):
        need, n, rank = limits.need(length), histogram[length], 0
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits into no sequence")
        fits = np.flatnonzero((left >= need).all(axis=1))
        if limits.rule == "dot":
            score = -((left[fits] / caps) * (need / caps) * weights).sum(axis=1)
        else:
            score = ((((left[fits] - need) / caps) ** 2) * weights).sum(axis=1)
        more: list[tuple[np.ndarray, int, int]] = []
        for k in fits[np.lexsort((first[fits], score))]:
            if rank == n:
                break
            each = int((left[k] // need).min())
            used = min(int(count[k]), -(-(n - rank) // each))
            rank = place(plan, more, left[k], int(first[k]), used, each, need, n, rank, caps)
            first[k] += used
            count[k] -= used
        if rank < n:
            each = int((caps // need).min())
            used = -(-(n - rank) // each)
            rank = place(plan, more, caps, plan.sequences, used, each, need, n, rank, caps)
            plan.sequences += used
        keep = count > 0
        left, first, count = left[keep], first[keep], count[keep]
        if more:
            left = np.concatenate([left, np.array([m[0] for m in more])])
            first = np.concatenate([first, np.array([m[1] for m in more])])
            count = np.concatenate([count, np.array([m[2] for m in more])])
    return plan


def place(plan: Plan, more: list, left: np.ndarray, first: int, used: int, each: int, need: np.ndarray, n: int, rank: int, caps: np.ndarray) -> int:
    """Puts the next pieces into `used` sequences from `first`, `each` in all but perhaps the last; the rank after them."""
    to = min(n, rank + used * each)
    plan.rows.append((int(need[0]), rank, to, first, each, int(caps[0] - left[0])))
    whole, rest = divmod(to - rank, each)
    if whole:
        more.append((left - each * need, first, whole))
    if rest:
        more.append((left - rest * need, first + whole, 1))
    return to


def pack(cut: DataFrame, id_col: str = "doc_id", limits: Limits | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """cut (id_col, piece, length, ids_crc32, ...; a written table) with sequence_id and offset."""
    limits, spark = limits or Limits(), cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `tokens` rows
    plan = best_fit(histogram, limits)
    ranked = rank_within(cut, "length", [id_col, "piece", "ids_crc32"], chunk_rows, "_rank")
    rows = spark.createDataFrame(plan.rows, "_length long, _from long, _to long, _first long, _each long, _offset long")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    out = ranked.join(F.broadcast(rows), on).withColumn("_at", F.col("_rank") - F.col("_from"))
    out = out.withColumn("sequence_id", F.col("_first") + F.floor(F.col("_at") / F.col("_each"))).withColumn("offset", F.col("_offset") + F.col("_at") % F.col("_each") * F.col("length"))
    return out.drop("_rank", "_length", "_from", "_to", "_first", "_each", "_offset", "_at")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): each sequence's ids as one binary, from packed pieces with ids; a sequence is bounded."""
    row = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(row.alias("_r")).select("sequence_id", F.expr("aggregate(_r, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.col("_r.offset").alias("starts"))


def byte_bpe() -> tuple[str, str]:
    """The public byte-level tokenizer, and its vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(written(pieces(docs, *byte_bpe()), "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
