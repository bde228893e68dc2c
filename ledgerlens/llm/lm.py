"""Language-model scoring by deleted interpolation of order three.

p(w | u v) = m c(u v w)/c(u v) + (1 - m) p(w | v), with m by the bucket of the context's frequency c(u v), and
p(w | v) = l2 c(v w)/c(v) + l1 c(w)/N + l0 /(V + 1), with (l2, l1, l0) by the bucket of c(v); buckets are powers of two.
The weights are learned by expectation-maximisation on held-out counts: a fold of the training documents is deleted from
the counts, its tokens are looked up in what is left, and EM runs over histograms: first of (bucket of c(v), log2 of the
estimates of pairs and words over the uniform one, in quarters), then, given these weights, of (bucket of c(u v), log2 of the
triple's estimate over p(w | v), in eighths). Both grids have a bounded number of cells for a corpus of any size, every deleted
token is in them, and only they come to the driver. Scores then use the counts of all training documents.

Words, pairs and triples are known by 56 bits of a hash; counts are exact but for collisions of these. Nothing depends
on one hot word:

1. Blocks. Documents of one fold are tokenized once into blocks of some million tokens: local word numbers and the
   hash of each distinct word. This table is written to the shared folder.
2. Questions. A block asks for its distinct words, pairs and triples in the order of their hashes, cut into buckets;
   hashes travel as differences. A frequent word is asked for once a block, so no bucket is larger than its share; the
   number of buckets and of tasks follows the tokens. A block makes rows for the buckets that it has questions for, so
   its work follows its tokens and not the number of buckets.
3. Answers. A bucket adds the counts of all blocks and answers each block in the order of its questions.
4. Scores. Blocks and answers meet; the block redoes its distinct triples and scores its documents.

Null and empty texts are one end token. A text longer than a block is a block of its own. Documents that repeat are
scored, and counted, one by one; a null id hashes like an empty text. Without training documents N and V are 0 and every
token is unknown. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCK_TOKENS, BUCKET_TOKENS = 1_000_000, 1_000_000
TRAIN, DELETED, HELD = 0, 1, 2
GRID, RATIO_GRID = 4, 8  # cells for each doubling
NONE = -10_000  # grid value of an estimate that is zero
HASH_BITS = 56
#: Buckets and blocks that a task takes.
TASK_BUCKETS, TASK_BLOCKS = 4, 3


def folds(docs: DataFrame, id_col: str, text_col: str, deleted: int = 8) -> DataFrame:
    """(id, text, fold): HELD if crc32(id) mod 5 is 1; of the others one in `deleted` is the fold deleted for EM."""
    crc = F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0).cast("long"))
    fold = F.when(crc % 5 == 1, HELD).when(F.floor(crc / 5) % deleted == 0, DELETED).otherwise(TRAIN)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold.cast("int").alias("fold"))


def squeezed(x: np.ndarray) -> bytes:
    """Small numbers as compressed 32-bit integers: what blocks and answers weigh in shuffles and tables."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").tobytes())


def restored(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<u4") if x else np.empty(0, "<u4")


def squeezed_counts(x: np.ndarray) -> bytes:
    """Counts of a whole corpus: compressed 64-bit integers."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").tobytes())


def restored_counts(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<u8").astype(np.int64) if x else np.empty(0, np.int64)


class Block:
    """Documents being tokenized: word numbers (0 is the end), and the distinct words in the order of their numbers."""

    def __init__(self):
        self.ids, self.sizes, self.numbers, self.n = [], [], [], 0
        self.words: dict[bytes, int] = defaultdict(count(1).__next__)

    def add(self, own, text: str | None) -> None:
        words = (text or "").encode().lower().split()
        got = np.zeros(len(words) + 1, np.int32)
        got[:-1] = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        self.ids.append(own)
        self.sizes.append(len(got))
        self.numbers.append(got)
        self.n += len(got)

    def row(self, block: int, fold: int) -> tuple:
        hashed = np.array([END_HASH, *map(xxhash.xxh64_intdigest, self.words)], "<u8")
        return block, fold, self.ids, len(self.ids), self.n, squeezed(np.array(self.sizes)), squeezed(np.concatenate(self.numbers)), hashed.tobytes()


END_HASH, START_HASH = (xxhash.xxh64_intdigest(x) for x in (b" end", b" start"))  # no word has a space
BLOCK = ["block", "fold", "ids", "docs", "tokens", "sizes", "numbers", "hashes"]


def blocks(folded: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    kind = folded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = count(TaskContext.get().partitionId() << 32), defaultdict(Block)
        id_type = pa.null()

        def batch(row: tuple) -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.list_(id_type), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=BLOCK)

        for b in batches:
            id_type = b.column(0).type
            for own, text, fold in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                open_[fold].add(own, text.as_py())
                if open_[fold].n >= block_tokens:
                    yield batch(open_.pop(fold).row(next(number), fold))
        for fold, left in open_.items():
            yield batch(left.row(next(number), fold))

    out = folded.mapInArrow(run, f"block bigint, fold int, ids array<{kind}>, docs bigint, tokens bigint, sizes binary, numbers binary, hashes binary")
    return written(out, "blocks", compression="zstd", **{"parquet.block.size": str(32 << 20)})


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One hash of two, in their order."""
    x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (y + np.uint64(0xD1B54A32D192ED03))
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Grams:
    """A block's numbers, and its distinct words, pairs and triples: their hashes, and where each token's are."""

    def __init__(self, sizes: bytes, numbers: bytes, hashes: bytes, orders: int = 3):
        self.sizes, self.now = restored(sizes).astype(np.int64), restored(numbers).astype(np.int32)
        self.first = np.cumsum(self.sizes) - self.sizes  # each document's first token
        words = np.frombuffer(hashes, "<u8")
        self.hashes, self.at = [words], [self.now]
        before = np.append(words, np.uint64(START_HASH))  # what stands before a document's first word is the last one here
        for _ in range(orders - 1):
            shifted = np.empty(len(self.now), np.int64)
            shifted[1:] = self.at[-1][:-1]
            shifted[self.first] = len(before) - 1
            if len(self.at) == 1:
                self.before = shifted.astype(np.int32)
            codes, at = np.unique(shifted * len(words) + self.now, return_inverse=True)
            context, last = np.divmod(codes, len(words))
            own = mixed(before[context], words[last])
            self.hashes.append(own)
            self.at.append(at.astype(np.int32))
            before = np.append(own, mixed(before[-1:], np.array([START_HASH], "<u8")))

    def counts(self, order: int) -> np.ndarray:
        return np.bincount(self.at[order], minlength=len(self.hashes[order]))


def dealt(hashed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the hashes, what is kept of them in it, the buckets (their first `bits` bits) that have any, and where each starts and the last ends."""
    short = hashed >> np.uint64(64 - HASH_BITS)
    order = np.argsort(short, kind="stable")
    short = short[order]
    bucket = (short >> np.uint64(HASH_BITS - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.empty(0, np.int64)
    return order, short, bucket[starts], np.append(starts, len(short))


def packed(short: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted hashes and their counts: differences as four plain bytes (chance, not worth compressing) and what is above and the counts compressed."""
    gaps = np.diff(short, prepend=np.uint64(0))
    gaps[:1] = 0  # the first one goes whole
    above = (gaps >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    rest = zstandard.ZstdCompressor(level=1).compress(above.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
    return len(short).to_bytes(4, "little") + short[:1].astype("<u8").tobytes() + gaps.astype("<u4").tobytes() + rest


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = int.from_bytes(data[:4], "little")
    low = np.frombuffer(data, "<u4", size, 12).astype(np.uint64)
    rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[12 + 4 * size :]), np.uint8).reshape(2, 4, size)
    above, n = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in rest)
    low += above.astype(np.uint64) << np.uint64(32)
    low[0] = np.frombuffer(data, "<u8", 1, 4)[0]
    return np.cumsum(low, dtype=np.uint64), n.astype(np.int64)


ORDERS = (1, 2, 3)
QUESTION = ["bucket", "block", "fold", *[f"q{k}" for k in ORDERS]]


def questions(table: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (x for at in range(b.num_rows) for x in b.slice(at, 1).to_pylist()):
                own, rows = Grams(r["sizes"], r["numbers"], r["hashes"]), defaultdict(lambda: [b""] * len(ORDERS))
                for k in range(len(ORDERS)):
                    order, short, buckets, starts = dealt(own.hashes[k], bits)
                    n = own.counts(k)[order]
                    for i, bucket in enumerate(buckets.tolist()):
                        rows[bucket][k] = packed(short[starts[i] : starts[i + 1]], n[starts[i] : starts[i + 1]])
                fixed = [pa.array(list(rows), pa.int64()), pa.array([r["block"]] * len(rows), pa.int64()), pa.array([r["fold"]] * len(rows), pa.int32())]
                yield pa.record_batch([*fixed, *[pa.array([x[k] for x in rows.values()], pa.binary()) for k in range(len(ORDERS))]], names=QUESTION)

    return table.select("block", "fold", "sizes", "numbers", "hashes").mapInArrow(run, "bucket bigint, block bigint, fold int, " + ", ".join(f"q{k} binary" for k in ORDERS))


ANSWER = ["block", "fold", "bucket", *[f"{x}{k}" for k in ORDERS for x in "ad"], "known", "known_left"]


def answer(asked: pa.Table) -> pa.Table:
    """Counts of all training folds (a) and, for blocks of the deleted fold, without it (d); in a row of its own, the distinct words."""
    fold, block, bucket = asked["fold"].to_numpy(), asked["block"].to_numpy(), asked["bucket"][0].as_py()
    sides, known = [], (0, 0)
    for k in ORDERS:
        hs, ns = zip(*[unpacked(x.as_py()) for x in asked[f"q{k}"]], strict=True)
        sizes, ns = np.array([len(h) for h in hs]), np.concatenate(ns)
        distinct, at = np.unique(np.concatenate(hs), return_inverse=True)
        owner = np.repeat(fold, sizes)
        train = np.bincount(at, np.where(owner == TRAIN, ns, 0), len(distinct)).astype(np.int64)
        both = train + np.bincount(at, np.where(owner == DELETED, ns, 0), len(distinct)).astype(np.int64)
        if k == 1:
            known = int((both > 0).sum()), int((train > 0).sum())
        ends = np.cumsum(sizes)
        sides.append([squeezed_counts(both[at[e - s : e]]) if s else b"" for s, e in zip(sizes, ends, strict=True)] + [b""])
        sides.append([squeezed_counts(train[at[e - s : e]]) if s and f == DELETED else b"" for s, e, f in zip(sizes, ends, fold, strict=True)] + [b""])
    n = len(fold)
    cols = [pa.array([*block.tolist(), -1]), pa.array([*fold.tolist(), -1], pa.int32()), pa.array([bucket] * (n + 1)), *[pa.array(s, pa.binary()) for s in sides]]
    return pa.table([*cols, pa.array([*[0] * n, known[0]]), pa.array([*[0] * n, known[1]])], names=ANSWER)


class Model:
    """What the corpus gives: N, V and documents of all training folds and without the deleted one, and EM's weights."""

    def __init__(self, n: tuple[int, int], v: tuple[int, int], docs: tuple[int, int], bits: int):
        self.n, self.v, self.docs, self.bits = n, v, docs, bits
        self.third = np.full(65, 0.5)
        self.set(np.tile([0.4, 0.4, 0.2], (65, 1)))

    def set(self, weights: np.ndarray) -> None:
        """Weights by bucket; an unseen context says nothing, so its share goes to the others."""
        self.weights = weights.copy()
        self.weights[0, 0] = self.third[0] = 0
        self.weights[0] /= self.weights[0].sum()

    def estimates(self, own: Grams, found: list[np.ndarray], left: int):
        """For each token: bucket of c(v), f2, f1, f0 and c(w), from a block's counts; left: 1 without the deleted fold."""
        one, two = found[0], found[1][own.at[1]]
        context = np.append(one, self.docs[left])[own.before]
        c = one[own.now]
        f2 = np.divide(two, context, out=np.zeros(len(c)), where=context > 0)
        f1 = c / max(self.n[left], 1)
        return np.frexp(context)[1], f2, f1, 1 / (self.v[left] + 1), c

    def second(self, bucket: np.ndarray, f2: np.ndarray, f1: np.ndarray, f0: float) -> np.ndarray:
        """p(w | v) for each token."""
        w = self.weights[bucket]
        return w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] * f0

    def triples(self, own: Grams, found: list[np.ndarray], left: int):
        """For each token: bucket of c(u v) and f3. The pair before a token is that of the token before it."""
        context = np.empty(len(own.now), np.int64)
        context[1:] = found[1][own.at[1]][:-1]
        context[own.first] = self.docs[left]
        return np.frexp(context)[1], np.divide(found[2][own.at[2]], context, out=np.zeros(len(context)), where=context > 0)

    def restored(self, answers: pa.Table, own: Grams, kind: str) -> list[np.ndarray]:
        """The counts of a block's distinct words, pairs and triples, from its answers."""
        answers, out = answers.sort_by("bucket"), []
        for k, h in enumerate(own.hashes):
            order = dealt(h, self.bits)[0]
            counts = np.empty(len(h), np.int64)
            counts[order] = np.concatenate([restored_counts(x.as_py()) for x in answers[f"{kind}{k + 1}"]])
            out.append(counts)
        return out

    def fit(self, cells: np.ndarray, steps: int = 100) -> None:
        """EM over rows (bucket, q2, q1, n) of the histogram of held-out counts."""
        if not len(cells):
            return
        f = np.stack([np.where(q == NONE, 0, np.exp2(q / GRID)) for q in (cells[:, 1], cells[:, 2], np.zeros(len(cells)))], axis=1)

        def weights(f: np.ndarray, n: np.ndarray) -> np.ndarray:
            w = np.array([0.4, 0.4, 0.2])
            for _ in range(steps):
                share = f * w
                share *= (n / share.sum(axis=1))[:, None]
                w = np.maximum(share.sum(axis=0) / n.sum(), 1e-6)
                w /= w.sum()
            return w

        out = np.tile(weights(f, cells[:, 3]), (65, 1))  # for buckets that the deleted fold has no token for
        for b in np.unique(cells[:, 0]):
            at = cells[:, 0] == b
            out[int(b)] = weights(f[at], cells[at, 3])
        self.set(out)

    def fit_third(self, cells: np.ndarray, steps: int = 200) -> None:
        """EM over rows (bucket, log2 of f3/p(w | v), n): the share m of the triples in each bucket but that of unseen contexts."""
        cells = cells[cells[:, 0] > 0]
        ratio = np.where(cells[:, 1] == NONE, 0, np.exp2(cells[:, 1] / RATIO_GRID))

        def share(r: np.ndarray, n: np.ndarray) -> float:
            m = 0.5
            for _ in range(steps):
                m = min(max(float((n * m * r / (m * r + 1 - m)).sum() / n.sum()), 1e-6), 1 - 1e-6)
            return m

        if len(cells):
            self.third[1:] = share(ratio, cells[:, 2])
        for b in np.unique(cells[:, 0]):
            at = cells[:, 0] == b
            self.third[int(b)] = share(ratio[at], cells[at, 2])

    def probability(self, own: Grams, found: list[np.ndarray], left: int) -> tuple[np.ndarray, np.ndarray]:
        """p(w | u v) of each token, and c(w)."""
        *second, c = self.estimates(own, found, left)
        bucket, f3 = self.triples(own, found, left)
        m = self.third[bucket]
        return m * f3 + (1 - m) * self.second(*second), c


def counted(rows: np.ndarray, names: list[str]) -> pa.Table:
    """How often each row of integers occurs."""
    distinct, n = np.unique(rows, axis=0, return_counts=True)
    return pa.table([*[pa.array(c) for c in distinct.T.astype(np.int64)], pa.array(n)], names=[*names, "n"])


def on_grid(ratio: np.ndarray, grid: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.rint(grid * np.log2(np.maximum(ratio, 1e-300))), NONE).astype(np.int64)


def cell_counts(model: Model):
    def run(_key, block: pa.Table, answers: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        own = Grams(r["sizes"], r["numbers"], r["hashes"], 2)
        bucket, f2, f1, f0, _ = model.estimates(own, model.restored(answers, own, "d"), 1)
        return counted(np.stack([bucket, on_grid(f2 / f0, GRID), on_grid(f1 / f0, GRID)], axis=1), ["bucket", "q2", "q1"])

    return run


def third_counts(model: Model):
    def run(_key, block: pa.Table, answers: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        own = Grams(r["sizes"], r["numbers"], r["hashes"])
        found = model.restored(answers, own, "d")
        *second, _ = model.estimates(own, found, 1)
        bucket, f3 = model.triples(own, found, 1)
        return counted(np.stack([bucket, on_grid(f3 / model.second(*second), RATIO_GRID)], axis=1), ["bucket", "q3"])

    return run


SCORED = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]


def scores(model: Model):
    def run(_key, block: pa.Table, answers: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        own = Grams(r["sizes"], r["numbers"], r["hashes"])
        p, c = model.probability(own, model.restored(answers, own, "a"), 0)
        per_doc = lambda x: np.add.reduceat(x, own.first)
        base = per_doc(np.log10((c + 0.5) / (model.n[0] + 0.5 * (model.v[0] + 1))))
        cols = [block["ids"].combine_chunks().flatten(), pa.array(np.full(len(own.sizes), r["fold"] == HELD)), pa.array(own.sizes), pa.array(per_doc((c > 0).astype(np.int64))), pa.array(base), pa.array(per_doc(np.log10(p)))]
        return pa.table(cols, names=SCORED)

    return run


@dataclass
class Trained:
    """Written tables of blocks and answers, and the model fitted to them."""

    table: DataFrame
    answers: DataFrame
    model: Model
    blocks: int

    def met(self, which: str, kind: str, orders: int, run, out: str) -> DataFrame:
        """run over each block and its answers; a task takes a few blocks."""
        tasks = 1 + self.blocks // TASK_BLOCKS
        own = self.table.where(which).select("block", "fold", "ids", "sizes", "numbers", "hashes").repartition(tasks, "block").groupBy("block")
        got = self.answers.where(f"block >= 0 AND {which}").select("block", "bucket", *[f"{kind}{k}" for k in ORDERS[:orders]]).repartition(tasks, "block").groupBy("block")
        return own.cogroup(got).applyInArrow(run, out)


def train(folded: DataFrame, block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> Trained:
    """Counts of folded documents (id, text, fold), and a model with weights learned on the deleted fold."""
    table = blocks(folded, block_tokens)
    per_fold = {r["fold"]: r for r in table.groupBy("fold").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"), F.count("*").alias("blocks")).collect()}
    of = lambda name, *which: sum(per_fold[f][name] for f in which if f in per_fold)
    bits = max(0, (of("tokens", TRAIN, DELETED, HELD) // bucket_tokens).bit_length())
    asked = questions(table, bits).repartition(1 + (1 << bits) // TASK_BUCKETS, "bucket")
    schema = "block bigint, fold int, bucket bigint, " + ", ".join(f"{x}{k} binary" for k in ORDERS for x in "ad") + ", known bigint, known_left bigint"
    answers = written(asked.groupBy("bucket").applyInArrow(answer, schema), "answers", compression="zstd", **{"parquet.block.size": str(32 << 20)})
    known = answers.where("block = -1").agg(F.sum("known"), F.sum("known_left")).first()
    model = Model((of("tokens", TRAIN, DELETED), of("tokens", TRAIN)), (known[0] or 0, known[1] or 0), (of("docs", TRAIN, DELETED), of("docs", TRAIN)), bits)
    out = Trained(table, answers, model, of("blocks", TRAIN, DELETED, HELD))
    # Bounded: both histograms have the cells of a grid.
    held = out.met(f"fold = {DELETED}", "d", 2, cell_counts(model), "bucket bigint, q2 bigint, q1 bigint, n bigint").groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).collect()
    model.fit(np.array([tuple(r) for r in held], np.float64).reshape(-1, 4))
    held = out.met(f"fold = {DELETED}", "d", 3, third_counts(model), "bucket bigint, q3 bigint, n bigint").groupBy("bucket", "q3").agg(F.sum("n").alias("n")).collect()
    model.fit_third(np.array([tuple(r) for r in held], np.float64).reshape(-1, 3))
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score); scores are log10 probabilities."""
    folded = folds(docs, id_col, text_col)
    trained = train(folded, block_tokens, bucket_tokens)
    kind = folded.schema["id"].dataType.simpleString()
    scored = trained.met("true", "a", 3, scores(trained.model), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(trained.model.n[0]).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
