"""The pipeline against a plain version of its stages on a small table."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import mixing, packing

from .test_mixing import water_fill
from .test_quality import brute
from .test_simhash import brute_components, brute_fp

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        out.append((name, docs.collect(), done.collect(), docs.columns, done.columns))
        docs = spark.createDataFrame(done.rdd, done.schema)
    return {name: rest for name, *rest in out}


def test_quality(stages):
    before, after, columns, kept = stages["quality_rules"]
    assert columns == kept and set(after) <= set(before)
    base = {r.doc_id for r in before if (b := brute(r.text))[0] < 50 or 100 * b[4] > 50 * b[0]}
    assert not base & {r.doc_id for r in after}


def test_near_duplicates(stages):
    before, after, columns, kept = stages["near_duplicates"]
    rows = sorted(before, key=lambda r: r.doc_id)
    classes = brute_components([brute_fp(r.text) for r in rows])
    want = [r for i, r in enumerate(rows) if classes[i] == i]
    assert columns == kept and sorted(after) == sorted(want)


def test_mixing(stages):
    before, after, columns, kept = stages["mixing_sources"]
    assert columns == kept
    sizes, taken, own = defaultdict(int), defaultdict(int), {r.doc_id: r.text.split() for r in before}
    for r in before:
        sizes[r.source] += len(r.text.split())
    for r in after:
        taken[r.source] += len(r.text.split())
        assert set(r.text.split()) <= set(own[r.doc_id])
    names = sorted(sizes)
    target = water_fill(sizes, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)})
    assert all(abs(taken[s] - target[s]) <= max(3 * mixing.BLOCK_WORDS, 0.02 * target[s]) for s in names)


def test_packing(stages):
    before, after, _, _ = stages["best_fit_packing"]
    tokenizer, want = Tokenizer.from_file(packing.byte_bpe()[0]), []
    for r in before:
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == sorted(want)
    bins = defaultdict(list)
    for r in after:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        x.sort()
        assert [o for o, _ in x] == np.cumsum([0, *[n for _, n in x[:-1]]]).tolist() and sum(n for _, n in x) <= 1024
    assert len(bins) <= sum(r.length for r in after) / 1024 * 1.05 + 1


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages["best_fit_packing"][1])


def test_stages_on_odd_rows(spark):
    """Nulls in every column, repeated rows, long and empty texts, and no rows at all go through every stage."""
    long = " ".join(f"w{i}" for i in range(30_000))
    clean = " ".join(f"v{i}" for i in range(80))
    rows = [(1, clean, "en", "a", 9), (1, clean, "en", "a", 9), (None, clean + " x", None, None, None), (2, None, "en", "a", 0), (3, "", None, "b", 0), (4, long, "fr", None, 1), (None, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (table, table.where("false")):
        counts = []
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.rdd, docs.schema)
            counts.append(docs.count())
        assert counts[:2] in ([4, 2], [4, 3], [0, 0]) and bool(counts[3]) == bool(counts[0])
