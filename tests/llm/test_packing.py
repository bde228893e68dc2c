import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import packing
from ledgerlens.llm.common import written

PATH, RANKS = packing.byte_bpe()
TOKENIZER = Tokenizer.from_file(PATH)
FAST, PLAIN = packing.Encoder(PATH, RANKS), packing.Encoder(PATH)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


TEXTS = ["", " ", "a", " a", "a ", "a  b", "a \n b", "Don't we'll x'sy ''s", "x y\xa0z", "1 2 34 5,6", "<|endoftext|> a b", "é È ßü ×÷ a×b", "日本 語 テスト", "a\x1c b \x85c", "tab\t end", "🙂 🙂🙂 x", "́a ́b"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids(text):
    want = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert ids(next(FAST.encode([text]))) == want and ids(next(PLAIN.encode([text]))) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t'abcdeTMll1.,é×ß日\x85\xa0 🙂|<>"), max_size=40), max_size=4))
def test_ids_of_any_text(texts):
    assert [ids(x) for x in FAST.encode(texts)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_the_test_table(spark):
    """Every document's ids are those of the named tokenizer."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert [ids(x) for x in FAST.encode(texts)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def brute(lengths, limits):
    """One-by-one vector best-fit over the sorted lengths: what each sequence holds, in its order."""
    bins, caps = [], limits.caps().tolist()
    for n in sorted(lengths, reverse=True):
        need = [n, 1, (t := -(-n // limits.tile)) * (t + 1) // 2]
        fits = [k for k, (left, _) in enumerate(bins) if all(x >= y for x, y in zip(left, need, strict=True))]
        if fits and limits.rule == "norm":
            best = min(fits, key=lambda k: (round(sum(w * ((x - y) / c) ** 2 for x, y, c, w in zip(bins[k][0], need, caps, limits.weights, strict=True)), 12), k))
        elif fits:
            best = max(fits, key=lambda k: (round(sum(w * (x / c) * (y / c) for x, y, c, w in zip(bins[k][0], need, caps, limits.weights, strict=True)), 12), -k))
        else:
            best = len(bins)
            bins.append((list(caps), []))
        for i in range(3):
            bins[best][0][i] -= need[i]
        bins[best][1].append(n)
    return [own for _, own in bins]


def planned(lengths, limits):
    """The same from the plan of classes, checked for gaps and capacities."""
    histogram = dict(Counter(lengths))
    plan = packing.best_fit(histogram, limits)
    bins, seen = defaultdict(list), defaultdict(int)
    for length, a, b, first, each, offset in plan.rows:
        assert a == seen[length]
        seen[length] = b
        for rank in range(a, b):
            bins[first + (rank - a) // each].append((offset + (rank - a) % each * length, length))
    assert seen == histogram and len(bins) == plan.sequences
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist()
        assert (sum(limits.need(n) for _, n in own) <= limits.caps()).all()
    return [[n for _, n in own] for own in bins.values()]


LIMITS = [packing.Limits(), packing.Limits(documents=5), packing.Limits(cost=40, documents=1024), packing.Limits(tokens=700, cost=25, documents=9)]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("seed", range(6))
def test_plan_is_one_by_one(limits, seed):
    """With the norm, classes give the sequences of one-by-one best-fit, whichever capacity decides."""
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 40), rng.randint(1, 500), min(limits.tokens, 900 + rng.randint(0, 5))]) for _ in range(rng.choice([0, 30, 300]))]
    assert sorted(planned(lengths, limits)) == sorted(brute(lengths, limits))


@pytest.mark.parametrize("limits", [packing.Limits(rule="dot"), packing.Limits(rule="dot", documents=9)])
def test_dot_plan(limits):
    """With the dot product a class stays with a sequence while it fits; distinct lengths are one-by-one best-fit."""
    rng = random.Random(3)
    lengths = rng.sample(range(1, 600), 250)
    assert sorted(planned(lengths, limits)) == sorted(brute(lengths, limits))
    planned([min(rng.randint(1, 500), rng.randint(1, 500)) for _ in range(2000)], limits)


def test_every_capacity_decides():
    """Each capacity of the default limits binds somewhere: without it the plan differs, and a sequence would exceed it."""
    rng = random.Random(1)
    lengths = [rng.choice([*[rng.randint(1, 8)] * 30, rng.randint(300, 900)]) for _ in range(6000)]
    full = packing.Limits()
    for loose in (packing.Limits(documents=1024), packing.Limits(cost=10**6)):
        bins = planned(lengths, loose)
        assert any((sum(full.need(n) for n in own) > full.caps()).any() for own in bins)
        assert sorted(bins) != sorted(planned(lengths, full))


def test_documents(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (3, "", "y"), (None, "word " * 3000, "z"), (5, "q" * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = packing.pack(written(packing.pieces(docs, PATH, RANKS, keep_ids=True), "t"), chunk_rows=2).collect()
    by_doc = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
    for i, text, _ in rows[2:]:
        own = sorted(by_doc[i], key=lambda r: r.piece)
        want = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]
        assert [x for r in own for x in ids(r.ids)] == want
        assert all(r.length == 1024 for r in own[1:]) and [r.start for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
    assert len(by_doc[1]) == 2
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for own in placed.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(n for _, n in own) <= 1024
    whole = packing.sequences(spark.createDataFrame(got)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in got)
    assert packing.pack(written(packing.pieces(docs.where("false"), PATH), "t")).count() == 0


def test_query(spark):
    """op4 over a whole table: ids of the named tokenizer, cut from the end, gapless sequences within every capacity."""
    sf, limits = "/root/testdata/sf0.001", packing.Limits()
    got, bins = packing.op4_packing(spark, sf).collect(), defaultdict(list)
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = np.array([*TOKENIZER.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(own) % 1024 or 1024
        cuts = [0, *range(first, len(own) + 1, 1024)]
        want += [(r.doc_id, i, a, b - a, zlib.crc32(own[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist()
        assert (sum(limits.need(n) for _, n in own) <= limits.caps()).all()
    assert len(bins) == len(brute([r.length for r in got], limits))
