"""The model by itself: weights, probabilities, blocks and buckets."""

import time

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import lm


def test_em_finds_the_mixture():
    """Held-out counts drawn from a known mixture give its weights back."""
    rng = np.random.default_rng(0)
    true = np.array([0.6, 0.3, 0.1])
    # Three outcomes: estimates of the pair and of the word over the uniform one, on the grid; each estimate sums to one.
    q2, q1 = np.array([24, lm.NONE, lm.NONE]), np.array([lm.NONE, 24, lm.NONE])
    f = np.stack([np.where(q == lm.NONE, 0, 2.0 ** (q / lm.GRID)) for q in (q2, q1, np.zeros(3))], axis=1)
    outcomes = [(f[0], 1 / 64), (f[1], 1 / 64), (f[2], 1 - 2 / 64)]  # with the uniform share of each outcome
    p = np.array([true @ x * u for x, u in outcomes])
    assert p.sum() == pytest.approx(1)
    n = rng.multinomial(4_000_000, p)
    model = lm.Model((10, 10), (5, 5), (1, 1), 0)
    model.fit(np.column_stack([np.full(3, 3), q2, q1, n]).astype(float), steps=2000)
    np.testing.assert_allclose(model.weights[3], true, atol=0.01)
    # The share of triples over the rest: ratio 8 where the triple is known, which is an eighth of the rest's mass.
    n = rng.multinomial(4_000_000, [1 / 8 * (0.7 * 8 + 0.3), 7 / 8 * 0.3])
    model.fit_third(np.column_stack([[4, 4], [3 * lm.RATIO_GRID, lm.NONE], n]).astype(float))
    assert model.third[4] == pytest.approx(0.7, abs=0.01) and model.third[0] == 0


def one_block(docs):
    block = lm.Block()
    for i, text in enumerate(docs):
        block.add(i, text)
    return dict(zip(lm.BLOCK, block.row(0, lm.TRAIN), strict=True)), block


def test_probabilities_sum_to_one():
    """Behind any context, seen or not, over all V words and the unknown one, by the model's own code."""
    row, block = one_block(["a b a c", "a b b", "c a", "b b b a"])
    own = lm.Grams(row["sizes"], row["numbers"], row["hashes"])
    model = lm.Model((len(own.now),) * 2, (len(own.hashes[0]),) * 2, (len(own.sizes),) * 2, 0)
    model.set(np.tile([0.5, 0.3, 0.2], (65, 1)))
    model.third[1:] = 0.6
    counts = [own.counts(k) for k in range(3)]
    words = ["a", "b", "c", "zzz"]
    known = {h: int(n) for k in range(3) for h, n in zip(own.hashes[k].tolist(), counts[k], strict=True)}
    for context in ("", "a", "c", "a b", "b b", "c c", "zzz", "zzz a", "a zzz"):
        total, ends = 0.0, []
        for w in words:
            asked, _ = one_block([f"{context} {w}"])
            q = lm.Grams(asked["sizes"], asked["numbers"], asked["hashes"])
            p, _ = model.probability(q, [np.array([known.get(h, 0) for h in hs.tolist()]) for hs in q.hashes], 0)
            total += p[-2]
        asked, _ = one_block([context])  # the end is a word too, behind the same context
        q = lm.Grams(asked["sizes"], asked["numbers"], asked["hashes"])
        ends, _ = model.probability(q, [np.array([known.get(h, 0) for h in hs.tolist()]) for hs in q.hashes], 0)
        assert total + ends[-1] == pytest.approx(1), context


def test_grams_know_their_documents():
    row, _ = one_block(["x y", "", "y"])
    own = lm.Grams(row["sizes"], row["numbers"], row["hashes"])
    assert own.before.tolist() == [3, 1, 2, 3, 3, 2] and own.first.tolist() == [0, 3, 4]
    assert [len(set(h.tolist())) for h in own.hashes] == [3, 6 - 1, 6]  # the pair "y, end" is there twice
    alone = [lm.Grams(*[one_block([t])[0][k] for k in ("sizes", "numbers", "hashes")]) for t in ("x y", "", "y")]
    for k in range(3):  # hashes do not depend on the block
        assert set(own.hashes[k].tolist()) == {h for g in alone for h in g.hashes[k].tolist()}


def test_buckets_cover_all_hashes():
    h = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    for bits in (0, 1, 5, 20):
        order, short, buckets, starts = lm.dealt(h, bits)
        assert sorted(order) == list(range(1000)) and starts[0] == 0 and starts[-1] == 1000 and (np.diff(starts) > 0).all()
        for b, i, j in zip(buckets, starts, starts[1:], strict=False):
            assert (h[order][i:j] >> np.uint64(64 - bits if bits else 63) == b).all() or not bits
            got, n = lm.unpacked(lm.packed(short[i:j], np.arange(i, j)))
            assert (got == h[order][i:j] >> np.uint64(8)).all() and (n == np.arange(i, j)).all()
    assert lm.unpacked(b"")[0].size == 0
    wide = np.array([0, (1 << 56) - 1], np.uint64)
    assert lm.unpacked(lm.packed(wide, np.array([1, 2**32 - 1])))[0].tolist() == wide.tolist()


def test_work_of_a_block_does_not_follow_the_buckets():
    """From 2^8 to 2^20 buckets, the time of a block's questions grows with its rows and not with the buckets."""
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64) * np.uint64(2)
    took, rows = {}, {}
    for bits in (8, 14, 20, 26):
        began = time.process_time()
        order, short, buckets, starts = lm.dealt(h, bits)
        n = np.ones(len(h), np.int64)
        out = [lm.packed(short[starts[i] : starts[i + 1]], n[starts[i] : starts[i + 1]]) for i in range(len(buckets))]
        took[bits], rows[bits] = time.process_time() - began, len(out)
    assert all(r <= len(h) for r in rows.values())
    assert took[26] <= 3 * took[14] + 0.5 and took[26] <= 3 * took[20] + 0.5


def test_answers_add_all_blocks():
    """Two blocks of the training folds and one held out: each gets the sums of the training folds, in the order of its questions."""
    hs = [np.array(x, np.uint64) for x in ([1, 5, 9], [5, 9, 70], [1, 2, 70])]
    ns = [np.array([1, 2, 3]), np.array([10, 20, 30]), np.array([7, 7, 7])]
    folds = [lm.TRAIN, lm.DELETED, lm.HELD]
    table = pa.table([pa.array([0] * 3), pa.array([0, 1, 2]), pa.array(folds, pa.int32()), *[pa.array([lm.packed(h, n) for h, n in zip(hs, ns, strict=True)], pa.binary())] * 3], names=lm.QUESTION)
    got = lm.answer(table).to_pylist()
    want = [[1, 12, 23], [12, 23, 30], [1, 0, 30]]
    for k in lm.ORDERS:
        assert [lm.restored_counts(r[f"a{k}"]).tolist() for r in got[:3]] == want
        assert lm.restored_counts(got[1][f"d{k}"]).tolist() == [2, 3, 0] and not got[0][f"d{k}"]
    assert (got[3]["block"], got[3]["known"], got[3]["known_left"]) == (-1, 4, 3)
