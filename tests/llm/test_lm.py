import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlens.llm import lm

WS = " \t\n\x0b\x0c\r"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WS:
        low = low.replace(c, " ")
    return [*[w for w in low.split(" ") if w], "</s>"]


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = Counter(t for i, x in rows if not held[i] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    out = {}
    for i, x in rows:
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))
        out[i] = (held[i], len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, base)
    return out


def test_counts_base_and_gain(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 13} the" for j in range(i % 9))) for i in range(120)] + [(500, None), (501, "  "), (502, "UPPER Éa upper x\x0by")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("score", "s")
    got = {r.doc_id: r for r in lm.score(docs, block_tokens=300, bucket_tokens=100).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, (held, n_tokens, n_known, n, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [i for i in want if want[i][0]]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)  # the model predicts held-out texts better
    one = {r.doc_id: r.score for r in lm.score(docs).collect()}
    assert all(math.isclose(one[i], got[i].score, rel_tol=1e-9) for i in one)  # whatever the blocks and buckets


class Counts:
    """Counts of words, pairs and triples with their contexts, by dictionaries."""

    def __init__(self, texts):
        self.docs, self.one, self.two, self.three = len(texts), Counter(), Counter(), Counter()
        for text in texts:
            own = ["<s>", "<s>", *tokens(text)]
            for u, v, w in zip(own, own[1:], own[2:], strict=False):
                self.one[w] += 1
                self.two[v, w] += 1
                self.three[u, v, w] += 1
        self.n, self.v = sum(self.one.values()), len(self.one)

    def estimates(self, text):
        """(bucket of c(u v), f3, bucket of c(v), f2, f1, f0) for each token."""
        own = ["<s>", "<s>", *tokens(text)]
        for u, v, w in zip(own, own[1:], own[2:], strict=False):
            after = self.docs if v == "<s>" else self.one[v]
            pair = self.docs if v == "<s>" else self.two[u, v]
            ratio = lambda a, b: a / b if b else 0.0
            yield pair.bit_length(), ratio(self.three[u, v, w], pair), after.bit_length(), ratio(self.two[v, w], after), ratio(self.one[w], self.n), 1 / (self.v + 1)


def corpus():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(500)]
    rows = [(i, " ".join(rng.choices(words[: 40 + i % 400], k=rng.randint(0, 60))) + " the end of it" * (i % 3)) for i in range(600)]
    return [*rows, (900, None), (901, ""), (902, rows[5][1]), (903, "long text " * 700), (None, "no id here")]


def test_score_against_brute_force(spark):
    """Weights are those of EM over every deleted token, and scores those of the formula with these weights; a text is longer than a block."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trained = lm.train(lm.folds(docs, "doc_id", "text"), block_tokens=900, bucket_tokens=3000)
    model = trained.model
    crc = {i: zlib.crc32(str(i).encode()) if i is not None else 0 for i, _ in rows}
    deleted = [x for i, x in rows if crc[i] % 5 != 1 and crc[i] // 5 % 8 == 0]
    left = Counts([x for i, x in rows if crc[i] % 5 != 1 and crc[i] // 5 % 8])
    whole = Counts([x for i, x in rows if crc[i] % 5 != 1])
    assert (model.n, model.v, model.docs) == ((whole.n, left.n), (whole.v, left.v), (whole.docs, left.docs))
    asked = [e for x in deleted for e in left.estimates(x)]
    second, third = defaultdict(list), defaultdict(list)
    for _, _, b, *f in asked:
        second[b].append(f)
    for b, own in second.items():
        w = np.array([0.4, 0.4, 0.2])
        for _ in range(100):
            share = np.array(own) * w
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        # The grid rounds estimates: the weights may move where few tokens tell them apart, the likelihood hardly.
        assert np.log(np.array(own) @ model.weights[b]).mean() >= np.log(np.array(own) @ w).mean() - 0.005
        assert len(own) < 1000 or np.abs(model.weights[b] - w).max() < 0.05
    for c, f3, b, f2, f1, f0 in asked:
        third[c].append((f3, model.weights[b] @ (f2, f1, f0)))
    for c, own in third.items():
        m, f3, rest = 0.5, *np.array(own).T
        for _ in range(200):
            m = np.clip((m * f3 / (m * f3 + (1 - m) * rest)).mean(), 1e-6, 1 - 1e-6)
        fits = lambda x: np.log(x * f3 + (1 - x) * rest).mean()  # noqa: B023, E731
        assert fits(model.third[c]) >= fits(m) - 0.005 if c else model.third[c] == 0
        assert len(own) < 1000 or abs(model.third[c] - (m if c else 0)) < 0.05
    got = {r.doc_id: r.score for r in lm.score(docs, block_tokens=900, bucket_tokens=3000).collect()}
    for i, text in rows:
        want = sum(math.log10(model.third[c] * f3 + (1 - model.third[c]) * (model.weights[b] @ (f2, f1, f0))) for c, f3, b, f2, f1, f0 in whole.estimates(text))
        assert got[i] == pytest.approx(want, rel=1e-9), i
    held = [i for i, _ in rows if crc[i] % 5 == 1]
    one = sum(math.log10((whole.one[t] + 0.5) / (whole.n + 0.5 * (whole.v + 1))) for i, x in rows if i in held for t in tokens(x))
    assert sum(got[i] for i in held) > one


def test_edges(spark):
    docs = spark.createDataFrame([(None, "x y"), (3, "x " * 5000), (3, "x " * 5000)], "doc_id long, text string")
    assert lm.score(docs).count() == 3
    assert lm.score(docs.where("false")).count() == 0
