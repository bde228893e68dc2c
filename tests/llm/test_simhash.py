import itertools
import random

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import simhash


def brute_fp(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b\tC d e\x0bf", " x　y a b c d", "É é a A z Z\r\nq w e r t"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fp(text)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for centre in fps[:12]:
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(1, 9)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    rows = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    from ledgerlens.llm.common import components

    for limit, blocks in ((20_000, None), (3, None), (20_000, 11), (20_000, 5)):
        links = simhash.similar_links(spark.createDataFrame(rows, "fp long"), limit, blocks)
        got = {r.node: r.root for r in components(links).collect()}
        as_unsigned = {r[0]: int(np.int64(r[0]).view(np.uint64)) for r in rows}
        classes = {}
        for x in as_unsigned:
            classes.setdefault(got.get(x, x), set()).add(as_unsigned[x])
        want = {}
        for x, c in zip(fps, brute_components(fps), strict=True):
            want.setdefault(c, set()).add(x)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_documents(spark):
    rows = [(3, "the quick brown fox jumps over the dog", "x"), (1, "The quick brown fox jumps over the dog", "y"), (2, None, None), (7, "", "x"), (7, "", "x"), (None, "completely different words live here now", "z"), (9, "w " * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(3, 1), (1, 1), (2, 2), (7, 2), (None, None), (9, 9)}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 9]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_path_in_sorted_order(spark):
    from ledgerlens.llm.common import components

    edges = spark.range(0, 500).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(900, 901), (900, 900), (901, 900)], "a long, b long"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(501)} | {900: 900, 901: 900}


def test_one_row_a_group_stays(spark):
    """Distinct texts without an id, or under one id, stay each; a row without an id goes where its group has one with an id."""
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    rows = [(None, texts[0], "x"), (None, texts[1], "x"), (None, texts[1], "x"), (5, texts[2], "y"), (5, texts[3], "y"), (7, texts[4], "z"), (None, texts[4], "z"), (8, texts[4], "z"), (9, texts[5], "q"), (9, texts[5], "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.drop_near_duplicates(docs)
    want = {(None, texts[0], "x"), (None, texts[1], "x"), (5, texts[2], "y"), (5, texts[3], "y"), (7, texts[4], "z"), (9, texts[5], "p")}
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(want) and set(got) == want


def test_embedding_is_a_lower_bound(spark):
    """Unary counts of two-bit segments, in numpy and as an expression; their distance is the Manhattan distance of the counts."""
    rng = random.Random(9)
    fps = [0, (1 << 64) - 1, 1 << 63, *[rng.getrandbits(64) for _ in range(300)]]
    emb = simhash.embedded(np.array(fps, np.uint64))
    counts = [[(x >> 2 * i & 3).bit_count() for i in range(32)] for x in fps]
    assert [[(int(e) >> 2 * i & 3).bit_count() for i in range(32)] for e in emb] == counts
    for i, j in itertools.combinations(range(60), 2):
        manhattan = sum(abs(a - b) for a, b in zip(counts[i], counts[j], strict=True))
        assert (int(emb[i]) ^ int(emb[j])).bit_count() == manhattan <= (fps[i] ^ fps[j]).bit_count()
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long").select(simhash.embedding(simhash.F.col("fp")).alias("e"))
    assert [r.e for r in df.collect()] == emb.view(np.int64).tolist()


@pytest.mark.parametrize("blocks", [5, 8, 9, 13])
def test_a_close_pair_shares_a_cell(blocks):
    rng, masks = random.Random(2), simhash.grids(blocks)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        a, b = (int(e) for e in simhash.embedded(np.array([x, y], np.uint64)))
        assert any(a & m == b & m for m in masks)


def test_dense_cells_give_a_forest():
    """A cell of many close fingerprints yields fewer links than rows, by either way, and connects them."""
    base = random.Random(4).getrandbits(64)
    fps = np.array(sorted({base ^ (1 << i) ^ (1 << j) for i in range(0, 40, 2) for j in range(20)}), np.uint64)
    for square in (0, 10_000):
        cells = simhash.Cells(4, None)
        cells.SQUARE = square
        links = [p for a, b in cells.forest(fps) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(links) == len(fps) - 1 and {x for p in links for x in p} == set(fps.tolist())


def test_blocks_follow_the_fingerprints():
    n = [simhash.blocks_for(10**k) for k in range(13)]
    assert n[0] == 8 and n == sorted(n) and n[6] == 8 and n[8] == 9 and n[12] <= simhash.MOST_BLOCKS


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    fps = [brute_fp(r.text) for r in rows]
    want = {(r.doc_id, f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, brute_components(fps), strict=True)}
    assert {tuple(r) for r in simhash.op5_simhash(spark, sf).collect()} == want
