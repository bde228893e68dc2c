import math
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import quality

WS = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in WS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    text = text or ""
    words, lines = words_of(text), [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


TEXTS = [None, "", " ", "a", "a b", "a b c", "a a a", "a a a a", "a b c a b c", "x a b c y a b c z a b", "A b\nA b\n \nA b ", "é 日本 🙂|<>\x0bq\x0c\r", "a b " * 400, "w " * 3000]


def test_measures(spark):
    rows = [(i, t, 9) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(chr(97 + (i * k * k) % 3) for k in range(i)), 9) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r._m) for r in quality.measure(docs).collect()}
    assert got == {i: brute(t) for i, t, _ in rows}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n|é\t"), max_size=60), min_size=30, max_size=60))
def test_measures_of_any_text(spark, texts):
    got = {r.i: tuple(r._m) for r in quality.measure(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("k", "n", "p"), [(0, 0, 0.01), (0, 500, 0.004), (1, 5000, 0.004), (10, 5000, 0.004), (19, 5000, 0.004), (150, 50_000, 0.004), (1, 10, 0.5)])
def test_binomial_tail(spark, k, n, p):
    q = Fraction(str(p))
    want = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)) if n else 1
    row = spark.sql(f"SELECT {k}D AS k, {n}D AS n")
    assert math.isclose(row.select(quality.binomial_tail("k", "n", f"{p}D").alias("x")).head().x, float(want), rel_tol=1e-9)


def labelled(spark, n, false_share, bad_symbols=0.9):
    """Good documents of which a share has symbols, and bad ones that nearly all have."""
    rows = []
    for i in range(2 * n):
        good = i % 2 == 0
        symbols = 60 if (i // 2 % 1000 < 1000 * (false_share if good else bad_symbols)) else 0
        rows.append((i, "xx", 100, 600, symbols, 0, 0, 5, int(good)))
    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, quality int"
    df = spark.createDataFrame(rows, schema)
    return df.drop("quality"), df.select("doc_id", "quality")


@pytest.mark.parametrize(("n", "false_share", "proven"), [(5000, 0.0, True), (5000, 0.001, True), (5000, 0.01, False), (100, 0.0, False)])
def test_cutoffs_are_proven(spark, n, false_share, proven):
    cuts = {r.rule: r.cutoff for r in quality.learn_cutoffs(*labelled(spark, n, false_share)).collect()}
    assert (cuts["symbol_share"] is not None) == proven
    assert all(v is None for k, v in cuts.items() if k != "symbol_share")  # no gain from the others


def brute_cutoffs(rows, good):
    """Cutoffs by the definition: exact binomial tails by fractions, fixed sequence within a rule, Bonferroni over rules and strata, the best gain."""
    strata, out = {r["lang"] for r in rows}, {}
    share, level = Fraction(str(quality.RISK)) / 5, quality.CONFIDENCE / 5 / len(strata)
    feature = {
        "symbol_share": lambda r: r["n_symbols"] / r["n_words"], "duplicate_line_share": lambda r: r["n_dup_lines"] / r["n_lines"], "repeated_word_share": lambda r: r["n_repeat_words"] / r["n_words"],
        "long_words": lambda r: r["word_chars"] / r["n_words"], "short_words": lambda r: -r["word_chars"] / r["n_words"],
    }
    for s in strata:
        held = [r for r in rows if r["lang"] == s and r["doc_id"] in good and not (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])]
        for rule, (_, cuts) in quality.RULES.items():
            values = [[feature[rule](r) for r in held if good[r["doc_id"]] == g] for g in (1, 0)]
            n, bad, best = len(values[0]), len(values[1]), None
            for cut in cuts:
                k, b = (sum(v > cut for v in x) for x in values)
                p = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1)) if n else 1
                if p > level:
                    break
                gain = (b / bad if bad else 0) - k / n
                if bad and gain > quality.RISK and (best is None or gain > best[0] + 1e-12):
                    best = (gain, cut)
            out[s, rule] = best and best[1]
    return out, feature


def test_cutoffs_and_verdicts_by_definition(spark):
    """All rules at once over three strata, one without a name and one too small to prove anything: the same cutoffs, and every row kept or rejected by them."""
    rng = random.Random(11)
    rows = []
    for i in range(9000):
        bad, n = i % 2, rng.randint(30, 400)
        lang = None if i % 50 == 0 else "xx" if i % 3 else "yy"
        chars = n * (rng.choice([4, 5, 6]) if not bad or rng.random() < 0.7 else rng.choice([2, 11, 18]))
        lines = rng.randint(1, 30)
        rows.append({"doc_id": i, "lang": lang, "n_words": n, "word_chars": chars, "n_symbols": int(n * rng.choice([0, 0.02, 0.3, 0.8])) if bad else int(n * rng.choice([0, 0.01, 0.02, 0.03])),
                     "n_dup_lines": int(lines * rng.random() * (0.9 if bad else 0.05)), "n_repeat_words": int(n * rng.random() * (0.55 if bad else 0.08)), "n_lines": lines})
    good = {r["doc_id"]: 1 - r["doc_id"] % 2 for r in rows if rng.random() < 0.9}
    columns = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    measured = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} {'string' if c == 'lang' else 'long'}" for c in columns))
    labels = spark.createDataFrame(list(good.items()), "doc_id long, quality int")
    cutoffs = quality.learn_cutoffs(measured, labels)
    want, feature = brute_cutoffs(rows, good)
    got = {(r.stratum, r.rule): r.cutoff for r in cutoffs.collect()}
    assert {k: v for k, v in want.items() if v is not None} == {k: v for k, v in got.items() if v is not None}
    assert len({r for (_, r), v in want.items() if v is not None}) >= 4 and any(v is None for v in want.values())
    for r in quality.judge(measured, cutoffs).collect():
        own = r.asDict()
        hits = [rule for rule in quality.RULES if want[r.lang, rule] is not None and feature[rule](own) > want[r.lang, rule]]
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.rejected_by, r.base_failed, r.kept) == (hits, base, not base and not hits)
    kept_good = [r for r in rows if good.get(r["doc_id"]) and r["n_words"] >= 50]
    lost = sum(any(want[r["lang"], k] is not None and feature[k](r) > want[r["lang"], k] for k in quality.RULES) for r in kept_good)
    assert lost <= quality.RISK * len(kept_good)


def test_keep_good(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, clean, "en", "x"), (2, "short", "en", "x"), (2, None, None, None), (3, "a b c " * 40, "en", "x"), (3, clean, None, "y"), (None, clean, "de", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.lang or "") for r in kept.collect()) == [(0, "de"), (1, "en"), (3, "")]
    assert quality.keep_good(docs.where("false"), labels.where("false")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op6_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()
    for d in docs:
        n, chars, symbols, dup, repeat, _ = brute(d.text)
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.kept and r.base_failed)
