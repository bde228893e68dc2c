"""Quality rules whose cutoffs come with a guarantee: risk-controlled thresholds, in DataFrame functions only.

Each rule rejects documents whose feature exceeds a cutoff. Candidate cutoffs are fixed grids. On the labelled good
documents of a stratum a candidate is tested against the hypothesis that it rejects more than the share `risk` of good
documents; the exact binomial tail P(Bin(n, risk share) <= false rejections) is its p-value. Within a rule candidates
are tested from the mildest on and the first failure ends the sequence (fixed-sequence testing), so that only the
number of rules and strata is to be corrected for: each is tested at confidence/(rules * strata) (Bonferroni), and the
risk of a stratum is shared equally by its rules, so the union of all rules keeps to it. Of the proven cutoffs of a rule
that with the largest gain (share of bad documents rejected less that of good ones) is used, the mildest of equals. A
stratum without enough labels, or a rule whose gain is below `risk`, gets no cutoff: it rejects nothing beyond the base rules.

Nulls and texts without a word have no words and fail the base rules. Documents with a null stratum form a stratum of
their own. Labels that repeat count once for each document; contradicting labels count as good. Documents that repeat
are judged one by one. An empty table gives an empty result, and labels of unknown documents count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

# Symbols of the base rules, and white space between words.
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "

#: Rule: its feature over the measured columns, and candidate cutoffs from the mildest on.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbol_share": ("try_divide(n_symbols, n_words)", [1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.07, 0.05]),
    "duplicate_line_share": ("try_divide(n_dup_lines, n_lines)", [0.8, 0.65, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1]),
    "repeated_word_share": ("try_divide(n_repeat_words, n_words)", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "long_words": ("try_divide(word_chars, n_words)", [30.0, 20.0, 15.0, 12.0, 10.0, 9.0]),
    "short_words": ("-try_divide(word_chars, n_words)", [-1.5, -2.0, -2.5, -3.0, -3.5]),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
RISK, CONFIDENCE = 0.02, 0.05


def _repeat_words() -> Column:
    """Words in windows of three words that occur twice or more in _words.

    Windows are hashed to 64 bits. Only where a hash repeats are (hash, place) pairs sorted, equal neighbours kept, and
    their places, in order, each credited with the words up to the next one, three at most.
    """
    hashes = "transform(slice(_words, 1, size(_words) - 2), (w, i) -> xxhash64(w, element_at(_words, i + 2), element_at(_words, i + 3)))"
    return F.expr(f"CASE WHEN size(_words) < 4 THEN array() ELSE {hashes} END")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column _m of MEASURES; every text is read whole, once, without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    out = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))).withColumn("_lines", lines)
    out = out.withColumn("_hashes", _repeat_words())
    out = out.withColumn(
        "_pairs",
        F.expr("CASE WHEN size(array_distinct(_hashes)) = size(_hashes) THEN array() ELSE array_sort(transform(_hashes, (h, i) -> struct(h, i))) END"),
    )
    out = out.withColumn("_places", F.expr("sort_array(transform(filter(_pairs, (p, i) -> (i > 0 AND _pairs[greatest(i - 1, 0)].h = p.h) OR (i + 1 < size(_pairs) AND _pairs[least(i + 1, size(_pairs) - 1)].h = p.h)), p -> p.i))"))
    out = out.withColumn(
        "_covered",
        F.expr("CASE WHEN size(_places) = 0 THEN 0L ELSE 3L + aggregate(transform(_places, (p, i) -> CASE WHEN i = 0 THEN 0 ELSE least(3, p - _places[i - 1]) END), 0L, (s, x) -> s + x) END"),
    )
    measures = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_covered").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    return out.withColumn("_m", measures).drop("_words", "_lines", "_hashes", "_pairs", "_places", "_covered")


def base_failed(m: str = "") -> Column:
    return F.expr(f"{m}n_words < 50 OR 100 * {m}n_repeat_words > 50 * {m}n_words")


def log_factorial(n: str) -> str:
    """SQL for ln(n!): Stirling's series at n + 8, taken back by eight factors; good to 1e-12."""
    x = f"({n} + 9D)"
    series = f"({x} - 0.5D) * ln({x}) - {x} + 0.5D * ln(2D * pi()) + 1D / (12D * {x}) - 1D / (360D * power({x}, 3)) + 1D / (1260D * power({x}, 5)) - 1D / (1680D * power({x}, 7))"
    back = " + ".join(f"ln({n} + {j}D)" for j in range(1, 9))
    return f"(({series}) - ({back}))"


def binomial_tail(k: str, n: str, p: str) -> Column:
    """P(Bin(n, p) <= k), exactly summed from k down; terms below 1e-17 of the sum's scale are past the loop's end.

    The loop has at most 60 standard deviations and 100 terms, so it grows as the root of n.
    """
    at = f"exp({log_factorial(n)} - {log_factorial(k)} - {log_factorial(f'({n} - {k})')} + {k} * ln({p}) + ({n} - {k}) * ln(1D - {p}))"
    terms = f"cast(least({k}, 100 + 60 * sqrt({n} * {p} * (1D - {p}))) as int)"
    step = f"(a, j) -> named_struct('t', a.t * ({k} - j + 1D) / ({n} - {k} + j) * (1D - {p}) / {p}, 's', a.s + a.t * ({k} - j + 1D) / ({n} - {k} + j) * (1D - {p}) / {p})"
    total = f"aggregate(CASE WHEN {terms} >= 1 THEN sequence(1, {terms}) ELSE array() END, named_struct('t', {at}, 's', {at}), {step}, a -> a.s)"
    # The sum runs down from k, where terms fall only below the mean; above it the tail is over one half and never significant.
    return F.expr(f"CASE WHEN {n} = 0 THEN 1D WHEN {k} >= {n} * {p} THEN 1D ELSE least(1D, {total}) END")


def learn_cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(stratum, rule, cutoff): the most severe cutoffs proven on the labelled good documents; null where none is.

    measured has id_col, stratum_col and the MEASURES. Documents that fail the base rules are no evidence, as the
    cutoffs never judge them. One row a stratum and rule, whatever the size of the input.
    """
    pad = max(len(c) for _, c in RULES.values())
    marked = labels.groupBy(id_col).agg(F.max("quality").alias("_good"))
    held = measured.where(~base_failed()).join(marked, id_col)
    # Shorter grids are padded with their last cutoff, so that every rule has the same number of candidates.
    cuts = {r: F.array(*[F.lit(c[min(i, len(c) - 1)]) for i in range(pad)]) for r, (_, c) in RULES.items()}
    values = F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(f).cast("double").alias("value"), cuts[r].alias("cuts")) for r, (f, _) in RULES.items()])
    rows = held.select(F.col(stratum_col).alias("stratum"), "_good", F.explode(values).alias("v")).select("stratum", "_good", "v.*")
    over = [F.count_if((F.col("_good") == g) & (F.col("value") > F.element_at("cuts", i + 1))).alias(f"{n}{i}") for i in range(pad) for g, n in ((1, "k"), (0, "b"))]
    totals = [F.count_if(F.col("_good") == g).cast("double").alias(n) for g, n in ((1, "n"), (0, "bad"))]
    seen = rows.groupBy("stratum", "rule", "cuts").agg(*totals, *over)
    strata = measured.agg(F.count_distinct(F.struct(F.col(stratum_col))).alias("strata"))
    tests = F.array(*[F.struct(F.lit(i).alias("i"), F.element_at("cuts", i + 1).alias("cutoff"), F.col(f"k{i}").cast("double").alias("k"), F.col(f"b{i}").cast("double").alias("b")) for i in range(pad)])
    tested = seen.join(F.broadcast(strata)).select("stratum", "rule", "n", "bad", "strata", F.explode(tests).alias("t")).select("stratum", "rule", "n", "bad", "strata", "t.*")
    share, level = f"{risk / len(RULES)!r}D", F.lit(confidence / len(RULES)) / F.col("strata")
    tested = tested.withColumn("p", binomial_tail("k", "n", share)).withColumn("level", level)
    failed = F.max(F.when(F.col("p") <= F.col("level"), 0).otherwise(1)).over(Window.partitionBy("stratum", "rule").orderBy("i"))
    tested = tested.withColumn("proven", failed == 0).withColumn("gain", F.expr("try_divide(b, bad) - try_divide(k, n)"))
    # Of the proven cutoffs that with the largest gain is used, the mildest of equals; a gain below the risk is not worth it.
    useful = F.when(F.col("proven") & (F.col("gain") > risk), F.struct(F.col("gain"), (-F.col("i")).alias("mild"), F.col("cutoff")))
    return tested.groupBy("stratum", "rule").agg(F.max(useful).alias("best")).select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """measured with base_failed, rejected_by (rules that reject the row, in their order) and kept."""
    wide = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    wide = wide.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_cut_{r}") for r in RULES])
    out = measured.join(wide, F.col(stratum_col).eqNullSafe(F.col("_stratum")), "left")
    hits = F.array_compact(F.array(*[F.when(F.expr(f) > F.col(f"_cut_{r}"), F.lit(r)) for r, (f, _) in RULES.items()]))
    out = out.withColumn("base_failed", base_failed()).withColumn("rejected_by", hits)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_stratum", *[f"_cut_{r}" for r in RULES])


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    measured = written(measure(docs).select("doc_id", "lang", "_m.*"), "measured")
    cutoffs = written(learn_cutoffs(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")), "cutoffs")
    return judge(measured, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that the base rules and the learned cutoffs keep, with the columns of docs."""
    table = written(measure(docs, text_col), "measured")
    flat = table.select(F.col(id_col), F.col(stratum_col), "_m.*")
    cutoffs = written(learn_cutoffs(flat, labels, id_col, stratum_col), "cutoffs")
    judged = judge(table.select(*[F.col(c).alias(f"_d_{c}") for c in docs.columns], "_m.*"), cutoffs, f"_d_{stratum_col}")
    return judged.where("kept").select(*[F.col(f"_d_{c}").alias(c) for c in docs.columns])
