"""Text to rows: number tokens, keyword windows, tuples that satisfy identities, forward-filled markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import half_width

NUMBER = r"(\(?[△▲\-]?[0-9][0-9,]*(?:\.[0-9]+)?\)?)"


def number_tokens(df: DataFrame, keys: list[str], text: str, least_digits: int = 3) -> DataFrame:
    """(keys, position, token, value, parenthetical): numbers of a text in order; bare integers of fewer digits are no amounts."""
    tokens = F.regexp_extract_all(half_width(F.coalesce(F.col(text), F.lit(""))), F.lit(NUMBER))
    rows = df.select(*keys, F.posexplode(tokens).alias("position", "token"))
    bare = F.translate("token", "()△▲-,", "")
    amount = F.contains("token", F.lit(",")) | F.contains("token", F.lit(".")) | (F.length(bare) >= least_digits)
    whole = F.startswith("token", F.lit("(")) & F.endswith("token", F.lit(")"))
    negative = whole | (F.length(F.translate("token", "△▲-", "")) < F.length("token"))
    number = bare.try_cast("double")
    return rows.where(amount).withColumn("parenthetical", whole).withColumn("value", F.when(negative, -number).otherwise(number))


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How many of the words a text contains."""
    return sum((F.coalesce(text.contains(w), F.lit(False)).cast("int") for w in words), F.lit(0))


def score_blocks(df: DataFrame, text: str, headings: list[str], table_words: list[str], bonus: list[str] = (), penalty: list[str] = ()) -> DataFrame:
    """Score of a block: three for a heading word, two for a table word, one more or less for the others."""
    c = F.lower(text)
    score = 3 * keyword_hits(c, headings) + 2 * keyword_hits(c, table_words) + keyword_hits(c, list(bonus)) - keyword_hits(c, list(penalty))
    return df.withColumn("heading_hits", keyword_hits(c, headings)).withColumn("table_hits", keyword_hits(c, table_words)).withColumn("score", score)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], cap: int, signature: Column | None = None) -> DataFrame:
    """The best `cap` rows of each key, equal signatures counting once."""
    if signature is not None:
        w = Window.partitionBy(*keys, signature).orderBy(*order)
        df = df.withColumn("_d", F.row_number().over(w)).where("_d = 1").drop("_d")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= cap)


def merged_windows(hits: DataFrame, keys: list[str], position: str, before: int, after: int) -> DataFrame:
    """Windows around hits with overlapping ones merged (gaps and islands): (keys, window_start, window_end, hits)."""
    w = Window.partitionBy(*keys).orderBy(position)
    spans = hits.withColumn("_a", F.greatest(F.col(position) - before, F.lit(0))).withColumn("_b", F.col(position) + after)
    reach = F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(F.col("_a") <= reach, 0).otherwise(1))
    spans = spans.withColumn("_island", F.sum("_new").over(w))
    return spans.groupBy(*keys, "_island").agg(F.min("_a").alias("window_start"), F.max("_b").alias("window_end"), F.count("*").alias("hits")).drop("_island")


#: What rows of order tables are called; blanks may stand between the letters.
ROW_LABELS = {"building": r"建\s*築(?:\s*(?:事業|工事|部門))?", "civil": r"土\s*木(?:\s*(?:事業|工事|部門))?", "total": r"(?:合\s*)?計"}


def labelled_numbers(df: DataFrame, keys: list[str], text: str, labels: dict[str, str] = ROW_LABELS, least_digits: int = 3, most: int = 13) -> DataFrame:
    """(keys, place, label, position, value): the row labels of a text in order, and the numbers up to the next label, at most `most`.

    Numbers in parentheses are remarks and do not count, nor do bare integers of few digits. labels are patterns by name.
    """
    either = "|".join(labels.values())
    t = F.regexp_replace(half_width(F.coalesce(F.col(text), F.lit(""))), r"\([^()]{1,20}\)", " ")
    rows = df.select(*keys, t.alias("_t")).where(F.col("_t").rlike(either))
    found = F.arrays_zip(F.regexp_extract_all("_t", F.lit(f"({either})"), 1).alias("label"), F.slice(F.split("_t", f"(?:{either})"), 2, 1 << 30).alias("tail"))
    # Outer, as the optimizer would compute a plain explode's array once more to ask for its size.
    rows = rows.select(*keys, F.posexplode_outer(found).alias("place", "x")).select(*keys, "place", "x.label", "x.tail")
    name = F.when(F.lit(False), "")
    for key, pattern in labels.items():
        name = name.when(F.col("label").rlike(f"^(?:{pattern})$"), key)
    tokens = F.filter(
        F.regexp_extract_all("tail", F.lit(r"([△▲\-−]?[0-9][0-9,]*(?:\.[0-9]+)?)")),
        lambda x: x.contains(",") | x.contains(".") | (F.length(F.translate(x, "△▲-−", "")) >= least_digits),
    )
    values = F.transform(F.slice(tokens, 1, most), lambda x: F.translate(x, "△▲−-,", "----").try_cast("double"))
    return rows.select(*keys, "place", name.alias("label"), F.posexplode_outer(values).alias("position", "value")).where("value IS NOT NULL")


def fitted_tuples(tokens: DataFrame, keys: list[str], absolute: float = 1.0, share: float = 0.005, order: str = "position") -> DataFrame:
    """(keys, position, a, b, c, d, e): five numbers in a row with a + b = c and c - d = e, within max(absolute, share of the result); where a key has none, four without the sum c, a + b - d = e within max(2, 0.1 %).

    keys bound the windows: with the row's label among them no window runs into the next row.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    next_ = [F.lead("value", i).over(w).alias(f"_{i}") for i in range(1, 5)]
    rows = tokens.select(*keys, F.col(order).alias("position"), F.col("value").alias("_0"), *next_)
    v = [F.col(f"_{i}") for i in range(5)]
    ok = lambda diff, base, least, part: F.coalesce(F.abs(diff) <= F.greatest(F.lit(least), F.abs(base) * part), F.lit(False))
    five = ok(v[0] + v[1] - v[2], v[2], absolute, share) & ok(v[2] - v[3] - v[4], v[4], absolute, share)
    four = ok(v[0] + v[1] - v[2] - v[3], v[3], 2.0, 0.001)
    rows = rows.withColumn("_five", five).withColumn("_four", four).withColumn("_any", F.max("_five").over(Window.partitionBy(*keys)))
    rows = rows.where(F.col("_five") | (~F.col("_any") & F.col("_four")))
    five_ = F.col("_five")
    return rows.select(*keys, "position", v[0].alias("a"), v[1].alias("b"), F.when(five_, v[2]).alias("c"), F.when(five_, v[3]).otherwise(v[2]).alias("d"), F.when(five_, v[4]).otherwise(v[3]).alias("e"))


def row_consistency(fits: DataFrame, keys: list[str]) -> DataFrame:
    """fits (keys, place, label, position, a..e) with consistent: false where a building row between its civil and its total row does not add up to the total in a role all three have."""
    w = Window.partitionBy(*keys).orderBy("place", "position")
    roles = ["a", "b", "c", "d", "e"]
    row = F.struct("label", *roles)
    out = fits.withColumn("_p", F.lag(row).over(w)).withColumn("_n", F.lead(row).over(w))
    trio = (F.col("label") == "building") & (F.col("_p.label") == "civil") & (F.col("_n.label") == "total")
    off = F.lit(False)
    for r in roles:
        total = F.col(f"_n.{r}")
        off = off | F.coalesce(F.abs(F.col(r) + F.col(f"_p.{r}") - total) > F.greatest(F.lit(1.0), F.abs(total) * 0.005), F.lit(False))
    out = out.withColumn("_bad", F.coalesce(trio & off, F.lit(False)))
    around = F.coalesce(F.lag("_bad").over(w), F.lit(False)) | F.coalesce(F.lead("_bad").over(w), F.lit(False))
    return out.withColumn("consistent", ~(F.col("_bad") | around)).drop("_p", "_n", "_bad")


def classified(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, value) of found values (keys, value, whole, consistent): high_confidence if the consistent rows with a sum column agree in one value to a tenth, else low_confidence."""
    sure = F.col("whole") & F.col("consistent")
    rounded = F.count_distinct(F.when(sure, F.round("value", 1)))
    out = found.groupBy(*keys).agg(rounded.alias("_n"), F.min(F.when(sure, F.col("value"))).alias("_v"))
    return out.select(*keys, F.when(F.col("_n") == 1, "high_confidence").otherwise("low_confidence").alias("status"), F.when(F.col("_n") == 1, F.col("_v")).alias("value"))


def forward_fill(df: DataFrame, keys: list[str], order: str, marker: str, out: str) -> DataFrame:
    """The last marker at or before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(marker, ignorenulls=True).over(w))


def markdown_table(lines: DataFrame, text: str, names: list[str]) -> DataFrame:
    """Rows of pipe tables: cells by name; separator rows and the header go, the raw line stays."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(text), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.trim(text).startswith("|") & ~F.col(text).rlike(r"^[\s|:\-]+$")).withColumn("_c", cells)
    rows = rows.where(F.get("_c", F.lit(0)) != names[0])
    return rows.select(*[F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(names)], F.col(text).alias("raw_line"))
