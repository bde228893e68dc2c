"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating, and share all words by weight. A target
stops at `epochs` times its source's size and the excess is shared again by weight; sorted by size per weight, running
sums give the level at which this ends, without iterating.

Blocks: the words of a source are dealt into shards by a hash of its documents, put in seeded order inside a shard and
cut into blocks of equal length (the last one may be shorter). The hash is of id and text, so rows without an id are spread. Blocks go to sources by the highest quotients
target/(2s - 1); only the seats near the common divisor are listed, about three a source, never one row a block. The
quota of a source goes to its shards in the same way, by their sizes: integer quotas for each shard.

Selection: a shard of n blocks with quota q takes each block q div n times, and q mod n seeded blocks once more: block
i is taken if (i * r + seed) mod n < r, which spreads exactly r of n blocks evenly over an order that is already seeded.
Running counts of taken blocks have a closed form, so a document's taken words need no row for each block.

Nulls and texts without a word have size 0 and nothing is taken from them. Documents that repeat are mixed one by one;
ties of the seeded order are between equal rows. Reruns agree. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, word_count, written

WEIGHTS = (5, 2, 1)
BLOCK_WORDS, SHARD_DOCS, EPOCHS, SEED = 16, 4096, 3, 20


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size, docs; one row a source) with its weight and target.

    The windows run over one row for each source, not over documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    out = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    out = out.withColumn("_cap", F.lit(epochs) * F.col("source_size"))
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    total, weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    capped = F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gone = F.coalesce(F.sum("weight").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = out.withColumn("_level", (total - capped) / (weight - gone)).withColumn("_place", F.row_number().over(by_level))
    # The first source in that order that stays at or below its cap sets the level for itself and all after it.
    free = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_place").alias("p"), F.col("_level").alias("l")))).over(everything)
    out = out.withColumn("_free", free["l"])
    return out.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_free") * F.col("weight"))).drop("_cap", "_level", "_place", "_free")


def apportion(claims: DataFrame, group: list[str], claim: str, seats: str, order: list[str], out: str) -> DataFrame:
    """Adds out: the integer share of each row in the `seats` of its group, by Sainte-Lague over the column claim.

    With n claimants and total T the divisor lies where T/d is within n/2 of the seats, which leaves each row a sure
    number of seats and a few contested ones; only these are ranked by quotient, with ties in the given order.
    """
    w = Window.partitionBy(*(group or [F.lit(0)]))
    total, n = F.sum(claim).over(w), F.count("*").over(w)
    rate = lambda shift: F.coalesce(F.try_divide(F.col(claim) * F.greatest(F.col(seats) + shift, F.lit(0.0)), F.col("_total")), F.lit(0.0))
    rows = claims.withColumn("_total", total.cast("double")).withColumn("_half", n / 2 + 1)
    rows = rows.withColumn("_sure", F.greatest(F.floor(rate(-F.col("_half")) + 0.5) - 1, F.lit(0))).withColumn("_most", F.floor(rate(F.col("_half")) + 0.5) + 1)
    rows = rows.withColumn("_open", F.col(seats) - F.sum("_sure").over(w))
    seat = F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_seat")
    tried = rows.where(F.col(claim) > 0).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], claim, "_open", seat)
    by_quotient = Window.partitionBy(*([f"_g{i}" for i in range(len(group))] or [F.lit(0)])).orderBy((F.col(claim) / (2 * F.col("_seat") - 1)).desc(), *[f"_o{i}" for i in range(len(order))])
    won = tried.withColumn("_rank", F.row_number().over(by_quotient)).where(F.col("_rank") <= F.col("_open"))
    keys = [f"_g{i}" for i in range(len(group))] + [f"_o{i}" for i in range(len(order))]
    extra = won.groupBy(*keys).agg(F.count("*").alias("_extra"))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip([*group, *order], keys, strict=True)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(extra, on, "left").withColumn(out, F.col("_sure") + F.coalesce("_extra", F.lit(0))).drop("_total", "_half", "_sure", "_most", "_open", "_extra", *keys)


def plan(sized: DataFrame, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, epochs: int = EPOCHS) -> DataFrame:
    """(source, shard, shards, source_size, target, shard_size, blocks, quota) for sized rows (source, size, _hash): one row a source and shard."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = source_targets(sources, epochs=epochs).withColumn("shards", F.ceil(F.col("docs") / shard_docs))
    everything = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("_all", F.round(F.sum("target").over(everything) / block_words).cast("long"))
    sources = written(apportion(sources, [], "target", "_all", ["source"], "source_quota").drop("_all"), "sources")
    placed = sized.join(sources.select(F.col("source").alias("_s"), "shards", "source_size", "target", "source_quota"), F.col("source").eqNullSafe(F.col("_s")))
    placed = placed.withColumn("shard", F.pmod("_hash", "shards"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), *[F.first(c).alias(c) for c in ("shards", "source_size", "target", "source_quota")])
    shards = apportion(shards, ["source"], "shard_size", "source_quota", ["shard"], "quota")
    shards = shards.withColumn("blocks", F.ceil(F.col("shard_size") / block_words)).withColumn("_kept", F.least(F.col("quota"), epochs * F.col("blocks")))
    # Seats above a shard's epochs, a few from rounding, go to the next shards of the source that have room.
    own, ahead = Window.partitionBy("source"), Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    room = epochs * F.col("blocks") - F.col("_kept")
    rest = F.sum(F.col("quota") - F.col("_kept")).over(own) - F.coalesce(F.sum(room).over(ahead), F.lit(0))
    return shards.withColumn("quota", F.col("_kept") + F.least(room, F.greatest(rest, F.lit(0)))).drop("source_quota", "_kept")


def mixed(sized: DataFrame, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """sized (source, size, order columns _o, _hash; others pass) with source_size, target, start, blocks, quota, offset and taken.

    start is the place of the document's first word in its shard; with blocks, quota and offset it says which words are
    taken how often, see block_times().
    """
    shards = written(plan(sized, block_words, shard_docs, epochs), "shards")
    count = shards.select(F.col("source").alias("_s"), "shards").distinct()
    dealt = sized.join(count, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("shard", F.pmod("_hash", "shards")).drop("shards")
    before = Window.partitionBy("source", "shard").orderBy(F.xxhash64("_o", "_hash", F.lit(seed)), "_o", "_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    own = shards.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "source_size", "target", "shard_size", "blocks", "quota")
    out = dealt.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h"))).drop("_s", "_h")
    out = out.withColumn("offset", F.coalesce(F.try_mod(F.abs(F.xxhash64("source", "shard", F.lit(seed))), F.col("blocks")), F.lit(0)))
    return out.withColumn("taken", words_before(F.col("start") + F.col("size"), block_words) - words_before(F.col("start"), block_words))


def _extra_before(i: Column) -> Column:
    """Seeded blocks among the first i of a shard: those k < i for which (k * r + offset) mod n < r, r = quota mod n."""
    n, r, off = F.col("blocks"), F.try_mod("quota", "blocks"), F.col("offset")
    # (k*r + off) mod n < r just where floor((k*r + off)/n) exceeds floor(((k-1)*r + off)/n), counted from k = 0.
    return F.coalesce(F.floor(F.try_divide(((i - 1) * r + off), n)) - F.floor(F.try_divide(off - r, n)), F.lit(0)).cast("long")


def block_times(i: Column) -> Column:
    """How often block i of the row's shard is taken."""
    return F.coalesce(F.floor(F.try_divide("quota", "blocks")), F.lit(0)).cast("long") + _extra_before(i + 1) - _extra_before(i)


def words_before(place: Column, block_words: int) -> Column:
    """Words taken from the shard's words ahead of place, repeats counted."""
    full = F.floor(place / block_words)
    whole = F.coalesce(F.floor(F.try_divide("quota", "blocks")), F.lit(0)) * full + _extra_before(full)
    return (whole * block_words + F.pmod(place, F.lit(block_words)) * block_times(full)).cast("long")


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(id_col, F.coalesce(text_col, F.lit(""))).alias("_hash")).withColumn("_o", F.col(id_col))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(id_col, source, size, source_size, target, taken, ...): what the mix takes of each document."""
    return mixed(written(sized_documents(docs, id_col, text_col, source_col), "sizes"), **how).drop("_o", "_hash")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "shard")


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, epochs: int = EPOCHS, **how) -> DataFrame:
    """The mix as rows with the columns of docs: the e-th row of a document has the words that are taken e times or more.

    Words keep the white space that follows them, and a document taken whole keeps its text as it is. A document of
    which nothing is taken goes.
    """
    # One key for the places of twins and for the join, so that texts are shuffled once; nulls hash as texts that no source has.
    own = F.xxhash64(id_col, F.coalesce(text_col, F.lit("")), F.coalesce(F.col(source_col), F.lit("\0")))
    keyed = docs.withColumn("_o", own).withColumn("_hash", F.xxhash64("_o"))
    sizes = written(keyed.select("_o", "_hash", F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    taken = mixed(sizes, block_words=block_words, epochs=epochs, **how).where("taken > 0").groupBy("_o").agg(F.collect_list(F.struct("size", "start", "blocks", "quota", "offset", "taken")).alias("_mix"))
    twin = Window.partitionBy("_o").orderBy(F.lit(0))
    rows = keyed.withColumn("_twin", F.row_number().over(twin)).join(taken, "_o")
    rows = rows.withColumn("_t", F.get("_mix", F.col("_twin") - 1)).where("_t IS NOT NULL")
    rows = rows.select(*[F.col(c).alias(f"_d_{c}") for c in docs.columns], "_t.*")
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    # Blocks of a document go at most one above the whole turns, so an epoch has all its words, none, or the seeded blocks.
    rows = rows.withColumn("_turns", F.floor(F.col("quota") / F.col("blocks"))).where(F.col("_epoch") <= F.col("_turns") + 1)
    here = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    seeded = F.when(F.col("_epoch") > F.col("_turns"), F.filter(here, lambda i: block_times(i) >= F.col("_epoch")))
    rows = rows.withColumn("_seeded", seeded).where(F.col("_seeded").isNull() | (F.size("_seeded") > 0))
    words = F.regexp_extract_all(f"_d_{text_col}", F.lit(rf"({WORD}[\x20\x09-\x0D]*)"))
    begin = lambda i: F.greatest(i * block_words - F.col("start"), F.lit(0)).cast("int")
    block = lambda w, i: F.slice(w, begin(i) + 1, ((i + 1) * block_words - F.col("start")).cast("int") - begin(i))
    # The words are bound to a variable, so that a text is cut into words once and not for each of its blocks.
    cut = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("_seeded", lambda i: block(w, i))), "")), F.lit(0))
    rows = rows.withColumn(f"_d_{text_col}", F.when(F.col("_seeded").isNull(), F.col(f"_d_{text_col}")).otherwise(cut))
    return rows.where(F.length(f"_d_{text_col}") > 0).select(*[F.col(f"_d_{c}").alias(c) for c in docs.columns])
