"""URL filters by a temporal list join.

Lists are dated entries: at some time a list adds or removes a host, a registered domain or an address prefix. The
entries of a list's key become validity intervals, from an addition until the next removal. Each capture asks for its
host and the host's parent domains and for the prefixes of its path, and an as-of join finds the intervals that hold at
its fetch time: the last state at or before it. So an entry never acts on captures from before it was made or after it
was withdrawn.

The join is on the key, with the time as range; intervals of a list and key do not overlap, so a capture's key meets at
most one interval of a list. An address makes keys only down to the deepest one that is listed, so that a very long
address costs no more than the list asks for. Captures come with few columns. A hot host makes a skewed key whose large side Spark's
adaptive join splits; repeated entries go before the intervals are made.

Addresses are compared in lower case without scheme, user, port, query or fragment. Null addresses or times match
nothing and are not blocked. At the same instant additions come after removals, so the key is listed. Captures that
repeat are judged one by one. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def keys_of(url: Column, labels: int, steps: int) -> Column:
    """The distinct keys under which an address may be listed: host and parent domains of at most `labels` labels, and prefixes host/a, host/a/b ... of at most `steps` steps."""
    host, path = host_of(url), F.regexp_extract(url, PATH, 1)
    parts = F.split(host, r"\.")
    n = F.size(parts)
    parents = F.transform(F.sequence(F.least(F.lit(2), n), F.least(n, F.greatest(F.lit(labels), F.lit(1)))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    parents = F.when(F.least(F.lit(2), n) <= F.greatest(F.lit(labels), F.lit(1)), parents).otherwise(F.array().cast("array<string>"))
    taken = F.slice(F.filter(F.split(F.lower(path), "/"), lambda s: s != ""), 1, max(steps, 0))
    prefixes = F.when(F.size(taken) > 0, F.transform(F.sequence(F.lit(1), F.size(taken)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(taken, F.lit(1), i), "/"))))
    return F.array_distinct(F.filter(F.concat(parents, F.coalesce(prefixes, F.array().cast("array<string>"))), lambda k: k != ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) for entries (list, key, action, at); valid_to is null while an entry holds."""
    clean = entries.where("key IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')").select("list", F.lower("key").alias("key"), "action", "at").distinct()
    # One state for each instant, then only changes of state: runs of equal states are one.
    state = clean.groupBy("list", "key", "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    w = Window.partitionBy("list", "key").orderBy("at")
    change = state.withColumn("was", F.lag("on", 1, 0).over(w)).where("on <> was")
    return change.withColumn("valid_to", F.lead("at").over(w)).where("on = 1").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """(id_col, url_col, at_col, lists, keys, blocked): the lists, sorted, on which the capture stands at its fetch time, and the keys that put it there."""
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(at_col).alias("_at"))
    spans = written(intervals(entries).withColumnRenamed("key", "_key"), "intervals")
    host, path = F.split(F.split_part("_key", F.lit("/"), F.lit(1)), r"\."), F.split("_key", "/")
    deepest = spans.agg(F.max(F.size(host)), F.max(F.size(path) - 1)).first()
    asked = rows.distinct().withColumn("key", F.explode(keys_of(F.col("_url"), deepest[0] or 0, deepest[1] or 0)))
    holds = (F.col("key") == F.col("_key")) & (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    hits = asked.join(spans, holds).groupBy(*[F.col(c).alias(f"{c}h") for c in ("_id", "_url", "_at")]).agg(F.array_sort(F.collect_set("list")).alias("lists"), F.array_sort(F.collect_set("key")).alias("keys"))
    same = F.col("_id").eqNullSafe(F.col("_idh")) & F.col("_url").eqNullSafe(F.col("_urlh")) & F.col("_at").eqNullSafe(F.col("_ath"))
    none = F.array().cast("array<string>")
    out = rows.join(hits, same, "left").withColumn("blocked", F.col("lists").isNotNull())
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_at").alias(at_col), F.coalesce("lists", none).alias("lists"), F.coalesce("keys", none).alias("keys"), "blocked")


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time (seconds): the table has none, so the query spreads them over the year 2024."""
    return pages.select("page_id", "url", (F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(31_536_000))).alias("fetched_at"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """Entries for the query, by rule, as the test tables hold no lists: of each known host, its registered domain and its first path step.

    By a number from the MD5 of the key, one host in three is added to `spam` and half of these are withdrawn later, one domain in
    five is on `adult`, and one path in seven on `copyright`, withdrawn and added again.
    """
    host = host_of(F.col("url"))
    first = F.regexp_extract(F.lower(F.regexp_extract("url", PATH, 1)), "^/+([^/]+)", 1)
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    kinds = F.array(*[F.struct(F.lit(k).alias("list"), v.alias("key")) for k, v in (("spam", host), ("adult", domain), ("copyright", F.when(first != "", F.concat(host, F.lit("/"), first))))])
    keys = pages.select(F.explode(kinds).alias("k")).select("k.*").where("key <> ''").distinct().withColumn("c", F.conv(F.left(F.md5(F.col("key").cast("binary")), F.lit(7)), 16, 10).cast("long"))
    keys = keys.where("(list = 'spam' AND c % 3 = 0) OR (list = 'adult' AND c % 5 = 0) OR (list = 'copyright' AND c % 7 = 0)")
    start = F.col("c") % 20_000_000 + 1704067200
    dated = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("at"))
    events = F.when(F.col("list") == "copyright", F.array(dated("add", start), dated("remove", start + 4_000_000), dated("add", start + 8_000_000)))
    events = events.when((F.col("list") == "spam") & (F.col("c") % 2 == 0), F.array(dated("add", start), dated("remove", start + 9_000_000)))
    return keys.select("list", "key", F.explode(events.otherwise(F.array(dated("add", start)))).alias("e")).select("list", "key", "e.*")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = judge(dated_captures(pages), written(dated_entries(pages), "entries"))
    return out.select("page_id", "fetched_at", F.array_join("lists", ",").alias("lists"), F.array_join("keys", ",").alias("matched_keys"), "blocked")


ORACLE = r"""
WITH u AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919) % 31536000 AS fetched_at,
    lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)) AS host,
    lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)) AS path
  FROM pages),
p AS (SELECT *, string_split(host, '.') AS labels, [s for s in string_split(path, '/') if s <> ''] AS steps FROM u),
k0 AS (
  SELECT DISTINCT 'spam' AS list, host AS key FROM p WHERE host <> ''
  UNION SELECT DISTINCT 'adult', array_to_string(labels[greatest(len(labels) - 1, 1):], '.') FROM p WHERE host <> ''
  UNION SELECT DISTINCT 'copyright', host || '/' || steps[1] FROM p WHERE len(steps) > 0),
k AS (SELECT * FROM (SELECT list, key, CAST('0x' || left(md5(key), 7) AS BIGINT) AS c FROM k0) x WHERE (list = 'spam' AND c % 3 = 0) OR (list = 'adult' AND c % 5 = 0) OR (list = 'copyright' AND c % 7 = 0)),
i AS (
  SELECT list, key, c % 20000000 + 1704067200 AS a, CASE WHEN list = 'copyright' THEN c % 20000000 + 1708067200 WHEN list = 'spam' AND c % 2 = 0 THEN c % 20000000 + 1713067200 END AS z FROM k
  UNION ALL SELECT list, key, c % 20000000 + 1712067200, NULL FROM k WHERE list = 'copyright'),
q AS (
  SELECT page_id, fetched_at, unnest(list_distinct(list_concat(
    [array_to_string(labels[j:], '.') for j in range(1, greatest(len(labels), 2))],
    [host || '/' || array_to_string(steps[:j], '/') for j in range(1, len(steps) + 1)]))) AS key
  FROM p),
h AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, string_agg(DISTINCT key, ',' ORDER BY key) AS matched_keys
  FROM q JOIN i USING (key) WHERE fetched_at >= a AND (z IS NULL OR fetched_at < z) GROUP BY page_id)
SELECT page_id, fetched_at, coalesce(lists, '') AS lists, coalesce(matched_keys, '') AS matched_keys, lists IS NOT NULL AS blocked
FROM p LEFT JOIN h USING (page_id)
"""
