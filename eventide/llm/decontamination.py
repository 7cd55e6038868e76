"""Benchmark decontamination with DataFrame operations only: find benchmark windows inside documents.

Texts are cut into words after lower-casing A-Z. A benchmark item gives its windows of ``window`` neighbouring words; an
item with fewer words, but not none, is one window. All windows are hashed into a set that is broadcast as long as it
stays below ``BROADCAST_ROWS`` distinct hashes, and joined by shuffle beyond that.

A document is not hashed at every word. A window of k words covers a whole short gram (g words) that begins at a
multiple of k - g + 1, so only grams at these places are looked up first, in the set of all grams inside windows. Documents
with one go on to the hashes of all their windows, and every hit is verified word by word. The lookups move hashes
with the row's key (document id and content hash), never texts.

Nulls: a null text has no words; null items and ids stay null and hit nothing. Repeated rows get a row each, items with
equal texts all count. Without items nothing is contaminated. Very long texts are read whole; a row's words are in memory at once.
Other columns, whatever their names, are left out, and kept by ``without_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_names, lower_ascii, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 4
BROADCAST_ROWS = 1_000_000  # counted before a broadcast; rows of a few hundred bytes at most


def words(text: Column) -> Column:
    """Words of a text; null gives none."""
    found = F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(found, lambda w: w != "")


def _key(text: Column) -> Column:
    """Tells rows with the same document id apart; rows with equal texts share a result anyway."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: hash, k (words in it), words (joined by blanks) and the ids of items that hold it."""
    cut = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("w") - k)
    spread = cut.select("item_id", "w", k.alias("k"), F.explode(starts).alias("i"))
    joined = spread.select("item_id", "k", F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.col("k"))).alias("words"))
    return joined.groupBy("words", "k").agg(F.collect_set("item_id").alias("items")).withColumn("h", F.xxhash64("words"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a written set that has been counted to be small; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per document: doc_id, key (content hash), n_words, n_hit, n_items, item_ids, contaminated and hit_spans.

    ``contaminated``: words are hit and ``share`` times the hit words are at least all words. ``hit_spans`` are the merged
    runs of hit words as (start, end), words counted from 0.
    """
    windows = written(benchmark_windows(items, window), "windows")
    lengths = [r["k"] for r in windows.select("k").distinct().orderBy("k").collect()]  # at most ``window`` numbers
    if not lengths:
        lengths = [window]
    grams = {k: min(GRAM, (k + 1) // 2) for k in lengths}

    def hashed(column: str, starts: Column, k: int) -> Column:
        return F.transform(
            starts, lambda i: F.struct(F.lit(k).alias("k"), F.xxhash64(F.concat_ws(" ", F.slice(column, i + 1, grams[k]))).alias("g"))
        )

    inside = F.coalesce(*[
        F.when(F.col("k") == k, hashed("w", F.sequence(F.lit(0), F.lit(k - grams[k])), k)) for k in lengths
    ])
    known_grams = written(
        windows.select("k", F.split("words", " ").alias("w")).select(F.explode(inside).alias("c")).select("c.*").distinct(), "grams"
    )
    none = F.expr("cast(array() as array<struct<k:int,g:bigint>>)")
    places = F.concat(*[
        F.when(
            F.size("w") >= k, hashed("w", F.sequence(F.lit(0), F.size("w") - grams[k], F.lit(k - grams[k] + 1)), k)
        ).otherwise(none) for k in lengths
    ])
    rows = docs.select(F.col("doc_id"), _key(F.col("text")).alias("key"), words(F.col("text")).alias("w"))
    read = written(
        rows.select("doc_id", "key", F.size("w").cast("bigint").alias("n_words"), places.alias("places")), "grams-of-documents"
    )
    counted = read.select("doc_id", "key", "n_words")
    asked = read.select("doc_id", "key", F.explode("places").alias("c")).select("doc_id", "key", "c.*")
    likely = asked.join(_small(known_grams), ["k", "g"], "left_semi").select("doc_id", "key", "k")
    candidates = written(likely.groupBy("doc_id", "key").agg(F.collect_set("k").alias("ks")), "candidates")
    wanted = _small(candidates.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "ks"))
    texts = docs.select("doc_id", "text", _key(F.col("text")).alias("key")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))
    ).select("doc_id", "key", "ks", words(F.col("text")).alias("w"))
    all_windows = F.flatten(F.transform("ks", lambda k: F.transform(
        F.sequence(F.lit(0), F.size("w") - k),
        lambda i: F.struct(i.alias("i"), k.alias("k"), F.concat_ws(" ", F.slice("w", i + 1, k)).alias("words")),
    )))
    every = texts.select("doc_id", "key", F.explode(all_windows).alias("c")).select("doc_id", "key", "c.*")
    known = _small(windows.select("h", F.col("words").alias("_words"), "items"))
    hits = every.withColumn("h", F.xxhash64("words")).join(known, "h").filter(F.col("words") == F.col("_words"))
    per_row = hits.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct(F.col("i").alias("start"), (F.col("i") + F.col("k")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("items", lambda x: x.cast("string")))))).alias("item_ids"),
    )
    merged = F.expr(
        "aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (done, s) -> "
        "CASE WHEN size(done) > 0 AND element_at(done, -1).end >= s.start THEN concat(slice(done, 1, size(done) - 1), "
        "array(struct(element_at(done, -1).start AS start, greatest(element_at(done, -1).end, s.end) AS end))) "
        "ELSE concat(done, array(struct(s.start AS start, s.end AS end))) END)"
    )
    per_row = per_row.select(
        F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "item_ids", merged.alias("hit_spans")
    )
    joined = counted.join(per_row, counted["doc_id"].eqNullSafe(F.col("_d")) & (counted["key"] == F.col("_k")), "left")
    n_hit = F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.start)")
    result = joined.select(
        "doc_id", "key", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("hit_spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("hit_spans"),
    )
    return result.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without contaminated documents; columns stay, whatever their names."""
    judged = contamination(docs, items, window, share)
    key, bad_id, bad_key = free_names(docs, "_key", "_d", "_k")
    bad = _small(
        written(judged.filter("contaminated").select(F.col("doc_id").alias(bad_id), F.col("key").alias(bad_key)).distinct(), "contaminated")
    )
    keyed = docs.withColumn(key, _key(F.col("text")))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(key) == F.col(bad_key)), "left_anti").drop(key)
