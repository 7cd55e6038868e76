"""URL filtering by given host and path rules and by association rules mined from labelled pages.

A given rule is a host and a path prefix; it fits the host and its subdomains, and the longest fitting rule decides. Urls
that no rule fits are judged by rules mined from the labelled pages: a page's tokens (host suffixes
and words, path segments, query names) form a basket. Tokens on exactly the same labelled pages are one item, named by the first
of them, and a page has an item if it has any of its tokens. Spark's FP-growth mines the baskets of the bad pages alone for the
sets of items that at least ``MIN_COUNT`` of them share, however many pages are labelled. An inverted index, which files each set under its
rarest item, then counts the labelled pages that hold it, good ones too. Sets that imply "bad" confidently and clearly above
the share of bad pages are rules; one that contains another as confident is dropped. Urls find their rules through the same
kind of index and must hold all of a rule's items.

Without enough labelled pages there are no mined rules, and urls without a given rule are allowed. A null url, or one
without ``://``, has an empty host and path and no tokens. Null ids and labels stay; several labels of one page each count
as a basket. Repeated rows get a row each. Very long urls are read whole; their tokens are as many as their parts. Other
columns, whatever their names, are left out. All steps are DataFrame functions; FP-growth runs in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii, written

MIN_COUNT = 10  # bad labelled pages that hold a rule's items; no share is asked for: it would hide small hosts in large tables
MIN_CONFIDENCE = 0.8
MIN_LIFT = 1.5
BROADCAST_ROWS = 1_000_000  # counted before a broadcast; a rule is a few short strings


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def rule(text: str, verdict: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(host, slash + path, verdict)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: host suffixes, words of its labels, path segments, names of query fields."""
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda k: k <= F.size(labels)),
        lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, -k, k), ".")),
    )
    named = lambda prefix, found: F.transform(F.filter(found, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    segments = F.transform(F.split(lower_ascii(path), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    fields = F.transform(F.split(lower_ascii(query), "[&;]"), lambda x: F.regexp_replace(x, "(?s)=.*", ""))
    every = F.concat(suffixes, named("word=", F.split(host, r"[.\-]")), named("path=", segments), named("field=", fields))
    return F.array_distinct(every)


RULES = "items array<string>, n_items int, support bigint, confidence double, anchor string"
MEMBERS = "token string, item string"


def _held_by(baskets: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of a basket (basket, items) and a set (set, anchor, n_items) whose items it holds, met by the set's anchor."""
    sets = F.broadcast(sets) if sets.count() <= BROADCAST_ROWS else sets
    met = baskets.select("basket", "items", F.explode("items").alias("anchor")).join(sets, "anchor")
    return met.filter(F.size(F.array_intersect("set", "items")) == F.col("n_items"))


def mine(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules that imply a bad page (items, n_items, support in bad pages, confidence, anchor: the rarest item), and the
    tokens that stand for each of their items (token, item)."""
    spark = pages.sparkSession
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    marked = labels.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), bad.alias("bad"))
    labelled = written(
        pages.select(F.col("page_id"), tokens(F.col("url")).alias("tokens")).join(marked, F.col("page_id") == F.col("_id")).select(
            F.uuid().alias("basket"), "bad", "tokens"
        ), "baskets"
    )
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).collect()[0]
    nothing = spark.createDataFrame([], RULES), spark.createDataFrame([], MEMBERS)
    if total["bad"] < MIN_COUNT:
        return nothing
    # A token on too few bad pages is in no rule. Tokens on exactly the same pages (two hashes over them agree) are one item:
    # a set with two of them is as frequent as with one.
    held = labelled.select("basket", "bad", F.explode("tokens").alias("token"))
    same = [F.bit_xor(F.xxhash64("basket")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "basket")).alias("h2")]
    frequent = written(
        held.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.count_if("bad").alias("bad"), *same).filter(F.col("bad") >= MIN_COUNT), "tokens"
    )
    items = written(frequent.groupBy("held", "h1", "h2").agg(F.min("token").alias("item")), "items")
    thin = written(
        held.join(items.select("item"), F.col("token") == F.col("item")).groupBy("basket").agg(
            F.first("bad").alias("bad"), F.collect_list("item").alias("items")
        ), "thin-baskets"
    )
    bad_baskets = thin.filter("bad").select("items")
    n = bad_baskets.count()
    if not n:
        return nothing
    model = FPGrowth(
        itemsCol="items", minSupport=(MIN_COUNT - 0.5) / n, minConfidence=0.0,  # rounded up to MIN_COUNT pages
        numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions")),
    ).fit(bad_baskets)
    found = model.freqItemsets.select(F.array_sort("items").alias("set"), F.col("freq").alias("support"))
    rarest = found.select("set", "support", F.explode("set").alias("item")).join(items.select("item", "held"), "item")
    sets = written(
        rarest.groupBy("set").agg(
            F.max("support").alias("support"), F.min("held").alias("least"), F.min_by("item", F.struct("held", "item")).alias("anchor")
        ).withColumn("n_items", F.size("set")), "item-sets"
    )
    # A set of one item is held by the item's pages; no set is held by more pages than its rarest item.
    share = max(MIN_CONFIDENCE, MIN_LIFT * total["bad"] / total["n"])
    counted = _held_by(thin, sets.filter("n_items > 1").select("set", "anchor", "n_items")).groupBy("set").agg(F.count(F.lit(1)).alias("pages"))
    sure = written(
        sets.join(counted, "set", "left").withColumn("confidence", F.col("support") / F.coalesce("pages", "least")).filter(
            F.col("confidence") >= share
        ).select("set", "support", "confidence", "anchor", "n_items"), "rules"
    )
    # A rule is needless if one of the same or higher confidence needs only some of its items. Going down one
    # item at a time is not enough, since a step between may be less confident, so shorter rules are looked up by their anchors.
    shorter = sure.select(F.col("set").alias("part"), F.col("confidence").alias("part_confidence"), F.col("anchor").alias("item"))
    needless = sure.select("set", "confidence", F.explode("set").alias("item")).join(shorter, "item").filter(
        (F.size("part") < F.size("set")) & (F.col("part_confidence") >= F.col("confidence"))
        & (F.size(F.array_intersect("part", "set")) == F.size("part"))
    ).select("set").distinct()
    rules = written(sure.join(needless, "set", "left_anti").select(F.col("set").alias("items"), "n_items", "support", "confidence", "anchor"), "kept-rules")
    used = rules.select(F.explode("items").alias("item")).distinct()
    named = items.join(used, "item").select("held", "h1", "h2", "item")
    return rules, frequent.join(named, ["held", "h1", "h2"]).select("token", "item")


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, url, host, path, rule, verdict, mined (items of the surest mined rule that fits) of every row."""
    rules_mined, members = mine(pages, labels)
    rules_mined, members = written(rules_mined, "mined-rules"), written(members, "members")
    members = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    urls = pages.select(F.col("url").alias("basket")).filter("basket IS NOT NULL").distinct()
    held = urls.select("basket", F.explode(tokens(F.col("basket"))).alias("token")).join(members, "token")
    baskets = held.groupBy("basket").agg(F.collect_set("item").alias("items"))
    fitting = _held_by(baskets, rules_mined.select(F.col("items").alias("set"), "anchor", "n_items", "confidence"))
    surest = fitting.groupBy("basket").agg(F.max(F.struct("confidence", "set")).alias("best")).select(
        F.col("basket").alias("_url"), F.col("best.set").alias("mined")
    )
    host, path = F.col("host"), F.col("path")
    by_length = sorted(rules, key=lambda r: (-len(r.text), r.text))
    found = F.coalesce(*[F.when(r.fits(host, path), F.lit(r.text)) for r in by_length], F.lit(None).cast("string"))
    verdicts = F.coalesce(*[F.when(F.col("rule") == r.text, F.lit(r.verdict)) for r in by_length], F.lit(None).cast("string"))
    cut = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = cut.withColumn("rule", found).join(surest, F.col("url") == F.col("_url"), "left").drop("_url")
    method = F.when(F.col("mined").isNull(), F.lit("allow")).otherwise(F.lit("block"))
    return judged.withColumn("verdict", F.coalesce(verdicts, method))
