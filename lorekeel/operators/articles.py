"""Articles: saving without repeats, backfill, coverage, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeel.functions.columns import content_hash, hex_id, micros


def first_by_url(articles: DataFrame, *order: str) -> DataFrame:
    """One row for each url, the first in the given order; rows without url are dropped."""
    rest = [c for c in articles.columns if c != "url"]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("f")
    return articles.where("url is not null").groupBy("url").agg(first).select("url", *[F.col(f"f.{c}") for c in rest])


def content_duplicates(articles: DataFrame) -> DataFrame:
    """(content_hash, copies, first_document_id) of bodies that occur more than once; the hash is made from the body."""
    h = articles.where("body is not null").select(content_hash(F.col("body")).alias("content_hash"), "document_id")
    return h.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("document_id").alias("first_document_id")).where("copies > 1")


def save(batch: DataFrame, held: DataFrame) -> DataFrame:
    """What a batch adds: content not held yet and only once in the batch, then a url not held yet and only once.

    Of equal rows the smallest document_id is taken. Empty bodies are no content, so they repeat freely.
    """
    b = batch.withColumn("_h", F.when(F.trim(F.coalesce("body", F.lit(""))) != "", content_hash(F.col("body"))))
    rest = [c for c in b.columns if c != "document_id"]
    own = F.min(F.struct("document_id", *rest)).alias("f")
    b = b.groupBy(F.coalesce("_h", F.col("document_id")).alias("_k")).agg(own).select("f.*")
    known = held.where("body is not null").select(content_hash(F.col("body")).alias("_held")).distinct()
    b = b.join(known, F.col("_h") == F.col("_held"), "left_anti")
    b = first_by_url(b, "document_id").join(held.select(F.col("url").alias("_url")), F.col("url") == F.col("_url"), "left_anti")
    return b.select(batch.columns)


def page(articles: DataFrame, source: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of articles, the newest batch first."""
    rows = articles if source is None else articles.where(F.col("source") == source)
    return rows.orderBy(F.desc("scraped_at"), "document_id").offset(offset).limit(limit)


def by_document(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles whose id is in a table of ids, in either form of the id."""
    return articles.join(ids.select(hex_id(ids.columns[0]).alias("_id")).distinct(), hex_id("document_id") == F.col("_id"), "left_semi")


def backfill(articles: DataFrame, day_from: str, day_to: str) -> DataFrame:
    """Articles published on the days of a closed range, each url on its first day only."""
    a, b = F.lit(day_from).cast("date"), F.lit(day_to).cast("date")
    rows = articles.withColumn("day", F.to_date("published")).where((F.col("day") >= a) & (F.col("day") <= b))
    return first_by_url(rows.select("url", "day", "document_id", "source"), "day", "document_id")


def enriched(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """Full texts (url, text) in place of summaries, where they are not empty."""
    t = texts.select(F.col("url").alias("_url"), F.nullif("text", F.lit("")).alias("_text"))
    return articles.join(t, F.col("url") == F.col("_url"), "left").withColumn("body", F.coalesce("_text", "body")).drop("_url", "_text")


def unprocessed(articles: DataFrame, provenance: DataFrame) -> DataFrame:
    """Articles of which no mention is recorded, in either form of the id."""
    done = provenance.select(hex_id("document_id").alias("_d")).distinct()
    return articles.join(done, hex_id("document_id") == F.col("_d"), "left_anti")


# ---------------------------------------------------------------- health
def by_source(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source").agg(F.count(F.lit(1)).alias("articles"))


def last_seen(articles: DataFrame, now: Column) -> DataFrame:
    """(source, last_us, hours_ago)."""
    last = articles.groupBy("source").agg(F.max(micros("scraped_at")).alias("last_us"))
    return last.withColumn("hours_ago", F.round((micros(now) - F.col("last_us")) / 3.6e9, 2))


def recent_batches(articles: DataFrame, n: int = 5) -> DataFrame:
    """(batch_us, articles, sources) of the newest batches; sources in order, joined by commas."""
    top = articles.groupBy("scraped_at").agg(F.count(F.lit(1)).alias("articles"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return top.orderBy(F.desc("scraped_at")).limit(n).select(micros("scraped_at").alias("batch_us"), "articles", "sources")


def quality(articles: DataFrame, short: int = 50) -> DataFrame:
    """One row of counts, made in one pass; document ids are compared in a second aggregate."""
    one = lambda c: F.count(F.when(c, 1))
    main = articles.agg(
        F.count(F.lit(1)).alias("articles"),
        one(F.trim(F.coalesce("body", F.lit(""))) == "").alias("empty_body"),
        one(F.trim(F.coalesce("title", F.lit(""))) == "").alias("empty_title"),
        one(F.col("published").isNull()).alias("missing_published"),
        one(F.length(F.coalesce("body", F.lit(""))) < short).alias("short_body"),
    )
    twice = articles.groupBy("document_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_ids"))
    urls = articles.groupBy("url").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_urls"))
    return main.crossJoin(twice).crossJoin(urls)


def daily_coverage(articles: DataFrame, today: str, days: int = 8) -> DataFrame:
    """(day, articles, gap) of the last ``days`` dates up to today, days without articles included; today is no gap."""
    spark = articles.sparkSession
    span = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date"))).alias("d"))
    n = articles.groupBy(F.to_date("scraped_at").alias("_d")).agg(F.count(F.lit(1)).alias("articles"))
    rows = span.join(n, F.col("d") == F.col("_d"), "left").withColumn("articles", F.coalesce("articles", F.lit(0)))
    return rows.select(F.col("d").cast("string").alias("day"), "articles", ((F.col("articles") == 0) & (F.col("d") < F.lit(today).cast("date"))).alias("gap"))
