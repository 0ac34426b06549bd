"""The crawl frontier as a table: canonical urls, acceptance, priorities, scheduling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that only track visitors, and file endings that are no pages.
TRACKING = "^(utm_|fbclid|gclid|mc_|ref$|ref_src|igshid|_hs)"
ASSETS = r"(?i)\.(png|jpe?g|gif|svg|webp|pdf|zip|gz|mp4|mp3|css|js|ico|woff2?)$"


def canonical(url: Column) -> Column:
    """Lower-case host without default port, single slashes, no fragment or tracking parameters, sorted query; null if not http(s).

    Percent signs stay as they are written."""
    trimmed = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(trimmed, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(trimmed, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), r"(?::80|:443|:)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/{2,}", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING))
    pairs = F.array_sort(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))
    joined = F.array_join(pairs, "&")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, "^[a-z]+://([^/?]*)", 1), ":[0-9]+$", "")


def accepted(url: Column, domains: list[str], exclude: list[str] | None = None, include: list[str] | None = None, seed: Column | None = None) -> Column:
    """Within the domains, of no excluded form, of an included form (seeds need not be), and no asset."""
    h = host(url)
    ok = F.lit(False)
    for d in domains:
        ok |= (h == d) | h.endswith(f".{d}")
    for pattern in exclude or []:
        ok &= ~url.rlike(pattern)
    if include:
        fits = F.lit(False) if seed is None else seed
        for pattern in include:
            fits |= url.rlike(pattern)
        ok &= fits
    return ok & ~url.rlike(ASSETS)


def enqueue(known: DataFrame, found: DataFrame, max_depth: int) -> DataFrame:
    """Rows of found(url, source_id, source_priority, depth, is_seed) that are new, once each, with their priority."""
    fresh = found.where(F.col("url").isNotNull() & (F.col("depth") <= max_depth)).join(known.select("url"), "url", "left_anti")
    priority = F.col("source_priority") + F.when(F.col("is_seed"), 3).otherwise(0) - F.col("depth")
    best = fresh.withColumn("priority", priority).groupBy("url").agg(F.max_by(F.struct("source_id", "priority", "depth", "is_seed"), F.struct("priority", -F.col("depth"), "source_id")).alias("b"))
    return best.select("url", "b.*", F.lit("QUEUED").alias("state"))


def next_batch(urls: DataFrame, limit: int) -> DataFrame:
    return urls.where(F.col("state") == "QUEUED").orderBy(F.desc("priority"), "depth", "discovered_at", "url").limit(limit)


def schedule(urls: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """urls with those queued again whose source is due: never crawled, or longer ago than its frequency."""
    due = sources.where(F.col("active") & (F.col("last_crawled").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_crawled") >= F.col("frequency_s")))).select("source_id", F.lit(True).alias("_due"))
    again = F.col("_due") & F.col("state").isin("CRAWLED", "UNCHANGED", "CHANGED") | (F.col("state") == "FAILED")
    return urls.join(F.broadcast(due), "source_id", "left").withColumn("state", F.when(again, "QUEUED").otherwise(F.col("state"))).drop("_due")
