"""Robots rules as a table, and a page source with an injected fetcher."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.frontier import host


def policy(status: Column) -> Column:
    """A readable file is obeyed, a missing one allows all, an unreachable one nothing."""
    return F.when(status == 200, "rules").when(status.between(400, 499), "allow").otherwise("deny")


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "quillon") -> DataFrame:
    """urls with allowed, from robots(host, status, body): one row a host, joined by host."""

    @F.pandas_udf("boolean")
    def obey(url: pd.Series, how: pd.Series, body: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        parsers: dict[str, RobotFileParser] = {}

        def ask(u, h, b):
            if h != "rules":
                return h == "allow"
            if b not in parsers:
                parsers[b] = RobotFileParser()
                parsers[b].parse(b.splitlines())
            return parsers[b].can_fetch(agent, u)

        return pd.Series([ask(*row) for row in zip(url, how, body.fillna(""), strict=True)])

    rules = robots.select(F.col("host").alias("_host"), policy(F.coalesce("status", F.lit(0))).alias("_how"), F.col("body").alias("_body"))
    joined = urls.join(rules, host(F.col("url")) == F.col("_host"), "left")
    return joined.withColumn("allowed", obey("url", F.coalesce("_how", F.lit("deny")), "_body")).drop("_host", "_how", "_body")


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, str | None]]) -> DataFrame:
    """url, status, html by a fetcher that is called once a url, partition by partition; what it raises becomes status 0."""

    def run(frames):
        for rows in frames:
            out = []
            for url in rows["url"]:
                try:
                    out.append((url, *fetch(url)))
                except OSError:
                    out.append((url, 0, None))
            yield pd.DataFrame(out, columns=["url", "status", "html"])

    return urls.select("url").mapInPandas(run, "url string, status int, html string")
