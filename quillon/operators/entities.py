"""Names to entities: the ontology's seed, and a join of names that are nearly alike.

Two keys are alike by the ratio of difflib: twice the characters of their matching blocks to those of both."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T


def seed(ontology: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities(entity, name, type) and aliases(key, entity, alias, type) from ontology(name, type, aliases). A key goes to its smallest entity."""
    named = ontology.withColumn("entity", T.slug(F.col("name")))
    entities = named.groupBy("entity").agg(F.min(F.struct("name", "type")).alias("x")).select("entity", "x.name", "x.type")
    rows = named.select("entity", "type", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    keyed = rows.withColumn("key", T.alias_key(F.col("alias"))).where("key != ''")
    return entities, keyed.groupBy("key").agg(F.min(F.struct("entity", "alias", "type")).alias("x")).select("key", "x.*")


def learn(aliases: DataFrame, learned: DataFrame) -> DataFrame:
    """aliases with those learned(alias, entity, type) whose keys are free."""
    keyed = learned.withColumn("key", T.alias_key(F.col("alias"))).where("key != ''")
    new = keyed.groupBy("key").agg(F.min(F.struct("entity", "alias", "type")).alias("x")).select("key", "x.*")
    return aliases.unionByName(new.join(aliases, "key", "left_anti"))


def ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right, strict=True)], dtype=float)

    return run(a, b)


def alike(names: DataFrame, keys: DataFrame, least: float = 0.93) -> DataFrame:
    """name, key and ratio of all pairs of names(name) and keys(key) that are at least so alike.

    Of two such strings at most D = (1 - least)(|name| + |key|) characters have no partner. Each spoils one piece of the key at most, so that of D + 1
    pieces one is in the name as it is, moved by D places at most. Keys are joined with names by such pieces; what meets is measured exactly.
    Pairs that really are alike are as many as they are: numbered names of one form all meet each other."""
    slack, low = F.lit(1.0 - least), least / (2.0 - least)
    longest = lambda n: F.floor(n / F.lit(low) + 1e-9).cast("int")
    spare = lambda n: F.floor(slack * (n + longest(n)) + 1e-9).cast("int")
    begin = lambda n, i: F.floor(i * n / (spare(n) + 1)).cast("int")
    stop = lambda n, i: F.floor((i + 1) * n / (spare(n) + 1)).cast("int")
    size = F.length("key")
    pieces = keys.select("key").where(size > 0).distinct().select("key", size.alias("n"), F.explode(F.sequence(F.lit(0), spare(size))).alias("i"))
    pieces = pieces.select("key", "n", "i", F.substring("key", begin(F.col("n"), F.col("i")) + 1, stop(F.col("n"), F.col("i")) - begin(F.col("n"), F.col("i"))).alias("piece"))
    own = F.length("name")
    asked = names.select("name").where(own > 0).distinct().select("name", F.explode(F.sequence(F.ceil(own * F.lit(low) - 1e-9).cast("int"), longest(own))).alias("n"))
    asked = asked.where("n > 0").select("name", "n", F.explode(F.sequence(F.lit(0), spare(F.col("n")))).alias("i"))
    n, i = F.col("n"), F.col("i")
    asked = asked.withColumns({"at": begin(n, i), "width": stop(n, i) - begin(n, i)})
    last = F.least(F.col("at") + spare(n), own - F.col("width"))
    asked = asked.withColumn("first", F.greatest(F.lit(0), F.col("at") - spare(n))).where(F.col("first") <= last)
    asked = asked.select("name", "n", "i", "width", F.explode(F.sequence(F.col("first"), last)).alias("p")).select("name", "n", "i", F.substring("name", F.col("p") + 1, F.col("width")).alias("piece"))
    pairs = asked.distinct().join(pieces, ["n", "i", "piece"]).select("name", "key").distinct()
    return pairs.withColumn("ratio", ratio(F.col("name"), F.col("key"))).where(F.col("ratio") >= least)


def resolve(names: DataFrame, aliases: DataFrame, least: float = 0.93) -> DataFrame:
    """name, type, entity and how (exact, alike) for each distinct names(name, type) against aliases(key, entity, type).

    An exact key counts whatever its type. Else keys of five characters or more take the most alike key of their type (any, if the name has none), the larger
    of equals; it counts if its numbers are the same. entity is null where nothing fits."""
    asked = names.select("name", "type").distinct().withColumn("_key", T.alias_key(F.col("name")))
    known = aliases.groupBy("key", "type").agg(F.min("entity").alias("entity"))
    exact = aliases.groupBy(F.col("key").alias("_key")).agg(F.min("entity").alias("exact"))
    told = asked.join(exact, "_key", "left")
    open_ = told.where(F.col("exact").isNull() & (F.length("_key") >= 5))
    near = alike(open_.select(F.col("_key").alias("name")), aliases, least).withColumnRenamed("name", "_key")
    rated = open_.select("name", F.col("type").alias("_type"), "_key").join(near, "_key").join(known, "key").where(F.col("_type").isNull() | (F.col("_type") == F.col("type")))
    best = rated.groupBy("name", "_type").agg(F.max(F.struct("ratio", "key", (F.col("entity")).alias("entity"))).alias("b"), F.first("_key").alias("_key"))
    digits = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    fits = best.where(digits(F.col("b.key")) == digits(F.col("_key"))).select(F.col("name").alias("_name"), "_type", F.col("b.entity").alias("near"))
    both = told.join(fits, (F.col("name") == F.col("_name")) & F.col("type").eqNullSafe(F.col("_type")), "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "alike")
    return both.select("name", "type", F.coalesce("exact", "near").alias("entity"), how.alias("how"))
