"""Table maintenance over snapshots: upserts, retirement, validity intervals, change detection. Snapshot in, snapshot out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sticky: list[str] | None = None) -> DataFrame:
    """old with the rows of new put in by key, and is_new. Sticky columns of a row that was there are never overwritten."""
    sticky = sticky or []
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    columns = []
    for c in old.columns:
        kept, put = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in keys:
            columns.append(F.coalesce(kept, put).alias(c))
        elif c in sticky:
            columns.append(F.when(F.col("_old"), kept).otherwise(put).alias(c))
        else:
            columns.append(F.when(F.col("_new"), put).otherwise(kept).alias(c))
    return joined.select(*columns, F.col("_old").isNull().alias("is_new"))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def retire(facts: DataFrame, observed: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """facts with active and valid_until set for those that were not observed again; rows are kept."""
    seen = observed.select(*keys).distinct().withColumn("_seen", F.lit(True))
    gone = F.col("_seen").isNull() & F.col("active")
    return facts.join(seen, keys, "left").withColumns({"valid_until": F.when(gone, now).otherwise(F.col("valid_until")), "active": F.col("active") & ~gone}).drop("_seen")


def put_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the facts of new: what states a fact is refreshed, when it was first told is kept, and what was retired is active again. Columns: fact, chunk, sentence, confidence, last_version; valid_from, observed_at, first_version; active, valid_until."""
    seen = new.withColumns({"active": F.lit(True), "valid_until": F.lit(None).cast(dict(old.dtypes)["valid_until"])})
    return upsert(old, seen, ["fact"], sticky=["valid_from", "observed_at", "first_version"])


def tombstone(documents: DataFrame, chunks: DataFrame, facts: DataFrame, gone: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after the pages of gone(url) were not found: documents(document, url, status, last_seen) have a status of gone, their chunks and facts end now. What ended before stays as it was."""
    hit = gone.select("url").distinct().withColumn("_gone", F.lit(True))
    marked = documents.join(hit, "url", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)) & (F.col("status") != "gone"))
    dead = marked.where("_gone").select("document").distinct().withColumn("_dead", F.lit(True))

    def ended(rows: DataFrame) -> DataFrame:
        ends = F.coalesce("_dead", F.lit(False)) & F.col("active")
        return rows.join(dead, "document", "left").withColumns({"valid_until": F.when(ends, now).otherwise(F.col("valid_until")), "active": F.col("active") & ~ends}).drop("_dead")

    after = marked.withColumns({"status": F.when(F.col("_gone"), "gone").otherwise(F.col("status")), "last_seen": F.when(F.col("_gone"), now).otherwise(F.col("last_seen"))}).drop("_gone")
    return after, ended(chunks), ended(facts)


def replace_rows(old: DataFrame, keys: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the rows of keys(key), and with new ones instead; a key without new rows ends up with none."""
    return old.join(keys.select(key).distinct(), key, "left_anti").unionByName(new.distinct())


def updated(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """old with the fields that changes has put in by key; rows that are not there are not added."""
    fields = [c for c in changes.columns if c not in keys]
    put = changes.select(*keys, *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_put"))
    return old.join(put, keys, "left").select(*(F.when(F.col("_put"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns))


def versions(events: DataFrame, entity: str, at: str, *tie: str) -> DataFrame:
    """version numbers and validity: each version ends when the next begins."""
    w = Window.partitionBy(entity).orderBy(at, *tie)
    return events.withColumns({"version": F.row_number().over(w), "valid_from": F.col(at), "valid_until": F.lead(at).over(w)})


def as_of(history: DataFrame, moment: Column) -> DataFrame:
    return history.where((F.col("valid_from") <= moment) & (F.col("valid_until").isNull() | (moment < F.col("valid_until"))))


def change_type(seen: Column, same_bytes: Column, same_content: Column, gone: Column) -> Column:
    """The ladder of change detection: the cheapest test that settles it names the change."""
    return F.when(gone, "gone").when(~seen, "new").when(same_bytes, "unchanged_bytes").when(same_content, "unchanged_content").otherwise("changed")


def section_diff(before: DataFrame, after: DataFrame, keys: list[str], content: str) -> DataFrame:
    """keys and change: added, removed or modified."""
    a = before.select(*keys, F.col(content).alias("_a"), F.lit(1).alias("_was"))
    b = after.select(*keys, F.col(content).alias("_b"), F.lit(1).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def nearest_rank(values: Column, q: float) -> Column:
    """The value at index floor(n q) of the sorted values: no interpolation."""
    ordered = F.sort_array(F.collect_list(values))
    return F.element_at(ordered, F.least(F.size(ordered), F.floor(F.size(ordered) * F.lit(q)).cast("int") + 1))
