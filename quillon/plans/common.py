"""What the registered queries share: table readers, and pieces of oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.functions.text import ENDINGS, STOPWORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs SQL in which the tables are named in braces."""
    import re

    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def stem_sql(t: str) -> str:
    rules = " ".join(
        f"WHEN {t} LIKE '%{ending}' AND length({t}) >= {len(ending) + 3}{f' AND {t} NOT LIKE {chr(39)}%ss{chr(39)}' if ending == 's' else ''} THEN substr({t}, 1, length({t}) - {len(ending)}) || '{instead}'"
        for ending, instead in ENDINGS
    )
    return f"CASE WHEN length({t}) <= 3 OR regexp_matches({t}, '[0-9]') THEN {t} {rules} ELSE {t} END"


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in sorted(set(STOPWORDS))) + ")"


def tokens_sql(source: str, key: str, text: str, keep: str = "", name: str = "tok") -> str:
    """CTEs that end in name(key, pos, part, term): the stemmed tokens of each row, in order."""
    more = f", {keep}" if keep else ""
    return f"""
{name}_raw AS (SELECT {key}{more}, regexp_extract_all(lower(replace({text}, '’', '''')), '[a-z0-9]+(?:[-.][a-z0-9]+)*') AS ts FROM {source}),
{name}_one AS (SELECT {key}{more}, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM {name}_raw),
{name}_all AS (
  SELECT {key}{more}, pos, 0 AS part, t FROM {name}_one WHERE regexp_matches(t, '[-.]') OR t NOT IN {STOP_SQL}
  UNION ALL SELECT {key}{more}, pos, 1, regexp_replace(t, '[-.]', '', 'g') FROM {name}_one WHERE regexp_matches(t, '[-.]')
  UNION ALL SELECT {key}{more}, pos, 1 + n, p FROM (SELECT {key}{more}, pos, unnest(string_split_regex(t, '[-.]')) AS p, generate_subscripts(string_split_regex(t, '[-.]'), 1) AS n FROM {name}_one WHERE regexp_matches(t, '[-.]')) WHERE p <> '' AND p NOT IN {STOP_SQL}),
{name} AS (SELECT {key}{more}, pos, part, {stem_sql("t")} AS term FROM {name}_all)"""
