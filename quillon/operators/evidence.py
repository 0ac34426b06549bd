"""From ranked candidates to evidence: scope filters, coverage of sub-questions, facts of what was chosen, refinement, cached answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.retrieval import dot

#: The rerank score from which a candidate counts as strong.
STRONG = 0.30


def scope(kinds: list[str] | None = None, source_types: list[str] | None = None, documents: list | None = None, entities: list | None = None, since: str | None = None, until: str | None = None) -> Column:
    """A predicate on chunks(kind, source_type, document, entities, published). Without kinds, page chunks only; under a date limit a chunk without a date fails."""
    tests = [F.col("kind").isin(*(kinds or ["chunk"]))]
    if source_types:
        tests.append(F.col("source_type").isin(*source_types))
    if documents:
        tests.append(F.col("document").isin(*documents))
    if entities:
        tests.append(F.arrays_overlap("entities", F.array(*map(F.lit, entities))))
    if since:
        tests.append(F.col("published") >= F.lit(since))
    if until:
        tests.append(F.col("published") <= F.lit(until))
    return reduce(lambda a, b: a & b, (F.coalesce(t, F.lit(False)) for t in tests))


def relaxed(kinds: list[str] | None = None, **dropped) -> Column:
    """The scope without its constraints on content: only kinds stay."""
    return scope(kinds)


def unreranked(fused: Column, weights: Column, k: int = 60) -> Column:
    """A fused score in proportion to the best there can be, for runs without a reranker."""
    ceiling = weights / (k + 1)
    return F.least(F.lit(1.0), fused / F.when(ceiling == 0, 1.0).otherwise(ceiling))


def strength(candidates: DataFrame, *by: str) -> DataFrame:
    """by, n, strong and best: how well the candidates (rerank) of each sub-question hold."""
    return candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rerank") >= STRONG).alias("strong"), F.max("rerank").alias("best"))


def coverage_first(candidates: DataFrame, per_document: int = 2) -> DataFrame:
    """query and the chunks picked so that no sub-question goes without: candidates(query, step, chunk, document, final).

    Steps go in order. A step one of whose first three is picked already is covered; another takes its best that its document has room for.
    Queries of one step pick nothing here. A query's candidates are bounded by the ranking before."""
    lists = candidates.groupBy("query", "step").agg(F.sort_array(F.collect_list(F.struct((-F.col("final")).alias("order"), "chunk", "document"))).alias("list"))
    steps = lists.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("step", "list"))).alias("steps"))
    kinds = dict(candidates.dtypes)
    nothing = F.array().cast(f"array<struct<chunk:{kinds['chunk']},document:{kinds['document']}>>")

    def pick(taken: Column, step: Column) -> Column:
        has = lambda x: F.exists(taken, lambda t: t["chunk"] == x["chunk"])
        room = lambda x: F.size(F.filter(taken, lambda t: t["document"] == x["document"])) < per_document
        fits = F.slice(F.filter(step["list"], lambda x: ~has(x) & room(x)), 1, 1)
        return F.when(F.exists(F.slice(step["list"], 1, 3), has), taken).otherwise(F.concat(taken, F.transform(fits, lambda x: F.struct(x["chunk"].alias("chunk"), x["document"].alias("document")))))

    picked = F.when(F.size("steps") > 1, F.aggregate("steps", nothing, pick)).otherwise(nothing)
    return steps.select("query", F.transform(picked, lambda t: t["chunk"]).alias("chunks"))


def strongest_facts(facts: DataFrame, most: int = 40) -> DataFrame:
    """The heaviest facts(query, fact, weight) of each query; ties go to the smaller fact."""
    w = Window.partitionBy("query").orderBy(F.desc("weight"), "fact")
    return facts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def facts_of_evidence(facts: DataFrame, evidence: DataFrame, most: int = 8) -> DataFrame:
    """query, fact, name and place: the first facts(query, fact, chunk, position) that chosen evidence(query, chunk, name) states."""
    held = facts.join(evidence.select("query", "chunk", "name"), ["query", "chunk"])
    w = Window.partitionBy("query").orderBy("position", "fact")
    return held.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query", "fact", "name", "place")


def handles(seen: DataFrame) -> DataFrame:
    """query, chunk, handle, score, methods: stable names E1, E2, ... by first sight, from seen(query, at, chunk, score, method)."""
    each = seen.groupBy("query", "chunk").agg(F.min("at").alias("first"), F.max("score").alias("score"), F.sort_array(F.collect_set("method")).alias("methods"))
    number = F.row_number().over(Window.partitionBy("query").orderBy("first", "chunk"))
    return each.select("query", "chunk", F.concat(F.lit("E"), number).alias("handle"), "score", "methods")


def refine(text: Column, wanted: Column, names: Column) -> Column:
    """The sentences of a long passage that bear on the question: the first, those with a wanted stem or a name, those with a year. Null where there is nothing to strip.

    wanted: stems of the question whose idf is over 0.8; names: its entities, in small letters."""

    def kept(s: Column, w: Column) -> Column:
        # A token holds its stem but for the last letter, so that only sentences where that occurs are taken apart.
        low = lambda x: F.concat(F.lower(x), F.lit(" "), F.regexp_replace(F.lower(x), "[-.]", ""))
        may = lambda x: T.let(low(x), lambda t: F.exists(w, lambda y: F.contains(t, F.substring(y, F.lit(1), F.length(y) - 1))))
        asks = lambda x: may(x) & F.arrays_overlap(T.tokens(x), w)
        bears = lambda x, i: (i == 0) | x.rlike(r"\b(19|20)[0-9]{2}\b") | F.exists(names, lambda n: F.contains(F.lower(x), n)) | asks(x)
        long = (F.size(s) >= 4) & (T.count_tokens(text) >= 100)
        stripped = lambda held: F.when((F.size(held) > 0) & (F.size(held) < F.size(s)), F.array_join(held, " "))
        return F.when(long, T.let(F.filter(s, lambda x, i: F.coalesce(bears(x, i), F.lit(False))), stripped))

    return T.let(wanted, lambda w: T.let(T.sentences(text), lambda s: kept(s, w)))


def cached(questions: DataFrame, entries: DataFrame, version: int, now: Column, ttl_s: int = 3600, least: float = 0.96, size: int = 64) -> DataFrame:
    """query, entry and score: the stored answer nearest in meaning, from questions(query, q, tag) and entries(entry, v, tag, version, at).

    Only the latest `size` entries are in the cache, so that what is broadcast is bounded by it; of those, entries of the same tag and index version that are not too old count. Ties go to the older entry."""
    latest = entries.orderBy(F.desc("at"), F.desc("entry")).limit(size)
    fresh = latest.where((F.col("version") == version) & (F.unix_timestamp(now) - F.unix_timestamp("at") <= ttl_s)).select("entry", "v", "tag")
    rated = questions.join(F.broadcast(fresh), "tag").select("query", "entry", F.round(dot(F.col("q"), F.col("v")), 6).alias("score")).where(F.col("score") >= least)
    return rated.groupBy("query").agg(F.max(F.struct("score", (-F.col("entry")).alias("entry"))).alias("best")).select("query", (-F.col("best.entry")).alias("entry"), F.col("best.score").alias("score"))


def json_of(text: Column) -> Column:
    """What of a model's reply is JSON: without thoughts and fences, whole, or from the first brace to the last, or bracket to bracket. Null where nothing parses."""
    bare = F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    bare = F.trim(F.regexp_replace(bare, r"^```(?:json)?\s*|\s*```$", ""))
    whole = lambda t: F.when(t.rlike(r"(?s)^[\[{].*[\]}]$") & F.try_parse_json(t).isNotNull(), t)
    return T.let(bare, lambda t: F.coalesce(whole(t), whole(F.regexp_extract(t, r"(?s)\{.*\}", 0)), whole(F.regexp_extract(t, r"(?s)\[.*\]", 0))))


def squashed(raw: Column, base: Column) -> Column:
    """A neural reranker's raw score on the scale of the feature score, mixed with it."""
    return 0.7 / (1 + F.exp(-raw)) + 0.3 * base


def paced(fetches: DataFrame, delay_s: float) -> DataFrame:
    """fetches(host, asked, crawl_delay) with start: no host sooner than its delay after its last start. Times are seconds.

    start(i) = max over j <= i of asked(j) + (i - j) * delay, a running maximum once i * delay is taken off."""
    wait = F.greatest(F.lit(float(delay_s)), F.coalesce(F.col("crawl_delay"), F.lit(0.0)))
    w = Window.partitionBy("host").orderBy("asked", "url")
    before = fetches.withColumns({"_n": F.row_number().over(w), "_wait": F.max(wait).over(Window.partitionBy("host"))})
    ahead = F.max(F.col("asked") - F.col("_n") * F.col("_wait")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return before.withColumn("start", ahead + F.col("_n") * F.col("_wait")).drop("_n", "_wait")
