"""What an answer asserts, and what its evidence says of it. Columns throughout, but for compatibility forms and dates.

An answer becomes rows of claims; evidence becomes windows of two sentences, each with its title and source. A claim is read
twice, against all evidence and against what it cites. A reading is the window that covers the largest share of the claim's
senses, or all its evidence together, which counts 0.9; what numbers, dates and names the reading lacks decides with the coverage.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.concepts import CONCEPTS
from quillon.functions.dates import MONTHS
from quillon.operators import language
from quillon.operators.answering import claim_verdict

# How citations are written, characters of one meaning, words before a number's unit, and words in capitals or titles that are no names.
CITATION, CITED_LIST = r"\[E([0-9]+)\]", r"[\[【(（]\s*(?:E\s?[0-9]+\s*[,;、]?\s*)+[\]】)）]"
SIGNS = {"\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00d7": "x", "\u2014": " - ", "\u00a0": " ", "\u202f": " ", "\u2009": " "}
UNIT = r"(?<=[0-9])\s+(?=[BKMT]\b)"
NO_NAMES = ["and", "the", "sept", *MONTHS, *(m[:3] for m in MONTHS)]
# What opens a remark on the evidence, and marks at the head of a line.
REMARK = r"(?i)^(?:the (?:knowledge base|evidence)|i could not|no direct evidence|insufficient)"
HEAD, DATED, RULE = r"^[\s>*\-•0-9.)#]+", r"^\([0-9]{4}(?:-[0-9]{2}){0,2}\)\s*", r"^[|\s:\-]+$"
#: What all evidence together counts, against one window.
TOGETHER = 0.9
READING = "name string, text string, title string, source string"


def uniform(text: Column) -> Column:
    """Compatibility forms, with one sign for each meaning; 7 B becomes 7B."""

    @F.pandas_udf("string")
    def compatible(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    signs = compatible(text)
    for sign, instead in SIGNS.items():
        signs = F.replace(signs, F.lit(sign), F.lit(instead))
    return F.regexp_replace(signs, UNIT, "")


def citations(text: Column) -> Column:
    """Citations in any brackets, alone or in lists, as [E1][E2]."""
    numbers = lambda group: F.regexp_extract_all(group, F.lit("[0-9]+"), F.lit(0))
    each = F.transform(F.regexp_extract_all(text, F.lit(CITED_LIST), F.lit(0)), lambda g: F.array_join(F.transform(numbers(g), lambda n: F.concat(F.lit("[E"), n, F.lit("]"))), ""))
    gaps = F.split(text, CITED_LIST, -1)
    return F.array_join(F.zip_with(gaps, each, lambda gap, cited: F.concat(gap, F.coalesce(cited, F.lit("")))), "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def cells(row: Column) -> Column:
    """A table's row as one line; a citation in a cell of its own follows what it is for."""
    own = F.filter(F.transform(F.split(row, r"\|"), trimmed), lambda c: c != "")
    cited = (F.size(own) > 1) & F.element_at(own, -1).rlike(f"^{CITATION}$")
    joined = F.when(cited, F.concat(F.array_join(F.slice(own, 1, F.size(own) - 1), " - "), F.lit(" "), F.element_at(own, -1)))
    return F.when(F.size(own) == 0, "").otherwise(F.coalesce(joined, F.array_join(own, " - ")))


def lines(answer: Column) -> Column:
    """The lines of a uniform answer that may assert something, without their marks. A table's heads and rules, headings, lead-ins and remarks on the evidence are none."""

    def each(every: Column) -> Column:
        own = F.transform(every, trimmed)
        follows = lambda i: F.coalesce(F.get(own, i + 1), F.lit(""))
        table = lambda x: x.startswith("|")
        head = lambda x, i: table(x) & (x.rlike(RULE) | follows(i).rlike(RULE))
        heading = lambda x: x.startswith("**") & x.endswith("**")
        bare = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.when(table(x), cells(x)).otherwise(x), r"\*\*|__", ""), HEAD, "")), DATED, "")
        told = F.transform(own, lambda x, i: F.when(~head(x, i) & ~heading(x), bare(x)))
        lead = lambda x: x.endswith(":") & (F.size(F.split(x, r"\s+")) < 8)
        return F.filter(told, lambda x: x.isNotNull() & (x != "") & ~lead(x) & ~x.rlike(REMARK))

    return T.let(F.split(answer, "\n"), each)


def claims(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """A row for each claim: the columns of answers with number (from 1), claim and cited (names of evidence). Sentences of under four tokens claim nothing."""
    said = answers.withColumn("_said", citations(uniform(F.col(answer))))
    found = F.filter(F.transform(F.flatten(F.transform(lines(F.col("_said")), T.sentences)), trimmed), lambda s: F.size(T.tokens(F.regexp_replace(s, CITATION, ""))) >= 4)
    rows = said.select(*answers.columns, F.posexplode(found).alias("_at", "claim"))
    cited = F.transform(F.regexp_extract_all("claim", F.lit(CITATION), F.lit(1)), lambda n: F.concat(F.lit("E"), n))
    return rows.withColumns({"number": F.col("_at") + 1, "cited": cited}).drop("_at")


def senses(text: Column, concepts: dict[str, list[str]] = CONCEPTS) -> Column:
    """Stems without stop words, and the concepts that the text's phrases stand for."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*T.STOPWORDS))
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    named = lambda name, phrases: F.when(F.lit(False) if not phrases else sum_or([F.contains(padded, F.lit(f" {p} ")) for p in phrases]), F.lit(f"__c_{name}"))
    return F.array_distinct(F.concat(F.transform(words, T.stem), F.array_compact(F.array(*(named(c, p) for c, p in concepts.items())))))


def sum_or(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def numbers(claim: Column) -> Column:
    """What a claim states in digits, but for single ones."""
    return F.filter(F.regexp_extract_all(F.replace(claim, F.lit(","), F.lit("")), F.lit(r"\b[0-9][0-9.,]*[a-zA-Z%]*\b"), F.lit(0)), lambda n: F.length(n) > 1)


def names(claim: Column) -> Column:
    """Words in capitals, and capitalised ones that do not open the claim, a clause or an entry."""
    opened = F.regexp_replace(claim, r"(^|[:\-]\s+)[A-Z][a-z]+(?=\s+[a-z])", "$1x")
    words = F.regexp_extract_all(opened, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-.]*"), F.lit(0))
    shouted = lambda w: w.rlike("[A-Z]") & (F.upper(w) == w)
    named = F.filter(words, lambda w, i: (F.length(w) > 2) & (shouted(w) | ((i > 0) & w.rlike("^[A-Z]"))))
    return F.array_distinct(F.filter(named, lambda w: ~(shouted(w) & w.isin("AND", "THE"))))


def lacking(claim: Column, claim_dates: Column, text: Column, text_dates: Column, known: Column, concepts: dict[str, list[str]] = CONCEPTS) -> tuple[Column, Column]:
    """Numbers and dates, and names, of a claim that a text does not hold. A day has to be the text's day, a month its month; a name may be there as another phrase of its concept."""
    low = F.replace(F.lower(text), F.lit(","), F.lit(""))
    digits = F.filter(numbers(claim), lambda n: ~F.contains(low, F.regexp_replace(F.lower(n), r"\.+$", "")))
    same_day = lambda d: F.exists(text_dates, lambda t: (t["precision"] == "day") & (t["start"] == d["start"]))
    same_month = lambda d: F.exists(text_dates, lambda t: F.trunc(t["start"], "month") == F.trunc(d["start"], "month"))
    untold = F.filter(claim_dates, lambda d: ((d["precision"] == "day") & ~same_day(d)) | ((d["precision"] == "month") & ~same_month(d)))
    meaning = F.create_map(*(F.lit(x) for c, phrases in concepts.items() for p in dict.fromkeys(phrases) for x in (p, f"__c_{c}"))) if concepts else F.create_map().cast("map<string,string>")
    bare = lambda w: F.regexp_replace(F.lower(w), r"^\.+|\.+$", "")
    there = lambda x: F.contains(low, x) | F.contains(low, F.regexp_replace(x, "s+$", "")) | x.isin(*NO_NAMES) | F.coalesce(F.array_contains(known, F.element_at(meaning, x)), F.lit(False))
    return F.array_distinct(F.concat(digits, F.transform(untold, lambda d: d["raw"]))), F.filter(names(claim), lambda w: ~there(bare(w)))


def verify(answers: DataFrame, key: str = "query", answer: str = "answer", evidence: str = "evidence") -> DataFrame:
    """key, number, claim, cited, verdict, coverage, cited_ok, and what the reading lacks, from answers(key, answer, evidence array<struct<name, text, title, source>>).

    cited_ok is null for a claim without citation, and false where none of what it cites is evidence. A claim's evidence is bounded by its answer's."""
    read = F.expr("sequence(0, 1)")  # 0: all evidence, 1: what is cited
    rows = claims(answers.select(key, answer, evidence), answer).withColumns({"body": F.trim(F.regexp_replace("claim", CITATION, "")), "reading": F.explode(read)})
    own = F.filter(evidence, lambda e: (F.col("reading") == 0) | F.array_contains("cited", e["name"]))
    rows = rows.where((F.col("reading") == 0) | (F.size("cited") > 0)).withColumns({"own": own, "wanted": F.array_remove(senses(F.col("body")), "e")})
    about = lambda e: F.concat_ws(" ", e["title"], e["source"])

    def windows(e: Column) -> Column:
        pairs = lambda s: F.transform(s, lambda x, i: F.concat_ws(" ", x, F.get(s, i + 1), about(e)))
        return T.let(T.sentences(F.coalesce(e["text"], F.lit(""))), lambda s: F.when(F.size(s) > 0, pairs(s)).otherwise(F.array(F.concat_ws(" ", e["text"], about(e)))))

    share = lambda known: F.when(F.size("wanted") > 0, F.size(F.array_intersect("wanted", known)) / F.size("wanted")).otherwise(F.lit(0.0))
    rated = F.transform(F.flatten(F.transform("own", windows)), lambda w: F.struct(share(senses(w)).alias("share"), w.alias("text")))
    nothing = F.struct(F.lit(-1.0).alias("share"), F.lit("").alias("text"))
    best = F.aggregate("rated", nothing, lambda s, x: F.when(x["share"] > s["share"], x).otherwise(s))
    whole = F.array_join(F.transform("own", lambda e: F.concat_ws(" ", e["text"], about(e))), " ")
    rows = rows.withColumn("rated", rated).withColumns({"best": best, "whole": whole}).drop("rated")
    for name, text in (("body", F.col("body")), ("best", F.col("best.text")), ("whole", F.col("whole"))):
        rows = rows.withColumn(f"{name}_dates", language.find_dates(text))
    for name, text in (("best", uniform(F.col("best.text"))), ("whole", uniform(F.col("whole")))):
        rows = rows.withColumn(f"{name}_text", text).withColumn(f"{name}_known", senses(F.col(f"{name}_text")))
        digits, missing = lacking(uniform(F.col("body")), F.col("body_dates"), F.col(f"{name}_text"), F.col(f"{name}_dates"), F.col(f"{name}_known"))
        rows = rows.withColumns({f"{name}_numbers": digits, f"{name}_names": missing})
    alone, together = F.greatest(F.col("best.share"), F.lit(0.0)), share(F.col("whole_known")) * TOGETHER
    fewer = F.size("whole_numbers") + F.size("whole_names") < F.size("best_numbers") + F.size("best_names")
    joint = (F.size("own") > 1) & (fewer | ((together > alone) & (F.size("whole_numbers") <= F.size("best_numbers"))))
    pick = lambda what: F.when(joint, F.col(f"whole_{what}")).otherwise(F.col(f"best_{what}"))
    coverage = F.when(joint & fewer, F.greatest(together, alone)).when(joint, together).otherwise(alone)
    none = F.size("own") == 0
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({"coverage": F.when(none, 0.0).otherwise(coverage), "numbers": F.when(none, empty).otherwise(pick("numbers")), "names": F.when(none, empty).otherwise(pick("names"))})
    verdict = claim_verdict(F.col("coverage"), F.size("numbers"), F.size("names"))
    told = F.struct("coverage", verdict.alias("verdict"), "numbers", "names")
    both = rows.groupBy(key, "number").agg(F.first("body").alias("claim"), F.first("cited").alias("cited"), F.max(F.when(F.col("reading") == 0, told)).alias("all"), F.max(F.when(F.col("reading") == 1, told)).alias("some"))
    better = F.when(F.col("some.coverage") > F.col("all.coverage"), F.col("some")).otherwise(F.col("all"))
    ok = F.when(F.size("cited") > 0, F.coalesce(F.col("some.verdict").isin("supported", "partial"), F.lit(False)))
    return both.withColumn("told", better).select(key, "number", "claim", "cited", "told.verdict", "told.coverage", ok.alias("cited_ok"), "told.numbers", "told.names")


def core(line: Column) -> Column:
    """A line without citations, emphasis and marks, by which claims and lines are set side by side."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, rf"{CITATION}|\*\*", ""), r"\s+", " "), "^[ .*•-]+|[ .*•-]+$", "")


def repair(answer: Column, bad: Column) -> Column:
    """The answer without the lines that hold a bad claim (its first 50 characters tell it); table rows are read as claims read them."""
    starts = F.filter(F.transform(bad, lambda b: F.substring(core(b), 1, 50)), lambda b: b != "")
    read = lambda line: core(citations(F.when(F.trim(line).startswith("|"), cells(F.trim(line))).otherwise(line)))
    holds = lambda line: F.exists(starts, lambda b: F.contains(read(line), b))
    return F.trim(F.array_join(F.filter(F.split(answer, "\n"), lambda x: ~holds(x)), "\n"))
