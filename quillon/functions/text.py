"""Text functions as Columns: tokens, stems, counts, shingles, hashes, slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no meaning in a search.
STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have how i if in into is it its of on or "
    "our s so than that the their them then there these they this those to was we were what when where which who whom "
    "why will with would you your about also more most other some such than very"
).split()

# Endings, what replaces them, in the order they are tried.
ENDINGS = (("ies", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""))

COMPOUND = "[a-z0-9]+(?:[-.][a-z0-9]+)*"


def stem(token: Column) -> Column:
    """The token without the first ending that leaves three letters; short tokens and those with digits stay."""
    n = F.length(token)
    out = F.when((n <= 3) | token.rlike("[0-9]"), token)
    for ending, instead in ENDINGS:
        fits = token.endswith(ending) & (n >= len(ending) + 3)
        if ending == "s":
            fits &= ~token.endswith("ss")
        out = out.when(fits, F.concat(F.substring(token, F.lit(1), n - len(ending)), F.lit(instead)))
    return out.otherwise(token)


def tokens(text: Column, keep_stop: bool = False) -> Column:
    """Stemmed tokens; a compound such as gpt-4 gives itself, its parts joined, and its parts."""
    found = F.regexp_extract_all(F.lower(F.replace(text, F.lit("’"), F.lit("'"))), F.lit(COMPOUND), F.lit(0))
    kept = (lambda t: F.lit(True)) if keep_stop else (lambda t: ~t.isin(*STOPWORDS))

    def expand(t: Column) -> Column:
        parts = F.filter(F.split(t, "[-.]"), lambda p: (p != "") & kept(p))
        return F.when(t.rlike("[-.]"), F.concat(F.array(t, F.regexp_replace(t, "[-.]", "")), parts)).when(kept(t), F.array(t)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.flatten(F.transform(found, expand)), stem)


def terms(docs: DataFrame, keep: list[Column], text: Column, name: str = "term") -> DataFrame:
    """The columns kept and name, a row for each stemmed token. Rows are made before tokens are expanded and stemmed, so that only compounds take array functions; the rest is compiled."""
    found = F.regexp_extract_all(F.lower(F.replace(text, F.lit("’"), F.lit("'"))), F.lit(COMPOUND), F.lit(0))
    t = F.col("_t")
    parts = F.filter(F.split(t, "[-.]"), lambda p: ~p.isin(*STOPWORDS))
    every = F.when(F.contains(t, F.lit("-")) | F.contains(t, F.lit(".")), F.concat(F.array(t, F.regexp_replace(t, "[-.]", "")), parts)).when(t.isin(*STOPWORDS), F.array().cast("array<string>")).otherwise(F.array(t))
    rows = docs.select(*keep, F.explode(found).alias("_t"))
    kept = [F.col(c) for c in rows.columns[:-1]]
    return rows.select(*kept, F.explode(every).alias("_t")).select(*kept, stem(t).alias(name))


def count_tokens(text: Column) -> Column:
    """Words (in any script) and single punctuation marks."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))


# Abbreviations that end in a point but end no sentence.
ABBREVIATIONS = "inc corp ltd co vs dr mr ms st no e.g i.e etc u.s approx fig".split()
#: White space between sentences; what stands before it is no abbreviation.
BREAK = r"(?U)(?<=[.!?])(?<!(?:^|\s)(?i:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.{1,3})\s+(?=[A-Z0-9\"“(\[])"


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, BREAK, -1), lambda s: F.trim(s) != "")


def normalize(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def runs(items: Column, body) -> Column:
    """body(sorted items, place, length) of each run of equal items, in their order."""

    def each(w: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return F.when(F.size(w) > 0, let(opens, lambda o: F.transform(o, lambda p, j: body(w, p, F.coalesce(F.get(o, j + 1), F.size(w)) - p))))

    return let(F.sort_array(items), each)


def bag(words: Column, heads: Column | None = None, boost: float = 1.0) -> Column:
    """The distinct words with their number, as structs (term, tf), ordered; each of heads counts boost. Null where there are none."""
    counted = lambda ws, by: runs(ws, lambda w, p, n: F.struct(F.get(w, p).alias("term"), (n * F.lit(float(by))).alias("tf")))
    if heads is None:
        return counted(words, 1.0)
    nothing = F.array().cast("array<struct<term:string,tf:double>>")
    both = F.concat(F.coalesce(counted(words, 1.0), nothing), F.coalesce(counted(heads, boost), nothing))

    def merged(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["term"] == F.get(s, j)["term"], F.lit(False))
        opens = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~same(i, i - 1))
        return F.when(F.size(s) > 0, F.transform(opens, lambda i: F.struct(F.get(s, i)["term"].alias("term"), (F.get(s, i)["tf"] + F.when(same(i, i + 1), F.get(s, i + 1)["tf"]).otherwise(0.0)).alias("tf"))))

    return let(F.sort_array(both), merged)


def shingles(words: Column, n: int = 4) -> Column:
    """Distinct runs of n words, joined by spaces; of fewer words, the run there is."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return let(words, lambda w: F.when(F.size(w) <= n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs(w))))


def bigrams(words: Column) -> Column:
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return let(words, lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(pairs(w)))


def short_hash(*parts: Column, length: int = 16) -> Column:
    """The first digits of SHA-1 over the parts, joined by bars."""
    return F.substring(F.sha1(F.encode(F.concat_ws("|", *parts), "UTF-8")), 1, length)


def chunk_id(document: Column, path: Column, text: Column, occurrence: Column) -> Column:
    return short_hash(document.cast("string"), path, normalize(text), occurrence.cast("string"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def alias_key(text: Column) -> Column:
    """What variants of a name have in common (for names in ASCII): no possessive, company form, article or separators."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(F.replace(text, F.lit("’"), F.lit("'"))), r"'s\b", ""), F.lit("[a-z0-9.+]+"), F.lit(0))
    joined = F.array_join(words, " ")
    # Company forms.
    bare = F.regexp_replace(joined, r"(?<=\S)(?: \.*(?:inc|corp|corporation|ltd|llc|plc|co|company|limited|pbc)\.*)+$", "")
    bare = F.regexp_replace(bare, "^the(?: |$)", "")
    together = F.replace(bare, F.lit(" "), F.lit(""))
    return F.regexp_replace(F.regexp_replace(together, r"(?<=[0-9])\.(?=[0-9])", "p"), "[^a-z0-9+]", "")
