"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated values are permuted, by a keyed Feistel network, within the values of their own format: a card number becomes a
card number of the same issuer digit and length whose check digit is right, an IBAN an IBAN of its country, a date a date,
a telephone number one that could be dialled, an e-mail address another local part at the same host. The permutation
depends on the key and the value alone, so that equal values stay equal in all documents, and different ones different.
Its round function is SHA-256 over the key, the format, the round and the other half.

A date with slashes is read month first, unless its first number is over 12: then it is read day first, and becomes a date whose day is over 12, which no one
reads month first. The other forms of dates are linked with each other.

The key is joined on as a column, from a table of one row, so that plans and event logs hold no key.

Values are found by one pattern, left to right. What looks like a value but fails its check (a Luhn sum, an IBAN's
remainder, a day that no month has, an octet over 255) stays as it is. Separators and the case of letters stay. An IBAN ends
at its country's length. Digits in groups are taken as one run, whatever its length; where its longest card fails, shorter
ones and later ones, of whole groups, are tried in the lengths that issuers use.

Defined cases: a null text stays null, an empty one empty, and both hold nothing; repeated rows are treated alike; where two kinds of value could begin at one place, the first of KINDS is taken; a text of any length is one row's
expression; an empty table gives an empty result; columns of any name stay beside the new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import documents, fresh

ROUNDS = 8
#: The setting that the query takes its key from; Spark hides settings of this name in its logs.
KEY_SETTING = "spark.quillon.pseudonym.secret"
WALK = 64
#: Dates lie in the years 1900 to 2099: the first day, and the number of days.
FIRST_DAY, DAYS = "1900-01-01", 73049

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: The characters of an IBAN in each country that has them.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_OWN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, c in LENGTHS.items())
#: By its country's length, or else the longest.
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_OWN}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9]|-[0-9])"
#: A run of digits in groups, up to where a value of another kind begins.
CARD = rf"(?<![0-9])[0-9](?:(?:[ -](?!{EMAIL}|{DATE}|{SSN}|{IP}|{PHONE}))?[0-9]){{12,}}+"
#: Card numbers by issuer and length: Visa, Mastercard, Mir, American Express, Diners, JCB, and Maestro, Discover, UnionPay.
ISSUED = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|220[0-4][0-9]{12,15}|3[47][0-9]{13}|3(?:0[0-59]|[689][0-9])[0-9]{11,16}|35[2-8][0-9]{13,16}|(?:5[06-8]|6[0-9])[0-9]{11,17})$"
ANY = "|".join((EMAIL, IBAN, DATE, SSN, IP, PHONE, CARD))
KINDS = ("email", "iban", "date", "ssn", "ip", "phone", "card")


def prf(key: Column, kind: str, turn: Column, *parts: Column) -> Column:
    """A keyed number below 2**60."""
    text = F.concat_ws("|", key, F.lit(kind), turn.cast("string"), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 15), 16, 10).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def mix(values: Column, sizes: Column, key: Column, kind: str) -> Column:
    """Permutes arrays of numbers, values[i] below sizes[i]: halves take turns to be shifted by what the other one says."""

    def shifted(side: Column, other: Column, radix: Column, turn: Column) -> Column:
        pairs = F.arrays_zip(side.alias("x"), radix.alias("r"))
        move = lambda p, i, whole: F.pmod(p["x"] + F.pmod(prf(key, kind, turn, i, whole), p["r"]), p["r"])
        return let(F.concat_ws(",", other.cast("array<string>")), lambda whole: F.transform(pairs, lambda p, i: move(p, i, whole)))

    def run(given: Column) -> Column:
        half = F.floor(F.size(given["v"]) / 2).cast("int")
        split = lambda a, name: (F.slice(a, 1, half).alias(f"{name}l"), F.slice(a, half + 1, F.size(a) - half).alias(f"{name}r"))
        return let(F.struct(*split(given["v"], "v"), *split(given["s"], "s")), halves)

    def halves(g: Column) -> Column:
        def step(s: Column, turn: Column) -> Column:
            left = F.when(turn % 2 == 0, shifted(s["l"], s["r"], g["sl"], turn)).otherwise(s["l"])
            right = F.when(turn % 2 == 1, shifted(s["r"], s["l"], g["sr"], turn)).otherwise(s["r"])
            return F.struct(left.alias("l"), right.alias("r"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(g["vl"].alias("l"), g["vr"].alias("r")), step, lambda s: F.concat(s["l"], s["r"]))

    return let(F.struct(values.alias("v"), sizes.alias("s")), run)


def permute(number: Column, n: int, key: Column, kind: str, also=None) -> Column:
    """Permutes 0 to n - 1, or those of them for which also(number) holds: a network over two digits to base ceil(sqrt(n)), walked until the result is one of them again."""
    inside = lambda x: (x < n) if also is None else (x < n) & also(x)
    base = int(n**0.5) + (int(n**0.5) ** 2 < n)

    def once(x: Column) -> Column:
        def step(s: Column, turn: Column) -> Column:
            moved = F.pmod(s["a"] + F.pmod(prf(key, kind, turn, s["b"]), F.lit(base)), F.lit(base))
            return F.struct(s["b"].alias("a"), moved.alias("b"))

        start = F.struct(F.floor(x / base).cast("long").alias("a"), F.pmod(x, F.lit(base)).cast("long").alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * base + s["b"])

    ended = lambda x: F.when(inside(x), x).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))
    walk = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x), lambda y, _: F.when(inside(y), y).otherwise(once(y)))
    return let(number.cast("long"), lambda x: let(walk(x), ended))


def chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def refill(text: Column, digits: Column) -> Column:
    """The text with its digits, in order, replaced by those of an array."""
    step = lambda s, c, d: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["t"], F.element_at(d, s["n"] + 1).cast("string")).alias("t"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["n"].alias("n")))
    return let(digits, lambda d: F.aggregate(chars(text), F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), lambda s, c: step(s, c, d), lambda s: s["t"]))


def digits(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("long"))


def same(values: Column, size: int) -> Column:
    return F.transform(values, lambda _: F.lit(size).cast("long"))


def luhn(values: Column) -> Column:
    """The Luhn sum of digits whose last one is the check digit."""
    doubled = F.transform(F.reverse(values), lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda s, x: s + x)


def card(text: Column, key: Column) -> Column:
    def made(d: Column) -> Column:
        inner = let(F.slice(d, 2, F.size(d) - 2), lambda x: mix(x, same(x, 10), key, "card"))
        checked = lambda body: refill(text, F.concat(body, F.array(F.pmod(-luhn(F.concat(body, F.array(F.lit(0).cast("long")))), F.lit(10)).cast("long"))))
        return F.when(F.pmod(luhn(d), F.lit(10)) == 0, let(F.concat(F.slice(d, 1, 1), inner), checked))

    return let(digits(text), made)


def cards(text: Column, key: Column) -> Column:
    """value and n: a run of digits with its cards permuted, and how many there are; null if there are none."""

    def windows(groups: Column) -> Column:
        """Stretches of 13 to 19 digits of whole groups: first group, groups, digits; the longest of each first group first."""
        own = lambda i: F.transform(F.sequence(F.lit(19), F.lit(1), F.lit(-1)), lambda n: F.struct(i.alias("i"), n.alias("n"), F.array_join(F.slice(groups, i + 1, n), "").alias("w")))
        fit = lambda x: (x["i"] + x["n"] <= F.size(groups)) & F.length(x["w"]).between(13, 19)
        marked = lambda x, k: F.struct(x["i"].alias("i"), x["n"].alias("n"), (k == 0).alias("longest"), x["w"].rlike(ISSUED).alias("issued"), (F.pmod(luhn(digits(x["w"])), F.lit(10)) == 0).alias("ok"))
        return F.flatten(F.transform(groups, lambda _, i: F.transform(F.filter(own(i), fit), marked)))

    def picked(found: Column) -> Column:
        """Left to right. The longest from where the last one ended may be of any issuer, what is within it if it fails not."""
        pick = "array<struct<i:int,n:int>>"

        def step(s: Column, x: Column) -> Column:
            end, whole = x["i"] + x["n"], (x["i"] >= s["fresh"]) & x["longest"]
            taken = F.struct(end.alias("at"), end.alias("fresh"), F.concat(s["p"], F.array(F.struct(x["i"].alias("i"), x["n"].alias("n")))).cast(pick).alias("p"))
            failed = F.struct(s["at"].alias("at"), F.when(whole, end).otherwise(s["fresh"]).alias("fresh"), s["p"].alias("p"))
            return F.when(x["i"] < s["at"], s).when(x["ok"] & (x["issued"] | whole), taken).otherwise(failed)

        return F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit(0).alias("fresh"), F.array().cast(pick).alias("p")), step, lambda s: s["p"])

    def rebuilt(groups: Column, picks: Column) -> Column:
        upto = lambda n: F.length(F.array_join(F.slice(groups, 1, n), "-"))  # noqa: E731  separators are one character each
        begin = lambda x: F.when(x["i"] == 0, 0).otherwise(upto(x["i"]) + 1)
        part = lambda a, b: F.substring(text, a + 1, b - a)

        def step(s: Column, x: Column) -> Column:
            made = lambda p: F.struct(F.concat(s["t"], part(s["at"], p["a"]), card(part(p["a"], p["b"]), key)).alias("t"), p["b"].alias("at"))
            return let(F.struct(begin(x).alias("a"), upto(x["i"] + x["n"]).alias("b")), made)

        return F.aggregate(picks, F.struct(F.lit("").alias("t"), F.lit(0).alias("at")), step, lambda s: F.concat(s["t"], part(s["at"], F.length(text))))

    def made(groups: Column) -> Column:
        out = lambda p: F.when(F.size(p) > 0, F.struct(rebuilt(groups, p).alias("value"), F.size(p).alias("n")))
        return let(picked(windows(groups)), out)

    return let(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), made)


def value(c: Column) -> Column:
    """0 to 9 for a digit, 10 to 35 for a capital letter."""
    return F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55).cast("long")


def remainder97(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: F.pmod(F.when(x.rlike("[0-9]"), s * 10).otherwise(s * 100) + value(x), F.lit(97)))


def recast(c: Column, key: Column, kind: str) -> Column:
    """Permutes an array of characters: digits, capital and small letters among their like, others stay."""
    base = lambda x: F.when(x.rlike("[0-9]"), 48).when(x.rlike("[A-Z]"), 65).when(x.rlike("[a-z]"), 97).otherwise(F.ascii(x)).cast("long")
    size = lambda x: F.when(x.rlike("[0-9]"), 10).when(x.rlike("[A-Za-z]"), 26).otherwise(1).cast("long")
    own = F.transform(c, lambda x: F.struct(base(x).alias("b"), (F.ascii(x) - base(x)).alias("v"), size(x).alias("s")))
    return let(own, lambda o: F.zip_with(o, mix(o["v"], o["s"], key, kind), lambda x, m: F.char(x["b"] + m)))


def iban(text: Column, key: Column) -> Column:
    def spaced(made: Column) -> Column:
        step = lambda s, c: F.when(c == " ", F.struct(F.concat(s["t"], c).alias("t"), s["n"].alias("n"))).otherwise(F.struct(F.concat(s["t"], F.element_at(made, s["n"] + 1)).alias("t"), (s["n"] + 1).alias("n")))
        return F.aggregate(chars(text), F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), step, lambda s: s["t"])

    def made(plain: Column) -> Column:
        country, body = F.slice(plain, 1, 2), F.slice(plain, 5, F.greatest(F.size(plain) - 4, F.lit(0)))
        check = lambda moved: chars(F.lpad((98 - remainder97(F.concat(moved, country, F.array(F.lit("0"), F.lit("0"))))).cast("string"), 2, "0"))
        valid = F.size(plain).between(15, 34) & (remainder97(F.concat(body, F.slice(plain, 1, 4))) == 1)
        return F.when(valid, let(recast(body, key, "iban"), lambda moved: let(F.concat(country, check(moved), moved), spaced)))

    return let(chars(F.regexp_replace(text, " ", "")), made)


def single(c: Column, key: Column, kind: str) -> Column:
    """Permutes one character among its like; a network of halves would only shift it."""
    moved = lambda base, n: F.char(permute(F.ascii(c) - base, n, key, kind) + base)
    return F.when(c.rlike("[0-9]"), moved(48, 10)).when(c.rlike("[A-Z]"), moved(65, 26)).when(c.rlike("[a-z]"), moved(97, 26)).otherwise(c)


def email(text: Column, key: Column) -> Column:
    local = F.substring_index(text, "@", 1)
    moved = F.when(F.length(local) == 1, single(local, key, "email")).otherwise(F.array_join(recast(chars(local), key, "email"), ""))
    return F.concat(moved, F.lit("@"), F.substring_index(text, "@", -1))


def ip(text: Column, key: Column) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    return let(octets, lambda o: F.when(F.forall(o, lambda x: x < 256), F.array_join(mix(o, same(o, 256), key, "ip").cast("array<string>"), ".")))


def phone(text: Column, key: Column) -> Column:
    """The country's 1, if there, stays; the area and the exchange begin with 2 to 9."""
    lowest = lambda i: F.when((i == 0) | (i == 3), 2).otherwise(0).cast("long")

    def made(d: Column) -> Column:
        own = F.slice(d, F.size(d) - 9, 10)
        moved = mix(F.transform(own, lambda x, i: x - lowest(i)), F.transform(own, lambda _, i: 10 - lowest(i)), key, "phone")
        return refill(text, F.concat(F.slice(d, 1, F.size(d) - 10), F.transform(moved, lambda x, i: x + lowest(i))))

    return let(digits(text), made)


def ssn(text: Column, key: Column) -> Column:
    def made(p: Column) -> Column:
        area, group, serial = p[0], p[1], p[2]
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        number = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1
        return F.when(valid, let(permute(number, 898 * 99 * 9999, key, "ssn"), written))

    def written(moved: Column) -> Column:
        new = F.floor(moved / (99 * 9999)) + 1
        return F.format_string("%03d-%02d-%04d", F.when(new >= 666, new + 1).otherwise(new), F.pmod(F.floor(moved / 9999), F.lit(99)) + 1, F.pmod(moved, F.lit(9999)) + 1)

    return let(F.transform(F.split(text, "-"), lambda x: x.cast("long")), made)


def date(text: Column, key: Column) -> Column:
    """Year first, or day first with dots, or month first with slashes; equal days give equal days in all of them. Day first with slashes are dates of their own."""
    part = lambda a, b, c: F.concat_ws("-", F.substring(text, *a), F.substring(text, *b), F.substring(text, *c))
    first, dots = text.rlike("^.{4}[-/]"), text.contains(".")
    late = ~first & ~dots & (F.substring(text, 1, 2) > "12")
    iso = F.when(first, part((1, 4), (6, 2), (9, 2))).when(dots | late, part((7, 4), (4, 2), (1, 2))).otherwise(part((7, 4), (1, 2), (4, 2)))
    start = F.to_date(F.lit(FIRST_DAY))
    day_of = lambda n: F.date_add(start, n.cast("int"))

    def written(d: Column) -> Column:
        y, m, day = F.substring(d, 1, 4), F.substring(d, 6, 2), F.substring(d, 9, 2)
        return F.when(text.contains("-"), d).when(first, F.concat_ws("/", y, m, day)).when(dots, F.concat_ws(".", day, m, y)).when(late, F.concat_ws("/", day, m, y)).otherwise(F.concat_ws("/", m, day, y))

    other = lambda n: permute(n, DAYS, key, "date, day first", lambda x: F.dayofmonth(day_of(x)) > 12)
    moved = lambda n: F.when(n.between(0, DAYS - 1), let(day_of(F.when(late, other(n)).otherwise(permute(n, DAYS, key, "date"))).cast("string"), written))
    return let(F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), start), moved)


MAKERS = {"email": (EMAIL, email), "iban": (IBAN, iban), "date": (DATE, date), "ssn": (SSN, ssn), "ip": (IP, ip), "phone": (PHONE, phone), "card": (CARD, cards)}


def pseudonym(text: Column, key: Column) -> Column:
    """kind, value of the pseudonym, and n, how many values it holds (more than 1 only for cards); null if the check does not hold. No value fits two of the patterns."""
    made = None
    for kind, (pattern, make) in MAKERS.items():
        fits, value = text.rlike(f"^(?:{pattern})$"), make(text, key)
        if make is cards:
            one = let(value, lambda x: F.struct(F.lit("card").alias("kind"), x["value"].alias("value"), x["n"].alias("n")))
        else:
            one = F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(1).alias("n"))
        made = F.when(fits, one) if made is None else made.when(fits, one)
    return let(made, lambda x: F.when(x["value"].isNotNull(), x))


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with clean (the text with pseudonyms) and kinds (array of the kinds found, in order), each name with a _ more if it is taken."""
    clean, kinds, found, secret, one = fresh(docs.columns, "clean", "kinds", "found", "secret", "one")
    source = F.col(f"`{text}`")
    owner = docs.sparkSession.createDataFrame([(1, key)], f"`{one}` int, `{secret}` string")
    docs = docs.withColumn(one, F.lit(1)).join(F.broadcast(owner), one)
    key = F.col(secret)
    matches = F.regexp_extract_all(source, F.lit(ANY), F.lit(0))
    mapped = docs.withColumn(found, F.when(source.isNotNull(), F.transform(matches, lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p")))))
    gaps = F.split(source, ANY, -1)
    rebuilt = F.array_join(F.zip_with(gaps, F.transform(found, lambda x: F.coalesce(x["p"]["value"], x["m"])), lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    whole = F.when(F.size(found) > 0, rebuilt).otherwise(source)
    return mapped.withColumns({clean: whole, kinds: F.flatten(F.transform(F.filter(found, lambda x: x["p"].isNotNull()), lambda x: F.array_repeat(x["p"]["kind"], x["p"]["n"])))}).drop(found, secret, one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), key=spark.conf.get(KEY_SETTING, "a key for trials"))
    count = lambda kind: F.coalesce(F.size(F.filter("kinds", lambda k: k == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", F.col("clean").alias("text"), *map(count, KINDS))
