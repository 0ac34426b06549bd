"""Dates in text: time windows that questions name (as Columns), and all dates of a text (as an Arrow function)."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months.
MONTHS = "january february march april may june july august september october november december".split()


# How questions name years and stretches of time, and words that ask for what is new.
_Y = "((?:19|20)[0-9]{2})"
_RANGE, _SINCE, _AFTER = rf"\b(?:between|from)\s+{_Y}\s+(?:and|to|through|until|-)\s+{_Y}\b", rf"\bsince\s+{_Y}\b", rf"\bafter\s+{_Y}\b"
_UPTO, _WITHIN = rf"\b(before|until|prior to)\s+{_Y}\b", rf"\b(?:in|during|of|throughout)\s+{_Y}\b"
_PAST, _NAMED = r"\bthe\s+(?:past|last)\s+([0-9]+|a|one|two|three)\s+(year|month)s?\b", r"\b(last|this)\s+year\b"
NEW = r"(?i)\b(?:latest|newest|most recent|recent(?:ly)?|current(?:ly)?|right now|nowadays|today|state[- ]of[- ]the[- ]art|up[- ]to[- ]date)\b"
#: Days that a year and a month back count.
BACK = {"year": 365, "month": 30}


def time_window(question: Column, today: Column) -> tuple[Column, Column, Column]:
    """Start, end and recency of the time that a question names; null where it is open. The first of the forms that fits tells it."""
    low = F.lower(question)
    begin, stop = lambda y: F.make_date(y, F.lit(1), F.lit(1)), lambda y: F.make_date(y, F.lit(12), F.lit(31))
    never = F.lit(None).cast("date")

    def read(form: str, group: int) -> Column:
        return F.regexp_extract(low, form, group)

    number = lambda form, group: read(form, group).try_cast("int")
    written = F.when(read(_PAST, 1).isin("a", "one"), 1).when(read(_PAST, 1) == "two", 2).when(read(_PAST, 1) == "three", 3).otherwise(number(_PAST, 1))
    days = written * F.when(read(_PAST, 2) == "year", BACK["year"]).otherwise(BACK["month"])
    own = F.year(today) - F.when(read(_NAMED, 1) == "last", 1).otherwise(0)
    forms = (
        (_RANGE, begin(number(_RANGE, 1)), stop(number(_RANGE, 2))),
        (_SINCE, begin(number(_SINCE, 1)), never),
        (_AFTER, begin(number(_AFTER, 1) + 1), never),
        (_UPTO, never, stop(number(_UPTO, 2) - F.when(read(_UPTO, 1) == "until", 0).otherwise(1))),
        (_WITHIN, begin(number(_WITHIN, 1)), stop(number(_WITHIN, 1))),
        (_PAST, F.date_sub(today, days), today),
        (_NAMED, begin(own), stop(own)),
    )
    window = F.coalesce(*(F.when(low.rlike(form), F.struct(a.alias("a"), b.alias("b"))) for form, a, b in forms))
    return window["a"], window["b"], question.rlike(NEW)


_MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "september" else "sept?(?:ember)?" for m in MONTHS) + ")"
_YEAR = r"((?:19|20)\d{2})"
_FORMS = (
    ("day", re.compile(r"(?<![\w.-])(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})(?!\d)")),
    ("day", re.compile(rf"\b{_MONTH}\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>(?:19|20)\d{{2}})\b", re.I)),
    ("day", re.compile(rf"\b(?P<d>\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH}\.?,?\s+(?P<y>(?:19|20)\d{{2}})\b", re.I)),
    ("month", re.compile(rf"\b{_MONTH}\.?,?\s+(?P<y>(?:19|20)\d{{2}})\b", re.I)),
    ("quarter", re.compile(rf"\bQ(?P<q>[1-4])\s+(?P<y>(?:19|20)\d{{2}})\b")),
    ("year", re.compile(r"(?<![\w.$-])(?P<y>(?:19|20)\d{2})(?![\w%.,-]?\d)(?!\s*(?:B|M|K|billion|million|tokens|parameters)\b)")),
)
DATES = "array<struct<start:date,stop:date,precision:string,raw:string,begin:int,end:int>>"


def month_end(year: int, month: int) -> date:
    return date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)


def _read(precision: str, m: re.Match) -> tuple[date, date]:
    parts = m.groupdict()
    year = int(parts["y"])
    if precision == "year":
        return date(year, 1, 1), date(year, 12, 31)
    if precision == "quarter":
        last = 3 * int(parts["q"])
        return date(year, last - 2, 1), month_end(year, last)
    if parts.get("m"):
        month = int(parts["m"])
    else:
        named = next(g for g in m.groups() if g and g[0].isalpha()).lower()
        month = 1 + next(i for i, name in enumerate(MONTHS) if name.startswith(named[:3]))
    if precision == "month":
        return date(year, month, 1), month_end(year, month)
    day = date(year, month, int(parts["d"]))
    return day, day


def dates(text: str | None) -> list[tuple]:
    """(start, stop, precision, raw, begin, end) of all dates, in order of place. More exact forms take their place first; what is no date of its form may be one of a later form."""
    found: list[tuple] = []
    for precision, form in _FORMS:
        for m in form.finditer(text or ""):
            if any(m.start() < e and b < m.end() for *_, b, e in found):
                continue
            try:
                start, stop = _read(precision, m)
            except ValueError:
                continue
            found.append((start, stop, precision, m[0], m.start(), m.end()))
    return sorted(found, key=lambda x: x[4])
