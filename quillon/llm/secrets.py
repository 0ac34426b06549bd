"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are reported wherever they stand. Weak candidates
(opaque strings, endpoints, account names) are reported only where they complete each other: a credential has parts of
three roles, identifier, secret and endpoint; every candidate reaches SCOPE code points to either side, within its paragraph,
and an interval join of these reaches pairs it with candidates of other roles. A weak secret is reported if an identifier
reaches it; a weak identifier or endpoint if a secret, strong or itself supported, reaches it.

The join is a sweep over candidates in order of place: a text of n candidates costs n log n and what it reports, as only the
nearest candidate of each role on either side is looked at, which decides whether any is in reach. Texts are independent,
so that nothing is shuffled.

Defined cases: null and empty texts have no spans; repeated rows are scanned one by one; an empty table gives an empty
result; spans count code points, the end excluded.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import blocks, carried, documents, fresh

SCOPE = 200
#: What ends a paragraph, and with it the reach of a candidate.
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")

ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The longest runs of 24 and more, which are the long ones among all longest runs.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words without one of which a text holds no assignment.
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE = ("assign", "access", "hex")

#: Weak candidates: kind, role, pattern, and a test of the match.
#: An opaque string may follow the = of an assignment.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:https?|s3|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s\"'<>|]+|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b", re.ASCII)
ACCOUNT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|(?ai:\b(?:user(?:name)?|login|account|client_?id)\b)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{2,}")
#: Stretches of one kind of character, once SIGNS are gone.
RUN, SIGNS = re.compile("[0-9]+|[a-z]+|[A-Z]+"), str.maketrans("", "", "+/_=-")
KINDS = (*BASE, "opaque", "endpoint", "account")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "opaque": "secret", "endpoint": "endpoint", "account": "identifier"}

Span = tuple[str, int, int]


def strong(text: str) -> list[Span]:
    found: list[Span] = []
    folded = text.lower()
    if any(cue in folded for cue in CUES):
        found += (("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6)
    if "AKIA" in text:
        found += (("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20)
    found += (("hex", m.start(), m.end()) for m in HEX.finditer(text))
    return found


def mixed(text: str) -> bool:
    """Whether a string looks drawn at random: it has digits, small and capital letters, and they alternate (unlike a path or a name) or none is rare.

    Of random base64 this leaves out what has no digit or no letters of a case: 3.4 % at 20 characters, 0.1 % at 40.
    """
    digits, small, capital = sum(map(str.isdigit, text)), sum(map(str.islower, text)), sum(map(str.isupper, text))
    least = min(digits, small, capital)
    return least * 10 >= len(text) or (least > 0 and len(RUN.findall(text.translate(SIGNS))) * 4 >= len(text))


def weak(text: str, taken: list[Span]) -> list[Span]:
    """Weak candidates that overlap no strong span."""
    begins, ends = sorted(s for _, s, _ in taken), sorted(e for _, _, e in taken)
    free = lambda a, b: bisect_left(begins, b) == bisect_right(ends, a)  # noqa: E731  as many begin before b as end by a
    found = [("opaque", m.start(), m.end()) for m in OPAQUE.finditer(text) if mixed(m[0])]
    found += (("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text))
    found += (("account", m.start(), m.end()) for m in ACCOUNT.finditer(text))
    return [x for x in found if free(x[1], x[2])]


class Reach:
    """Which intervals of one role lie within `scope` of a place and in its paragraph."""

    def __init__(self, spans: list[Span], breaks: list[int], scope: int):
        self.spans = sorted((a, b) for _, a, b in spans)
        self.begins = [a for a, _ in self.spans]
        self.furthest: list[int] = []
        for _, b in self.spans:
            self.furthest.append(max(b, self.furthest[-1]) if self.furthest else b)
        self.breaks, self.scope = breaks, scope

    def meets(self, begin: int, end: int) -> bool:
        """Whether a span overlaps begin - scope to end + scope, cut to the paragraph."""
        at = bisect_right(self.breaks, begin)
        low = max(begin - self.scope, self.breaks[at - 1] if at else 0)
        high = end + self.scope
        if (after := bisect_left(self.breaks, end)) < len(self.breaks):
            high = min(high, self.breaks[after])
        n = bisect_left(self.begins, high)
        return n > 0 and self.furthest[n - 1] > low


def scan(text: str | None, scope: int = SCOPE) -> list[Span]:
    """All spans, strong and linked, by place and kind."""
    if not text:
        return []
    found = strong(text)
    # Nothing weak is reported without a secret; an identifier alone may complete an opaque string.
    if found or any(mixed(m[0]) for m in OPAQUE.finditer(text)):
        loose = weak(text, found)
        breaks = [m.start() for m in PARAGRAPH.finditer(text)]
        role = lambda spans, name: [x for x in spans if ROLE[x[0]] == name]
        identifiers = Reach(role(found + loose, "identifier"), breaks, scope)
        supported = [x for x in role(loose, "secret") if identifiers.meets(x[1], x[2])]
        secrets = Reach(role(found, "secret") + supported, breaks, scope)
        found += supported + [x for x in loose if ROLE[x[0]] != "secret" and secrets.meets(x[1], x[2])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def findings(docs: DataFrame, text: str = "text", scope: int = SCOPE, masked: bool = False) -> DataFrame:
    """docs with spans (array of kind, begin, end) and, if masked, the redacted text (each name with a _ more if it is taken)."""
    names = fresh(docs.columns, "spans", "redacted")
    frame, own, at = carried(docs, docs.columns, text)
    span = "array<struct<kind:string,begin:int,end:int>>"
    schema = ", ".join(f"{o} {frame.schema[o].dataType.simpleString()}" for o in own) + f", spans {span}, redacted string"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, at):
            texts = table.column(at).to_pylist()
            found = [scan(x, scope) for x in texts]
            clean = [redact(x, s) if s else x for x, s in zip(texts, found, strict=True)] if masked else [None] * len(texts)
            spans = pa.array([[dict(zip(("kind", "begin", "end"), s, strict=True)) for s in x] for x in found], kind)
            yield from pa.table([*(table.column(o) for o in own), spans, pa.array(clean, pa.string())], [*own, "spans", "redacted"]).to_batches()

    out = frame.mapInArrow(run, schema)
    columns = [F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)] + [F.col("spans").alias(names[0])]
    return out.select(*columns, *([F.col("redacted").alias(names[1])] if masked else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    line = lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, BASE),
        F.sha2(F.encode(F.array_join(F.transform(base, line), ","), "UTF-8"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
