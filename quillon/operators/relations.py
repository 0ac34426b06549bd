"""Facts stated in sentences: what stands between two mentions decides the relation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from quillon.operators.language import Gazetteer, sentences
from quillon.sharing import Shared

# Verbs of relations, and which types they hold between.
ACTIVE = (
    ("RELEASED", r"(?:has )?(?:released?|launch(?:ed|es)|unveil(?:ed|s)|introduc(?:ed|es)|announc(?:ed|es)|ships?|shipped)"),
    ("DEVELOPS", r"(?:develop(?:ed|s)|built|builds|created?|makes|designed)"), ("ACQUIRED", r"(?:acquired?|bought|purchased)"),
    ("PARTNERS_WITH", r"(?:partner(?:ed|s)|collaborat(?:ed|es)|teamed up) with"), ("INVESTED_IN", r"(?:invest(?:ed|s) in|backed|funded)"),
    ("USES", r"(?:uses|is based on|is built on|adopt(?:ed|s))"), ("OUTPERFORMS", r"(?:outperform(?:ed|s)|beats|surpass(?:ed|es))"),
    ("TRAINED_ON", r"(?:was|is) trained on"), ("EVALUATED_ON", r"(?:was|is) evaluated on"), ("IS_A", r"is (?:an?|the)"),
)
PASSIVE = (("RELEASED", r"(?:was|were|is) (?:released|launched|unveiled|introduced|announced) by"), ("DEVELOPS", r"(?:was|were|is) (?:developed|built|created|made|designed) by"), ("ACQUIRED", r"(?:was|were) (?:acquired|bought) by"))
LEGAL = {
    "RELEASED": ("ORGANIZATION", None), "DEVELOPS": ("ORGANIZATION", None), "ACQUIRED": ("ORGANIZATION", "ORGANIZATION"), "PARTNERS_WITH": ("ORGANIZATION", "ORGANIZATION"),
    "INVESTED_IN": ("ORGANIZATION", "ORGANIZATION"), "USES": (None, "TECHNOLOGY"), "OUTPERFORMS": ("MODEL", "MODEL"), "TRAINED_ON": ("MODEL", None), "EVALUATED_ON": ("MODEL", None), "IS_A": (None, None),
}


def legal(rel: str, src: tuple, dst: tuple) -> bool:
    domain, range_ = LEGAL[rel]
    return src[0] != dst[0] and domain in (None, src[1]) and range_ in (None, dst[1])


def facts(sentence: str, names: Gazetteer) -> list[tuple[str, str, str, float]]:
    """(src, rel, dst, confidence). A list after a verb ("A released B and C") carries subject and verb on; a possessive ("A's B") is release."""
    found, carried = {}, None
    mentions = names.mentions(sentence)
    for left, right in zip(mentions, mentions[1:], strict=False):
        between = sentence[left[3] : right[2]].strip().lower()
        told = None
        for bank, swap in ((ACTIVE, False), (PASSIVE, True)):
            for rel, verb in bank:
                if m := re.match(rf"^(?:,?\s*)?{verb}\b(.*)$", between):
                    if len(m[1].split()) <= 4:
                        told = (right, rel, left) if swap else (left, rel, right)
                        break
            if told:
                break
        if told:
            sure = 0.9 if told[1] != "IS_A" else 0.7
            carried = None if told[0] is right else (told[0], told[1])
        elif between in ("and", ",", ", and") and carried:
            told, sure = (carried[0], carried[1], right), 0.75
        elif between in ("'s", "’s") or (between == "" and sentence[left[2] : left[3]].endswith(("'s", "’s"))):
            told, sure = (left, "RELEASED", right), 0.6
        else:
            carried = None
        if told and legal(told[1], told[0], told[2]):
            key = (told[0][0], told[1], told[2][0])
            found[key] = max(found.get(key, 0.0), sure)
    return [(*k, c) for k, c in found.items()]


def extracted(docs: DataFrame, names: Gazetteer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentence, src, rel, dst, conf of all facts in docs."""
    shared = Shared(docs.sparkSession, names)

    def run(frames):
        for rows in frames:
            known, out = shared.value(), []
            for k, t in rows.itertuples(index=False):
                for _, _, s in sentences(t):
                    out += [(k, s, *f) for f in facts(s, known)]
            yield pd.DataFrame(out, columns=[key, "sentence", "src", "rel", "dst", "conf"])

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, sentence string, src string, rel string, dst string, conf double")
