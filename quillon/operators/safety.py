"""Injection scanning and output cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARANTINE, SUSPICIOUS, FULL = 0.75, 0.5, 4

# What instructions hidden in a page look like, how much each weighs, and its name.
SIGNS = (
    (r"(?i)\b(?:ignore|disregard|forget|override)\b[^.\n]{0,40}\b(?:previous|prior|above|earlier|all|any|your)\b[^.\n]{0,40}\b(?:instructions?|prompts?|rules|guidelines|context)\b", 3, "instruction override"),
    (r"(?i)\b(?:reveal|print|show|repeat|leak|output|disclose)\b[^.\n]{0,30}\b(?:system prompt|your instructions|hidden instructions|api[- ]?keys?|secrets?|credentials?|passwords?)\b", 3, "prompt/secret exfiltration"),
    (r"(?i)\b(?:note|message|instruction)s? (?:to|for) (?:the )?(?:ai|assistants?|language models?|llms?|chatbots?|agents?)\b", 3, "addresses the AI directly"),
    (r"(?i)\byou are now\b|\bact as (?:an? )?(?:unrestricted|jailbroken|different|evil)\b|\bnew (?:persona|role)\b", 2, "role hijack"),
    (r"(?im)<\|?(?:im_start|im_end|system|assistant)\|?>|\[/?INST\]|^\s*(?:system|assistant)\s*:", 2, "chat-template markers"),
    (r"(?i)\bdo not (?:tell|mention|reveal|inform|disclose)\b[^.\n]{0,40}\b(?:user|human|anyone)\b", 2, "concealment instruction"),
    (r"(?i)\b(?:assistant|ai|model) (?:must|should|will) (?:now )?(?:say|answer|respond|reply|state|claim|output)\b|\btell the user (?:that)?\b", 2, "directive to the model"),
    (r"(?i)!\[[^\]]*\]\(https?://[^)]*\)", 2, "markdown image (exfiltration channel)"),
    (r"(?i)\b(?:send|post|upload|forward|exfiltrate)\b[^.\n]{0,50}https?://", 2, "exfiltration URL"),
    ("[​-‏⁠‪-‮﻿]{3,}", 2, "invisible characters"),
)


def risk(text: Column) -> Column:
    """0 to 1: the weights of the signs found, against four."""
    total = F.lit(0)
    for pattern, weight, _ in SIGNS:
        total = total + F.when(text.rlike(pattern), weight).otherwise(0)
    return F.least(F.lit(1.0), total / F.lit(float(FULL)))


def findings(text: Column) -> Column:
    """Names of the signs found."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for p, _, name in SIGNS)))


def visible_risk(score: Column, hidden: Column) -> Column:
    """Hidden text that is but suspicious counts as quarantined."""
    return F.when(hidden & (score >= SUSPICIOUS), F.greatest(score, F.lit(QUARANTINE))).otherwise(score)


def sanitize(text: Column, allowed: Column) -> Column:
    """Without images, and with links only to the allowed urls; other links leave their words."""
    bare = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    links = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\[[^\]]+\]\(https?://[^)\s]+\)"), F.lit(0)))
    url = lambda x: F.regexp_extract(x, r"\]\((https?://[^)\s]+)\)$", 1)
    words = lambda x: F.regexp_extract(x, r"^\[([^\]]+)\]", 1)
    return F.aggregate(links, bare, lambda s, x: F.when(F.array_contains(allowed, url(x)), s).otherwise(F.replace(s, x, words(x))))
