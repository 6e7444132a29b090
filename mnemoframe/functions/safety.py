"""Screening of texts: personal data, prompt injection, encrypted fields, local addresses."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.functions.text import _col

# Kinds of personal data with pattern and confidence, in order of precedence.
PII = (
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.95),
    ("credit_card", r"\b(?:\d[ \-]?){13,19}\b", 0.70),
    ("ssn", r"\b\d{3}[\- ]?\d{2}[\- ]?\d{4}\b", 0.85),
    ("phone", r"(?:\+?\d{1,3}[\s\-]?)?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}\b", 0.75),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.80),
    ("date_of_birth", r"\b(?:0[1-9]|1[0-2])[/\-](?:0[1-9]|[12]\d|3[01])[/\-](?:19|20)\d{2}\b", 0.70),
    ("passport", r"\b[A-Z]{1,2}\d{6,9}\b", 0.50),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}\b", 0.80),
)
#: Confidence of a card number whose check digit holds; shortest passport number that counts.
CARD_CONFIDENCE, SHORTEST_PASSPORT = 0.95, 7

# Patterns of injected instructions with score and label.
INJECTION = (
    (r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|context)", 0.9, "role_override"),
    (r"(disregard|forget|override)\s+(your|the|all)\s+(rules?|instructions?|guidelines?|system\s*prompt)", 0.9, "role_override"),
    (r"you\s+are\s+now\s+(a|an|the)\s+", 0.7, "identity_switch"),
    (r"pretend\s+(you\s+are|to\s+be|you'?re)\s+", 0.7, "identity_switch"),
    (r"act\s+as\s+(a|an|if)\s+", 0.5, "identity_switch"),
    (r"system\s*:\s*", 0.8, "system_prompt_inject"),
    (r"\[INST\]|\[/INST\]|<<SYS>>|<\|im_start\|>|<\|system\|>", 0.9, "format_exploit"),
    (r"<\s*/?\s*(?:system|assistant|user|human)\s*>", 0.85, "format_exploit"),
    (r"do\s+not\s+follow\s+(the\s+)?(system|original)\s+", 0.8, "role_override"),
    (r"new\s+instructions?\s*:", 0.75, "role_override"),
    (r"reveal\s+(your|the)\s+(system\s+)?prompt", 0.85, "prompt_extraction"),
    (r"(print|show|output|repeat|display)\s+(your|the)\s+(system\s+)?(prompt|instructions?|rules?)", 0.85, "prompt_extraction"),
    (r"what\s+(are|is)\s+your\s+(system\s+)?(prompt|instructions?|rules?)", 0.6, "prompt_extraction"),
    (r"DAN\s+mode|jailbreak|bypass\s+(safety|filter|content)", 0.95, "jailbreak"),
    (r"(?:base64|b64)[\s:]+[A-Za-z0-9+/=]{20,}", 0.7, "encoded_payload"),
    (r"\\x[0-9a-fA-F]{2}", 0.5, "hex_escape"),
    (r"(?:eval|exec|import|__\w+__)\s*\(", 0.8, "code_injection"),
    (r"subprocess|os\.system|os\.popen|shutil\.|open\s*\(", 0.85, "code_injection"),
)
BLOCKED_FROM = 0.7


def luhn(number: str) -> bool:
    """Whether 13 to 19 digits pass the check-digit test."""
    digits = [int(c) for c in number if c.isdigit()]
    doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


class Scanner:
    """Finds personal data; earlier patterns win, and findings never overlap."""

    def __init__(self, extra: Sequence[tuple[str, str, float]] = ()):
        self.patterns = [(n, re.compile(p, re.IGNORECASE), c) for n, p, c in (*PII, *extra)]

    def scan(self, text: str | None) -> list[tuple[str, str, int, int, float]]:
        starts: list[int] = []
        ends: list[int] = []
        found = []
        for name, pattern, confidence in self.patterns:
            for m in pattern.finditer(text or ""):
                lo, hi = m.span()
                at = bisect_left(starts, hi)  # spans taken before do not overlap, so only the last that starts before the end can be in the way
                if lo == hi or (at and ends[at - 1] > lo):
                    continue
                if name == "passport" and hi - lo < SHORTEST_PASSPORT:
                    continue
                if name == "credit_card" and not luhn(m.group()):
                    continue
                sure = CARD_CONFIDENCE if name == "credit_card" else confidence
                starts.insert(at, lo)
                ends.insert(at, hi)
                found.append((name, m.group(), lo, hi, sure))
        return sorted(found, key=lambda f: f[2])


_FINDING = "array<struct<type:string,value:string,start:int,end:int,confidence:double>>"


def pii_findings(c: str | Column, extra: Sequence[tuple[str, str, float]] = ()) -> Column:
    """Findings in order of place; null texts have none. ``extra`` patterns come after the fixed ones."""

    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = Scanner(extra)
        for t in texts:
            yield t.map(lambda x: [dict(zip(("type", "value", "start", "end", "confidence"), f, strict=True)) for f in s.scan(x)])

    scan.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scan, _FINDING)(_col(c))


def pii_counts(c: str | Column) -> Column:
    """How often each kind of personal data matches, by built-in functions: a map from kind to count, kinds that occur only.

    Kinds are counted apart from each other, so a place may count for several; card numbers need their check digit.
    """
    t = F.coalesce(_col(c), F.lit(""))

    def n(name: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(t, F.lit(f"(?i){pattern}"), F.lit(0))
        if name == "credit_card":
            hits = F.filter(hits, lambda x: F.call_function("luhn_check", F.regexp_replace(x, r"\D", "")))
        if name == "passport":
            hits = F.filter(hits, lambda x: F.length(x) >= SHORTEST_PASSPORT)
        return F.size(hits)

    counted = F.map_from_arrays(F.array(*(F.lit(k) for k, _, _ in PII)), F.array(*(n(k, p) for k, p, _ in PII)))
    return F.map_filter(counted, lambda _, k: k > 0)


def pii_redact(c: str | Column, min_confidence: float = 0.0, style: str = "label", mask: str = "*", extra: Sequence[tuple[str, str, float]] = ()) -> Column:
    """The text with findings of at least ``min_confidence`` replaced by ``[TYPE_REDACTED]`` or by mask characters."""

    def redact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scanner(extra)

        def one(x):
            if x is None:
                return None
            for name, _, lo, hi, sure in reversed(s.scan(x)):
                if sure >= min_confidence:
                    x = x[:lo] + (f"[{name.upper()}_REDACTED]" if style == "label" else mask * (hi - lo)) + x[hi:]
            return x

        for t in texts:
            yield t.map(one)

    redact.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(redact, "string")(_col(c))


def pii_summary(df: DataFrame, text: str) -> DataFrame:
    """``has_pii``, ``n_findings`` and the distinct ``types`` of each row."""
    found = df.select(F.struct("*").alias("row"), pii_findings(text).alias("found"))
    kinds = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["type"])))
    return found.select("row.*", (F.size("found") > 0).alias("has_pii"), F.size("found").alias("n_findings"), kinds.alias("types"))


def injection_score(c: str | Column) -> Column:
    """The highest score of the injection patterns that occur, 0 if none does."""
    t = F.coalesce(_col(c), F.lit(""))
    return F.greatest(F.lit(0.0), *(F.when(t.rlike(f"(?i){p}"), F.lit(s)).otherwise(0.0) for p, s, _ in INJECTION))


def injection_labels(c: str | Column) -> Column:
    """Distinct labels of the injection patterns that occur, sorted."""
    t = F.coalesce(_col(c), F.lit(""))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(t.rlike(f"(?i){p}"), F.lit(label)) for p, _, label in INJECTION)))))


def base64_score(c: str | Column) -> Column:
    """0.9 if a run of 40 or more base64 characters decodes to a text with an injection pattern, else 0."""
    every = "|".join(f"(?:{p})" for p, _, _ in INJECTION)
    runs = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"[A-Za-z0-9+/=]{40,}"), F.lit(0))
    plain = F.transform(runs, lambda x: F.make_valid_utf8(F.try_to_binary(F.rpad(F.rtrim(x, F.lit("=")), (F.ceil(F.length(F.rtrim(x, F.lit("="))) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")).cast("string")))
    return F.when(F.exists(plain, lambda x: F.coalesce(x.rlike(f"(?i){every}"), F.lit(False))), 0.9).otherwise(0.0)


def unicode_score(c: str | Column) -> Column:
    """0.6 for more than three invisible characters, else 0.7 for a right-to-left mark, else 0."""
    t = F.coalesce(_col(c), F.lit(""))
    unseen = F.regexp_count(t, F.lit("[​‌‍⁠﻿­]"))
    return F.when(unseen > 3, 0.6).when(t.rlike("[‮‏]"), 0.7).otherwise(0.0)


def entropy(c: str | Column) -> Column:
    """Shannon entropy in bits a character; 0 for empty texts."""
    chars = F.split(F.coalesce(_col(c), F.lit("")), "")
    n = F.size(chars).cast("double")
    sums = F.aggregate(F.array_sort(chars), F.struct(F.lit("").alias("c"), F.lit(0).cast("double").alias("run"), F.lit(0.0).alias("h")), _entropy_step, lambda a: a["h"] + F.when(a["run"] > 0, a["run"] * F.log2(a["run"])).otherwise(0.0))
    return F.when(F.length(F.coalesce(_col(c), F.lit(""))) == 0, 0.0).otherwise(F.log2(n) - sums / n)


def _entropy_step(a, x):
    same = a["c"] == x
    done = F.when(same | (a["run"] == 0), 0.0).otherwise(a["run"] * F.log2(F.greatest(a["run"], F.lit(1.0))))
    return F.struct(x.alias("c"), F.when(same, a["run"] + 1).otherwise(1.0).alias("run"), (a["h"] + done).alias("h"))


def heuristic_score(c: str | Column) -> Column:
    """Length over 5000, many special characters, high entropy, and two or more role headers, added up to at most 1."""
    t = F.coalesce(_col(c), F.lit(""))
    n = F.length(t)
    special = F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]"))
    headers = F.regexp_count(t, F.lit(r"(?im)^(?:system|assistant|user|human)\s*:"))
    parts = F.when(n > 5000, 0.15).otherwise(0.0) + F.when((n > 0) & (special / F.greatest(n, F.lit(1)) > 0.3), 0.2).otherwise(0.0) + F.when(entropy(t) > 5.5, 0.2).otherwise(0.0) + F.when(headers >= 2, 0.4).otherwise(0.0)
    return F.least(parts, F.lit(1.0))


def injection_verdict(df: DataFrame, text: str, threshold: float = BLOCKED_FROM) -> DataFrame:
    """``risk`` (the larger of pattern and structure scores plus heuristics, at most 1), ``blocked``, ``flags`` and ``reason``.

    ``reason`` says why a text is blocked and is empty for others.
    """
    from mnemoframe.functions.text import sanitise

    scores = F.greatest(injection_score(text), F.greatest(base64_score(text), unicode_score(text))) + heuristic_score(text)
    first = df.select(F.struct("*").alias("row"), F.round(F.least(scores, F.lit(1.0)), 6).alias("risk"), injection_labels(text).alias("flags"), sanitise(text).alias("clean"))
    blocked = F.col("risk") >= threshold
    reason = F.when(blocked, F.format_string("Prompt injection detected (score=%.2f, flags=[%s]). Input blocked for safety.", "risk", F.array_join("flags", ", "))).otherwise("")
    return first.select("row.*", "risk", blocked.alias("blocked"), "flags", reason.alias("reason"), F.when(~blocked, F.col("clean")).alias("cleaned"))


def encrypt_fields(df: DataFrame, columns: Sequence[str], key: Column | str) -> DataFrame:
    """AES-GCM of string columns as base64 with a prefix; null stays null. ``key`` has 16, 24 or 32 bytes."""
    k = F.lit(key) if isinstance(key, str) else key
    return df.withColumns({c: F.concat(F.lit("enc:"), F.base64(F.aes_encrypt(F.col(c).cast("binary"), k, F.lit("GCM")))) for c in columns})


def decrypt_fields(df: DataFrame, columns: Sequence[str], key: Column | str) -> DataFrame:
    """Plain values again; what was never encrypted, or does not decrypt with this key, stays as it is."""
    k = F.lit(key) if isinstance(key, str) else key
    plain = lambda c: F.try_aes_decrypt(F.try_to_binary(F.substr(F.col(c), F.lit(5)), F.lit("base64")), k, F.lit("GCM")).cast("string")
    return df.withColumns({c: F.when(F.col(c).startswith("enc:"), F.coalesce(plain(c), F.col(c))).otherwise(F.col(c)) for c in columns})


def url_locality(df: DataFrame, url: str) -> DataFrame:
    """``host``, ``allowed`` and ``reason``: loopback and link-local hosts pass, other hosts are blocked, none is rejected."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    local = host.rlike(r"^(localhost|127\.\d{1,3}\.\d{1,3}\.\d{1,3}|169\.254\.\d{1,3}\.\d{1,3}|0\.0\.0\.0|\[::1\]|\[fe80:.*\])$")
    reason = F.when(host == "", "no host").when(local, "local").otherwise("external host")
    return df.withColumn("host", host).withColumn("allowed", local & (host != "")).withColumn("reason", reason)
