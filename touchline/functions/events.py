"""Event labels, flags and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.config import (
    DEFENCE_PATTERN,
    GOAL_TOKENS,
    PASS_PATTERN,
    SET_PIECE_LABELS,
    SHOT_PATTERN,
    SUCCESS_TOKENS,
    ProviderConfig,
)


def _matches(df: DataFrame, types: tuple[str, ...], pattern: str, event: str, original: str) -> Column:
    tests = [F.lit(False)]
    if event in df.columns and types:
        tests.append(F.coalesce(F.upper(event).isin(*types), F.lit(False)))
    if original in df.columns:
        tests.append(F.coalesce(F.lower(original).rlike(pattern), F.lit(False)))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def is_shot(df: DataFrame, cfg: ProviderConfig, event: str = "event_type", original: str = "original_event") -> Column:
    return _matches(df, cfg.shot_types, SHOT_PATTERN, event, original)


def is_pass(df: DataFrame, cfg: ProviderConfig, event: str = "event_type", original: str = "original_event") -> Column:
    return _matches(df, cfg.pass_types, PASS_PATTERN, event, original)


def is_defence(
    df: DataFrame, cfg: ProviderConfig, event: str = "event_type", original: str = "original_event"
) -> Column:
    return _matches(df, cfg.defence_types, DEFENCE_PATTERN, event, original)


def is_set_piece(label: str | Column) -> Column:
    """Label belongs to the set-piece vocabulary, whatever its separators."""
    label = F.col(label) if isinstance(label, str) else label
    plain = sorted({w.replace("_", "").replace(" ", "") for w in SET_PIECE_LABELS})
    return F.coalesce(F.regexp_replace(F.lower(label), "[_ ]", "").isin(*plain), F.lit(False))


def clean_number_id(c: str | Column) -> Column:
    """Frame-side event id: text without a trailing ``.0``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def leading_digits(c: str | Column) -> Column:
    """Event-side id: the digits it starts with, else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(c.cast("string"), r"^(\d+)", 1), F.lit(""))


def success_flag(df: DataFrame, success: str = "success", ends: tuple[str, str] = ("x2", "y2")) -> Column:
    """Success tokens when the column exists, else whether the pass has an end point."""
    if success in df.columns:
        return F.coalesce(F.lower(F.col(success).cast("string")).isin(*SUCCESS_TOKENS), F.lit(False))
    return F.col(ends[0]).isNotNull() & F.col(ends[1]).isNotNull()


def goal_flag(success: str | Column | None, label: str | Column | None) -> Column:
    """Positive number, success word or a label that names a goal."""
    flag = F.lit(False)
    if success is not None:
        s = (F.col(success) if isinstance(success, str) else success).cast("string")
        flag = flag | F.coalesce(s.try_cast("double") > 0, F.lit(False))
        flag = flag | F.coalesce(F.lower(F.trim(s)).isin(*GOAL_TOKENS), F.lit(False))
    if label is not None:
        l = F.col(label) if isinstance(label, str) else label
        flag = flag | F.coalesce(F.lower(l).contains("goal"), F.lit(False))
    return flag


def clean_phase(c: str | Column, underscores: bool = False) -> Column:
    """Trimmed lower-case phase with ``-`` for spaces (and for underscores in lookups)."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("-"))
    return F.replace(out, F.lit("_"), F.lit("-")) if underscores else out


# Accented Latin letters and the plain letters they decompose to.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"


def slug(c: str | Column, max_length: int = 120) -> Column:
    """File-safe text: accents off, ``: \\ /`` to ``-``, other signs to ``_``."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    dashed = F.translate(plain, ":\\/", "---")
    safe = F.regexp_replace(dashed, "[^A-Za-z0-9._-]+", "_")
    return F.substring(F.regexp_replace(safe, "^_+|_+$", ""), 1, max_length)


def same_value(c: str | Column, value) -> Column:
    """Equality that reads number-like text as a number; no value means no filter."""
    c = F.col(c) if isinstance(c, str) else c
    if value is None or value == "" or value != value:
        return F.lit(True)
    if isinstance(value, str) and value.strip().lstrip("-").isdigit():
        value = int(value)
    return c == F.lit(value)
