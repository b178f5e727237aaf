"""Ad-hoc SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tablemill.errors import SpecError

# Text limit, replaced characters and refused words.
MAX_SQL_CHARS = 50_000
HELPER_COMMENT = re.compile(r"\s*/\* AI_CONTEXT.*?\*/\s*", re.DOTALL)
SMART_CHARACTERS = str.maketrans({"\u00a0": " ", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"'})
UNPRINTABLE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u200b\u200c\u200d\u2060\ufeff]")
WRITE_WORDS = re.compile(
    r"\b(?:INSERT|UPDATE|DELETE|MERGE|ALTER|DROP|CREATE|TRUNCATE|GRANT|REVOKE|COMMENT|RENAME|COMMIT|ROLLBACK"
    r"|SAVEPOINT|CALL|EXEC|EXECUTE|BEGIN|DECLARE|LOCK\s+TABLE|FOR\s+UPDATE)\b",
    re.IGNORECASE,
)
LEADING_COMMENTS = re.compile(r"\s*(?:--[^\n]*(?:\n|$)\s*|/\*.*?\*/\s*)*", re.DOTALL)


def clean_sql(text: str) -> str:
    """One statement, without helper comment, typographic quotes, control characters or ';'."""
    comment = HELPER_COMMENT.match(text)
    body = text[comment.end():] if comment else text
    body = UNPRINTABLE.sub(" ", body.translate(SMART_CHARACTERS)).strip().removesuffix(";").rstrip()
    if not body:
        raise SpecError("SQL cannot be empty.")
    if ";" in body:
        raise SpecError("Only one SQL statement can be run at a time.")
    if len(body) > MAX_SQL_CHARS:
        raise SpecError(f"SQL text is longer than {MAX_SQL_CHARS} characters.")
    return body


def ensure_read_only(text: str) -> None:
    """Refuse everything but SELECT and WITH. The word test is lexical, literals included."""
    body = LEADING_COMMENTS.sub("", text, count=1).strip()
    if not re.match(r"(?:SELECT|WITH)\b", body, re.IGNORECASE):
        raise SpecError("Read-only: the statement must start with SELECT or WITH.")
    found = WRITE_WORDS.search(body)
    if found:
        raise SpecError(f"Read-only: {found.group(0).upper()} is not allowed.")


def run_sql(spark: SparkSession, text: str, read_only: bool = False, **frames: DataFrame) -> DataFrame:
    """Run SQL text. ``frames`` are offered to it as ``{name}`` placeholders."""
    body = clean_sql(text)
    if read_only:
        ensure_read_only(body)
    return spark.sql(body, **frames) if frames else spark.sql(body)
