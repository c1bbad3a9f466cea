"""Message tokens and the template algebra on them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, space_aware, trim_space

# Fixed values of the template rule.
WILDCARD = "<*>"
MAX_TOKENS = 40
TEMPLATE_CHARS = 150
SIMILARITY = 0.5
VARIABLE_TOKENS = (
    r"^\d+(\.\d+)?$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^\d{1,3}(\.\d{1,3}){3}$",
)


def tokenize(message: Column | str) -> Column:
    """First 40 whitespace-separated tokens; an empty array for a blank message."""
    trimmed = trim_space(message)
    pieces = space_aware(trimmed, r"\s+", lambda text, p: F.split(text, p, MAX_TOKENS + 1))
    tokens = F.slice(pieces, 1, MAX_TOKENS)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(tokens)


def join_tokens(tokens: Column | str) -> Column:
    return F.substring(F.array_join(col(tokens), " "), 1, TEMPLATE_CHARS)


def log_template(message: Column | str) -> Column:
    return join_tokens(tokenize(message))


def prefix_token(token: Column | str) -> Column:
    t = col(token)
    variable = F.lit(False)
    for pattern in VARIABLE_TOKENS:
        variable = variable | t.rlike(pattern)
    return F.when(variable, WILDCARD).otherwise(t)


def group_key(tokens: Column | str) -> Column:
    """Messages are only ever compared within one token count and first-token class."""
    t = col(tokens)
    return F.concat_ws("|", F.size(t).cast("string"), prefix_token(F.get(t, F.lit(0))))


def _agree(x: Column, y: Column) -> Column:
    return (x == y) | (x == WILDCARD) | (y == WILDCARD)


def token_similarity(a: Column | str, b: Column | str) -> Column:
    """Share of positions that are equal or wild on either side; 0 if lengths differ."""
    left, right = col(a), col(b)
    same = F.size(F.filter(F.zip_with(left, right, _agree), lambda hit: hit))
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 0), same / F.size(left)).otherwise(0.0)


def merge_tokens(a: Column | str, b: Column | str) -> Column:
    """Positions that differ become wild."""
    return F.zip_with(col(a), col(b), lambda x, y: F.when(x == y, x).otherwise(WILDCARD))
