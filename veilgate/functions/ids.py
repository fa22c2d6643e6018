"""Deterministic identifiers, tokens and log-safe prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PREFIX = "TOK_"
TOKEN_LIFETIME = "INTERVAL 24 HOURS"


def _hex_head(value: Column, digits: int) -> Column:
    return F.upper(F.substring(F.sha2(value, 256), 1, digits))


def entity_token(session_id: Column, id_type: Column, id_value: Column) -> Column:
    """A token that is stable within one session and differs between sessions."""
    return F.concat(F.lit(TOKEN_PREFIX), _hex_head(F.concat_ws(":", session_id, id_type, id_value), 16))


def stable_id(*parts: Column) -> Column:
    """A reproducible row id, used where a random one would change on every retry; a null part is marked."""
    marked = [F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]
    return F.sha2(F.concat_ws("\u0001", *marked), 256)


def log_prefix(token: Column) -> Column:
    return F.concat(F.substring(token, 1, 8), F.lit("***"))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)
