"""Tokens, chunking and text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilgate.functions import sqltext

MAX_CHUNK_WORDS = 512

# --- Fixed values: English stop words of the full-text configuration -------------------------

STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now
    """.split()
)

# ----------------------------------------------------------------------------------------------


def words(text: str) -> Column:
    """Lower-cased runs of letters and digits of an SQL expression, stop words kept."""
    return F.expr(words_of(text))


def terms(text: str) -> Column:
    """Search terms of an SQL expression: words without stop words. No stemming."""
    return F.expr(f"filter({words_of(text)}, w -> w NOT IN ({sqltext.texts(STOP_WORDS)}))")


def words_of(text: str) -> str:
    """The SQL text behind ``words``."""
    return rf"filter(split(lower({text}), r'[^\p{{L}}\p{{N}}]+'), w -> w <> '')"


def embedding_key(text: Column) -> Column:
    """Key under which equal texts share one vector: lower case, single spaces, MD5."""
    collapsed = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    return F.md5(F.trim(collapsed))


def word_pieces(text: str, size: int = MAX_CHUNK_WORDS) -> Column:
    """Consecutive pieces of at most ``size`` whitespace-separated words, single-spaced.

    One pass of a possessive pattern, so the work grows with the length of the text.
    """
    run = rf"\S++(?:\s++\S++){{0,{size - 1}}}+"
    return F.expr(
        f"transform(regexp_extract_all({text}, {sqltext.raw(run)}, 0), "
        r"p -> regexp_replace(p, r'\s+', ' '))"
    )
