"""Recogniser patterns, entity types and other detection constants."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: entity types, patterns and scores must equal the published ones -----------

ENTITY_TYPES = (
    "US_SSN",
    "US_DRIVER_LICENSE",
    "US_PASSPORT",
    "US_NPI",
    "CREDIT_CARD",
    "US_BANK_NUMBER",
    "US_ROUTING_NUMBER",
    "ACCOUNT_NUMBER",
    "PERSON",
    "EMAIL_ADDRESS",
    "PHONE_NUMBER",
    "DATE_TIME",
    "LOCATION",
    "US_ZIP_CODE",
)

MODES = ("block", "mask", "token")

DEFAULT_THRESHOLD = 0.75

SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:\d{4}[\s\-]?){3}\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(?:\+1[\s\-]?)?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{4}\b"
BANK = r"\b\d{8,17}\b"
ACCOUNT_PREFIXED = r"\b[A-Z]{2,4}-\d{8,12}\b"
ACCOUNT_LABELLED = r"\b(?:acct|account)[\s#:]*\d{10,16}\b"
DASHED_PHONE = r"\b\d{3}-\d{3}-\d{4}\b"
ISO_DATE = r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"

QUICK_SCAN = (SSN, CARD, EMAIL, ACCOUNT_PREFIXED, DASHED_PHONE)
NEVER_IN_RESPONSE = (
    ("SSN", SSN),
    ("CREDIT_CARD", CARD),
    ("DOMAIN_ACCOUNT", ACCOUNT_PREFIXED),
    ("PHONE", DASHED_PHONE),
)
SUSPICIOUS_IN_RESPONSE = (("EMAIL", EMAIL), ("DATE", ISO_DATE))
QUERY_REDACTION = (SSN, CARD)
REDACTED = "[REDACTED]"

# ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Recogniser:
    """One pattern-based detector. ``needs`` is a cheap test every match must pass (``digits``: EIGHT_DIGITS).

    ``begins`` is a class of characters that holds the first of every match; looking at that first is cheaper than ``\\b``.
    """

    entity_type: str
    pattern: str
    score: float
    ignore_case: bool = False
    needs: str | None = None
    begins: str | None = None

    @property
    def regex(self) -> str:
        ahead = f"(?=[{self.begins}])" if self.begins else ""
        return java_regex(ahead + self.pattern, self.ignore_case)


# What every match of the patterns of numbers holds: eight digits, between two of them no more than `) `, `)-`, a blank or a dash.
EIGHT_DIGITS = r"\d(?:[\s\-)]{0,2}+\d){7}"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """Java reading of a pattern whose classes (digit, space, word) are meant as Unicode classes."""
    return ("(?Ui)" if ignore_case else "(?U)") + pattern


# --- Fixed values: the score of each pattern must equal the published one ----------------------

RECOGNISERS = (
    Recogniser("US_SSN", SSN, 0.90, needs="digits", begins=r"\d"),
    Recogniser("CREDIT_CARD", CARD, 0.85, needs="digits", begins=r"\d"),
    Recogniser("EMAIL_ADDRESS", EMAIL, 0.95, needs="at"),
    Recogniser("PHONE_NUMBER", PHONE, 0.85, needs="digits", begins=r"+(\d"),
    Recogniser("US_BANK_NUMBER", BANK, 0.60, needs="digits", begins=r"\d"),
    Recogniser("ACCOUNT_NUMBER", ACCOUNT_PREFIXED, 0.92, needs="digits", begins="A-Z"),
    Recogniser("ACCOUNT_NUMBER", ACCOUNT_LABELLED, 0.92, ignore_case=True, needs="digits", begins="a"),
)
