"""A small independent model of detection and protection on single Python strings."""

import hashlib
import re

FINDERS = [
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.90, 0),
    ("CREDIT_CARD", r"\b(?:\d{4}[\s\-]?){3}\d{4}\b", 0.85, 0),
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.95, 0),
    ("PHONE_NUMBER", r"\b(?:\+1[\s\-]?)?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{4}\b", 0.85, 0),
    ("US_BANK_NUMBER", r"\b\d{8,17}\b", 0.60, 0),
    ("ACCOUNT_NUMBER", r"\b[A-Z]{2,4}-\d{8,12}\b", 0.92, 0),
    ("ACCOUNT_NUMBER", r"\b(?:acct|account)[\s#:]*\d{10,16}\b", 0.92, re.IGNORECASE),
]


def spans(text, threshold):
    found = []
    for order, (kind, pattern, score, flags) in enumerate(FINDERS):
        if score >= threshold(kind):
            for m in re.finditer(pattern, text, flags):
                found.append((m.start() - m.end(), -score, order, m.start(), m.end(), kind))
    kept = []
    for span in sorted(found):
        if all(span[4] <= k[3] or span[3] >= k[4] for k in kept):
            kept.append(span)
    return sorted(((k[3], k[4], k[5]) for k in kept), reverse=True)


def protect(text, threshold, mode):
    """(safe text or None, blocked type or None)."""
    safe = text
    for start, end, kind in spans(text, threshold):
        how = mode(kind)
        if how == "block":
            return None, kind
        new = f"[{kind}]"
        if how == "token":
            digest = hashlib.sha256(text[start:end].encode()).hexdigest()[:8].upper()
            new = f"[{kind}:{digest}]"
        safe = safe[:start] + new + safe[end:]
    return safe, None
