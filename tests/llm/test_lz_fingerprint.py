import hashlib
import random
import zlib

import numpy as np
import pytest

from veilgate.llm import lz_fingerprint as L


def plain_phrases(text):
    known, current = set(), ""
    for c in text:
        current += c
        if current not in known:
            known.add(current)
            current = ""
    return known


def mixed_crc(phrase):
    h = zlib.crc32(phrase.encode())
    h ^= h >> 16
    h = h * 0x7FEB352D % (1 << 32)
    h ^= h >> 15
    h = h * 0x846CA68B % (1 << 32)
    return h ^ (h >> 16)


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "é", "re", "漢"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


TEXTS = ["", "a", "ab", "aaaaaaaaaaaaa", "abababababab" * 30, "é漢🙂" * 9]


def test_parse_equals_the_definition():
    rng = random.Random(1)
    for text in TEXTS + [words(rng, n) for n in (3, 50, 900)]:
        parser = L.Parser()
        parser.feed(text)
        assert parser.known == plain_phrases(text)
        for cut in (0, 1, len(text) // 2, len(text)):
            parts = L.Parser()
            parts.feed(text[:cut])
            fork = parts.fork()
            parts.feed(text[cut:])
            assert parts.known == plain_phrases(text)
            fork.feed("zz")
            assert fork.known == plain_phrases(text[:cut] + "zz")
        want = sorted({mixed_crc(p) for p in plain_phrases(text)})[: L.SIGNATURE]
        assert L.fingerprint(text).tolist() == want


def test_likeness():
    rng = random.Random(2)
    a, b = words(rng, 3000), words(rng, 3000)
    mixed = a[: len(a) // 2] + b[: len(b) // 2]
    for x, y in ((a, mixed), (a, b), (a, a)):
        p, q = plain_phrases(x), plain_phrases(y)
        assert L.likeness(L.fingerprint(x), L.fingerprint(y)) == pytest.approx(len(p & q) / len(p | q), abs=0.15)
    empty = L.fingerprint("")
    assert L.likeness(empty, empty) == 1 and L.likeness(empty, L.fingerprint("x")) == 0


def expected(rows):
    def order(row):
        h = row[2]
        return (row[0] is None, -(row[0] or 0), h)

    rows = sorted(rows, key=order)
    out = []
    for k, (number, text, _) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 2
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = L.fingerprint(text), L.fingerprint(edited), L.fingerprint(following)
        out.append(
            (-1 if number is None else number, len(text), hashlib.sha256(edited.encode()).hexdigest(), L.to_hex(a), L.to_hex(b), L.likeness(a, b), L.likeness(a, c))
        )
    return sorted(out)


@pytest.mark.parametrize("rows_per_range", [1024, 3])
def test_neighbours_equal_a_global_sort(spark, docs, monkeypatch, rows_per_range):
    monkeypatch.setattr(L, "RANGE_ROWS", rows_per_range)
    rng = random.Random(3)
    rows = [(rng.randint(-50, 5000), words(rng, rng.randint(0, 60))) for _ in range(90)]
    rows = list(dict(rows).items()) + [(9000, None), (9001, ""), (None, "x y z"), (None, "x y z a"), (None, None), (7, "t" * 5000), (7, "u v")]
    rows += [rows[5], rows[0]]
    frame = docs(rows).withColumnsRenamed({"lang": "h", "source": "fingerprint"})
    hashed = spark.createDataFrame([(i, t or "") for i, t in rows], "i long, t string").selectExpr("i", "t", "xxhash64(t) h").collect()
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in L.edited_pairs(frame).collect())
    assert got == expected([(r.i, r.t, r.h) for r in hashed])


def test_small_tables(spark, docs):
    assert L.edited_pairs(docs([])).collect() == []
    one = L.edited_pairs(docs([(4, "abcdef")])).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(4, hashlib.sha256(b"abcabc").hexdigest(), 1.0)]
    plain = L.fingerprints(docs([(4, "abcdef"), (5, None), (5, "abcdef")])).collect()
    assert sorted(r.fingerprint for r in plain) == sorted([L.to_hex(L.fingerprint("abcdef"))] * 2 + [""])
    assert np.all(np.diff(L.fingerprint("some text to be sure").astype(int)) > 0)
