import itertools
import random

from veilgate.llm import license_scan as L

TEMPLATES = L.make_templates()
KEYS = frozenset(w for t in TEMPLATES for w in t.places)


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_increasing_run_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        values = rng.sample(range(20), rng.randint(0, 8))
        pairs = list(enumerate(values))
        best = max((len(c) for n in range(len(pairs) + 1) for c in itertools.combinations(pairs, n) if all(x[1] < y[1] for x, y in zip(c, c[1:]))), default=0)
        assert len(L.increasing(pairs)) == best


def test_alignment_is_valid_and_exact_for_unique_words():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))]
        got = L.patience(a, b)
        assert all(a[x] == b[y] for x, y in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(got) <= longest_common(a, b)
        c, d = rng.sample(range(30), 12), rng.sample(range(30), 12)
        assert len(L.patience(c, d)) == longest_common(c, d)


def noise(rng, n):
    return " ".join(rng.choice(["the", "of", "thing", "ander", "work", "in", "über", "under", "software"]) for _ in range(n))


def test_planted_notices_are_found():
    rng = random.Random(3)
    for name, text in L.NOTICES:
        words = text.split()
        edited = list(words)
        if len(words) > 20:  # every tenth word is lost or changed
            edited = [w if k % 10 else rng.choice(["", "changed"]) for k, w in enumerate(words)]
        page = f"{noise(rng, 60)}\n{' '.join(edited).upper()}\n{noise(rng, 60)}"
        got = L.find_notices(page, TEMPLATES, KEYS)
        assert [g[0] for g in got] == [name]
        assert 60 - 5 <= got[0][2] <= 60 + 5
        assert L.find_notices(noise(rng, 300), TEMPLATES, KEYS) == []
        half = " ".join(words[: len(words) // 2])
        assert name not in [g[0] for g in L.find_notices(half, TEMPLATES, KEYS) if g[1] < 1]


def test_repeated_and_neighbouring_notices():
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    text = f"{mit}\n" * 5 + f"words between them\n{apache}\n{mit}"
    got = L.find_notices(text, TEMPLATES, KEYS)
    assert [g[0] for g in got] == ["MIT"] * 5 + ["Apache-2.0", "MIT"]
    assert all(g[1] == 1 for g in got)
    long_text = "word " * 100_000 + mit
    assert [g[2] for g in L.find_notices(long_text, TEMPLATES, KEYS)] == [100_000]


def test_rows(spark, docs):
    rows = [(1, "x Released under the MIT License. y"), (1, "x Released under the MIT License. y"), (2, None), (3, ""), (None, "Licensed under CC BY-NC 4.0."), (4, "no license here")]
    frame = docs(rows).withColumnRenamed("lang", "licenses")
    got = sorted((r.doc_id or 0, [(x.license, x.coverage, x.first_word, x.last_word) for x in r.licenses]) for r in L.scan_licenses(frame).collect())
    assert got == [(0, [("CC-BY-NC-4.0", 1.0, 0, 6)]), (1, [("MIT", 1.0, 1, 5)]), (1, [("MIT", 1.0, 1, 5)]), (2, []), (3, []), (4, [])]
    assert L.scan_licenses(docs([])).collect() == []
    own = L.scan_licenses(docs([(1, "you may use it as you like")]), notices=[("own", "You may use it as you like"), ("none", "...")])
    assert [x.license for x in own.first().licenses] == ["own"]


def test_variants_are_told_apart():
    rng = random.Random(5)
    core = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details."
    bsd = [t for n, t in L.NOTICES if n == "BSD-3-Clause"][-1]
    cases = {
        core.format("General", 3): ["GPL-3.0"],
        core.format("General", 2): ["GPL-2.0"],
        core.format("Lesser General", 3): ["LGPL-3.0"],
        core.format("Lesser General", "2.1"): ["LGPL-2.1"],
        core.format("Affero General", 3): ["AGPL-3.0"],
        "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
        "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0"],
        "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"],
        "Licensed under CC BY 3.0.": ["CC-BY-3.0"],
        "Licensed under CC BY 7.0.": [],
        bsd: ["BSD-3-Clause"],
    }
    for text, want in cases.items():
        page = f"{noise(rng, 40)} {text} {noise(rng, 40)}"
        assert [g[0] for g in L.find_notices(page, TEMPLATES, KEYS)] == want, text
