"""Near-duplicates by odd sketches against all pairs; leaders' rounds against plain comparison."""

import random

import numpy as np
import pytest

from veilgate.llm import metric_groups as M
from veilgate.llm import odd_sketch as O
from veilgate.session import settle

WORDS = [f"w{k}" for k in range(3000)]


def plain_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 4]) for k in range(len(words) - 3)} or ({tuple(words)} if words else set())


def plain_components(rows):
    sets = [plain_sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for k, (doc, _) in enumerate(rows):
        mine = [d for j, (d, _) in enumerate(rows) if root(j) == root(k) and d is not None]
        out.append((doc, len(sets[k]), min(mine, default=None) if sets[k] else doc))
    return out


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(WORDS)
        elif kind == 1:
            words.insert(at, rng.choice(WORDS))
        elif len(words) > 5:
            del words[at]
    return words


def corpus(seed, n):
    rng = random.Random(seed)
    bases = [[rng.choice(WORDS) for _ in range(rng.choice([5, 30, 120, 400]))] for _ in range(8)]
    texts = []
    for _ in range(n):
        words = rng.choice(bases)
        if rng.random() < 0.3 and texts:
            words = rng.choice(texts)
        words = edited(words, rng, rng.randrange(1 + len(words) // 25))
        if rng.random() < 0.2:
            words = words + [rng.choice(WORDS) for _ in range(len(words) // 6)]
        texts.append(words)
    return [" ".join(t) for t in texts]


EDGE = ["", None, " \t\n", "one", "One", "one two three", "a b c d", "A  b\tc d", "ÄB c d e", "äB c d e", "word " * 30_000, "x\x1cy z w v"]


@pytest.mark.parametrize("bucket", [1024, 6])
def test_against_all_pairs(spark, docs, bucket):
    rows = [(k * 3 % 501, t) for k, t in enumerate(corpus(7, 150) + EDGE)]
    rows += [(None, rows[0][1]), (None, "a null id alone here"), rows[5], rows[5], (3, "same id, other text and words")]
    frame = docs(rows).withColumnsRenamed({"lang": "row", "source": "digest", "n_chars": "id"}).repartition(4)
    found = O.near_duplicates(frame, bucket=bucket).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((key(r[:3]) for r in found)) == sorted(map(key, plain_components(rows)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_exactly_at_the_limit(spark, docs):
    shared = [f"s{k}" for k in range(83)]  # 80 shingles in common
    rows = [(1, " ".join(shared + [f"a{k}" for k in range(10)])), (2, " ".join(shared + [f"b{k}" for k in range(10)])), (3, " ".join(shared + [f"c{k}" for k in range(11)]))]
    found = {r.doc_id: r.component_id for r in O.near_duplicates(docs(rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3}  # 80 of 100 and 80 of 101


def test_empty_tables(spark, docs):
    found = O.near_duplicates(docs([]))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"] and found.count() == 0
    assert [tuple(r) for r in O.near_duplicates(docs([(4, None)])).collect()] == [(4, 0, 4, True)]


def test_estimates():
    rng = np.random.default_rng(2)
    for similarity in (0.6, 0.8, 0.95):
        errors = []
        for _ in range(150):
            both, own = (rng.integers(0, 1 << 63, n, np.uint64) for n in (int(1000 * similarity), 2 * int(500 * (1 - similarity))))
            a, b = np.concatenate((both, own[::2])), np.concatenate((both, own[1::2]))
            true = len(both) / (len(both) + len(own))
            bits = [np.frombuffer(O.odd_sketch(O.samples(x)), np.uint8) for x in (a, b)]
            errors.append(O.estimate(np.bitwise_count(bits[0] ^ bits[1]).sum()) - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < {0.6: 0.06, 0.8: 0.04, 0.95: 0.025}[similarity]
    assert O.estimate(O.bits_at(0.635)) == pytest.approx(0.635, abs=0.01)


def test_leaders_lose_no_link(spark):
    """Chains, rings and a dense heart in one group, in a plane of bit strings."""
    rng = np.random.default_rng(9)
    points = [rng.integers(0, 2, 128) for _ in range(4)]
    for _ in range(300):
        seed = points[int(rng.integers(len(points)))].copy()
        flips = rng.choice(128, int(rng.integers(1, 9)), replace=False)
        seed[flips] ^= 1
        points.append(seed)
    values = [np.packbits(p).tobytes() for p in points]
    members = settle(spark.createDataFrame([(1, k, 0) for k in range(len(points))], "group long, id long, size long"), "t")
    table = settle(spark.createDataFrame(list(enumerate(values)), "id long, value binary"), "t")
    for limit in (2, 5):
        found = M.connect(members, lambda rows: rows.join(table, "id"), bytes, M.BitStrings, limit, bucket=20, leaders=3)
        label = list(range(len(points)))

        def root(k):
            while label[k] != k:
                k = label[k]
            return k

        pairs = [(i, j) for i in range(len(points)) for j in range(i) if (points[i] != points[j]).sum() <= limit]
        for i, j in pairs:
            label[root(i)] = root(j)
        want = {frozenset(k for k in range(len(points)) if root(k) == r) for r in map(root, range(len(points)))}
        label[:] = range(len(points))
        for u, v in found.collect():
            assert (points[u] != points[v]).sum() <= limit
            label[root(u)] = root(v)
        assert {frozenset(k for k in range(len(points)) if root(k) == r) for r in map(root, range(len(points)))} == want
