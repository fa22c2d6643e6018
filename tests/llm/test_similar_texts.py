import random

import numpy as np
import pytest

from tests.llm.test_golay_dedup import partition
from veilgate.llm import similar_texts as S
from veilgate.llm.components import connected_components


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def overlap(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def words(rng, n):
    return ["".join(rng.choice(["th", "er", "on", "an", "re", "in", "é", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def copy(rng, text, share):
    return [w if rng.random() > share else "new" + rng.choice("abcdef") for w in text]


def test_estimate_is_near_the_overlap():
    rng = random.Random(1)
    for n in (12, 60, 400, 3000):
        base = words(rng, n)
        for share in (0.0, 0.01, 0.05, 0.3):
            a, b = " ".join(base), " ".join(copy(rng, base, share))
            sketches = np.frombuffer(S.profile(a)[2] + S.profile(b)[2], np.uint8).reshape(2, -1)
            assert S.likeness(sketches[:1], sketches[1:])[0, 0] == pytest.approx(overlap(a, b), abs=0.12)


@pytest.mark.parametrize("bucket", [4096, 5])
def test_near_copies_are_linked_and_others_not(spark, docs, bucket):
    rng = random.Random(2)
    texts = []
    for _ in range(25):
        base = words(rng, rng.randint(60, 500))
        texts.append(" ".join(base))
        texts += [" ".join(copy(rng, base, share)) for share in (0.004, 0.008, 0.008, 0.3)]
    texts += [texts[0], texts[0].upper(), texts[1].replace(" ", "\n "), None, "", " ", "short text", "short  text", "a short text"]
    rows = list(enumerate(texts)) + [(None, texts[3])]
    tied, links = S.similar_links(docs(rows).withColumnRenamed("lang", "bits"), bucket=bucket)
    edges = tied.selectExpr("id AS u", "rep AS v").unionByName(links)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    label = [roots.get(i, i) for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            alike = overlap(texts[i], texts[j])
            if alike >= 0.9:
                assert label[i] == label[j], (i, j, alike)
            if label[i] == label[j]:
                assert i // 5 == j // 5 or alike > 0.7 or max(i, j) >= 125, (i, j, alike)
    assert len(set(label[128:131])) == 1 and label[131] == label[132] != label[133]
    assert links.count() <= 40 * len(texts)
    assert len(partition(label)) < len(texts)


def test_empty_table(spark, docs):
    tied, links = S.similar_links(docs([]))
    assert tied.collect() == [] and links.collect() == []


def test_copies_with_another_passage_share_a_band():
    rng = random.Random(6)
    met, pairs = 0, 0
    for n in (60, 200, 1000):
        for share in (0.08, 0.16, 0.2):
            for _ in range(20):
                base, more = words(rng, n), words(rng, int(n * share))
                at = rng.randint(0, n) if rng.random() < 0.5 else n
                a, b = " ".join(base), " ".join(base[:at] + more + base[at:])
                if overlap(a, b) >= 0.8:
                    pairs += 1
                    met += not set(S.profile(a)[1]).isdisjoint(S.profile(b)[1])
    assert pairs > 100 and met == pairs


def test_a_chain_stays_connected_in_small_tiles(spark, docs):
    rng = random.Random(8)
    now = words(rng, 400)
    texts = []
    for step in range(40):  # each text is like its neighbours, not like the first
        texts.append(" ".join(now))
        now = now[:step * 10] + words(rng, 10) + now[step * 10 + 10 :]
    order = list(range(40))
    rng.shuffle(order)
    assert overlap(texts[0], texts[5]) < 0.8 <= overlap(texts[0], texts[2])
    for bucket in (4096, 3):
        tied, links = S.similar_links(docs([(order[i], t) for i, t in enumerate(texts)]), bucket=bucket)
        roots = {r.node: r.root for r in connected_components(links).collect()}
        assert roots == dict.fromkeys(range(40), 0)
    # one group of everything, whose leaders are not enough: no link may depend on the block
    rows = spark.createDataFrame([(1, i, 14) for i in range(40)], "group long, rep long, blocks long")
    tiles = {}
    for r in S._tiles(rows, "group", "rep").collect():
        tiles.setdefault(r.tile, set()).add(r.rep)
    assert all(any({i, j} <= t for t in tiles.values()) for i in range(40) for j in range(i))
    assert max(map(len, tiles.values())) < 20


def test_the_limit_is_decided_by_the_shingles(spark, docs):
    rng = random.Random(10)
    rows, want = [], set()
    for k in range(60):
        base = words(rng, 204)  # 200 shingles; c appended words leave 200 / (200 + c) of them common
        c = 50 if k % 2 else 51
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + words(rng, c)))]
        if overlap(rows[-2][1], rows[-1][1]) >= 0.8:
            want.add((2 * k, 2 * k + 1))
    assert 25 <= len(want) <= 35
    _, links = S.similar_links(docs(rows))
    assert {tuple(sorted(r)) for r in links.collect()} == want


def test_exact_forest_equals_all_pairs():
    rng = random.Random(11)
    for _ in range(60):
        sets = [np.array(sorted(rng.sample(range(14), rng.randint(8, 13))), np.uint64) for _ in range(rng.randint(2, 14))]
        n = len(sets)
        root = list(range(n))
        for i in range(n):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if len(a & b) >= 0.8 * len(a | b):
                    root = [root[j] if x == root[i] else x for x in root]
        got = list(range(n))
        edges = S.exact_forest(list(range(n)), sets, 0.8)
        for a, b in edges:
            got = [got[b] if x == got[a] else x for x in got]
        assert len(set(zip(root, got))) == len(set(root)) == len(set(got)) == n - len(edges)
