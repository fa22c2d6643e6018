import random
import re

import numpy as np
import pytest
import xxhash

from veilgate.llm import golay_dedup as G
from veilgate.llm.components import connected_components


def slow_simhash(text, n=4):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(bits, radius=4):
    root = list(range(len(bits)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(bits)):
        for j in range(i):
            if bin(bits[i] ^ bits[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(bits))]


def partition(keys):
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(k, []).append(i)
    return sorted(groups.values())


def near_bits(rng, n, bases, most=6):
    out = set()
    roots = [rng.getrandbits(64) for _ in range(bases)]
    while len(out) < n:
        x = rng.choice(roots)
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_code_is_perfect():
    words = G.code_words()
    assert min(bin(int(words[0] ^ w)).count("1") for w in words[1:]) == 7
    table = G.decoder()
    x = np.arange(0, 1 << 23, 977, dtype=np.uint32)
    assert np.bitwise_count(words[table[x]] ^ x).max() <= 3


def test_linked_fingerprints_share_a_key():
    rng = random.Random(3)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        row, key = G.golay_keys(np.array([a, b], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_simhash_equals_the_definition():
    texts = ["", None, " \t ", "One", "a b c", "A b C d", "The cat, the\x0bcat sat\x1con Ünder Ä the mat the cat, the cat"]
    rng = random.Random(1)
    texts += [" ".join(rng.choice("ab cd Ef gh i j k".split()) for _ in range(n)) for n in (5, 40, 700)]
    for text in texts:
        assert G.simhash(text) == slow_simhash(text)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_components_equal_all_pairs(spark, bucket):
    rng = random.Random(7)
    bits = near_bits(rng, 260 if bucket > 3 else 60, 6)
    edges = G.links(spark.createDataFrame([(signed(x),) for x in bits], "bits long"), bucket=bucket)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    got = [roots.get(signed(x), signed(x)) for x in bits]
    assert partition(got) == partition(slow_components(bits))


def test_a_crowded_bucket_gives_no_pairs(spark):
    bits = near_bits(random.Random(9), 900, 1, 3)
    edges = G.links(spark.createDataFrame([(signed(x),) for x in bits], "bits long"))
    assert edges.count() < 40 * len(bits)
    assert connected_components(edges).select("root").distinct().count() == 1


def test_documents(spark, docs):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [
        (5, base), (3, base.upper()), (9, base.replace("w7 ", "x ")), (4, None), (8, ""), (6, "other text here now"),
        (7, " "), (7, " "), (None, base), (2, " ".join(f"v{i}" for i in range(300))),
    ]
    frame = docs(rows).withColumnsRenamed({"lang": "bits", "source": "component_id"})
    got = G.near_duplicates(frame).collect()
    bits = [slow_simhash(t) for _, t in rows]
    components = slow_components(bits)
    least = {}
    for (i, _), c in zip(rows, components, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((i or -1, signed(b), least[c]) for (i, _), b, c in zip(rows, bits, components, strict=True))
    assert sorted((r.doc_id or -1, r.bits, r.component_id) for r in got) == want
    edges = G.document_links(frame)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert {i: roots.get(i, i) for i, _ in rows if i is not None} == {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert G.near_duplicates(docs([])).collect() == []


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (3, 4)], "u long, v long")
    assert {(r.node, r.root) for r in connected_components(edges).collect()} == {(i, 0) for i in range(201)}
