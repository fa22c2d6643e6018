import random
import zlib
from collections import Counter, defaultdict

from veilgate.llm import sharding as S


def plain_best_fit(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
        if fit:
            b = min(fit)[1]
        else:
            b = len(rooms)
            rooms.append(max(capacity, sizes[i]))
        rooms[b] -= sizes[i]
        out[i] = b
    return out


def test_tree_equals_a_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(0, 60) for _ in range(rng.randint(0, 120))]
        assert S.best_fit_decreasing(sizes, 70) == plain_best_fit(sizes, 70)


def test_pack_is_even():
    rng = random.Random(2)
    sizes = [int(rng.paretovariate(1.3) * 50) for _ in range(5000)]
    placed = S.pack(sizes, 16)
    load = Counter()
    for size, shard in zip(sizes, placed, strict=True):
        load[shard] += size
    alone = {placed[i] for i in range(len(sizes)) if sizes[i] >= sum(sizes) / 16}
    shared = [load[s] for s in range(16) if s not in alone]
    assert max(shared) - min(shared) <= max(shared) * 0.001 + 60
    assert set(placed) == set(range(16))
    assert S.pack([], 4) == [] and sorted(S.pack([5, 5, 5], 4)) == [0, 1, 2]


def check(rows, got, shards=16):
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    of_text, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        of_text[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(x) == 1 for x in of_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return load


def test_documents(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "SLOT_ROWS", 40)
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(1, 900) + str(i)) for i in range(900)]
    rows += [(1000 + i, "a copy " * 9) for i in range(400)] + [(2000 + i, None) for i in range(3)] + [(None, ""), (None, ""), (5, rows[5][1])]
    frame = docs(rows).withColumnsRenamed({"lang": "shard", "source": "size"})
    load = check(rows, S.shard_documents(frame).collect())
    assert max(load.values()) - min(load.values()) < 0.05 * max(load.values())
    again = sorted(map(tuple, S.shard_documents(frame.repartition(7)).collect()), key=str)
    assert again == sorted(map(tuple, S.shard_documents(frame).collect()), key=str)


def test_hot_group_and_small_tables(spark, docs):
    rows = [(i, "the very same text") for i in range(300)] + [(1000 + i, f"text number {i}") for i in range(450)]
    load = check(rows, S.shard_documents(docs(rows)).collect())
    rest = sorted(load.values())[:-1]
    assert len(rest) == 15 and rest[-1] - rest[0] < 30
    check([(1, "a")], S.shard_documents(docs([(1, "a")])).collect())
    assert S.shard_documents(docs([])).collect() == []
