import random

from veilgate.llm import decontaminate as D


def distance(item, text):
    """Least edits of the whole item against any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "in", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        action = rng.random()
        if action < 0.4:
            chars[at] = "z"
        elif action < 0.7:
            del chars[at]
        else:
            chars.insert(at, "y")
    return "".join(chars)


def test_equals_full_alignment(spark, docs):
    rng = random.Random(5)
    items = [(i, words(rng, rng.randint(8, 40))) for i in range(12)]
    rows = []
    for i in range(60):
        text = words(rng, rng.randint(0, 80))
        if i % 2:
            item = rng.choice(items)[1]
            text = f"{text} {edited(rng, item, rng.randint(0, len(item) // 7)).upper()} {words(rng, 20)}"
        if i % 7 == 0:
            text = text.replace(" ", " \n ")
        rows.append((i, text))
    rows += [(60, None), (61, ""), (62, items[0][1][: len(items[0][1]) // 2]), (None, items[3][1]), (1, rows[1][1])]
    bench = spark.createDataFrame([*items, items[0], (None, items[1][1]), (50, None), (51, ""), (52, "shortest")], "item_id long, text string")
    clash = docs(rows).withColumnRenamed("lang", "leaks")
    got = sorted(
        (-1 if r.doc_id is None else r.doc_id, [(x.item_id, x.edits) for x in r.leaks])
        for r in D.find_leaks(clash, bench, keep=["doc_id"]).collect()
    )
    want = []
    for i, text in rows:
        found = []
        for item, passage in items:
            a, b = D.normalise(passage), D.normalise(text)
            least = distance(a, b)
            if least <= D.edit_budget(len(a)):
                found.append((item, least))
        want.append((-1 if i is None else i, found))
    assert got == sorted(want)
    assert sum(bool(f) for _, f in want) > 15


def test_blocks_give_the_same(spark, docs, monkeypatch):
    rng = random.Random(6)
    items = [(i, words(rng, 30)) for i in range(8)]
    rows = [(i, words(rng, 10) + " " + items[i % 8][1] + " " + items[(i + 3) % 8][1]) for i in range(16)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {r.doc_id: [x.item_id for x in r.leaks] for r in D.find_leaks(docs(rows), bench).collect()}
    monkeypatch.setattr(D, "BLOCK_BYTES", 500)
    frame = D.find_leaks(docs(rows), bench)
    assert frame.columns == [*docs([]).columns, "leaks"]
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in frame.collect()} == one
    assert one == {i: sorted({i % 8, (i + 3) % 8}) for i in range(16)}


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.leaks for r in D.find_leaks(docs([(1, "a text")]), bench).collect()] == [[]]
    assert D.find_leaks(docs([]), bench).collect() == []


def test_short_items_are_found_word_for_word(spark, docs):
    items = [(1, "Forty two is it"), (2, "两个黄鹂鸣翠柳一"), (3, "yes"), (4, "yes"), (5, " \n"), (6, "an long enough item of many words to align " * 2), (3, "no way")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "he said forty  TWO\nis it, and left"),
        (2, "forty two is item"),
        (3, "因此两个黄鹂鸣翠柳一行"),
        (4, "eyes yesterday"),
        (5, "Yes."),
        (6, None),
        (7, "no way " + items[5][1]),
        (8, "x" * 200_000 + " yes"),
        (9, "forty two is"),
    ]
    found = {r.doc_id: [(x.item_id, x.edits) for x in r.leaks] for r in D.find_leaks(docs(rows), bench).collect()}
    assert found == {1: [(1, 0)], 2: [], 3: [(2, 0)], 4: [], 5: [(3, 0), (4, 0)], 6: [], 7: [(3, 0), (6, 0)], 8: [(3, 0), (4, 0)], 9: []}
    at = D.find_leaks(docs([(1, "é  yes")]), bench).first().leaks[0].at
    assert at == len("é ".encode())


def test_clashing_names(spark, docs):
    bench = spark.createDataFrame([(1, "forty two is it")], "item_id long, text string")
    frame = docs([(1, "forty two is it")]).withColumnsRenamed({"lang": "found", "source": "text_of"})
    row = D.find_leaks(frame, bench).first()
    assert (row.found, row.text_of, len(row.leaks)) == ("en", "s", 1)
