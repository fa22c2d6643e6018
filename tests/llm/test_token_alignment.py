"""Interval coalescing against a plain walk over byte offsets, and corpus counts against plain counting."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilgate.llm import token_alignment as A

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    "Hello world, it's 12 o'clock.\n\n  Next  line\t\tend ",
    "",
    None,
    "<|endoftext|> plain <s> text </s> <0x41> <unk>",
    "äöü ß 漢字 🙂🙂 ´ x y \x1c\x00 z",
    "a ▁ b",
    " leads and trails ",
    "tokenization of antidisestablishmentarianism " * 60,
    "Hello world, it's 12 o'clock.\n\n  Next  line\t\tend ",
    "unbroken" * 3000 + " " * 500 + "b\n\n\n" * 50 + "1 2  3",
    "x",
]


def plain_tokens(text):
    a_side, b_side = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a_side.encode_special_tokens = True
    alphabet = A.byte_alphabet()
    a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids
    b = b_side.encode(text or "")
    a_parts = [bytes(alphabet[c] for c in a_side.id_to_token(i)) for i in a]
    b_parts = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_side.id_to_piece(i)) for i in b)]
    if not text or {b"".join(a_parts), b"".join(b_parts)} != {(" " + text).encode()}:
        return [], []
    return list(zip(a, map(len, a_parts))), list(zip(b, map(len, b_parts)))


def plain_alignment(a, b):
    spans = []
    for side in (a, b):
        ends = np.cumsum([n for _, n in side]).tolist()
        spans.append([(i, e - n, e) for (i, n), e in zip(side, ends)])
    cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups, start = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in spans))
        start = cut
    links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
    return groups, links


def plain_rows(texts):
    found = [plain_alignment(*plain_tokens(t)) for t in texts]
    counts = Counter(p for _, links in found for p in set(links))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    return [
        (
            *(len(side) for side in plain_tokens(t)),
            len(groups),
            len(links),
            ";".join(groups),
            sum(counts[p] == most[p[0]] for p in links),
            sum(counts[p] for p in links),
        )
        for t, (groups, links) in zip(texts, found)
    ]


@pytest.mark.parametrize("top", [A.TOP, 8, 0])
def test_against_brute_force(spark, docs, top):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    frame = docs(rows).withColumnsRenamed({"lang": "row", "source": "a", "n_chars": "id"}).repartition(3)
    found = {r.doc_id: r for r in A.align_documents(frame, *FILES, top=top).collect()}
    want = plain_rows(TEXTS)
    assert len(found) == len(TEXTS)
    for i, row in enumerate(want):
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, bytes(r.groups).decode(), r.n_best, r.count_sum) == row, TEXTS[i]
    assert want[1] == want[2] == want[5] == (0, 0, 0, 0, "", 0, 0) and want[3][0]


def test_rows_that_repeat_and_null_ids(spark, docs):
    texts = ["two same", "two same", "two", None]
    found = A.align_documents(docs([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, None)]), *FILES).collect()
    want = plain_rows(texts)
    assert sorted((r.doc_id or -1, r.count_sum) for r in found) == sorted(zip((1, 1, -1, -1), (w[-1] for w in want)))


def test_empty_table(spark, docs):
    found = A.align_documents(docs([]), *FILES)
    assert found.count() == 0 and found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


def test_cuts_change_no_token():
    pair = A.Pair(*(open(f, "rb").read() for f in FILES))
    assert pair.cuts and pair.ranked
    texts = [t for t in TEXTS if t] + ["one two three 4 five  six\nseven eight's nine-ten " * 40]
    whole = [[x.tolist() for x in ids] for ids in pair.encode(texts, 1 << 30)]
    for limit in (1, 7, 50):
        assert [[x.tolist() for x in ids] for ids in pair.encode(texts, limit)] == whole


def test_ranks_give_the_ids_of_the_vocabulary(spark):
    pair = A.Pair(*(open(f, "rb").read() for f in FILES))
    texts = [t for t in TEXTS if t] + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    ranked = [pair.a_ids(" " + t).tolist() for t in texts]
    pair.ranked = None
    assert [pair.a_ids(" " + t).tolist() for t in texts] == ranked


def test_very_long_texts():
    pair = A.Pair(*(open(f, "rb").read() for f in FILES))
    for text in ("a" * 300_000, "\n" * 300_000, " " * 300_001 + "x", "word " * 200_000):
        found = A.align(pair.encode([text]), pair)
        assert found["n_a"][0][0] and found["n_links"][0][0] == found["n_a"][0][0] + found["n_b"][0][0] - found["n_groups"][0][0]


def test_random_tilings():
    rng = np.random.default_rng(1)
    for _ in range(50):
        total = int(rng.integers(1, 40))
        sides = [np.diff(np.concatenate(([0], np.sort(rng.choice(np.arange(1, total), int(rng.integers(0, total)), False)), [total]))) for _ in range(2)]
        group_a, group_b, links = A.coalesce(*sides)
        groups, plain = plain_alignment(*(list(enumerate(s.tolist())) for s in sides))
        assert sorted(map(tuple, links.tolist())) == plain
        assert [";".join(groups)] == [
            ";".join("|".join(",".join(map(str, np.flatnonzero(g == k))) for g in (group_a, group_b)) for k in range(group_a[-1] + 1))
        ]


def test_query_digest(spark):
    from veilgate.llm.queries import op13_token_alignment

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()[:25]
    found = {r.doc_id: r for r in op13_token_alignment(spark, sf).collect()}
    for r in rows:
        groups, links = plain_alignment(*plain_tokens(r.text))
        written = ";".join(groups)
        assert found[r.doc_id].groups_sha256 == (hashlib.sha256(written.encode()).hexdigest() if written else "")
        assert found[r.doc_id].n_links == len(links)
