import hashlib

import public_tokenizers as P
import tiktoken

from veilgate.llm import byte_bpe

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


def plain():
    ranks = byte_bpe.parse_ranks(open(VOCABULARY, "rb").read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "Hello world, it's 12 o'clock.\n\n  Next  line\t\tend ",
    "",
    None,
    "<|endoftext|> plain <|im_start|>",
    "äöü ß 漢字 🙂🙂 ´ x y \x1c z",
    "no_blank_at_all" * 400,
    "word 'll 've   \n \n x" * 300,
    "a" * 3000 + " " * 500 + "b\n\n\n" * 50 + "1 2  3",
    "Hello world, it's 12 o'clock.\n\n  Next  line\t\tend ",
]


def test_ids_and_bytes_equal_the_library(spark, docs):
    encoding = plain()
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (0, TEXTS[0])]
    clash = docs(rows).withColumnsRenamed({"lang": "ids", "source": "decoded"})
    for limit in (7, 100, 1 << 16):
        found = byte_bpe.encode_decode(clash, VOCABULARY, P.PATTERN, limit=limit).collect()
        assert len(found) == len(rows)
        want = sorted((-1 if i is None else i, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
        assert sorted((-1 if r[0] is None else r[0], r.ids, bytes(r.decoded)) for r in found) == want


def test_runs_of_white_space_follow_the_pattern():
    encoding = plain()
    runs = [" " * 9, "\n" * 9, "\t" * 8, " \n" * 5, "\n " * 5, "\u3000\xa0" * 5, "\x1c" * 12, "\x85 " * 6, " "]
    for run in runs:
        for text in (run, "a" + run, run + "b", f"a{run}b", f"1{run}!{run}'s{run}\x1c{run}漢", f"x {run}\n"):
            assert byte_bpe.encode(encoding, text, run=4) == encoding.encode_ordinary(text), (run, text)
            assert "".join(p for p, _ in byte_bpe.blank_runs(text, 4)) == text


def test_very_long_runs():
    encoding = plain()
    for run in (" ", "\t", "\n", " \n"):
        for n in (1_000_000, 10_000_000):
            long = run * (n // len(run))
            found = byte_bpe.encode(encoding, "a" + long + "b")
            assert encoding.decode_bytes(found) == f"a{long}b".encode()
            # what a shorter run gives, with more of the same ids between
            short = byte_bpe.encode(encoding, "a" + run * (5000 // len(run)) + "b")
            assert found[:3] == short[:3] and found[-2:] == short[-2:] and set(found) == set(short)
    text = "! " * 2_000_000  # blanks everywhere, none behind a letter or digit
    assert encoding.decode_bytes(byte_bpe.encode(encoding, text)) == text.encode()


def test_pieces_join_to_the_text():
    for text in TEXTS:
        if text:
            assert "".join(byte_bpe.safe_pieces(text, 5)) == text


def test_digests(spark, docs):
    encoding = plain()
    row = byte_bpe.digests(byte_bpe.encode_decode(docs([(1, TEXTS[4])]), VOCABULARY, P.PATTERN)).first()
    ids = encoding.encode_ordinary(TEXTS[4])
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(TEXTS[4].encode()).hexdigest()
    empty = byte_bpe.digests(byte_bpe.encode_decode(docs([(1, None)]), VOCABULARY, P.PATTERN)).first()
    assert (empty.n_tokens, empty.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_empty_table(spark, docs):
    assert byte_bpe.encode_decode(docs([]), VOCABULARY, P.PATTERN).collect() == []
