import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgate.functions.rules import FALLBACK_RULES
from veilgate.functions.text import STOP_WORDS
from veilgate.operators import corpus, dense, search, sparse

WORDS = [f"w{i}" for i in range(30)] + ["the", "and"]


def fixture(spark, chunks=400, queries=6, copies=0, same_vectors=0, seed=3):
    """Chunks with missing vectors, exact copies, and shared vectors over different texts."""
    rng = random.Random(seed)
    rows = []
    for i in range(chunks):
        text = " ".join(rng.choices(WORDS, k=rng.randint(3, 25)))
        vector = [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
        rows.append([f"c{i:04d}", text, vector if rng.random() > 0.1 else None, rng.choice("ab")])
    for i in range(copies):
        rows.append([f"x{i:04d}", rows[0][1], rows[1][2], rows[0][3]])
    for i in range(same_vectors):
        text = " ".join(rng.choices(WORDS, k=9))
        rows.append([f"y{i:04d}", text, [1.0, 1.0, 0.0, 0.5], "a"])
    chunk_df = spark.createDataFrame(
        [(c, c, t, v, d, "2024-06-01") for c, t, v, d in rows],
        "chunk_id string, document_id string, chunk_text string, embedding array<float>, "
        "domain string, updated_at string",
    ).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    asked = []
    for i in range(queries):
        text = " ".join(rng.choices(WORDS, k=4))
        vector = [1.0, 1.0, 0.0, 0.5] if i % 2 else [rng.random() for _ in range(4)]
        asked.append((f"q{i}", text, vector, "a" if i % 3 == 0 else "all"))
    query_df = spark.createDataFrame(
        asked, "query_id string, query string, query_vector array<float>, domain string"
    ).withColumn("cutoff", F.lit(None).cast("timestamp"))
    return rows, asked, corpus.with_terms(chunk_df, "chunk_text"), query_df


def terms(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w and w not in STOP_WORDS]


def brute_force(rows, asked, k):
    docs = {c: terms(t) for c, t, _, _ in rows}
    mean = sum(map(len, docs.values())) / len(docs)
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    answer = {}
    for q, text, vector, domain in asked:
        scored = []
        for c, _, v, d in rows:
            if domain not in ("all", d):
                continue
            s = 0.0
            for w in set(terms(text)):
                tf = docs[c].count(w)
                if tf:
                    idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[c]) / mean))
            cos = None
            if v is not None:
                a, b = np.array(v, "float64"), np.array(vector, "float32").astype("float64")
                length = np.linalg.norm(a) * np.linalg.norm(b)
                cos = round(float(a @ b / length), 6) + 0.0 if length else 0.0
            scored.append((c, cos, round(s, 6)))
        fused = []
        for c, cos, s in scored:
            rd = 1 + sum(1 for x in scored if x[1] is not None and (cos is None or x[1] > cos))
            rs = 1 + sum(1 for x in scored if x[2] > s)
            fused.append((-(1 / (60 + rd) + 1 / (60 + rs)), c, rd, rs))
        answer[q] = [(c, rd, rs) for _, c, rd, rs in sorted(fused)[:k]]
    return answer


@pytest.mark.parametrize("copies, same", [(0, 0), (150, 0), (0, 200), (120, 150)])
def test_fusion_equals_ranking_the_whole_corpus(spark, copies, same):
    rows, asked, chunks, queries = fixture(spark, 300, 6, copies, same)
    found = search.hybrid_search(chunks, queries, "query", 3).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.position)):
        got.setdefault(r.query_id, []).append((r.chunk_id, r.dense_rank, r.sparse_rank))
    assert got == brute_force(rows, asked, 3)


def test_tiles_and_packed_queries_agree(spark):
    _, _, chunks, queries = fixture(spark, 200, 7)
    marked = queries.withColumn("marks", F.array(F.lit(0.25), F.lit(0.5)))
    packed = dense.score_hits(chunks, marked, 5)
    tiled = dense._tiled(
        chunks.select("chunk_id", "embedding", "domain", "updated_at").where("embedding IS NOT NULL"),
        marked.select("query_id", "query_vector", "domain", "cutoff", "marks"),
        5,
        query_tiles=3,
        chunk_tiles=4,
    )

    def best(hits):
        return {(r.query_id, r.chunk_id, r.dense_rank) for r in dense.best_of(hits, 5).collect()}

    def counts(hits):
        rows = hits.where("chunk_id IS NULL").groupBy("query_id", "dense").agg(F.sum("n").alias("n"))
        return {(r.query_id, r.dense, r.n) for r in rows.collect()}

    assert best(packed) == best(tiled)
    assert counts(packed) == counts(tiled)


def test_clusters_find_most_neighbours(spark):
    _, _, chunks, queries = fixture(spark, 300, 6)
    exact = {(r.query_id, r.chunk_id) for r in dense.dense_top(chunks, queries, 5).collect()}
    near = dense.dense_top_clustered(chunks, queries, 5, centroids=4, probes=4).collect()
    assert {(r.query_id, r.chunk_id) for r in near} == exact
    few = dense.dense_top_clustered(chunks, queries, 5, centroids=4, probes=2).collect()
    assert len(exact & {(r.query_id, r.chunk_id) for r in few}) >= len(exact) // 2


def test_governed_search_clamps_and_refuses(spark):
    _, _, chunks, queries = fixture(spark, 60, 3)
    asked = queries.withColumns(
        {
            "top_k": F.lit(999),
            "agent_id": F.lit("a"),
            "agent_role": F.lit("analyst"),
            "session_id": F.lit("s"),
            "query": F.concat("query", F.lit(" 123-45-6789")),
        }
    )
    rows = search.governed_search(chunks, asked, FALLBACK_RULES).collect()
    assert {r.returned for r in rows} == {3} and {r.total_found for r in rows} == {10}
    assert all("123-45-6789" not in r.query for r in rows)
    secret = chunks.withColumn("chunk_text", F.concat("chunk_text", F.lit(" 123-45-6789")))
    refused = search.governed_search(secret, asked, FALLBACK_RULES).collect()
    assert {(r.status, r.text, r.returned) for r in refused} == {("blocked", None, 0)}
    dropped = search.governed_search(secret, asked, FALLBACK_RULES, on_block="drop").collect()
    assert [(r.total_found, r.returned, r.position, r.chunk_id, r.text) for r in dropped] == [(10, 0, 0, None, None)] * 3


def test_custom_scorer_reorders(spark):
    _, _, chunks, queries = fixture(spark, 60, 2)
    asked = queries.withColumns(
        {c: F.lit(v) for c, v in (("top_k", 3), ("agent_id", "a"), ("agent_role", "x"), ("session_id", "s"))}
    )
    rows = search.governed_search(
        chunks, asked, FALLBACK_RULES, scorer=lambda df: F.length("safe_text").cast("double")
    ).collect()
    for q in {r.query_id for r in rows}:
        sizes = [len(r.text) for r in sorted(rows, key=lambda r: r.position) if r.query_id == q]
        assert sizes == sorted(sizes, reverse=True)


def test_each_text_is_embedded_once(spark, tmp_path):
    import os

    def embed(texts):
        with open(tmp_path / f"calls-{os.getpid()}", "a") as log:
            log.write("".join(f"{t}\n" for t in texts))
        return [[1.0, 2.0]] * len(texts)

    df = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "id int, t string")
    corpus.embed_once(df, "t", corpus.batch_embedder(embed, 2)).collect()
    lines = [line for p in tmp_path.iterdir() for line in p.read_text().splitlines()]
    assert sorted(lines) == [f"text {i}" for i in range(5)]


def test_embedder_runs_once_per_text_and_checks_size(spark):
    df = spark.createDataFrame([("A  b",), ("a b",), ("c",)], "text string")
    embed = corpus.batch_embedder(lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    rows = corpus.embed_once(df, "text", embed).collect()
    assert {r.text: list(r.embedding) for r in rows}["A  b"] == {r.text: list(r.embedding) for r in rows}["a b"]
    assert corpus.cache_hit_rate(df, "text").first().hit_rate == pytest.approx(1 / 3)
    wrong = corpus.batch_embedder(lambda texts: [[1.0] for _ in texts], 2)
    with pytest.raises(Exception, match="dimension mismatch"):
        df.select(wrong("text")).collect()


def test_pseudo_vectors_are_unit_and_repeatable(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    rows = [r.embedding for r in corpus.pseudo_embed(df, "text", 40).collect()]
    assert rows[0] == rows[1] != rows[2]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 and len(v) == 40 for v in rows)


def test_zero_vector_is_kept_by_normalisation(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert corpus.normalised(df, "v", "u").first().u == [0.0, 0.0]


def test_bm25_without_matches_is_empty(spark):
    _, _, chunks, queries = fixture(spark, 20, 2)
    none = queries.withColumn("query", F.lit("the and zebra"))
    assert sparse.bm25(chunks, none, "query").count() == 0


def test_fewer_scored_chunks_than_asked_for(spark):
    _, _, chunks, _ = fixture(spark, 30)
    asked = spark.createDataFrame(
        [("one", "w1", None, "all"), ("none", "zzz", None, "all"), ("nowhere", "w1", None, "missing")],
        "query_id string, query string, query_vector array<float>, domain string",
    ).withColumn("cutoff", F.lit(None).cast("timestamp"))
    found = search.hybrid_search(chunks, asked, "query", 10).collect()
    assert sorted(r.query_id for r in found) == ["none"] * 10 + ["one"] * 10
    ids = sorted(r.chunk_id for r in found if r.query_id == "none")
    assert ids == [f"c{i:04d}" for i in range(10)]
    assert {r.position for r in found if r.query_id == "one"} == set(range(1, 11))


def test_query_batches_agree(spark, monkeypatch):
    _, _, chunks, queries = fixture(spark, 120, 7)
    whole = {tuple(r) for r in search.hybrid_search(chunks, queries, "query", 4).collect()}
    monkeypatch.setattr(search.scan, "BATCH_QUERIES", 2)
    monkeypatch.setattr(search.scan, "BLOCK_CHUNKS", 17)
    assert {tuple(r) for r in search.hybrid_search(chunks, queries, "query", 4).collect()} == whole


def test_every_call_has_a_row(spark):
    _, _, chunks, queries = fixture(spark, 20, 3)
    about = queries.withColumns(
        {"top_k": F.lit(2), "agent_id": F.lit("a"), "agent_role": F.lit("analyst"), "session_id": F.lit("s")}
    ).withColumn("domain", F.when(F.col("query_id") == "q1", "missing").otherwise("all"))
    vectors = []

    def embed(text):
        vectors.append(text)
        return F.array(*(F.lit(0.5).cast("float") for _ in range(4)))

    found = search.governed_search(chunks, about, FALLBACK_RULES, on_block="drop", embed=embed).collect()
    assert len(vectors) == 1
    empty = [r for r in found if r.query_id == "q1"]
    assert [(r.status, r.total_found, r.returned, r.position, r.chunk_id) for r in empty] == [("ok", 0, 0, 0, None)]
    assert sum(r.query_id == "q0" for r in found) == 2


def test_scores_held_at_a_time_do_not_grow_with_the_block():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from veilgate.operators import dense

    rng = np.random.default_rng(3)
    asked, given = rng.normal(size=(1500, 8)), rng.normal(size=(20_000, 8))
    queries = pd.DataFrame({"query_id": [str(i) for i in range(1500)], "query_vector": list(asked), "domain": "all", "cutoff": pd.NaT, "marks": None})
    queries.at[3, "marks"] = [0.5]
    block = pd.DataFrame({"chunk_id": [f"{i:05}" for i in range(20_000)], "embedding": list(given), "domain": "en", "updated_at": pd.NaT})
    top = dense.BlockTop(queries, 5)
    tracemalloc.start()
    top.add(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # one table of scores alone has 240 MB
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    rows = top.rows()
    for i in (0, 3, 1499):
        scores = np.round(unit(given) @ unit(asked)[i], dense.DIGITS) + 0.0
        want = [f"{x:05}" for x in np.lexsort((np.arange(20_000), -scores))[:5]]
        mine = rows[rows.query_id == str(i)]
        assert mine.chunk_id.dropna().tolist() == want
        counts = mine[mine.chunk_id.isna()]
        assert dict(zip(counts.dense, counts.n, strict=True)) == {-2.0: 20_000} | ({0.5: int((scores > 0.5).sum())} if i == 3 else {})
