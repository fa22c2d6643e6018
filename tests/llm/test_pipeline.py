import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from veilgate.llm import byte_bpe, quality
from veilgate.llm import decontaminate as D
from tests.llm.test_decontaminate import distance
from tests.llm.test_golay_dedup import slow_components, slow_simhash
from tests.llm.test_quality import make


def test_stages_equal_brute_force(spark, docs, tmp_path):
    rng = random.Random(4)
    truth = {i: int(i % 4 != 0) for i in range(120)}
    rows = [(i, make(rng, g)) for i, g in truth.items()]
    item = make(rng, True)[:150]
    rows += [(200 + i, make(rng, True) + " " + item + " " + make(rng, True)) for i in range(4)]
    rows += [(300 + i, rows[i + 1][1]) for i in range(6)] + [(None, rows[1][1]), (None, make(rng, True)), (400, None), (401, "")]
    frame = docs(rows)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, g, 0) for i, g in truth.items()], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    forest = quality.fit(frame, labels)
    good = [(i, t) for i, t in rows if forest.score(__import__("numpy").array([quality.statistics(t)]))[0] >= 0.5]
    components = slow_components([slow_simhash(t) for _, t in good])
    first = {}
    for (i, t), c in zip(good, components, strict=True):
        first[c] = min(first.get(c, (1 << 62, "")), (1 << 61 if i is None else i, t or ""))
    clean = [(i, t) for i, t in first.values() if distance(D.normalise(item), D.normalise(t)) > D.edit_budget(len(D.normalise(item)))]

    current = frame
    sizes = [current.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == frame.columns
        sizes.append(current.count())
    got = sorted((r.doc_id if r.doc_id is not None else 1 << 61, r.text or "") for r in current.collect())
    assert got == sorted(clean)
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]

    ranks = byte_bpe.parse_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    texts = {None if i == 1 << 61 else i: t for i, t in clean}
    assert out == {i: encoding.encode_ordinary(t) for i, t in texts.items()}


def test_empty_documents(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_texts_under_one_id_stay_unless_they_are_copies(spark, docs):
    rng = random.Random(12)
    texts = [make(rng, True) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (1, None), (2, texts[2]), (3, texts[2]), (3, texts[3]), (None, texts[3])]
    got = []
    for some in (rows, rows[::-1]):
        kept = corpus_pipeline.drop_copies(spark, docs(some).repartition(3), "").collect()
        got.append(sorted((r.doc_id, r.text or "") for r in kept))
    assert got[0] == got[1] == sorted([(1, texts[0]), (1, texts[1]), (1, ""), (2, texts[2]), (3, texts[3])])


def test_columns_of_any_name_and_type_come_through(spark, docs, tmp_path):
    rng = random.Random(13)
    rows = [(i, make(rng, True)) for i in range(4)]
    rows += [(4, rows[0][1]), (5, None)]
    extra = docs(rows).selectExpr(
        "*", "'x' AS __key", "doc_id + 1 AS key", "text AS digest", "1 AS score", "2 AS leaks", "map('a', doc_id) AS more",
        "struct(doc_id AS number) AS document", "array(doc_id) AS least", "'t' AS text_of", "'f' AS found", "3 AS __score", "4 AS __leaks",
    )
    spark.createDataFrame([(1, "an item of the benchmark that is nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    want = {r.doc_id: r for r in extra.collect()}
    for stage, kept in ((corpus_pipeline.keep_good, None), (corpus_pipeline.drop_copies, {0, 1, 2, 3, 5}), (corpus_pipeline.drop_leaks, {0, 1, 2, 3, 4, 5})):
        got = stage(spark, extra, str(tmp_path))
        assert got.schema.names == extra.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in extra.schema]
        rows = got.collect()
        assert all(r == want[r.doc_id] for r in rows) and (kept is None or {r.doc_id for r in rows} == kept)
