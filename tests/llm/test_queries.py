"""The registered queries themselves, on small tables with every odd row, against plain versions."""

import hashlib
import itertools
import zlib
from collections import Counter

import corpus_pipeline as C
import pytest
from casegraph.llm import fingerprints, hot, lmscore, packing, queries, tokencount
from test_operators import brute_clean, brute_losses, sample_texts, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, _row long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts = sample_texts()
    rows = [(i, x, "en", None if i % 9 == 4 else f"h{i % 3}", None, "mine", i) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_op1(spark, folder, texts):
    rows = queries.QUERIES["op1_sharding"](spark, folder).collect()
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op5(spark, folder, texts):
    counter = tokencount.PieceCounter(tokencount.load_vocabulary(tokencount.vocabulary_path()))
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op5_token_counts"](spark, folder).collect()}
    assert got == {k: counter.count_text(x)[1] if x else 0 for k, x in texts.items()}


def test_op6(spark, folder, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op6_fingerprints"](spark, folder).collect()}
    marks = {k: fingerprints.simhash(x or "") for k, x in texts.items()}
    order = sorted(texts, reverse=True)
    for k, after in zip(order, order[1:] + order[:1], strict=True):
        changed = fingerprints.edited(texts[k] or "", texts[after] or "")
        assert got[k].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[k].fingerprint == marks[k].hex()
        near = sum(fingerprints.likeness(marks[k], m) >= 1 - 3 / 128 for j, m in marks.items() if j != k)
        assert got[k].n_near == (near if k % 20 == 0 else None)


def test_op7(spark, folder, texts):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.tokenizer_path())
    rows = queries.QUERIES["op7_packing"](spark, folder).collect()
    total = Counter()
    for r in rows:
        ids = [*exact.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        piece = ids[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)) and r.doc_tokens == len(ids) and r.length == len(piece)
        total[r.doc_id] += r.length
    assert total == {k: len(exact.encode(x or "", add_special_tokens=False).ids) + 1 for k, x in texts.items()}
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        lengths = [(r.offset, r.length) for r in group]
        assert [o for o, _ in lengths] == [sum(n for _, n in lengths[:i]) for i in range(len(lengths))] and sum(n for _, n in lengths) <= 4096


def test_op9(spark, folder, texts):
    rows = [(k, x or "") for k, x in texts.items() if len(words_of(x or "")) < 2000]
    long = [k for k in texts if k not in dict(rows)]
    got = {r.doc_id: r for r in queries.QUERIES["op9_lm_scoring"](spark, folder).collect()}
    assert got.keys() == texts.keys() and all(got[k].n_tokens == len(words_of(x or "")) for k, x in texts.items())
    assert long and all(got[k].score is not None for k in long)
    want = {r[0]: r for r in brute_losses([(k, x or "") for k, x in texts.items()], {i for i in range(30) if i % 2})}
    for k, r in got.items():
        assert (r.target_loss, r.background_loss) == (pytest.approx(want[k][2:]) if want[k][2] is not None else (None, None))
    assert lmscore.WORD_SHARE + lmscore.UNIFORM_SHARE < 1


def test_op10(spark, folder, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op10_line_dedup"](spark, folder).collect()}
    assert {k: r.text for k, r in got.items()} == brute_clean(texts)
    assert all(len(r.first_doc_ids) == r.n_removed_chunks + r.n_removed_passages for r in got.values())


@pytest.mark.parametrize("stage", [name for name, _ in C.STAGES])
def test_stages_of_the_pipeline_take_nothing_and_nulls(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    nothing = spark.createDataFrame([], schema)
    assert dict(C.STAGES)[stage](spark, nothing, "").count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None, "x"), (1, None, "en", None, 3, "x"), (1, None, "en", None, 3, "x"), (2, "", None, "s", 0, None), (None, "some words stand here", "en", "s", 1, None)], schema)
    assert dict(C.STAGES)[stage](spark, odd, "").count() >= 0


def test_pipeline_of_an_empty_table(spark, empty):
    assert C.run(spark, empty).count() == 0


def test_joins_on_hot_keys(spark):
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 7, id) as k", "id")
    table = rows.groupBy("k").count().selectExpr("k", "count as n", "k * 2 as twice")
    got = hot.joined_hot(rows, table.filter("k <> 8"), ["k"]).collect()
    assert len(got) == 8999 and all(r.twice == 2 * r.k for r in got)
    assert hot.hot_limit(table) == 1000 and hot.hot_limit(table.limit(0)) == 1000
