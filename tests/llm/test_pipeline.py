"""The pipeline's stages on a small table, each against what its operator decides."""

from collections import Counter

import corpus_pipeline as C
import pytest
from casegraph.llm.quality import base_failed, features
from casegraph.llm.text import WORD
from test_operators import brute_clean, brute_components, words_of


def rows_of(df):
    assert df.columns == C.COLUMNS
    return df.collect()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(C.STAGES)
    assert list(steps) == ["quality rules", "line dedup", "near dedup", "source mix", "sequence packing"]

    def written(name, df):
        path = str(tmp_path / name.replace(" ", "-"))
        df.write.parquet(path)
        return spark.read.parquet(path)

    ruled = written("quality rules", steps["quality rules"](spark, docs, ""))
    good = {k for k, x in before.items() if not base_failed(features(x)[0], features(x)[4])}
    kept = {r.doc_id: r.text for r in rows_of(ruled)}
    assert kept.keys() <= good and len(kept) >= 0.98 * len(good)

    deduped = written("line dedup", steps["line dedup"](spark, ruled, ""))
    want = {k: x for k, x in brute_clean(kept).items() if words_of(x) or not words_of(kept[k])}
    assert {r.doc_id: r.text for r in rows_of(deduped)} == want

    unique = written("near dedup", steps["near dedup"](spark, deduped, ""))
    components, _ = brute_components(want, 5)
    assert {r.doc_id for r in rows_of(unique)} == set(components.values())

    mixed = written("source mix", steps["source mix"](spark, unique, ""))
    copies = Counter(r.doc_id for r in rows_of(mixed))
    assert max(copies.values()) <= 3 and copies.keys() <= set(components.values())
    budget = sum(len(words_of(r.text)) for r in unique.collect())
    taken = sum(len(words_of(r.text)) for r in mixed.collect())
    assert budget - max(len(words_of(r.text)) for r in unique.collect()) <= taken <= budget

    packed = steps["sequence packing"](spark, mixed, "").collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == copies
    assert WORD == r"[^\x20\x09-\x0D]+"


def test_rows_are_told_apart_by_id_and_text(spark):
    own = lambda tag: " ".join(f"{tag}{i}" for i in range(30))
    near = own("n").replace("n29", "changed")
    texts = [(1, own("a")), (1, own("b")), (2, own("c")), (2, own("c")), (3, own("c")), (None, own("n")), (None, near), (None, None), (None, None), (4, near)]
    df = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in dict(C.STAGES)["near dedup"](spark, df, "").collect())
    assert got == Counter([(1, own("a")), (1, own("b")), (2, own("c")), (4, near), (None, None)])


@pytest.mark.parametrize("stage", ["quality rules", "line dedup"])
def test_each_text_is_read_once_by_the_last_function(spark, stage):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = dict(C.STAGES)[stage](spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
