"""The store by deltas against the store built anew."""

import random
import threading

import pytest
from casegraph.operators import merge as M
from casegraph.sources import deltas

SCHEMA = "entity long, kind string, prob double, runs array<string>, n long"


def investigation(spark, seed, n, most=400):
    rng = random.Random(seed)
    rows = [(rng.randrange(most), "ORG", rng.random(), [f"r{seed}"], 1) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def held(df):
    return {r.entity: (r.kind, r.prob, tuple(r.runs), r.n) for r in df.collect()}


def test_deltas_equal_one_build(spark, tmp_path):
    path = str(tmp_path / "store")
    every = None
    for i in range(7):
        new = investigation(spark, i, 50)
        every = new if every is None else every.union(new)
        version = deltas.merge(path, new, M.store_entities, "entity", f"b{i}", buckets=4, most_changes=2)
        assert version.number == i + 1
    assert held(deltas.stored(spark, path, M.store_entities)) == held(M.store_entities(every))
    assert max(len(x) for x in version.folders.values()) <= 3
    again = deltas.merge(path, new, M.store_entities, "entity", "b6")
    assert again.number == 7 and held(deltas.stored(spark, path, M.store_entities)) == held(M.store_entities(every))
    assert deltas.swept(spark, path) > 0 and held(deltas.stored(spark, path, M.store_entities)) == held(M.store_entities(every))


def test_rows_written_follow_the_change(spark, tmp_path):
    path = str(tmp_path / "store")
    big = spark.range(20_000).selectExpr("id as entity", "'ORG' as kind", "0.5D as prob", "array('a') as runs", "1L as n")
    assert deltas.merge(path, big, M.store_entities, "entity", "base", buckets=16).rows_written == 20_000
    small = investigation(spark, 1, 5)
    for i in range(3):
        assert deltas.merge(path, small, M.store_entities, "entity", f"c{i}", buckets=16).rows_written <= 5
    folded = deltas.merge(path, small, M.store_entities, "entity", "c3", buckets=16, most_changes=2)
    assert 5 < folded.rows_written <= 5 * 20_000 / 16 * 2  # the touched buckets at most


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    deltas.merge(path, investigation(spark, 1, 40), M.store_entities, "entity", "a", buckets=4)
    before = held(deltas.stored(spark, path, M.store_entities))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(deltas, "_published", killed)
        with pytest.raises(KeyboardInterrupt):
            deltas.merge(path, investigation(spark, 2, 40), M.store_entities, "entity", "b", buckets=4)
    assert held(deltas.stored(spark, path, M.store_entities)) == before and deltas.current(spark, path).number == 1
    deltas.merge(path, investigation(spark, 2, 40), M.store_entities, "entity", "b", buckets=4)
    both = investigation(spark, 1, 40).union(investigation(spark, 2, 40))
    assert held(deltas.stored(spark, path, M.store_entities)) == held(M.store_entities(both)) and deltas.swept(spark, path) == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    deltas.merge(path, investigation(spark, 0, 10), M.store_entities, "entity", "w0", buckets=4)
    writers = [threading.Thread(target=deltas.merge, args=(path, investigation(spark, i, 30), M.store_entities, "entity", f"w{i}"), kwargs={"buckets": 4}) for i in (1, 2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    every = investigation(spark, 0, 10).union(investigation(spark, 1, 30)).union(investigation(spark, 2, 30))
    assert deltas.current(spark, path).number == 3 and held(deltas.stored(spark, path, M.store_entities)) == held(M.store_entities(every))


def test_a_stream_into_the_store(spark, tmp_path):
    path, source = str(tmp_path / "store"), str(tmp_path / "in")
    for i in range(3):
        investigation(spark, i, 20).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        deltas.keep(stream, path, M.store_entities, "entity", str(tmp_path / "state"), buckets=4).awaitTermination()
    every = investigation(spark, 0, 20).union(investigation(spark, 1, 20)).union(investigation(spark, 2, 20))
    assert held(deltas.stored(spark, path, M.store_entities)) == held(M.store_entities(every)) and len(deltas.current(spark, path).batches) == 3


def test_edges_go_into_the_store_by_canonical_name(spark):
    edges = spark.createDataFrame([("a", "B", "x", ["r1"], 1), ("b", "A", "y", ["r2"], 2), ("a", "e", "x", ["r1"], 1), ("a", "B", "evidence", ["r1"], 1), ("A", "aa", "x", ["r1"], 1), ("c", "B", "x", ["r1"], 1)], "src string, dst string, type string, runs array<string>, n long")
    events = spark.createDataFrame([("e",)], "node string")
    aliases = spark.createDataFrame([("A", "Alpha"), ("AA", "Alpha"), ("B", "Beta")], "alias string, canonical string")
    got = {(r.src, r.dst): (tuple(r.runs), r.n) for r in M.edges_of_store(edges, events, aliases).collect()}
    assert got == {("Alpha", "Beta"): (("r1", "r2"), 3), ("Beta", "c"): (("r1",), 1)}
