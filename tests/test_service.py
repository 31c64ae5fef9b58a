"""The search service as a data source, with a stand-in for the service."""

import json

import pytest
from casegraph.sources import connectors, service
from pyspark.sql import functions as F

STAND_IN = '''
import json, os

def answer(query, day=None):
    with open(os.environ.get("STAND_IN_LOG", LOG), "a") as f:
        f.write(f"{query} {day}\\n")
    if query == "bad":
        raise TimeoutError("late")
    return json.dumps({"items": [{"title": f"{query} {day or ''}".strip(), "link": "https://www.a.example/x", "snippet": "s"}]})
'''


@pytest.fixture(scope="module")
def stand_in(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("service")
    log = folder / "log"
    log.write_text("")
    (folder / "stand_in_service.py").write_text(f"LOG = {str(log)!r}\n{STAND_IN}")
    spark.sparkContext.addPyFile(str(folder / "stand_in_service.py"))
    service.register(spark)
    return log


def options(**more):
    return {"fetcher": "stand_in_service:answer", "queries": json.dumps(["one", "bad", "two", "one"]), "each": 2, **more}


def test_queries_in_partitions_and_failures_as_rows(spark, stand_in):
    df = spark.read.format("search_service").options(**options()).load()
    assert df.rdd.getNumPartitions() == 2
    got = {r.query: (r.response is not None, r.error) for r in df.collect()}
    assert got == {"one": (True, None), "two": (True, None), "bad": (False, "TimeoutError: late")}
    articles = connectors.web_search(df)
    assert sorted(r.title for r in articles.collect()) == ["one", "two"]
    empty = spark.read.format("search_service").options(**options(queries="[]")).load()
    assert empty.count() == 0


def test_only_what_is_wanted_is_asked(spark, stand_in):
    stand_in.write_text("")
    df = spark.read.format("search_service").options(**options()).load()
    assert [r.query for r in df.filter(F.col("query") == "two").collect()] == ["two"]
    assert set(stand_in.read_text().split("\n")) - {""} == {"two None"}
    assert df.filter(F.col("query").isin("one", "nobody")).count() == 1


def test_a_stream_goes_on_where_it_stopped(spark, stand_in, tmp_path):
    seen = []
    for until in ("2024-01-02", "2024-01-02", "2024-01-04"):
        stream = spark.readStream.format("search_service").options(**options(queries='["one", "two"]', since="2024-01-01", until=until)).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(sorted((r.query, r.day) for r in spark.read.schema(service.SCHEMA).parquet(str(tmp_path / "out")).collect()))
    days = lambda n: sorted((q, f"2024-01-0{d}") for q in ("one", "two") for d in range(1, n + 1))
    assert seen == [days(2), days(2), days(4)]
