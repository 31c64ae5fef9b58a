"""Scalar functions and predicates against small goldens."""

import random
import time

from pyspark.sql import functions as F

from casegraph.functions import dates, names, scores, text
from casegraph.operators import predicates as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_dates(spark):
    iso = lambda s: one(spark, dates.iso_date(F.lit(s)))
    assert iso("Wed, 15 May 2024 12:00:00 GMT") == "2024-05-15"
    assert iso("20240515T120000Z") == "2024-05-15"
    assert iso("2024-10-09T00:00:00Z") == "2024-10-09"
    assert iso("") == iso("not a date") == "" == one(spark, dates.iso_date(F.lit(None).cast("string")))
    near = lambda a, b: one(spark, dates.dates_compatible(F.lit(a), F.lit(b)))
    assert near("2024-05-10", "2024-05-16") and not near("2024-05-10", "2024-05-20")
    assert near("2024-05", "2024-05-16") and not near("2023-12-30", "2024-01-02")


def test_names(spark):
    tokens = one(spark, names.name_tokens(F.lit("U.S. Department of the Treasury")))
    assert set(tokens) == {"US", "DEPARTMENT", "TREASURY"}
    assert one(spark, names.norm_key(F.lit("Seo-Hee"))) == "SEOHEE"
    assert one(spark, names.clean(F.lit(" Not specified in data "))) is None
    assert one(spark, names.clean(F.lit(" x "))) == "x"
    assert one(spark, names.token_run(F.array(F.lit("A"), F.lit("BC")), F.array(F.lit("B")))) is False


def test_valid_names(spark):
    valid = lambda s: one(spark, P.valid_canonical(F.lit(s)))
    assert valid("Helping Hand for Relief and Development")
    assert not valid("ALL OTHER UNIQUE IDENTIFIERS")
    assert not valid("Strike killed many") and not valid("") and not valid("a b c d e f g h")


def test_publishers(spark):
    e = spark.createDataFrame([("Business Insider (US)",), ("Iran",), ("wsj",)], "identifier string")
    p = spark.createDataFrame([("BUSINESS INSIDER",), ("IRAN INTERNATIONAL",), ("WSJ",)], "publisher string")
    assert {r[0] for r in P.publishers_among(e, p).collect()} == {"Business Insider (US)", "wsj"}


def test_rules():
    assert P.valid_rule({"name": "r", "steps": [{"types": ["a"]}], "windowDays": 3})
    assert not P.valid_rule({"name": "", "steps": [{"types": ["a"]}]})
    assert not P.valid_rule({"name": "r", "steps": [{}]})
    assert not P.valid_rule({"name": "r", "steps": [{"types": ["a"]}], "windowDays": "soon"})


def test_ladders(spark):
    label = lambda x: one(spark, scores.ladder(F.lit(x), scores.CONFIDENCE_LADDER, scores.CONFIDENCE_LAST))
    assert label(0.93) == "Almost certain" and label(0.0) == "Almost no chance"
    assert one(spark, text.host(F.lit("https://www.Ex.org:80/a?b"))) == "ex.org"


def test_best_window_of_a_long_text(spark):
    """Windows against a plain search, with breaks, letters beyond 16 bits and a text whose windows were searched for minutes."""
    plain = lambda x, w, s: max(range(0, max(len(x) - w, 1), s), key=lambda i: (sum(x[i : i + w].lower().count(t) for t in ("tion", "aa")), -i))
    rng = random.Random(3)
    some = ["", "tion", "x" * 30, *("".join(rng.choice(["a", "aA", "tion", "TION\n", "\U0001f600", "b", " "]) for _ in range(n)) for n in (7, 12, 19, 40, 41, 200))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(some)] + [(99, None)], "id int, text string")
    for width, stride in ((20, 5), (18, 5), (9, 9)):
        got = {r.id: r.at for r in df.select("id", text.best_window(F.col("text"), ["tion", "aa"], width, stride).alias("at")).collect()}
        assert got == {i: plain(x, width, stride) for i, x in enumerate(some)} | {99: None}
    long = spark.range(4).select(F.concat(F.repeat(F.lit("lorem ipsum "), 200_000), F.lit("tion"), F.repeat(F.lit("lorem ipsum "), 500)).alias("text"))
    started = time.perf_counter()
    assert {r.at for r in long.select(text.best_window(F.col("text"), ["tion"], 900, 200).alias("at")).collect()} == {2_399_200}
    assert time.perf_counter() - started < 30
