"""State, registries, logs and artifacts as tables: one writer for each partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.functions.names import name_tokens
from casegraph.operators.picks import last_wins
from casegraph.operators.resolve import subset_aliases

#: Work by hosts of the domain presets: id, label, hypothesis.
PRESETS = [("general", "General", "The subject is involved in the events reported."), ("sanctions", "Sanctions", "The subject evades sanctions."), ("fraud", "Fraud", "The subject takes part in a fraud.")]


def save_state(df: DataFrame, path: str, session: str) -> None:
    """The session's records replace those it had; other sessions stay."""
    rows = df.withColumn("session_id", F.lit(session))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def load_state(spark: SparkSession, path: str, session: str, schema: str) -> DataFrame:
    """The session's records; none where nothing was saved or the session is new."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(conf).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, session_id string").parquet(path).filter(F.col("session_id") == session).drop("session_id")


def indexed(records: DataFrame) -> DataFrame:
    """The last record of each canonical id."""
    return last_wins(records, ["canonical"], "ord")


def encoded(records: DataFrame) -> DataFrame:
    """Records as JSON without absent fields."""
    return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "true"}).alias("record"))


def decoded(rows: DataFrame, schema: str) -> DataFrame:
    """JSON records with the fields of the schema; what else they hold is in ``extra``."""
    known = [c.split()[0] for c in schema.split(", ")]
    parsed = rows.select(F.from_json("record", schema).alias("r"), F.from_json("record", "map<string,string>").alias("m"))
    return parsed.select("r.*", F.map_filter("m", lambda k, v: ~k.isin(known)).alias("extra"))


def _beside(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store's rows and others, told by ``_new``, with ``_had`` and ``_got``: whether a session
    has rows of the store and of the others.  Both meet in one sort in place of joins."""
    both = store.withColumn("_new", F.lit(False)).unionByName(rows.withColumn("_new", F.lit(True)))
    session = Window.partitionBy("session_id")
    return both.withColumns({"_had": ~F.min("_new").over(session), "_got": F.max("_new").over(session)})


def added(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new sessions; those that it has already are left as they are."""
    met = _beside(store, last_wins(new.select(*store.columns), ["session_id"], "ord"))
    return met.filter(~F.col("_new") | ~F.col("_had") | F.col("session_id").isNull()).select(*store.columns)  # no session is that of a null


def updated(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store with the last change of each session that it has; others are not made."""
    known = changes.filter("session_id is not null").select(*store.columns)
    met = _beside(store, last_wins(known, ["session_id"], "ord"))
    return met.filter(F.when(F.col("_new"), F.col("_had")).otherwise(~F.col("_got"))).select(*store.columns)


def field_of(store: DataFrame, session: str, field: str) -> DataFrame:
    """One row with a field of a session's JSON record, null without it; none without the session."""
    return store.filter(F.col("session_id") == session).select(F.get_json_object("record", f"$.{field}").alias("value"))


def save_collections(collections: dict[str, DataFrame], path: str) -> int:
    """The collections as the next version of a store; readers see it once all are written."""
    spark = next(iter(collections.values())).sparkSession
    version = (latest_version(spark, path) or 0) + 1
    for name, rows in collections.items():
        rows.write.parquet(f"{path}/version={version}/{name}")
    spark.createDataFrame([(sorted(collections),)], "names array<string>").write.parquet(f"{path}/version={version}/_complete")
    return version


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The last version of a store that was written to its end."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_complete/_SUCCESS")
    found = done.getFileSystem(conf).globStatus(done) or []
    return max((int(str(x.getPath()).rsplit("version=", 1)[1].split("/")[0]) for x in found), default=None)


def load_collections(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The collections of the last version, empty ones where nothing was saved."""
    version = latest_version(spark, path)
    if version is None:
        return {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}
    return {name: spark.read.schema(schema).parquet(f"{path}/version={version}/{name}") for name, schema in schemas.items()}


def review_rows(names: DataFrame, known: DataFrame) -> DataFrame:
    """``name, canonical``: names that a registry mints although their tokens stand in a known
    one, or the other way about, for a person to look at; nothing is merged.

    ``names``: name; ``known``: alias (upper case), canonical.
    """
    minted = names.select(F.upper("name").alias("name")).distinct().join(known.select(F.col("alias").alias("name")), "name", "left_anti")
    one = minted.select(F.col("name").alias("id"), name_tokens(F.col("name")).alias("tokens"))
    two = known.select(F.col("alias").alias("id"), name_tokens(F.col("alias")).alias("tokens"))
    pairs = subset_aliases(one, two).union(subset_aliases(two, one).select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(known.select(F.col("alias").alias("b"), "canonical"), "b").select(F.col("a").alias("name"), "canonical").distinct()


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: those that ran or waited have failed.  ``jobs``: id, state, error."""
    lost = F.col("state").isin("running", "queued")
    return jobs.withColumns({"error": F.when(lost, F.lit("interrupted")).otherwise(F.col("error")), "state": F.when(lost, F.lit("failed")).otherwise(F.col("state"))})


def accepted(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """``key, id``: the job of each request: the one that its key has already, else its own first."""
    own = requests.groupBy("key").agg(F.min_by("id", "ord").alias("own"))
    had = jobs.groupBy("key").agg(F.min("id").alias("had"))
    return own.join(had, "key", "left").select("key", F.coalesce("had", "own").alias("id"))


def backlog(lines: DataFrame, after: int) -> DataFrame:
    """Progress of a job that a reader who has seen line ``after`` has missed.  ``lines``: no, line."""
    return progress(lines.filter(F.col("no") > after))


def migrated(legacy: DataFrame, target: DataFrame) -> DataFrame:
    """The target's sessions, or those of a legacy store where the target has none yet: the
    last record of each.  Both: session_id, ord and the same other columns."""
    empty = target.agg((F.count("*") == 0).alias("_empty"))
    taken = last_wins(legacy.select(*target.columns), ["session_id"], "ord").crossJoin(F.broadcast(empty)).filter("_empty").drop("_empty")  # one row
    return target.unionByName(taken)


def enriched(entities: DataFrame, providers: list[tuple[str, Column, DataFrame]]) -> DataFrame:
    """Entities with ``provider`` and what the first provider that applies and knows them has found.

    ``entities`` have a ``key``; a provider is its name, the condition on an entity under
    which it applies, and its answers so far: key, found.
    """
    out = entities.withColumns({"provider": F.lit(None).cast("string"), "found": F.lit(None).cast("string")})
    for name, applies, answers in providers:
        known = answers.select(F.col("key").alias("_k"), F.col("found").alias("_f"))
        out = out.join(known, F.col("provider").isNull() & applies & (F.col("key") == F.col("_k")), "left")
        out = out.withColumns({"provider": F.coalesce("provider", F.when(F.col("_k").isNotNull(), F.lit(name))), "found": F.coalesce("found", "_f")}).drop("_k", "_f")
    return out


def artifact_index(names: DataFrame) -> DataFrame:
    """``base, name, id``: one artifact of each base name, the enriched one if there is one."""
    base = F.regexp_replace("name", r"(\.enriched)?\.json$", "")
    best = names.select(base.alias("base"), "name").groupBy("base").agg(F.max_by("name", F.col("name").endswith(".enriched.json")).alias("name"))
    return best.select("base", "name", F.substring(F.sha2(F.concat("base", F.lit(".json")), 256), 1, 10).alias("id"))


def audit_rows(nodes: DataFrame, chunks: DataFrame, width: int = 1000) -> DataFrame:
    """Nodes with the head of the chunk that named them, for the CSV audit."""
    return nodes.join(chunks, "chunk_id").select("node", "chunk_id", F.substring(F.regexp_replace("text", "[\\r\\n]+", " "), 1, width).alias("text"))


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def progress(lines: DataFrame) -> DataFrame:
    """``stage, done, total`` of log lines like ``[stage] 3/10``."""
    part = lambda i: F.regexp_extract("line", r"^\[(\w+)\] (\d+)/(\d+)", i)
    return lines.filter(F.col("line").rlike(r"^\[\w+\] \d+/\d+")).select(part(1).alias("stage"), part(2).cast("long").alias("done"), part(3).cast("long").alias("total"))


def threads_today(jobs: DataFrame, day: str) -> DataFrame:
    """Threads launched on a day.  ``jobs``: started (ISO), threads (array)."""
    return jobs.filter(F.col("started").startswith(day)).agg(F.coalesce(F.sum(F.size("threads")), F.lit(0)).alias("threads"))


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "id string, label string, hypothesis string")
