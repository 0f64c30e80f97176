"""Tables of the memory store: readers that are strict or tolerant, append-only logs, immutable snapshots, keyed tables.

Every table is a folder of Parquet or JSON lines that Spark reads and writes, so
any store that Spark reaches will do. A missing table reads as an empty one.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.rank import latest_wins

EVENT = "id STRING, shardId STRING, content STRING, tokenCount INT, isCore BOOLEAN, tier INT, timestamp STRING, tags ARRAY<STRING>"
CELL = """system STRING, corpusSize BIGINT, modelContext BIGINT, trial INT, queryId STRING, queryKind STRING, chosenOption INT, correctOption INT,
chosenAnswer STRING, correctAnswer STRING, citedEventIds ARRAY<STRING>, relevantEventIds ARRAY<STRING>, correct BOOLEAN, citationPrecision DOUBLE,
citationRecall DOUBLE, citationF1 DOUBLE, inputTokens BIGINT, outputTokens BIGINT, latencyMs BIGINT, meta STRING, timestampIso STRING, error STRING"""
QUERY = """kind STRING, id STRING, question STRING, options ARRAY<STRING>, correctOption INT, correctAnswer STRING, alternativeAnswers ARRAY<STRING>,
relevantEventIds ARRAY<STRING>, category STRING, shardHints ARRAY<STRING>"""
MANIFEST = """shardId STRING, name STRING, description STRING, tags ARRAY<STRING>, status STRING, latestSnapshotId STRING, snapshotIds ARRAY<STRING>,
nEvents BIGINT, tokens BIGINT, createdAt TIMESTAMP, updatedAt TIMESTAMP"""
ENTRY = """id STRING, name STRING, description STRING, tags ARRAY<STRING>, status STRING, snapshotId STRING, tokens BIGINT, fullnessPct DOUBLE,
summaryShort STRING, createdAt TIMESTAMP, updatedAt TIMESTAMP"""
STORED_EVENT = "shardId STRING, snapshotId STRING, eventId STRING, role STRING, content STRING, importance DOUBLE, tags ARRAY<STRING>, createdAt TIMESTAMP"
CHRONICLE = "type STRING, createdAt TIMESTAMP, targetShardId STRING, oldSnapshotId STRING, newSnapshotId STRING, reason STRING, actor STRING"
CACHED = "key STRING, response STRING"
EMBEDDED = "text_sha STRING, vec ARRAY<DOUBLE>"
HAYSTACK = "input STRING, target STRING, question STRING, supporting_facts ARRAY<INT>, supporting_lines ARRAY<INT>"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _schema(kind: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(kind) if isinstance(kind, str) else kind


def read_json(spark: SparkSession, path: str, kind: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines of a declared schema; a malformed line fails the read, or is left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], _schema(kind))
    return spark.read.schema(_schema(kind)).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_queries(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """The queries of a file {version: 1, queries: [...]}; a query of no kind is a choice among options."""
    whole = spark.read.schema(f"version INT, queries ARRAY<STRUCT<{QUERY}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    bad = whole.where(F.coalesce(F.col("version") != 1, F.lit(True))).limit(1).count()
    if bad:
        raise ValueError(f"{path}: version 1 is asked for")
    rows = whole.select(F.explode("queries").alias("q")).select("q.*").withColumn("kind", F.coalesce("kind", F.lit("mcq")))
    return rows.where(F.col("id").isin(ids)) if ids else rows


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result cells; malformed lines are left out, and of a cell's rows the last written wins: by its own time, then that of its file, then its place there."""
    rows = _placed(read_json(spark, path, CELL, strict=False))
    return latest_wins(rows, ["system", "modelContext", "corpusSize", "trial", "queryId"], "timestampIso", "__time", "__file", "__from", "__line").drop("__time", "__file", "__from", "__line")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of files with the file's time and name, where the part that holds them starts, and their order within that part."""
    if not rows.inputFiles():
        return rows.select("*", F.lit(None).cast("timestamp").alias("__time"), F.lit("").alias("__file"), F.lit(0).alias("__from"), F.lit(0).alias("__line"))
    place = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_modification_time", "__time"), ("file_path", "__file"), ("file_block_start", "__from"))]
    return rows.select("*", *place, F.monotonically_increasing_id().alias("__line"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows of files counted from 0, file by file by name, whatever way Spark deals the files to tasks."""
    placed, part = _placed(rows), ["__file", "__from"]
    sizes = placed.groupBy(*part).agg(F.count("*").alias("__n"))  # a row per part of a file
    before = sizes.select(*part, F.coalesce(F.sum("__n").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*part).orderBy("__line")) - 1
    return placed.withColumn("__own", own).join(before, part).withColumn(name, F.col("__before") + F.col("__own")).drop(*part, "__time", "__line", "__own", "__before")


def read_haystack(spark: SparkSession, path: str, task: str, sentences: Column | None = None, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, queries): each row of a long-context set is a shard of its own whose sentences are events. JSON lines or Parquet.

    ``sample``: the first so many rows, if not all.
    """
    from ..functions.text import estimate_tokens, split_sentences

    rows = numbered(spark.read.parquet(path) if path.endswith(".parquet") else read_json(spark, path, HAYSTACK), "idx")
    if sample is not None:
        rows = rows.where(F.col("idx") < sample)
    shard = F.concat(F.lit(f"{task}-"), F.col("idx").cast("string"))
    body = split_sentences(F.col("input")) if sentences is None else sentences
    events = rows.select(shard.alias("shard_id"), F.posexplode(body).alias("place", "content")).select(
        F.concat("shard_id", F.lit("-"), F.col("place").cast("string")).alias("event_id"), "shard_id", "place", "content", estimate_tokens(F.col("content")).alias("token_count")
    )
    held = F.filter(F.transform(body, lambda s, i: F.when(F.contains(F.lower(s), F.lower("target")) & (F.length(s) < 120), i)), lambda i: i.isNotNull())
    lines = F.coalesce(F.col("supporting_lines"), held) if "supporting_lines" in rows.columns else held
    queries = rows.select(F.concat(F.lit(f"b{task}-"), F.col("idx").cast("string")).alias("query_id"), shard.alias("shard_id"), "question", F.col("target").alias("answer"), F.transform(lines, lambda i: F.concat(shard, F.lit("-"), i.cast("string"))).alias("relevant"))
    return events, queries


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """(model_name, task, length, score) of a wide CSV; blank scores are left out."""
    wide = spark.read.option("header", True).option("nullValue", "").csv(path)
    lengths = [c for c in wide.columns if c not in ("model_name", "task")]
    return wide.unpivot(["model_name", "task"], lengths, "length", "score").withColumn("score", F.col("score").try_cast("double")).where("score IS NOT NULL")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(decision, event_id, shard_ids, phase): the bridge table of a nested map of decisions."""
    kind = "decisions MAP<STRING, STRUCT<summary:STRING, shardIds:ARRAY<STRING>, phase:STRING, eventIds:ARRAY<STRING>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("decisions").alias("decision", "d"))
    return rows.select("decision", F.col("d.shardIds").alias("shard_ids"), F.col("d.phase").alias("phase"), F.explode("d.eventIds").alias("event_id"))


def read_documents(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """Agent documents, without byte-order marks and blank lines, of one user if one is named."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where("trim(line) <> ''")
    rows = lines.select(F.from_json("line", "id STRING, content STRING, user_id STRING, timestamp STRING, context STRING", {"mode": "FAILFAST"}).alias("d")).select("d.*")
    return rows.where(F.col("user_id") == user_id) if user_id else rows


def build_corpus(core: DataFrame, fillers: list[DataFrame]) -> DataFrame:
    """Core and filler events of declared tiers in one order; a repeated id fails."""
    whole = core.withColumn("tier", F.lit(0)).withColumn("isCore", F.lit(True))
    for tier, part in enumerate(fillers, 1):
        whole = whole.unionByName(part.withColumn("tier", F.lit(tier)).withColumn("isCore", F.lit(False)))
    again = [r.id for r in whole.groupBy("id").count().where("count > 1").limit(5).collect()]
    if again:
        raise ValueError(f"ids that repeat: {', '.join(again)}")
    return whole.orderBy("tier", "id")


def snapshot_number(snapshot_id: Column) -> Column:
    """The number in a snapshot's id: ids are ordered by it, as S1000 comes after S999."""
    return F.regexp_extract(snapshot_id, r"(\d+)$", 1).cast("long")


class MemoryStore:
    """Tables under one folder, changed by transactions.

    A transaction writes the rows of all its tables into folders of its own and is then published by making one
    file whose name tells its number, its id and its tables. Readers see the tables of published transactions only,
    so one that failed half way has written nothing, and one that is run again under its id replaces what the
    failed one left, or, if it had been published, does nothing. Of a keyed table the latest row of a key is read;
    a transaction costs what it writes, and ``compact`` folds a table into one part when it has many.
    """

    LOGS = ("chronicle", "query_runs", "results", "telemetry", "events", "facts")
    KEYED = {"directory": "id", "manifests": "shardId", "cache": "key", "embeddings": "text_sha", "fact_tails": "key"}

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _names(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def transactions(self) -> list[tuple[str, list[str], bool]]:
        """(number and id, tables, whether it replaces all before it) of each published transaction, in order."""
        parts = [n.split("~") for n in self._names(self.path("_published")) if n.count("~") == 2]
        return [(name, tables.split("+"), kind == "whole") for name, tables, kind in parts]

    def published(self, transaction: str) -> bool:
        return any(name.partition("-")[2] == transaction for name, _, _ in self.transactions())

    def publish(self, transaction: str, tables: dict[str, DataFrame], whole: bool = False) -> bool:
        """Write the tables' rows as one; False if a transaction of this id was published before. Fails if another was published meanwhile."""
        done = self.transactions()
        if any(name.partition("-")[2] == transaction for name, _, _ in done):
            return False
        name = f"{int(done[-1][0].partition('-')[0]) + 1 if done else 1:012d}-{transaction}"
        for table, rows in tables.items():
            if table not in self.LOGS and table not in self.KEYED:
                raise ValueError(f"{table} is no table of the store")
            rows.write.mode("overwrite").parquet(f"{self.path(table)}/part={name}")
        jvm = self.spark._jvm
        fs_of = lambda p: p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        number, folder = name.partition("-")[0], jvm.org.apache.hadoop.fs.Path(self.path("_published"))
        # a number is taken by the one that makes its file; both it and the name are made before the next is
        lock = jvm.org.apache.hadoop.fs.Path(f"{self.path('_published')}/{number}")
        owner = self._owner(lock)
        if owner is None:
            fs_of(folder).mkdirs(folder)
            try:
                out = fs_of(lock).create(lock, False)
                out.writeBytes(transaction)
                out.close()
            except Py4JJavaError as e:
                raise RuntimeError(f"another transaction took number {int(number)}: read again and repeat") from e
        elif owner not in ("", transaction):
            raise RuntimeError(f"another transaction took number {int(number)}: read again and repeat")
        fs_of(folder).create(jvm.org.apache.hadoop.fs.Path(f"{self.path('_published')}/{name}~{'+'.join(tables)}~{'whole' if whole else 'part'}"), True).close()
        return True

    def _owner(self, lock) -> str | None:
        fs = lock.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(lock):
            return None
        return self.spark.read.text(lock.toString()).agg(F.first("value")).first()[0] or ""

    def parts(self, table: str) -> list[str]:
        """The folders of the table's rows, the oldest first."""
        out: list[str] = []
        for name, tables, whole in self.transactions():
            if table in tables:
                out = [name] if whole else [*out, name]
        return [f"{self.path(table)}/part={name}" for name in out]

    def read(self, table: str, kind: str) -> DataFrame:
        schema, paths = _schema(kind), self.parts(table)
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.StringType())])).option("basePath", self.path(table)).parquet(*paths)
        if table in self.KEYED and len(paths) > 1:
            # the newest row of each key, combined before the shuffle
            own = F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])
            rows = rows.groupBy(F.col(self.KEYED[table]).alias("__key")).agg(F.max_by(own, "part").alias("row")).select("row.*")
        return rows.select(*[F.col(f"`{f.name}`") for f in schema.fields])

    def append(self, table: str, rows: DataFrame) -> None:
        if table not in self.LOGS:
            raise ValueError(f"{table} isn't a log")
        self.publish(uuid.uuid4().hex, {table: rows})

    def put(self, table: str, rows: DataFrame) -> None:
        """Rows replace those of their key; only they are written."""
        if table not in self.KEYED:
            raise ValueError(f"{table} has no key")
        self.publish(uuid.uuid4().hex, {table: rows})

    def compact(self, table: str, kind: str) -> None:
        """The table's rows as one part; older parts stay for those who are reading them."""
        if len(self.parts(table)) > 1:
            self.publish(uuid.uuid4().hex, {table: self.read(table, kind)}, whole=True)

    def write_snapshot(self, shard_id: str, snapshot_id: str, events: DataFrame) -> None:
        """A snapshot that is brought in as a whole. Fails if it is there already."""
        events.write.mode("errorifexists").parquet(f"{self.root}/snapshots/shard_id={shard_id}/snapshot_id={snapshot_id}")

    def snapshot_ids(self, shard_id: str) -> list[str]:
        """Snapshots that commits made and those brought in, by number."""
        own = {n.partition("=")[2] for n in self._names(f"{self.root}/snapshots/shard_id={shard_id}") if n.startswith("snapshot_id=")}
        latest = self.read("manifests", MANIFEST).where(F.col("shardId") == shard_id).select("latestSnapshotId").first()
        made = {f"S{n:03d}" for n in range(1, int(latest[0].lstrip("S")) + 1)} if latest else set()
        return sorted(own | made, key=lambda s: (int("".join(c for c in s if c.isdigit()) or 0), s))

    def shard_ids(self) -> list[str]:
        return sorted(r.shardId for r in self.read("manifests", MANIFEST).select("shardId").collect())

    def events(self, shard_id: str | None = None, snapshot_id: str | None = None) -> DataFrame:
        """The events of each shard's latest snapshot, or of one snapshot of a shard, as a corpus. A snapshot holds what
        was written up to it, so rows are stored once and a later commit changes no earlier snapshot."""
        rows = self.read("events", STORED_EVENT)
        if shard_id is not None:
            rows = rows.where(F.col("shardId") == shard_id)
        if snapshot_id is not None:
            rows = rows.where(snapshot_number(F.col("snapshotId")) <= snapshot_number(F.lit(snapshot_id)))
        head = F.concat("shardId", F.lit(":"), "eventId")
        return rows.select(head.alias("event_id"), F.col("shardId").alias("shard_id"), "content", F.ceil(F.length("content") / 4).cast("long").alias("token_count"), F.col("importance").between(0.8, 1).alias("is_core"), "tags")

    def fingerprint(self) -> dict[str, tuple[int, int]]:
        """Of each table but the run log, its rows and an order-free checksum of them."""
        out = {}
        for table in (*self.LOGS, *self.KEYED):
            if table != "query_runs" and (paths := self.parts(table)):
                rows = self.spark.read.parquet(*paths)
                n, own = rows.agg(F.count("*"), F.bit_xor(F.xxhash64(*rows.columns))).first()
                out[table] = (n, own or 0)
        return out

    def cache_stats(self) -> tuple[int, int]:
        """Kept responses and the bytes of them."""
        row = self.read("cache", CACHED).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("response")), F.lit(0))).first()
        return row[0], row[1]

    def cached(self, requests: DataFrame, answer, kind: str = CACHED) -> DataFrame:
        """Each request (key, prompt) with its kept response, else the one that ``answer`` makes of the missing.

        The first answers are written before they are used, so none is asked for twice; those under 5 characters
        are used once and asked for again the next time.
        """
        kept = self.read("cache", kind)
        missing = requests.join(kept.select("key"), "key", "left_anti").dropDuplicates(["key"])
        if not missing.limit(1).count():
            return requests.join(kept, "key", "left")
        at = f"{self.root}/_answers/{uuid.uuid4().hex}"
        answer(missing).select("key", "response").write.parquet(at)
        made = self.spark.read.schema(_schema(kind)).parquet(at)
        good = made.where("length(trim(response)) >= 5")
        if good.limit(1).count():
            self.put("cache", good)
        return requests.join(kept.unionByName(made), "key", "left")

    def embedded(self, texts: DataFrame, embed, kind: str = EMBEDDED) -> DataFrame:
        """``texts`` (text) with ``text_sha`` and ``vec``. Texts whose digest has no kept vector go once to ``embed``, a
        function of a list of texts to a list of vectors that runs over Arrow batches; only their vectors are written."""
        keyed = texts.withColumn("text_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
        kept = self.read("embeddings", kind)
        missing = keyed.join(kept.select("text_sha"), "text_sha", "left_anti").groupBy("text_sha").agg(F.any_value("text").alias("text"))

        def run(batches):
            for batch in batches:
                made = embed([x or "" for x in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("text_sha"), pa.array([[float(v) for v in x] for x in made], pa.list_(pa.float64()))], names=["text_sha", "vec"])

        if missing.limit(1).count():
            self.put("embeddings", missing.mapInArrow(run, kind))
        return keyed.join(self.read("embeddings", kind), "text_sha")
