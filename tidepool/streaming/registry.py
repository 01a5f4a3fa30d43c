"""The registry of stored queries: a log of operations, the live rows that follow from it, and versions of both."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidepool.functions.vocabulary import Vocabulary
from tidepool.operators.match import QuerySet
from tidepool.sources.loader import parse_bulk

OPS = "seq long, op string, query_id long, query string, version int, tags array<string>, priority long"
SEMANTICS = 1
FEW_IDS = 1000


def accepted(ops: DataFrame, vocabulary: Vocabulary | None = None, accept_class_d: bool = False) -> DataFrame:
    """``ops`` with ``refused`` (why, or null): a query that does not parse or has no positive clause changes nothing."""
    from tidepool.plans.lowering import refused_queries

    vocabulary = vocabulary or Vocabulary()
    analyzer = vocabulary.analyzer()
    writes = refused_queries(ops.where("op <> 'delete'"), analyzer, vocabulary.equivalence_classes(analyzer), accept_class_d)
    return writes.select(*ops.columns, F.col("refusal.kind").alias("refused")).unionByName(ops.where("op = 'delete'").withColumn("refused", F.lit(None).cast("string")))


def live(ops: DataFrame) -> DataFrame:
    """The rows that are live after all operations, from ``ops`` with ``refused``.

    In the order of ``seq``: ``index`` replaces all copies of its id, ``insert`` adds one, ``delete`` removes all, ``create``
    acts where none is live.  What is refused changes nothing, so an older copy stays.

    An id's copies are those since its last replacing operation.  All of it are windows by id over the log, which is
    shuffled once."""
    return standing(ops.where("refused is null")).where("_live").select(F.col("seq").alias("row_id"), "query_id", "query", "version", "tags", "priority", F.col("seq").alias("generation"))


def standing(ops: DataFrame) -> DataFrame:
    """``ops`` with ``_live``: whether the operation's row is live after all of them."""
    by_id = Window.partitionBy("query_id")
    good = F.when(F.col("refused").isNull(), F.col("op"))
    rows = ops.withColumn("_op", good).withColumn("_as", F.when(F.col("_op").isNotNull(), created_as(by_id.orderBy("seq"), F.col("_op"))))
    last = F.max(F.when(F.col("_as").isin("index", "delete"), F.col("seq"))).over(by_id)
    stays = F.col("_as").isin("index", "insert") & (F.col("_last").isNull() | (F.col("seq") >= F.col("_last")))
    return rows.withColumn("_last", last).withColumn("_live", F.coalesce(stays, F.lit(False))).drop("_op", "_as", "_last")


def created_as(by_id: WindowSpec, op: Column) -> Column:
    """``create`` as ``insert`` where nothing is live at that point, else ``conflict``.

    Something is live unless no write stands before it, or the last operation that was no create is a delete and no create
    stands between."""
    before = by_id.rowsBetween(Window.unboundedPreceding, -1)
    last_delete = F.max(F.when(op == "delete", F.col("seq"))).over(before)
    last_write = F.max(F.when(op != "delete", F.col("seq"))).over(before)
    is_live = last_write.isNotNull() & (last_delete.isNull() | (last_write > last_delete))
    return F.when(op != "create", op).when(is_live, F.lit("conflict")).otherwise(F.lit("insert"))


def outcomes(ops: DataFrame) -> DataFrame:
    """``seq, query_id, status``: 201 created, 200 updated or deleted, 404 nothing to delete, 409 there already, 400
    refused.

    Whether an id is live before an operation follows from its last accepted write and delete before it."""
    by_id = Window.partitionBy("query_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("refused").isNull()
    last_delete = F.max(F.when(good & (F.col("op") == "delete"), F.col("seq"))).over(by_id)
    last_write = F.max(F.when(good & (F.col("op") != "delete"), F.col("seq"))).over(by_id)
    is_live = last_write.isNotNull() & (last_delete.isNull() | (last_write > last_delete))
    rows = ops.withColumn("_live", is_live)
    status = F.when(~good, 400).when(F.col("op") == "delete", F.when(F.col("_live"), 200).otherwise(404)).when((F.col("op") == "create") & F.col("_live"), 409).when((F.col("op") == "index") & F.col("_live"), 200).otherwise(201)
    return rows.select("seq", "query_id", status.alias("status"))


def ingest_report(ops: DataFrame) -> DataFrame:
    return outcomes(ops).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


class Conflict(RuntimeError):
    """Another writer was first; what this one wrote is not part of the registry."""


@dataclass
class Registry:
    """A folder of tables with names of their own (``ops/<id>``, ``state/<id>``) and numbered manifests.

    A manifest names the batches of the log, the published states and the next sequence number.  Whatever is written becomes
    part of the registry when the next manifest is put in place, in one rename that fails if that number is there; a crash
    before it leaves tables that nothing names, which ``vacuum`` removes.  Readers keep the tables of the manifest that they
    read, so they never see half an update."""

    spark: SparkSession
    path: str
    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    accept_class_d: bool = False
    observer: Callable[[str, dict], None] = lambda event, info: None

    # --- manifests ---------------------------------------------------------------------------------------------------

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _names(self, kind: str) -> list[str]:
        fs, path = self._fs()
        folder = path(f"{self.path}/{kind}")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def manifest(self, number: int | None = None) -> dict:
        """The manifest of this number, else the newest one; before the first, an empty one."""
        if number is None:
            numbers = [int(n) for n in self._names("manifest") if n.isdigit()]
            if not numbers:
                return {"number": 0, "ops": [], "next_seq": 0, "states": {}, "mask": None}
            number = max(numbers)
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/manifest/{number:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, old: dict, **changes) -> dict:
        """Puts the manifest after ``old`` in place."""
        new = old | changes | {"number": old["number"] + 1}
        fs, path = self._fs()
        jvm = self.spark._jvm
        draft, final = path(f"{self.path}/manifest/draft-{uuid.uuid4().hex}"), path(f"{self.path}/manifest/{new['number']:012d}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"manifest {new['number']} is there already") from e
            self.observer("durability_failure", {"manifest": new["number"]})
            raise
        return new

    def _write(self, kind: str, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{kind}/{name}")
        return name

    # --- the log -----------------------------------------------------------------------------------------------------

    def ops(self, manifest: dict | None = None) -> DataFrame:
        """The log, from the batches that the manifest names."""
        batches = [f"{self.path}/ops/{n}" for n in (manifest or self.manifest())["ops"]]
        return self.spark.read.schema(OPS + ", refused string").parquet(*batches) if batches else self.spark.createDataFrame([], OPS + ", refused string")

    def next_seq(self) -> int:
        return self.manifest()["next_seq"]

    def append(self, ops: DataFrame, replay: bool = False) -> DataFrame:
        """Adds a batch and returns its outcomes.  ``seq`` must continue the log, whatever was compacted since; with
        ``replay`` operations that the log has had already are left out."""
        started = time.time()
        old = self.manifest()
        ops = ops.select("seq", "op", "query_id", "query", F.col("version").cast("int").alias("version"), "tags", "priority")
        if replay:
            ops = ops.where(F.col("seq") >= old["next_seq"])
        name = self._write("ops", accepted(ops, self.vocabulary, self.accept_class_d))
        batch = self.spark.read.schema(OPS + ", refused string").parquet(f"{self.path}/ops/{name}")
        first, last = batch.agg(F.min("seq"), F.max("seq")).first()
        if first is not None and first < old["next_seq"]:
            raise ValueError(f"operation {first} does not continue the log, which is at {old['next_seq']}")
        if first is None:
            return outcomes(batch)
        new = self._commit(old, ops=[*old["ops"], name], next_seq=last + 1)
        self.observer("ingest", {"batch": name, "seconds": time.time() - started})
        log = self.ops(new)
        ids = [r.query_id for r in batch.select("query_id").distinct().limit(FEW_IDS + 1).collect()]
        # few ids go into the log's scan as a filter
        touched = log.where(F.col("query_id").isin(ids)) if len(ids) <= FEW_IDS else log.join(batch.select("query_id").distinct(), "query_id", "left_semi")
        return outcomes(touched).where(F.col("seq") >= first)

    def _one(self, op: str, query_id: int, query: str | None, version: int = 1, tags: list[str] | None = None, priority: int = 0, attempts: int = 5) -> int:
        """One operation; behind another writer's it gets the next number."""
        for attempt in range(attempts):
            row = (self.next_seq(), op, query_id, query, version, tags or [], priority)
            try:
                return self.append(self.spark.createDataFrame([row], OPS)).first().status
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise ValueError("attempts")

    def upsert(self, query_id: int, query: str, **more) -> int:
        return self._one("index", query_id, query, **more)

    def insert(self, query_id: int, query: str, **more) -> int:
        return self._one("insert", query_id, query, **more)

    def create(self, query_id: int, query: str, **more) -> int:
        return self._one("create", query_id, query, **more)

    def delete(self, query_id: int) -> int:
        return self._one("delete", query_id, None)

    def build(self, queries: DataFrame) -> DataFrame:
        """A first or further corpus, ``query_id, query`` and optionally the rest; copies of an id are all live."""
        seq = self.next_seq()
        for name, value in (("version", F.lit(1)), ("tags", F.array().cast("array<string>")), ("priority", F.lit(0).cast("long"))):
            if name not in queries.columns:
                queries = queries.withColumn(name, value)
        rows = queries.select((F.monotonically_increasing_id() + seq).alias("seq"), F.lit("insert").alias("op"), "query_id", "query", "version", "tags", "priority")
        return self.append(rows)

    def bulk(self, body: str) -> list[dict]:
        """A bulk body in the order of its lines: each item's status."""
        rows = parse_bulk(body, self.next_seq())
        good = [tuple(r[k] for k in ("seq", "op", "query_id", "query", "version", "tags", "priority")) for r in rows if r["error"] is None]
        status = {r.seq: r.status for r in self.append(self.spark.createDataFrame(good, OPS)).collect()} if good else {}
        return [{"_id": r["query_id"], "status": status.get(r["seq"], 400), "error": r["error"]} for r in rows]

    def rows(self, manifest: dict | None = None) -> DataFrame:
        return live(self.ops(manifest))

    def get(self, query_id: int) -> dict | None:
        """The newest live copy, or None: the log is read with the id in the scan's filter."""
        row = live(self.ops().where(F.col("query_id") == query_id)).orderBy(F.desc("generation")).first()
        return row.asDict() if row else None

    def has_live(self, query_id: int) -> bool:
        return self.get(query_id) is not None

    # --- states ------------------------------------------------------------------------------------------------------

    def publish(self, mask: list[str] | None = None) -> int:
        """Writes the live rows as a new state.  The hot features are frozen by the first state that has rows, unless given."""
        old = self.manifest()
        name = self._write("state", self.rows(old))
        mask = old["mask"] if mask is None else mask
        if mask is None:
            rows = self.spark.read.parquet(f"{self.path}/state/{name}")
            if rows.limit(1).count():
                built = QuerySet.build(rows, self.vocabulary, accept_class_d=self.accept_class_d)
                mask = list(built.mask.hot)
                built.release()
        number = max(map(int, old["states"]), default=-1) + 1
        about = {"semantics": SEMANTICS, "mask": mask, "vocabulary": self.vocabulary.to_json(), "seq": old["next_seq"]}
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{self.path}/about/{name}")
        self._commit(old, states=old["states"] | {str(number): name}, mask=mask)
        self.observer("flush", {"state": number})
        return number

    def states(self) -> list[int]:
        return sorted(map(int, self.manifest()["states"]))

    def snapshot(self, number: int | None = None, theta: int = 0) -> QuerySet:
        """The queries of a published state, as they were."""
        states = self.manifest()["states"]
        name = states[str(max(map(int, states)) if number is None else number)]
        about = json.loads(self.spark.read.text(f"{self.path}/about/{name}").first().value)
        if about["semantics"] != SEMANTICS:
            raise RuntimeError(f"state of semantics {about['semantics']}")
        rows = self.spark.read.parquet(f"{self.path}/state/{name}")
        return QuerySet.build(rows, Vocabulary.from_json(about["vocabulary"]), theta, self.accept_class_d, about["mask"] or [])

    def compact(self) -> int:
        """The log as what is live, under the old numbers; results do not change, and numbers go on where they were.  The
        batches before it stay until ``vacuum``, for readers that still use them."""
        old = self.manifest()
        rows = self.rows(old).select(F.col("row_id").alias("seq"), F.lit("insert").alias("op"), "query_id", "query", "version", "tags", "priority", F.lit(None).cast("string").alias("refused"))
        new = self._commit(old, ops=[self._write("ops", rows)])
        self.observer("compaction", {"batches": len(old["ops"])})
        return new["number"]

    def maybe_compact(self, most_batches: int = 8, most_holes: float = 0.3) -> bool:
        figures = self.metrics().first()
        if should_compact([1] * len(self.manifest()["ops"]), 0, most_batches, most_holes) or figures.holes > most_holes:
            self.compact()
            return True
        return False

    def vacuum(self, keep_states: int = 1) -> int:
        """Removes tables that the newest manifest does not name, older manifests, and states but the newest ones; how many
        went.  Only when no reader or writer uses them."""
        now = self.manifest()
        kept = dict(sorted(now["states"].items(), key=lambda s: int(s[0]))[-keep_states:]) if keep_states else {}
        if kept != now["states"]:
            now = self._commit(now, states=kept)
        fs, path = self._fs()
        gone = 0
        for kind, names in (("ops", now["ops"]), ("state", kept.values()), ("about", kept.values()), ("manifest", [f"{now['number']:012d}"])):
            for name in set(self._names(kind)) - set(names):
                if fs.delete(path(f"{self.path}/{kind}/{name}"), True):
                    gone += 1
                else:
                    self.observer("cleanup_failed", {"table": f"{kind}/{name}"})
        return gone

    def set_vocabulary(self, vocabulary: Vocabulary) -> int:
        """Every live query must still compile; then all are compiled anew under it, as a new state."""
        vocabulary.aliases.demote_unexpressible(vocabulary.analyzer())
        bad = accepted(self.rows().select(F.col("row_id").alias("seq"), F.lit("insert").alias("op"), "query_id", "query"), vocabulary, True).where("refused is not null")
        if first := bad.first():
            raise ValueError(f"query {first.query_id}: {first.refused}")
        self.vocabulary = vocabulary
        return self.publish()

    def backup(self, path: str) -> None:
        """A registry at ``path`` with what this one's newest manifest names; the manifest is written last."""
        now = self.manifest()
        for kind, names in (("ops", now["ops"]), ("state", now["states"].values())):
            for name in names:
                self.spark.read.parquet(f"{self.path}/{kind}/{name}").write.parquet(f"{path}/{kind}/{name}")
        for name in now["states"].values():
            self.spark.read.text(f"{self.path}/about/{name}").write.text(f"{path}/about/{name}")
        Registry(self.spark, path)._commit(now | {"number": now["number"] - 1})

    def metrics(self) -> DataFrame:
        """One row: operations, live rows, queries, replaced or deleted rows and their share, refusals."""
        return measured(self.ops())

    def segments(self) -> DataFrame:
        """The log's batches: ``batch, position, operations, first_seq, last_seq``."""
        names = self.manifest()["ops"]
        out = self.spark.createDataFrame([], "batch string, position int, operations long, first_seq long, last_seq long")
        for at, name in enumerate(names):
            rows = self.spark.read.parquet(f"{self.path}/ops/{name}")
            out = out.unionByName(rows.agg(F.count(F.lit(1)).alias("operations"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).select(F.lit(name).alias("batch"), F.lit(at).alias("position"), "operations", "first_seq", "last_seq"))
        return out


def measured(ops: DataFrame) -> DataFrame:
    """One row about a log with ``refused``: ``writes, refused, live, queries``, ``gone`` (replaced or deleted) and the share
    ``holes`` of it."""
    told = standing(ops).agg(
        F.count(F.when(F.col("op") != "delete", 1)).alias("writes"),
        F.count("refused").alias("refused"),
        F.count(F.when(F.col("_live"), 1)).alias("live"),
        F.countDistinct(F.when(F.col("_live"), F.col("query_id"))).alias("queries"),
    )  # the log is read once
    gone = F.col("writes") - F.col("refused") - F.col("live")
    return told.withColumn("gone", gone).withColumn("holes", gone / F.greatest(F.col("writes") - F.col("refused"), F.lit(1)))


def should_compact(sizes: list[int], dead: int, most_batches: int = 8, most_holes: float = 0.3) -> bool:
    """Many batches, or many rows that are no longer live."""
    return len(sizes) > most_batches or bool(sizes) and dead / max(1, sum(sizes)) > most_holes


def compaction_range(sizes: list[int], fixed: int = 1000) -> tuple[int, int] | None:
    """The neighbouring batches whose merging costs least for what it saves."""
    best = None
    for i in range(len(sizes)):
        for j in range(i + 2, len(sizes) + 1):
            n = j - i
            cost = (sum(sizes[i:j]) + fixed * n) / (n - 1.9)
            if best is None or cost < best[0]:
                best = (cost, i, j)
    return best and (best[1], best[2])
