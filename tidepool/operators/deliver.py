"""All matches, in checked chunks; pages over a pinned state."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHUNK = 16_384
WORD = 1 << 64


def mixed(value: int) -> int:
    """A 64-bit value with its bits well mixed."""
    value = (value ^ value >> 30) * 0xBF58476D1CE4E5B9 % WORD
    value = (value ^ value >> 27) * 0x94D049BB133111EB % WORD
    return value ^ value >> 31


def splitmix64(value: int) -> int:
    return mixed((value + 0x9E3779B97F4A7C15) % WORD)


def chunks(matches: DataFrame, size: int = 512) -> DataFrame:
    """``matches`` with ``sequence`` (from 0 within a title) and ``position`` in the chunk, by query_id."""
    if not 1 <= size <= MAX_CHUNK:
        raise ValueError(f"chunk size {size}")
    number = F.row_number().over(Window.partitionBy("title_id").orderBy("query_id")) - 1
    return matches.withColumn("_n", number).select("*", F.floor(F.col("_n") / size).cast("long").alias("sequence"), (F.col("_n") % size).cast("long").alias("position")).drop("_n")


def row_hash(query_id: Column, score: Column | None = None) -> Column:
    """A row's 64 bits; a row without a score differs from one with any score."""
    return F.xxhash64(query_id, F.lit("-")) if score is None else F.xxhash64(query_id, F.lit("+"), score)


def summary(matches: DataFrame, size: int = 512) -> DataFrame:
    """``title_id, exact_total, chunk_count, xor, sum``: xor and sum (mod 2^64, as a decimal) of the rows' hashes do not
    depend on the order or on how parts are merged."""
    hashed = row_hash(F.col("query_id"), F.col("score") if "score" in matches.columns else None)
    modulus = F.lit(str(WORD)).cast("decimal(38,0)")
    out = matches.groupBy("title_id").agg(F.count(F.lit(1)).alias("exact_total"), F.bit_xor(hashed).alias("xor"), F.sum(hashed.cast("decimal(20,0)")).cast("decimal(38,0)").alias("_s"))
    return out.select("title_id", "exact_total", F.ceil(F.col("exact_total") / size).alias("chunk_count"), "xor", F.pmod("_s", modulus).cast("decimal(20,0)").alias("sum"))


def idempotency_key(event_id: str, generation: Column, query_id: Column) -> Column:
    return F.sha2(F.concat_ws("\x01", F.lit(event_id), generation.cast("string"), query_id.cast("string")), 256)


def write_stream(matches: DataFrame, path: str, event_id: str, generation: int = 0, size: int = 512) -> None:
    """Chunks as JSON lines, ``match_chunk`` with their members, then the ``completion``: if writing fails there is none."""
    matches = matches.persist()  # told twice, looked for once
    cut = chunks(matches, size)
    fields = [F.col("query_id").alias("logical_id"), *([F.col("score")] if "score" in matches.columns else []), idempotency_key(event_id, F.lit(generation), F.col("query_id")).alias("idempotency_key")]
    frames = cut.groupBy("title_id", "sequence").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("members"))  # a chunk's size at most
    try:
        frames.select(F.lit("match_chunk").alias("type"), "title_id", "sequence", "members").write.json(f"{path}/chunks")
        summary(matches, size).select(F.lit("completion").alias("type"), "*").write.json(f"{path}/completion")
    finally:
        matches.unpersist()


class Cancelled(RuntimeError):
    pass


def deliver(matches: DataFrame, send: Callable[[int, int, list], None], cancelled: Callable[[], bool] = lambda: False, size: int = 512) -> DataFrame:
    """Chunks to a sink in order, held one partition at a time; then the summary, a table, which a failure never reaches."""
    held: list = []
    at: tuple | None = None
    for row in chunks(matches, size).orderBy("title_id", "sequence", "position").toLocalIterator():
        if at is not None and at != (row.title_id, row.sequence):
            send(*at, held)
            held = []
        if cancelled():
            raise Cancelled
        at = row.title_id, row.sequence
        held.append(row)
    if at is not None:
        send(*at, held)
    return summary(matches, size)


class DeadlineError(RuntimeError):
    pass


def within(spark, seconds: float, action: Callable[[], object]) -> object:
    """What ``action`` gives, an action on Spark, if it takes no longer; else its jobs are cancelled and nothing of it comes back."""
    group, late = f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    if seconds <= 0:
        raise DeadlineError(f"{seconds} seconds")
    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    timer.start()
    try:
        out = action()
    except Exception as e:
        if late.is_set():
            raise DeadlineError(f"{seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(name, None)
    if late.is_set():
        raise DeadlineError(f"{seconds} seconds")
    return out


def publish_at_least_once(publish: Callable[[str, bytes], None], key: str, payload: bytes, attempts: int = 3, delay: float = 0.0, cancelled: Callable[[], bool] = lambda: False) -> int:
    """The same keyed frame until it is taken; the number of attempts."""
    for n in range(1, attempts + 1):
        if cancelled():
            raise Cancelled
        try:
            publish(key, payload)
            return n
        except Exception:
            if n == attempts:
                raise
            time.sleep(delay)
    raise ValueError("attempts")


@dataclass
class PointInTime:
    """Pinned states with a time to live that each use renews."""

    ttl: float = 60.0
    longest: float = 600.0
    most: int = 64
    clock: Callable[[], float] = time.monotonic
    open_: dict[str, tuple[object, float, float]] = field(default_factory=dict)

    def open(self, state: object, ttl: float | None = None) -> str:
        self.reap()
        keep = self.ttl if ttl is None else ttl
        if not 0 < keep <= self.longest:
            raise ValueError(f"ttl {keep}")
        if len(self.open_) >= self.most:
            raise RuntimeError("too many open states")
        name = uuid.uuid4().hex
        self.open_[name] = (state, keep, self.clock() + keep)
        return name

    def touch(self, name: str) -> object:
        self.reap()
        state, keep, _ = self.open_[name]
        self.open_[name] = (state, keep, self.clock() + keep)
        return state

    def close(self, name: str) -> object | None:
        return (self.open_.pop(name, None) or (None,))[0]

    def reap(self) -> int:
        dead = [n for n, (_, _, until) in self.open_.items() if until <= self.clock()]
        for n in dead:
            del self.open_[n]
        return len(dead)


class CursorError(ValueError):
    pass


@dataclass(frozen=True)
class Cursors:
    """Tokens for the next page, bound to a pinned state and to the request they continue."""

    secret: bytes

    def sign(self, body: bytes) -> bytes:
        return hmac.new(self.secret, body, hashlib.sha256).digest()

    def make(self, pit: str, request: dict, score: int, query_id: int) -> str:
        told = hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()
        body = json.dumps([pit, told, score, query_id]).encode()
        return base64.urlsafe_b64encode(self.sign(body) + body).decode()

    def pit(self, token: str) -> str:
        return json.loads(base64.urlsafe_b64decode(token)[32:])[0]

    def read(self, token: str, request: dict, states: PointInTime) -> tuple[object, tuple[int, int]]:
        """The pinned state and where to go on."""
        raw = base64.urlsafe_b64decode(token)
        if not hmac.compare_digest(raw[:32], self.sign(raw[32:])):
            raise CursorError("forged")
        pit, told, score, query_id = json.loads(raw[32:])
        if told != hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest():
            raise CursorError("mismatch")
        try:
            return states.touch(pit), (score, query_id)
        except KeyError:
            raise CursorError("stale") from None


@dataclass
class Jobs:
    """Deliveries by event id, each in a thread of its own; one that is there already is returned, not run again.

    ``work`` gets a function that tells whether it is cancelled; its Spark jobs are cancelled as well.  Only a completed job has
    a result, which is handed out once."""

    most: int = 256
    jobs: dict[str, dict] = field(default_factory=dict)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def create(self, event_id: str, spark, work: Callable[[Callable[[], bool]], object]) -> dict:
        with self.lock:
            if event_id in self.jobs:
                return self.status(event_id)
            if len(self.jobs) >= self.most:
                raise RuntimeError("too many jobs")
            job = self.jobs[event_id] = {"id": event_id, "status": "running", "result": None, "error": None, "stop": threading.Event(), "group": f"job-{uuid.uuid4().hex}"}

        def run() -> None:
            spark.sparkContext.setJobGroup(job["group"], event_id, interruptOnCancel=True)
            try:
                result = work(job["stop"].is_set)
                if job["stop"].is_set():
                    raise Cancelled
                job["result"], job["status"] = result, "completed"
            except Exception as e:  # noqa: BLE001  the job's state tells
                job["status"], job["error"] = ("cancelled", None) if job["stop"].is_set() or isinstance(e, Cancelled) else ("failed", str(e))

        job["thread"] = InheritableThread(target=run, daemon=True)
        job["thread"].start()
        return self.status(event_id)

    def status(self, event_id: str) -> dict:
        job = self.jobs[event_id]
        return {k: job[k] for k in ("id", "status", "error")}

    def wait(self, event_id: str, seconds: float | None = None) -> dict:
        self.jobs[event_id]["thread"].join(seconds)
        return self.status(event_id)

    def result(self, event_id: str) -> object:
        """The result of a completed job, to the first who asks."""
        with self.lock:
            job = self.jobs[event_id]
            if job["status"] != "completed" or job["result"] is None:
                raise RuntimeError(f"job {event_id} is {job['status']}" if job["status"] != "completed" else "the result was handed out")
            out, job["result"] = job["result"], None
            return out

    def cancel(self, event_id: str, spark) -> dict:
        job = self.jobs[event_id]
        if job["status"] == "running":
            job["stop"].set()
            spark.sparkContext.cancelJobGroup(job["group"])
        return self.status(event_id)

    def delete(self, event_id: str) -> dict | None:
        """Forgets a job that is over."""
        with self.lock:
            if event_id in self.jobs and self.jobs[event_id]["status"] == "running":
                raise RuntimeError(f"job {event_id} is running")
            job = self.jobs.pop(event_id, None)
        return job and {k: job[k] for k in ("id", "status", "error")}
