"""The engine as one object: a registry, a vocabulary, profiles and what can be asked of them."""

from __future__ import annotations

import secrets
import time
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession

from tidepool.functions.dsl import Limits
from tidepool.functions.vocabulary import Vocabulary
from tidepool.operators import deliver, inspect, learn, rank
from tidepool.operators.match import QuerySet
from tidepool.sources import loader
from tidepool.streaming.registry import Registry

UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(text: str) -> float:
    """``250ms``, ``2s``, ``1m``, ``1h``."""
    for unit, factor in UNITS.items():
        if text.endswith(unit) and text[: -len(unit)].isdigit():
            return int(text[: -len(unit)]) * factor
    raise ValueError(f"time {text!r}")


@dataclass(frozen=True)
class Settings:
    accept_class_d: bool = False
    include_broad: bool = False
    theta: int = 0
    default_size: int = 1000
    chunk_size: int = 512
    pit_ttl: float = 60.0

    def updated(self, patch: dict) -> Settings:
        """All of a patch or nothing: unknown names and other types are refused."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        for name, value in patch.items():
            if name not in kinds or type(value) is not kinds[name] and not (kinds[name] is float and type(value) is int):
                raise ValueError(f"setting {name}={value!r}")
        return replace(self, **patch)


@dataclass
class Percolator:
    spark: SparkSession
    path: str
    settings: Settings = field(default_factory=Settings)
    profiles: dict[str, rank.Profile] = field(default_factory=lambda: rank.load_profiles('{"version": 1, "profiles": {}}'))
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self) -> None:
        self.registry = Registry(self.spark, self.path, Vocabulary(), self.settings.accept_class_d)
        self.pits = deliver.PointInTime(self.settings.pit_ttl)
        self.jobs = deliver.Jobs()
        self.cursors = deliver.Cursors(secrets.token_bytes(32))
        self.feedback_seen = None
        self._state: QuerySet | None = None
        self._dirty = not self.registry.states()

    # --- writing -----------------------------------------------------------------------------------------------------

    def load(self, path: str) -> DataFrame:
        """Adds a CSV or JSON lines file and publishes; returns its errors."""
        queries, errors = loader.load_file(self.spark, path)
        self.registry.build(queries)
        self._dirty = True
        return errors

    def bulk(self, body: str) -> list[dict]:
        out = self.registry.bulk(body)
        self._dirty = True
        return out

    def put(self, query_id: int, query: str, create: bool = False, **more) -> int:
        status = (self.registry.create if create else self.registry.upsert)(query_id, query, **more)
        self._dirty = True
        return status

    def delete(self, query_id: int) -> int:
        status = self.registry.delete(query_id)
        self._dirty = True
        return status

    def refresh(self) -> int:
        """Publishes a new state, which later reads see.  Reads do so themselves after writes, once for all of them."""
        number = self.registry.publish()
        self._state, self._dirty = None, False
        return number

    def set_vocabulary(self, vocabulary: Vocabulary) -> int:
        number = self.registry.set_vocabulary(vocabulary)
        self._state, self._dirty = None, False
        return number

    # --- vocabulary --------------------------------------------------------------------------------------------------

    def live_queries(self) -> DataFrame:
        return self.registry.rows().select("query_id", "query")

    def learn_and_apply(self, **how) -> Vocabulary:
        """Learns from the live queries; what the vocabulary says already stays."""
        learned = self.registry.vocabulary.merge(learn.learn_vocabulary(self.live_queries(), **how))
        self.set_vocabulary(learned)
        return learned

    def _copy(self) -> Vocabulary:
        return Vocabulary.from_json(self.registry.vocabulary.to_json())

    def learn_aliases(self, min_count: int = 2) -> int:
        """Any-of groups of the live queries as learned aliases; queries are compiled anew if some became active."""
        vocabulary = self._copy()
        active = learn.learn_aliases(self.live_queries(), vocabulary.aliases, min_count, vocabulary.analyzer())
        if active:
            self.set_vocabulary(vocabulary)
        else:
            self.registry.vocabulary = vocabulary
        return active

    def discover_aliases(self, **how) -> tuple[int, int, int]:
        """Distributional pairs of the live queries as candidates, which change no query."""
        return learn.record_candidates(learn.discover_pairs(self.live_queries(), glue=True, **how), self.registry.vocabulary.aliases, self.registry.vocabulary.analyzer())

    def import_solr(self, text: str) -> int:
        """A synonym file's groups as declared aliases; queries are compiled anew."""
        vocabulary = self._copy()
        groups = vocabulary.aliases.import_solr(text, vocabulary.analyzer())
        self.set_vocabulary(vocabulary)
        return len(groups)

    def candidate_pairs(self) -> list[tuple[str, str]]:
        return [a.forms for a in self.registry.vocabulary.aliases.entries.values() if a.status == "candidate" and len(a.forms) == 2]

    def observe(self, titles: DataFrame) -> None:
        """Counts what titles tell of the candidate pairs."""
        seen = learn.observe(titles, self.state().match(titles, "with_broad"), self.candidate_pairs())
        seen = seen[0].persist(), seen[1].persist()
        self.feedback_seen = learn.merged(self.feedback_seen, seen)

    def alias_feedback(self, min_overlap: float = 0.5, min_titles: int = 50, min_queries: int = 20) -> list[dict]:
        """The report on the candidate pairs from all titles observed: a row for each pair."""
        if self.feedback_seen is None:
            return []
        return [r.asDict() for r in learn.report(self.feedback_seen, self.live_queries(), self.candidate_pairs(), min_overlap, min_titles, min_queries).collect()]

    def apply_feedback(self, activate: bool = False, **bounds) -> tuple[int, int]:
        """The report as evidence in the alias registry; with ``activate`` validated pairs become active and queries are
        compiled anew.  How many pairs were known, and became active."""
        vocabulary = self._copy()
        known, active = vocabulary.aliases.apply(self.alias_feedback(**bounds), activate)
        if active:
            self.set_vocabulary(vocabulary)
        else:
            self.registry.vocabulary = vocabulary
        return known, len(active)

    # --- reading ---------------------------------------------------------------------------------------------------------

    def state(self) -> QuerySet:
        if self._dirty:
            self.refresh()
        if self._state is None:
            self._state = self.registry.snapshot(theta=self.settings.theta)
        return self._state

    def titles(self, titles: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(titles)), "title_id long, title string")

    def scope(self, include_broad: bool | None) -> str:
        return "with_broad" if (self.settings.include_broad if include_broad is None else include_broad) else "standard"

    def search(self, body: dict, include_broad: bool | None = None) -> DataFrame:
        """``title_id, query_id, score, rank`` for a search body with one document or several."""
        titles, wanted = loader.parse_search(body)
        spec = body.get("rank", {})
        boosts = tuple((b["key"], b["value"], b["boost"]) for b in spec.get("boosts", []))
        found = rank.scored(self.state(), self.titles(titles), rank.compat_score(boosts, spec.get("priority_key", "")), self.scope(include_broad), wanted)
        return rank.page(found, body.get("from", 0), body.get("size", self.settings.default_size))

    def top(self, titles: DataFrame, size: int, spec: rank.RankSpec | None = None, tags: dict | None = None, scope: str = "standard", search_after: tuple[int, int] | None = None) -> DataFrame:
        found = rank.scored(self.state(), titles, replace(spec or rank.RankSpec(), profiles=self.profiles), scope, tags)
        return rank.top_k(found, size, search_after)

    def batch_top(self, titles: DataFrame, size: int, spec: rank.RankSpec | None = None, tags: dict | None = None, scope: str = "standard") -> DataFrame:
        return rank.batch_top_k(self.state(), titles, replace(spec or rank.RankSpec(), profiles=self.profiles), size, scope, tags)

    def open_pit(self, ttl: float | None = None) -> str:
        """Pins the state as it is now; later writes do not change what is read from it."""
        return self.pits.open(self.state(), ttl)

    def ranked_page(self, title: str, size: int, pit: str | None = None, cursor: str | None = None, spec: rank.RankSpec | None = None, tags: dict | None = None, scope: str = "standard") -> tuple[list, str | None]:
        """A page of a title's ranked matches over a pinned state, and the cursor of the next page (None after the last).

        All pages together are what one ranked read of that state gives.  A cursor goes on with the request it came from only."""
        spec = replace(spec or rank.RankSpec(), profiles=self.profiles)
        asked = {"title": title, "size": size, "tags": tags or {}, "scope": scope, "rank": [spec.profile, spec.priority_field, [list(b) for b in spec.boosts]]}
        if (pit is None) == (cursor is None):
            raise ValueError("a page needs a pinned state or a cursor")
        if cursor is None:
            state, after = self.pits.touch(pit), None
        else:
            state, after = self.cursors.read(cursor, asked, self.pits)
            pit = self.cursors.pit(cursor)
        rank.check_size(size)
        found = rank.top_k(rank.scored(state, self.titles([title]), spec, scope, tags), size + 1 if size < rank.MAX_K else size, after).orderBy("rank").collect()
        rows = found[:size]
        more = len(found) > size or size == rank.MAX_K and len(found) == size
        return rows, self.cursors.make(pit, asked, rows[-1].score, rows[-1].query_id) if more and rows else None

    def match(self, titles: DataFrame, scope: str = "standard", tags: dict | None = None) -> DataFrame:
        return self.state().match(titles, scope, tags)

    def match_within(self, titles: DataFrame, deadline: float, scope: str = "standard", tags: dict | None = None) -> list:
        """The matches, if they are there within ``deadline`` seconds; else an error and none of them."""
        return deliver.within(self.spark, deadline, lambda: self.match(titles, scope, tags).collect())

    def start_delivery(self, event_id: str, titles: DataFrame, path: str, scope: str = "with_broad") -> dict:
        """Writes all matches of titles in the background; ``jobs`` tells how it goes and can cancel it."""
        state = self.state()

        def work(cancelled) -> str:
            if cancelled():
                raise deliver.Cancelled
            deliver.write_stream(state.match(titles, scope), path, event_id, size=self.settings.chunk_size)
            return path

        return self.jobs.create(event_id, self.spark, work)

    def explain(self, query_id: int, title: str) -> dict:
        from pyspark.sql import functions as F

        return inspect.explain(self.state(), self.titles([title]).withColumn("query_id", F.lit(query_id).cast("long"))).first().asDict()

    def health(self) -> dict:
        """``green``; ``yellow`` if operations are not published yet or the log should be compacted; ``red`` if it cannot be
        read."""
        started = time.time()
        try:
            row = self.registry.metrics().first().asDict()
        except Exception as e:  # noqa: BLE001  that is what is told
            return {"status": "red", "seconds": time.time() - started, "error": str(e)}
        waits = self._dirty or row["holes"] > 0.3 or len(self.registry.manifest()["ops"]) > 8
        return {"status": "yellow" if waits else "green", "seconds": time.time() - started, **row}

    def metrics_text(self) -> str:
        return "".join(f"tidepool_{k} {v}\n" for k, v in self.registry.metrics().first().asDict().items())
