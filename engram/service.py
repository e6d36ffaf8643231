"""The façade: eight verbs of a process bound to one brain, and administration."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.errors import EngramError, ValidationError
from engram.functions import clock, jsons
from engram.functions.embedding import Embedder, HashingEmbedder
from engram.functions.text import tokenize
from engram.functions.vectors import check_query_vector
from engram.operators import constraints, lifecycle, scan, search
from engram.schemas import AUDIT_DEFAULT, MEMORIES, PREVIEW, PROFILES, PURGE_BATCH, RECENT_DEFAULT, TOKEN_BUDGETS
from engram.sources.store import Store

#: What ``respond`` answers.
VERBS = ("remember", "search", "recent", "get", "reinforce", "forget", "health", "audit")


class MemoryService:
    """``clock`` gives epoch milliseconds. The brain is bound here and never an argument."""

    def __init__(self, store: Store, *, brain_id: str, clock: Callable[[], int], embedder: Embedder | None = None, profile_id: str = "hash-64", tz: str = "UTC", count_tokens: Callable[[str], int] | None = None) -> None:
        if not brain_id.strip() or ":" in brain_id:
            raise ValidationError("brain_id must not be blank or contain ':'")
        self.store, self.brain_id, self.clock, self.profile_id, self.tz = store, brain_id, clock, profile_id, tz
        self.embedder = embedder or HashingEmbedder()
        self.count_tokens = count_tokens or (lambda t: len(tokenize(t)))
        profile = {"profile_id": profile_id, "revision": "1", "input_version": 2, "dimension": self.embedder.dimension}
        self.profile = profile
        if constraints.register_profile(store.table("profiles"), profile) == "new" and not store.read_only:
            with store.transaction():
                if constraints.register_profile(store.table("profiles"), profile) == "new":
                    store.commit(profiles=store.spark.createDataFrame([tuple(profile.values())], PROFILES))

    # -------------------------------------------------------------- writing

    def remember(self, topic: str, summary: str, *, agent_id: str, catalog: str = "general", content: str = "", importance: int = 3, metadata: dict[str, Any] | None = None, period_start_ms: int | None = None, period_end_ms: int | None = None) -> dict[str, Any]:
        self._budgets(topic=topic, document=f"{topic.replace('-', ' ')}\n{summary.strip()}", content=content)
        if metadata is not None and not isinstance(metadata, dict):
            raise ValidationError("metadata must be an object")
        try:
            meta = jsons.canonical(metadata or {}, ascii_only=True)
        except (TypeError, ValueError) as e:
            raise ValidationError(f"metadata: {e}") from None
        now, ttl = self.clock(), clock.ttl_ms_for(importance)
        vector = [float(x) for x in self.embedder([f"{topic.replace('-', ' ')}\n{summary.strip()}"])[0]]
        name, day = uuid.uuid4().hex, clock.timeline_day_for(now, self.tz)
        row = (name, self.brain_id, agent_id, topic, catalog, summary, content, day, period_start_ms, period_end_ms, now, now, importance, now + ttl, None, meta, self.profile_id, 1, vector)
        rows = self.store.spark.createDataFrame([row], MEMORIES)
        self.store.append_memories(rows, self._event(name, "remember", now, agent_id, {"importance": importance}), dim=self.embedder.dimension)
        return {"memory_id": name, "expires_at": clock.iso(now + ttl, self.tz)}

    def _event(self, name: str, action: str, now: int, agent_id: str, detail: dict) -> DataFrame:
        if bad := jsons.forbidden_path(detail):
            raise ValidationError(f"an event may hold numbers and names only; found a record's field at {bad}")
        row = (uuid.uuid4().hex, self.brain_id, name, agent_id, action, now, clock.timeline_day_for(now, self.tz), jsons.canonical(detail, ascii_only=True))
        return self.store.spark.createDataFrame([row], self.store.table("audit").schema)

    def _mutate(self, name: str, op: str, agent_id: str) -> dict[str, Any]:
        with self.store.transaction():  # judged and written under one lock
            now = self.clock()
            done = lifecycle.apply_one(self.store.memories(self.brain_id, name), op, F.lit(True), now_ms=now).where("outcome = 'applied'").collect()
            if not done:
                return {"ok": False, "reason": "not_found"}
            state = self.store.spark.createDataFrame([(r["brain_id"], r["memory_id"], r["deleted_at_ms"], r["expires_at_ms"], r["removed"]) for r in done], "brain_id string, memory_id string, deleted_at_ms bigint, expires_at_ms bigint, removed boolean")
            self.store.append_lifecycle(state, op, at_ms=now, audit=self._event(name, op, now, agent_id, {}))
        return {"ok": True, "memory_id": name} | ({} if op == "hard_delete" else {"expires_at": clock.iso(done[0]["expires_at_ms"], self.tz)})

    def reinforce(self, memory_id: str, *, agent_id: str) -> dict[str, Any]:
        return self._mutate(memory_id, "reinforce", agent_id)

    def forget(self, memory_id: str, *, agent_id: str) -> dict[str, Any]:
        return self._mutate(memory_id, "forget", agent_id)

    def restore(self, memory_id: str, *, agent_id: str) -> dict[str, Any]:
        return self._mutate(memory_id, "restore", agent_id)

    def hard_delete(self, memory_id: str, *, agent_id: str) -> dict[str, Any]:
        return self._mutate(memory_id, "hard_delete", agent_id)

    def purge_expired(self, max_rows: int = 500) -> int:
        """Tombstones for rows past their time, of all brains."""
        with self.store.transaction():
            now = self.clock()
            gone = lifecycle.purge_expired(self.store.memories(), now_ms=now, max_rows=max_rows)[1].collect()
            if gone:
                rows = [(r["brain_id"], r["memory_id"], None, now, True) for r in gone]
                self.store.append_lifecycle(self.store.spark.createDataFrame(rows, "brain_id string, memory_id string, deleted_at_ms bigint, expires_at_ms bigint, removed boolean"), "purge", at_ms=now)
            return len(gone)

    def purge_retained(self, max_rows: int = PURGE_BATCH) -> int:
        """Remove audit events past retention, of all brains."""
        return self.store.purge_audit(now_ms=self.clock(), max_rows=max_rows)

    # -------------------------------------------------------------- reading

    def search(self, query: str, **filters: Any) -> list[dict[str, Any]]:
        self._budgets(query=query)
        if not query.strip():
            raise ValidationError("the query is blank")
        now = self.clock()
        payload = query.strip()
        vector = check_query_vector([float(x) for x in self.embedder([payload])[0]], self.embedder.dimension)
        q = self.store.spark.createDataFrame([("q", self.brain_id, query, vector)], "query_id string, brain_id string, text string, vector array<double>")
        # Rows of other brains count in the statistics where there is no index.
        found = search.search(self.store.memories(), q, now_ms=now, filters=scan.Filters.of(now_ms=now, **filters), index=self.store.index())
        return [{c: r[c] for c in PREVIEW} for r in found.orderBy("rank").collect()]

    def recent(self, limit: int = RECENT_DEFAULT, **filters: Any) -> list[dict[str, Any]]:
        now = self.clock()
        rows = scan.recent(self.store.memories(), brain_id=self.brain_id, now_ms=now, limit=limit, filters=scan.Filters.of(now_ms=now, **filters))
        return [r.asDict() for r in scan.preview(rows).collect()]

    def current_day(self) -> str:
        """The diary day that it is now."""
        return clock.timeline_day_for(self.clock(), self.tz)

    def today(self) -> list[dict[str, Any]]:
        return self.recent(limit=100, timeline_day=clock.timeline_day_for(self.clock(), self.tz))

    def get(self, memory_id: str) -> dict[str, Any]:
        rows = scan.detail(scan.get(self.store.memories(self.brain_id, memory_id), memory_id, brain_id=self.brain_id, now_ms=self.clock()), tz=self.tz).collect()
        return {"found": True} | rows[0].asDict() | {"metadata": jsons.parse(rows[0]["metadata"])} if rows else {"found": False}

    def audit(self, day: str | None = None, limit: int = AUDIT_DEFAULT) -> list[dict[str, Any]]:
        day = day or clock.timeline_day_for(self.clock(), self.tz)
        return [r.asDict() for r in scan.audit_day(self.store.table("audit"), day, brain_id=self.brain_id, limit=limit).collect()]

    def health(self, *, deep: bool = False) -> dict[str, Any]:
        """A pure read; ``deep`` runs the constraint checks, too."""
        facts = constraints.integrity(self.store.memories(), self.store.table("profiles")).first().asDict()
        ok = facts["orphans"] == 0 and facts["profiles"] == 1
        if deep:
            facts["violations"] = constraints.counted(self.store.memories(), constraints.memory_rules(self.embedder.dimension)).count()
            facts["duplicates"] = constraints.duplicates(self.store.memories()).count()
            ok &= not facts["violations"] and not facts["duplicates"]
        state = {"store_version": self.store.version, "profile": self.profile, "embedder": type(self.embedder).__name__, "timezone": self.tz, "vector_backend": "exact", "indexed": self.store.index() is not None}
        return {"status": "ok" if ok else "degraded", "brain_id": self.brain_id, **state, **facts}

    def respond(self, verb: str, **arguments: Any) -> str:
        """A verb's answer as one JSON object; lists come with their number, refusals as an error."""
        if verb not in VERBS:
            raise ValidationError(f"no such verb: {verb!r}")
        try:
            found = getattr(self, verb)(**arguments)
        except EngramError as e:
            return jsons.canonical({"error": type(e).__name__, "message": str(e)})
        return jsons.canonical({"count": len(found), "results": found} if isinstance(found, list) else found)

    def _budgets(self, **texts: str) -> None:
        over = [f"{k}: {n} tokens, at most {TOKEN_BUDGETS[k]}" for k, t in texts.items() if (n := self.count_tokens(t)) > TOKEN_BUDGETS[k]]
        if over:
            raise ValidationError("; ".join(over))
