"""Coordination: lease conflicts, dispatch lifecycles, progress guard, sessions
(J9-J11, S17, F15, T-1 to T-7, W8, W13, W14, A22)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.config import UsageError, checkpointed
from assay.functions.paths import literal_prefix, path_problem
from assay.functions.text import is_handle, is_name, is_reason

RELEASE_AFTER = 6
SESSIONS = 64


EVERYTHING = ""  # the reach of a glob that starts with a wildcard, and of one that may not be claimed


def reaches(claims: DataFrame) -> DataFrame:
    """Each glob with its reach: the literal segments that it starts with."""
    return claims.withColumn("reach", literal_prefix(F.col("glob")))


def lease_conflicts(claims: DataFrame, held: DataFrame) -> DataFrame:
    """claims(owner, glob) against held(owner, place, glob): per claimed glob and other owner the first glob of
    that owner's lease that overlaps it (J9).

    Two globs overlap if one's reach is the other's or stands above it, so each reach meets the other side's
    reaches and all that stand above those: an equi-join that makes overlapping pairs alone. What reaches
    everything conflicts with all others by that; it is told once, with no partner, and not paired.
    """
    above = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda n: F.array_join(F.slice(F.split(c, "/"), F.lit(1), n), "/"))
    mine = reaches(claims.select("owner", "glob").distinct())
    theirs = reaches(held.select(F.col("owner").alias("other"), "place", "glob")).withColumnRenamed("glob", "their_glob")
    some, held_some = mine.filter(F.col("reach") != EVERYTHING), theirs.filter(F.col("reach") != EVERYTHING)
    below = some.join(held_some.withColumn("reach", F.explode(above(F.col("reach")))), "reach")
    over = some.withColumn("own", F.col("reach")).withColumn("reach", F.explode(above(F.col("reach")))).filter("reach <> own").join(held_some, "reach")
    columns = ["owner", "glob", "other", "place", "their_glob"]
    met = below.select(*columns).unionByName(over.select(*columns)).filter("owner <> other")
    pairs = met.groupBy("owner", "glob", "other").agg(F.min_by("their_glob", "place").alias("their_glob"))
    wide = mine.filter(F.col("reach") == EVERYTHING).select("owner", "glob", F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("their_glob"))
    held_wide = theirs.filter(F.col("reach") == EVERYTHING).select(F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("glob"), "other", "their_glob").distinct()
    return pairs.unionByName(wide).unionByName(held_wide)


def admit_claims(claims: DataFrame) -> DataFrame:
    """claims(turn, owner, globs) in order of their turn: a claim is admitted if none of its globs overlaps one of
    an admitted claim before it, all or nothing (T-6).

    Instead of one claim after the other, claims are decided in rounds: those that are the first of all open claims they
    overlap are admitted, and what overlaps these is refused. No pair of claims is made: a literal path tells its first open
    claim at it and at or below it, and a claim asks the paths that its globs start with. A claim without globs, or with one
    that may not be claimed, is refused.
    """
    refusable = F.coalesce(F.size("globs") <= 0, F.lit(True)) | F.exists("globs", lambda g: path_problem(g).isNotNull())
    asked, claims = claims, claims.filter(~refusable)
    reached = reaches(claims.select("turn", F.explode("globs").alias("glob")))
    least = claims.agg(F.min("turn")).first()[0]
    # what claims everything comes first or not at all, and ends what comes after it
    wide = reached.filter(F.col("reach") == EVERYTHING).select("turn").distinct()
    first_wide = wide.agg(F.min("turn").alias("turn")).first()["turn"]
    parts = F.split("reach", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    paths = reached.filter(F.col("reach") != EVERYTHING).select("turn", "reach", F.explode(above).alias("path")).distinct()
    if first_wide is not None:
        paths = paths.limit(0) if first_wide == least else paths.join(wide, "turn", "left_anti")
    each = paths.select("turn", "path", (F.col("path") == F.col("reach")).alias("own")).groupBy("turn", "path").agg(F.max("own").alias("own"))
    # what lies above all globs tells nothing
    left = checkpointed(each.join(each.filter("own").select("path").distinct(), "path", "left_semi"))
    won = wide.filter(F.col("turn") == F.lit(least)) if first_wide is not None else None
    own = F.col("own")
    while not left.isEmpty():
        first = left.groupBy("path").agg(F.min("turn").alias("below"), F.min(F.when(own, F.col("turn"))).alias("here"))
        met = left.join(first, "path").groupBy("turn").agg(F.min("here").alias("here"), F.min(F.when(own, F.col("below"))).alias("below"))
        winners = checkpointed(met.filter(F.least("here", "below") == F.col("turn")).select("turn"))
        won = winners if won is None else won.unionByName(winners)
        taken = left.join(winners, "turn", "left_semi").groupBy("path").agg(F.max(own).alias("here"))
        beaten = left.join(taken, "path").filter(own | F.col("here")).select("turn").distinct()
        left = checkpointed(left.join(beaten, "turn", "left_anti"))
    won = asked.select("turn").limit(0) if won is None else won
    won = won.distinct().withColumn("admitted", F.lit(True))
    return asked.join(won, "turn", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def block_runs(states: DataFrame, session: str, order: str, state: Column) -> DataFrame:
    """Running count of equal states in a session, from 1 at each change; released above RELEASE_AFTER (W13, T-4)."""
    window = Window.partitionBy(session).orderBy(order)
    changed = F.when(F.lag("state").over(window) == F.col("state"), 0).otherwise(1)
    marked = states.select(session, order, state.alias("state")).withColumn("changed", changed).withColumn("run", F.sum("changed").over(window))
    inside = Window.partitionBy(session, "run").orderBy(order)
    return marked.withColumn("blocks", F.row_number().over(inside).cast("long")).select(session, order, "state", "blocks", (F.col("blocks") > RELEASE_AFTER).alias("released"))


def decision(readable: Column, resolved: Column, ledger_ok: Column, complete: Column, released: Column) -> Column:
    """What the guard does: unreadable requests and unresolved targets are let through, a broken ledger
    blocks, and no progress for too long releases (T-5)."""
    return F.when(~readable | ~resolved, "allow").when(~ledger_ok, "block").when(complete, "allow").when(released, "release").otherwise("block")


def latest(sessions: DataFrame, n: int = SESSIONS) -> DataFrame:
    """The n sessions touched last."""
    return sessions.orderBy(F.desc("updated_at"), "session").limit(n)


def wave_problems(waves: DataFrame) -> DataFrame:
    """Impossible histories of waves (T-2, J10): one row per wave and rule.

    waves(wave, state, leaves array, opened_at, sealed_at, completed_at, abandoned_at, reason,
    started map<leaf, struct<handle, at>>, returned map<leaf, at>).
    """
    state, leaves = F.col("state"), F.col("leaves")
    starts, returns = F.map_entries("started"), F.map_entries("returned")
    start_times, handles = F.transform(starts, lambda e: e["value"]["at"]), F.transform(starts, lambda e: F.trim(e["value"]["handle"]))
    return_times = F.map_values("returned")
    last_start = F.greatest(F.col("opened_at"), F.array_max(start_times))
    all_started, all_returned = F.size("started") == F.size(leaves), F.size("returned") == F.size(leaves)
    needs_seal = state.isin("sealed", "complete") | ((state == "abandoned") & F.col("sealed_at").isNotNull())
    gone = F.col("abandoned_at").isNotNull() | F.col("reason").isNotNull()
    rules = {
        "invalid-state": ~F.coalesce(state.isin("open", "sealed", "complete", "abandoned"), F.lit(False)),
        "invalid-wave-id": ~is_name(F.col("wave")),
        "no-leaves": F.coalesce(F.size(leaves) <= 0, F.lit(True)),
        "invalid-leaf-id": F.exists(leaves, lambda x: ~is_name(x)),
        "duplicate-leaves": F.size(F.array_distinct(leaves)) < F.size(leaves),
        "missing-time": F.col("opened_at").isNull() | F.exists(start_times, lambda t: t.isNull()) | F.exists(return_times, lambda t: t.isNull()) | (state.isin("sealed", "complete") & F.col("sealed_at").isNull()) | ((state == "complete") & F.col("completed_at").isNull()) | ((state == "abandoned") & F.col("abandoned_at").isNull()),
        "stray-abandonment": (state != "abandoned") & gone,
        "abandoned-without-reason": (state == "abandoned") & ~F.coalesce(is_reason(F.trim("reason")), F.lit(False)),
        "unknown-start": F.size(F.array_except(F.map_keys("started"), leaves)) > 0,
        "invalid-handle": F.exists(handles, lambda h: ~F.coalesce(is_handle(h), F.lit(False))),
        "handle-reused": F.size(F.array_distinct(handles)) < F.size(handles),
        "start-before-open": F.exists(start_times, lambda t: t < F.col("opened_at")),
        "return-without-start": F.size(F.array_except(F.map_keys("returned"), F.map_keys("started"))) > 0,
        "return-before-own-start": F.exists(returns, lambda e: e["value"] < F.try_element_at(F.col("started"), e["key"])["at"]),
        "open-with-returns": (state == "open") & (F.size("returned") > 0),
        "sealed-with-missing-starts": (state.isin("sealed", "complete") | needs_seal) & ~all_started,
        "complete-with-missing-returns": (state == "complete") & ~all_returned,
        "sealed-yet-returned": (state == "sealed") & all_returned,
        "sealed-before-last-start": needs_seal & (F.col("sealed_at") < last_start),
        "stray-seal": ~needs_seal & F.col("sealed_at").isNotNull(),
        "return-without-seal": (F.size("returned") > 0) & F.col("sealed_at").isNull(),
        "return-before-seal": F.exists(return_times, lambda t: t < F.col("sealed_at")),
        "complete-before-last-return": (state == "complete") & (F.col("completed_at") < F.greatest(F.col("sealed_at"), F.array_max(return_times))),
        "stray-completion": (state != "complete") & F.col("completed_at").isNotNull(),
        "abandoned-yet-returned": (state == "abandoned") & all_returned,
        "abandoned-before-last-transition": (state == "abandoned") & (F.col("abandoned_at") < F.greatest(last_start, F.col("sealed_at"), F.array_max(return_times))),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), rule) for rule, test in rules.items())), lambda r: r.isNotNull())
    return waves.select("wave", F.explode(broken).alias("rule"))


class Wave:
    """What one wave's events have come to; ``step`` says why an event is refused, or null (T-1)."""

    def __init__(self):
        self.state, self.leaves, self.handles, self.started, self.returned = None, (), set(), set(), set()

    def step(self, action: str, leaves: list[str] | None, leaf: str | None, handle: str | None, reason: str | None) -> str | None:
        handle, reason = (handle or "").strip(), (reason or "").strip()
        if action == "open":
            if self.state:
                return "wave-exists"
            if not leaves or len(set(leaves)) < len(leaves):
                return "duplicate-leaf" if leaves else "no-leaves"
            self.state, self.leaves = "open", tuple(leaves)
            return None
        if self.state is None:
            return "unknown-wave"
        if action == "abandon":
            if self.state in ("complete", "abandoned"):
                return "wave-is-" + self.state
            if not reason or len(reason) > 500:
                return "invalid-reason"
            self.state = "abandoned"
        elif action == "seal":
            if self.state != "open":
                return "wave-is-" + self.state
            if len(self.started) < len(self.leaves):
                return "missing-starts"
            self.state = "sealed"
        elif action in ("start", "return"):
            done = self.started if action == "start" else self.returned
            if self.state != ("open" if action == "start" else "sealed"):
                return "wave-is-" + self.state
            if leaf not in self.leaves:
                return "unknown-leaf"
            if leaf in done:
                return "already-" + {"start": "started", "return": "returned"}[action]
            if action == "start":
                if not handle or len(handle) > 256:
                    return "invalid-handle"
                if handle in self.handles:
                    return "handle-in-use"
                self.handles.add(handle)
            done.add(leaf)
            if len(self.returned) == len(self.leaves):
                self.state = "complete"
        else:
            return "unknown-action"
        return None


EVENT = "wave string, seq long, action string, leaves array<string>, leaf string, handle string, reason string"


def fold_waves(events: DataFrame, parts: int | None = None) -> DataFrame:
    """events in the columns of EVENT, in order of seq: each with why it was refused (null: it was taken), the
    wave's state after it, and its started and returned leaves (T-1). A task holds the state of one wave."""

    def run(batches):
        name, wave = None, Wave()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["wave"] != name:
                    name, wave = row["wave"], Wave()
                refused = wave.step(row["action"], row["leaves"], row["leaf"], row["handle"], row["reason"])
                out.append((refused, wave.state, len(wave.started), len(wave.returned)))
            refused, state, started, returned = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("wave"), batch.column("seq"), batch.column("action"), pa.array(refused, pa.string()), pa.array(state, pa.string()), pa.array(started, pa.int64()), pa.array(returned, pa.int64())],
                ["wave", "seq", "action", "refused", "state", "started", "returned"],
            )

    columns = [part.split()[0] for part in EVENT.replace("array<string>", "array").split(", ")]
    dealt = events.select(*columns).repartition(parts, "wave") if parts else events.select(*columns).repartition("wave")
    return dealt.sortWithinPartitions("wave", "seq").mapInArrow(run, "wave string, seq long, action string, refused string, state string, started long, returned long")


def wave_progress(waves: DataFrame) -> DataFrame:
    """Started and returned of all leaves, and whether the wave blocks (T-3, A22)."""
    return waves.select(
        "wave",
        "state",
        F.size("leaves").cast("long").alias("leaves"),
        F.size("started").cast("long").alias("started"),
        F.size("returned").cast("long").alias("returned"),
        F.when(F.col("state").isin("open", "sealed"), "blocking").when(F.col("state") == "abandoned", "abandoned").otherwise("resolved").alias("effect"),
    )


def progress_line(wave: str = "wave") -> Column:
    """A wave's state with its counts as one item of the state digest (T-3)."""
    of = lambda c: F.concat_ws("/", F.col(c).cast("string"), F.col("leaves").cast("string"))
    return F.concat(F.lit("dispatch:"), F.col(wave), F.lit("="), F.col("state"), F.lit(";started="), of("started"), F.lit(";returned="), of("returned"))


def session_scope(bindings: DataFrame, session: str) -> DataFrame:
    """The scope that a session is bound to, if it is bound to exactly one."""
    return bindings.filter(F.col("session") == session).agg(F.count_distinct("scope").alias("n"), F.min("scope").alias("scope")).filter("n = 1").select("scope")


def resolve_target(scopes: list[str], files: list[str] = (), scope: str | None = None, bound: str | None = None, legacy: list[str] = ()) -> tuple[str, list[str]]:
    """What a run is about: given files, a given scope, the only scope, the session's scope, the files of old
    layouts; several scopes without a choice are refused (S17)."""
    if files:
        return "files", list(files)
    if scope is not None:
        if scope not in scopes:
            raise UsageError(f"no scope {scope!r}")
        return "scope", [scope]
    if len(scopes) == 1:
        return "scope", list(scopes)
    if bound is not None and bound in scopes:
        return "scope", [bound]
    if scopes:
        raise UsageError(f"{len(scopes)} scopes and no choice among them")
    return "legacy", list(legacy)


def release_leases(leases: DataFrame, scope: str, leaf: str | None = None) -> DataFrame:
    """What is left after a scope, or one leaf of it, is released (T-7)."""
    gone = F.col("scope") == scope
    return leases.filter(~(gone & (F.col("leaf") == leaf) if leaf is not None else gone))
