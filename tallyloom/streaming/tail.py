"""Transcripts that still grow: turns with what is carried between them from a stream of lines, and polls of changed files."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.scratch import written
from ..sources import catalog, transcripts

_OWN = ("seq long, ts_ms long, message_id string, request_id string, in_tok long, out_tok long, cr_tok long, cw_tok long, rs_tok long, cw1h_tok long, cache_ttl string, cache_miss boolean, "
        "is_sidechain boolean, web_searches long, web_fetches long, iterations int, native_usd double, kind string, model string")
_CARRIED = "interrupted boolean, after_compaction boolean, compaction_before long, thinking_level string, prev_ctx long"
_TURN = f"{_OWN}, {_CARRIED}"
_OUT = f"session_id string, generation int, {_TURN}, settled boolean, delta int"
#: Whether a turn is open, and it; then what will mark or price the next one; the last place seen, and in which generation.
_STATE = f"open boolean, {_TURN}, closing boolean, freed long, model_set string, thinking_set string, context long, last long, generation int"
_NAMES = [f.split()[0] for f in _TURN.split(", ")]
_WHOLE = {c for c, kind in (f.split() for f in _OUT.split(", ")) if kind in ("long", "int")}
_FLAGS = {c for c, kind in (f.split() for f in _OUT.split(", ")) if kind == "boolean"}
#: How long a session may be silent before its state is given up.
IDLE_MS = 24 * 3600 * 1000


def flat_entries(lines: DataFrame) -> DataFrame:
    """What ``session_turns`` needs of each line of a batch or a stream: (file, line_no, line), or (file, generation, pos, line) as ``source.grown_lines`` gives them.

    Texts, tools and commands stay behind; of the tools the turn's kind is kept. A row
    without a line opens its generation.
    """
    order = "pos" if "pos" in lines.columns else "line_no"
    numbered = lines.select("file", F.col(order).alias("line_no"), "line", (F.col("generation") if "generation" in lines.columns else F.lit(0)).cast("int").alias("generation"))
    told = transcripts.entries(numbered).withColumns({"is_turn": F.col("harness").isNotNull(), "stop": F.col("interrupt"), "shut": F.col("compacted"), "set_model": F.col("model_set"), "set_thinking": F.col("thinking_set"), "freed_here": F.col("freed")})
    rows = transcripts.described(told).withColumnRenamed("own_model", "model")
    none = {"is_turn": F.lit(False), "stop": F.lit(False), "shut": F.lit(False)}
    opened = numbered.where("line is null").select(F.col("file").alias("session_id"), F.lit(-1).cast("long").alias("seq"), "generation", *[v.alias(k) for k, v in none.items()])
    wanted = ["session_id", "generation", *(n for n in _NAMES if n in rows.columns), *none, "set_model", "set_thinking", "freed_here"]
    return rows.select(*wanted).unionByName(opened, allowMissingColumns=True)


class SessionTurns(StatefulProcessor):
    """The state of one session: its open turn, what the lines since have set, and where it stands."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _STATE)

    def close(self) -> None:
        pass

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _STATE.split(", ")]
        held = dict(zip(names, self.state.get())) if self.state.exists() else dict.fromkeys(names) | {"open": False, "closing": False, "context": 0, "last": -2, "generation": 0}
        told = {n: held[n] for n in _NAMES} if held["open"] else None  # what was put out of the open turn
        turn = dict(told) if told else None
        fresh, out = False, []

        def put(values: dict | None, settled: bool, delta: int) -> None:
            out.append({**(values or {"seq": -1}), "generation": held["generation"], "settled": settled, "delta": delta})

        def say(settled: bool) -> None:
            """Put the turn out if it is new or has changed, taking back what was said of it."""
            if not fresh and (settled or turn != told):
                put(told, False, -1)
            if fresh or settled or turn != told:
                put(turn, settled, 1)

        batch = pd.concat(list(rows)).astype(object)
        batch = batch.where(batch.notna(), None).drop_duplicates(["generation", "seq"]).sort_values(["generation", "seq"])
        for r in batch.to_dict("records"):
            if r["generation"] > held["generation"]:
                out.clear()  # all before is void, and downstream learns it by the generation alone
                turn, told, fresh = None, None, False
                held.update(dict.fromkeys(names) | {"open": False, "closing": False, "context": 0, "last": -1, "generation": int(r["generation"])})
                put(None, True, 0)
            if r["generation"] < held["generation"] or r["seq"] <= held["last"]:
                continue
            held["last"] = int(r["seq"])
            if r["is_turn"]:
                if turn is not None:
                    say(True)
                # columns with nulls come as floats
                turn, fresh = {n: int(r[n]) if n in _WHOLE and r.get(n) is not None else r.get(n) for n in _NAMES}, True
                turn.update(model=r["model"] if r["model"] is not None else held["model_set"], interrupted=False, after_compaction=bool(held["closing"]), compaction_before=held["freed"],
                            thinking_level=held["thinking_set"], prev_ctx=held["context"])
                if not r["is_sidechain"]:
                    held["context"] = int(r["in_tok"] + r["cr_tok"] + r["cw_tok"])
                held["closing"], held["freed"] = False, None
            if r["stop"] and turn is not None:
                turn["interrupted"] = True
            held["closing"] = bool(held["closing"] or r["shut"])
            for name, value in (("model_set", r["set_model"]), ("thinking_set", r["set_thinking"]), ("freed", None if r["freed_here"] is None else int(r["freed_here"]))):
                held[name] = value if value is not None else held[name]
        if turn is not None:
            say(False)
        held.update(turn or dict.fromkeys(_NAMES), open=turn is not None)
        self.state.update(tuple(held[n] for n in names))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            columns = [f.split()[0] for f in _OUT.split(", ")]
            frame = pd.DataFrame(out).assign(session_id=key[0]).reindex(columns=columns)
            # texts as plain objects: pandas' own strings may come in chunks, which the worker cannot send
            yield frame.astype(dict.fromkeys(columns, "object") | dict.fromkeys(_WHOLE, "Int64") | dict.fromkeys(_FLAGS, "boolean") | {"native_usd": "float64"})


def session_turns(rows: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Changes of the turns of a stream of ``flat_entries``: each turn with what the lines around it say (interrupted, after_compaction, prev_ctx, the model and thinking level in force), ``settled`` and ``delta``.

    A session's last turn may yet be interrupted: it is put out open (settled false,
    delta 1) after each micro-batch that changes it; what was said before is taken back
    by an equal row of delta -1, and the next turn settles it. So the sum of deltas of
    equal rows is 1 for what holds and 0 for what does not. A row of delta 0 and seq -1
    opens a generation: all rows of earlier ones are void. Lines of a session must arrive
    in the order of ``seq`` over micro-batches, in any order within one; those at or
    before the last one seen are repeats and are passed over. A session silent for
    ``idle_ms`` loses its state and would begin anew; None keeps it for good, and must be
    passed where the trigger is availableNow, which does not end while a timer may
    strike. Needs the RocksDB state store. A micro-batch's slim rows of one session meet
    in one task: bound them by the source's limit for a trigger.
    """
    mode = "None" if idle_ms is None else "ProcessingTime"
    return rows.groupBy("session_id").transformWithStateInPandas(SessionTurns(idle_ms), _OUT, "Update", mode)


def newest(changes: DataFrame) -> DataFrame:
    """The last word on each turn of each session's last generation."""
    rest = [c for c in changes.columns if c not in ("session_id", "generation", "seq", "settled", "batch", "delta")]
    last = changes.groupBy("session_id").agg(F.max("generation").alias("generation"))
    live = changes.where("delta = 1").join(last, ["session_id", "generation"])
    best = F.max_by(F.struct(*rest, "settled"), F.struct("settled", "interrupted"))
    return live.groupBy("session_id", "generation", "seq").agg(best.alias("b")).select("session_id", "generation", "seq", "b.*")


def poll(spark: SparkSession, root: str, table: str, generation: int, modified_after: str | None = None) -> None:
    """Read anew the transcripts changed since ``modified_after`` (a time like 2026-01-31T23:59:59) and write their turns as a generation.

    A file is read whole, so that a rewritten or cut one retracts what it said before. A
    generation that is written again replaces itself; let polls overlap by some seconds.
    """
    lines = transcripts.read_lines(spark, root, modified_after=modified_after)
    transcripts.turns(lines).write.mode("overwrite").parquet(f"{table}/turns/generation={generation}")
    # last: a generation counts once its files are named
    transcripts.read_files(spark, root, modified_after=modified_after).write.mode("overwrite").parquet(f"{table}/files/generation={generation}")


def poll_changes(spark: SparkSession, root: str, table: str, generation: int) -> None:
    """Read anew the transcripts that differ from the last poll's listing and write their turns as a generation.

    The listings are compared by path, size and time, so that a file rewritten within the
    second is read again, and one that is gone or moved takes back what it said. Only
    files at least as young as the oldest that changed are opened, and of these only the
    changed ones are kept. A generation that is written again replaces itself.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  a local path, as lines have it
    now = catalog.listing(spark, root, skip=transcripts.DERIVED).select(plain("path").alias("path"), "size", "mtime_ms", F.lit(None).cast("bigint").alias("inode"))
    now.write.mode("overwrite").parquet(f"{table}/stamps/generation={generation}")
    stamps = spark.read.schema(now.schema.add("generation", "integer")).parquet(f"{table}/stamps")
    last = stamps.where(F.col("generation") < generation).agg(F.max("generation")).first()[0]
    now, before = (stamps.where(F.col("generation") == g).drop("generation") for g in (generation, -1 if last is None else last))
    changed = written(catalog.changes(before, now))
    fresh = changed.where("change <> 'gone'").select(F.col("path").alias("file"))
    low = now.join(fresh.withColumnRenamed("file", "path"), "path", "left_semi").agg(F.min("mtime_ms")).first()[0]
    if low is not None:
        since = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(low // 1000 - 1))
        transcripts.turns(transcripts.read_lines(spark, root, modified_after=since, only=fresh)).write.mode("overwrite").parquet(f"{table}/turns/generation={generation}")
    # last: a generation counts once its files are named, among them those that are gone and those that moved away
    named = changed.select(F.col("path").alias("file")).union(changed.where("was is not null").select("was"))
    named.write.mode("overwrite").parquet(f"{table}/files/generation={generation}")


def polled(spark: SparkSession, table: str) -> DataFrame:
    """Turns of each transcript's last generation; none for one that holds no turns any more."""
    last = spark.read.schema("file string, generation int").parquet(f"{table}/files").groupBy("file").agg(F.max("generation").alias("generation"))
    rows = spark.read.option("mergeSchema", "true").parquet(f"{table}/turns")
    return rows.join(last.withColumnRenamed("file", "session_id"), ["session_id", "generation"]).drop("generation")
