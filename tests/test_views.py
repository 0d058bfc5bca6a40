"""Sums kept over changes equal a rebuild after any sequence of batches, replays and deaths."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import transcripts
from tallyloom.streaming import source, tail, views

T0 = "2026-09-20T10:00:00Z"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "session_id string, generation int, seq long, model string, category string, tokens long, delta int"


def plain(spark, root, **more):
    return views.Views(spark, str(root), sums=("tokens",), finish=lambda df: df, **more)


class Told:
    """What the changes so far amount to, the plain way."""

    def __init__(self):
        self.rows, self.generation = [], {}

    def add(self, batch):
        for r in batch:
            self.generation[r[0]] = max(r[1], self.generation.get(r[0], 0))
        self.rows += batch

    def sums(self):
        out = {}
        for s, g, _, model, category, tokens, delta in self.rows:
            if g == self.generation[s] and delta:
                n, t = out.get((s, model, category), (0, 0))
                out[s, model, category] = (n + delta, t + delta * tokens)
        return {k: v for k, v in out.items() if v[0]}


def read(v):
    return {(r.session_id, r.model, r.category): (r.turns, r.tokens) for r in v.totals().collect()}


@pytest.mark.parametrize("seed", [1])
def test_any_sequence_of_batches_equals_a_rebuild(spark, tmp_path, seed):
    rng, told, v = random.Random(seed), Told(), plain(spark, tmp_path, fold_every=3)
    generation, spoken, seq = dict.fromkeys("abc", 0), [], 0
    for number in range(6):
        batch = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice("abc")
            if rng.random() < 0.25:
                generation[s] += 1
                batch.append((s, generation[s], -1, None, None, None, 0))
            live = [r for r in spoken if r[0] == s and r[1] == generation[s]]
            if live and rng.random() < 0.3:
                old = live[-1]
                spoken.remove(old)
                batch.append((*old[:6], -1))
            seq += 1
            row = (s, generation[s], seq, rng.choice(["m", "n", None]), rng.choice(["code", "git"]), rng.randint(1, 9), 1)
            spoken.append(row)
            batch.append(row)
        df = spark.createDataFrame(batch, SCHEMA)
        if rng.random() < 0.4:  # dies before its mark
            keep = v._set_mark
            v._set_mark = lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
            with pytest.raises(RuntimeError):
                v.put(df, number)
            v._set_mark = keep
            if number:
                assert read(v) == told.sums()  # what the dead batch wrote counts for nothing
        v.put(df, number)
        told.add(batch)
        v.put(df, number)  # a replay after the mark changes nothing
        assert read(v) == told.sums()
    assert v.mark() == (5, 5)
    with pytest.raises(ValueError):
        v.put(df, 12)


def answer(mid, n, cw=0):
    return json.dumps({"type": "assistant", "timestamp": T0, "message": {"role": "assistant", "id": mid, "model": "claude-sonnet-4-6", "content": [], "usage": {"input_tokens": n, "output_tokens": 1, "cache_creation_input_tokens": cw}}}) + "\n"


STOP = json.dumps({"type": "user", "timestamp": T0, "message": {"role": "user", "content": "[Request interrupted by user]"}}) + "\n"


def test_growing_files_to_sums(spark, tmp_path):
    """Bytes to sums: append, interrupt, cut, replace and delete files between polls; the sums equal those of a batch read of what is there."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    logs, root = tmp_path / "logs", tmp_path / "view"
    logs.mkdir()
    v = views.Views(spark, str(root), fold_every=2)

    def poll():
        rows = tail.flat_entries(source.grown_lines(spark, str(logs), str(tmp_path / "state")))
        query = tail.session_turns(rows, idle_ms=None).writeStream.outputMode("update").foreachBatch(v.put).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    def rebuilt():
        turns = transcripts.turns(transcripts.read_lines(spark, str(logs)))
        name = F.regexp_replace("session_id", "^file:/*", "/")
        rows = turns.withColumn("session_id", name).groupBy(*views.KEYS).agg(F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in views.SUMS])
        return sorted(map(str, rows.collect()))

    def held():
        return sorted(map(str, v.totals().select(*views.KEYS, "turns", *views.SUMS).collect()))

    put = lambda name, text, how="a": (logs / name).open(how).write(text)
    put("a.jsonl", answer("a1", 5) + answer("a2", 6, 100))
    put("b.jsonl", answer("b1", 7))
    poll()
    assert held() == rebuilt()
    put("a.jsonl", STOP + answer("a3", 9) + answer("a4", 1)[:20])
    put("b.jsonl", answer("b1", 8), "w")
    poll()
    assert len(held()) == 3
    put("a.jsonl", answer("a4", 1)[20:])
    os.remove(logs / "b.jsonl")
    poll()
    assert held() == rebuilt() and not [r for r in held() if "b.jsonl" in r]
    put("b.jsonl", answer("b9", 3))
    os.truncate(logs / "a.jsonl", len(answer("a1", 5)))
    poll()
    assert held() == rebuilt()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
