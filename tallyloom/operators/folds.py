"""Sessions that a turn spawned, folded into it: whom each turn meets, whom these met in turn, and what all of them add.

A session counts once for each session above it, by what it spent itself, whatever the
number of ways that lead to it; ways that come back end where they began.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, shell
from .scratch import together, written

SHARES = ("cost_ticks", "in_tok", "out_tok", "cr_tok", "cw_tok", "rs_tok")
#: How far a child's first line may be from its turn.
REACH_MS = 15_000
#: Tables of rounds that are read beside each other before they are written as one.
MOST_TABLES = 32


def spawns(turns: DataFrame, directories: DataFrame) -> DataFrame:
    """The folders in which the agents that a turn starts may have written: session_id, seq, ts_ms, slug.

    ``turns`` has commands as given to the shell; ``directories`` (session_id, cwd) stands
    in where a command names none.
    """
    own = turns.where(F.size("commands") > 0).join(directories.select("session_id", F.col("cwd").alias("_own")), "session_id", "left")
    found = shell.all_spawn_directories(F.col("commands"), F.col("_own"))
    slugs = F.array_distinct(F.flatten(F.transform(found, names.slugs)))
    return own.select("session_id", "seq", "ts_ms", F.explode(slugs).alias("slug"))


def met(spawned: DataFrame, sessions: DataFrame, reach_ms: int = REACH_MS) -> DataFrame:
    """(parent, seq, child): each session (session_id, slug, first_ms) with every turn of another in its folder that began within ``reach_ms`` of it.

    Nearness is equality on buckets as wide as the reach: a session meets its own and the two beside it.
    """
    near = sessions.select(F.col("session_id").alias("child"), "slug", "first_ms", F.explode(F.array(*[F.floor(F.col("first_ms") / reach_ms) + d for d in (-1, 0, 1)])).alias("_bucket"))
    both = spawned.withColumn("_bucket", F.floor(F.col("ts_ms") / reach_ms)).join(near, ["slug", "_bucket"])
    inside = both.where((F.abs(F.col("first_ms") - F.col("ts_ms")) <= reach_ms) & (F.col("child") != F.col("session_id")))
    return inside.groupBy(F.col("session_id").alias("parent"), "child").agg(F.min("seq").alias("seq"))


def folded(claims: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(root, child, seq): every session that one claims, or that a claimed one claims in turn, with the first turn of the root that leads to it.

    ``claims`` (parent, seq, child) may form cycles: no way passes through its root, and a
    round takes up only what it found or found earlier. Rounds go level by level until
    one brings nothing new, as many as the longest chain. Null ids claim nobody.

    A round writes only what it found. Its joins are by sorting: the files of ids are small
    for their rows, and a side chosen for broadcast by their size would pass through the
    driver in every round.
    """
    new = written(claims.where("parent is not null and child is not null and parent <> child").groupBy(F.col("parent").alias("root"), "child").agg(F.min("seq").alias("seq")))
    hops = new.select(F.col("root").alias("_via"), F.col("child").alias("_next")).hint("merge")
    found = [new]
    for _ in range(most_rounds):
        further = new.join(hops, new["child"] == hops["_via"]).where("_next <> root").select("root", F.col("_next").alias("child"), "seq", F.lit(None).cast(new.schema["seq"].dataType).alias("was"))
        known = together(found)
        # the smallest turn wins; a row is taken up again only if its turn got smaller
        best = known.withColumn("was", F.col("seq")).unionByName(further).groupBy("root", "child").agg(F.min("seq").alias("seq"), F.min("was").alias("was"))
        new = written(best.where("was is null or seq < was").drop("was"))
        if not new.limit(1).count():
            return smallest(known)
        found = [*found, new] if len(found) < MOST_TABLES else [written(smallest(known)), new]
    raise ValueError(f"chains of claims go on beyond {most_rounds} rounds")


def smallest(known: DataFrame) -> DataFrame:
    return known.groupBy("root", "child").agg(F.min("seq").alias("seq"))


def own_shares(turns: DataFrame) -> DataFrame:
    """What each session spent in its own collapsed turns."""
    return turns.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in SHARES])


def inclusive(turns: DataFrame, inside: DataFrame, own: DataFrame) -> DataFrame:
    """``turns`` (collapsed) with what their folded sessions spent added to them, ``folds``, the ids of these in order, and ``n_folds``, how many they are.

    Who needs no ids selects ``n_folds`` alone: then no row holds all sessions below a root.
    ``inside``: (root, child, seq) of ``folded``; ``own``: ``own_shares``. What a folded
    session spent includes nothing of those it folded itself: they stand in ``inside`` too.
    """
    shares = own.select(F.col("session_id").alias("child"), *[F.col(c).alias(f"_{c}") for c in SHARES])
    added = inside.join(shares.hint("merge"), "child", "left").groupBy(F.col("root").alias("session_id"), "seq").agg(
        F.array_sort(F.collect_set("child")).alias("folds"), F.count("child").alias("n_folds"), *[F.sum(f"_{c}").alias(f"_{c}") for c in SHARES])
    plus: dict[str, Column] = {c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).cast("bigint") for c in SHARES}
    out = turns.join(added.hint("merge"), ["session_id", "seq"], "left").withColumns({**plus, "folds": F.coalesce("folds", F.array().cast("array<string>")), "n_folds": F.coalesce("n_folds", F.lit(0)).cast("bigint")})
    return out.select(*turns.columns, "folds", "n_folds")


def held_shares(inside: DataFrame, own: DataFrame) -> DataFrame:
    """(holder, child, ticks): what each session's total holds of every session it folded."""
    return inside.join(own.select(F.col("session_id").alias("child"), F.col("cost_ticks").alias("ticks")).hint("merge"), "child").select(F.col("root").alias("holder"), "child", "ticks")
