"""Trees of spawned sessions: reachability, what becomes of each edge, and totals that count a session once.

Edges: root-independent rows (parent, child, pos, ...), pos being the place in the ledger.
Sessions: (session_id, readable, ticks, mtime_ms, untagged, untagged_ticks). Folds: (holder, child, ticks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Milliseconds after which a transcript is no longer being written.
IDLE_MS = 122_000


def normal_ids(edges: DataFrame) -> DataFrame:
    """Ids without the suffix of their file."""
    plain = lambda c: F.regexp_replace(c, r"(?i)\.jsonl$", "").alias(c)
    return edges.withColumns({"parent": plain("parent"), "child": plain("child")})


def reach(edges: DataFrame, roots: DataFrame, inside: DataFrame | None = None, max_depth: int = 5, keep=written) -> DataFrame:
    """The depth at which each session's own edges stand: (root, node, depth), 1 at the root.

    Sessions ``inside`` (root, node) the root's own total stand at depth 2. Each level is
    used twice, so ``keep`` writes it down.
    """
    start = roots.select(F.col("node").alias("root"), "node", F.lit(1).alias("depth"))
    if inside is not None:
        start = start.unionByName(inside.select("root", "node", F.lit(2).alias("depth"))).groupBy("root", "node").agg(F.min("depth").alias("depth"))
    seen, links = keep(start), edges.select("parent", "child").distinct()
    for depth in range(1, max_depth + 1):
        front = seen.where(F.col("depth") == depth).select("root", F.col("node").alias("parent"))
        step = front.join(links, "parent").select("root", F.col("child").alias("node"), F.lit(depth + 1).alias("depth"))
        seen = keep(seen.unionByName(step).groupBy("root", "node").agg(F.min("depth").alias("depth")))
    return seen


def outcomes(edges: DataFrame, reached: DataFrame, sessions: DataFrame, inside: DataFrame, max_depth: int = 5) -> DataFrame:
    """Each edge below a root with its depth, skip (null if counted) and ticks.

    The first edge to a session, by depth and place in the ledger, decides: in the root's
    own total, beyond the depth, no transcript, unreadable, or counted; later edges repeat that.
    """
    own = reached.select("root", F.col("node").alias("parent"), "depth")
    rows = edges.join(own, "parent").join(sessions.withColumnRenamed("session_id", "child"), "child", "left")
    marked = inside.select("root", F.col("node").alias("child"), F.lit(True).alias("is_inside")).distinct()
    rows = rows.join(marked, ["root", "child"], "left").withColumn("is_inside", F.coalesce("is_inside", F.lit(False)) | (F.col("child") == F.col("root")))
    nth = F.row_number().over(Window.partitionBy("root", "child").orderBy((F.col("depth") > max_depth), "depth", "pos"))
    first = F.when(F.col("is_inside"), "in-self-total").when(F.col("depth") > max_depth, "depth-capped").when(F.col("readable").isNull(), "not-found").when(~F.col("readable"), "unreadable")
    rows = rows.withColumn("nth", nth).withColumn("first", F.first(F.coalesce(first, F.lit("counted"))).over(Window.partitionBy("root", "child").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)))
    again = F.when(F.col("first") == "in-self-total", "in-self-total").when(F.col("first") == "counted", "already-counted").when(F.col("first") == "depth-capped", "depth-capped").otherwise("already-seen-unresolved")
    skip = F.when(F.col("nth") > 1, again).otherwise(F.nullif("first", F.lit("counted")))
    return rows.select("root", "parent", "child", "pos", "depth", skip.alias("skip"), F.when(skip.isNull(), F.col("ticks")).alias("ticks"), "mtime_ms", "untagged", "untagged_ticks")


def folds_to_subtract(judged: DataFrame, folds: DataFrame) -> DataFrame:
    """Shares (root, holder, child, ticks) inside a counted holder's total of sessions that are counted themselves."""
    counted = judged.where("skip is null").select("root", F.col("child").alias("id"))
    held = folds.join(counted.withColumnRenamed("id", "holder"), "holder")
    return held.join(counted.withColumnRenamed("id", "child"), ["root", "child"]).where("holder <> child").select("root", "holder", "child", "ticks")


def gaps(judged: DataFrame, folds: DataFrame) -> DataFrame:
    """One row a session whose cost is not known (root, child, reason), unless a counted session folded it."""
    counted = judged.where("skip is null").select("root", F.col("child").alias("holder"))
    folded = folds.join(counted, "holder").select("root", "child").distinct()
    return judged.where("skip in ('not-found', 'unreadable')").select("root", "child", F.col("skip").alias("reason")).join(folded, ["root", "child"], "left_anti")


def live(judged: DataFrame, now_ms: int, idle_ms: int = IDLE_MS) -> DataFrame:
    """Counted edges whose transcript changed within ``idle_ms`` of now."""
    return judged.where(F.col("skip").isNull() & (F.abs(F.lit(now_ms) - F.col("mtime_ms")) < idle_ms))


def tree_totals(judged: DataFrame, folds: DataFrame, malformed: int = 0) -> DataFrame:
    """One row a root: edges, descendants, depth_capped, untagged, unattributed, ticks (each session once), is_floor."""
    less = folds_to_subtract(judged, folds).groupBy("root").agg(F.sum("ticks").alias("less"))
    missing = gaps(judged, folds).groupBy("root").agg(F.count(F.lit(1)).alias("unattributed"))
    sums = judged.groupBy("root").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("skip").isNull()).alias("descendants"), F.count_if(F.col("skip") == "depth-capped").alias("depth_capped"),
        F.sum(F.when(F.col("skip").isNull(), F.coalesce("untagged", F.lit(0))).otherwise(0)).alias("untagged"), F.sum(F.coalesce("ticks", F.lit(0))).alias("all_ticks"))
    out = sums.join(less, "root", "left").join(missing, "root", "left").na.fill(0, ["less", "unattributed"])
    floor = (F.col("unattributed") > 0) | (F.col("depth_capped") > 0) | (F.col("untagged") > 0) | F.lit(malformed > 0)
    return out.select("root", "edges", "descendants", "depth_capped", "untagged", "unattributed", (F.col("all_ticks") - F.col("less")).alias("ticks"), floor.alias("is_floor"))


def outside(sessions: DataFrame, attributed: DataFrame) -> DataFrame:
    """Sessions that no id set attributes already."""
    return sessions.join(attributed.select("session_id").distinct(), "session_id", "left_anti")


def self_attributed(*sets: DataFrame) -> DataFrame:
    """The distinct ids of several one-column sets."""
    out = sets[0].toDF("session_id")
    for s in sets[1:]:
        out = out.union(s.toDF("session_id"))
    return out.distinct()


def walk(edges: DataFrame, roots: DataFrame, sessions: DataFrame, inside: DataFrame, folds: DataFrame, max_depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """The edges below each root judged in the order of a walk, breadth first, and what became of every session.

    Within a level edges are walked by when their parent was queued, then by place in the
    ledger, and each may change what the next one finds: a counted session's total holds
    the sessions it folded (``folds``: holder, child, ticks, and pos, their order in the holder, if known), so a later edge to one of these
    is ``already-counted``, and one that could not be priced before is priced after all.

    Edges: (root, parent, child, pos, depth, skip, ticks), skip null where the session is
    counted and ticks less the shares that stand in a total already. Outcomes: (root, session_id,
    outcome) of in-self, counted, folded and unresolved. ``inside`` (root, node): sessions in
    the root's own total; their edges stand at the second level. A fold's own edges stand two
    levels below the edge that brought it.

    A level is settled in rounds: an edge is settled once no unsettled one before it could
    fold its session. Most levels take one round; a chain of folds within a level one each.
    """
    links = written(edges.select("parent", "child", "pos"))
    nth = F.min("pos") if "pos" in folds.columns else F.lit(0)
    shares = written(folds.where("holder <> child").groupBy("holder", "child").agg(F.sum("ticks").alias("share"), nth.cast("bigint").alias("nth")))
    known = written(roots.select(F.col("node").alias("root"), F.col("node").alias("x")).unionByName(inside.select("root", F.col("node").alias("x"))).distinct().withColumn("state", F.lit("in-self")))
    # where each session's edges stand, and when it was queued there
    start = roots.select(F.col("node").alias("root"), F.col("node").alias("parent"), F.lit(1).alias("depth"), F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("nth"))
    queue = start.unionByName(inside.select("root", F.col("node").alias("parent"), F.lit(2).alias("depth"), F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("nth")))
    queue = written(_first_queued(queue))
    judged = None
    for depth in range(1, max_depth + 3):
        front = queue.where(F.col("depth") == depth).join(links, "parent").join(known.withColumnRenamed("x", "child"), ["root", "child"], "left")
        if judged is not None and not front.limit(1).count():
            if not queue.where(F.col("depth") > depth).limit(1).count():
                break
            continue
        # a sort over all roots at once gives the walk's order; the ids that follow it need not be dense
        level = written(front.orderBy("root", "level", "place", "nth", "parent", "pos").withColumn("at", F.monotonically_increasing_id()).select("root", "parent", "child", "pos", "at", "state"))
        judged_here, known, queued = _settle(level, known, sessions, shares, depth, max_depth)
        judged = judged_here if judged is None else judged.unionByName(judged_here)
        queue = written(_first_queued(queue.unionByName(queued)))
    return judged, known.select("root", F.col("x").alias("session_id"), F.col("state").alias("outcome"))


def _first_queued(queue: DataFrame) -> DataFrame:
    first = F.min(F.struct("depth", "level", "place", "nth")).alias("q")
    return queue.groupBy("root", "parent").agg(first).select("root", "parent", "q.*")


def _settle(level: DataFrame, known: DataFrame, sessions: DataFrame, shares: DataFrame, depth: int, max_depth: int):
    """One level: its judged edges, what is known after it, and whom it queues."""
    first = level.groupBy("root", "child").agg(F.min("at").alias("at"))
    seen = sessions.select(F.col("session_id").alias("child"), "readable", "ticks")
    fresh = level.where("state is null").join(first, ["root", "child", "at"]).join(seen, "child", "left").select("root", "child", "at", "readable", "ticks")
    fresh = written(fresh if depth <= max_depth else fresh.limit(0))
    could = fresh.where("readable").select("root", "child", "at", "ticks")
    # who could fold whom within the level: both are met here for the first time, the holder before
    after = could.select("root", F.col("child").alias("held"), F.col("at").alias("held_at"))
    chain = written(could.select("root", F.col("child").alias("holder"), "at").join(shares.select("holder", F.col("child").alias("held")), "holder").join(after, ["root", "held"]).where("at < held_at").select("root", "holder", "held"))
    settled = could.select("root", "child", F.lit(None).cast("boolean").alias("counts"))
    while True:
        by = chain.join(settled.withColumnRenamed("child", "holder"), ["root", "holder"]).groupBy("root", F.col("held").alias("child")).agg(
            F.bool_or(F.coalesce("counts", F.lit(False))).alias("folded"), F.bool_or(F.col("counts").isNull()).alias("waits"))
        now = F.when(F.coalesce("folded", F.lit(False)), F.lit(False)).when(~F.coalesce("waits", F.lit(False)), F.lit(True))
        settled = written(settled.join(by, ["root", "child"], "left").select("root", "child", F.coalesce("counts", now).alias("counts")))
        if not settled.where("counts is null").limit(1).count():
            break
    counted = written(could.join(settled.where("counts"), ["root", "child"]).select("root", "child", "at", "ticks"))
    # a fold lands if its session is in no total yet when its holder is counted, and only once
    held = counted.select("root", F.col("child").alias("holder"), "at").join(shares.withColumnRenamed("child", "x"), "holder")
    before = known.withColumnRenamed("state", "was")
    visit = counted.select("root", F.col("child").alias("x"), F.col("at").alias("counted_at"))
    events = held.join(before, ["root", "x"], "left").join(visit, ["root", "x"], "left")
    open_ = F.coalesce(F.col("was") == "unresolved", F.lit(True)) & (F.col("counted_at").isNull() | (F.col("at") < F.col("counted_at")))
    events = written(events.select("root", "x", "holder", "at", "share", "nth", open_.alias("open")))
    landed = written(events.where("open").groupBy("root", "x").agg(F.min(F.struct("at", "nth")).alias("f")).select("root", "x", F.col("f.at").alias("fold_at"), "f.nth"))
    taken = events.join(landed, ["root", "x"], "left").where("fold_at is null or at <> fold_at").groupBy("root", F.col("holder").alias("child")).agg(F.sum("share").alias("less"))
    visits = counted.select("root", "child", F.col("at").alias("first_at"), F.lit("counted").alias("became")).unionByName(
        fresh.join(counted.select("root", "child"), ["root", "child"], "left_anti").select("root", "child", F.col("at").alias("first_at"), F.lit("unresolved").alias("became")))
    rows = level.join(visits, ["root", "child"], "left").join(landed.select("root", F.col("x").alias("child"), "fold_at"), ["root", "child"], "left").join(taken, ["root", "child"], "left").join(seen, "child", "left")
    folded_by_now = F.coalesce(F.col("fold_at") < F.col("at"), F.lit(False))
    prior = F.when(F.col("state").isin("in-self", "counted", "folded"), F.col("state")).when(folded_by_now, "folded").when(F.coalesce(F.col("first_at") < F.col("at"), F.lit(False)), F.col("became")).otherwise(F.col("state"))
    skip = (F.when(F.col("prior") == "in-self", "in-self-total").when(F.col("prior").isin("counted", "folded"), "already-counted").when(F.col("prior") == "unresolved", "already-seen-unresolved")
            .when(F.lit(depth > max_depth), "depth-capped").when(F.col("readable").isNull(), "not-found").when(~F.col("readable"), "unreadable"))
    judged = written(rows.withColumn("prior", prior).withColumn("skip", skip).select(
        "root", "parent", "child", "pos", F.lit(depth).alias("depth"), "skip", F.when(F.col("skip").isNull(), F.col("ticks") - F.coalesce("less", F.lit(0))).alias("ticks"), "at"))
    new = visits.select("root", F.col("child").alias("x"), F.col("became").alias("state")).join(landed, ["root", "x"], "full").select("root", "x", F.when(F.col("fold_at").isNotNull(), "folded").otherwise(F.col("state")).alias("state"))
    rank = F.when(F.col("state") == "unresolved", 0).otherwise(1)
    known = written(known.unionByName(new).groupBy("root", "x").agg(F.max_by("state", rank).alias("state")))
    onward = judged.where("skip is null or skip <> 'depth-capped'").select("root", F.col("child").alias("parent"), F.lit(depth + 1).alias("depth"), F.lit(depth).alias("level"), (2 * F.col("at") + 1).alias("place"), F.lit(0).cast("bigint").alias("nth"))
    deeper = landed.select("root", F.col("x").alias("parent"), F.lit(depth + 2).alias("depth"), F.lit(depth).alias("level"), (2 * F.col("fold_at")).alias("place"), "nth")
    return judged.drop("at"), known, onward.unionByName(deeper)


def walked_gaps(judged: DataFrame, outcomes_: DataFrame) -> DataFrame:
    """One row a session whose cost is not known after all (root, child, reason): the first reason given."""
    first = judged.where("skip in ('not-found', 'unreadable')").groupBy("root", "child").agg(F.min_by("skip", F.struct("depth", "pos")).alias("reason"))
    return first.join(outcomes_.where("outcome = 'unresolved'").select("root", F.col("session_id").alias("child")), ["root", "child"], "left_semi")
