"""Workflow graphs and the state of runs: readiness, closure, layers, stalls, checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import discard, materialize


def ready(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Blocked tasks (run, task, status) all of whose dependencies (run, task, needs) have passed."""
    passed = tasks.groupBy("run", F.col("task").alias("needs")).agg(F.min(F.coalesce(F.col("status") == "passed", F.lit(False))).alias("_passed")).where("_passed")
    open_ = deps.join(passed, ["run", "needs"], "left_anti").select("run", "task")
    return tasks.where("status = 'blocked'").join(open_, ["run", "task"], "left_anti").select("run", "task")


def layers(edges: DataFrame) -> DataFrame:
    """node and layer, the longest path from a root, of a graph (up, down); one join for each layer.

    A path can't have more edges than there are nodes, so a layer beyond their number, or nodes without any, mean that
    there is a cycle: a ValueError.
    """
    edges = materialize(edges.select("up", "down").distinct(), "edges")
    nodes = edges.select(F.col("up").alias("node")).union(edges.select("down")).distinct()
    front = materialize(nodes.join(edges.select(F.col("down").alias("node")), "node", "left_anti").withColumn("layer", F.lit(0)), "layer")
    found = front
    most = nodes.count()
    for k in range(1, most + 1):
        front = materialize(edges.join(front.withColumnRenamed("node", "up"), "up").select(F.col("down").alias("node")).distinct().withColumn("layer", F.lit(k)), "layer")
        if not front.limit(1).count():
            out = found.groupBy("node").agg(F.max("layer").alias("layer"))
            if out.count() < most:
                break
            return out
        found = materialize(found.unionByName(front).groupBy("node").agg(F.max("layer").alias("layer")), "found")
    if not most:
        return found
    raise ValueError("the graph has a cycle")


def closure(edges: DataFrame) -> DataFrame:
    """node and reach: all that lies downstream of each node of a graph (up, down), cycles included.

    Each round doubles the length of paths: all pairs so far, put behind the pairs of just so many steps. A path is cut
    at one place only, so that a pair comes up once for each of its paths, and the rounds grow with the logarithm of
    the longest one. What is returned is written.
    """
    found = jumps = materialize(edges.select(F.col("up").alias("node"), F.col("down").alias("reach")).where("node IS NOT NULL AND reach IS NOT NULL").distinct(), "found")
    while True:
        ahead = jumps.select("node", F.col("reach").alias("via"))
        step = ahead.join(found.withColumnRenamed("node", "via"), "via").select("node", "reach").distinct()
        new = materialize(step.join(found, ["node", "reach"], "left_anti"), "reach")
        if not new.limit(1).count():
            return found
        jumps = materialize(ahead.join(jumps.withColumnRenamed("node", "via"), "via").select("node", "reach").distinct(), "jumps")
        found = found.unionByName(new)


def stalled(runs: DataFrame, tasks: DataFrame, events: DataFrame, now, quiet_minutes: int, horizon_hours: int = 24) -> DataFrame:
    """Active runs without a live task but with one that waits, whose last event is quiet_minutes old, within the horizon."""
    live = tasks.where(F.col("status").isin("dispatched", "running", "submitted")).select("run")
    waits = tasks.where(F.col("status").isin("blocked", "ready")).select("run")
    last = events.groupBy("run").agg(F.max("ts").alias("last"))
    age = F.unix_micros(now) - F.unix_micros("last")
    active = runs.where("status = 'active'").join(live, "run", "left_anti").join(waits, "run", "left_semi").join(last, "run")
    return active.where((age >= quiet_minutes * 60_000_000) & (age < horizon_hours * 3_600_000_000)).select("run", "last")


#: Open edges from which on one task goes through them in order, whatever their number at first.
LAST_EDGES = 20_000


def _in_one_task(todo: DataFrame, used: DataFrame, cap: int) -> DataFrame:
    """What one pass in order takes of LAST_EDGES edges or fewer, with what their ends have taken already."""
    count = used.select(F.col("v"), F.col("n"))
    rows = todo.join(count.select(F.col("v").alias("a"), F.col("n").alias("na")), "a", "left").join(count.select(F.col("v").alias("b"), F.col("n").alias("nb")), "b", "left")
    rows = rows.select("a", "b", "rank", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    kinds = ", ".join(f"{c} {todo.schema[c].dataType.simpleString()}" for c in ("a", "b", "rank"))

    def work(batches):
        taken: dict = {}
        for t in batches:
            keep = []
            for i, (a, b, na, nb) in enumerate(zip(*(t.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True)):
                taken.setdefault(a, na), taken.setdefault(b, nb)
                if taken[a] < cap and taken[b] < cap:
                    taken[a] += 1
                    taken[b] += 1
                    keep.append(i)
            yield t.take(pa.array(keep, pa.int32())).select(["a", "b", "rank"])

    return rows.coalesce(1).sortWithinPartitions("rank").mapInArrow(work, kinds)


def capped_edges(edges: DataFrame, cap: int, last_edges: int = LAST_EDGES) -> DataFrame:
    """The edges (a, b, rank) that greedy selection in the order of rank takes, with at most cap at each end.

    rank tells edges apart; an edge has two different ends. In a round, an end that has taken n edges vouches for the
    first cap - n of its open ones: even if all of those are taken, each of them fits. An edge for which both ends vouch
    is taken; one with a full end is dropped. That is what one pass in order does, and the first open edge of all is
    taken in each round. Only the first cap edges of an end are shuffled, as each task keeps cap of them, so that a node
    may have any number. In an order that is not chosen against it a round decides a good part of the open edges; the
    last ones, last_edges or fewer, are gone through in order in one task, long chains in the order of rank included.
    """
    todo = materialize(edges.select("a", "b", "rank"), "todo")
    used = None
    taken = []
    while (left := todo.count()) > last_edges:
        ends = todo.select(F.col("a").alias("v"), "a", "b", "rank").union(todo.select("b", "a", "b", "rank"))
        first = ends.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("rank"))).where(F.col("place") <= cap)
        if used is not None:
            first = first.join(used, "v", "left").where(F.col("place") <= cap - F.coalesce("n", F.lit(0)))
        now = materialize(first.groupBy("a", "b", "rank").agg(F.count("*").alias("ends")).where("ends = 2").select("a", "b", "rank"), "taken")
        taken.append(now)
        both = now.select(F.col("a").alias("v")).union(now.select("b")).groupBy("v").agg(F.count("*").alias("n"))
        sums = both if used is None else both.union(used.select("v", "n")).groupBy("v").agg(F.sum("n").alias("n"))
        before, used = used, materialize(sums, "used")
        full = used.where(F.col("n") >= cap).select("v")
        rest = todo.join(now.select("rank"), "rank", "left_anti").select("a", "b", "rank")
        for end in ("a", "b"):
            rest = rest.join(full.withColumnRenamed("v", end), end, "left_anti")
        gone, todo = todo, materialize(rest.select("a", "b", "rank"), "todo")
        discard(gone, *([before] if before is not None else []))
    if used is None:
        used = todo.select(F.col("a").alias("v"), F.lit(0).cast("long").alias("n")).limit(0)
    out = todo.limit(0) if not left else _in_one_task(todo, used, cap)
    for part in taken:
        out = out.unionByName(part)
    return out


#: How a stage may be handed out, and what it may do.
DISPATCH_MODES = ("", "auto", "manual", "hub")
ACTION = "^(|read|platform_write:.+)$"


#: Nodes of a graph up to which its paths are bits of a long for each node.
SMALL = 64


def _edges(stages: DataFrame, deps: DataFrame) -> DataFrame:
    """Edges (graph, up, down) between stages that exist."""
    known = stages.select("graph", "node")
    edges = deps.select("graph", F.col("needs").alias("up"), F.col("node").alias("down")).distinct()
    return edges.join(known.withColumnRenamed("node", "up"), ["graph", "up"], "left_semi").join(known.withColumnRenamed("node", "down"), ["graph", "down"], "left_semi")


def _of_small(stages: DataFrame, deps: DataFrame) -> DataFrame:
    """What _of_large gives, for graphs of SMALL nodes at most: a row for each graph, whose node k is bit k."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, k.cast("int"))
    has = lambda mask, k: mask.bitwiseAND(bit(k)) != 0
    union = lambda items, of: F.aggregate(items, zero, lambda m, x: m.bitwiseOR(of(x)))
    at = lambda masks, k: F.get(masks, k)
    kind = stages.schema["node"].dataType
    both = stages.select("graph", F.struct("node", "is_merge").alias("s"), F.lit(None).cast(f"struct<up:{kind.simpleString()},down:{kind.simpleString()}>").alias("d"))
    both = both.union(deps.select("graph", F.lit(None), F.struct(F.col("needs").cast(kind).alias("up"), F.col("node").cast(kind).alias("down"))))
    rows = both.groupBy("graph").agg(F.array_sort(F.collect_list("s")).alias("s"), F.collect_set("d").alias("d")).where(F.size("s") > 0)
    # As a column of a generator each value is computed once; projections are merged, and lambdas would compute it anew for each node.
    held = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))
    rows = held(held(rows, "nodes", F.col("s.node")), "ks", F.sequence(F.lit(0), F.size("s") - 1))
    place = lambda x: (F.array_position("nodes", x) - 1).cast("int")
    pairs = F.filter(F.transform("d", lambda e: F.struct(place(e.up).alias("u"), place(e.down).alias("v"))), lambda e: (e.u >= 0) & (e.v >= 0))
    rows = held(rows, "e", pairs)
    rows = held(rows, "next", F.transform("ks", lambda k: union(F.filter("e", lambda e: e.u == k), lambda e: bit(e.v))))
    rows = held(rows, "before", F.transform("ks", lambda k: union(F.filter("e", lambda e: e.v == k), lambda e: bit(e.u))))
    through = lambda masks, k: F.transform(masks, lambda m: F.when(has(m, k), m.bitwiseOR(at(masks, k))).otherwise(m))
    rows = held(rows, "reach", F.aggregate("ks", F.col("next"), through))
    rows = held(rows, "led", union(F.filter("ks", lambda k: at(F.col("before"), k) == 0), lambda k: at(F.col("reach"), k)))
    rows = held(rows, "merges", union(F.filter("ks", lambda k: F.coalesce(F.get("s", k).is_merge, F.lit(False))), bit))
    # A round takes away all nodes that nothing left leads to; a node's layer is the number of rounds that it outlasts.
    left = lambda last: union(F.filter("ks", lambda k: has(last, k) & (at(F.col("before"), k).bitwiseAND(last) != 0)), bit)
    rounds = F.aggregate("ks", F.array(union(F.col("ks"), bit)), lambda done, _: F.concat(done, F.array(left(F.get(done, F.size(done) - 1)))))
    rows = held(rows, "rounds", F.slice(rounds, 2, SMALL))
    entry = lambda k: at(F.col("before"), k) == 0
    out = F.transform("ks", lambda k: F.struct(
        at(F.col("nodes"), k).alias("node"), entry(k).alias("entry"), (at(F.col("next"), k) == 0).alias("terminal"), has(at(F.col("reach"), k), k).alias("in_cycle"),
        (entry(k) | has(F.col("led"), k)).alias("reached"), (at(F.col("reach"), k).bitwiseAND(F.col("merges")) != 0).alias("merged"), F.size(F.filter("rounds", lambda r: has(r, k))).alias("depth")))
    return rows.select("graph", F.inline(out))


def _of_large(stages: DataFrame, deps: DataFrame) -> DataFrame:
    """graph, node, entry, terminal, in_cycle, reached, merged and depth of graphs of any size, by joins along all paths."""
    edges = materialize(_edges(stages, deps), "edges")
    key = lambda n: F.struct("graph", F.col(n).alias("node")).alias(n)
    pairs = closure(edges.select(key("up"), key("down")))
    paths = pairs.select("node.graph", F.col("node.node").alias("node"), F.col("reach.node").alias("reach"))
    flag = lambda df, n: df.distinct().withColumn(n, F.lit(True))
    ends = stages.join(flag(edges.select("graph", F.col("down").alias("node")), "_needs"), ["graph", "node"], "left").join(flag(edges.select("graph", F.col("up").alias("node")), "_led"), ["graph", "node"], "left")
    ends = ends.withColumn("entry", F.col("_needs").isNull()).withColumn("terminal", F.col("_led").isNull())
    led = paths.join(ends.where("entry").select("graph", "node"), ["graph", "node"], "left_semi").select("graph", F.col("reach").alias("node"))
    loops = paths.where("node = reach").select("graph", "node")
    joined = paths.join(stages.where("is_merge").select("graph", F.col("node").alias("reach")), ["graph", "reach"], "left_semi").select("graph", "node")
    rows = ends.join(flag(led, "_from"), ["graph", "node"], "left").join(flag(loops, "_loop"), ["graph", "node"], "left").join(flag(joined, "_merged"), ["graph", "node"], "left")
    rows = rows.withColumn("in_cycle", F.col("_loop").isNotNull()).withColumn("reached", F.col("entry") | F.col("_from").isNotNull()).withColumn("merged", F.col("_merged").isNotNull())
    rows = materialize(rows.select("graph", "node", "entry", "terminal", "in_cycle", "reached", "merged"), "places")
    sound = edges.join(rows.where("in_cycle").select("graph").distinct(), "graph", "left_anti")
    depth = layers(sound.select(key("up"), key("down"))).select("node.graph", F.col("node.node").alias("node"), F.col("layer").alias("depth"))
    return rows.join(depth, ["graph", "node"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def _places(stages: DataFrame, deps: DataFrame, small: int = SMALL) -> DataFrame:
    """graph, node, entry, terminal, in_cycle, reached (an entry leads there), merged (it leads to a merge) and depth of stages (graph, node, is_merge).

    depth is the longest path from an entry, in a graph without cycles. Stages and dependencies are counted first: a
    graph of `small` stages and `small` squared dependencies at most is a row of its own, larger ones take joins. A
    stage without a graph or name isn't among the rows; nothing leads to it or from it.
    """
    stages, deps = stages.where("graph IS NOT NULL AND node IS NOT NULL"), deps.where("graph IS NOT NULL AND needs IS NOT NULL AND node IS NOT NULL")
    sized = stages.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") > small).select("graph")
    many = deps.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") > small * small).select("graph")
    large = materialize(sized.union(many).distinct(), "large-graphs")
    if not large.limit(1).count():
        return _of_small(stages, deps)
    rest = [df.join(large, "graph", "left_anti") for df in (stages, deps)]
    return _of_small(*rest).unionByName(_of_large(*(df.join(large, "graph", "left_semi") for df in (stages, deps))))


def _placed(stages: DataFrame, deps: DataFrame) -> DataFrame:
    """stages, written and told apart by graph and node, with the columns of _places."""
    stages = materialize(stages.dropDuplicates(["graph", "node"]), "stages")
    merge = F.col("is_merge") if "is_merge" in stages.columns else F.lit(False)
    rows = stages.join(_places(stages.select("graph", "node", merge.alias("is_merge")), deps), ["graph", "node"], "left")
    alone = {"entry": True, "terminal": True, "in_cycle": False, "reached": True, "merged": False, "depth": 0}
    return rows.select(*stages.columns, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in alone.items()))


def definition_checks(definitions: DataFrame, stages: DataFrame, deps: DataFrame, gates: DataFrame, roles: DataFrame) -> DataFrame:
    """graph, check and ok: ten checks of each definition (graph, hub_role).

    stages are (graph, node, per_item, is_merge, instructions, self_check, acceptance, action, mode, sla, ack, idle), deps
    (graph, node, needs), gates (graph, role), roles (role, management).
    """
    rows = _placed(stages, deps)
    told = F.lit(True)
    for text in ("instructions", "self_check", "acceptance"):
        told = told & (F.trim(F.coalesce(text, F.lit(""))) != "")
    timed = F.coalesce("mode", F.lit("")).isin(*DISPATCH_MODES) & (F.least(*(F.coalesce(n, F.lit(0)) for n in ("sla", "ack", "idle"))) >= 0)
    of_stages = {
        "acyclic": F.bool_and(~F.col("in_cycle")),
        "entry_reaches_all": F.bool_or("entry") & F.bool_and("reached"),
        "ends_reached": F.bool_and(~F.col("terminal") | F.col("reached")),
        "texts_present": F.bool_and(told),
        "has_stage": F.count("*") > 0,
        "actions_valid": F.bool_and(F.coalesce("action", F.lit("")).rlike(ACTION)),
        "modes_valid": F.bool_and(timed),
        "items_merge": F.bool_and(~F.coalesce("per_item", F.lit(False)) | F.col("merged")),
    }
    found = rows.groupBy("graph").agg(*(v.alias(k) for k, v in of_stages.items()))
    known = roles.select("role", "management")
    gate = gates.join(known, "role", "left").groupBy("graph").agg(F.bool_and(F.col("management").isNotNull()).alias("reviewers_exist"))
    every = definitions.join(known.withColumnRenamed("role", "hub_role"), "hub_role", "left").join(found, "graph", "left").join(gate, "graph", "left")
    absent = {"has_stage": False, "entry_reaches_all": False}
    checks = [(k, F.coalesce(k, F.lit(absent.get(k, True)))) for k in (*of_stages, "reviewers_exist")] + [("hub_manages", F.coalesce("management", F.lit(False)))]
    return every.select("graph", F.inline(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks))))


def placed_stages(stages: DataFrame, deps: DataFrame) -> DataFrame:
    """graph, node, layer, entry, terminal and in_cycle of stages (graph, node, seq).

    layer is the longest path from an entry; in a graph with a cycle it is the place by seq instead.
    """
    rows = _placed(stages.select("graph", "node", "seq"), deps)
    whole = Window.partitionBy("graph")
    order = F.row_number().over(whole.orderBy("seq", "node")) - 1
    layer = F.when(F.max("in_cycle").over(whole), order).otherwise(F.col("depth"))
    return rows.select("graph", "node", layer.alias("layer"), "entry", "terminal", "in_cycle")


def definition_diff(base: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed) and the array fields of those that differ; rows that are the same don't come back."""
    old = base.select(*key, F.struct(*fields).alias("_a"))
    both = old.join(new.select(*key, F.struct(*fields).alias("_b")), key, "full")
    apart = F.array_compact(F.array(*(F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(apart) > 0, "changed")
    return both.select(*key, change.alias("change"), F.when(change == "changed", apart).otherwise(F.array().cast("array<string>")).alias("fields")).where("change IS NOT NULL")
