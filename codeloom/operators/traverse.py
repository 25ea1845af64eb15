"""Traversals by level-synchronous frontiers: one join per level, cut, never a path enumeration."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.common import cut
from codeloom.operators.graph import CONFIDENCE_RANK, TYPE_KINDS, confidence, confidence_rank, top_per_group

MAX_CALL_DEPTH = 5
MAX_IMPACT_DEPTH = 4
MAX_PATH_HOPS = 6


def levels(links: DataFrame, seeds: DataFrame, max_depth: int | None, seen: DataFrame | None = None) -> DataFrame:
    """node, depth: everything within ``max_depth`` steps (None: however far) along links (a -> b), at its least depth.

    links: a, b; seeds: node. Nodes of ``seen`` are never reported again; with ``seen`` left out a
    seed on a circle is reported at the length of the circle. All seeds walk together, so the work
    per level is one join whatever their number. A circle ends as its nodes are known."""
    links = cut(links.select("a", "b").distinct())
    front = cut(seeds.select("node").distinct())
    known = seen.select("node") if seen is not None else None
    out = None
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = front.join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        if known is not None:
            step = step.join(known, "node", "left_anti")
        front = cut(step)
        level = front.withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
        known = front if known is None else known.unionByName(front)
        if not front.limit(1).count():
            break
    return out


def reach_by_root(links: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """root, node, depth: as ``levels`` for every root on its own (roots: root)."""
    links = cut(links.select("a", "b").distinct())
    front = cut(roots.select("root", F.col("root").alias("node")).distinct())
    known = out = None
    for depth in range(1, max_depth + 1):
        step = front.join(links, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        if known is not None:
            step = step.join(known, ["root", "node"], "left_anti")
        front = cut(step)
        level = front.withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
        known = front if known is None else known.unionByName(front)
        if not front.limit(1).count():
            break
    return out


def callers(edges: DataFrame, symbol_ids: DataFrame, max_depth: int = MAX_CALL_DEPTH) -> DataFrame:
    """node, depth of whoever calls one of the symbols (node), directly or not; unresolved edges with
    a target count too."""
    calls = edges.where("edge_type = 'CALLS' and target_symbol_id is not null")
    return levels(calls.select(F.col("target_symbol_id").alias("a"), F.col("source_symbol_id").alias("b")), symbol_ids, min(max_depth, MAX_CALL_DEPTH))


def callees(edges: DataFrame, symbol_ids: DataFrame, max_depth: int = MAX_CALL_DEPTH) -> DataFrame:
    """callee, depth: what the symbols call. A callee is 's:' and its id where resolved, else 'u:'
    and its raw target; unresolved ones are leaves."""
    calls = edges.where("edge_type = 'CALLS'")
    key = F.when(F.col("resolved") & F.col("target_symbol_id").isNotNull(), F.concat(F.lit("s:"), F.col("target_symbol_id").cast("string"))).otherwise(
        F.concat(F.lit("u:"), F.coalesce("target_raw", F.lit("")))
    )
    links = calls.select(F.concat(F.lit("s:"), F.col("source_symbol_id").cast("string")).alias("a"), key.alias("b"))
    seeds = symbol_ids.select(F.concat(F.lit("s:"), F.col("node").cast("string")).alias("node"))
    return levels(links, seeds, min(max_depth, MAX_CALL_DEPTH)).withColumnRenamed("node", "callee")


def subtypes(symbols: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = MAX_CALL_DEPTH) -> DataFrame:
    """root, id, depth, path of every subtype of every root (roots: root).

    path joins the names from below the root with '>'; of paths of least depth it is the smallest
    as a string."""
    names = symbols.select(F.col("id").alias("nid"), "fqn")
    down = (
        edges.where("edge_type in ('INHERITS', 'IMPLEMENTS') and target_symbol_id is not null")
        .select(F.col("target_symbol_id").alias("a"), F.col("source_symbol_id").alias("b")).distinct()
        .join(names, F.col("b") == F.col("nid")).select("a", "b", "fqn")
    )
    down = cut(down)
    front = roots.select("root", F.col("root").alias("node"), F.lit("").alias("lead")).distinct()
    known = out = None
    for depth in range(1, max_depth + 1):
        met = front.join(down, F.col("node") == F.col("a"))
        if known is not None:
            met = met.join(known, (met["root"] == known["kroot"]) & (met["b"] == known["knode"]), "left_anti")
        step = cut(met.groupBy("root", F.col("b").alias("node")).agg(F.min(F.concat("lead", "fqn")).alias("path")))
        level = step.select("root", F.col("node").alias("id"), F.lit(depth).alias("depth"), "path")
        out = level if out is None else out.unionByName(level)
        mine = step.select(F.col("root").alias("kroot"), F.col("node").alias("knode"))
        known = mine if known is None else known.unionByName(mine)
        front = step.select("root", "node", F.concat("path", F.lit(">")).alias("lead"))
        if not step.limit(1).count():
            break
    return out


def ancestors(symbols: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = MAX_CALL_DEPTH) -> DataFrame:
    """root, id, depth of every class above a root along INHERITS, nearest first."""
    up = edges.where("edge_type = 'INHERITS' and target_symbol_id is not null").select(F.col("source_symbol_id").alias("a"), F.col("target_symbol_id").alias("b"))
    classes = symbols.where("kind = 'class'").select(F.col("id").alias("cid"))
    reached = reach_by_root(up, roots, max_depth)
    return reached.where("root <> node").join(classes, F.col("node") == F.col("cid"), "left_semi").select("root", F.col("node").alias("id"), "depth")


def importers(modules: DataFrame, paths: DataFrame, max_depth: int = 5) -> DataFrame:
    """node, depth of the files that import one of the paths (node)."""
    links = modules.where("target_path is not null").select(F.col("target_path").alias("a"), F.col("source_path").alias("b"))
    return levels(links, paths, max_depth)


def imports(modules: DataFrame, paths: DataFrame, max_depth: int = 5) -> DataFrame:
    """node, depth of the files that the paths import; only resolved imports lead on."""
    links = modules.where("resolved and target_path is not null").select(F.col("source_path").alias("a"), F.col("target_path").alias("b"))
    return levels(links, paths, max_depth)


def path_links(symbols: DataFrame, resolved: DataFrame, types: Sequence[str], undirected: bool) -> DataFrame:
    """a, b, rank, relation, direction: the steps that a path may take. Containment leads both ways."""
    kept = resolved.where(F.col("edge_type").isin(*types)).where("source_symbol_id <> target_symbol_id")
    rank = confidence_rank(confidence(F.col("resolution_tier"), F.col("resolved")))
    out = kept.select(F.col("source_symbol_id").alias("a"), F.col("target_symbol_id").alias("b"), rank.alias("rank"), F.col("edge_type").alias("relation"), F.lit("forward").alias("direction"))
    if undirected:
        out = out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "rank", "relation", F.lit("reverse").alias("direction")))
    inside = symbols.where("parent_symbol_id is not null").select(F.col("parent_symbol_id").alias("a"), F.col("id").alias("b"))
    inside = inside.join(symbols.select(F.col("id").alias("p")), F.col("a") == F.col("p"), "left_semi").where("a <> b")
    best = F.lit(CONFIDENCE_RANK["EXTRACTED"])
    down = inside.select("a", "b", best.alias("rank"), F.lit("CONTAINS").alias("relation"), F.lit("forward").alias("direction"))
    up = inside.select(F.col("b").alias("a"), F.col("a").alias("b"), best.alias("rank"), F.lit("CONTAINS").alias("relation"), F.lit("reverse").alias("direction"))
    return out.unionByName(down).unionByName(up)


def shortest_path(symbols: DataFrame, resolved: DataFrame, source: int, target: int, types: Sequence[str] = ("CALLS", "INHERITS"), undirected: bool = False, max_hops: int = MAX_PATH_HOPS) -> DataFrame:
    """hop, from_id, to_id, relation, direction of one shortest path; no rows if there is none.

    Of equally short paths it is the one a breadth-first search meets first that takes neighbours
    by trust, relation and id. A node's place in that order is the list of such keys on the way to
    it, and lists compare like the order, so each level keeps the least list per node without
    sorting a whole level."""
    links = path_links(symbols, resolved, types, undirected)
    links = cut(links.groupBy("a", "b").agg(F.min(F.struct("rank", "relation", "direction")).alias("via")))
    spark = symbols.sparkSession
    key = "array<struct<rank:int,relation:string,id:bigint,direction:string>>"
    front = spark.range(1).select(F.lit(source).cast("long").alias("node"), F.array().cast(key).alias("trail"))
    known = front.select("node")
    found = None
    if source != target:
        for _ in range(max_hops):
            step = F.struct(F.col("via.rank").alias("rank"), F.col("via.relation").alias("relation"), F.col("b").alias("id"), F.col("via.direction").alias("direction"))
            met = front.join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.concat("trail", F.array(step)).alias("trail"))
            front = cut(met.join(known, "node", "left_anti").groupBy("node").agg(F.min("trail").alias("trail")))
            known = cut(known.unionByName(front.select("node")))
            found = front.where(F.col("node") == target)
            if found.limit(1).count() or not front.limit(1).count():
                break
    if found is None:
        found = front.where("false")
    hops = found.select("trail", F.posexplode("trail").alias("hop", "step"))
    before = F.when(F.col("hop") == 0, F.lit(source)).otherwise(F.expr("trail[hop - 1].id"))
    return hops.select((F.col("hop") + 1).alias("hop"), before.cast("long").alias("from_id"), F.col("step.id").alias("to_id"), F.col("step.relation").alias("relation"), F.col("step.direction").alias("direction"))


def impact(
    symbols: DataFrame, resolved: DataFrame, changed: DataFrame, depth: int = 3, types: Sequence[str] = ("CALLS", "INHERITS"), direction: str = "inbound", fixpoint: bool = False,
    seed_filter: str = "all",
) -> DataFrame:
    """id, distance, risk, is_test of every symbol that a change of the files reaches.

    changed: file_path. Seeds are the symbols of those files at distance 0. risk: low for tests;
    high for types and from five uses on; medium from one; else low."""
    kept = resolved.where(F.col("edge_type").isin(*types))
    into = kept.select(F.col("target_symbol_id").alias("a"), F.col("source_symbol_id").alias("b"))
    links = {"inbound": into, "outbound": into.select(F.col("b").alias("a"), F.col("a").alias("b"))}
    links["both"] = into.unionByName(links["outbound"])
    seeds = symbols.join(changed.select("file_path").distinct(), "file_path", "left_semi")
    if seed_filter == "product":
        seeds = seeds.where("not is_test")
    seeds = cut(seeds.select(F.col("id").alias("node")))
    reached = levels(links[direction], seeds, None if fixpoint else min(depth, MAX_IMPACT_DEPTH), seen=seeds)
    found = seeds.withColumn("depth", F.lit(0)).unionByName(reached)
    fan = kept.groupBy(F.col("target_symbol_id").alias("t")).agg(F.count("*").alias("fan_in"))
    s = symbols.select("id", "kind", "is_test")
    rows = found.join(s, F.col("node") == F.col("id")).join(fan, F.col("node") == F.col("t"), "left")
    uses = F.coalesce("fan_in", F.lit(0))
    risk = F.when(F.col("is_test"), "low").when(F.col("kind").isin(*TYPE_KINDS) | (uses >= 5), "high").when(uses >= 1, "medium").otherwise("low")
    return rows.select("id", F.col("depth").alias("distance"), risk.alias("risk"), "is_test")


def impact_parents(symbols: DataFrame, resolved: DataFrame, reached: DataFrame, types: Sequence[str] = ("CALLS", "INHERITS"), direction: str = "inbound") -> DataFrame:
    """id, parent_id of what a change reaches: the node that it was reached from, of several the least.

    reached: id, distance as ``impact`` gives them; the symbols of the changed files have no parent."""
    kept = resolved.where(F.col("edge_type").isin(*types))
    into = kept.select(F.col("target_symbol_id").alias("a"), F.col("source_symbol_id").alias("b"))
    links = {"inbound": into, "outbound": into.select(F.col("b").alias("a"), F.col("a").alias("b"))}
    links["both"] = into.unionByName(links["outbound"])
    near = reached.select(F.col("id").alias("pid"), F.col("distance").alias("pd"))
    met = reached.where("distance > 0").join(links[direction].distinct(), F.col("id") == F.col("b")).join(near, (F.col("a") == F.col("pid")) & (F.col("pd") == F.col("distance") - 1))
    return met.groupBy("id").agg(F.min("pid").alias("parent_id"))


def neighbourhood(
    symbols: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, types: Sequence[str] = ("CALLS", "INHERITS"), direction: str = "both", fan_out: int | None = None, most: int | None = None,
) -> DataFrame:
    """id, distance, external: the nodes around the seeds (node), with the number of unresolved
    targets that each names collapsed into a count.

    fan_out: neighbours of a node that are followed, least ids first; most: nodes that are reported,
    nearest first (both are features of a shown graph; None: all)."""
    kept = edges.where("resolved and target_symbol_id is not null").where(F.col("edge_type").isin(*types))
    out = kept.select(F.col("source_symbol_id").alias("a"), F.col("target_symbol_id").alias("b"))
    both = {"out": out, "in": out.select(F.col("b").alias("a"), F.col("a").alias("b"))}
    links = (both["out"].unionByName(both["in"]) if direction == "both" else both[direction]).distinct()
    if fan_out is not None:
        links = top_per_group(links, ["a"], [F.col("b")], fan_out)
    seeds = cut(seeds.select("node").distinct())
    near = seeds.withColumn("depth", F.lit(0)).unionByName(levels(links, seeds, min(depth, MAX_IMPACT_DEPTH), seen=seeds))
    ext = edges.where("not resolved").where(F.col("edge_type").isin(*types)).groupBy(F.col("source_symbol_id").alias("x")).agg(F.count("*").alias("external"))
    known = symbols.select(F.col("id").alias("k"))
    out = (
        near.join(known, F.col("node") == F.col("k"), "left_semi").join(ext, F.col("node") == F.col("x"), "left")
        .select(F.col("node").alias("id"), F.col("depth").alias("distance"), F.coalesce("external", F.lit(0)).alias("external"))
    )
    return out if most is None else out.orderBy("distance", "id").limit(most)


def ego_graph(symbols: DataFrame, edges: DataFrame, symbol_id: int, depth: int = 2, types: Sequence[str] = ("CALLS", "INHERITS")) -> DataFrame:
    """level, node_id, section, other_id, relation: what stands around a symbol and, level by level,
    around what was met, up to MAX_IMPACT_DEPTH. A node is looked at once, at its least level."""
    res = edges.where("resolved and target_symbol_id is not null").where(F.col("edge_type").isin(*types)).where("source_symbol_id <> target_symbol_id")
    inside = symbols.where("parent_symbol_id is not null and parent_symbol_id <> id")
    parts = [
        res.select(F.col("target_symbol_id").alias("a"), F.lit("incoming").alias("section"), F.col("source_symbol_id").alias("b"), F.col("edge_type").alias("relation")),
        res.select(F.col("source_symbol_id").alias("a"), F.lit("outgoing").alias("section"), F.col("target_symbol_id").alias("b"), F.col("edge_type").alias("relation")),
        inside.select(F.col("parent_symbol_id").alias("a"), F.lit("members").alias("section"), F.col("id").alias("b"), F.lit("CONTAINS").alias("relation")),
        inside.select(F.col("id").alias("a"), F.lit("container").alias("section"), F.col("parent_symbol_id").alias("b"), F.lit("CONTAINS").alias("relation")),
    ]
    links = parts[0]
    for part in parts[1:]:
        links = links.unionByName(part)
    links = cut(links.distinct())
    seed = cut(symbols.sparkSession.range(1).select(F.lit(symbol_id).cast("long").alias("node")))
    depth = max(1, min(depth, MAX_IMPACT_DEPTH))
    met = seed.withColumn("depth", F.lit(0))
    if depth > 1:
        met = met.unionByName(levels(links, seed, depth - 1, seen=seed))
    return met.join(links, F.col("node") == F.col("a")).select((F.col("depth") + 1).alias("level"), F.col("node").alias("node_id"), "section", F.col("b").alias("other_id"), "relation")


def explain(symbols: DataFrame, edges: DataFrame, symbol_id: int, types: Sequence[str] = ("CALLS", "INHERITS")) -> DataFrame:
    """section, other_id, relation of everything one step around a symbol: uses of it, its own uses,
    its members and its container."""
    res = edges.where("resolved and target_symbol_id is not null").where(F.col("edge_type").isin(*types))
    parts = [
        res.where(F.col("target_symbol_id") == symbol_id).select(F.lit("incoming").alias("section"), F.col("source_symbol_id").alias("other_id"), F.col("edge_type").alias("relation")),
        res.where(F.col("source_symbol_id") == symbol_id).select(F.lit("outgoing").alias("section"), F.col("target_symbol_id").alias("other_id"), F.col("edge_type").alias("relation")),
        symbols.where(F.col("parent_symbol_id") == symbol_id).select(F.lit("members").alias("section"), F.col("id").alias("other_id"), F.lit("CONTAINS").alias("relation")),
        symbols.where((F.col("id") == symbol_id) & F.col("parent_symbol_id").isNotNull()).select(F.lit("container").alias("section"), F.col("parent_symbol_id").alias("other_id"), F.lit("CONTAINS").alias("relation")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def communities(links: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community by label propagation on the undirected links (a, b), all nodes at once.

    Every node takes the label that most of its neighbours hold, of equally frequent ones the
    least, for ``rounds`` rounds. All nodes move at the same time, where a sequential version
    moves them in order of id; the result is as deterministic and needs no single task. Groups
    of one node keep their own label."""
    pairs = links.where("a <> b").select("a", "b")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("node")).groupBy("a", "label").agg(F.count("*").alias("n"))
        labels = cut(votes.groupBy(F.col("a").alias("node")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")))
    return labels.select("node", F.col("label").alias("community"))


def strong_components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every strongly connected component of two nodes or more,
    or of one node that links to itself.

    Nodes without a way in or out are trimmed away; then colours spread forward (the greatest
    wins), every node that kept its own colour starts a backward walk within it, and what that
    meets is a component. Memory is linear in the links, whatever the components."""
    links = links.where("a is not null and b is not null").select("a", "b").distinct()
    loops = links.where("a = b").select(F.col("a").alias("node"))
    live = cut(links.where("a <> b"))
    found = None
    while True:
        while True:  # trim
            ends = live.select(F.col("b").alias("n")).distinct().join(live.select(F.col("a").alias("m")).distinct(), F.col("n") == F.col("m"), "left_semi")
            kept = cut(live.join(ends, F.col("a") == F.col("n"), "left_semi").join(ends, F.col("b") == F.col("n"), "left_semi"))
            before, after = live.count(), kept.count()
            live = kept
            if before == after:
                break
        if not after:
            break
        colour = cut(live.select(F.col("a").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:  # spread
            pushed = live.join(colour, F.col("a") == F.col("node")).groupBy("b").agg(F.max("colour").alias("best"))
            new = cut(colour.join(pushed, F.col("node") == F.col("b")).select("node", F.greatest("colour", "best").alias("colour"), (F.col("best") > F.col("colour")).alias("moved")))
            colour = new.drop("moved")
            if not new.where("moved").limit(1).count():
                break
        tinted = live.join(colour.withColumnsRenamed({"node": "an", "colour": "ac"}), F.col("a") == F.col("an")).join(
            colour.withColumnsRenamed({"node": "bn", "colour": "bc"}), F.col("b") == F.col("bn")
        )
        within = cut(tinted.where("ac = bc").select(F.col("b").alias("a"), F.col("a").alias("b")))
        seeds = cut(colour.where("node = colour").select("node"))
        met = seeds.unionByName(levels(within, seeds, None, seen=seeds).select("node")).distinct()
        part = cut(colour.join(met, "node", "left_semi").select("node", "colour"))
        found = part if found is None else found.unionByName(part)
        live = cut(live.join(part.select(F.col("node").alias("n")), F.col("a") == F.col("n"), "left_anti").join(part.select(F.col("node").alias("n")), F.col("b") == F.col("n"), "left_anti"))
    alone = loops.withColumn("colour", F.col("node"))
    if found is not None:
        alone = alone.join(found.select("node"), "node", "left_anti").unionByName(found.groupBy("colour").agg(F.count("*").alias("size")).where("size > 1").join(found, "colour").select("node", "colour"))
    least = alone.groupBy("colour").agg(F.min("node").alias("component"))
    return alone.join(least, "colour").select("node", "component")


def module_cycles(modules: DataFrame, max_length: int | None = None) -> DataFrame:
    """members, length of simple import circles, of up to ``max_length`` files where that is given.

    Only links inside strong components are walked, and a walk only passes files greater than the
    one it began at, so each circle is met once, from its least file."""
    links = modules.where("resolved and target_path is not null").select(F.col("source_path").alias("a"), F.col("target_path").alias("b")).distinct()
    comp = strong_components(links)
    inner = (
        links.join(comp.withColumnsRenamed({"node": "an", "component": "ac"}), F.col("a") == F.col("an"))
        .join(comp.withColumnsRenamed({"node": "bn", "component": "bc"}), F.col("b") == F.col("bn")).where("ac = bc").select("a", "b")
    )
    inner = cut(inner)
    walk = inner.where("a < b").select(F.col("a").alias("first"), F.col("b").alias("last"), F.array("a", "b").alias("members"))
    out = inner.where("a = b").select(F.array("a").alias("members"))
    for _ in count(2) if max_length is None else range(2, max_length + 1):
        walk = cut(walk)
        if not walk.limit(1).count():
            break
        closed = walk.join(inner, (F.col("last") == F.col("a")) & (F.col("first") == F.col("b")), "left_semi")
        out = out.unionByName(closed.select("members"))
        walk = walk.join(inner, F.col("last") == F.col("a")).where("b > first and not array_contains(members, b)").select("first", F.col("b").alias("last"), F.concat("members", F.array("b")).alias("members"))
    return out.select(F.array_join("members", " > ").alias("members"), F.size("members").alias("length"))
