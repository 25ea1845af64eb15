"""Parent-child links to whole hierarchies, by parallel tree contraction.

Every round removes from the live forest all its leaves (rake) and an independent set of nodes
with one child (compress, where the child takes over the pointer and the nodes passed on the
way). A forest of any depth is gone after a number of rounds that grows with the logarithm of
its size. What is never gone is a core of circles: each compresses to one node that points to
itself. The removed nodes are then put back in reverse order, each taking root and path from
the node it pointed to when it was removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.common import cut, heavy_keys, lookup_join

#: More rounds than a forest of 2**60 nodes needs; reaching it means a defect, not a large input.
MAX_ROUNDS = 400


@dataclass(frozen=True)
class Forest:
    """nodes: id, parent_id, root_id, depth int; with paths also path array<struct<id, label>>, on_circle boolean."""

    nodes: DataFrame

    def positions(self) -> DataFrame:
        """id, parent_id, root_id, depth, path: labels from the root down, joined with '/'."""
        labels = F.concat_ws("/", F.transform("path", lambda x: F.coalesce(x["label"], x["id"].cast("string"))))
        return self.nodes.select("id", "parent_id", "root_id", "depth", F.when(F.col("depth") >= 0, labels).alias("path"))

    def descendants(self) -> DataFrame:
        """ancestor_id, descendant_id, distance: one row per pair; nodes at circles have no pairs."""
        up = F.col("path")
        pairs = self.nodes.where("depth > 0").select(
            F.col("id").alias("descendant_id"),
            "depth",
            F.posexplode(F.slice(up, 1, F.size(up) - 1)).alias("at", "above"),
        )
        return pairs.select(
            F.col("above.id").alias("ancestor_id"), "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance")
        )

    def circles(self) -> DataFrame:
        """root_id (the smallest id of the circle), id: the members of every circle."""
        return self.nodes.where("on_circle").select("root_id", "id")


def _mix(node: Column, round_no: int) -> Column:
    return F.xxhash64(node, F.lit(round_no))


def build_forest(rows: DataFrame, node: str, parent: str, label: str, paths: bool = True) -> Forest:
    """Resolve ``rows`` (one per node) to roots and depths, and to paths if they are asked for.

    A node whose parent is null or has no row is a root of depth 0. A node on a circle, or below
    one, has depth -1, the smallest id of the circle as root and no path. Rows with a null id are
    left out; of several rows of an id, which callers should have settled, one is taken, by the
    smallest parent. A null label stands in paths as the id. An empty table gives an empty one.

    Without paths a node carries the number of nodes between it and its pointer and the least id
    among them, so what is stored is linear in the nodes however long the chains are.
    """
    base = cut(
        rows.where(F.col(node).isNotNull())
        .groupBy(F.col(node).alias("id"))
        .agg(F.min(F.struct(F.col(parent).alias("p"), F.col(label).cast("string").alias("l"))).alias("_m"))
        .select("id", F.col("_m.p").alias("parent_id"), *([F.col("_m.l").alias("label")] if paths else []))
    )
    kind = base.schema["id"].dataType.simpleString()
    names = ["label"] if paths else []
    named = base.where("parent_id is not null").select(F.col("parent_id").alias("k")).distinct()
    base = cut(base.join(named, base["id"] == named["k"], "left").withColumn("inner", F.col("k").isNotNull()).drop("k"))
    heavy = heavy_keys(base, F.col("parent_id"), base.count())
    known = base.where("inner").select(F.col("id").alias("k"))
    linked = lookup_join(base, known, "parent_id", "k", heavy, "left")
    entry = cut(linked.select("id", "parent_id", *names, "inner", F.col("k").alias("ptr")))

    step_type = f"array<struct<id:{kind},label:string>>"
    me = F.struct(F.col("id").alias("id"), F.col("label").alias("label")) if paths else None
    # what a node passes over on the way to its pointer: the nodes themselves, or their number and least id
    if paths:
        start = {"seg": F.array().cast(step_type)}
        passed_on = {"cseg": F.concat("seg", F.array(me))}
        joined = {"seg": F.when(F.col("cid").isNotNull(), F.concat("cseg", "seg")).otherwise(F.col("seg"))}
    else:
        start = {"steps": F.lit(0), "least": F.col("id")}
        passed_on = {"csteps": F.col("steps") + 1, "cleast": F.col("least")}
        joined = {"steps": F.col("steps") + F.coalesce("csteps", F.lit(0)), "least": F.least("least", "cleast")}
    live = entry.where("ptr is not null").select("id", "parent_id", *names, "inner", "ptr", *[v.alias(k) for k, v in start.items()])
    removed: list[DataFrame] = []
    for round_no in range(1, MAX_ROUNDS):
        if not live.where("id <> ptr").limit(1).count():
            break
        counts = live.groupBy(F.col("ptr").alias("k")).agg(F.count("*").alias("kids"), F.min("id").alias("kid"))
        seen = live.join(counts, live["id"] == counts["k"], "left").drop("k")
        taken = seen.where(
            (F.col("kids") == 1)
            & (F.col("id") != F.col("ptr"))
            & (_mix(F.col("id"), round_no) > _mix(F.col("ptr"), round_no))
            & (_mix(F.col("id"), round_no) > _mix(F.col("kid"), round_no))
        )
        passed = taken.select(F.col("kid").alias("heir"), F.col("id").alias("cid"), F.col("ptr").alias("cptr"), *[v.alias(k) for k, v in passed_on.items()])
        gone = taken.select(F.col("id").alias("tid"))
        step = (
            seen.join(passed, seen["id"] == passed["heir"], "left")
            .join(gone, F.col("id") == F.col("tid"), "left")
            .select(
                "id", "parent_id", *names, "inner", F.coalesce("cptr", "ptr").alias("ptr"), *[v.alias(k) for k, v in joined.items()],
                (F.col("kids").isNull() | F.col("tid").isNotNull()).alias("out"),
            )
        )
        step = cut(step)
        removed.append(step.where("out"))
        live = step.where("not out").drop("out")
    else:
        raise RuntimeError("tree contraction did not end")

    roots = entry.where("ptr is null").select(
        "id", "parent_id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), "inner", *([F.array(me).alias("path"), F.lit(False).alias("on_circle")] if paths else [])
    )
    if paths:
        ring = F.concat("seg", F.array(me))
        rings = live.select("id", "parent_id", F.array_min(F.transform(ring, lambda x: x["id"])).alias("root_id"), "inner", ring.alias("ring"))
        # the members of a circle are known from its core; they are told apart from what hangs on it
        members = rings.select(F.explode("ring.id").alias("mid")).distinct()
        cores = rings.select("id", "parent_id", "root_id", F.lit(-1).alias("depth"), "inner", F.lit(None).cast(step_type).alias("path"), F.lit(True).alias("on_circle"))
        extra, own_path = ["path"], [F.when(F.col("adepth") >= 0, F.concat("apath", "seg", F.array(me))).alias("path"), F.lit(False).alias("on_circle")]
        passed_over = F.size("seg")
    else:
        cores = live.select("id", "parent_id", F.col("least").alias("root_id"), F.lit(-1).alias("depth"), "inner")
        extra, own_path, passed_over, members = [], [], F.col("steps"), None
    found = [roots, cores]
    above = cut(roots.unionByName(cores).where("inner").select("id", "root_id", "depth", *extra))
    for depth_no, step in enumerate(reversed(removed)):
        near = above.select(F.col("id").alias("aid"), "root_id", F.col("depth").alias("adepth"), *[F.col(c).alias(f"a{c}") for c in extra])
        back = lookup_join(step, near, "ptr", "aid", heavy)
        depth = F.when(F.col("adepth") < 0, F.lit(-1)).otherwise(F.col("adepth") + passed_over + 1).cast("int")
        back = back.select("id", "parent_id", "root_id", depth.alias("depth"), "inner", *own_path)
        if depth_no < len(removed) - 1:
            back = cut(back)
            above = above.unionByName(back.where("inner").select("id", "root_id", "depth", *extra))
            if depth_no % 4 == 3:
                above = cut(above)
        found.append(back)
    nodes = found[0]
    for part in found[1:]:
        nodes = nodes.unionByName(part)
    if members is not None:
        below = nodes.where("depth < 0 and not on_circle").join(members, F.col("id") == F.col("mid"), "left")
        below = below.withColumn("on_circle", F.col("mid").isNotNull()).drop("mid")
        nodes = nodes.where("depth >= 0 or on_circle").unionByName(below)
    return Forest(nodes.drop("inner"))
