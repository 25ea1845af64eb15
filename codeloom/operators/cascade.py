"""Cascades of name resolution: references, imports, refined edges and implementations of members.

Each step is an equi-join to counts, one row per key, so a name that a third of all symbols or
references share never meets itself; the first step with any candidate decides, and more than
one candidate is an ambiguity, never a choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.common import cut, few, laid_down
from codeloom.operators.graph import TYPE_KINDS, arity, subtype_closure
from codeloom.operators.passes import parameter_types
from codeloom.operators.traverse import reach_by_root

#: What an import without an extension may stand for, in order.
SCRIPT_ENDINGS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.d.ts", "/index.js", "/index.jsx")
ANCESTOR_LEVELS = 5


def _without_list(name: Column) -> Column:
    return F.regexp_replace(name, r"\(.*$", "")


def _stripped(raw: Column) -> Column:
    """raw without what stands before the last '::' and without its list of arguments."""
    return _without_list(F.regexp_replace(raw, r"^.*::", ""))


def written_owner(raw: Column) -> Column:
    """The type before the last dot of a member expression, or null."""
    bare = _stripped(raw)
    return F.when(bare.contains("."), F.regexp_extract(bare, r"([^.]*)\.[^.]*$", 1))


#: Steps by number, in the order in which they decide, and what they are called.
STEPS = ("no_match", "exact", "conventional", "conventional", "type_infer", "same_file", "range", "fallback", "ambiguous")
_EXACT, _CONV, _OWNER, _ABOVE, _FILE, _RANGE, _FALLBACK, _AMBIGUOUS = range(1, 9)


def _of_arity(narrow: Column, all_: tuple[Column, Column], same: tuple[Column, Column], open_: tuple[Column, Column]) -> Column:
    """{n, id} of a step; where ``narrow``, of the wanted arity and unknown ones only."""
    n = F.coalesce(same[0], F.lit(0)) + F.coalesce(open_[0], F.lit(0))
    return F.when(narrow, F.struct(n.alias("n"), F.least(same[1], open_[1]).alias("id"))).otherwise(F.struct(F.coalesce(all_[0], F.lit(0)).alias("n"), all_[1].alias("id")))


def _met(df: DataFrame, key: str, candidate: str, step: str, narrowed: bool = True) -> DataFrame:
    """df with the struct ``step``: candidates of the row's name and key, ``key`` dropped. df lies by
    name, so nothing is shuffled; no candidate meets a reference, both meet the numbers of their group."""
    group = Window.partitionBy("name", key)
    count, least = (lambda c, w: F.count(c).over(w)), (lambda c, w: F.min(c).over(w))
    all_ = (count(F.col(candidate), group), least(F.col(candidate), group))
    if narrowed:
        each, unknown = Window.partitionBy("name", key, "arity"), F.when(F.col("arity").isNull(), F.col(candidate))
        found = _of_arity(F.col("narrow"), all_, (count(F.col(candidate), each), least(F.col(candidate), each)), (count(unknown, group), least(unknown, group)))
    else:
        found = F.struct(all_[0].alias("n"), all_[1].alias("id"))
    return df.withColumn(step, F.when(F.col("rid").isNotNull() & F.col(key).isNotNull(), found)).drop(key)


def _around(df: DataFrame) -> DataFrame:
    """df with the struct ``s_range``: declarations of the row's name around its line. Running counts of
    what has begun and ended; the exclusive or of the ids that are open is the id where one is."""
    begins = F.when(F.col("line_start") <= F.col("line_end"), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(0)))
    rows = df.withColumn("turn", F.explode(F.when(F.col("sid").isNotNull(), F.coalesce(begins, F.array(F.lit(0)))).otherwise(F.array(F.lit(0)))))
    at = F.when(F.col("rid").isNotNull(), F.col("line").cast("long")).when(F.col("turn") == 1, F.col("line_start").cast("long")).when(F.col("turn") == -1, F.col("line_end").cast("long") + 1)
    rows = rows.withColumn("at", at).where("rid is not null or turn <> 0")
    order = ["at", F.col("rid").isNotNull()]
    sofar = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bit = F.when(F.col("turn") != 0, F.col("sid"))
    n_of = lambda c, w: F.sum(c).over(w)
    id_of = lambda c, w: F.bit_xor(c).over(w)
    turn, unknown, by_name, by_arity = F.col("turn").cast("long"), F.col("arity").isNull(), sofar("name"), sofar("name", "arity")
    counts = rows.withColumns({
        "e_n": n_of(turn, by_arity), "e_id": id_of(bit, by_arity), "a_n": n_of(turn, by_name), "a_id": id_of(bit, by_name),
        "o_n": n_of(F.when(unknown, turn), by_name), "o_id": id_of(F.when(unknown, bit), by_name),
    })
    # an id only counts where a single one is open, and then the other part of the sum is zero
    same, open_ = (F.col("e_n"), F.when(F.col("e_n") == 1, F.col("e_id"))), (F.col("o_n"), F.when(F.col("o_n") == 1, F.col("o_id")))
    found = _of_arity(F.col("narrow"), (F.col("a_n"), F.col("a_id")), same, open_)
    return counts.withColumn("s_range", F.when(F.col("rid").isNotNull() & F.col("line").isNotNull(), found)).drop("turn", "at", "e_n", "e_id", "a_n", "a_id", "o_n", "o_id")


def _nearest_members(wanted: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """root, leaf, arity, n, id of the members named leaf of the nearest ancestors of root that have one.

    wanted: root, leaf; links: a, b; members: node, leaf, arity, n, id. Level by level, at most
    ANCESTOR_LEVELS; a pair that is found is not asked again, and a root with no pair left goes no
    further: all ancestors of all roots would be most pairs of types in a corpus of common names."""
    links = cut(links.where("a <> b").distinct())
    left = cut(wanted.join(members.select("leaf").distinct(), "leaf", "left_semi"))
    front = left.select("root", F.col("root").alias("node")).distinct()
    known, out = cut(front), None
    front = known
    for depth in range(ANCESTOR_LEVELS):
        step = front.join(links, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        front = cut(step.join(known, ["root", "node"], "left_anti"))
        hits = cut(front.join(left, "root").join(members, ["node", "leaf"]).groupBy("root", "leaf", "arity").agg(F.sum("n").alias("n"), F.min("id").alias("id")))
        out = hits if out is None else out.unionByName(hits)
        left = cut(left.join(hits, ["root", "leaf"], "left_anti"))
        if depth + 1 == ANCESTOR_LEVELS or not left.limit(1).count():
            break
        front = cut(front.join(left, "root", "left_semi"))
        known = known.unionByName(front)
    return out


def resolve_cascade(symbols: DataFrame, references: DataFrame, edges: DataFrame) -> DataFrame:
    """id, tier, target, n of every reference.

    references: id, raw, file_path, line, args (number of arguments, or null), receiver (whether raw
    is a member expression), type_only. Candidates have the name that raw ends with. Steps: exact
    name; conventional name; member of the type that raw names (both ``conventional``); member of its
    nearest ancestor (``type_infer``, for receivers); same file; the declaration around the line
    (``range``); the only one of its name, or the only type (``fallback``). Overloads are narrowed by
    arity where the name has that arity. A member expression never falls through to the last steps.
    Null raws are no_match.

    Symbols and references are laid out by name once, and all steps but that of the ancestors count
    within a name where its rows lie; only references that are left are carried on to the ancestors."""
    s = symbols.where("name is not null")
    parents = symbols.where("name is not null").select(F.col("id").alias("pid"), F.col("name").alias("own"))
    members = s.where("parent_symbol_id is not null").select(F.col("id").alias("oid"), "name", arity(F.col("fqn")).alias("arity"), "parent_symbol_id")
    owned = lambda rows: rows.join(parents, F.col("parent_symbol_id") == F.col("pid")).select("oid", "name", "arity", "own")
    leaf = F.regexp_extract(_stripped(F.col("raw")), r"([^.]*)$", 1)
    receiver = F.coalesce(F.col("receiver"), F.lit(False))
    last = ~(receiver & written_owner(F.col("raw")).isNotNull())
    laid = (
        s.select(F.col("id").alias("sid"), "name", F.col("fqn").alias("full"), F.col("conventional_fqn").alias("conv"), F.col("file_path").alias("file"), F.col("kind").isin(*TYPE_KINDS).alias("typed"), "line_start", "line_end")
        .unionByName(owned(members), allowMissingColumns=True)
        .unionByName(
            references.select(
                F.col("id").alias("rid"), leaf.alias("name"), F.col("raw").alias("full"), "args", receiver.alias("receiver"), F.coalesce("type_only", F.lit(False)).alias("type_only"),
                F.when(F.coalesce(last, F.lit(True)), F.col("file_path")).alias("file"), F.when(F.coalesce(last, F.lit(True)), F.col("line")).alias("line"),
            ),
            allowMissingColumns=True,
        )
        .repartition("name")
    )
    asks = F.col("rid").isNotNull()
    df = laid.select(
        "sid", "oid", "rid", "name", "full", _without_list(F.when(asks, F.col("full")).otherwise(F.col("conv"))).alias("conv"), F.when(asks, written_owner(F.col("full"))).otherwise(F.col("own")).alias("own"), "file", "typed", "line_start", "line_end", "line",
        F.when(asks, F.col("args")).when(F.col("sid").isNotNull(), arity(F.col("full"))).otherwise(F.col("arity")).alias("arity"), "type_only", "receiver",
    ).withColumn("owner", F.when(asks, F.col("own"))).withColumn("member", F.col("receiver") & F.col("own").isNotNull())
    # candidates of the name itself, types among them, and whether it has the arity at all
    name, each = Window.partitionBy("name"), Window.partitionBy("name", "arity")
    kind, unknown = F.when(F.col("typed"), F.col("sid")), F.col("arity").isNull()
    numbers = {"all": (F.col("sid"), name), "one": (F.col("sid"), each), "open": (F.when(unknown, F.col("sid")), name), "t_all": (kind, name), "t_one": (kind, each), "t_open": (F.when(unknown, kind), name)}
    df = df.withColumns({f"{k}_{what}": f(c).over(w) for k, (c, w) in numbers.items() for what, f in (("n", F.count), ("id", F.min))})
    df = df.withColumn("narrow", asks & ~unknown & (F.col("one_n") > 0))
    pair = lambda k: (F.col(f"{k}_n"), F.col(f"{k}_id"))
    df = df.withColumn("s_name", F.when(asks, _of_arity(F.col("narrow"), pair("all"), pair("one"), pair("open")))).withColumn("s_type", F.when(asks, _of_arity(F.col("narrow"), pair("t_all"), pair("t_one"), pair("t_open"))))
    df = df.drop(*[f"{k}_{what}" for k in numbers for what in ("n", "id")])
    df = _met(df, "full", "sid", "s_exact", narrowed=False)
    df = _met(_met(df, "conv", "sid", "s_conv"), "own", "oid", "s_owner")
    df = _around(_met(df.where("rid is not null or sid is not null"), "file", "sid", "s_file")).where("rid is not null")
    hit = F.lit(None).cast("struct<k:int,n:bigint,id:bigint>")
    for k, step, may in reversed([(_EXACT, "s_exact", F.lit(True)), (_CONV, "s_conv", F.lit(True)), (_OWNER, "s_owner", F.lit(True)), (_FILE, "s_file", ~F.col("member")), (_RANGE, "s_range", ~F.col("member"))]):
        hit = F.when(may & (F.col(f"{step}.n") > 0), F.struct(F.lit(k).alias("k"), F.col(f"{step}.n").alias("n"), F.col(f"{step}.id").alias("id"))).otherwise(hit)
    count = F.coalesce(F.col("s_name.n"), F.lit(0))
    rest = (
        F.when(~F.col("member") & (count == 1), F.struct(F.lit(_FALLBACK).alias("k"), F.lit(1).cast("long").alias("n"), F.col("s_name.id").alias("id")))
        .when(F.col("type_only") & (F.col("s_type.n") == 1), F.struct(F.lit(_FALLBACK).alias("k"), F.lit(1).cast("long").alias("n"), F.col("s_type.id").alias("id")))
        .otherwise(F.struct(F.when(count > 0, _AMBIGUOUS).otherwise(0).alias("k"), count.alias("n"), F.lit(None).cast("long").alias("id")))
    )
    df = df.withColumn("hit", hit).withColumn("done", F.coalesce("hit", rest))
    waits = F.when(F.col("hit").isNull() & F.col("member"), F.struct(F.col("owner").alias("root"), F.col("name").alias("leaf"), "arity", "narrow"))
    settled = laid_down(df.select(F.col("rid").alias("id"), "done.k", "done.n", F.col("done.id").alias("target"), waits.alias("waits")))

    # ancestors of the named type, by name and level, for members that it does not declare itself
    open_ = settled.where("waits is not null").select("id", "k", "n", "target", "waits.*")
    kinds = symbols.select(F.col("id").alias("tid"), F.col("name").alias("tname"))
    up = edges.where("edge_type in ('INHERITS', 'IMPLEMENTS') and target_symbol_id is not null").select("source_symbol_id", "target_symbol_id").distinct()
    up = up.join(kinds, F.col("source_symbol_id") == F.col("tid")).withColumnRenamed("tname", "a").drop("tid").join(kinds, F.col("target_symbol_id") == F.col("tid")).select("a", F.col("tname").alias("b"))
    wanted = cut(open_.select("root", "leaf").distinct())
    named = owned(members.join(few(wanted.select(F.col("leaf").alias("w")).distinct()), F.col("name") == F.col("w"), "left_semi"))
    declared = cut(named.groupBy(F.col("own").alias("node"), F.col("name").alias("leaf"), "arity").agg(F.count("*").alias("n"), F.min("oid").alias("id")))
    near = _nearest_members(wanted, up, declared)
    unknown = F.col("arity").isNull()
    above = near.groupBy("root", "leaf").agg(
        F.sum("n").alias("a_n"), F.min("id").alias("a_id"), F.sum(F.when(unknown, F.col("n"))).alias("o_n"), F.min(F.when(unknown, F.col("id"))).alias("o_id"),
        F.map_from_entries(F.collect_list(F.when(~unknown, F.struct("arity", F.struct("n", "id"))))).alias("by"),
    )
    same = F.col("by")[F.col("arity")]
    found = _of_arity(F.col("narrow"), (F.col("a_n"), F.col("a_id")), (same["n"], same["id"]), (F.col("o_n"), F.col("o_id")))
    late = open_.join(above, ["root", "leaf"], "left").withColumn("f", found)
    some = F.coalesce(F.col("f.n") > 0, F.lit(False))
    late = late.select("id", F.when(some, _ABOVE).otherwise(F.col("k")).alias("k"), F.when(some, F.col("f.n")).otherwise(F.col("n")).alias("n"), F.when(some, F.col("f.id")).otherwise(F.col("target")).alias("target"))
    out = settled.where("waits is null").select("id", "k", "n", "target").unionByName(late)
    tier = F.get(F.array(*[F.lit(t) for t in STEPS]), F.col("k"))
    return out.select("id", F.when(F.col("n") > 1, "ambiguous").otherwise(tier).alias("tier"), F.when(F.col("n") == 1, F.col("target")).alias("target"), "n")


def _repo(path: Column) -> Column:
    return F.split(path, "/")[0]


def _first_hit(imports: DataFrame, tried: DataFrame, known: DataFrame) -> DataFrame:
    """id, rank, target of the first of the tried keys (id, rank, repo, key) that is known (repo, key, target)."""
    k = known.select(F.col("repo").alias("kr"), F.col("key").alias("kk"), "target")
    return tried.join(k, (F.col("repo") == F.col("kr")) & (F.col("key") == F.col("kk"))).groupBy("id").agg(F.min_by("target", "rank").alias("target"), F.min("rank").alias("rank"))


def resolve_imports(imports: DataFrame, symbols: DataFrame, files: DataFrame, aliases: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """id, source_path, raw, target_path, how of import statements; target_path is null for packages from elsewhere.

    imports: id, source_path, raw; symbols: name, kind, file_path, conventional_fqn; files: file_path.
    An import only leads within its repository, the first folder of a path. Scripts: a relative path,
    or one that an alias (pattern, target, each with at most one star; a bounded setting) makes,
    with the usual endings and index files. Others: a conventional name, a Python module by
    any tail of its path, the module that holds the last part, the only file with a type of that
    name. The first that fits holds; of several files the first by path."""
    rows = imports.select("id", "source_path", "raw", _repo(F.col("source_path")).alias("repo"))
    script = F.col("source_path").rlike(r"\.(?:ts|tsx|js|jsx|mjs)$")
    folder = F.split(F.regexp_replace("source_path", "/?[^/]*$", ""), "/")
    ups = F.char_length(F.regexp_extract("raw", r"^(?:\./)*((?:\.\./)*)", 1)) / 3
    rest = F.regexp_replace("raw", r"^(?:\.\.?/)+", "")
    near = F.concat_ws("/", F.slice(folder, 1, F.greatest(F.size(folder) - ups, F.lit(0)).cast("int")), F.array(rest))
    base = F.when(F.col("raw").startswith("."), near)
    for pattern, target in aliases:
        form = _alias_regex(pattern)
        made = F.concat(F.col("repo"), F.lit("/"), F.regexp_replace("raw", form, target.replace("*", "$1")))
        base = F.coalesce(base, F.when(F.col("raw").rlike(form), made))
    bases = rows.where(script).withColumn("base", base).where("base is not null")
    endings = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(e).alias("ending")) for k, e in enumerate(SCRIPT_ENDINGS)])
    tried = bases.select("id", "repo", "base", F.inline(endings)).select("id", "rank", "repo", F.concat("base", "ending").alias("key"))
    paths = files.select(_repo(F.col("file_path")).alias("repo"), F.col("file_path").alias("key"), F.col("file_path").alias("target")).where("target is not null").distinct()
    by_script = _first_hit(rows, tried, paths).select("id", "target", F.lit("path").alias("how"))

    parts = F.split(F.regexp_replace(F.regexp_replace("file_path", r"\.py$", ""), "/__init__$", ""), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    modules = files.where("file_path like '%.py'").select(_repo(F.col("file_path")).alias("repo"), "file_path", F.explode(tails).alias("key")).groupBy("repo", "key").agg(F.min("file_path").alias("target"))
    named = symbols.where("conventional_fqn is not null and file_path is not null").groupBy(_repo(F.col("file_path")).alias("repo"), F.col("conventional_fqn").alias("key")).agg(F.min("file_path").alias("target"))
    typed = symbols.where(F.col("kind").isin(*TYPE_KINDS) & F.col("file_path").isNotNull()).groupBy(_repo(F.col("file_path")).alias("repo"), F.col("name").alias("key")).agg(F.min("file_path").alias("target"), F.max("file_path").alias("last"))
    others = rows.where(~script)
    as_is = others.select("id", F.lit(0).alias("rank"), "repo", F.col("raw").alias("key"))
    holder = others.where("raw like '%.%'").select("id", F.lit(1).alias("rank"), "repo", F.regexp_replace("raw", r"\.[^.]*$", "").alias("key"))
    leaf = others.select("id", F.lit(0).alias("rank"), "repo", F.regexp_extract("raw", r"([^.]*)$", 1).alias("key"))
    ways = [("conventional", _first_hit(others, as_is, named)), ("module", _first_hit(others, as_is.unionByName(holder), modules)), ("type", _first_hit(others, leaf, typed.where("target = last")))]
    got = by_script
    out = rows
    for k, (how, found) in enumerate(ways):
        out = out.join(found.select(F.col("id").alias(f"i{k}"), F.struct(F.col("target"), F.lit(how).alias("how")).alias(f"h{k}")), F.col("id") == F.col(f"i{k}"), "left")
    out = out.join(got.select(F.col("id").alias("i9"), F.struct("target", "how").alias("h9")), F.col("id") == F.col("i9"), "left")
    hit = F.coalesce("h9", *[f"h{k}" for k in range(len(ways))])
    return out.select("id", "source_path", "raw", hit["target"].alias("target_path"), F.coalesce(hit["how"], F.lit("external")).alias("how"))


def _alias_regex(pattern: str) -> str:
    return "^" + "(.*)".join("".join("\\" + c if not c.isalnum() else c for c in part) for part in pattern.split("*", 1)) + "$"


def refined_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, edge_type, resolution_tier of resolved edges as they are to be stored.

    A class that inherits from an interface implements it; a reference to a call's target that
    can't be called is a usage; an exact tier that came about by an import or an inferred type says
    so. Edges from a symbol to itself only stay if the line lies within its declaration."""
    s = symbols.select(F.col("id").alias("sid"), F.col("kind").alias("skind"), F.col("line_start").alias("s0"), F.col("line_end").alias("s1"))
    t = symbols.select(F.col("id").alias("tid"), F.col("kind").alias("tkind"))
    rows = edges.where("resolved and target_symbol_id is not null").join(s, F.col("source_symbol_id") == F.col("sid"), "left").join(t, F.col("target_symbol_id") == F.col("tid"), "left")
    line = F.get("source_range", F.lit(0))
    inside = F.coalesce((line >= F.col("s0")) & (line <= F.col("s1")), F.lit(False))
    kind = (
        F.when((F.col("edge_type") == "INHERITS") & (F.col("skind") == "class") & (F.col("tkind") == "interface"), "IMPLEMENTS")
        .when((F.col("edge_type") == "CALL_REFERENCE") & ~F.coalesce(F.col("tkind").isin("function", "method", "constructor"), F.lit(False)), "USAGE")
        .otherwise(F.col("edge_type"))
    )
    via = F.col("properties")["via"]
    tier = F.when((F.col("resolution_tier") == "exact") & via.isin("import", "type_infer"), via).otherwise(F.col("resolution_tier"))
    return rows.where((F.col("source_symbol_id") != F.col("target_symbol_id")) | inside).select("id", kind.alias("edge_type"), tier.alias("resolution_tier"))


def member_implementations(symbols: DataFrame, resolved: DataFrame, members: DataFrame) -> DataFrame:
    """member_id, type_id, implementation_id, how: what stands for a member in every type below its own.

    members: id. ``declared``: the type's own member of the name, of the same parameter types where it
    has one, else the first; ``inherited``: that of its nearest ancestor, other than the member itself.
    Types with neither have a null implementation and how ``none``."""
    methods = symbols.where("parent_symbol_id is not null and kind in ('method', 'function', 'constructor')").select("id", "name", F.col("parent_symbol_id").alias("owner"), F.array_join(parameter_types(F.col("fqn")), ",").alias("types"))
    asked = methods.join(members.select(F.col("id").alias("w")), F.col("id") == F.col("w"), "left_semi").select(F.col("id").alias("member_id"), F.col("name").alias("mname"), "owner", F.col("types").alias("mtypes"))
    below = subtype_closure(resolved, asked.select(F.col("owner").alias("root")))
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("k"))
    pairs = asked.join(below, F.col("owner") == F.col("root")).join(types, F.col("subtype") == F.col("k"), "left_semi").select("member_id", "mname", "mtypes", F.col("subtype").alias("type_id"))
    own = methods.select(F.col("id").alias("oid"), F.col("name").alias("oname"), F.col("owner").alias("oowner"), F.col("types").alias("otypes"))
    declared = pairs.join(own, (F.col("type_id") == F.col("oowner")) & (F.col("mname") == F.col("oname")) & (F.col("oid") != F.col("member_id")))
    declared = declared.groupBy("member_id", "type_id").agg(F.min(F.struct(F.col("otypes") != F.col("mtypes"), "oid"))["oid"].alias("own_id"))
    up = resolved.where("edge_type in ('INHERITS', 'IMPLEMENTS')").select(F.col("source_symbol_id").alias("a"), F.col("target_symbol_id").alias("b")).where("a <> b")
    met = pairs.join(declared.withColumnsRenamed({"member_id": "dm", "type_id": "dt"}), (F.col("member_id") == F.col("dm")) & (F.col("type_id") == F.col("dt")), "left").drop("dm", "dt")
    lacking = met.where("own_id is null").select(F.col("type_id").alias("root")).distinct()
    above = reach_by_root(up, lacking, ANCESTOR_LEVELS).where("root <> node")
    far = met.where("own_id is null").join(above, F.col("type_id") == F.col("root")).join(own, (F.col("node") == F.col("oowner")) & (F.col("mname") == F.col("oname")) & (F.col("oid") != F.col("member_id")))
    inherited = far.groupBy(F.col("member_id").alias("im"), F.col("type_id").alias("it")).agg(F.min(F.struct("depth", F.col("otypes") != F.col("mtypes"), "oid"))["oid"].alias("far_id"))
    out = met.join(inherited, (F.col("member_id") == F.col("im")) & (F.col("type_id") == F.col("it")), "left")
    how = F.when(F.col("own_id").isNotNull(), "declared").when(F.col("far_id").isNotNull(), "inherited").otherwise("none")
    return out.select("member_id", "type_id", F.coalesce("own_id", "far_id").alias("implementation_id"), how.alias("how"))
