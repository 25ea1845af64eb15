"""Graph statics: degrees, importance, statistics, derived edges, validation, dead code, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import stem
from codeloom.functions.text import leaf
from codeloom.operators.common import lookup_join

#: Types that count for degrees and as evidence of use (TESTS is derived from them).
USE_TYPES = ("CALLS", "INHERITS", "IMPLEMENTS", "REFERENCES", "USAGE", "CALL_REFERENCE")
IMPORTANCE_TYPES = ("CALLS", "USAGE")
CALLABLE_KINDS = ("function", "method", "constructor")
TYPE_KINDS = ("class", "interface", "enum", "type_alias")
#: Trust in a resolution, by tier.
CONFIDENCE = {
    "exact": "EXTRACTED", "conventional": "EXTRACTED", "import": "EXTRACTED", "same_file": "INFERRED", "range": "INFERRED",
    "type_infer": "INFERRED", "derived": "INFERRED", "fallback": "AMBIGUOUS", "ambiguous": "AMBIGUOUS",
}
CONFIDENCE_RANK = {"EXTRACTED": 0, "INFERRED": 1, "AMBIGUOUS": 2, "UNRESOLVED": 3}
LOW_TIERS = ("ambiguous", "fallback")
#: Annotations that make a symbol an entry point.
ENTRY_ANNOTATIONS = (
    r"(?i)@(?:app\.(?:route|get|post|put|patch|delete|websocket)|router\.|blueprint\.|(?:get|post|put|delete|patch|head|options|request)mapping"
    r"|path|route|handler|endpoint|(?:rest)?controller|pytest\.fixture|fixture|bean|eventlistener|scheduled|commandlinerunner|applicationrunner"
    r"|(?:before|after)each|main)"
)


def confidence(tier: Column, resolved: Column) -> Column:
    """The trust label of an edge; unknown tiers of resolved edges are inferred."""
    pairs = [F.lit(x) for kv in CONFIDENCE.items() for x in kv]
    return F.when(~resolved, "UNRESOLVED").otherwise(F.coalesce(F.create_map(*pairs)[F.coalesce(tier, F.lit(""))], F.lit("INFERRED")))


def confidence_rank(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CONFIDENCE_RANK.items() for x in kv])[label]


def degrees(resolved: DataFrame) -> DataFrame:
    """symbol_id, edge_type, in_count, out_count over resolved edges.

    Both ends of every edge become one stream of increments, so one partial and final aggregation
    serves both directions."""
    ends = resolved.select(
        "edge_type",
        F.inline(
            F.array(
                F.struct(F.col("source_symbol_id").alias("symbol_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("target_symbol_id").alias("symbol_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ),
    )
    return ends.groupBy("symbol_id", "edge_type").agg(F.sum("i").alias("in_count"), F.sum("o").alias("out_count"))


def total_degrees(resolved: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """symbol_id, in_degree, out_degree, degree."""
    kept = resolved.where(F.col("edge_type").isin(*types)) if types else resolved
    by = degrees(kept).groupBy("symbol_id").agg(F.sum("in_count").alias("in_degree"), F.sum("out_count").alias("out_degree"))
    return by.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def importance(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """id, importance: root of incoming calls and usages, scaled by what the name and place say.

    Times 0.1 each for narrow visibility, for a name declared in five files or more and for tests;
    times 10 for a descriptive name of eight letters or more (camel case or underscore)."""
    uses = (
        resolved.where(F.col("edge_type").isin(*IMPORTANCE_TYPES))
        .groupBy(F.col("target_symbol_id").alias("t")).agg(F.count("*").alias("uses"))
    )
    spread = symbols.groupBy(F.col("name").alias("n")).agg(F.count_distinct("file_path").alias("files"))
    # a name can be declared everywhere: the join side is one row per name, the planner may broadcast it
    s = symbols.join(uses, F.col("id") == F.col("t"), "left").join(spread, F.col("name") == F.col("n"), "left")
    descriptive = (F.char_length("name") >= 8) & (F.col("name").contains("_") | F.col("name").rlike("[a-z0-9][A-Z]"))
    score = (
        F.sqrt(F.coalesce("uses", F.lit(0)).cast("double"))
        * F.when(F.col("visibility").isin("private", "package", "internal"), 0.1).otherwise(1.0)
        * F.when(F.col("files") >= 5, 0.1).otherwise(1.0)
        * F.when(descriptive, 10.0).otherwise(1.0)
        * F.when(F.col("is_test"), 0.1).otherwise(1.0)
    )
    return s.select("id", F.round(score, 6).alias("importance"))


def edge_stats(edges: DataFrame) -> DataFrame:
    """edge_type, total, resolved, ratio."""
    by = edges.groupBy("edge_type").agg(F.count("*").alias("total"), F.count_if(F.col("resolved") & F.col("target_symbol_id").isNotNull()).alias("resolved"))
    return by.withColumn("ratio", F.round(F.col("resolved") / F.col("total"), 4))


def graph_schema(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """section, key, n: labels, edge types, tiers, languages and property keys with their counts."""
    def section(name: str, df: DataFrame, key: Column) -> DataFrame:
        return df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "key", "n")

    parts = [
        section("label", symbols, F.col("kind")), section("language", symbols, F.col("language")), section("edge_type", edges, F.col("edge_type")),
        section("tier", edges, F.col("resolution_tier")), section("property", edges.select(F.explode(F.map_keys("properties")).alias("p")), F.col("p")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unresolved_targets(edges: DataFrame, top: int) -> DataFrame:
    """target_raw, n of the raw targets that most unresolved edges name (a top list)."""
    raw = edges.where("not resolved and target_raw is not null and target_raw <> ''")
    return raw.groupBy("target_raw").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_raw").limit(top)


def tests_edges(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """source_symbol_id, target_symbol_id of TESTS edges: uses of production code by test code."""
    flag = symbols.select(F.col("id").alias("sid"), F.col("is_test").alias("stest"))
    uses = resolved.where(F.col("edge_type").isin(*USE_TYPES)).where("source_symbol_id <> target_symbol_id")
    pairs = uses.select("source_symbol_id", "target_symbol_id").distinct()
    tests = pairs.join(flag.where("stest"), F.col("source_symbol_id") == F.col("sid"), "left_semi")
    return tests.join(flag.where("not stest"), F.col("target_symbol_id") == F.col("sid"), "left_semi")


def arity(fqn: Column) -> Column:
    """Parameters in the list that ends a name; null where there is no list. Generics are stripped,
    so their commas do not count."""
    inner = F.regexp_extract(fqn, r"\(([^()]*)\)$", 1)
    for _ in range(3):
        inner = F.regexp_replace(inner, r"[<\[][^<>\[\]]*[>\]]", "")
    return F.when(fqn.rlike(r"\([^()]*\)$"), F.when(F.trim(inner) == "", 0).otherwise(F.size(F.split(inner, ","))))


def subtype_closure(resolved: DataFrame, roots: DataFrame) -> DataFrame:
    """root, subtype: everything that implements or inherits from a root, directly or not.

    roots: root. Level by level; a level is joined and cut, and pairs that are known are dropped,
    so circles end; there is no bound on the depth."""
    from codeloom.operators.common import cut

    up = resolved.where(F.col("edge_type").isin("IMPLEMENTS", "INHERITS")).select(F.col("target_symbol_id").alias("base"), F.col("source_symbol_id").alias("sub")).distinct()
    up = cut(up)
    level = cut(roots.select("root").distinct().join(up, F.col("root") == F.col("base")).select("root", F.col("sub").alias("subtype")))
    known = level
    while level.limit(1).count():
        level = cut(
            level.join(up, F.col("subtype") == F.col("base")).select("root", F.col("sub").alias("subtype")).distinct().join(known, ["root", "subtype"], "left_anti")
        )
        known = known.unionByName(level)
    return known.where("root <> subtype").distinct()


def dispatch_edges(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """source_symbol_id, target_symbol_id of calls that an interface method passes to those who
    implement it: same name, compatible arity, no existing call."""
    kinds = symbols.select(F.col("id").alias("pid"), F.col("kind").alias("pkind"))
    methods = symbols.where("kind in ('method', 'constructor') and parent_symbol_id is not null").select(
        F.col("id").alias("mid"), F.col("name").alias("mname"), F.col("parent_symbol_id").alias("owner"), arity(F.col("fqn")).alias("n")
    )
    declared = (
        symbols.where("parent_symbol_id is not null")
        .select(F.col("id").alias("did"), F.col("name").alias("dname"), F.col("parent_symbol_id").alias("interface"), arity(F.col("fqn")).alias("dn"))
        .join(kinds.where("pkind = 'interface'"), F.col("interface") == F.col("pid"), "left_semi")
    )
    calls = resolved.where("edge_type = 'CALLS'").select("source_symbol_id", "target_symbol_id").distinct()
    through = calls.join(declared, F.col("target_symbol_id") == F.col("did")).select("source_symbol_id", "dname", "dn", "interface").distinct()
    closure = subtype_closure(resolved, through.select(F.col("interface").alias("root")))
    met = through.join(closure, F.col("interface") == F.col("root")).join(
        methods, (F.col("subtype") == F.col("owner")) & (F.col("dname") == F.col("mname")) & (F.col("dn").isNull() | F.col("n").isNull() | (F.col("dn") == F.col("n")))
    )
    new = met.where("source_symbol_id <> mid").select("source_symbol_id", F.col("mid").alias("target_symbol_id")).distinct()
    return new.join(calls, ["source_symbol_id", "target_symbol_id"], "left_anti")


def validated_edges(symbols: DataFrame, edges: DataFrame, hot: Sequence[int] = ()) -> DataFrame:
    """id, dropped_by of every edge that fails validation, by the first rule that it breaks; hot:
    targets of very many edges.

    1 a self edge whose call does not lie in the declaration; 2 a call line outside of the caller;
    3 a target of the same name in the same file; 4 a range or fallback tier beside a surviving
    edge of a better tier to the same name."""
    s = symbols.select(F.col("id").alias("source_symbol_id"), F.col("line_start").alias("s0"), F.col("line_end").alias("s1"), F.col("name").alias("sname"), F.col("file_path").alias("sfile"))
    t = symbols.select(F.col("id").alias("_t"), F.col("name").alias("tname"), F.col("file_path").alias("tfile"))
    line = F.get("source_range", F.lit(0))
    e = edges.select("id", "source_symbol_id", "target_symbol_id", "resolution_tier", line.alias("line")).join(s, "source_symbol_id", "left")
    e = lookup_join(e, t, "target_symbol_id", "_t", list(hot), "left")
    inside = F.coalesce((F.col("line") >= F.col("s0")) & (F.col("line") <= F.col("s1")), F.lit(False))
    rule = (
        F.when((F.col("source_symbol_id") == F.col("target_symbol_id")) & ~inside, 1)
        .when(F.col("line").isNotNull() & F.col("s0").isNotNull() & F.col("s1").isNotNull() & ~inside, 2)
        .when((F.col("source_symbol_id") != F.col("target_symbol_id")) & (F.col("sname") == F.col("tname")) & (F.col("sfile") == F.col("tfile")), 3)
    )
    ruled = e.withColumn("rule", rule)
    better = ruled.where("rule is null and resolution_tier in ('exact', 'conventional', 'same_file') and tname is not null")
    better = better.select(F.col("source_symbol_id").alias("bs"), F.col("tname").alias("bn")).distinct()
    last = ruled.where("rule is null and resolution_tier in ('range', 'fallback')").join(
        better, (F.col("source_symbol_id") == F.col("bs")) & (F.col("tname") == F.col("bn")), "left_semi"
    )
    return ruled.where("rule is not null").select("id", F.col("rule").alias("dropped_by")).unionByName(last.select("id", F.lit(4).alias("dropped_by")))


def entry_points(symbols: DataFrame, resolved: DataFrame, configured: Sequence[str] = ()) -> DataFrame:
    """id, reason of every entry point; the first rule that holds gives the reason."""
    bases = resolved.where(F.col("edge_type").isin("INHERITS", "IMPLEMENTS")).select(F.col("source_symbol_id").alias("sub"), F.col("target_symbol_id").alias("base")).distinct()
    members = symbols.where("parent_symbol_id is not null").select(F.col("parent_symbol_id").alias("owner"), F.col("name").alias("mname")).distinct()
    methods = symbols.where("kind = 'method' and parent_symbol_id is not null").select("id", "name", "parent_symbol_id")
    overrides = (
        methods.join(bases, F.col("parent_symbol_id") == F.col("sub"))
        .join(members, (F.col("base") == F.col("owner")) & (F.col("name") == F.col("mname")), "left_semi")
        .select(F.col("id").alias("oid")).distinct()
    )
    s = symbols.join(overrides, F.col("id") == F.col("oid"), "left")
    patterns = "|".join("(?s:" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in p) + ")" for p in configured)
    reason = (
        F.when(F.col("is_test"), "test")
        .when(F.col("name").isin("main", "__main__") & F.col("kind").isin("function", "method"), "main")
        .when((F.col("kind") == "constructor") | (F.col("name").isin("__init__", "__new__") & F.col("parent_symbol_id").isNotNull()), "constructor")
        .when(F.col("oid").isNotNull(), "override")
        .when(F.col("parent_symbol_id").isNull() & (F.col("visibility") == "public"), "exported")
        .when(F.col("declared_rules").rlike(ENTRY_ANNOTATIONS), "annotation")
    )
    if patterns:
        reason = reason.when(F.col("name").rlike(f"^(?:{patterns})$") | F.col("fqn").rlike(f"^(?:{patterns})$"), "configured")
    return s.select("id", reason.alias("reason")).where("reason is not null")


def incoming_evidence(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """t, proven, low_confidence, test_usage: uses of a symbol by kind of evidence."""
    src = symbols.select(F.col("id").alias("sid"), F.col("is_test").alias("stest"))
    uses = resolved.where(F.col("edge_type").isin(*USE_TYPES)).select("source_symbol_id", F.col("target_symbol_id").alias("t"), F.coalesce("resolution_tier", F.lit("")).alias("tier"))
    low = F.col("tier").isin(*LOW_TIERS)
    return (
        uses.join(src, F.col("source_symbol_id") == F.col("sid"))
        .groupBy("t")
        .agg(F.count_if(~F.col("stest") & ~low).alias("proven"), F.count_if(~F.col("stest") & low).alias("low_confidence"), F.count_if("stest").alias("test_usage"))
    )


def dead_code(symbols: DataFrame, edges: DataFrame, kinds: Sequence[str] = CALLABLE_KINDS, include_entry_points: bool = False, include_tests: bool = False) -> DataFrame:
    """id, fqn, kind, confidence, low_confidence, test_usage, unresolved of callables without proven use.

    Members of interfaces are left out, tests and entry points unless asked for. unresolved counts
    unresolved edges whose raw target, taken apart into words, has the name among them: an
    equi-join in place of the substring test of every name against every target."""
    resolved = edges.where("resolved and target_symbol_id is not null")
    seen = incoming_evidence(symbols, resolved)
    parents = symbols.select(F.col("id").alias("pid"), F.col("kind").alias("pkind"))
    wanted = symbols.where(F.col("kind").isin(*kinds))
    if not include_tests:
        wanted = wanted.where("not is_test")
    if not include_entry_points:
        wanted = wanted.where("not is_entry_point")
    raw = edges.where("not resolved and target_raw is not null and target_raw <> ''").where(F.col("edge_type").isin(*USE_TYPES))
    words = raw.select("id", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(target_raw, '[A-Za-z0-9_]+', 0)"))).alias("word"))
    named = words.groupBy("word").agg(F.count("*").alias("unresolved"))
    rows = (
        wanted.join(parents, F.col("parent_symbol_id") == F.col("pid"), "left")
        .where("coalesce(pkind, '') <> 'interface'")
        .join(seen, F.col("id") == F.col("t"), "left")
        .where("coalesce(proven, 0) = 0")
        .join(named, F.col("name") == F.col("word"), "left")
    )
    low, test, open_ = (F.coalesce(c, F.lit(0)) for c in ("low_confidence", "test_usage", "unresolved"))
    label = F.when(low > 0, "low").when((test > 0) | (open_ > 0), "medium").otherwise("high")
    return rows.select("id", "fqn", "kind", label.alias("confidence"), low.alias("low_confidence"), test.alias("test_usage"), open_.alias("unresolved"), "importance", "is_test")


def symbol_search(
    symbols: DataFrame, resolved: DataFrame, text: str | None = None, name_pattern: str | None = None, kinds: Sequence[str] | None = None,
    path_glob: str | None = None, min_degree: int | None = None, max_degree: int | None = None, exclude_entry_points: bool = True, qualified_pattern: str | None = None,
    edge_types: Sequence[str] = USE_TYPES, connected: int = 0,
) -> DataFrame:
    """id, fqn, kind, degree, importance of symbols that meet every given condition.

    text is a substring of name, fqn or docstring in any case; name_pattern and qualified_pattern are
    full matches of name and fqn; the degree counts uses of the edge types, and its bounds hold
    before any paging. connected adds the names of so many neighbours, the most used first."""
    out = symbols
    if text:
        needle = text.lower()
        out = out.where(F.lower("name").contains(needle) | F.lower("fqn").contains(needle) | F.lower(F.coalesce("docstring", F.lit(""))).contains(needle))
    if name_pattern:
        out = out.where(F.col("name").rlike(rf"\A(?:{name_pattern})\z"))
    if qualified_pattern:
        out = out.where(F.col("fqn").rlike(rf"\A(?:{qualified_pattern})\z"))
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if path_glob:
        out = out.where(F.col("file_path").rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_/-" else "\\" + c for c in path_glob) + "$"))
    if exclude_entry_points:
        out = out.where("not is_entry_point")
    found = out.join(total_degrees(resolved, edge_types), F.col("id") == F.col("symbol_id"), "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if min_degree is not None:
        found = found.where(F.col("degree") >= min_degree)
    if max_degree is not None:
        found = found.where(F.col("degree") <= max_degree)
    shown = found.select("id", "fqn", "kind", "degree", "importance")
    if not connected:
        return shown
    uses = resolved.where(F.col("edge_type").isin(*edge_types)).where("source_symbol_id <> target_symbol_id")
    ends = uses.select(F.col("source_symbol_id").alias("me"), F.col("target_symbol_id").alias("other")).unionByName(uses.select(F.col("target_symbol_id").alias("me"), F.col("source_symbol_id").alias("other")))
    counted = ends.join(shown.select(F.col("id").alias("s")), F.col("me") == F.col("s"), "left_semi").groupBy("me", "other").agg(F.count("*").alias("n"))
    first = top_per_group(counted, ["me"], [F.desc("n"), F.col("other")], connected)
    names = first.join(symbols.select(F.col("id").alias("o"), F.col("fqn").alias("ofqn")), F.col("other") == F.col("o"))
    by = names.groupBy("me").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "other", "ofqn"))), lambda x: x["ofqn"]).alias("connected"))
    return shown.join(by, F.col("id") == F.col("me"), "left").drop("me")


def outline(symbols: DataFrame, path: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """The symbols of one file in reading order."""
    out = symbols.where(F.col("file_path") == path)
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    return out.select("id", "name", "kind", "line_start", "line_end", "visibility").orderBy("line_start", "id")


def hotspots(symbols: DataFrame, resolved: DataFrame, top: int) -> DataFrame:
    """The most important symbols with any edge, tests left out (a top list)."""
    all_degrees = total_degrees(resolved)
    rows = symbols.where("not is_test").join(all_degrees, F.col("id") == F.col("symbol_id")).where("degree > 0")
    return rows.select("id", "fqn", "importance", "degree").orderBy(F.desc("importance"), F.desc("degree"), "fqn").limit(top)


def isolated(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """Symbols without any resolved edge."""
    ends = resolved.select(F.explode(F.array("source_symbol_id", "target_symbol_id")).alias("e")).distinct()
    return symbols.join(ends, F.col("id") == F.col("e"), "left_anti").select("id", "fqn")


def packages(symbols: DataFrame) -> DataFrame:
    """package, files, symbols, tests: by directory of the file."""
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    return symbols.groupBy(folder.alias("package")).agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("symbols"), F.count_if("is_test").alias("tests"))


def canonical_names(symbols: DataFrame) -> DataFrame:
    """id, canonical: the stated canonical name, else the conventional one, else the leaf's path."""
    return symbols.select("id", F.coalesce("canonical_fqn", "conventional_fqn", "fqn").alias("canonical"))


def implementations(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """interface_id, type_id, direct of every type below an interface."""
    roots = symbols.where("kind = 'interface'").select(F.col("id").alias("root"))
    closure = subtype_closure(resolved, roots)
    direct = resolved.where(F.col("edge_type").isin("IMPLEMENTS", "INHERITS")).select(F.col("target_symbol_id").alias("b"), F.col("source_symbol_id").alias("s")).distinct()
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("k"))
    return (
        closure.join(types, F.col("subtype") == F.col("k"), "left_semi")
        .join(direct, (F.col("root") == F.col("b")) & (F.col("subtype") == F.col("s")), "left")
        .select(F.col("root").alias("interface_id"), F.col("subtype").alias("type_id"), F.col("b").isNotNull().alias("direct"))
    )


def smallest_enclosing(points: DataFrame, spans: DataFrame, keep: Sequence[str], bin_lines: int = 100) -> DataFrame:
    """The smallest span of the same file that encloses each point, by bins of lines.

    points: file_path, line and ``keep``; spans: file_path, line_start, line_end, span_id. A span
    stands in every bin that it crosses, so the join is by (file, bin) and never by file alone."""
    bins = F.sequence(F.floor(F.col("line_start") / bin_lines), F.floor(F.greatest("line_end", "line_start") / bin_lines))
    wide = spans.where("line_start is not null and line_end is not null").select(
        F.col("file_path").alias("f"), "line_start", "line_end", "span_id", F.explode(bins).alias("bin")
    )
    p = points.withColumn("bin_p", F.floor(F.col("line") / bin_lines))
    met = p.join(wide, (F.col("file_path") == F.col("f")) & (F.col("bin_p") == F.col("bin")) & F.col("line").between(F.col("line_start"), F.col("line_end")))
    best = F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("size"), "span_id")).alias("m")
    return met.groupBy(*keep, "file_path", "line").agg(best).select(*keep, "file_path", "line", F.col("m.span_id").alias("span_id"))


def page_with_total(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """One page and the exact total: a count and a sorted page, not a window over everything."""
    return df.orderBy(*order).offset(offset).limit(limit), df.count()


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group. Groups of any size: the rank filter is pushed below the
    shuffle as a limit per task and group."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def call_pages(resolved: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """symbol_id, direction (callers, callees), neighbour, calls, total: one page of each direction of
    every symbol, the most calls first, with the exact number of neighbours.

    Calls are added up before anything is ranked, and totals come from a count with partial sums, so
    a symbol that a third of all rows call stays bounded in every task. Edges without an end give no row."""
    calls = resolved.where("edge_type = 'CALLS' and source_symbol_id is not null and target_symbol_id is not null")
    ends = [("callees", "source_symbol_id", "target_symbol_id"), ("callers", "target_symbol_id", "source_symbol_id")]
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.col(a).alias("symbol_id"), F.col(b).alias("neighbour")) for d, a, b in ends]))
    pairs = calls.select(sides.alias("s")).select("s.*").groupBy("symbol_id", "direction", "neighbour").agg(F.count("*").alias("calls"))
    totals = pairs.groupBy("symbol_id", "direction").agg(F.count("*").alias("total"))
    ranked = pairs.withColumn("_rank", F.row_number().over(Window.partitionBy("symbol_id", "direction").orderBy(F.desc("calls"), F.asc("neighbour"))))
    return ranked.where(F.col("_rank") <= offset + limit).where(F.col("_rank") > offset).drop("_rank").join(totals, ["symbol_id", "direction"])


def chunk_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunk_id, symbol_id, how: the symbol that a chunk stands for.

    By its full name (fqn), else the smallest span of its file that encloses its first line (span),
    else a symbol of its file with the last part of its name (name) or named as the file (stem). Of
    several, the one with the least id; chunks that nothing fits give no row, nor do nulls."""
    chunks = chunks.select("id", "fqn", "file_path", "line_start").withColumnsRenamed({"fqn": "c_fqn"})
    named = symbols.where("name is not null").groupBy(F.col("file_path").alias("f"), F.col("name").alias("s_name")).agg(F.min("id").alias("symbol_id"))
    full = symbols.groupBy(F.col("fqn").alias("s_fqn")).agg(F.min("id").alias("symbol_id"))
    points = chunks.where("file_path is not null").select(F.col("id").alias("chunk_id"), "file_path", F.col("line_start").alias("line"))
    spans = symbols.select("file_path", "line_start", "line_end", F.col("id").alias("span_id"))
    in_file = lambda part: (F.col("file_path") == F.col("f")) & (part == F.col("s_name"))
    found = [
        chunks.join(full, F.col("c_fqn") == F.col("s_fqn")).select(F.col("id").alias("chunk_id"), "symbol_id"),
        smallest_enclosing(points, spans, ["chunk_id"]).select("chunk_id", F.col("span_id").alias("symbol_id")),
        chunks.join(named, in_file(leaf(F.col("c_fqn")))).select(F.col("id").alias("chunk_id"), "symbol_id"),
        chunks.join(named, in_file(stem(F.col("file_path")))).select(F.col("id").alias("chunk_id"), "symbol_id"),
    ]
    ways = F.array(*[F.lit(w) for w in ("fqn", "span", "name", "stem")])
    every = found[0].withColumn("way", F.lit(1))
    for n, rows in enumerate(found[1:], 2):
        every = every.unionByName(rows.withColumn("way", F.lit(n)))
    best = every.groupBy("chunk_id").agg(F.min(F.struct("way", "symbol_id")).alias("m"))
    return best.select("chunk_id", "m.symbol_id", F.element_at(ways, F.col("m.way")).alias("how"))
