"""Passes that re-score a pool of candidates, find named answers that it lacks, or reject it.

A pool is (id, score). Passes that add look at every definition of the corpus, not only at the
pool, and scale what they add by the pool's maximum; gates look at a few numbers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import text as X
from codeloom.operators.rank import FACTORS, MIN_LIFT, RANK_CLASS, pool_max

#: Strengths of the passes, as multiples of the pool's maximum, and their bounds.
STEM_MATCH, STEM_RELATED = 1.5, 1.0
EMBEDDED = 0.5
CONCEPT = {"boost": 0.7, "cap": 0.6, "anchor": 1.8, "anchor_cap": 2.0, "least_ratio": 0.2, "new_ratio": 0.34, "common": 0.25, "terms": 6, "pool": 100}
ENDPOINT = {"boost": 2.0, "cap": 1.5}
CONSTANT = {"boost": 1.4, "cap": 1.5}
PATH_BOOST, PATH_PREFIX, PATH_KEYWORDS = 1.0, 3, 2
RANKED_FLOOR = 0.05
GATE = {"informative": 1, "concepts": 2, "coverage": 0.5, "cosine": 0.5}
EXACT_BOOST, NON_CODE, CONFIG_CONTENT = 0.5, 0.7, 1.5
#: Annotations of endpoints by verb, and words that ask for one.
VERBS = {"get": "GetMapping", "post": "PostMapping", "put": "PutMapping", "patch": "PatchMapping", "delete": "DeleteMapping"}
ENDPOINT_WORDS = frozenset("endpoint endpoints route routes api apis request requests controller controllers mapping handler http".split())
CONSTANT_WORDS = frozenset("default constant final".split())
CALLABLE = ("function", "method", "constructor")
BOILERPLATE_ROLES = ("model", "dto", "assembler", "exception")


def bounded(score: Column) -> Column:
    """A score of any size in [0, 1)."""
    return score / (1 + score)


def inject(scored: DataFrame, added: DataFrame) -> DataFrame:
    """id, score of the pool with what is added (id, add), candidates outside of it too."""
    more = added.select(F.col("id").alias("aid"), "add")
    both = scored.select("id", "score").join(more, F.col("id") == F.col("aid"), "full")
    return both.select(F.coalesce("id", "aid").alias("id"), (F.coalesce("score", F.lit(0.0)) + F.coalesce("add", F.lit(0.0))).alias("score"))


def named(chunks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Definitions whose own name is one of the names."""
    return chunks.where(F.coalesce("is_definition", F.lit(False)) & X.leaf(F.col("fqn")).isin(*names)) if names else chunks.where("false")


def stem_rescue(scored: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    """Definitions of a name in a file whose stem begins the name's first word, or is begun by it."""
    first = X.split_identifier(name)[0] if X.split_identifier(name) else name.lower()
    stem = F.lower(P.stem(F.col("file_path")))
    factor = F.when(F.startswith(F.lit(first), stem), STEM_MATCH).when(F.startswith(stem, F.lit(first)), STEM_RELATED)
    return inject(scored, named(chunks, [name]).select("id", (factor * pool_max(scored)).alias("add")).where("add is not null"))


def embedded_names(symbols: DataFrame, query: str) -> list[str]:
    """Identifiers in a question that name exactly one symbol."""
    words = {w for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", query) if "_" in w or (w != w.lower() and w != w.upper())}
    rows = symbols.where(F.col("name").isin(*words)).groupBy("name").agg(F.count("*").alias("n")).where("n = 1").collect() if words else []
    return sorted(r["name"] for r in rows)


def definition_pass(scored: DataFrame, chunks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Definitions of the names that a question contains, or of one ambiguous name."""
    return inject(scored, named(chunks, names).select("id", F.lit(EMBEDDED * pool_max(scored)).alias("add")))


def concept_terms(stats: DataFrame, total: int, query: str) -> list[str]:
    """The rarest concepts of a question that the corpus knows and that no quarter of it shares."""
    words = [w for w in X.collapse(X.decompose(query)) if len(w) >= 3 and w not in X.STOP_WORDS]
    if not words or not total:
        return []
    rows = stats.where(F.col("key").isin(*words, *[w[:3] for w in words])).groupBy("section", "key").agg(F.sum("doc_count").alias("d")).collect()
    seen = {(r["section"], r["key"]): r["d"] for r in rows}
    counted = [(seen.get(("token", w)) or seen.get(("prefix", w[:3]), 0), w) for w in words]
    most = max(3, int(total * CONCEPT["common"]))
    return [w for d, w in sorted(counted, key=lambda p: p[0]) if 0 < d <= most][: int(CONCEPT["terms"])]


def _short(fqn: Column) -> Column:
    return F.regexp_replace(F.coalesce(fqn, F.lit("")), r"^.*::", "")


def _words(text: Column) -> Column:
    """Sub-words of all identifiers in a text."""
    return F.filter(F.flatten(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), X.subwords)), lambda x: x != "")


def _member(fqn: Column) -> Column:
    """Sub-words of the member in ``path::Type.member``; none for a bare type."""
    short = F.regexp_replace(_short(fqn), r"\(.*$", "")
    return F.when(short.contains("."), X.subwords(F.regexp_extract(short, r"([^.]*)$", 1))).otherwise(F.array().cast("array<string>"))


def concept_weights(scored: DataFrame, chunks: DataFrame, terms: Sequence[str]) -> dict[str, float]:
    """Weight of each term: the rarer among the pool's first hundred, the more it tells."""
    first = scored.orderBy(F.round("score", 9).desc(), "id").limit(int(CONCEPT["pool"])).select("id")
    rows = chunks.join(F.broadcast(first), "id", "left_semi").select(F.coalesce("subwords", F.array().cast("array<string>")).alias("w"))
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(X.concept_match(F.col("w"), t)).alias(f"c{k}") for k, t in enumerate(terms)]).first()
    size = counts["n"] or 1
    return {t: math.log(1 + size / (1 + counts[f"c{k}"])) for k, t in enumerate(terms)}


def concept_pass(scored: DataFrame, chunks: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Definitions whose names carry the rare terms of a question, by the share of their weight.

    A callable whose own name has one is the named answer and may go further. Nothing is added
    if the pool's best already carries all terms that any name has."""
    weights = concept_weights(scored, chunks, terms) if terms else {}
    floor = math.log(1 + CONCEPT["pool"] / (1 + CONCEPT["common"] * CONCEPT["pool"]))
    definitions = chunks.where(F.coalesce("is_definition", F.lit(False))).withColumn("_w", _words(_short(F.col("fqn"))))
    holds = {t: X.concept_match(F.col("_w"), t) for t in terms}
    seen = definitions.agg(*[F.bool_or(h).alias(f"h{k}") for k, h in enumerate(holds.values())]).first() if terms else None
    kept = [t for k, t in enumerate(terms) if seen and seen[f"h{k}"] and weights[t] >= floor]
    if not kept:
        return scored.select("id", "score")
    best = scored.orderBy(F.round("score", 9).desc(), "id").limit(1).select("id")
    leader = definitions.join(F.broadcast(best), "id", "left_semi").select(*[holds[t].alias(f"k{k}") for k, t in enumerate(kept)]).first()
    if leader and all(leader):
        return scored.select("id", "score")
    total, top = sum(weights[t] for t in kept), pool_max(scored)
    ratio = sum((F.when(holds[t], weights[t]).otherwise(0.0) for t in kept), F.lit(0.0)) / total
    anchored = F.lit(False)
    for t in kept:
        anchored = anchored | (holds[t] & X.concept_match(_member(F.col("fqn")), t))
    factor = F.when(F.coalesce("is_test", F.lit(False)), FACTORS["test"]).otherwise(1.0)
    plain = F.least(top * CONCEPT["boost"] * F.col("ratio") * factor, F.lit(CONCEPT["cap"] * top))
    anchor = F.least(top * CONCEPT["anchor"] * F.col("ratio") * factor * factor, F.lit(CONCEPT["anchor_cap"] * top))
    rated = definitions.withColumn("ratio", ratio).withColumn("anchored", anchored & F.col("chunk_node_type").isin(*CALLABLE)).where(F.col("ratio") >= CONCEPT["least_ratio"])
    inside = scored.where("score > 0").select(F.col("id").alias("pid"))
    near = rated.join(inside, F.col("id") == F.col("pid"), "left").where(F.col("pid").isNotNull() | (F.col("ratio") >= CONCEPT["new_ratio"]))
    return inject(scored, near.select("id", F.when(F.col("anchored"), F.greatest(plain, anchor)).otherwise(plain).alias("add")))


def _carried(terms: Sequence[str]) -> Column:
    """The share of terms that a definition's name or path carries."""
    words = F.array_union(_words(_short(F.col("fqn"))), _words(F.col("file_path")))
    return sum((F.when(X.concept_match(words, t), 1).otherwise(0) for t in terms), F.lit(0)) / len(terms)


def endpoint_pass(scored: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """Callables annotated for the verb that a question about endpoints names."""
    words = set(X.query_tokens(query))
    verb = next((v for v in VERBS if v in words), None)
    terms = [t for t in X.collapse(X.decompose(query)) if len(t) >= 3 and t not in X.STOP_WORDS]
    if verb is None or not words & ENDPOINT_WORDS or not terms:
        return scored.select("id", "score")
    top, mark = pool_max(scored), VERBS[verb]
    marked = F.coalesce(F.col("content").contains(mark), F.lit(False)) | F.coalesce(F.col("declared_rules").contains(mark), F.lit(False))
    rows = chunks.where(F.coalesce("is_definition", F.lit(False)) & marked & F.col("chunk_node_type").isin(*CALLABLE)).withColumn("ratio", _carried(terms)).where("ratio > 0")
    factor = F.when(F.coalesce("is_test", F.lit(False)), FACTORS["test"]).otherwise(1.0)
    return inject(scored, rows.select("id", F.least(top * ENDPOINT["boost"] * (0.5 + 0.5 * F.col("ratio")) * factor, F.lit(ENDPOINT["cap"] * top)).alias("add")))


def constant_pass(scored: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """Definitions that declare a constant and have a word that asks for one and every other concept."""
    asked = set(X.query_tokens(query)) & CONSTANT_WORDS
    terms = [t for t in X.collapse(X.decompose(query)) if len(t) >= 3 and t not in X.STOP_WORDS and t not in CONSTANT_WORDS]
    if not asked or not terms:
        return scored.select("id", "score")
    words = F.coalesce("subwords", F.array().cast("array<string>"))
    told = F.lit(False)
    for w in sorted(asked):
        told = told | X.concept_match(words, w)
    for t in terms:
        told = told & X.concept_match(words, t)
    declares = F.coalesce("is_definition", F.lit(False)) & (F.col("content").contains("static final") | F.col("content").contains("const "))
    factor = F.when(F.coalesce("is_test", F.lit(False)), FACTORS["test"]).otherwise(1.0)
    top = pool_max(scored)
    return inject(scored, chunks.where(declares & told).select("id", F.least(top * CONSTANT["boost"] * factor, F.lit(CONSTANT["cap"] * top)).alias("add")))


def path_boost(pool: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Adds the share of keywords of which one begins a word of the file's stem or folder, or the other way."""
    keywords = [t for t in terms if len(t) >= PATH_PREFIX]
    if len(keywords) < PATH_KEYWORDS:
        return pool
    folder = F.regexp_extract("file_path", r"([^/]*)/[^/]*$", 1)
    words = F.filter(F.concat(X.subwords(P.stem(F.col("file_path"))), X.subwords(folder)), lambda w: F.char_length(w) >= PATH_PREFIX)
    hits = sum((F.when(F.exists(words, _related(k)), 1).otherwise(0) for k in keywords), F.lit(0))
    return pool.withColumn("score", F.col("score") + F.least(PATH_BOOST * hits / len(keywords), F.lit(pool_max(pool))))


def _related(keyword: str):
    return lambda w: F.startswith(F.lit(keyword), w) | F.startswith(w, F.lit(keyword))


def rank_class(path: Column, chunk_type: Column) -> Column:
    return F.when(chunk_type == "resource", "resource").when(P.file_role(path).isin(*BOILERPLATE_ROLES), "boilerplate").otherwise("code")


def weighting(pool: DataFrame, resource_intent: bool = False, config_scent: str = "neutral", code_context: bool = False, exact: Column | None = None, infra_intent: bool = False) -> DataFrame:
    """score times the weights of a chunk's class, content and scent; what is weighed down stays apart
    from code by MIN_LIFT. Tests count half; an exact answer gains EXACT_BOOST."""
    apart = lambda w: w if w == 1.0 else min(w, 1.0 - MIN_LIFT)
    kind = rank_class(F.col("file_path"), F.col("chunk_type"))
    by_class = F.when(kind == "resource", 1.0 if resource_intent else apart(RANK_CLASS["resource"])).when(kind == "boilerplate", apart(RANK_CLASS["boilerplate"])).otherwise(1.0)
    config = (CONFIG_CONTENT if config_scent != "neutral" else 1.0) * (NON_CODE if code_context else 1.0)
    by_content = F.when(F.col("content_type") == "config", config).when(F.col("content_type") == "docs", NON_CODE if code_context else 1.0).otherwise(1.0)
    out = F.col("score") * by_class * by_content * scent(F.col("file_path"), config_scent)
    out = out * F.when(F.coalesce("is_test", F.lit(False)), FACTORS["test"]).otherwise(1.0)
    out = out * F.when(P.file_role(F.col("file_path")) == "infra", 0.5 if infra_intent else FACTORS["infra"]).otherwise(1.0)
    return pool.withColumn("score", out + F.when(exact, EXACT_BOOST).otherwise(0.0) if exact is not None else out)


def scent(path: Column, kind: str) -> Column:
    """How a question about configuration or table definitions weighs a file."""
    if kind not in ("config", "ddl"):
        return F.lit(1.0)
    name = F.lower(P.basename(path))
    low = ("package-lock.json", "pom.xml", "maven-wrapper.properties") if kind == "config" else ("package-lock.json", "pom.xml")
    high = name.endswith(".sql") | (name == "docker-compose.yml")
    if kind == "config":
        high = high | name.endswith(".properties")
    return F.when(name.isin(*low), 0.5).when(high, 1.5 if kind == "config" else 1.8).otherwise(1.0)


def quality_gate(informative: int, concepts: int, coverage: float, lexical_hits: int, best_cosine: float, exempt: bool = False) -> tuple[bool, float]:
    """(accepted, least cosine): whether a question has enough that tells, is supported, and hits."""
    if informative < GATE["informative"]:
        return False, 0.0
    if concepts >= GATE["concepts"] and not exempt:
        if informative < GATE["concepts"] or (coverage < GATE["coverage"] and best_cosine < GATE["cosine"]):
            return False, 0.0
    if not lexical_hits and not exempt:
        return best_cosine >= GATE["cosine"], GATE["cosine"]
    return True, 0.0


def below_floor(scored: DataFrame) -> bool:
    """Whether the whole pool is too weak to be shown."""
    top = scored.agg(F.max("score")).first()[0]
    return top is None or top < RANKED_FLOOR


def saturated(pool: DataFrame, informative: Sequence[str]) -> bool:
    """Whether any candidate carries a telling word, or a sub-word that begins like one."""
    words, text = F.coalesce("subwords", F.array().cast("array<string>")), F.lower(F.coalesce("content", F.lit("")))
    test = F.lit(False)
    for w in informative:
        test = test | F.array_contains(words, w) | text.contains(w)
        if len(w) >= 3:
            test = test | F.exists(words, _begins(w[:3]))
    return bool(pool.where(test).limit(1).count())


def _begins(prefix: str):
    return lambda w: F.startswith(w, F.lit(prefix))


def rescue_allowed(known: int, score: float) -> bool:
    """Whether a rescued answer may be shown: a word of the question is known and something scored."""
    return known > 0 and score > 0.0


def suppressed(related: DataFrame, anchor_role: str, drop: bool = False) -> DataFrame:
    """Related rows (file_path, score) without boilerplate, or with half its score, unless what they
    are related to is boilerplate itself."""
    role = P.file_role(F.col("file_path")).isin(*BOILERPLATE_ROLES)
    if anchor_role in BOILERPLATE_ROLES:
        return related
    return related.where(~role) if drop else related.withColumn("score", F.when(role, F.col("score") * 0.5).otherwise(F.col("score")))


def type_sharing(a: Column, b: Column, same_return: Column | None = None) -> Column:
    """Shared types of two lists over the larger list, more for the same result, at most 1."""
    most = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    shared = F.when(most == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / most)
    return F.least(F.lit(1.0), shared + (F.when(same_return, 0.2).otherwise(0.0) if same_return is not None else F.lit(0.0)))


def parameter_types(fqn: Column) -> Column:
    """Types in the list that ends a name, without generics; none where there is no list."""
    inner = F.regexp_extract(F.coalesce(fqn, F.lit("")), r"\(([^()]*)\)$", 1)
    for _ in range(3):
        inner = F.regexp_replace(inner, r"[<\[][^<>\[\]]*[>\]]", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
