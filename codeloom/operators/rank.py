"""Fusion and re-scoring of ranked candidates, as chains of Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import text as X

#: Weights and floors of the ranking stages.
RRF_K = 60
ALPHA_TEXT, ALPHA_SYMBOL = 0.5, 0.3
VECTOR_ONLY_FLOOR = 0.5
COHERENCE = 0.05
MIN_LIFT = 0.05
RANK_CLASS = {"code": 1.0, "boilerplate": 0.65, "resource": 0.35}
FACTORS = {
    "definition": 1.2, "owner": 1.5, "identifier": 1.5, "usage": 0.85, "config_key": 1.35, "docs": 1.2, "docs_project": 1.35, "docs_third_party": 0.35, "docs_generated": 0.6,
    "config_primary": 1.35, "config_other": 0.7, "cohesion": 1.15, "test": 0.5, "non_canonical": 0.25, "model": 0.6, "infra": 0.35, "minified": 0.2, "vendor": 0.5, "dts": 0.7, "barrel": 0.5,
}
MATCH_BOOST = {"exact_fqn": 2.0, "symbol": 1.5, "filename": 1.5, "generic": 0.5, "cap": 2.0}
CONFIDENCE = {
    "definition": 0.1, "endpoint": 0.05, "fqn": 0.9, "fqn_definition": 0.95, "symbol": 0.75, "symbol_definition": 0.85, "ambiguous": 0.69,
    "semantic_min": 0.6, "semantic_floor": 0.4, "concept_ratio": 0.75, "concept_floor": 0.7, "config_floor": 0.7,
}
HIGH_BAND, MEDIUM_BAND = 0.70, 0.40


def normalise_scores(scored: DataFrame) -> DataFrame:
    """score as its distance from the mean in deviations, clipped to three and mapped to [0, 1].

    One candidate, or equal ones, get 1. The three numbers come from one aggregation."""
    facts = scored.agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if not facts["n"]:
        return scored
    if facts["n"] == 1 or facts["hi"] - facts["lo"] < 1e-12:
        return scored.withColumn("score", F.lit(1.0))
    if facts["sd"] < 1e-12:
        return scored.withColumn("score", (F.col("score") - facts["lo"]) / (facts["hi"] - facts["lo"]))
    z = (F.col("score") - F.lit(facts["mean"])) / F.lit(facts["sd"])
    return scored.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (z + 3) / 6)))


def ranked(scored: DataFrame) -> DataFrame:
    """rank from 0 by score, ties by id. A pool of candidates is bounded by its top-k, so one task
    ranks it; never use it on a whole table."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "id")) - 1)


def fuse(lexical: DataFrame, dense: DataFrame, alpha: float = ALPHA_TEXT, k: int = RRF_K) -> DataFrame:
    """id, score of two pools of candidates (id, score) by reciprocal ranks.

    With one empty arm the other's scores are normalised instead; the dense arm alone needs a
    score of VECTOR_ONLY_FLOOR."""
    has = lambda df: bool(df.limit(1).count())
    if not has(lexical):
        best = dense.agg(F.max("score")).first()[0]
        return normalise_scores(dense.select("id", "score")) if best is not None and best >= VECTOR_ONLY_FLOOR else dense.select("id", "score").where("false")
    if not has(dense):
        return normalise_scores(lexical.select("id", "score"))
    a = ranked(lexical).select(F.col("id").alias("lid"), (1.0 / (k + F.col("rank") + 1)).alias("l"))
    b = ranked(dense).select(F.col("id").alias("did"), (1.0 / (k + F.col("rank") + 1)).alias("d"))
    both = a.join(b, F.col("lid") == F.col("did"), "full")
    blended = both.select(F.coalesce("lid", "did").alias("id"), (alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("l", F.lit(0.0))).alias("score"))
    return normalise_scores(blended)


def demote_tests(scored: DataFrame) -> DataFrame:
    """Scores of tests halved before fusion (needs is_test)."""
    return scored.withColumn("score", F.when(F.col("is_test"), F.col("score") * FACTORS["test"]).otherwise(F.col("score")))


def pool_max(scored: DataFrame) -> float:
    """The greatest score now, which every additive pass reads; 1 for an empty pool."""
    top = scored.agg(F.max("score")).first()[0]
    return 1.0 if top is None else float(top)


def add_pass(scored: DataFrame, condition: Column, factor: float) -> DataFrame:
    """Adds ``factor`` times the pool's maximum where the condition holds."""
    return scored.withColumn("score", F.when(F.coalesce(condition, F.lit(False)), F.col("score") + factor * pool_max(scored)).otherwise(F.col("score")))


def lift_pass(scored: DataFrame, condition: Column, factor: float) -> DataFrame:
    """Raises to ``factor`` times the pool's maximum where the condition holds; never adds."""
    return scored.withColumn("score", F.when(F.coalesce(condition, F.lit(False)), F.greatest("score", F.lit(factor * pool_max(scored)))).otherwise(F.col("score")))


def match_boost(scored: DataFrame, name: str, fqn: str | None = None) -> DataFrame:
    """Adds the strongest of the exact name, symbol and file name matches, at most twice the maximum."""
    top = pool_max(scored)
    stem = F.lower(P.stem(F.col("file_path")))
    weight = (
        F.when(F.lit(fqn is not None) & (F.col("fqn") == F.lit(fqn or "")), MATCH_BOOST["exact_fqn"])
        .when(F.lower(X.leaf(F.col("fqn"))) == name.lower(), MATCH_BOOST["symbol"]).when(stem == name.lower(), MATCH_BOOST["filename"]).otherwise(0.0)
    )
    return scored.withColumn("score", F.col("score") + F.least(F.lit(MATCH_BOOST["cap"] * top), weight * top))


def overlap(terms: Sequence[str], words: Column) -> Column:
    """Share of the query's concepts that stand among the words."""
    unique = X.collapse(dict.fromkeys(terms))
    if not unique:
        return F.lit(0.0)
    return sum((F.coalesce(X.concept_match(words, t), F.lit(False)).cast("int") for t in unique), F.lit(0)) / len(unique)


def confidence(terms: Sequence[str], words: Column, vector: Column, is_definition: Column, exact_symbol: Column, ambiguous: bool = False) -> Column:
    """Calibrated confidence in [0, 1] of a candidate."""
    lexical, dense = overlap(terms, words), F.least(F.lit(1.0), F.greatest(F.lit(0.0), vector))
    score = 0.5 * lexical + 0.5 * dense + F.when(is_definition, CONFIDENCE["definition"]).otherwise(0.0)
    score = F.when(exact_symbol, F.greatest(score, F.when(is_definition, CONFIDENCE["symbol_definition"]).otherwise(CONFIDENCE["symbol"]))).otherwise(score)
    if ambiguous:
        score = F.least(score, F.lit(CONFIDENCE["ambiguous"]))
    score = F.when((lexical == 0) & (dense >= CONFIDENCE["semantic_min"]), F.greatest(score, F.lit(CONFIDENCE["semantic_floor"]))).otherwise(score)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def band(score: Column) -> Column:
    return F.when(score >= HIGH_BAND, "high").when(score >= MEDIUM_BAND, "medium").otherwise("low")


def envelope_band(scored: DataFrame) -> DataFrame:
    """The strongest band present; none for no candidates."""
    return scored.agg(F.when(F.count("*") == 0, "none").otherwise(F.max_by("band", F.when(F.col("band") == "high", 2).when(F.col("band") == "medium", 1).otherwise(0))).alias("band"))


def rerank(
    scored: DataFrame, terms: Sequence[str], identifier: str | None = None, docs_intent: bool = False, config_intent: bool = False, behaviour_intent: bool = False,
    weights: DataFrame | None = None, owner: str | None = None,
) -> DataFrame:
    """score times the factors that each candidate's kind, place and text earn; never negative.

    owner: the type in a qualified name that is asked for; its members gain. Uses are only weighed
    down for questions of three concepts or fewer. scored: id, score, fqn, file_path, content, content_type, is_definition, is_test. weights:
    file_path, weight of the session, joined where given. Factors are strictly positive, so nothing
    is dropped."""
    path, content = F.col("file_path"), F.lower(F.coalesce("content", F.lit("")))
    is_def = F.coalesce("is_definition", F.lit(False))
    leaf = F.lower(X.leaf(F.coalesce("fqn", F.lit(""))))
    named = [t.lower() for t in terms]
    names_leaf = leaf.isin(*named) if named else F.lit(False)
    matches = F.lit(not named)
    for t in named:
        matches = matches | F.lower(F.coalesce("fqn", F.lit(""))).contains(t)
    low = F.concat(F.lit("/"), F.lower(path))
    f = F.when(is_def & names_leaf, FACTORS["identifier"]).when(is_def & matches, FACTORS["definition"]).otherwise(1.0)
    if owner:
        own = F.regexp_extract(F.regexp_replace(F.regexp_replace(F.coalesce("fqn", F.lit("")), r"^.*::", ""), r"\(.*$", ""), r"([^.]+)\.[^.]+$", 1)
        f = f * F.when(is_def & (F.lower(own) == owner.lower()), FACTORS["owner"]).otherwise(1.0)
    present = [r["leaf"] for r in scored.where(is_def & names_leaf).select(leaf.alias("leaf")).distinct().collect()] if 0 < len(named) <= 3 else []  # at most the query's terms
    uses = F.lit(False)
    for n in present:
        uses = uses | content.contains(n)
    f = f * F.when(~is_def & uses, FACTORS["usage"]).otherwise(1.0)
    if identifier:
        f = f * F.when((F.col("content_type") == "config") & content.contains(identifier.lower()), FACTORS["config_key"]).otherwise(1.0)
    if docs_intent:
        tier = P.doc_tier(path)
        f = f * F.when(F.col("content_type") == "docs", FACTORS["docs"] * F.when(tier == "project", FACTORS["docs_project"]).when(tier == "third_party", FACTORS["docs_third_party"]).when(tier == "generated", FACTORS["docs_generated"]).otherwise(1.0)).otherwise(1.0)
    if config_intent:
        tier = P.config_tier(path)
        f = f * F.when(F.col("content_type") == "config", F.when(tier == "primary", FACTORS["config_primary"]).when(tier.isin("test", "sample", "generated"), FACTORS["config_other"]).otherwise(1.0)).otherwise(1.0)
    long_terms = [t for t in named if len(t) >= 3]
    if long_terms:
        f = f * F.when(F.arrays_overlap(F.transform(P.parts(path), F.lower), F.array(*[F.lit(t) for t in long_terms])), FACTORS["cohesion"]).otherwise(1.0)
    f = f * F.when(F.coalesce("is_test", F.lit(False)), FACTORS["test"]).otherwise(1.0) * F.when(P.is_non_canonical(path), FACTORS["non_canonical"]).otherwise(1.0)
    role = P.file_role(path)
    f = f * F.when(role.isin("model", "dto", "assembler", "exception") & (F.lit(behaviour_intent) | ~is_def), FACTORS["model"]).otherwise(1.0)
    f = f * F.when(role == "infra", FACTORS["infra"]).otherwise(1.0)
    f = f * F.when(low.rlike(r"\.min\.(?:js|css)$") | low.contains("/dist/"), FACTORS["minified"]).otherwise(1.0)
    f = f * F.when(low.rlike("/(?:node_modules|vendor|bower_components)/"), FACTORS["vendor"]).otherwise(1.0)
    f = f * F.when(low.endswith(".d.ts"), FACTORS["dts"]).otherwise(1.0)
    out = scored.withColumn("score", F.greatest(F.lit(0.0), F.col("score") * f))
    if weights is not None:
        w = weights.select(F.col("file_path").alias("wp"), "weight")
        out = out.join(w, F.col("file_path") == F.col("wp"), "left").withColumn("score", F.col("score") * F.coalesce("weight", F.lit(1.0))).drop("wp", "weight")
    return out


def cohere(scored: DataFrame) -> DataFrame:
    """One candidate per file: the best, with the file's maximum plus a bonus for more of them."""
    by = scored.groupBy("file_path").agg(
        F.max("score").alias("top"), F.count("*").alias("file_matches"), F.max_by("id", F.struct("score", -F.coalesce("line_start", F.lit(0)), -F.col("id"))).alias("id")
    )
    return by.select("id", "file_path", (F.col("top") + COHERENCE * F.log2(1 + F.col("file_matches"))).alias("score"), "file_matches")


def insufficient(scored: DataFrame, concepts: int, coverage: float) -> bool:
    """Whether to abstain: three concepts or more, half of them covered at most, and a top that hardly
    stands out of the first five."""
    five = [r["score"] for r in scored.orderBy(F.desc("score"), "id").limit(5).collect()]
    if concepts < 3 or coverage > 0.5 or not five:
        return False
    middle = sorted(five)[len(five) // 2]
    return middle > 0 and max(five) / middle <= 1.05


def budget_trim(rows: DataFrame, size: Column, order: Sequence[Column], budget: int) -> DataFrame:
    """The first rows whose sizes add up to at most the budget (a page of results)."""
    running = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_sum", running).where(F.col("_sum") <= budget).drop("_sum")


def token_savings(results: DataFrame, files: DataFrame) -> DataFrame:
    """returned, full, saved: tokens of the returned contents against those of their whole files."""
    got = results.agg(F.sum(X.estimated_tokens(F.col("content"))).alias("returned"))
    full = files.join(results.select("file_path").distinct(), "file_path", "left_semi").agg(F.sum(F.floor(F.col("size") / 4)).alias("full"))
    return got.crossJoin(full).select("returned", "full", (F.col("full") - F.col("returned")).alias("saved"))  # one row each


def related_score(package: Column, sharing: Column, proximity: Column, cosine: Column) -> Column:
    """Relatedness of two pieces of code from shared packages and types, nearness in calls, and vectors.

    Vectors that agree where nothing in the structure does are halved."""
    semantic = 0.2 * package + 0.2 * sharing + 0.6 * proximity
    structure = 0.3 * package + 0.3 * sharing + 0.4 * proximity
    final = 0.8 * semantic + 0.2 * cosine
    return F.when((structure < 0.15) & (cosine > 0.7), final * 0.5).otherwise(final)


def scope(query: str) -> str:
    """docs, code or code_focused: where a question is to be looked for."""
    words = set(X.query_tokens(query))
    if words & {"readme", "documentation", "docs", "guide", "tutorial", "changelog", "install", "installation"}:
        return "all"
    if words & {"class", "function", "method", "implementation", "implemented", "defined", "definition", "code"}:
        return "code"
    return "code_focused"
