"""Names to symbols: staged lookups, honest ambiguity, cross-file resolution of raw targets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.graph import arity
from codeloom.operators.passes import parameter_types


def candidates(symbols: DataFrame, target: str, edit_distance: int = 2) -> DataFrame:
    """id, stage of the first stage that finds any: exact or leaf, suffix, substring, sub-word, edits.

    Each stage is one filter; a stage is only run if those before it found nothing."""
    low = target.lower()
    leaf = F.lower(X.leaf(F.col("fqn")))
    stages = (
        ("exact", (F.col("fqn") == target) | (F.col("name") == target) | (leaf == low)),
        ("suffix", F.lower("fqn").endswith(low)),
        ("substring", F.lower("fqn").contains(low)),
        ("subword", F.arrays_overlap(X.subwords(F.col("name")), F.array(*[F.lit(w) for w in X.split_identifier(target)] or [F.lit("")]))),
        ("edits", F.levenshtein(F.lower("name"), F.lit(low)) <= edit_distance),
    )
    for stage, condition in stages:
        found = symbols.where(condition)
        if found.limit(1).count():
            return found.select("id", F.lit(stage).alias("stage"))
    return symbols.where("false").select("id", F.lit("none").alias("stage"))


def resolve(symbols: DataFrame, target: str) -> tuple[str, DataFrame]:
    """(outcome, candidates): resolved if one exact name, conventional name, leaf, or member of the type
    that the target names fits alone, or alone has its parameter types; else ambiguous with ranked
    candidates, or not_found. Ambiguity is never decided by rank.

    symbols: id, fqn, name, conventional_fqn, is_test, declared_rules, parent_symbol_id."""
    bare = re.sub(r"\(.*$", "", target)
    owner, _, leaf = re.sub(r"^.*::", "", bare).rpartition(".")
    ways = [F.col("fqn") == target, F.col("conventional_fqn") == target, F.col("name") == bare]
    parents = symbols.where(F.col("name") == owner.rpartition(".")[2]).select(F.col("id").alias("_p")) if owner else None
    pools = [symbols.where(w) for w in ways]
    if parents is not None:
        pools.append(symbols.where(F.col("name") == leaf).join(parents, F.col("parent_symbol_id") == F.col("_p"), "left_semi"))
    for pool in pools:
        found = pool.limit(2).collect()
        if len(found) == 1:
            return "resolved", ranked_candidates(pool, target, symbols)
        if len(found) == 2:
            wanted = X.signature(target)
            if wanted is not None:
                same = pool.where(F.array_join(parameter_types(F.col("fqn")), ",") == ",".join(wanted[1]))
                if len(same.limit(2).collect()) == 1:
                    return "resolved", ranked_candidates(same, target, symbols)
            return "ambiguous", ranked_candidates(pool, target, symbols)
    near = candidates(symbols, target)
    rows = symbols.join(near.select("id"), "id", "left_semi")
    return ("ambiguous" if near.limit(1).count() else "not_found"), ranked_candidates(rows, target, symbols)


def ranked_candidates(rows: DataFrame, target: str, symbols: DataFrame | None = None) -> DataFrame:
    """id, fqn, evidence: members of the type that the target names first, then kept before deprecated,
    the same parameter types, the same arity, most parameters, production before tests."""
    wanted = X.signature(target)
    owner = re.sub(r"^.*::", "", re.sub(r"\(.*$", "", target)).rpartition(".")[0].rpartition(".")[2]
    fits = arity(F.col("fqn")) == (wanted[0] if wanted else -1)
    typed = (F.array_join(parameter_types(F.col("fqn")), ",") == ",".join(wanted[1])) if wanted else F.lit(False)
    deprecated = F.coalesce(F.col("declared_rules").rlike("(?i)deprecated"), F.lit(False))
    out = rows
    inside = F.lit(False)
    if symbols is not None and owner and "parent_symbol_id" in rows.columns:
        named = symbols.where(F.col("name") == owner).select(F.col("id").alias("_o"))
        out, inside = rows.join(named, F.col("parent_symbol_id") == F.col("_o"), "left"), F.col("_o").isNotNull()
    evidence = F.array_compact(
        F.array(F.when(inside, "parent"), F.when(typed, "types"), F.when(fits, "signature"), F.when(~deprecated, "current"), F.when(~F.col("is_test"), "production"))
    )
    order = [inside.alias("_i"), deprecated.alias("_d"), F.coalesce(typed, F.lit(False)).alias("_t"), F.coalesce(fits, F.lit(False)).alias("_f"), F.coalesce(arity(F.col("fqn")), F.lit(0)).alias("_n")]
    shown = out.select("id", "fqn", F.array_join(evidence, ",").alias("evidence"), "is_test", *order)
    return shown.orderBy(F.desc("_i"), F.asc("_d"), F.desc("_t"), F.desc("_f"), F.desc("_n"), F.asc("is_test"), "fqn", "id").select("id", "fqn", "evidence")


def resolve_references(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """id, tier, target, n of raw references: the first tier with any candidate decides.

    references: id, raw, file_path. Tiers: exact name, conventional name, same file, unique in the
    corpus (fallback). A tier with one candidate resolves; one with more makes the reference
    ambiguous and ends the search. Each tier is one equi-join; none compares all pairs. A name that
    a third of the references share is joined to counts, one row per name, not to its symbols."""
    leaf = X.leaf(F.col("raw"))
    refs = references.select("id", "raw", "file_path", leaf.alias("leaf"))
    count = lambda key, *more: symbols.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k"), *more).agg(F.count("*").alias("n"), F.min("id").alias("target"))
    exact, conventional, anywhere = count("fqn"), count("conventional_fqn"), count("name")
    local = symbols.groupBy(F.col("name").alias("k"), F.col("file_path").alias("f")).agg(F.count("*").alias("n"), F.min("id").alias("target"))
    out = (
        refs.join(exact.select(F.col("k").alias("k1"), F.struct("n", "target").alias("t1")), F.col("raw") == F.col("k1"), "left")
        .join(conventional.select(F.col("k").alias("k2"), F.struct("n", "target").alias("t2")), F.col("raw") == F.col("k2"), "left")
        .join(local.select(F.col("k").alias("k3"), "f", F.struct("n", "target").alias("t3")), (F.col("leaf") == F.col("k3")) & (F.col("file_path") == F.col("f")), "left")
        .join(anywhere.select(F.col("k").alias("k4"), F.struct("n", "target").alias("t4")), F.col("leaf") == F.col("k4"), "left")
    )
    tier = F.when(F.col("t1").isNotNull(), "exact").when(F.col("t2").isNotNull(), "conventional").when(F.col("t3").isNotNull(), "same_file").when(F.col("t4").isNotNull(), "fallback")
    hit = F.coalesce("t1", "t2", "t3", "t4")
    return out.select(
        "id", F.when(hit.isNull(), "no_match").when(hit["n"] > 1, "ambiguous").otherwise(tier).alias("tier"), F.when(hit["n"] == 1, hit["target"]).alias("target"), F.coalesce(hit["n"], F.lit(0)).alias("n")
    )


#: Names in prose: in backticks, or with capitals inside.
_QUOTED_NAME = r"`([A-Za-z_][A-Za-z0-9_.]*)(\(\))?`"
_CAMEL_NAME = r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b|\b[a-z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b"


def mentions(documents: DataFrame, symbols: DataFrame) -> DataFrame:
    """document, symbol_id of documents (document, text) that name a symbol whose name is its own.

    Names are taken out where the texts lie; a name that many symbols have names none of them, so
    the join is to one row per name. Null texts name nothing."""
    quoted = F.transform(F.regexp_extract_all("text", F.lit(_QUOTED_NAME), F.lit(1)), lambda x: F.regexp_extract(x, r"([^.]*)$", 1))
    names = F.array_distinct(F.concat(quoted, F.regexp_extract_all("text", F.lit(_CAMEL_NAME), F.lit(0))))
    said = documents.where("text is not null").select("document", F.explode(names).alias("said"))
    own = symbols.where("name is not null").groupBy("name").agg(F.min("id").alias("symbol_id"), F.count("*").alias("n")).where("n = 1")
    return said.join(own, F.col("said") == F.col("name")).select("document", "symbol_id").distinct()


def overloads(symbols: DataFrame) -> DataFrame:
    """parent, name, n, ids of names that a container declares more than once."""
    by = symbols.where("parent_symbol_id is not null and kind in ('function', 'method', 'constructor')").groupBy("parent_symbol_id", "name")
    return by.agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).where("n > 1")


def unique_leafs(symbols: DataFrame) -> DataFrame:
    """name, n, id where the name stands once."""
    return symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).select("name", "n", F.when(F.col("n") == 1, F.col("id")).alias("id"))

