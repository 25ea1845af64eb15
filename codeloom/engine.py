"""The engine's verbs over one corpus: each returns a payload with an outcome and DataFrames."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import redact as R
from codeloom.functions import text as X
from codeloom.operators import cascade as CS
from codeloom.operators import chunking as C
from codeloom.operators import graph as G
from codeloom.operators import lexical as L
from codeloom.operators import ops as O
from codeloom.operators import passes as PS
from codeloom.operators import rank as K
from codeloom.operators import resolve as S
from codeloom.operators import traverse as T
from codeloom.operators import vector as V
from codeloom.operators.common import cut, keep_latest, latest_rows, table_state
from codeloom.operators.postings import LexicalIndex
from codeloom.plans.pattern.execute import execute
from codeloom.pattern_queries import pattern_graph
from codeloom.sources import git as checkout
from codeloom.sources.sinks import append_audit
from codeloom.views import CHUNK_COLUMNS, Corpus

#: Words that tell what a question is about.
DOCS_WORDS = frozenset("readme documentation docs guide tutorial changelog install installation how-to".split())
CONFIG_WORDS = frozenset("config configuration property properties setting settings yaml environment variable".split())
AUTH_WORDS = frozenset("authorization authorize authenticate permission access role secured guard".split())
BEHAVIOUR_WORDS = frozenset("how why when does handle handles process processes flow happens".split())
KIND_WORDS = {"classes": ["class"], "functions": ["function", "arrow_function"], "methods": ["method"], "interfaces": ["interface"], "enums": ["enum"]}
RESOURCE_WORDS = {"migrations": "%.sql", "dockerfiles": "%dockerfile%", "properties files": "%.properties", "yaml files": "%.y%ml"}
POOL = 40
#: Questions by form, first match first: what is asked, and what it is about.
ROUTES = (
    ("literal", re.compile(r'^\s*"([^"]+)"\s*$')),
    ("callers", re.compile(r"(?i)\b(?:who|what)\s+(?:calls|invokes|uses)\s+([\w.:]+)|\b(?:callers|usages|uses) of\s+([\w.:]+)|\bwhere is\s+([\w.:]+)\s+(?:called|used|invoked)")),
    ("callees", re.compile(r"(?i)\bwhat does\s+([\w.:]+)\s+call|\bcallees of\s+([\w.:]+)")),
    ("implementations", re.compile(r"(?i)\b(?:implementations|implementers|subclasses) of\s+([\w.:]+)|\bwho implements\s+([\w.:]+)")),
    ("definition", re.compile(r"(?i)^\s*([A-Za-z_]\w*(?:(?:\.|::)\w+)+|[a-z]+(?:[A-Z]\w*)+|\w+_\w+)\s*$|\bwhere is\s+([\w.:]+)\s+(?:defined|declared)|\bdefinition of\s+([\w.:]+)|\bdefine\s+([\w.:]+)")),
)


def route(question: str) -> tuple[str, str]:
    """(verb, target) of a question; ranked search where no form fits."""
    for verb, form in ROUTES:
        m = form.search(question)
        if m:
            return verb, next(g for g in m.groups() if g)
    return "search", question


@dataclass
class Intents:
    docs: bool
    config: bool
    authorization: bool
    behaviour: bool
    identifier: str | None
    literal: bool

    @classmethod
    def of(cls, query: str) -> Intents:
        words = set(re.findall(r"[a-z-]+", query.lower()))
        name = query.strip()
        is_name = bool(re.fullmatch(r"[A-Za-z_][\w.:$#]*", name)) and bool(re.search(r"[_.:]|[a-z][A-Z]", name))
        literal = bool(re.search(r"^@\w|^\".*\"$|^[\w-]+:[\w-]+:[\d.]+$", name))
        return cls(bool(words & DOCS_WORDS), bool(words & CONFIG_WORDS), bool(words & AUTH_WORDS), bool(words & BEHAVIOUR_WORDS), name if is_name else None, literal)


@dataclass
class Engine:
    spark: SparkSession
    sf_dir: str
    audit_path: str | None = None
    generation: str = ""
    corpus: Corpus = field(init=False)

    def __post_init__(self) -> None:
        self.corpus = Corpus(self.spark, self.sf_dir)
        self.states: dict[str, str] = {}
        self.refresh()

    # search

    def search(
        self, query: str, limit: int = 10, mode: str = "ranked", matching: str = "literal", content: str | None = None, language: str | None = None, include_tests: bool = False,
        strict: bool = False, allow_weak: bool = False, query_vector: DataFrame | None = None, ignore_case: bool = False,
    ) -> dict[str, Any]:
        """Ranked, exhaustive or enumerating search.

        query_vector: one row (query_id, vector) where the caller has an embedding of the query; the
        dense arm is skipped without one."""
        begin = time.monotonic()
        if not query.strip():
            return {"outcome": "invalid_argument", "error": "empty query", "results": None, "total": 0}
        chunks = self.scoped(content or K.scope(query), language or (self.language(query) if mode == "ranked" else None), include_tests)
        if mode == "exhaustive":
            payload = self.exhaustive(chunks, query, matching, ignore_case)
        elif mode == "enumerate":
            payload = self.enumerate(chunks, query)
        else:
            payload = self.ranked(chunks, query, limit, strict, allow_weak, query_vector)
        self.audit("search", query, payload.get("total", 0), begin)
        return payload

    def scoped(self, scope: str, language: str | None, include_tests: bool) -> Column:
        """The condition on a chunk that a search's scope makes."""
        test = F.lit(True)
        if scope in ("code", "config", "docs"):
            test = F.col("content_type") == scope
        elif scope == "code_focused":
            test = F.col("content_type") != "docs"
        if language:
            test = test & (F.col("language") == language)
        return test if include_tests else test & ~F.coalesce("is_test", F.lit(False))

    def exhaustive(self, scope: Column, query: str, matching: str, ignore_case: bool) -> dict[str, Any]:
        """Every matching line; totals count occurrences for literals and lines otherwise."""
        rows, versions = self.corpus.rows.where(scope), self.corpus.versions
        if matching == "literal":
            rows = L.scan_literal(rows, query.strip().strip('"'), versions, ignore_case)
            total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        elif matching in ("all_tokens", "any_token"):
            needles = [a or b for a, b in re.findall(r'"([^"]+)"|(\S+)', query)]
            rows = L.scan_tokens(rows, needles, matching == "all_tokens", versions)
            total = rows.count()
        elif matching == "regex":
            try:
                re.compile(query)
            except re.error as x:
                return {"outcome": "invalid_regex", "error": str(x), "results": None, "total": 0}
            rows = L.scan_regex(rows, query, versions)
            total = rows.count()
        else:
            return {"outcome": "invalid_argument", "error": f"unknown matching {matching}", "results": None, "total": 0}
        return {"outcome": "resolved" if total else "no_match", "results": rows, "total": int(total)}

    def enumerate(self, scope: Column, query: str) -> dict[str, Any]:
        low, chunks, versions = query.lower(), self.corpus.rows.where(scope), self.corpus.versions
        kinds = next((v for k, v in KIND_WORDS.items() if k in low), None)
        glob = next((v for k, v in RESOURCE_WORDS.items() if k in low), None)
        if kinds:
            rows = L.enumerate_kinds(chunks, kinds, versions)
        elif glob:
            rows = keep_latest(chunks.where(F.lower("file_path").like(glob)).select("id", "updated_at", "fqn", "file_path", "line_start"), versions, "id")
        else:
            rows = L.enumerate_named(chunks, query.strip(), versions)
        unparsed = self.corpus.table("files").where("parse_failed").count()
        total = rows.count()
        return {"outcome": "resolved" if total else "no_match", "results": rows, "total": total, "excluded_files": unparsed}

    def ranked(self, scope: Column, query: str, limit: int, strict: bool, allow_weak: bool, query_vector: DataFrame | None) -> dict[str, Any]:
        index = self.corpus.lexical
        intents = Intents.of(query)
        pool_size = max(2 * limit, POOL)
        terms, phrases = X.decompose(query), index.phrases(query)
        lexical = L.top(index.bm25(phrases, scope), pool_size)
        dense = cut(self.dense(query_vector, pool_size)) if query_vector is not None and not intents.literal else lexical.select("id", "score").where("false")
        informative = L.informative_terms(index.stats, index.chunks, query)
        concepts = [w for w in terms if len(w) >= 3 and w not in X.STOP_WORDS]
        best_cosine = float(dense.agg(F.max("score")).first()[0] or 0.0) if query_vector is not None else 0.0
        known = len(index.known(concepts)) / max(1, len(concepts))
        counts = {r["is_test"]: r["n"] for r in index.match_counts(phrases, scope).collect()}
        total = sum(counts.values())
        plain = not (intents.literal or intents.identifier or allow_weak)
        accepted, floor = PS.quality_gate(len(informative), len(concepts), known, total, best_cosine, intents.authorization) if plain else (True, 0.0)
        if not accepted:
            return {**self.rescue(scope, query, limit, index), "reason": "quality_gate"}
        fused = cut(K.fuse(lexical, dense.where(F.col("score") >= floor), K.ALPHA_SYMBOL if intents.identifier else K.ALPHA_TEXT))
        definitions = self.corpus.definitions.where(scope)
        if intents.identifier:
            leaf = re.split(r"[.:#]+", intents.identifier)[-1]
            fused = PS.stem_rescue(fused, definitions, leaf)
            if definitions.where(X.leaf(F.col("fqn")) == leaf).limit(2).count() > 1:
                fused = PS.definition_pass(fused, definitions, [leaf])
        else:
            for name in PS.embedded_names(self.corpus.symbols, query):
                fused = PS.stem_rescue(PS.definition_pass(fused, definitions, [name]), definitions, name)
            fused = PS.concept_pass(fused, definitions, PS.concept_terms(index.stats, index.chunks, query))
            fused = PS.constant_pass(PS.endpoint_pass(fused, definitions, query), definitions, query)
        fused = cut(L.top(fused, 2 * pool_size))
        if not fused.limit(1).count():
            return self.rescue(scope, query, limit, index)
        if PS.below_floor(fused) and plain:
            return {**self.rescue(scope, query, limit, index), "reason": "ranked_floor"}
        chunks = cut(self.corpus.chunks_of(fused))  # of the pool only
        pool = fused.join(chunks, "id")
        if plain and informative and not PS.saturated(pool, informative):
            return {**self.rescue(scope, query, limit, index), "reason": "saturation"}
        if intents.identifier:
            pool = K.match_boost(pool, leaf, intents.identifier)
        else:
            pool = K.add_pass(pool, F.coalesce(F.lower("declared_rules"), F.lit("")).rlike("|".join(map(re.escape, terms)) or "$^"), 1.5)
            if intents.docs:
                pool = K.lift_pass(pool, F.col("content_type") == "docs", 0.3)
            if intents.config:
                primary = F.when(P.config_tier(F.col("file_path")) == "primary", 1.3).otherwise(1.0) * F.when(F.lower("file_path").contains("schema"), 1.3).otherwise(1.0)
                pool = pool.withColumn("score", F.when(F.col("content_type") == "config", F.col("score") + 0.75 * K.pool_max(pool) * primary).otherwise(F.col("score")))
            if intents.authorization:
                pool = K.add_pass(pool, F.col("is_definition") & F.lower(F.coalesce("content", F.lit(""))).rlike("secured|preauthorize|permission|validate"), 1.5)
            pool = PS.path_boost(pool, [w for w in concepts])
        exact = F.lower(X.leaf(F.coalesce("fqn", F.lit("")))) == query.strip().lower()
        pool = PS.weighting(pool, config_scent="config" if intents.config else "neutral", exact=exact)
        owner = re.split(r"[.:#]+", intents.identifier)[-2] if intents.identifier and len(re.split(r"[.:#]+", intents.identifier)) > 1 else None
        pool = K.rerank(pool, terms, intents.identifier, intents.docs, intents.config, intents.behaviour, self.session_weights(), owner)
        best = K.cohere(pool).join(chunks.drop("file_path"), "id")
        best = best.withColumn("confidence", K.confidence(terms, F.coalesce("subwords", F.array().cast("array<string>")), F.lit(0.0), F.coalesce("is_definition", F.lit(False)), F.lower(X.leaf(F.coalesce("fqn", F.lit("")))) == query.strip().lower()))
        best = best.withColumn("band", K.band(F.col("confidence")))
        if strict:  # weak answers that define nothing and cover less than half of the concepts are no answer
            covered = K.overlap(terms, F.coalesce("subwords", F.array().cast("array<string>")))
            sure = best.where((F.col("band") != "low") | F.col("is_definition") | (covered >= 0.5))
            if not sure.limit(1).count():
                few = best.orderBy(F.round("score", 9).desc(), "id").limit(3).select("id", "fqn", "file_path", "line_start", "score")
                return {"outcome": "no_match", "reason": "strict", "results": few.where("false"), "alternatives": few, "total": total}
            best = sure
        page = best.orderBy(F.round("score", 9).desc(), "id").limit(limit).withColumn("r", R.redact(F.col("content")))
        results = page.select("id", "fqn", "file_path", "line_start", "line_end", "score", "file_matches", "confidence", "band", F.col("r.redacted").alias("content"), F.col("r.count").alias("redacted"))
        coverage = best.agg(F.max(K.overlap(terms, F.coalesce("subwords", F.array().cast("array<string>"))))).first()[0] or 0.0
        if not allow_weak and not intents.literal and K.insufficient(fused, len(X.collapse(terms)), coverage):
            return {"outcome": "no_match", "reason": "insufficient_signal", "results": results.where("false"), "alternatives": results, "total": total}
        band = K.envelope_band(best).first()["band"]
        return {
            "outcome": "resolved", "results": results, "total": total, "total_tests": counts.get(True, 0), "total_production": counts.get(False, 0), "truncated": total > limit, "band": band,
            "arms": {"lexical": True, "dense": query_vector is not None},
        }

    def rescue(self, scope: Column, query: str, limit: int, index: LexicalIndex) -> dict[str, Any]:
        """Relaxed steps where the ranked search has no answer: any known word by the index, then the text
        itself in any case with scores that fall with the rank, then no match."""
        words = X.query_tokens(query)
        known = index.known([w for t in words for w in X.split_identifier(t)])
        scored = index.bm25([w for w in dict.fromkeys(X.full_text_words(query)) if w not in X.STOP_WORDS], scope)
        best = scored.agg(F.max("score"), F.count("*")).first()
        if PS.rescue_allowed(len(known), float(best[0] or 0.0)):
            pool = L.top(scored, limit)
            rows = pool.join(self.corpus.chunks_of(pool, "fqn", "file_path", "line_start"), "id")
            return {"outcome": "resolved", "rescued_by": "relaxed", "results": rows, "total": int(best[1]), "band": "low"}
        needle = query.strip().lower()
        rows = self.corpus.rows.where(scope)
        found = keep_latest(rows.where(F.lower("content").contains(needle)).select("id", "updated_at", "fqn", "file_path", "line_start"), self.corpus.versions, "id")
        total = found.count() if len(needle) > 2 else 0
        if not total:
            return {"outcome": "no_match", "results": rows.where("false").select("id", "fqn", "file_path", "line_start"), "total": 0}
        page = K.ranked(found.withColumn("score", F.lit(1.0)).orderBy("id").limit(limit))
        results = page.select("id", "fqn", "file_path", "line_start", (1.0 / (1 + F.col("rank"))).alias("score"))
        return {"outcome": "resolved", "rescued_by": "literal", "results": results, "total": total, "band": "low"}

    def dense(self, query_vector: DataFrame, k: int) -> DataFrame:
        rows = self.corpus.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("group"))
        return V.top_cosine(query_vector.withColumn("group", F.lit(None).cast("string")), rows, k, floor=0.25).select("id", "score")

    def session_weights(self) -> DataFrame:
        """Weights by stored path: session events name files as their tools saw them, by any suffix."""
        weights = O.session_weights(self.corpus.table("sessions"), F.current_timestamp())
        return O.suffix_weights(self.corpus.table("files").select("file_path").distinct(), weights)

    # names

    def resolve(self, symbol: str) -> tuple[str, DataFrame]:
        return S.resolve(self.corpus.symbols, symbol)

    def _one(self, symbol: str) -> tuple[dict[str, Any] | None, int | None]:
        """An error payload, or the id of the one symbol that the name means."""
        outcome, rows = self.resolve(symbol)
        if outcome != "resolved":
            return {"outcome": outcome, "candidates": rows.limit(10), "error": f"{symbol} is {outcome.replace('_', ' ')}"}, None
        return None, rows.first()["id"]

    def _seed(self, symbol_id: int) -> DataFrame:
        return self.spark.createDataFrame([(symbol_id,)], "node long")

    def definition(self, symbol: str) -> dict[str, Any]:
        error, sid = self._one(symbol)
        if error:
            return error
        return {"outcome": "resolved", "symbol": self.corpus.symbols.where(F.col("id") == sid), "chunk": latest_rows(self.corpus.rows.join(F.broadcast(self.corpus.symbols.where(F.col("id") == sid).select("fqn")), "fqn", "left_semi"), "id", CHUNK_COLUMNS)}

    def neighbors(self, symbol: str, direction: str = "both", max_depth: int = 1, transitive: bool = False, limit: int = 50, offset: int = 0) -> dict[str, Any]:
        error, sid = self._one(symbol)
        if error:
            return error
        depth = T.MAX_CALL_DEPTH if transitive else max_depth
        out: dict[str, Any] = {"outcome": "resolved"}
        if direction in ("both", "callers"):
            out["callers"], out["total_callers"] = G.page_with_total(T.callers(self.corpus.edges, self._seed(sid), depth), [F.col("depth"), F.col("node")], limit, offset)
        if direction in ("both", "callees"):
            out["callees"], out["total_callees"] = G.page_with_total(T.callees(self.corpus.edges, self._seed(sid), depth), [F.col("depth"), F.col("callee")], limit, offset)
        return out

    def implementations(self, symbol: str) -> dict[str, Any]:
        """Types below a type, or what stands for a member in the types below its own."""
        error, sid = self._one(symbol)
        if error:
            return error
        c = self.corpus
        row = c.symbols.where(F.col("id") == sid).first()
        hint = "no static implementation: look for framework wiring"
        if row["kind"] in ("method", "function", "constructor") and row["parent_symbol_id"] is not None:
            found = CS.member_implementations(c.symbols_with("fqn", "name", "kind", "parent_symbol_id"), c.resolved_edges, self.spark.createDataFrame([(sid,)], "id long"))
            real = found.where("implementation_id is not null")
            return {"outcome": "resolved" if real.limit(1).count() else "no_match", "implementations": found, "hint": hint}
        found = T.subtypes(c.symbols_with("fqn"), c.edges, self.spark.createDataFrame([(sid,)], "root long"))
        return {"outcome": "resolved" if found.limit(1).count() else "no_match", "implementations": found, "hint": hint}

    # graph

    def graph_schema(self, limit: int = 100) -> dict[str, Any]:
        c = self.corpus
        return {"outcome": "resolved", "sections": G.graph_schema(c.symbols_with("kind", "language"), c.edges), "unresolved": G.unresolved_targets(c.edges, limit)}

    def outline(self, path: str, kinds: Sequence[str] | None = None, limit: int = 200, offset: int = 0) -> dict[str, Any]:
        rows, total = G.page_with_total(G.outline(self.corpus.symbols, path, kinds), [F.col("line_start"), F.col("id")], limit, offset)
        return {"outcome": "resolved" if total else "not_found", "symbols": rows, "total": total}

    def coverage(self, paths: Sequence[str] = (), scopes: Sequence[str] = ()) -> dict[str, Any]:
        c = self.corpus
        rows = O.coverage(c.table("files"), c.chunks_with("file_path"), c.symbols_with("file_path"))
        if paths:
            rows = rows.where(F.col("file_path").isin(*paths))
        if scopes:
            test = F.lit(False)
            for s in scopes:
                test = test | F.col("file_path").startswith(s)
            rows = rows.where(test)
        return {"outcome": "resolved", "files": rows, "scopes": O.scope_coverage(rows)}

    def symbols(self, limit: int = 50, offset: int = 0, **conditions: Any) -> dict[str, Any]:
        rows, total = G.page_with_total(G.symbol_search(self.corpus.symbols, self.corpus.resolved_edges, **conditions), [F.desc("importance"), F.col("fqn")], limit, offset)
        return {"outcome": "resolved" if total else "no_match", "symbols": rows, "total": total}

    def dead_code(self, limit: int = 50, offset: int = 0, **options: Any) -> dict[str, Any]:
        order = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
        rows, total = G.page_with_total(G.dead_code(self.corpus.symbols, self.corpus.edges, **options), [order, F.col("is_test"), F.desc("importance"), F.col("fqn")], limit, offset)
        return {"outcome": "resolved", "candidates": rows, "total": total, "note": "no proven use in this index; that does not prove that there is none"}

    def architecture(self, aspects: Sequence[str] = ("overview",), top_n: int = 15, max_communities: int = 10) -> dict[str, Any]:
        c = self.corpus
        calls = c.resolved_edges.where(F.col("edge_type").isin("CALLS", "INHERITS")).select(F.col("source_symbol_id").alias("a"), F.col("target_symbol_id").alias("b"))
        build = {
            "overview": lambda: G.graph_schema(c.symbols_with("kind", "language"), c.edges),
            "structure": lambda: G.packages(c.symbols_with("file_path", "is_test")),
            "dependencies": lambda: G.edge_stats(c.edges),
            "hotspots": lambda: G.hotspots(c.symbols_with("fqn", "importance", "is_test"), c.resolved_edges, top_n),
            "entry_points": lambda: G.entry_points(c.symbols, c.resolved_edges).groupBy("reason").agg(F.count("*").alias("n")),
            "clusters": lambda: T.communities(calls).groupBy("community").agg(F.count("*").alias("size")).where("size > 1").orderBy(F.desc("size"), "community").limit(max_communities),
            "cycles": lambda: T.module_cycles(c.modules),
        }
        unknown = [a for a in aspects if a not in build]
        if unknown:
            return {"outcome": "invalid_argument", "error": f"unknown aspects: {', '.join(unknown)}"}
        return {"outcome": "resolved", **{a: build[a]() for a in aspects}}

    def suggested_questions(self) -> list[str]:
        spots = G.hotspots(self.corpus.symbols_with("fqn", "importance", "is_test"), self.corpus.resolved_edges, 5).collect()
        return [f"How does {r['fqn']} connect to its callers?" for r in spots]

    def neighbourhood(self, question: str, depth: int = 2, edge_types: Sequence[str] = ("CALLS", "INHERITS"), direction: str = "both") -> dict[str, Any]:
        """The graph around the three chunks that answer the question best."""
        c = self.corpus
        pool = L.top(c.lexical.bm25(c.lexical.phrases(question)), POOL)
        hits = L.top(pool.join(c.chunks_of(pool, "is_definition", "fqn"), "id").where("is_definition"), 3)
        seeds = hits.join(c.symbols_with("fqn").select(F.col("id").alias("node"), F.col("fqn").alias("f")), F.col("fqn") == F.col("f")).select("node")
        if not seeds.limit(1).count():
            return {"outcome": "no_seed"}
        return {"outcome": "resolved", "nodes": T.neighbourhood(c.symbols_with("kind"), c.edges, seeds, depth, edge_types, direction, fan_out=50, most=200)}

    def path(self, source: str, target: str, undirected: bool = False, max_hops: int = 6, edge_types: Sequence[str] = ("CALLS", "INHERITS")) -> dict[str, Any]:
        ends = []
        for name in (source, target):
            error, sid = self._one(name)
            if error:
                return error
            ends.append(sid)
        if ends[0] == ends[1]:
            return {"outcome": "trivial"}
        hops = T.shortest_path(self.corpus.symbols_with("parent_symbol_id"), self.corpus.resolved_edges, ends[0], ends[1], edge_types, undirected, max(1, min(max_hops, T.MAX_PATH_HOPS)))
        return {"outcome": "resolved" if hops.limit(1).count() else "no_path", "hops": hops.orderBy("hop")}

    def explain(self, symbol: str, relations: Sequence[str] = ("CALLS", "INHERITS"), depth: int = 1) -> dict[str, Any]:
        """What stands around a symbol to a depth of four at most, the notes in its lines and the documents
        that name it."""
        error, sid = self._one(symbol)
        if error:
            return error
        c = self.corpus
        row = c.symbols.where(F.col("id") == sid).first()
        rows = c.rows.where((F.col("file_path") == row["file_path"]) & (F.col("content_type") == "code"))  # one file's texts
        split = rows.select("id", "updated_at", "file_path", "line_start", F.posexplode(F.split("content", "\n")).alias("at", "line"))
        marked = split.where(F.col("line").rlike(C.RATIONALE)).select("id", "updated_at", "file_path", (F.coalesce("line_start", F.lit(1)) + F.col("at")).alias("line_no"), "line")
        notes = C.rationale(keep_latest(marked, c.versions, "id"), c.symbols.where(F.col("file_path") == row["file_path"])).where(F.col("symbol_id") == sid)
        documents = c.table("documents").select(F.col("doc_id").alias("document"), "text")
        named = S.mentions(documents, c.symbols_with("name")).where(F.col("symbol_id") == sid)
        return {"outcome": "resolved", "around": T.ego_graph(c.symbols_with("parent_symbol_id"), c.edges, sid, depth, relations), "rationale": notes, "documents": named}

    def impact(self, changed_paths: Sequence[str], depth: int = 3, direction: str = "inbound", fixpoint: bool = False, include_imports: bool = True, seed_filter: str = "all", edge_types: Sequence[str] = ("CALLS", "INHERITS")) -> dict[str, Any]:
        c = self.corpus
        changed = self.spark.createDataFrame([(p,) for p in changed_paths], "file_path string")
        reached = T.impact(c.symbols_with("file_path", "kind", "is_test"), c.resolved_edges, changed, depth, edge_types, direction, fixpoint, seed_filter)
        reached = cut(reached)
        parents = T.impact_parents(c.symbols, c.resolved_edges, reached, edge_types, direction)
        out: dict[str, Any] = {"outcome": "resolved" if reached.limit(1).count() else "not_indexed", "parents": parents, "impacted": reached, "risks": reached.groupBy("risk").agg(F.count("*").alias("n")), "tests": reached.where("is_test")}
        if include_imports:
            paths = changed.withColumnRenamed("file_path", "node")
            walk = T.importers if direction != "outbound" else T.imports
            out["files"] = walk(c.modules, paths, 1 if fixpoint else depth)
        return out

    def changes(self, changed_paths: Sequence[str] = (), scope: str = "impact", root: str | None = None, base: str | None = None, head: str | None = None, **options: Any) -> dict[str, Any]:
        """What a change touches: its files, what it reaches, or the tests to run. The change is a list of
        paths, or the difference of two revisions of a checkout at ``root``."""
        paths = list(changed_paths)
        if base is not None:
            try:
                paths += checkout.changed_paths(root or ".", base, head)
            except ValueError as x:
                return {"outcome": "invalid_argument", "error": str(x)}
        if not paths:
            return {"outcome": "no_changes"}
        payload = {**self.impact(paths, **options), "changed": paths}
        if scope == "files":
            return {k: payload[k] for k in ("outcome", "files", "changed") if k in payload}
        return {"outcome": payload["outcome"], "tests": payload["tests"]} if scope == "tests" else payload

    def refresh(self) -> list[str]:
        """The tables that have changed since they were last looked at; their relations are settled anew
        when they are next asked for."""
        state = {t: table_state(self.spark, f"{self.sf_dir}/{t}.parquet") for t in ("symbols", "edges", "code_chunks", "files")}
        changed = sorted(t for t, s in state.items() if self.states.get(t) != s)
        if changed:
            self.corpus, self.states = Corpus(self.spark, self.sf_dir), state
        return changed

    def language(self, query: str) -> str | None:
        """The one language that a question speaks of: that of the symbol it names, else the only one
        whose chunks know any of its concepts."""
        name = query.strip()
        if " " not in name:
            rows = self.corpus.symbols.where((F.col("name") == name) | (F.col("fqn") == name)).select("language").distinct().limit(2).collect()
            if len(rows) == 1 and rows[0]["language"]:
                return rows[0]["language"]
        words = [w for w in X.decompose(query) if len(w) >= 3 and w not in X.STOP_WORDS]
        if not words:
            return None
        rows = self.corpus.lexical.stats.where((F.col("section") == "token") & F.col("key").isin(*words)).select("language").distinct().collect()
        return rows[0]["language"] if len(rows) == 1 and rows[0]["language"] != "unknown" else None

    def pattern(self, query: str, limit: int = 100, cursor: str | None = None, timeout_ms: int = 5_000) -> dict[str, Any]:
        return execute(query, pattern_graph(self.corpus), limit, cursor, timeout_ms, self.generation)

    def related(self, file_path: str, line: int, limit: int = 5, drop_boilerplate: bool = False) -> dict[str, Any]:
        """Chunks related to the one at a line: nearest vectors, weighed with packages, parameter types and
        calls; boilerplate is weighed down unless asked about."""
        c = self.corpus
        spans = c.chunks_with("file_path", "line_start", "line_end").where(F.col("file_path") == file_path).withColumnRenamed("id", "span_id")
        point = self.spark.createDataFrame([(file_path, line)], "file_path string, line int")
        anchor = G.smallest_enclosing(point, spans, []).first()
        if anchor is None:
            return {"outcome": "not_found"}
        me = anchor["span_id"]
        vectors = c.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        paths = c.chunks_with("file_path").select("id", F.col("file_path").alias("group"))
        rows = vectors.join(paths, "id", "left")
        asked = rows.where(F.col("id") == me).select(F.col("id").alias("query_id"), "vector", "group")
        near = cut(V.top_cosine(asked, rows, max(limit + 1, limit + 50)).select("id", "score"))  # of other files
        if not near.limit(1).count():
            near = cut(V.top_cosine(asked.withColumn("group", F.lit(None).cast("string")), rows.withColumn("group", F.lit(None).cast("string")), limit + 1).where(F.col("id") != me).select("id", "score"))
        pool = near.join(c.chunks_of(near, "file_path", "fqn"), "id")
        mine = c.chunks_of(self.spark.createDataFrame([(me,)], "id long"), "fqn").first()
        symbols = c.symbols_with("fqn").select(F.col("id").alias("node"), F.col("fqn").alias("f"))
        seed = symbols.where(F.col("f") == (mine["fqn"] if mine else None)).select("node")
        links = c.resolved_edges.where("edge_type = 'CALLS'").select(F.col("source_symbol_id").alias("a"), F.col("target_symbol_id").alias("b"))
        calls = T.levels(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), seed, 3, seen=seed).groupBy("node").agg(F.min("depth").alias("depth"))
        known = pool.join(symbols, F.col("fqn") == F.col("f"), "left").join(calls, "node", "left")
        sharing = PS.type_sharing(PS.parameter_types(F.lit(mine["fqn"] if mine else None).cast("string")), PS.parameter_types(F.col("fqn")))
        score = K.related_score(P.package_overlap(F.lit(file_path), F.col("file_path")), sharing, F.coalesce(1 / F.col("depth"), F.lit(0.0)), F.col("score"))
        rated = known.select("id", "file_path", score.alias("score")).groupBy("id", "file_path").agg(F.max("score").alias("score"))
        role = self.spark.createDataFrame([(file_path,)], "file_path string").select(P.file_role(F.col("file_path"))).first()[0]
        ranked = PS.suppressed(rated, role, drop_boilerplate)
        return {"outcome": "resolved", "related": ranked.orderBy(F.desc("score"), "id").limit(limit)}

    # operations

    def health(self) -> dict[str, Any]:
        counts = {t: self.corpus.table(t).count() for t in ("symbols", "edges", "code_chunks", "files", "sessions", "subword_stats")}
        return {"outcome": "resolved", "counts": counts, "generation": O.generation_digest(self.sf_dir, counts, ("1",)), "edges": G.edge_stats(self.corpus.edges)}

    def ask(self, question: str, limit: int = 10, budget: int = 1200) -> dict[str, Any]:
        """Routes a question to the verb that answers it and trims search results to a token budget."""
        verb, target = route(question)
        if verb == "literal":
            return {"route": verb, **self.search(target, mode="exhaustive")}
        if verb in ("callers", "callees"):
            return {"route": verb, **self.neighbors(target, direction=verb, limit=limit)}
        if verb in ("implementations", "definition"):
            return {"route": verb, **getattr(self, verb)(target)}
        payload = {"route": verb, **self.search(question, limit)}
        if payload["outcome"] == "resolved" and "content" in payload["results"].columns:
            payload["results"] = K.budget_trim(payload["results"], X.estimated_tokens(F.col("content")), [F.round("score", 9).desc(), F.col("id")], budget)
        return payload

    def audit(self, kind: str, summary: str, count: int, begin: float) -> None:
        if self.audit_path:
            from datetime import datetime

            append_audit(self.spark, self.audit_path, [(datetime.now(), kind, summary[:200], int(count), int((time.monotonic() - begin) * 1000), 0)])
