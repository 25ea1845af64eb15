"""One page of a pattern query: caps, deadline, cursors and errors as data."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import threading
import uuid
from typing import Any

from codeloom.plans.pattern.builder import build
from codeloom.plans.pattern.errors import PatternError
from codeloom.plans.pattern.graph_views import PatternGraph

MAX_ROWS, DEFAULT_ROWS = 500, 100
MAX_TIMEOUT_MS, DEFAULT_TIMEOUT_MS = 30_000, 5_000
MAX_BYTES = 200_000


def query_digest(text: str) -> str:
    return hashlib.sha256(re.sub(r"\s+", " ", text).strip().encode()).hexdigest()[:16]


def encode_cursor(generation: str, digest: str, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([generation, digest, offset]).encode()).decode()


def decode_cursor(cursor: str, generation: str, digest: str) -> int:
    try:
        gen, dig, offset = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except Exception as x:
        raise PatternError("malformed cursor", "invalid_cursor") from x
    if gen != generation or dig != digest:
        raise PatternError("the cursor belongs to another query or index", "stale_cursor")
    return int(offset)


def execute(text: str, graph: PatternGraph, limit: int = DEFAULT_ROWS, cursor: str | None = None, timeout_ms: int = DEFAULT_TIMEOUT_MS, generation: str = "") -> dict[str, Any]:
    """Rows of a page with outcome, columns, truncated, capped_by and next_cursor; errors are payloads."""
    limit = max(1, min(limit, MAX_ROWS))
    digest = query_digest(text)
    base = {"query_digest": digest, "index_generation": generation, "rows": [], "columns": [], "row_count": 0, "truncated": False, "next_cursor": None, "capped_by": None}
    sc = graph.symbols.sparkSession.sparkContext
    group = f"pattern-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(max(1, min(timeout_ms, MAX_TIMEOUT_MS)) / 1000, stop)
    try:
        offset = decode_cursor(cursor, generation, digest) if cursor else 0
        sc.setJobGroup(group, "pattern query", interruptOnCancel=True)
        timer.start()
        df = build(text, graph)
        page = df.offset(offset).limit(limit + 1).collect()
    except PatternError as x:
        return {**base, "outcome": "invalid_argument", **x.as_dict()}
    except RecursionError:
        return {**base, "outcome": "invalid_argument", "error": "the query is nested too deeply", "error_kind": "syntax", "position": None}
    except Exception as x:
        if late.is_set():
            return {**base, "outcome": "timeout", "error": "the query took too long", "error_kind": "timeout", "position": None}
        return {**base, "outcome": "failed", "error": type(x).__name__, "error_kind": "execution", "position": None}
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    rows = [r.asDict(recursive=True) for r in page[:limit]]
    capped = "rows" if len(page) > limit else None
    size = 0
    for n, row in enumerate(rows):
        size += len(json.dumps(row, default=str))
        if size > MAX_BYTES and n:
            rows, capped = rows[:n], "bytes"
            break
    more = capped is not None
    return {
        **base, "outcome": "resolved" if rows else "no_match", "rows": rows, "columns": df.columns, "row_count": len(rows), "truncated": more, "capped_by": capped,
        "next_cursor": encode_cursor(generation, digest, offset + len(rows)) if more else None,
    }
