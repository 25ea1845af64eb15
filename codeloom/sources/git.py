"""What a version control checkout says has changed: the input of change detection and sessions."""

from __future__ import annotations

import subprocess
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession


def _run(root: str, *arguments: str) -> list[str]:
    """The NUL-separated fields that git prints; its errors are raised."""
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace").strip() or "git failed")
    return [f for f in done.stdout.decode("utf-8", "surrogateescape").split("\0") if f]


def changed_paths(root: str, base: str, head: str | None = None) -> list[str]:
    """Paths, relative to the repository, that differ between two revisions, or from one to the work tree."""
    for ref in (base, head):
        if ref is not None and ref.startswith("-"):
            raise ValueError(f"{ref} is no revision")
    return sorted(_run(root, "diff", "--name-only", "-z", base if head is None else f"{base}...{head}", "--"))


def touched_paths(root: str) -> list[str]:
    """Paths that the work tree has changed, added or renamed and not yet committed."""
    fields, out, k = _run(root, "status", "--porcelain=v1", "-z", "--untracked-files=all"), [], 0
    while k < len(fields):
        out.append(fields[k][3:])
        k += 2 if "R" in fields[k][:2] or "C" in fields[k][:2] else 1  # the old name follows a renamed one
    return sorted(out)


def work_tree_sessions(spark: SparkSession, root: str, session_id: str, now: datetime, ttl_hours: int = 24) -> DataFrame:
    """WRITE events of the paths that the work tree has touched, as session rows."""
    rows = [(session_id, p, "WRITE", now, None, now + timedelta(hours=ttl_hours), now) for p in touched_paths(root)]
    return spark.createDataFrame(rows, "session_id string, file_path string, event_type string, event_time timestamp, weight_score double, ttl_expires_at timestamp, recorded_at timestamp")
