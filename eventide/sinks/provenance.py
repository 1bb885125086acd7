"""Parameter fingerprints, run records and the staleness of results."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import platform

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(parameters: dict) -> str:
    def check(v):
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("parameters must be finite")
        if isinstance(v, dict):
            return {str(k): check(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [check(x) for x in v]
        return v

    return json.dumps(check(parameters), sort_keys=True, separators=(",", ":"), allow_nan=False)


def fingerprint(parameters: dict) -> str:
    return hashlib.sha256(canonical_json(parameters).encode()).hexdigest()


def fingerprint_column(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of columns, keys in sorted order."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def staleness(
    *,
    exists: Column,
    readable: Column,
    schema_version: Column,
    dirty: Column,
    stored_fingerprint: Column,
    stored_commit: Column,
    expected_schema: str,
    expected_fingerprint: str | Column | None,
    current_commit: str | None,
) -> Column:
    """State of a processed result; the first matching rule wins."""
    state = F.when(~exists, "missing").when(~F.coalesce(readable, F.lit(False)), "unknown_version")
    state = state.when(~schema_version.eqNullSafe(F.lit(expected_schema)), "older_schema")
    state = state.when(F.coalesce(dirty, F.lit(False)), "dirty_code")
    if expected_fingerprint is not None:
        blank = F.coalesce(stored_fingerprint, F.lit("")) == ""
        wanted = expected_fingerprint if isinstance(expected_fingerprint, Column) else F.lit(expected_fingerprint)
        state = state.when(blank, "unknown_version").when(
            stored_fingerprint != wanted, "settings_changed"
        )
    state = state.when(F.coalesce(stored_commit, F.lit("")) == "", "unknown_version")
    if not current_commit:
        return state.otherwise("unknown_version")
    return state.when(stored_commit != current_commit, "different_commit").otherwise("current")


def run_record(workflow: str, parameters: dict, inputs: list[dict], outputs: list[str]) -> dict:
    """JSON record of one run (small, driver side)."""
    return {
        "schema_version": "1.0",
        "workflow": workflow,
        "created_utc": dt.datetime.now(dt.UTC).isoformat(),
        "parameters": parameters,
        "parameters_sha256": fingerprint(parameters),
        "inputs": inputs,
        "outputs": outputs,
        "software": {"python": platform.python_version(), "platform": platform.platform()},
    }
