"""Content-addressed ids and configuration fingerprints over canonical JSON."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: object, ascii_only: bool = False) -> str:
    return json.dumps(value, ensure_ascii=ascii_only, sort_keys=True, separators=(",", ":"))


def fingerprint(value: object, length: int | None = 16, ascii_only: bool = False) -> str:
    return hashlib.sha256(canonical(value, ascii_only).encode()).hexdigest()[:length]


def config_ref(name: str, version: str, value: object, ascii_only: bool = False) -> str:
    return f"{name}@{version}:{fingerprint(value, ascii_only=ascii_only)}"


def fusion_ref(rrf_k: int, routes: list[str]) -> str:
    return config_ref("rrf", "1.0.0", {"algorithm": "reciprocal_rank_fusion", "version": "1.0.0", "rrf_k": rrf_k, "routes": sorted(routes)}, ascii_only=True)


def space_ref(provider: str, config: str, model: str, dimensions: int, preprocessing_version: str) -> str:
    return "embedding-space@1:" + fingerprint({"provider": provider, "config_ref": config, "model": model, "dimensions": dimensions, "preprocessing_version": preprocessing_version})


def element_id(document_id: Column, version: Column, ordinal: Column, locator: Column, text: Column) -> Column:
    return F.concat(F.lit("element_"), F.substring(F.sha2(F.concat_ws("\x1f", document_id, version, ordinal.cast("string"), locator, text), 256), 1, 16))


def chunk_id(document_id: Column, version: Column, policy: Column, kind: Column, text: Column, spans: Column) -> Column:
    """spans: array of element_id, start_char, end_char. Canonical JSON needs Python's escapes."""

    def f(d: pd.Series, v: pd.Series, p: pd.Series, k: pd.Series, t: pd.Series, s: pd.Series) -> pd.Series:
        rows = zip(d, v, p, k, t, s, strict=True)
        return pd.Series(["chunk_" + fingerprint({"document_id": a, "document_version": b, "policy_fingerprint": c, "kind": e, "text": g, "source_spans": [{"element_id": x["element_id"], "start_char": int(x["start_char"]), "end_char": int(x["end_char"])} for x in h]}) for a, b, c, e, g, h in rows])

    return F.pandas_udf(f, "string")(document_id, version, policy, kind, text, spans)


def cache_key(config: Column, model: Column, messages: Column, **parts: object) -> Column:
    """Key of a call: messages is JSON of a list of role and content; parts are constants of the configuration."""
    fixed = {"prompt_id": None, "prompt_version": None, "structured_mode": None, "schema_version": None, "temperature": None, "context_fingerprint": None, "extra": {}} | parts

    def f(c: pd.Series, m: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(fixed | {"config_ref": a, "model": b, "messages_hash": fingerprint(json.loads(d), None)}, None) for a, b, d in zip(c, m, x, strict=True)])

    return F.pandas_udf(f, "string")(config, model, messages)


def simple_chunk_id(document_id: Column, index: Column, content: Column) -> Column:
    return F.concat_ws(":", document_id, index.cast("string"), F.substring(F.sha1(content), 1, 12))
