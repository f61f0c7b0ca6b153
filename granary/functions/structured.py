"""Structured model output: fences, JSON candidates, risk lists with the stage at which they fail."""

from __future__ import annotations

import ast
import json
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import col, strip
from granary.functions.vector import let

#: Fixed values of the risk schema.
CATEGORIES = ("interaction", "state_flow", "api", "multi_platform", "exception", "other")
LEVELS = ("high", "medium", "low")
RISK = "struct<title:string,category:string,level:string,rationale:string,citations:array<struct<source_id:string,excerpt:string>>>"


def response_format(mode: str, schema: dict | None = None, name: str = "response") -> dict | None:
    """What a request says about the form of its answer. mode: none, json_object or json_schema (strict)."""
    if mode == "none":
        return None
    if mode == "json_object":
        return {"type": mode}
    if mode != "json_schema" or schema is None:
        raise ValueError(f"no response format {mode} without a schema")
    return {"type": mode, mode: {"name": name, "schema": schema, "strict": True}}


def json_text(c: Column | str) -> Column:
    """Stripped; a fence around the whole is taken off."""
    fence = r"(?is)^```(?:json)?\s*(.*?)\s*```$"
    return let(strip(c), lambda t: F.when(t.rlike(fence), strip(F.regexp_extract(t, fence, 1))).otherwise(t))


def risk_list(c: Column | str) -> Column:
    """risks, ok and error_stage (empty, json or schema) of an answer: an array of risks, an object with risks, or one risk. Each answer is parsed once."""

    def listed(t: Column, value: Column) -> Column:
        held = F.from_json(t, f"risks array<{RISK}>")["risks"]
        has_risks = F.try_variant_get(value, "$.risks", "variant").isNotNull()
        return F.when(F.substring(t, 1, 1) == "[", F.from_json(t, f"array<{RISK}>")).when(has_risks, held).otherwise(F.array(F.from_json(t, RISK)))

    def judged(t: Column, value: Column, risks: Column) -> Column:
        good = F.forall(risks, lambda r: r["title"].isNotNull() & r["rationale"].isNotNull() & r["category"].isin(*CATEGORIES) & r["level"].isin(*LEVELS) & F.coalesce(F.forall(r["citations"], lambda x: x["source_id"].isNotNull()), F.lit(True)))
        stage = F.when(t == "", "empty").when(value.isNull() | ~F.substring(t, 1, 1).isin("[", "{"), "json").when(risks.isNull() | ~F.coalesce(good, F.lit(False)), "schema")
        return let(stage, lambda s: F.struct(F.when(s.isNull(), risks).alias("risks"), s.isNull().alias("ok"), s.alias("error_stage")))

    return let(json_text(c), lambda t: let(F.try_parse_json(t), lambda v: let(listed(t, v), lambda r: judged(t, v, r))))


def risk_counts(risks: Column) -> Column:
    none = F.array()
    return let(risks, lambda rs: F.struct(F.size(rs).alias("risks"), F.size(F.filter(rs, lambda r: F.size(F.coalesce(r["citations"], none)) == 0)).alias("without_citation"), F.aggregate(rs, F.lit(0), lambda a, r: a + F.greatest(F.size(F.coalesce(r["citations"], none)), F.lit(0))).alias("claims")))


def _balanced(text: str, opens: str, closes: str) -> str | None:
    start = text.find(opens)
    depth, inside, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        ch = text[i]
        if inside:
            inside, escaped = (ch != '"' or escaped), (ch == "\\" and not escaped)
        elif ch == '"':
            inside = True
        else:
            depth += (ch == opens) - (ch == closes)
            if depth == 0:
                return text[start : i + 1]
    return None


def _candidate(text: str) -> str | None:
    lines = text.strip().splitlines()
    body = "\n".join(lines[1:-1] if len(lines) > 1 and lines[0].startswith("```") and lines[-1].startswith("```") else lines)
    return _balanced(body, "{", "}") or _balanced(body, "[", "]")


def json_candidate(c: Column | str) -> Column:
    """The first balanced object in the text, else the first array."""

    def f(texts: pd.Series) -> pd.Series:
        return texts.map(_candidate, na_action="ignore")

    return F.pandas_udf(f, "string")(col(c))


def is_json(c: Column | str) -> Column:
    return F.try_parse_json(col(c)).isNotNull()


def at_path(c: Column | str, path: str, default: str | None = None) -> Column:
    return F.coalesce(F.get_json_object(col(c), path), F.lit(default))


def without_nulls(struct: Column) -> Column:
    """JSON of a struct; null fields are left out."""
    return F.to_json(struct)


def server_sent_event(run_id: Column, sequence: Column, kind: Column, payload: Column) -> Column:
    return F.concat(F.lit("id: "), run_id, F.lit(":"), sequence, F.lit("\nevent: "), kind, F.lit("\ndata: "), payload, F.lit("\n\n"))


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Expression):
        return _value(node.body)
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
        return node.value
    if isinstance(node, ast.BinOp):
        return _OPS[type(node.op)](_value(node.left), _value(node.right))
    if isinstance(node, ast.UnaryOp):
        return _OPS[type(node.op)](_value(node.operand))
    raise ValueError("not arithmetic")


def calculate(c: Column | str) -> Column:
    """Value of an arithmetic expression of + - * / and signs; null for anything else."""

    def one(t: str) -> float | None:
        try:
            return float(_value(ast.parse(t, mode="eval")))
        except (ValueError, KeyError, SyntaxError, ZeroDivisionError):
            return None

    def f(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore").astype("float64")

    return F.pandas_udf(f, "double")(col(c))


def fingerprint_messages(c: Column | str) -> Column:
    def f(texts: pd.Series) -> pd.Series:
        from granary.functions.identity import fingerprint

        return texts.map(lambda t: fingerprint(json.loads(t), None), na_action="ignore")

    return F.pandas_udf(f, "string")(col(c))
