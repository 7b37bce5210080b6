"""What has no built-in: Unicode composition, JSON repair, nested rewriting and patches, as Arrow-batched functions."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from civicframe.session import ship_active

PATCH_OPS = frozenset(("add", "remove", "replace", "move", "copy", "test"))


def nfc(x: str | Column) -> Column:
    """Composed to NFC, format characters dropped. For many rows, apply it to the distinct values and join."""
    ship_active()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "".join(ch for ch in unicodedata.normalize("NFC", t) if unicodedata.category(ch) != "Cf"))

    return run(x)


def repaired(text: str | None) -> str | None:
    """A JSON value, cut short or in a fence, as canonical JSON; null if it is beyond repair."""
    if text is None:
        return None
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return None
    body = text[min(starts) :]
    try:
        return json.dumps(json.JSONDecoder().raw_decode(body)[0], ensure_ascii=False, sort_keys=True)
    except ValueError:
        pass
    ends, stack, inside, escaped = [], [], False, False
    for i, ch in enumerate(body):
        if inside:
            escaped, inside = ch == "\\" and not escaped, escaped or ch != '"'
            if not inside:
                ends.append((i + 1, tuple(stack)))
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
            ends.append((i + 1, tuple(stack)))
        elif ch in "}]" and stack:
            stack.pop()
            ends.append((i + 1, tuple(stack)))
        elif ch == ",":
            ends.append((i, tuple(stack)))
    for at, still_open in reversed(ends):
        try:
            return json.dumps(json.loads(body[:at] + "".join(reversed(still_open))), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def repaired_json(x: str | Column) -> Column:
    ship_active()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(repaired)

    return run(x)


def rewritten(value: object, mapping: dict[str, str], keep: tuple[str, ...] = ("version",), top: bool = True) -> tuple[object, int]:
    """``@id`` values replaced at any depth, and how many; a list in which one was replaced drops what became equal.

    The document's own ``@id`` and its blocks named in ``keep`` stay: one is identity, the others history.
    """
    if isinstance(value, dict):
        out, n = {}, 0
        for k, v in value.items():
            if top and k in ("@id", *keep):
                out[k] = v
            elif k == "@id" and isinstance(v, str):
                out[k] = mapping.get(v, v)
                n += v in mapping
            else:
                out[k], m = rewritten(v, mapping, keep, False)
                n += m
        return out, n
    if isinstance(value, list):
        made = [rewritten(v, mapping, keep, False) for v in value]
        n = sum(m for _, m in made)
        return (list({json.dumps(v, sort_keys=True): v for v, _ in made}.values()) if n else [v for v, _ in made]), n
    return value, 0


def rewritten_json(x: str | Column, mapping: dict[str, str], keep: tuple[str, ...] = ("version",)) -> Column:
    """For a mapping of bounded size; rows that aren't JSON stay."""
    ship_active()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(rewritten(json.loads(t), mapping, keep)[0], ensure_ascii=False)
            except ValueError:
                return t

        return s.map(one)

    return run(x)


def patch_problem(text: str | None, blocked: tuple[str, ...]) -> str | None:
    """What is wrong with a list of patch operations, or null: all are taken or none."""
    try:
        ops = json.loads(text or "")
    except ValueError:
        return "not JSON"
    if not isinstance(ops, list) or not ops:
        return "not a list of operations"
    for op in ops:
        if not isinstance(op, dict) or op.get("op") not in PATCH_OPS:
            return "unknown operation"
        paths = [op.get("path")] + ([op.get("from")] if op["op"] in ("move", "copy") else [])
        if any(not isinstance(p, str) or p and not p.startswith("/") for p in paths):
            return "bad path"
        if op["op"] in ("add", "replace", "test") and "value" not in op:
            return "no value"
        touched = paths if op["op"] == "move" else paths[:1] if op["op"] != "test" else []
        if any(p == b or p.startswith(b + "/") or p == "" for p in touched for b in blocked):
            return "blocked path"
    return None


def patch_problems(x: str | Column, blocked: tuple[str, ...] = ()) -> Column:
    ship_active()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: patch_problem(t, blocked))

    return run(x)
