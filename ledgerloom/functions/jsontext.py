"""JSON in what a model wrote: fences, prose around it, braces inside strings."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import functions as F

#: A string, or one of the four brackets; an unclosed string runs to the end.
TOKEN = re.compile(r'"(?:\\.|[^"\\])*(?:"|$)|[{}\[\]]', re.DOTALL)
FENCE = re.compile(r"```[a-zA-Z]*[ \t]*\r?\n?(.*?)```", re.DOTALL)


def _balanced(text: str, opening: str) -> str | None:
    """From the first bracket of the kind to the one that closes it, brackets in strings not counted."""
    start = text.find(opening)
    depth = 0
    for m in TOKEN.finditer(text, start) if start >= 0 else ():
        if m[0] in "{[":
            depth += 1
        elif m[0] in "}]":
            depth -= 1
            if depth == 0:
                return text[start : m.end()]
    return None


def _found(text: str | None, opening: str) -> str | None:
    fenced = [m[1] for m in FENCE.finditer(text or "") if m[1].strip()[:1] in ("{", "[")]
    for part in [*fenced, text or ""]:
        for candidate in (part.strip(), _balanced(part, opening)):
            if candidate and candidate[0] == opening:
                try:
                    json.loads(candidate, parse_constant=lambda _: 1 / 0)
                except (ValueError, ZeroDivisionError, RecursionError):
                    continue
                return candidate
    return None


def extract_json(col, kind: str = "object"):
    """The text of the JSON object (or array) in a model's output, null where there is none that parses.

    A fenced block comes first, then the whole text, then what reaches from the first bracket to the one that closes it. Brackets in strings don't count.
    """
    opening = {"object": "{", "array": "["}[kind]

    @F.arrow_udf("string")
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([_found(t.as_py(), opening) for t in texts], pa.string())

    return find(col)
