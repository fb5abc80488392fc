"""Strings out of JSON by dotted path: the first of a key counts, and nothing is read behind it."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BLANK = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_MARK = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|(.))", re.S)
_NESTED = re.compile(r'"(?:[^"\\]|\\.)*"|[][{}]', re.S)
_PLAIN = re.compile(r"[^,\]}\s]*")
_CONTROLS = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _text(raw: str) -> str:
    if "\\" not in raw:
        return raw
    found = _MARK.sub(lambda m: chr(int(m[1], 16)) if m[1] else _CONTROLS.get(m[2], m[2]), raw)
    return found.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _behind(text: str, at: int) -> int:
    """The end of the value at a place; len(text) if it has none."""
    if text[at : at + 1] == '"':
        found = _STRING.match(text, at)
        return found.end() if found else len(text)
    if text[at : at + 1] not in ("{", "["):
        return _PLAIN.match(text, at).end()
    depth = 0
    for found in _NESTED.finditer(text, at):
        depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(found[0], 0)
        if not depth:
            return found.end()
    return len(text)


def first_string(text: str | None, path: str) -> str | None:
    """The string at a dotted path of keys, or None: of the first of each key, whatever follows."""
    if text is None:
        return None
    skip = lambda at: _BLANK.match(text, at).end()
    at = skip(0)
    for key in path.split("."):
        while True:
            if text[at : at + 1] not in ("{", ","):
                return None
            name = _STRING.match(text, skip(at + 1))
            colon = skip(name.end()) if name else len(text)
            if text[colon : colon + 1] != ":":
                return None
            at = skip(colon + 1)
            if _text(name[1]) == key:
                break
            at = skip(_behind(text, at))
            if text[at : at + 1] != ",":
                return None
        if text[at : at + 1] == ",":
            return None
    found = _STRING.match(text, at)
    return _text(found[1]) if found else None


def json_string(text: Column, path: str) -> Column:
    """The string at a dotted path of keys, or null if it is absent or no string. Only what is no whole JSON without repeated
    keys goes to Python; other texts cost a null there."""
    at = "$" + "".join(f"[{json.dumps(k)[1:-1]!r}]" for k in path.split("."))
    whole = F.try_parse_json(text)
    typed = F.try_variant_get(whole, at, "variant")

    @F.pandas_udf(StringType())
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: first_string(t, path))

    return F.when(whole.isNull(), scan(F.when(whole.isNull(), text))).when(F.schema_of_variant(typed) == "STRING", F.try_variant_get(whole, at, "string"))
