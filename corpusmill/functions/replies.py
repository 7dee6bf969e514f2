"""Clauses out of model replies that may be fenced, wrapped, nested or cut off."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

WRAPPERS = ("clauses", "data", "result", "items")
FIELDS = ("clause_id", "title", "body")


def loaded(reply: str | None) -> object:
    """The JSON of a reply, without a code fence; of one that was cut off, what closing its array or object can save; else None."""
    text = (reply or "").strip()
    if text.startswith("```"):
        text = text.partition("\n")[2]
        text = text.rstrip().removesuffix("```")
    tails = [""]
    begins = sorted(at for at in (text.find("["), text.find("{")) if at >= 0)
    if begins:
        array = text.find("[")
        cut = text[array if array >= 0 else begins[0] :]
        tails = ["", "]", "}", "]}"]
    else:
        cut = text
    for body in dict.fromkeys((text, cut, text[begins[0] :] if begins else text)):
        for tail in tails:
            try:
                return json.loads((body.rstrip().rstrip(",") if tail else body) + tail)
            except ValueError:
                continue
    return None


def _opened(found: object) -> list:
    """What is inside a value that is no clause itself: of an object with a `clauses` container that alone."""
    if isinstance(found, dict):
        told = found.get("clauses")
        found = [told] if isinstance(told, (list, dict)) else list(found.values())
    return found if isinstance(found, list) else []


def flattened(value: object) -> Iterator[dict]:
    """The clause objects of any nesting, in the order in which they are written.

    Values wait in a list and are opened one by one, so a reply may be nested as deep as it likes.
    """
    waiting = [value]
    while waiting:
        found = waiting.pop()
        if isinstance(found, dict) and found.keys() >= set(FIELDS) and not isinstance(found.get("clauses"), (list, dict)):
            yield found
        else:
            waiting += reversed(_opened(found))


def wrapped(value: object) -> list[dict]:
    """A list as it is, one under a usual key, or the values of an object of objects."""
    if isinstance(value, dict):
        lists = [value[k] for k in WRAPPERS if isinstance(value.get(k), list)]
        value = lists[0] if lists else list(value.values()) if value and all(isinstance(x, dict) for x in value.values()) else []
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def clauses(nested: bool = True):
    """A column function: reply to an array of clause_id, title, body; null where the reply holds no JSON."""

    @F.pandas_udf("array<struct<clause_id:string,title:string,body:string>>")
    def read(replies: pd.Series) -> pd.Series:
        found = []
        for reply in replies:
            value = loaded(reply)
            items = list(flattened(value)) if nested else wrapped(value)
            found.append(None if value is None else [{k: str(x.get(k) or "") for k in FIELDS} for x in items])
        return pd.Series(found, dtype=object)

    return read
