"""Shredding of deeply nested JSON records into related flat tables, in one pass over the records."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Members whose values are shredded, by lower-case name, and the table (tag) that each one goes to.
VALUE_MEMBERS = {"color": "color", "categories": "categories", "features": "features"}
#: Members whose text, where it is the JSON text of an object, counts as that object.
EMBEDDED_MEMBERS = ("details",)

TAGGED = T.StructType([
    T.StructField("tag", T.StringType(), False), T.StructField("raw_id", T.LongType()),
    T.StructField("row_key", T.StringType(), False), T.StructField("parent_key", T.StringType()), T.StructField("payload", T.StringType()),
])

#: Schema of each table's payload.
PAYLOADS = {
    "record": "struct<members:array<string>>",
    "object": "struct<members:array<string>>",
    **dict.fromkeys(VALUE_MEMBERS.values(), "struct<value:string,kind:string>"),
}

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null))')


def _not_json(text):
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_constant=_not_json)


def _decode_deep(text: str):
    """What json.loads gives, without recursion, for texts nested deeper than Python's stack allows."""
    holders, at, key, done, expect = [], 0, None, [], "value"
    while True:
        if done and not holders:
            if text[at:].strip(" \t\n\r"):
                raise ValueError("text after the value")
            return done[0]
        match = _TOKEN.match(text, at)
        if not match:
            raise ValueError(f"no JSON at {at}")
        at, (mark, string, plain) = match.end(), match.groups()
        if mark in ("}", "]"):
            holder = holders.pop() if holders else None
            if expect not in ("comma", "first") or not isinstance(holder[0], dict if mark == "}" else list):
                raise ValueError(f"unexpected {mark}")
            value, key = holder
        elif mark == ",":
            if expect != "comma":
                raise ValueError("unexpected ,")
            expect = "key" if isinstance(holders[-1][0], dict) else "value"
            continue
        elif mark == ":":
            if expect != "colon":
                raise ValueError("unexpected :")
            expect = "value"
            continue
        elif string is not None and (expect == "key" or expect == "first" and isinstance(holders[-1][0], dict)):
            key, expect = json.loads(string, strict=False), "colon"
            continue
        elif expect not in ("value", "first") or expect == "first" and isinstance(holders[-1][0], dict):
            raise ValueError("value out of place")
        elif mark:
            value = {} if mark == "{" else []
            holders.append((value, key))
            expect = "first"
            continue
        else:
            value = json.loads(string if string is not None else plain, strict=False)
        if holders:
            holder = holders[-1][0]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
        else:
            done.append(value)
        expect = "comma"


def decode_object(text):
    """The dict of a JSON object's text, else None (null, cut off, another kind of value, NaN or Infinity)."""
    if not isinstance(text, str) or "{" not in text:
        return None
    try:
        value = _DECODER.decode(text)
    except RecursionError:
        try:
            value = _decode_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def visit(record: dict):
    """Depth-first visitor of one record: yields (tag, row_key, parent_key, payload dict) for the record, for each
    object that is an element of an array, and for each string or number (not blank) in or below a value member.
    Keys are JSON pointers; a row's parent is the nearest such object above it, '' being the record."""
    yield "record", "", None, {"members": list(record)}
    stack = [(record, "", "", None, False)]
    while stack:
        node, path, owner, tag, in_array = stack.pop()
        if isinstance(node, dict):
            if in_array:
                yield "object", path, owner, {"members": list(node)}
                owner = path
            below = []
            for name, value in node.items():
                folded = name.lower()
                if isinstance(value, str) and folded in EMBEDDED_MEMBERS and (held := decode_object(value)) is not None:
                    value = held
                if not name.isascii():
                    name = name.encode("utf-8", "replace").decode()
                escaped = name.replace("~", "~0").replace("/", "~1") if "~" in name or "/" in name else name
                below.append((value, f"{path}/{escaped}", owner, VALUE_MEMBERS.get(folded) or tag, False))
            stack.extend(reversed(below))
        elif isinstance(node, list):
            stack.extend((node[i], f"{path}/{i}", owner, tag, True) for i in range(len(node) - 1, -1, -1))
        elif tag and node is not None and not isinstance(node, bool) and (not isinstance(node, str) or node.strip()):
            yield tag, path, owner, {"value": node if isinstance(node, str) else json.dumps(node), "kind": "string" if isinstance(node, str) else "number"}


def _shred(batches):
    for batch in batches:
        rows = []
        for raw_id, text in zip(batch["raw_id"].tolist(), batch["payload"].tolist(), strict=True):
            record = decode_object(text)
            if record is not None:
                rows.extend((tag, raw_id, key, parent, json.dumps(payload)) for tag, key, parent, payload in visit(record))
        yield pd.DataFrame(rows, columns=TAGGED.names).astype({"raw_id": "Int64"})


def shred(records: DataFrame) -> DataFrame:
    """Tagged rows (tag, raw_id, row_key, parent_key, payload) of ``records`` (raw_id, payload), one pass, no shuffle.

    A payload that is null, blank, cut off or no JSON object gives no row. Null and blank values give no row;
    booleans are no values. Members that repeat in one object: the last one counts. Extra columns are ignored; an
    empty table gives none. A repeated raw_id gives its rows again.
    """
    return records.select("raw_id", "payload").mapInPandas(_shred, TAGGED)


def write_tables(tagged: DataFrame, folder: str) -> None:
    """Write all tables at once, a sub-folder for each tag."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(folder)


def apply_schema(tagged: DataFrame, tag: str) -> DataFrame:
    """The flat table of one tag: raw_id, row_key, parent_key and the payload's columns."""
    rows = tagged.filter(F.col("tag") == tag).withColumn("_payload", F.from_json("payload", PAYLOADS[tag]))
    return rows.select("raw_id", "row_key", "parent_key", "_payload.*")


def value_rows(tagged: DataFrame) -> DataFrame:
    """The rows of all value tables: raw_id, value_path, owner_path."""
    return tagged.filter(F.col("tag").isin(*VALUE_MEMBERS.values())).select(
        "raw_id", F.col("row_key").alias("value_path"), F.col("parent_key").alias("owner_path")
    )
