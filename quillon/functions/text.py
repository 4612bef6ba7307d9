"""Text functions of the document ETL as Column expressions; a UDF only where a scan must balance braces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def chunk_markdown(text: Column, limit: int = 3000) -> Column:
    """Cut at headings, pack pieces greedily below ``limit`` characters, and cut longer pieces hard."""
    parts = F.filter(F.transform(F.split(text, r"\n(?=##+\s)"), lambda x: F.trim(x)), lambda x: x != "")
    hard = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / limit)), lambda i: p.substr((i * limit + 1).cast("int"), F.lit(limit)))))
    empty = F.array().cast("array<string>")

    def pack(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(last, F.lit("\n"), p)
        return F.when((F.size(done) > 0) & (F.length(joined) <= limit), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(p)))

    # a hard cut of an empty array would make a wrong index, so nothing is packed then
    return F.when(F.size(parts) > 0, F.aggregate(hard, empty, lambda s, p: F.when(F.size(s) == 0, F.array(p)).otherwise(pack(s, p)))).otherwise(empty)


def first_balanced_object(text: str | None) -> str | None:
    """The first {...} whose braces balance outside strings."""
    if not text:
        return None
    start, depth, quoted, escaped = text.find("{"), 0, False, False
    if start < 0:
        return None
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


@F.pandas_udf(StringType())
def balanced_json(text: pd.Series) -> pd.Series:
    return text.map(first_balanced_object)


def sse_events(stream: Column) -> Column:
    """Server-sent events: an array of (event, data); an event without a name is a message."""
    blocks = F.filter(F.split(stream, r"\n\n"), lambda b: F.trim(b) != "")
    return F.transform(blocks, lambda b: F.struct(
        F.coalesce(F.nullif(F.regexp_extract(b, r"(?m)^event: *(.*)$", 1), F.lit("")), F.lit("message")).alias("event"),
        F.array_join(F.regexp_extract_all(b, F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n").alias("data")))
