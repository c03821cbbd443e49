"""Robots files: rules of a host, and whether a path may be fetched."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGENT = "search-crawler"
DEFAULT_DELAY_MS = 1000.0
SCHEMA = T.StructType([T.StructField("allow", T.ArrayType(T.StringType())), T.StructField("disallow", T.ArrayType(T.StringType())), T.StructField("crawl_delay_ms", T.DoubleType())])


def parse(text: str | None, agent: str = AGENT) -> tuple[list[str], list[str], float]:
    """(allow, disallow, delay in ms) of the block for ``agent``, else of the block for ``*``; compared in lower case.

    A block runs to the next user-agent line; of blocks for one agent the first holds. Lines end at line feeds, and
    may end in a carriage return. Allow lines are read first: an empty one ends all reading, so that no disallow line
    holds; an empty disallow line ends the reading of those. Of several delays the last number holds. Null and empty
    files have no rules.
    """
    blocks: dict[str, list[tuple[str, str]]] = {}
    current: list[tuple[str, str]] | None = None
    for line in (text or "").lower().split("\n"):
        name, colon, value = line.partition(":")
        name, value = name.strip(" \t\r"), value.split("#")[0].strip(" \t\r")
        if not colon:
            continue
        if name == "user-agent":
            current = blocks.setdefault(value, []) if value not in blocks else []
        elif current is not None:
            current.append((name, value))
    rules, delay = blocks.get(agent, blocks.get("*", [])), DEFAULT_DELAY_MS
    listed = {kind: [value for name, value in rules if name == kind] for kind in ("allow", "disallow")}
    allow, disallow = (values[: values.index("")] if "" in values else values for values in listed.values())
    for name, value in rules:
        if name == "crawl-delay" and re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", value):
            delay = float(value) * 1000
    return allow, [] if "" in listed["allow"] else disallow, delay


@F.pandas_udf(SCHEMA)
def robots_parse(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t) for t in text], columns=["allow", "disallow", "crawl_delay_ms"])


def robots_check(code: Column, rules: Column, path: Column) -> Column:
    """False if the robots file wasn't found or any disallowed prefix fits; true else."""
    return F.coalesce((code == "200") & ~F.exists(rules["disallow"], lambda p: F.lower(path).startswith(p)), F.lit(False))
