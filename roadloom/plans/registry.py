"""Query registry, and the common table expressions oracle texts are built from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadloom.plans.fixtures import VIEWS, duck_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
RECURSIVE: set[str] = set()
_memo: dict[tuple, object] = {}


def cte(name: str, text: str, recursive: bool = False) -> None:
    CTES[name] = text
    if recursive:
        RECURSIVE.add(name.split("(")[0])


for _v in VIEWS:
    cte(_v, duck_text(_v))


def _needs(text: str, seen: list[str], skip: str | None = None) -> None:
    for word in dict.fromkeys(re.findall(r"\b[a-z_][a-z_0-9]*\b", text)):
        if word in CTES and word != skip and word not in seen:
            _needs(CTES[word], seen, word)
            if word not in seen:
                seen.append(word)


def oracle(text: str) -> str:
    """``text`` preceded by the definitions it uses, in order."""
    seen: list[str] = []
    _needs(text, seen)
    if not seen:
        return text
    parts = [f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTES[n].strip()})" for n in seen]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + text.strip()


def query(name: str, sql: str | None = None):
    """Registers a query with its oracle text."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return keep


def shared(fn):
    """Keeps a checkpointed intermediate per session and data folder."""

    def wrapped(spark: SparkSession, sf_dir: str):
        key = (fn.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _memo:
            _memo[key] = fn(spark, sf_dir)
        return _memo[key]

    return wrapped


def forget() -> None:
    _memo.clear()


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Haversine metres as SQL text."""
    a = (
        f"(pow(sin(radians({lat2}-{lat1})/2e0),2e0)"
        f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2e0),2e0))"
    )
    return f"(12742000e0*atan2(sqrt({a}),sqrt(1e0-{a})))"
