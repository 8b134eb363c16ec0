"""All registered queries of the engine with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that define `QUERIES` (name -> function) and `ORACLE` (name -> SQL).
MODULES: tuple[str, ...] = ("aggregates", "joins", "texts", "engine", "tools", "extras", "cues", "gates", "proofs", "classes", "stores", "entry")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"gristmill.plans.{name}"), attribute).items():
            if key in out:
                raise ValueError(f"{key} is registered twice")
            out[key] = value
    return out


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
