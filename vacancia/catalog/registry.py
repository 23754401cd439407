"""Query registry. A query takes :class:`~vacancia.plans.tables.Tables` and returns a frame."""
from __future__ import annotations

import importlib
import pkgutil
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..plans.tables import SQL_TABLES, Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain_types(self.build(Tables(spark, sf_dir)))

    def oracle(self) -> str | None:
        return with_tables(self.sql) if self.sql else None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name any model table, whose definition is put in front."""
    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build
    return add


def plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and decimals as double, as the comparison expects."""
    wide = {T.ByteType(): "bigint", T.ShortType(): "bigint", T.IntegerType(): "bigint", T.FloatType(): "double",
            T.TimestampNTZType(): "timestamp"}
    casts = []
    for f in df.schema.fields:
        to = "double" if isinstance(f.dataType, T.DecimalType) else wide.get(f.dataType)
        casts.append(F.col(f"`{f.name}`").cast(to).alias(f.name) if to else F.col(f"`{f.name}`"))
    return df.select(*casts)


def with_tables(sql: str) -> str:
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL_TABLES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(body)
                needed.append(name)

    need(sql)
    ctes = [f"{n} AS ({SQL_TABLES[n].strip()})" for n in needed]
    body = sql.strip()
    if not ctes:
        return body
    head = re.match(r"(?is)WITH\s+(RECURSIVE\s+)?", body)
    if head:
        return f"WITH {head[1] or ''}{', '.join(ctes)}, {body[head.end():]}"
    return f"WITH {', '.join(ctes)} {body}"


def load_all() -> dict[str, Query]:
    from .. import catalog
    for module in pkgutil.iter_modules(catalog.__path__):
        if module.name != "registry":
            importlib.import_module(f"{catalog.__name__}.{module.name}")
    return REGISTRY
