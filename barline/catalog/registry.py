"""Named queries: a Spark plan, an output shape, and (where SQL can say it) the equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline import session
from barline.operators import features, neighbours, outcomes, splits
from barline.session import Study, source_version, written
from barline.sources import events as adapter


@dataclass
class Tables:
    """The given tables and the data products derived from them, for one session, folder and study."""

    spark: SparkSession
    folder: str
    study: Study

    def table(self, name: str) -> DataFrame:
        return adapter.read_table(self.spark, self.folder, name)

    def _keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, source_version(self.spark, self.folder), self.study, name)
        if key not in _PRODUCTS:
            _PRODUCTS[key] = written(make(), name)
        return _PRODUCTS[key]

    def bars(self) -> DataFrame:
        """Paired bars with their position."""
        raw = adapter.paired_bars(self.table("events"), self.study.interval_s)
        return self._keep("bars", lambda: features.positioned(raw, self.study))

    def hourly(self) -> DataFrame:
        """Paired one-hour bars with their position, for the bar-level queries."""
        study = replace(self.study, interval_s=3600)
        raw = adapter.paired_bars(self.table("events"), study.interval_s)
        return self._keep("hourly", lambda: features.positioned(raw, study))

    def sided(self) -> DataFrame:
        return adapter.sided_bars(self.hourly())

    def states(self) -> DataFrame:
        return self._keep("states", lambda: neighbours.study_states(self.bars(), self.study))

    def outcomes(self) -> DataFrame:
        return outcomes.outcomes(self.bars(), self.study)

    def records(self) -> DataFrame:
        """Target records with the pair split and the global split."""

        def make() -> DataFrame:
            r = self._keep("raw_records", lambda: neighbours.records(self.states(), self.study))
            return splits.with_global_split(splits.with_pair_split(r, self.study.interval_s))

        return self._keep("records", make)

    def two_sided(self) -> DataFrame:
        raw = self._keep("raw_two_sided", lambda: neighbours.two_sided_records(self.states(), self.study))
        return self._keep("two_sided", lambda: splits.with_global_split(raw))


_PRODUCTS: dict[tuple, DataFrame] = {}


def close(spark: SparkSession) -> int:
    """Forget and delete the products of a session."""
    for key in [k for k in _PRODUCTS if k[0] == spark.sparkContext.applicationId]:
        del _PRODUCTS[key]
    return session.close(spark)


DEFAULT = Study()


@dataclass(frozen=True)
class Query:
    name: str
    shape: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str, study: Study = DEFAULT) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return shaped(self.plan(Tables(spark, folder, study)), self.shape)


QUERIES: dict[str, Query] = {}


def fields(shape: str) -> list[tuple[str, str]]:
    return [(f.partition(":")[0], f.partition(":")[2] or "s") for f in shape.split()]


def shaped(df: DataFrame, shape: str) -> DataFrame:
    """Select the named columns: d double to 6 digits, i bigint, t epoch seconds, b boolean, s as is."""
    out = []
    for name, kind in fields(shape):
        c = F.col(name)
        if kind == "d":
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "t":
            c = F.unix_seconds(c.cast("timestamp"))
        elif kind == "b":
            c = c.cast("boolean")
        out.append(c.alias(name))
    return df.select(*out)


def shaped_sql(body: str, shape: str) -> str:
    out = []
    for name, kind in fields(shape):
        c = f'"{name}"'
        if kind == "d":
            c = f"round(CAST({c} AS DOUBLE), 6) + 0.0"
        elif kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "t":
            c = f"CAST(epoch_us({c}) // 1000000 AS BIGINT)"
        elif kind == "b":
            c = f"CAST({c} AS BOOLEAN)"
        out.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({body}) AS answer"


FRAGMENTS: dict[str, str] = {}


def fragment(name: str, body: str) -> None:
    FRAGMENTS[name] = body


def with_fragments(body: str) -> str:
    """Prefix the named fragments a statement uses, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\bx_\w+", text):
            if word in FRAGMENTS and word not in order:
                visit(FRAGMENTS[word])
                if word not in order:
                    order.append(word)

    visit(body)
    ctes = ",\n".join(f"{n} AS ({FRAGMENTS[n]})" for n in order)
    return f"WITH {ctes}\n{body}" if order else body


def query(name: str, shape: str, sql: str | None = None) -> Callable:
    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, shape, plan, sql)
        return plan

    return register


def oracle(name: str) -> str | None:
    q = QUERIES[name]
    return None if q.sql is None else with_fragments(shaped_sql(q.sql, q.shape))
