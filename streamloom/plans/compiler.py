"""Plans to DataFrames: the same over stored events and over a micro-batch of live ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, basic, joins, windows
from ..operators.frames import ARRIVAL, EMIT, own, sequenced
from .deployment import Windowing
from .query import Create, QueryError, Select, parse


@dataclass
class Environment:
    """Event frames by stream name, and tables: by name, as DataFrames or as functions that read the present rows."""

    streams: dict[str, DataFrame]
    tables: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    windowing: Windowing = field(default_factory=Windowing)

    def table(self, name: str) -> DataFrame:
        found = self.tables[name]
        return found() if callable(found) else found


def source(plan: Select, env: Environment) -> DataFrame:
    """The event frame that WHERE sees: the stream, joined if the plan says so."""
    if plan.source not in env.streams:
        raise QueryError(f"no stream is named {plan.source!r}")
    events, j, w = env.streams[plan.source], plan.join, env.windowing
    if not j:
        return events
    if j.target in env.streams:
        other = env.streams[j.target]
        if w.sliding:
            found = joins.sliding_join(events, other, j.left, j.op, j.right, w.micros)
        else:
            found = joins.tumbling_join(events, other, j.left, j.op, j.right, w.micros, w.flush_last)
        return found
    if j.target not in env.tables:
        raise QueryError(f"neither a stream nor a table is named {j.target!r}")
    table = env.table(j.target)
    if j.right not in table.columns:
        raise QueryError(f"table {j.target!r} has no column {j.right!r}")
    return joins.table_join(events, table, j.left, j.op, j.right)


def compile_query(query: str | Select, env: Environment, keep_emit: bool = False, input_stream: str | None = None) -> DataFrame:
    """The rows that a query gives out over all events of `env`, in no order; `keep_emit` adds EMIT, by which emissions can be told apart and ordered."""
    plan = parse(query) if isinstance(query, str) else query
    if isinstance(plan, Create):
        raise QueryError("only SELECT can be deployed")
    if input_stream and plan.source != input_stream:
        raise QueryError(f"the query reads {plan.source!r}, its input stream is {input_stream!r}")
    rows = source(plan, env)
    if plan.where:
        rows = basic.filtered(rows, plan.where)
    if plan.aggregates:
        w = env.windowing
        if w.sliding or w.tumbling_velocity:
            rows = sequenced(rows)  # counted over what reaches the window
        return aggregates.aggregated(windows.emissions(rows, w), plan, w.agg_state == "cumulative", w.exact_scale, keep_emit)
    if plan.star:
        out = rows.select(*(F.col(f"`{c}`") for c in own(rows)), *([ARRIVAL] if keep_emit else []))
    else:
        out = basic.projected(rows, [i.field for i in plan.select], (ARRIVAL,) if keep_emit else ())
    if keep_emit:
        out = out.withColumn(EMIT, F.struct(F.col(ARRIVAL).alias("w"), F.lit(0).cast("long").alias("s"))).drop(ARRIVAL)
    return out


def inputs(plan: Select, streams) -> set[str]:
    """The streams whose events reach the query."""
    return {plan.source} | ({plan.join.target} if plan.join and plan.join.target in streams else set())
