"""Engines and their registry: a deployment with its streams, tables and queries, fed by events or by live sources."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.types import struct
from ..operators.frames import ARRIVAL, EMIT, TIE
from ..plans.compiler import Environment, inputs
from ..plans.deployment import Continuous, Deployment, DeploymentError, Stream
from ..plans.query import Create, QueryError, Select, parse_all
from ..sources.folders import shared_folder
from ..sources.sinks import table_sink
from ..sources.tables import ReferenceTables
from . import live

Operator = Callable[[DataFrame], DataFrame]


class Engine:
    """One deployment. Events pushed to it wait for the next micro-batch, which `drain` or `results` runs; live sources run as streaming queries.

    The driver holds the events of one micro-batch. What queries remember, and the rows that they have given out, are tables in `folder`.
    """

    def __init__(self, spark: SparkSession, deployment: Deployment, tables: ReferenceTables | None = None, clock: Callable[[], float] = time.time, folder: str | None = None):
        self.spark, self.deployment, self.tables, self.clock = spark, deployment, tables, clock
        self._folder = folder
        self._events: dict[str, list[tuple]] = {n: [] for n in deployment.inputs}
        self._operators: dict[str, list[Operator]] = {}
        self._batch, self._drained = 0, 0
        self._sinks: dict[str, Callable[[dict[str, Any]], None]] = {}
        self._live: dict[str, StreamingQuery] = {}
        self._n = 0
        self.plans: dict[str, Select] = {}
        for t in deployment.static_tables:
            self._seed(t)
        for q in deployment.queries:
            self._plan(q)

    def _seed(self, doc: dict[str, Any]) -> None:
        """A table that the deployment brings along: name, schema and rows."""
        if self.tables is None:
            raise DeploymentError("static tables need a table store")
        columns = list((doc.get("schema") or doc.get("columns") or {}).items())
        if columns and doc["name"] not in self.tables.list_tables():
            self.tables.from_rows(doc["name"], columns, doc.get("rows", []))

    def _plan(self, query: Continuous) -> None:
        plan = parse_all(query.query)[:1]
        if not plan or isinstance(plan[0], Create):
            raise QueryError(f"query {query.name!r}: only SELECT can be deployed")
        select = plan[0]
        if select.source not in self.deployment.inputs:  # FROM says what a query reads; its input_stream need only be declared
            raise QueryError(f"query {query.name!r} reads {select.source!r}, which is no input stream")
        if select.join and select.join.target not in self.deployment.inputs and (self.tables is None or select.join.target not in self.tables.list_tables()):
            raise QueryError(f"query {query.name!r} joins {select.join.target!r}, which is neither a stream nor a table")
        self.plans[query.name] = select

    # what is declared

    def schema_name(self) -> str:
        return self.deployment.name

    def input_streams(self) -> list[str]:
        return list(self.deployment.inputs)

    def output_streams(self) -> list[str]:
        return list(self.deployment.outputs)

    def queries(self) -> list[str]:
        return list(self.plans)

    def window_config(self) -> dict[str, Any]:
        w = self.deployment.windowing
        return {"type": w.kind, "size": w.size, "unit": w.unit, "velocity": {"type": w.velocity_type, "value": w.velocity}}

    def add_input(self, stream: Stream) -> None:
        self.deployment.add_input(stream)
        self._events[stream.name] = []

    def add_query(self, query: Continuous) -> None:
        self.deployment.add_query(query)
        try:
            self._plan(query)
        except QueryError:
            self.deployment.queries.remove(query)
            raise

    def define(self, text: str) -> list[str]:
        """Run CREATE statements: a stream becomes an input (its topic is option `topic`, or its name), a table one of the store. Their names."""
        made = parse_all(text)
        if not all(isinstance(c, Create) for c in made):
            raise QueryError("only CREATE can define a stream or a table")
        if self.tables is None and any(c.kind == "TABLE" for c in made):
            raise DeploymentError("tables need a table store")
        for c in made:
            if c.kind == "STREAM":
                self.add_input(Stream(c.name, c.options.get("topic", c.name), dict(c.columns)))
            else:
                self.tables.create_table(c.name, list(c.columns))
        return [c.name for c in made]

    def add_operator(self, stream: str, operator: Operator) -> None:
        """Put an operator of one's own between a stream and all queries that read it: a function of event frames, which keeps the columns that begin with two underscores."""
        if stream not in self._events:
            raise ValueError(f"no stream is named {stream!r}")
        self._operators.setdefault(stream, []).append(operator)

    # pushed events

    def process_event(self, stream: str, event: dict[str, Any]) -> list[str]:
        """Take an event in now; the names of the queries that it reaches. Fields that are not declared, or not of their type, are left out."""
        if stream not in self._events:
            raise ValueError(f"no stream is named {stream!r}")
        self._n += 1
        kinds = struct(self.deployment.inputs[stream].columns)
        self._events[stream].append((round(self.clock() * 1_000_000), self._n, *(_fitted(event.get(f.name), f.dataType) for f in kinds)))
        return [name for name, plan in self.plans.items() if stream in inputs(plan, self.deployment.inputs)]

    def _through(self, stream: str, frame: DataFrame) -> DataFrame:
        for operator in self._operators.get(stream, []):
            frame = operator(frame)
        return frame

    def _frames(self) -> dict[str, DataFrame]:
        head = [T.StructField(ARRIVAL, T.LongType()), T.StructField(f"{TIE}0", T.LongType())]
        kinds = {name: T.StructType(head + struct(self.deployment.inputs[name].columns).fields) for name in self._events}
        return {name: self._through(name, self.spark.createDataFrame(rows, kinds[name])) for name, rows in self._events.items()}

    def _tables(self) -> dict[str, Callable[[], DataFrame]]:
        return {t: (lambda t=t: self.tables.frame(t)) for t in self.tables.list_tables()} if self.tables else {}

    def _rows(self, query: str) -> str:
        return f"{self._folder}/{query}/rows"

    def _advance(self) -> None:
        """Run the events that wait as a micro-batch."""
        if not any(self._events.values()):
            return
        self._folder = self._folder or f"{shared_folder(self.spark)}/engine-{uuid.uuid4().hex}"
        env = Environment(self._frames(), self._tables(), self.deployment.windowing)
        for name, plan in self.plans.items():
            reads = inputs(plan, env.streams)
            if any(self._events[n] for n in reads):
                state = live.State(self.spark, f"{self._folder}/{name}/state")
                live.Live(self.spark, plan, env, table_sink(self._rows(name)), state, keep=True).run({n: env.streams[n] for n in reads}, self._batch)
        self._events = {n: [] for n in self._events}
        self._batch += 1

    def _given(self, query: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._rows(query))
        there = self._folder and path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self._rows(query)) if there else None

    def results(self, query: str) -> DataFrame:
        """All rows that the query has given out for the events so far; no columns as long as there were no events."""
        self._advance()
        found = self._given(query)
        return self.spark.createDataFrame([], T.StructType([])) if found is None else found.drop(EMIT, "batch")

    def on_result(self, query: str, callback: Callable[[dict[str, Any]], None]) -> None:
        self._sinks[query] = callback

    def drain(self) -> dict[str, list[dict[str, Any]]]:
        """Rows that were given out since the last call, by query, in order; they go to the callbacks as well. Null fields are left out."""
        self._advance()
        out: dict[str, list[dict[str, Any]]] = {}
        for name in self.plans:
            found = self._given(name) if self._batch > self._drained else None
            rows = [] if found is None else found.filter(f"batch >= {self._drained}").orderBy("batch", EMIT).collect()
            out[name] = [{k: v for k, v in r.asDict().items() if k not in (EMIT, "batch") and v is not None} for r in rows]
            for row in out[name]:
                if name in self._sinks:
                    self._sinks[name](row)
        self._drained = self._batch
        return out

    # live sources

    def start(self, query: str, sources: dict[str, DataFrame], sink: live.Sink, checkpoint: str, arrival: str | None = None, trigger: dict | None = None) -> StreamingQuery:
        """Run a query over streaming frames, by stream; `arrival` names the column that says when an event came, else it is the time of the micro-batch. Tables are read anew for each micro-batch."""
        env = Environment({n: self._through(n, live.arrived(f, arrival)) for n, f in sources.items()}, self._tables(), self.deployment.windowing)
        self._live[query] = live.start(self.spark, self.plans[query], env, sink, f"{checkpoint}/{self.deployment.name}/{query}", query, trigger)
        return self._live[query]

    def running(self) -> list[str]:
        return [n for n, q in self._live.items() if q.isActive]

    def stop(self) -> None:
        for q in self._live.values():
            q.stop()
        self._live.clear()


def _fitted(value: Any, kind: T.DataType) -> Any:
    if isinstance(kind, T.DoubleType):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if isinstance(kind, T.LongType):
        whole = isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
        return int(value) if whole else None
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    return value if isinstance(value, str) or value is None else json.dumps(value) if isinstance(value, (dict, list)) else str(value)


class Registry:
    """Engines by the name of their deployment."""

    def __init__(self, spark: SparkSession, tables: ReferenceTables | None = None):
        self.spark, self.tables, self._engines = spark, tables, {}

    def _engine(self, document: dict[str, Any] | Deployment, **options: Any) -> Engine:
        found = document if isinstance(document, Deployment) else Deployment.from_document(document)
        return Engine(self.spark, found, self.tables, **options)

    def register(self, document: dict[str, Any] | Deployment, **options: Any) -> Engine:
        engine = self._engine(document, **options)
        if engine.schema_name() in self._engines:
            raise ValueError(f"{engine.schema_name()!r} is registered already")
        self._engines[engine.schema_name()] = engine
        return engine

    def replace(self, document: dict[str, Any] | Deployment, **options: Any) -> Engine:
        """The new engine starts without pushed events; live queries that are started again with their checkpoint go on with their state."""
        engine = self._engine(document, **options)
        if engine.schema_name() in self._engines:
            self._engines[engine.schema_name()].stop()
        self._engines[engine.schema_name()] = engine
        return engine

    def engine(self, name: str) -> Engine:
        if name not in self._engines:
            raise ValueError(f"no deployment is named {name!r}")
        return self._engines[name]

    def config(self, name: str) -> dict[str, Any]:
        return self.engine(name).deployment.document()

    def unregister(self, name: str) -> None:
        self.engine(name).stop()
        del self._engines[name]

    def list(self) -> list[str]:
        return sorted(self._engines)

    def process_event(self, name: str, stream: str, event: dict[str, Any]) -> list[str]:
        return self.engine(name).process_event(stream, event)


_registry: Registry | None = None


def global_registry(spark: SparkSession | None = None) -> Registry:
    global _registry
    if _registry is None:
        _registry = Registry(spark or SparkSession.builder.getOrCreate())
    return _registry


def reset_global_registry() -> None:
    global _registry
    if _registry:
        for name in _registry.list():
            _registry.unregister(name)
    _registry = None
