"""Deployments: a document that declares streams, one window, a firing policy and continuous queries."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..functions.types import STREAM_TYPES

UNITS = {"seconds": 1, "minutes": 60, "hours": 3600}
WINDOW_TYPES = ("tumbling", "sliding")
AGG_STATES = ("cumulative", "window")


class DeploymentError(ValueError):
    """A deployment that cannot be used as it is."""


def seconds_of(size: float, unit: str) -> float:
    """Anything but minutes and hours counts as seconds."""
    return size * UNITS.get(unit.lower(), 1)


@dataclass(frozen=True)
class Stream:
    name: str
    topic: str
    columns: dict[str, str]

    def document(self) -> dict[str, Any]:
        return {"name": self.name, "topic": self.topic, "schema": dict(self.columns)}


@dataclass(frozen=True)
class Continuous:
    name: str
    input_stream: str
    output_stream: str
    query: str

    def document(self) -> dict[str, Any]:
        return {"name": self.name, "input_stream": self.input_stream, "output_stream": self.output_stream, "query": self.query}


@dataclass(frozen=True)
class Windowing:
    """The window of a deployment, and when it fires.

    agg_state: "cumulative" lets aggregates run on from window to window, "window" starts them anew. tumbling_velocity: whether the velocity
    also fires within a tumbling window (early), which only makes sense for aggregates that start anew. flush_last: whether the last, open window is given out.
    """

    kind: str = "tumbling"
    size: float = 1
    unit: str = "seconds"
    velocity_type: str = "count"
    velocity: float = 1
    agg_state: str = "cumulative"
    tumbling_velocity: bool = False
    flush_last: bool = False
    exact_scale: int | None = None

    def __post_init__(self):
        if self.kind.lower() not in WINDOW_TYPES:
            raise DeploymentError(f"unknown window type {self.kind!r}")
        if self.velocity_type.lower() not in ("count", "time"):
            raise DeploymentError(f"unknown velocity type {self.velocity_type!r}")
        if not self.size > 0 or not self.velocity > 0:
            raise DeploymentError("the window's size and the velocity must be over 0")
        if self.agg_state not in AGG_STATES:
            raise DeploymentError(f"unknown agg_state {self.agg_state!r}")
        if self.tumbling_velocity and self.agg_state != "window":
            raise DeploymentError("early firing needs agg_state 'window': else rows count twice")

    @property
    def micros(self) -> int:
        return round(seconds_of(self.size, self.unit) * 1_000_000)

    @property
    def sliding(self) -> bool:
        return self.kind.lower() == "sliding"


def _need(doc: dict, names: tuple[str, ...], where: str) -> None:
    for name in names:
        if name not in doc:
            raise DeploymentError(f"{where} lacks {name}")


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and x > 0


@dataclass
class Deployment:
    name: str
    windowing: Windowing
    inputs: dict[str, Stream]
    outputs: dict[str, Stream]
    queries: list[Continuous]
    static_tables: list[dict[str, Any]] = field(default_factory=list)

    @classmethod
    def from_document(cls, doc: dict[str, Any], **options: Any) -> Deployment:
        """Checked. `options` set the fields of Windowing that a document does not name."""
        _need(doc, ("schema_name", "window_size", "window_unit", "velocity", "input_streams", "output_streams", "continuous_queries"), "the deployment")
        if not _number(doc["window_size"]):
            raise DeploymentError("window_size must be a number over 0")
        if doc["window_unit"] not in UNITS:
            raise DeploymentError(f"window_unit must be one of {', '.join(UNITS)}")
        velocity = doc["velocity"]
        if not isinstance(velocity, dict) or velocity.get("type") not in ("count", "time") or not _number(velocity.get("value")):
            raise DeploymentError("velocity must have a type, count or time, and a value over 0")
        if not isinstance(doc["input_streams"], list) or not doc["input_streams"]:
            raise DeploymentError("input_streams must be a list of at least one stream")
        inputs, outputs = (cls._streams(doc[key], key) for key in ("input_streams", "output_streams"))
        found = []
        for q in doc["continuous_queries"]:
            _need(q, ("name", "input_stream", "output_stream", "query"), "a continuous query")
            cls._known(q["input_stream"], inputs, "input")
            cls._known(q["output_stream"], outputs, "output")
            found.append(Continuous(q["name"], q["input_stream"], q["output_stream"], q["query"]))
        if len({q.name for q in found}) < len(found):
            raise DeploymentError("two continuous queries have one name")
        windowing = Windowing(
            doc.get("window_type", "tumbling"), doc["window_size"], doc["window_unit"], velocity["type"], velocity["value"],
            **({k: doc[k] for k in ("agg_state", "tumbling_velocity", "flush_last") if k in doc} | options),
        )
        return cls(doc["schema_name"], windowing, inputs, outputs, found, list(doc.get("static_tables", [])))

    @staticmethod
    def _known(name: str, streams: dict[str, Stream], kind: str) -> None:
        if name not in streams:
            raise DeploymentError(f"no {kind} stream is named {name!r}")

    @staticmethod
    def _streams(docs: list[dict[str, Any]], where: str) -> dict[str, Stream]:
        out: dict[str, Stream] = {}
        for d in docs:
            _need(d, ("name", "topic", "schema"), f"a stream in {where}")
            if d["name"] in out:
                raise DeploymentError(f"two streams in {where} are named {d['name']!r}")
            if not isinstance(d["schema"], dict) or not d["schema"]:
                raise DeploymentError(f"stream {d['name']!r} declares no columns")
            for column, kind in d["schema"].items():
                if kind not in STREAM_TYPES:
                    raise DeploymentError(f"column {column!r} of {d['name']!r} has the unknown type {kind!r}")
            out[d["name"]] = Stream(d["name"], d["topic"], dict(d["schema"]))
        return out

    @classmethod
    def load(cls, path: str | Path, **options: Any) -> Deployment:
        return cls.from_document(json.loads(Path(path).read_text()), **options)

    @classmethod
    def read_lines(cls, lines, **options: Any) -> Deployment:
        """From lines of JSON, up to one that says END."""
        kept = []
        for line in lines:
            if line.strip() == "END":
                break
            kept.append(line)
        return cls.from_document(json.loads("\n".join(kept)), **options)

    def document(self) -> dict[str, Any]:
        w = self.windowing
        return {
            "schema_name": self.name, "window_type": w.kind, "window_size": w.size, "window_unit": w.unit, "velocity": {"type": w.velocity_type, "value": w.velocity},
            "agg_state": w.agg_state, "tumbling_velocity": w.tumbling_velocity, "flush_last": w.flush_last,
            "input_streams": [s.document() for s in self.inputs.values()], "output_streams": [s.document() for s in self.outputs.values()],
            "continuous_queries": [q.document() for q in self.queries], "static_tables": self.static_tables,
        }

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.document(), indent=2))

    def add_input(self, stream: Stream) -> None:
        self._add(stream, self.inputs)

    def add_output(self, stream: Stream) -> None:
        self._add(stream, self.outputs)

    def _add(self, stream: Stream, to: dict[str, Stream]) -> None:
        to |= self._streams([s.document() for s in (*to.values(), stream)], "the deployment")

    def add_query(self, query: Continuous) -> None:
        self._known(query.input_stream, self.inputs, "input")
        self._known(query.output_stream, self.outputs, "output")
        if any(q.name == query.name for q in self.queries):
            raise DeploymentError(f"a query is named {query.name!r} already")
        self.queries.append(query)
