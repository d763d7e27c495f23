"""A small command line: `python -m streamloom.cli`. Commands ask for what they need; `help` lists them."""

from __future__ import annotations

import json
import re
import sys
import tempfile
from collections.abc import Callable
from pathlib import Path

from .functions.types import infer_output_schema
from .plans.deployment import Continuous, Deployment, Stream
from .plans.query import Select, parse_all
from .sources import kafka
from .sources.sinks import callback_sink, fan_out
from .sources.tables import ReferenceTables
from .streaming.engine import Engine, Registry

COMMANDS = {
    "help": "this list", "load": "load a deployment from a JSON file, replacing one of its name", "create": "type in a deployment, ended by END", "schemas": "list deployments",
    "status": "what is declared and running", "add_input": "add an input stream", "query": "deploy a query", "save": "write a deployment to a JSON file",
    "table_create": "", "table_add_column": "", "table_insert": "", "table_update": "", "table_delete": "", "table_list": "", "table_schema": "", "table_select": "",
    "wait": "wait for the live queries", "exit": "stop all (also: quit)",
}


def normalized(line: str) -> str:
    """`table insert`, `tableinsert` and `table-insert` are `table_insert`."""
    word = re.sub(r"[\s-]+", "_", line.strip().lower())
    if word.startswith("table") and not word.startswith("table_"):
        word = f"table_{word[5:]}"
    if word.startswith("table_") and word not in COMMANDS:
        word = next((c for c in COMMANDS if c.startswith("table_") and c.replace("_", "") == word.replace("_", "")), word)
    return "exit" if word == "quit" else word


class Shell:
    def __init__(self, spark, root: str | Path, ask: Callable[[str], str] = input, say: Callable[[str], None] = print, live: bool = True):
        self.spark, self.root, self.ask, self.say, self.live = spark, Path(root), ask, say, live
        self.tables = ReferenceTables(spark, self.root / "tables")
        self.registry = Registry(spark, self.tables)
        self.paths: dict[str, Path] = {}

    def run(self) -> None:
        while True:
            try:
                line = self.ask("> ")
            except EOFError:
                line = "exit"
            if line.strip() and not self.one(line):
                return

    def one(self, line: str) -> bool:
        """False if that was the last command."""
        command = normalized(line)
        if command == "exit":
            for name in self.registry.list():
                self.registry.unregister(name)
            return False
        if command not in COMMANDS:
            self.say(f"unknown command {line.strip()!r}; try help")
            return True
        try:
            getattr(self, f"do_{command}")()
        except (ValueError, OSError) as e:
            self.say(f"error: {e}")
        return True

    def _choose(self) -> Engine:
        names = self.registry.list()
        return self.registry.engine(names[0] if len(names) == 1 else self.ask("deployment: ").strip())

    def _pairs(self, prompt: str) -> list[tuple[str, str]]:
        """name:TYPE, name:TYPE"""
        return [tuple(x.strip() for x in part.split(":", 1)) for part in self.ask(prompt).split(",") if ":" in part]

    def _values(self, prompt: str) -> dict:
        """A JSON object, or name=value, name=value."""
        text = self.ask(prompt).strip()
        if text.startswith("{"):
            return json.loads(text)
        out = {}
        for part in filter(str.strip, text.split(",")):
            name, _, value = part.partition("=")
            try:
                out[name.strip()] = json.loads(value)
            except ValueError:
                out[name.strip()] = value.strip()
        return out

    def _register(self, deployment: Deployment) -> Engine:
        engine = self.registry.replace(deployment)
        for q in deployment.queries:
            self._start(engine, q)
        return engine

    def _start(self, engine: Engine, query: Continuous) -> None:
        if not self.live:
            return
        plan = engine.plans[query.name]
        streams = [plan.source] + ([plan.join.target] if plan.join and plan.join.target in engine.deployment.inputs else [])
        sources = {n: kafka.read_topic(self.spark, engine.deployment.inputs[n]) for n in dict.fromkeys(streams)}
        topic = engine.deployment.outputs[query.output_stream].topic
        sink = fan_out(callback_sink(lambda row, n=query.name: self.say(f"[{n}] {json.dumps(row, default=str)}")), kafka.topic_sink(topic))
        engine.start(query.name, sources, sink, str(self.root / "checkpoints"))

    def do_help(self) -> None:
        for name, what in COMMANDS.items():
            self.say(f"{name:18}{what}")

    def do_load(self) -> None:
        path = Path(self.ask("file: ").strip())
        engine = self._register(Deployment.load(path))
        self.paths[engine.schema_name()] = path
        self.say(f"loaded {engine.schema_name()}")

    def do_create(self) -> None:
        lines = []
        while (line := self.ask("")).strip() != "END":
            lines.append(line)
        engine = self._register(Deployment.read_lines(lines))
        self._persist(engine)
        self.say(f"created {engine.schema_name()}")

    def _persist(self, engine: Engine) -> None:
        path = self.paths.setdefault(engine.schema_name(), self.root / "schemas" / f"{engine.schema_name()}.json")
        engine.deployment.save(path)

    def do_schemas(self) -> None:
        self.say(", ".join(self.registry.list()) or "none")

    def do_status(self) -> None:
        for name in self.registry.list():
            e = self.registry.engine(name)
            self.say(f"{name}: inputs {e.input_streams()}, outputs {e.output_streams()}, queries {e.queries()}, running {e.running()}, window {e.window_config()}, {kafka.default_settings().describe()}")

    def do_add_input(self) -> None:
        engine = self._choose()
        name = self.ask("stream: ").strip()
        engine.add_input(Stream(name, self.ask("topic: ").strip() or name, {n: k.upper() for n, k in self._pairs("columns (name:TYPE, ...): ")}))
        self._persist(engine)
        self.say(f"added {name}")

    def do_query(self) -> None:
        engine = self._choose()
        text = self.ask("query: ").strip().rstrip(";")
        found = parse_all(text)[:1]
        if not found or not isinstance(found[0], Select):
            raise ValueError("only SELECT can be deployed")
        plan, inputs = found[0], engine.deployment.inputs
        if plan.source not in inputs:
            raise ValueError(f"{plan.source!r} is no input stream")
        right, prefix = None, "right_"
        if plan.join and plan.join.target in inputs:
            right = inputs[plan.join.target].columns
        elif plan.join:
            right, prefix = self.tables.declared_schema(plan.join.target), "table_"
        schema = infer_output_schema(plan, inputs[plan.source].columns, right, prefix)
        name, output = self.ask("name: ").strip(), self.ask("output stream: ").strip()
        if output not in engine.deployment.outputs:
            engine.deployment.add_output(Stream(output, output, schema))
        query = Continuous(name, plan.source, output, text)
        engine.add_query(query)
        self._start(engine, query)
        self._persist(engine)
        self.say(f"deployed {name}: {schema}")

    def do_save(self) -> None:
        engine = self._choose()
        path = self.ask("file: ").strip()
        engine.deployment.save(path)
        self.say(f"saved {path}")

    def do_table_create(self) -> None:
        self.tables.create_table(self.ask("table: ").strip(), [(n, k.upper()) for n, k in self._pairs("columns (name:TYPE, ...): ")])
        self.say("done")

    def do_table_add_column(self) -> None:
        self.tables.add_column(self.ask("table: ").strip(), self.ask("column: ").strip(), self.ask("type: ").strip().upper())
        self.say("done")

    def do_table_insert(self) -> None:
        self.tables.insert_row(self.ask("table: ").strip(), self._values("values: "))
        self.say("done")

    def do_table_update(self) -> None:
        self.say(f"{self.tables.update_rows(self.ask('table: ').strip(), self._values('values: '), self._values('where: '))} rows")

    def do_table_delete(self) -> None:
        self.say(f"{self.tables.delete_rows(self.ask('table: ').strip(), self._values('where: '))} rows")

    def do_table_list(self) -> None:
        self.say(", ".join(self.tables.list_tables()) or "none")

    def do_table_schema(self) -> None:
        self.say(", ".join(f"{n} {k}" for n, k in self.tables.table_schema(self.ask("table: ").strip())))

    def do_table_select(self) -> None:
        for row in self.tables.select_rows(self.ask("table: ").strip()):
            self.say(json.dumps(row, default=str))

    def do_wait(self) -> None:
        for q in self.spark.streams.active:
            q.awaitTermination()


def main() -> None:
    from pyspark.sql import SparkSession

    root = sys.argv[1] if len(sys.argv) > 1 else tempfile.mkdtemp(prefix="streamloom-")
    Shell(SparkSession.builder.appName("streamloom").getOrCreate(), root).run()


if __name__ == "__main__":
    main()
