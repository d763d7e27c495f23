import json

from streamloom.cli import Shell, normalized

DOCUMENT = {
    "schema_name": "d", "window_size": 10, "window_unit": "seconds", "velocity": {"type": "count", "value": 1},
    "input_streams": [{"name": "s", "topic": "t", "schema": {"a": "INT", "k": "STRING"}}], "output_streams": [{"name": "o", "topic": "o", "schema": {"a": "INT"}}], "continuous_queries": [],
}


def test_words():
    assert [normalized(x) for x in ("table insert", "tableinsert", "table-insert", "TABLE_ADD_COLUMN", "table addcolumn", "quit", "add-input")] == [
        "table_insert", "table_insert", "table_insert", "table_add_column", "table_add_column", "exit", "add_input",
    ]


def test_session(spark, tmp_path):
    answers = [
        "help", "create", *json.dumps(DOCUMENT, indent=1).split("\n"), "END", "table create", "zones", "k:STRING, zone:STRING, n:INT", "table insert", "zones", 'k="x", zone=north, n=3',
        "table_update", "zones", "zone=south", "n=3", "table add-column", "zones", "note", "STRING", "table_select", "zones", "table schema", "zones", "tablelist",
        "query", "SELECT a, zone, COUNT(a) FROM s INNER JOIN zones ON k = k;", "q1", "joined", "query", "SELECT a FROM nowhere", "query", "SELECT a FROM s", "q1", "o",
        "add_input", "s2", "", "b:FLOAT", "status", "schemas", "save", str(tmp_path / "copy.json"), "load", str(tmp_path / "copy.json"), "table delete", "zones", "n=3", "nonsense", "quit",
    ]
    said, todo = [], iter(answers)
    Shell(spark, tmp_path, lambda prompt: next(todo), said.append, live=False).run()
    text = "\n".join(said)
    assert next(todo, None) is None
    for part in ("created d", "1 rows", '"zone": "south"', "k STRING, zone STRING, n INT, note STRING", "deployed q1: {'a': 'INT', 'zone': 'STRING', 'COUNT(a)': 'INT'}", "'nowhere' is no input stream",
                 "a query is named 'q1' already", "added s2", "loaded d", "unknown command 'nonsense'"):
        assert part in text, part
    saved = json.loads((tmp_path / "copy.json").read_text())
    assert [q["name"] for q in saved["continuous_queries"]] == ["q1"] and saved["output_streams"][1]["schema"] == {"a": "INT", "zone": "STRING", "COUNT(a)": "INT"}
