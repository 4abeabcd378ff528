"""Operator 9: linking, order, validation, canonical JSON; against plain Python and, for the query, against DuckDB."""

import json

import duckdb
import pytest

from basecov.llm import tool_calls
from basecov.llm.queries import ORACLES, QUERIES

SCHEMAS = {"find": {"q": {"type": "string", "required": True, "minLength": 2, "maxLength": 5}, "n": {"type": "integer", "minimum": 1, "maximum": 9}, "x": {"type": "number"}, "o": {"type": "object"}, "a": {"type": "array"}, "b": {"type": "boolean"}}}
CALLS = "conv_id BIGINT, call_id STRING, turn BIGINT, name STRING, arguments STRING, depends_on STRING, extra INT"
RESULTS = "conv_id BIGINT, call_id STRING, turn BIGINT, content STRING, name STRING"


@pytest.fixture(scope="module")
def link(spark):
    def run(calls, results=()):
        made = spark.createDataFrame([(*c, 1) for c in calls], CALLS), spark.createDataFrame([(*r, "n") for r in results], RESULTS)
        return tool_calls.link(*made, SCHEMAS).collect()

    return run


@pytest.mark.parametrize(
    ("arguments", "errors"),
    [
        ('{"q": "abc", "n": 3, "x": 1.5, "o": {}, "a": [], "b": true}', []),
        ('{"q": "abc", "x": 2}', []),
        ('{"n": 0}', ["minimum: n", "missing: q"]),
        ('{"q": "a", "n": 10}', ["maximum: n", "minLength: q"]),
        ('{"q": "abcdef", "z": 1}', ["maxLength: q", "unknown: z"]),
        ('{"q": 5, "n": 1.5, "b": "true", "o": [], "a": {}}', ["type: a", "type: b", "type: n", "type: o", "type: q"]),
        ('{"q": null}', ["type: q"]),
        ("[1]", ["arguments: no object"]),
        ("{broken", ["arguments: no object"]),
        ("", ["arguments: no object"]),
        (None, ["arguments: no object"]),
    ],
)
def test_validation(link, arguments, errors):
    (row,) = link([(1, "c", 0, "find", arguments, None)])
    assert sorted(row.errors) == errors and row.status == "no result"


def test_links_and_statuses(link):
    ok = '{"q":"abc"}'
    calls = [(1, "a", 0, "find", ok, None), (1, "b", 4, "find", ok, "a"), (1, "c", 1, "none", ok, "zz"), (2, "a", 0, "find", ok, None), (2, "a", 0, "find", ok, None), (None, "a", 0, "find", ok, None), (3, None, 0, "find", ok, None)]
    results = [(1, "a", 1, "r1"), (1, "a", 3, "late"), (1, "b", 2, "early"), (1, "q", 2, "lost"), (2, "a", 1, None), (None, "a", 1, "n"), (3, None, 1, "n")]
    rows = sorted((r.conv_id, r.call_id, r.status, r.level, r.errors) for r in link(calls, results) if r.conv_id in (1, 2))
    assert rows == [
        (1, "a", "linked", 0, []),
        (1, "a", "repeated", None, []),
        (1, "b", "early", 1, []),
        (1, "c", "no result", 0, ["tool: unknown"]),
        (1, "q", "no call", None, []),
        (2, "a", "linked", 0, []),
        (2, "a", "linked", 0, []),
    ]
    rest = sorted(str((r.conv_id, r.call_id, r.status)) for r in link(calls, results) if r.conv_id not in (1, 2))
    assert rest == sorted(str(x) for x in [(None, "a", "no call"), (None, "a", "no result"), (3, None, "no call"), (3, None, "no result")])


def test_canonical_json(link):
    calls = [(1, "a", 0, "find", '{ "q" : "é\\"\\n", "n" : 1 }', None)]
    (row,) = link(calls, [(1, "a", 1, "x\ty/")])
    assert json.loads(row.json) == {"arguments": {"q": 'é"\n', "n": 1}, "call_id": "a", "conv_id": 1, "depends_on": None, "errors": [], "level": 0, "name": "find", "result": "x\ty/", "status": "linked", "turn": 0}
    assert row.json == json.dumps(json.loads(row.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_order_of_chains_and_cycles(spark):
    calls = [(1, f"c{i}", f"c{i - 1}") for i in range(100)] + [(2, "x", "y"), (2, "y", "x"), (2, "z", "y"), (3, "s", "s"), (4, "c5", "c4"), (4, None, "c5"), (5, "t", "u"), (5, "t", "u"), (5, "u", None)]
    found = {(r.conv_id, r.call_id): r.level for r in tool_calls.levels(spark.createDataFrame(calls, "conv_id BIGINT, call_id STRING, depends_on STRING")).collect()}
    assert found == {(1, f"c{i}"): i for i in range(100)} | {(2, "x"): None, (2, "y"): None, (2, "z"): None, (3, "s"): None, (4, "c5"): 0, (5, "t"): 1, (5, "u"): 0}


@pytest.mark.parametrize("n", [5, 9, 80, 700])
def test_one_long_chain_keeps_all_levels(spark, n):
    """The number of open calls shrinks while a chain is resolved; its tail must not pass for a cycle."""
    calls = [(1, f"c{i}", f"c{i - 1}") for i in range(n)] + [(2, "x", "y"), (2, "y", "x")]
    found = {(r.conv_id, r.call_id): r.level for r in tool_calls.levels(spark.createDataFrame(calls[:n], "conv_id BIGINT, call_id STRING, depends_on STRING")).collect()}
    assert found == {(1, f"c{i}"): i for i in range(n)}
    found = {(r.conv_id, r.call_id): r.level for r in tool_calls.levels(spark.createDataFrame(calls, "conv_id BIGINT, call_id STRING, depends_on STRING")).collect()}
    assert found == {(1, f"c{i}"): i for i in range(n)} | {(2, "x"): None, (2, "y"): None}


def test_empty_tables(spark):
    assert tool_calls.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).count() == 0


def test_query_equals_sql(spark, tmp_path):
    rows = [(c, t, "system" if t == 0 and c % 3 == 0 else "user" if (t + (c % 3 == 0)) % 2 == 0 else "assistant", f"text {c} {t} é\"\n" * (40 if c == 4 else 1)) for c in range(12) for t in range(c)]
    rows += [(50, 0, "user", ""), (50, 1, "assistant", None), (50, 2, "user", None), (51, 5, "assistant", "alone"), (52, 3, "system", "late")]
    spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").write.parquet(str(tmp_path / "conversations.parquet"))
    df = QUERIES["op9_tool_call_links"](spark, str(tmp_path))
    database = duckdb.connect()
    database.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    relation = database.execute(ORACLES["op9_tool_call_links"])
    names = [d[0] for d in relation.description]
    expected = [dict(zip(names, r)) for r in relation.fetchall()]
    assert sorted(str(sorted(r.asDict().items())) for r in df.collect()) == sorted(str(sorted(e.items())) for e in expected)


def test_query_keeps_turns_without_a_role(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, None, "b"), (1, 2, "user", "c"), (2, 7, None, "d")]
    spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").write.parquet(str(tmp_path / "conversations.parquet"))
    found = [(r.conv_id, r.call_id, r.turn, r.status, json.loads(r.json)["result"]) for r in QUERIES["op9_tool_call_links"](spark, str(tmp_path)).collect()]
    assert sorted(found) == [(1, "c0", 0, "linked", "b"), (1, "c2", 2, "no result", None), (2, "c6", 7, "no call", "d")]


def test_only_native_operations(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id BIGINT, turn BIGINT, role STRING, text STRING").write.parquet(str(tmp_path / "conversations.parquet"))
    plan = QUERIES["op9_tool_call_links"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
