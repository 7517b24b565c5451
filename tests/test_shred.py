import json

import duckdb
from briefmill.operators.shred import decoded, entities, nodes_of, shred
from briefmill.plans import nested

DDL = (
    "output_id bigint, kpi_chart_mapping array<struct<kpi:string,task_type:string,chart_type:string,alternatives:array<string>,encoding:string>>, "
    "interactions array<string>, rationales array<struct<claim:string,principle:string>>, node string, parent string"
)


def found(spark, tmp_path, rows):
    spark.createDataFrame(rows, DDL).write.parquet(str(tmp_path / "design_outputs.parquet"))
    return {tuple(r) for r in nested.p7_found(spark, str(tmp_path)).collect()}


def test_children_and_positions(spark, tmp_path):
    layers = {"layers": [None, {"channels": {"name": "x"}}, {"channels": json.dumps([{"name": "a"}, None, {"name": "b"}])}]}
    rows = [
        (1, [None, ("k", "trend", "line", ["bar", None, "12"], json.dumps(layers))], ["plain", None, '{"targets": {"fields": "site"}}'], [("c", None), None], "clash", "clash"),
        (2, [("k", None, None, None, json.dumps(json.dumps({"layers": {"mark": "line"}})))], ["{no json}", '{"targets": [{"fields": [null, "a"]}, {}]}', "null"], [], None, None),
        (3, None, None, None, None, None),
        (4, [("k", None, None, [], "x: date")], [""], [(None, None)], None, None),
        (4, [("k", None, None, [], "x: date")], [""], [(None, None)], None, None),
    ]
    got = found(spark, tmp_path, rows)
    assert got == {
        (1, "mapping", 1, -1, -1), (1, "alternative", 1, 0, -1), (1, "alternative", 1, 2, -1),
        (1, "layer", 1, 1, -1), (1, "layer", 1, 2, -1), (1, "channel", 1, 1, 0), (1, "channel", 1, 2, 0), (1, "channel", 1, 2, 2),
        (1, "interaction", 0, -1, -1), (1, "interaction", 2, -1, -1), (1, "target", 2, 0, -1), (1, "field", 2, 0, 0), (1, "rationale", 0, -1, -1),
        (2, "mapping", 0, -1, -1), (2, "layer", 0, 0, -1), (2, "interaction", 0, -1, -1), (2, "interaction", 1, -1, -1),
        (2, "target", 1, 0, -1), (2, "target", 1, 1, -1), (2, "field", 1, 0, 1),
        (4, "mapping", 0, -1, -1), (4, "interaction", 0, -1, -1), (4, "rationale", 0, -1, -1),
    }


def test_empty_table(spark, tmp_path):
    assert found(spark, tmp_path, []) == set()


def test_decoded():
    assert decoded('"{\\"a\\": 1}"') == {"a": 1}
    assert decoded('{"a": 1} x') == '{"a": 1} x'
    assert decoded('"as agreed"') == '"as agreed"'
    assert decoded("12") == "12" and decoded("null") is None and decoded(None) is None
    assert decoded("[" * 5000) == "[" * 5000


def test_round_trip_rebuilds_records():
    """Every record can be rebuilt from its nodes alone."""
    record = {"a": [{"b": 1, "c": [1, 2, {"d": "x"}]}, "s"], "e": {"f": True, "g": "t"}, "h": []}

    def build(nodes):
        made = {}
        for node, _, _, _, _, kind, scalar in nodes:
            made[node] = {} if kind == "object" else [] if kind == "array" else scalar
        for node, parent, _, label, _, _, _ in nodes:
            if parent is None:
                continue
            if node.endswith("]"):
                if isinstance(made[parent], list):
                    made[parent].append(made[node])
                else:
                    made[parent].setdefault(label, []).append(made[node])
            else:
                made[parent][label] = made[node]
        return made[""]

    assert build(list(nodes_of(record, frozenset()))) == {"a": [{"b": "1", "c": ["1", "2", {"d": "x"}]}, "s"], "e": {"f": "true", "g": "t"}}


def test_very_long_array(spark):
    df = spark.createDataFrame([("r", ["v"] * 50_000)], "id string, items array<string>")
    nodes = shred(df, "id", ["items"], ["items"])
    assert nodes.filter("kind = 'scalar'").count() == 50_000


def test_entities_lead_to_parents(spark, tiny):
    nodes = nested.nodes(spark, tiny).cache()
    channels = entities(nodes, "output_id", nested.CHILDREN["channel"][0], ["name"], ["a", "b", "c"])
    layers = entities(nodes, "output_id", nested.CHILDREN["layer"][0], ["mark"], ["a", "b"])
    assert channels.count() > 0
    assert channels.select("output_id", "parent").join(layers.select("output_id", layers["node"].alias("parent")), ["output_id", "parent"], "left_anti").count() == 0


def test_tables_equal_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW design_outputs AS SELECT * FROM '{tiny}/design_outputs.parquet'")
    for name, sql in nested.ORACLE.items():
        ours = sorted(map(tuple, nested.QUERIES[name](spark, tiny).collect()), key=str)
        assert ours == sorted(con.execute(sql).fetchall(), key=str), name
