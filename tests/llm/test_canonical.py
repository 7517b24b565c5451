import pytest
from briefmill.llm import canonical as ca
from briefmill.llm import queries

VOCAB = [
    ("task_type", "trend", "Trend", ["time course", "Zeitverlauf"]),
    ("task_type", "part_to_whole", "Part to whole", ["share of total"]),
    ("chart_type", "bar", "Bar chart", ["column chart"]),
    ("chart_type", "stacked_bar", "Stacked bar chart", ["stacked columns"]),
    ("chart_type", "donut", "Donut chart", None),
    ("chart_type", "map", "Map", []),
]
DDL = "mapping_id bigint, task_type string, chart_type string, alternatives array<string>, value string, canonical string, list string"


def found(spark, rows):
    entries = spark.createDataFrame([(*v, "x") for v in VOCAB], "field string, canonical string, label string, aliases array<string>, value string")
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], DDL)
    own = ca.occurrences(df, "mapping_id", {"task_type": "task_type", "chart_type": "chart_type"}, {"alternatives": "chart_type"})
    return sorted((r.mapping_id, r.field, r.pos, r.canonical) for r in ca.map_to_list(own, entries).collect())


@pytest.fixture(scope="module")
def many(spark):
    values = {
        "TREND": "trend", " time-course ": "trend", "Zeitvrelauf": "trend", "zeitverla": "trend", "тrеnd": "trend", "Ｔｒｅｎｄ": "trend", "Part to wohle": "part_to_whole", "parttowhole": "part_to_whole",
        '{"type": "Trend"}': "trend", "task_type: share of total": "part_to_whole", "Trend (recommended)": "trend", "total, share of": "part_to_whole", "trend_analysis": "trend",
        "trendsetter accounts": "unmatched", "monthly": "unmatched", "task": "unmatched", "?": "unmatched", "Open Refund Value per Line": "unmatched", "x" * 20_000: "unmatched",
    }
    rows = found(spark, [(i, v, None, None) for i, v in enumerate(values)])
    return dict(zip(values, [c for _, _, _, c in rows], strict=True)), values


def test_values_of_every_kind(many):
    got, want = many
    assert got == want


def test_positions_blanks_and_canonical_values(spark):
    rows = [
        (1, "trend", "ColumnChart", [None, " ", "bar", "stackd bar", "radar chart"]),
        (2, None, "", None),
        (3, "​ ", "chart", []),
        (3, "Trend", "Trend", ["Donut"]),
        (3, "Trend", "Trend", ["Donut"]),
    ]
    assert found(spark, rows) == sorted(
        [
            (1, "chart_type", 0, "bar"), (1, "alternatives", 3, "stacked_bar"), (1, "alternatives", 4, "unmatched"), (3, "chart_type", 0, "unmatched"),
            *2 * [(3, "task_type", 0, "trend"), (3, "chart_type", 0, "unmatched"), (3, "alternatives", 0, "donut")],
        ]
    )


def test_empty_table(spark):
    assert found(spark, []) == []


def test_edits():
    assert ca.edits("trend", "trned", 3) == 1 and ca.edits("a", "a", 0) == 0 and ca.edits("abc", "xyz", 2) == 3


def test_every_free_value_has_one_row(spark, tiny):
    rows = queries.p2_found(spark, tiny)
    assert rows.count() == rows.select("mapping_id", "field", "pos").distinct().count()
