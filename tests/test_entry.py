import importlib
import sys

import duckdb
import pytest
from briefmill.plans import registry

entry = importlib.import_module("__spark_entry__")


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_nothing_of_llm():
    loaded = [m for m in sys.modules if m.startswith("briefmill.") and not m.startswith("briefmill.llm")]
    from pathlib import Path

    for m in loaded:
        source = Path(sys.modules[m].__file__).read_text()
        assert "briefmill.llm" not in source


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tiny, name):
    con = duckdb.connect()
    from pathlib import Path

    for f in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, tiny)
    rel = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return float(v) if type(v).__name__ == "Decimal" else v

    want = sorted((tuple(plain(v) for v in r) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want
