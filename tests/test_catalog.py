import os

import pytest

import __spark_entry__ as entry
from broadsheet.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def rows(table):
    out = []
    for r in table.select(sorted(table.column_names)).to_pylist():
        out.append(str([round(v, 5) + 0.0 if isinstance(v, float) else (str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v) for v in r.values()]))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_duckdb(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    found = duck.execute(catalog.ORACLE[name])
    wanted = found.to_arrow_table() if hasattr(found, "to_arrow_table") else found.fetch_arrow_table()
    assert sorted(got.column_names) == sorted(wanted.column_names)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_without_oracle_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["time_period", "entity_text", "entity_type", "mention_count"] and df.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_plan_reads_few_columns(spark):
    plan = catalog.QUERIES["a2_entity_frequency"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Python" not in plan
