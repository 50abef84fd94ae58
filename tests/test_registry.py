import os
import shutil
import subprocess
import sys

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    from pointloom import registry

    q, o = registry.queries(), registry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


def plain(df):
    out = df[sorted(df.columns)].astype(object)
    out = out.where(out.notna(), None)
    return sorted((tuple(None if x is None or x != x else round(float(x), 5) if isinstance(x, float) else x for x in r) for r in out.itertuples(index=False)), key=str)


def names():
    from pointloom import registry

    return sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, duck, name):
    from pointloom import registry

    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/pointloom", tmp_path / "pointloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'chamfer_l1' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
