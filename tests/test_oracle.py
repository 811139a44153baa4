"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from leadmill.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list:
    def value(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        if pd.isna(v):
            return None
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted((tuple(map(value, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name in catalog.ORACLE:
        want = oracle.sql(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got)


def titled(spark, name, folder) -> tuple[list, list]:
    """Rows of a query and of its SQL over pages whose titles have separators of several kinds."""
    titles = ["Atonea, | reeast | tibleer", "a b c d | e", "ering. - heoren | x", "For ble_hendnt · co | a", "Foo Co | Bar Inc", "x — y, | z", ""]
    rows = [(i, f"https://site-{i // 3}.example.com/{i}", f"<html><title>{titles[i // 3 % 7]}</title><article>the {i}</article>") for i in range(63)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{folder}/pages.parquet/*.parquet'")
    return plain(catalog.QUERIES[name](spark, str(folder)).toPandas()), plain(con.sql(catalog.ORACLE[name]).df())


def test_candidates_of_titles_with_several_separators(spark, tmp_path):
    got, want = titled(spark, "r_web_candidates", tmp_path)
    assert got == want and len(got) > 20


def test_sites_of_titles_with_several_separators(spark, tmp_path):
    got, want = titled(spark, "r_web_sites", tmp_path)
    assert got == want and len(got) > 20


def test_library_stands_alone():
    """Nothing outside the optional subpackage imports it."""
    import subprocess
    import sys

    code = "import sys; sys.modules['leadmill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "False"]
