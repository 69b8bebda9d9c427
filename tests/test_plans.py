"""Every registered query against its DuckDB text on the smallest driver tables."""

import math
import os

import pytest

from quern import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    text = plans.oracles().get(name)
    if text is None:
        assert got
        return
    cur = duck.execute(text)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_never_imports_the_optional_subpackage():
    import re

    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "quern")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"quern\.llm|from \.+llm|corpus_pipeline", open(os.path.join(folder, n), encoding="utf-8").read()), n


def test_token_multiset_takes_no_text_for_counts(spark, tmp_path):
    """Digits after a tag are text: the query agrees with its SQL on them, whatever their size."""
    duckdb = pytest.importorskip("duckdb")
    pages = [(1, "<p>4501042323994846</p><p>7<b class='x'>3</b>"), (2, "</p <b>12 < 3 <br/>"), (3, ""), (4, None), (5, "<P>1<td\n>2")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, plans.queries()["token_multiset"](spark, str(tmp_path)).select("token", "pages", "most").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(plans.oracles()["token_multiset"]).fetchall())
    assert ("p", 1, 2) in got
