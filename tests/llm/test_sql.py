"""The operators' queries that SQL can say, against it."""

import os

import duckdb
import pytest
from loomwell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        p = f"{data}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    df = queries.queries()[name](spark, data)
    cols = sorted(df.columns)
    cur = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got and got == sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)


def test_url_sql_canonicalises_too(spark, tmp_path):
    rows = ["HTTP://User:p@Host.COM:8080/A/./b/../%63asino?Q=%41#f", "http://x.org", "http://x.org?q", "http://x.org/..", "http://x.org/a/..", "http://x.org/a/b/.", "http://x.net./%zz%2F%e9%", "http://x.net/a..b/...", "no scheme", None, "http://a.net/WP-LOGIN", "http://u@CASINO.net:80/", "http://a.net/x/../cgi-bin/y"]
    spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(tuple(r) for r in queries.op8_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == sorted(c.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.oracle_sql()['op8_url_filter']})").fetchall())
