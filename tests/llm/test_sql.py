"""Queries of the operators that SQL can express, against their SQL twins."""

import glob
import os
import random

import duckdb
import pytest

from textloom.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, size):
    at = f"/root/testdata/{size}"
    c = duckdb.connect()
    for p in glob.glob(f"{at}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    shown = lambda x: "null" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    got = queries.QUERIES[name](spark, at)
    cols = sorted(got.columns)
    want = c.execute(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted(tuple(map(shown, r)) for r in rows)
    assert sorted(c.execute(f"describe ({queries.ORACLE_SQL[name]})").df()["column_name"]) == cols
    assert plain(got.select(*cols).collect()) == plain(want)


def test_url_verdicts_of_link_graphs_equal_sql(spark, tmp_path):
    """Chains, hubs and rings of canonical links and refreshes, absolute and relative, null html."""
    rng = random.Random(9)
    hosts = ["a.net", "B.net", "www.x.com", "example.org", "y.org"]
    paths = ["/", "/es/1", "/en/12", "/de/3", "/fr/4", "/p/q/r", "/p/s"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [f"http://hub.net/{i}" for i in range(40)] + [None, "no scheme/es/"]
    rows = []
    for i, u in enumerate(urls):
        html = "<html>text"
        html += rng.choice(["", "<!-- <link rel=canonical href=http://x.com/de/3> -->", "<script>'<!--' <link rel=canonical href=http://x.com/de/3></script>", "<base href='/p/q/'>"])
        for to in rng.sample(["/p/s", "s", "../p/s", "./../../de/0", "?q=1", "//a.net/", *[x for x in urls if x]], rng.randrange(3)) if rng.random() < 0.5 else []:
            to = rng.choice(["http://hub.net/0", "http://a.net/de/0"]) if "hub" in (u or "") else to
            html += rng.choice([f'<link rel="canonical" href="{to}">', f"<LINK href='{to}' class=x rel='nofollow canonical'>", f'<meta http-equiv="refresh" content="0; url={to}">'])
        rows.append((i, u, None if i % 11 == 5 else html))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = ("page_id", "host", "path", "rule", "verdict")
    got = queries.QUERIES["op9_urls"](spark, f"file://{tmp_path}").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(f"select {', '.join(names)} from ({queries.ORACLE_SQL['op9_urls']})").fetchall())
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}
