"""Queries and their SQL on made tables that tell the rules apart."""

import duckdb

from oracle import compare
from tidemark.llm import queries


def both(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(queries.SQL[name]).df()
    assert compare(got, want) is None
    return got


def test_linked_hosts(spark, tmp_path):
    """Thirty hosts that link to a blocked one only: far below the absolute mass, but all they could have."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)
    rows = [(0, "http://bad.com/de/1", link("far.net")), (1, "http://good.org/1", link("friend.net", "mixed.net"))]
    rows += [(10 + i, f"http://farm{i}.net/a", link("bad.com")) for i in range(30)]
    rows += [(50, "http://mixed.net/", link("bad.com", "good.org")), (51, "http://friend.net/", link("good.org")), (52, "http://far.net/", ""), (53, "http://alone.net/", None), (54, None, link("bad.com"))]
    got = both(spark, tmp_path, "op1_link_trust_urls", pages=(rows, "page_id long, url string, html string"))
    verdict = dict(zip(got.page_id, got.verdict))
    assert all(verdict[10 + i] == "block" for i in range(30)) and verdict[50] == verdict[51] == verdict[52] == verdict[53] == verdict[54] == "allow"


def test_a_third_are_copies(spark, tmp_path):
    """A text that is there many times is not boilerplate of itself; a footer is."""
    copy = "Title\nsome text of the copied page\nanother line"
    rows = [(i, copy if i % 3 == 0 else f"page {i}\nwords of page {i}\n  Footer  line\n", "a") for i in range(90)]
    rows += [(100 + i, None if i % 2 else "", None) for i in range(8)] + [(200 + i, "x\nx\n\nX", "b") for i in range(7)] + [(300, "footer line", "c")]
    got = both(spark, tmp_path, "op3_site_line_dedup", documents=(rows, "doc_id long, text string, source string"))
    text = dict(zip(got.doc_id, got.text))
    assert text[0] == copy and text[1] == "page 1\nwords of page 1\n" and text[200] == "x\nx\n\nX" and text[300] == "footer line"
