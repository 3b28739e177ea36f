"""Queries against their SQL over rows that the given tables lack."""

import os

import pytest

from lorebase.plans import ORACLES, QUERIES

from .conftest import SF, TABLES, same_rows

PAGES = ["<p>x &amp</p>y", "&amp;lt;b&amp;gt;", "&#150;&#x96; &#0; &#xD800; &copy2020 &notit; &bogus; AT&T;", "b \u0085", "\x0b c \x0b", "<p\x0bx>k", "<title>[Repealed.]</title>z", "<ſup>q</ſup>", "&ampamp;", "&NotEqualTilde;&apos;", "", "plain"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    for t, rows in (("pages", [(90_001 + i, "u", x) for i, x in enumerate(PAGES)]), ("documents", [(90_000 + 2 * i, f"zq{i}", "en", "src1", 5) for i in range(2000)])):
        given = spark.read.parquet(f"{SF}/{t}.parquet")
        (path / f"{t}.parquet").unlink()
        given.unionByName(spark.createDataFrame(rows, given.schema)).write.parquet(str(path / "new" / t))
        os.symlink(path / "new" / t, path / f"{t}.parquet")
    return str(path)


def sql_over(odd, name):
    sql = ORACLES[name]
    return sql.replace("FROM pages", f"FROM '{odd}/new/pages/*.parquet'").replace("FROM documents", f"FROM '{odd}/new/documents/*.parquet'")


@pytest.mark.parametrize("name", ["html_to_text", "parse_sections", "embedded_in_ranges"])
def test_odd_rows_equal_sql(spark, odd, name):
    got = QUERIES[name](spark, odd)
    same_rows(got, sql_over(odd, name))
    if name == "embedded_in_ranges":  # opposite signs in one slot leave no vector
        assert got.where("NOT unit").count() > 0
