"""SQL functions against the columns they are made of."""

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import sql

TEXTS = ["see hxxp://a[.]com/x?q='1' b@c.org, 10.1.2.3 CVE-2024-12345", "68656c6c6f", "aGVsbG8=", "a%20b", "10.0.0.1", "8.8.8.8", "fe80::1%eth0", "x1.evil-qwrtzxcv.co.uk", "curl/8.1", "72a589da586844d7f0818ce684948eea", "%PDF-1.7", "", None]


@pytest.fixture(scope="module")
def texts(spark):
    sql.register(spark)
    df = spark.createDataFrame([(n, t, t.encode() if t is not None else None) for n, t in enumerate(TEXTS)], "n int, s string, b binary")
    df.createOrReplaceTempView("sql_texts")
    return df


@pytest.mark.parametrize("name", sorted(sql.FUNCTIONS))
def test_function_is_its_column(spark, texts, name):
    arguments, function = sql.FUNCTIONS[name]
    c = "b" if "BINARY" in arguments else "s"
    mine = [r[0] for r in spark.sql(f"SELECT {name}({c}) FROM sql_texts ORDER BY n").collect()]
    assert mine == [r[0] for r in texts.orderBy("n").select(function(F.col(c))).collect()]


def test_lateral_extraction(spark, texts):
    rows = spark.sql("SELECT n, i.pos, i.type, i.value FROM sql_texts, LATERAL extract_iocs(s) AS i WHERE n = 0 ORDER BY i.pos").collect()
    assert [tuple(r)[2:] for r in rows] == [("url", "http://a.com/x?q="), ("domain", "a.com"), ("email", "b@c.org"), ("domain", "c.org"), ("cve", "CVE-2024-12345"), ("ipv4", "10.1.2.3")]
    assert [r["pos"] for r in rows] == list(range(6))


def test_quotes_in_texts_of_columns_stay(spark):
    column = F.concat(F.lit("it's <(a) and =(b) 1.5 \\ `x`"), F.when(F.length("s") <= 3, " short").otherwise(F.lit("")))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quoted_text(s STRING) RETURN {sql.sql_text(column)}")
    assert spark.sql("SELECT quoted_text('abc'), quoted_text('abcd')").first()[:] == ("it's <(a) and =(b) 1.5 \\ `x` short", "it's <(a) and =(b) 1.5 \\ `x`")
