"""Cases of the guards and small parsers that are easy to get past."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import dates
from loomwork.operators import cleaning, quality, taxonomy
from loomwork.plans.notebook import read_only_tables


@pytest.mark.parametrize("sql", [
    "select (select max(x) from secret) from ok", "select * from ok where a in (select a from secret)", "select * from ok where exists (select 1 from secret)",
    "select * from ok where a > (select max(b) from (select * from secret) s)", "select reflect('java.lang.System', 'getenv') from ok", "select java_method('java.lang.Math', 'abs', 1) from ok",
    "select upper(input_file_name()) from ok", "describe secret", "describe table extended ok", "with c as (select * from secret) select * from ok join c on true",
])
def test_hidden_reads_are_refused(spark, sql):
    with pytest.raises(ValueError):
        read_only_tables(spark, sql, {"ok"})


def test_subqueries_on_allowed_tables_pass(spark):
    assert read_only_tables(spark, "select (select max(x) from ok) m from ok where a in (select a from also)", {"ok", "also"}) == {"ok", "also"}


@pytest.mark.parametrize("pattern,ok", [("(a?)+", False), ("(a?b?)*", False), ("(ab)?", True), ("a??", True), ("(?:a?){2,}", False), ("(?:ab)?c", True)])
def test_optional_parts_are_quantifiers(pattern, ok):
    assert quality.safe_pattern(pattern) is ok


@pytest.mark.parametrize("name,known,score", [("manager", "age", 0.0), ("ratecodeid", "rate", 0.0), ("ABCDef", "def", 0.85), ("vendorNameText", "vendorname", 0.65), ("user_age", "age", 0.85)])
def test_header_words_are_whole(name, known, score):
    assert taxonomy.header_score(name, (known,)) == score


def test_more_than_100_accepted_values_are_refused():
    with pytest.raises(ValueError):
        quality.violation(quality.Check("v", "accepted_values", "c", {"values": [str(i) for i in range(101)]}))


def test_only_number_and_dates(spark):
    df = spark.createDataFrame([("Stay 5 days",), ("5 of 7",), ("none",)], "t string")
    assert [r[0] for r in df.select(cleaning.embedded_number(F.col("t"))).collect()] == [5.0, None, None]
    texts = spark.createDataFrame([("Sep 25, 2021",), ("25 September 2021",), ("2010/12/01",), ("20101201",)], "t string")
    assert [str(r[0])[:10] for r in texts.select(dates.parse_time(F.col("t"))).collect()] == ["2021-09-25", "2021-09-25", "2010-12-01", "None"]
    parts = spark.createDataFrame([("a, b",), ("c, d",)], "v string")
    assert cleaning.choose_delimiter(parts, "v").first().delimiter == ", "
