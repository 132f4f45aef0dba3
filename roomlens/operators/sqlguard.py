"""F-8/F-9: read-only SQL over registered views.

The guard is the reference's rule (trimmed lower text starts with select or
with; none of the write words appear anywhere, as substrings), plus Spark's
own escape hatches (reflection calls, script transformation, SQL on files).  For a column of
statements the same rule is ``functions.text.guard_reason``; here it gates
one statement before ``spark.sql`` plans it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from roomlens.functions.text import GUARD_WORDS, SCRIPT_RULE, SPARK_GUARD_WORDS


class UnsafeSQL(ValueError):
    pass


def check_sql(sql: str) -> None:
    s = (sql or "").strip().lower()
    if not re.match(r"^(select|with)", s):
        raise UnsafeSQL("Only SELECT statements are allowed.")
    if any(w in s for w in GUARD_WORDS) or any(w in s for w in SPARK_GUARD_WORDS) \
            or re.search(SCRIPT_RULE, s):
        raise UnsafeSQL("Unsafe SQL detected.")


def guarded_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    """Check, register the views, and plan the statement (lazily)."""
    check_sql(sql)
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
