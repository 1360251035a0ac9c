import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

START = "2015-06-01 00:00:00"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g")
         .config("spark.sql.session.timeZone", "Asia/Kolkata")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="voltloom-tests-")).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def series(spark, values, key="k", cols=("value",), step=10, start=START):
    """Rows (key, ts, columns...) on the ten-minute grid; a value is a scalar or a tuple."""
    rows = [(key, i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    kinds = []
    for n, c in enumerate(cols):
        seen = [r[2 + n] for r in rows if r[2 + n] is not None]
        kind = "boolean" if seen and isinstance(seen[0], bool) else "string" if seen and isinstance(seen[0], str) else "double"
        kinds.append(f"{c} {kind}")
        if kind == "double":
            rows = [tuple(float(x) if j == 2 + n and x is not None else x for j, x in enumerate(r)) for r in rows]
    df = spark.createDataFrame(rows, f"key string, i bigint, {', '.join(kinds)}")
    ts = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("i") * step).cast("int"))
    return df.withColumn("ts", ts)


def column(df, name, by=("key", "ts")):
    return [r[name] for r in df.orderBy(*by).collect()]
