import os
import sys

import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def cloud(spark):
    """Points from lists of positions: ``cloud(pos)`` is one set, ``cloud(pos, sets)`` several; node ids by position within the set."""

    def make(pos, sets=None, **more):
        sets = sets or [0] * len(pos)
        seen, rows = {}, []
        for i, (p, c) in enumerate(zip(pos, sets, strict=True)):
            n = seen[c] = seen.get(c, -1) + 1
            rows.append((c, n, [float(x) for x in p], *(v[i] for v in more.values())))
        kinds = {float: "double", int: "long", bool: "boolean", list: "array<double>", str: "string"}
        extra = "".join(f", {k} {kinds[type(v[0])]}" for k, v in more.items())
        return spark.createDataFrame(rows, "cloud_id long, node_id long, pos array<double>" + extra)

    return make
