import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s


EDGE_SCHEMA = "source string, target string, relation string, confidence string, confidence_score double, source_file string, source_location string, weight double, extraction_seq int"
NODE_SCHEMA = "id string, label string, file_type string, source_file string, source_location string, line_end int, kind string, signature string, source_url string, captured_at string, author string, contributor string, extraction_seq int"


@pytest.fixture(scope="session")
def edges(spark):
    def make(*rows, relation="calls", seq=1):
        full = []
        for r in rows:
            r = tuple(r)
            full.append((r[0], r[1], r[2] if len(r) > 2 else relation, r[3] if len(r) > 3 else "EXTRACTED", 1.0, "test.hs", "L1", 1.0, seq))
        return spark.createDataFrame(full, EDGE_SCHEMA)

    return make


@pytest.fixture(scope="session")
def nodes(spark):
    def make(*rows, source_file="test.hs", file_type="code", seq=1):
        full = []
        for r in rows:
            r = (r, r) if isinstance(r, str) else tuple(r)
            full.append((r[0], r[1], r[3] if len(r) > 3 else file_type, r[2] if len(r) > 2 else source_file, "L1", None, None, None, None, None, None, None, seq))
        return spark.createDataFrame(full, NODE_SCHEMA)

    return make
