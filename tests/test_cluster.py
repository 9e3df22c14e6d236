"""Queries on a cluster, where the driver and the executors are processes of their own."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from test_oracles import DATA, compare, duck  # noqa: F401

from quillon.registry import ORACLES

ROOT = Path(__file__).resolve().parent.parent
NAMES = ["g_pg_count", "g_pg_findone", "g_pg_remove", "g_pg_rename", "scan_pg", "sink_pg_replace", "sink_pg_update"]
RUN = """
import sys
from pyspark.sql import SparkSession

root, folder, data, *names = sys.argv[1:]
sys.path.insert(0, root)
conf = {"spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.checkpoint.dir": f"file://{folder}/shared"}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
import quillon.queries
from quillon.registry import QUERIES

for name in names:
    try:
        QUERIES[name](spark, data).write.parquet(f"{folder}/{name}")
    except Exception as e:
        print(name, e)
spark.stop()
"""

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def written(tmp_path_factory):
    """The folder with the results, and what failed."""
    folder = tmp_path_factory.mktemp("cluster")
    (folder / "shared").mkdir()
    done = subprocess.run([sys.executable, "-c", RUN, str(ROOT), str(folder), DATA, *NAMES], cwd=folder, capture_output=True, text=True, timeout=600, check=False)
    return folder, done.stdout + done.stderr[-2000:]


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql_on_a_cluster(spark, duck, written, name):  # noqa: F811
    folder, said = written
    assert (folder / name / "_SUCCESS").exists(), said
    compare(spark, duck, lambda s, d: s.read.parquet(f"{folder}/{name}"), ORACLES[name])


def test_removal_tells_nulls_and_blanks_apart(spark, tmp_path):
    import duckdb

    from quillon.registry import QUERIES

    rows = [(1, "a", 1, 0.5, "BUILDING"), (2, "b", 1, 0.5, "BUILDING "), (3, "c", 1, 0.5, None), (4, None, 1, None, "building"), (5, "", None, 0.5, "")]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    connection = duckdb.connect()
    connection.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = QUERIES["g_pg_remove"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(connection.sql(ORACLES["g_pg_remove"]).fetchall())
