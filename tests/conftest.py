import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # workers import the package too
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    out = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture
def oracle():
    """Runs SQL on a connection of its own, so that an engine that breaks off spoils no other test."""
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")

    def rows(sql, *before):
        for statement in before:
            con.execute(statement)
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        return canonical(names, got.fetchall())

    yield rows
    con.close()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order]) for r in rows), [names[i] for i in order]


@pytest.fixture(scope="session")
def collected():
    return lambda df: canonical(df.columns, [tuple(r) for r in df.collect()])
