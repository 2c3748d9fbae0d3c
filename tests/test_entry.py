"""The driver's contract: every query runs; where there is SQL, DuckDB agrees."""

import glob
import importlib.util
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

Q, S = entry.queries(), entry.oracle_sql()
LLM = importlib.util.find_spec("loomgrain.llm") is not None


def plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return [plain(x) for x in v]
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    return v.item() if hasattr(v, "item") else v


def rows(df, cols):
    return sorted(repr([plain(x) for x in r]) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["topic", "source", "checked", "accepted", "accept_rate"]


def test_names():
    assert set(S) <= set(Q)
    assert not LLM or {f"p{n}" for n in range(1, 10)} <= {k.split("_")[0] for k in Q}


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, sf, duck, name):
    got = Q[name](spark, sf).toPandas()
    if name in S:
        expected = duck.execute(S[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(expected.columns)
        assert rows(got, cols) == rows(expected, cols)


def test_nothing_imports_the_optional_subpackage():
    root = os.path.dirname(entry.__file__)
    for path in glob.glob(f"{root}/loomgrain/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "loomgrain.llm" not in open(path, encoding="utf-8").read(), path


def test_workers_find_the_package_from_any_folder(sf, tmp_path):
    """The driver may have the package on its path only by its own doing."""
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.abspath(entry.__file__))!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", e.queries()["concurrency_levels"](s, {sf!r}).count(), e.queries()["p2_found"](s, {sf!r}).count() > 0)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1000 True" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("call", [
    "from loomgrain.operators import compaction; compaction.parsed_records(spark.createDataFrame([('{\"image_path\": \"a\", \"ts\": 1}',)], 'content string')).collect()",
    "from loomgrain.operators import throttle; throttle.token_bucket(spark.createDataFrame([('a', 1, 1.0)], 'worker string, seq bigint, t double'), 1.0).collect()",
    "from loomgrain.functions import jsonrepair; spark.createDataFrame([('[1]',)], 'a string').select(jsonrepair.parsed_list('a')).collect()",
    "from loomgrain.operators import ordering; from pyspark.sql import functions as F; ordering.range_cumulated(spark.range(3), [F.col('id').asc()], [], 'id', 'x').collect()",
])
def test_operators_work_on_any_frame_of_a_bare_session(tmp_path, call):
    out = _alone(tmp_path, call + "; print('DONE')")
    assert "DONE" in out.stdout, out.stderr[-2000:]


def test_a_cluster_without_a_shared_folder_is_refused():
    """No folder of a single machine takes the place of the shared one."""
    from types import SimpleNamespace as N

    from loomgrain import runtime

    none = N(get=lambda *_: None)
    on = lambda master: N(conf=none, sparkContext=N(applicationId="test-" + master, master=master, getConf=lambda: none, setCheckpointDir=lambda _: None))
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            runtime.scratch(on(master), "x")
    assert runtime.scratch(on("local[2]"), "x").startswith("file://")


def _alone(folder, code):
    import subprocess
    import sys

    head = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.abspath(entry.__file__))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")}
    return subprocess.run([sys.executable, "-c", head + code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
