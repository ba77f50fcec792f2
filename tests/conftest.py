import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# many small plans that run once: the first compiler alone is faster
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-java-options -XX:TieredStopAtLevel=1 pyspark-shell")


@pytest.fixture(scope="session")
def spark():
    from shorespark.session import local_session

    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session", params=["empty", "nulls", "one", "twice"])
def edge_dir(request, tmp_path_factory):
    """The smallest test tables without rows, with rows of nulls only beside two others, with one row, with rows twice."""
    import glob

    import pyarrow as pa
    import pyarrow.parquet as pq

    d = tmp_path_factory.mktemp(request.param)
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        t = pq.read_table(f)
        if request.param == "nulls":
            t = pa.concat_tables([t.slice(0, 2), pa.table({c: pa.nulls(3, t.schema.field(c).type) for c in t.column_names}).cast(t.schema)])
        else:
            t = {"empty": t.slice(0, 0), "one": t.slice(0, 1), "twice": pa.concat_tables([t.slice(0, 5)] * 2)}[request.param]
        pq.write_table(t, d / os.path.basename(f))
    return str(d)
