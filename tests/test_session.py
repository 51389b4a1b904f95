"""The shared folder, the entry's contract, and every query's oracle at the smallest scale."""

import os

import pytest

import __spark_entry__
from rasterloom import session

SF = "/root/testdata/sf0.001"


class Cluster:
    """A session on a cluster, as far as shared_dir looks."""

    def __init__(self, conf):
        self.values = conf
        self.conf = self
        self.sparkContext = self
        self.master = "spark://host:7077"

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_shared_folder():
    assert session.shared_dir(Cluster({"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Cluster({}))


def test_cut_keeps_rows_and_schema(spark):
    d = spark.createDataFrame([(1, None), (2, [1, 2])], "a int, b array<int>")
    c = session.cut(d)
    assert c.schema == d.schema and sorted(c.collect()) == sorted(d.collect())


def test_names_of_queries_and_oracles():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 130


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
def test_oracles(spark):
    """A few of each module; the driver compares them all."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("embeddings", "events", "lineitem", "part", "pages", "conversations", "documents"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in ("px_compare_basic", "ssim_plane", "colour_delta_e2000", "edit_convolve", "components", "mesh_rectangles", "palette_nearest", "svg_minify", "page_specs", "anim_sample"):
        got, want = q[name](spark, SF).toPandas(), c.execute(o[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        a, b = (d[cols].astype(object).where(d[cols].notna(), None).map(lambda v: round(float(v), 6) if isinstance(v, int | float) else str(v)).sort_values(cols).reset_index(drop=True) for d in (got, want))
        assert a.equals(b), name
