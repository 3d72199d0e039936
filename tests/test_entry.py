"""The driver's contract: every query has SQL or is known not to, and small ones agree with it."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["scene_percentiles", "normalize_scene", "tile_invalid_fraction", "boundary_rejects", "overlap_average", "open_disk2", "connected_components", "region_measurements", "scene_alert", "coast_distance", "mask_set_ops", "lru_eviction", "expand_pass_grid", "geographic_area", "coast_search", "scene_bounds"]


def test_catalogue_has_sql():
    assert set(catalog.QUERIES) == set(oracle.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["scene_id", "region_id", "distance_to_coast_km", "severity", "confidence"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    have = catalog.QUERIES[name](spark, sf).toPandas()
    want = con.execute(oracle.SQL[name]).df()
    assert sorted(have.columns) == sorted(want.columns)
    cols = sorted(have.columns)

    def plain(x):
        x = x[cols].copy()
        for c in cols:
            if x[c].dtype.kind in "iuf" or str(x[c].dtype) == "Int64":
                x[c] = x[c].astype("float64").round(9)
        return x.astype(str).sort_values(cols).reset_index(drop=True)

    assert plain(have).equals(plain(want))
