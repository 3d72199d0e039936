"""Queries of scene bounds on scenes of more cells than meet in one aggregate: equal to their SQL, as on small ones."""

from dataclasses import replace

import duckdb
import pytest
from test_entry import test_query_equals_sql as equals_sql

from tidemark.config import DEFAULT
from tidemark.operators import stats
from tidemark.plans import catalog

NAMES = ["blend_layer", "classical_union", "components_four", "connected_components", "contours", "display_uint8", "erode_disk2", "geographic_area", "geographic_regions", "identity_stitch", "mask_area", "visible_contours"]


@pytest.mark.parametrize("name", NAMES)
def test_query_of_a_large_scene_equals_sql(spark, sf, name, monkeypatch):
    monkeypatch.setattr(stats.normalised, "__defaults__", (replace(DEFAULT, max_samples=500), None))
    equals_sql(spark, sf, name)


def test_halves_of_centroids_are_rounded_as_in_sql(spark):
    """Centroids of six places times 0.0005 have ten, so many lie halfway between two of eight."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    lat = f"{d('-0.0005')} * ({d('id')} / {d('100000')} + {d('4128.5')}) + {d('27')}"
    have = spark.range(3000).selectExpr("id", f"{lat} AS lat").orderBy("id").select(catalog._eight_places("lat")).collect()
    assert [r[0] for r in have] == [r[0] for r in duckdb.sql(f"SELECT round({lat}, 8) FROM range(3000) t(id) ORDER BY id").fetchall()]
