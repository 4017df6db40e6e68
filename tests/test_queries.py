"""Every registered query with SQL is compared with DuckDB on the smallest tables."""

import datetime

import duckdb
import pytest

from scenetrack.plans.queries import registered

QUERIES, ORACLE_SQL = registered()

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def canonical(rows):
    def norm(v):
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat(" ")
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["object_props", "perimeter", "fill_holes", "closing_box", "bridge", "stretch", "kmeans_levels", "track4", "rotation_lookback", "crosscorr", "case_expand", "geo_mercator", "ice_peaks", "relevant_set", "band_rules", "tile_blocks", "box_mean_halo", "clahe", "ice_from_water", "kmeans_tiles", "mask_holes", "merged_objects", "reconstruct_gray", "diffuse_eight", "convex_area", "case_overpass", "track_ids", "rotation_rates", "contour_points", "case_names", "clahe_by_range", "register_angle", "crosscorr_padded", "distance_squared", "expand_labels"])
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    found = canonical(tuple(r) for r in got.select(*names).collect())
    quoted = ", ".join(f'"{n}"' for n in names)
    wanted = canonical(duck.execute(f"select {quoted} from ({ORACLE_SQL[name]})").fetchall())
    assert found == wanted


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
