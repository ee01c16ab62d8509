"""A query of each family against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from geoloom.queries import REGISTERED

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
CHOSEN = [
    "math_log2", "math_is_nodata", "math_integer_division", "math_logical_xor", "gis_reclass", "gis_percent_equal_to", "gis_weighted_overlay", "gis_update_nodata_cells",
    "image_mean_filter", "image_median_filter", "image_majority_filter", "image_k_nearest_mean_filter", "image_gaussian_filter", "image_sobel_filter", "image_tophat_transform", "image_rgb_to_ihs",
    "terrain_slope", "terrain_aspect", "terrain_surface_area_ratio", "terrain_pennock_landform_class", "terrain_max_elevation_deviation", "terrain_spherical_std_dev_of_normals",
    "hydro_d8_pointer", "hydro_dinf_pointer", "hydro_d8_flow_accumulation", "hydro_watershed", "hydro_snap_pour_points", "stream_strahler_order", "stream_link_class", "stream_tributary_identifier", "gis_clump",
    "stats_zonal_statistics", "stats_kappa_index", "stats_wilcoxon_signed_rank_test", "stats_image_autocorrelation", "math_quantiles", "plugin_otsu_thresholding",
    "gis_euclidean_allocation", "gis_idw_interpolation", "plugin_heat_map_quartic", "lidar_point_stats", "lidar_thin_nearest", "lidar_height_above_ground", "gis_vector_hex_binning",
    "gis_polygon_area", "gis_centroid_vector", "gis_medoid", "gis_smooth_vectors", "gis_line_intersections", "gis_clip", "data_vector_polygons_to_raster", "data_join_tables",
    # NoData of the sparse grid
    "image_min_max_contrast_stretch", "image_standard_deviation_contrast_stretch", "image_percentage_contrast_stretch", "image_integral_image",
    "image_balance_contrast_enhancement", "image_direct_decorrelation_stretch", "image_gaussian_contrast_stretch", "image_panchromatic_sharpening", "image_mosaic_with_feathering", "image_corner_detection", "image_thicken_raster_line",
    "gis_raster_perimeter", "gis_narrowness_index", "gis_shape_complexity_index_raster", "data_raster_to_vector_polygons",
    "hydro_average_upslope_flowpath_length", "hydro_average_flowpath_slope", "hydro_longest_flowpath", "hydro_unnest_basins", "hydro_find_outlet", "hydro_flatten_lakes", "hydro_burn_streams_at_roads", "hydro_breach_single_cell_pits",
    "terrain_downslope_index", "terrain_max_branch_length", "terrain_profile", "plugin_edge_contamination", "stream_long_profile_from_points", "stream_raster_streams_to_vector", "stream_extract_valleys",
    "lidar_clip_to_polygon", "lidar_kappa_index", "lidar_ground_point_filter", "lidar_classify_overlap_points", "plugin_individual_tree_detection",
    "stats_image_correlation_neighbourhood_analysis", "math_trend_surface_vector_points", "data_vector_lines_to_raster", "plugin_split_vector_lines", "gis_create_hexagonal_vector_grid", "data_merge_table_with_csv",
    "gis_intersect", "gis_union", "gis_dissolve", "stats_two_sample_ks_test",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, duck, name):
    fn, sql = REGISTERED[name]
    df = fn(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = duck.execute(sql)
    at = [[d[0] for d in rel.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_names():
    assert len(REGISTERED) > 250
    assert all(sql is None or "SELECT" in sql for _, sql in REGISTERED.values())
