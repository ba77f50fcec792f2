from shorespark.plans import coast, problems, scenes


def test_problem_queries_on_odd_tables(spark, edge_dir):
    for name, q in problems.QUERIES.items():
        rows = q(spark, edge_dir).collect()
        assert edge_dir.find("empty") < 0 or rows == [], name


def test_shoreline_queries_on_odd_tables(spark, edge_dir):
    for name in ("ring_arcs", "nearest_crossing", "rate_status_completeness", "storm_interval_join", "storm_point_biserial", "tide_vertex_correction", "nearest_feature_click", "keep_first_corrections", "exposed_lengths"):
        coast.QUERIES[name](spark, edge_dir).collect()


def test_scene_queries_on_odd_tables(spark, edge_dir):
    for name in ("polygon_zonal_stats", "catalogue_reader", "stac_normalise"):
        scenes.QUERIES[name](spark, edge_dir).collect()
