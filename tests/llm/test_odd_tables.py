from shorespark.llm import queries


def test_queries_on_odd_tables(spark, edge_dir):
    for name, q in queries.QUERIES.items():
        rows = q(spark, edge_dir).collect()
        assert edge_dir.find("empty") < 0 or rows == [], name
