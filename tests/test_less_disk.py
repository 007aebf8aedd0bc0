"""What the feature tables and the model table shuffle."""

from shelfcast.operators import features as ft, models as md
from shelfcast.operators.skew import find_hot_keys
from test_moved import COLUMNS, brands, sales, shuffles  # noqa: F401


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_counts_are_dealt_once(sales, brands):  # noqa: F811
    tables, plain = ft.build_features(sales, brands, written=True), ft.build_features(sales, brands)
    for name, most in (("pair", 1), ("pair_week", 1), ("client_week", 1), ("product_route_week", 1), ("route_week", 2)):
        assert shuffles(getattr(tables, name)) <= most
        assert rows_of(getattr(tables, name)) == rows_of(getattr(plain, name).select(getattr(tables, name).columns))


def test_hot_keys_are_counted_before_they_are_dealt(spark):
    hot = [(f"h{i}", 3 + i % 2, 0, 1, 1, 1, 1, i % 3) for i in range(2000)]
    lines = spark.createDataFrame([*hot, *[(f"{i}", 3, 0, 1, i % 50, i, i % 30, 4) for i in range(2, 300)]], COLUMNS)
    found = find_hot_keys(lines, [ft.PAIR], fraction=1.0)
    assert found[ft.PAIR].count() == 1
    counts = ft.dealt_counts(lines, ft.PAIR, found)
    assert rows_of(counts) == rows_of(ft.demand_counts(lines, [*ft.PAIR, "week"]).select(counts.columns))
    assert "LeftSemi" in counts._jdf.queryExecution().optimizedPlan().toString()


def test_a_brand_that_is_not_read_moves_nothing_but_repeats_rows(sales, brands):  # noqa: F811
    tables = ft.build_features(sales, brands)
    twice = ft.build_features(sales, brands.unionByName(brands))
    once = ft.model_table(sales, tables, needed=md.LATEST_INPUTS)
    assert "cat_brand" not in once.columns and shuffles(once) < shuffles(ft.model_table(sales, tables, needed=(*md.LATEST_INPUTS, "cat_brand")))
    branded = sales.where("product_id < 9").count()
    assert ft.model_table(sales, twice, needed=md.LATEST_INPUTS).count() == once.count() + branded
