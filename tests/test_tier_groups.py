"""The finest tier's groups are made once."""

from shelfcast.operators import hierarchy as hi


def test_finest_tier_is_grouped_once(spark):
    rows = [(1, 1, 1, 3), (1, 1, 1, 8), (1, 1, 2, 0), (2, 1, 1, None), (None, 1, 1, 5), (2, 2, 1, 7), (2, 2, 1, None)]
    sales = spark.createDataFrame(rows, "product_id long, client_id long, agency_id long, demand int")
    tiers = hi.fit_tiers(sales, (hi.PCA, hi.PC, hi.P))
    plan = tiers["pca"]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate(") == 2  # before and after the shuffle
    alone = {tuple(r) for r in tiers["pca"].collect()}
    # The same groups in another order of keys, rolled up from a finer table.
    finer = sales.selectExpr("*", "client_id AS route_id")
    rolled = hi.fit_tiers(finer, (hi.PCA, hi.PCR))["pca"].select("product_id", "client_id", "agency_id", "pca")
    assert alone == {tuple(r) for r in rolled.collect()} and len(alone) == 4
