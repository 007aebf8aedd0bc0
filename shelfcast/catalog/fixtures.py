"""The engine's tables as projections of the star-schema files, in DataFrame form and in oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from shelfcast.sources.tables import read_table

REQUEST_COLUMNS = ("id", "week", "agency_id", "channel_id", "route_id", "client_id", "product_id")


_SCHEMAS: dict[str, StructType] = {}


def star(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Scan of a given table; its footer is read once per path, not once per query."""
    path = f"{sf_dir}/{table}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return read_table(spark, path, _SCHEMAS[path], fmt="parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = star(spark, sf_dir, "lineitem"), star(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def week_of(day: str) -> Column:
    """ISO weeks folded into the nine weeks 3 to 11."""
    return (F.lit(3) + F.weekofyear(day) % 9).cast("int").alias("week")


def sales_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines; what follows from the line or the order alone is taken before the join, so that less is moved."""
    units = F.col("l_quantity").cast("int")
    is_return = F.col("l_returnflag") == "R"
    back = F.floor(F.col("l_quantity") * F.col("l_discount") * 10)
    return_units = F.when(is_return, back.cast("int")).otherwise(0)
    return_amount = F.when(is_return, back * F.col("l_extendedprice") / F.col("l_quantity")).otherwise(0.0)
    id_parts = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    lines = star(spark, sf_dir, "lineitem").select(
        *id_parts,
        units.alias("units_sold"),
        F.col("l_extendedprice").alias("sales_amount"),
        return_units.alias("return_units"),
        return_amount.alias("return_amount"),
        F.greatest(units - return_units, F.lit(0)).alias("demand"),
    )
    orders = star(spark, sf_dir, "orders").select(
        "o_orderkey",
        week_of("o_orderdate"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("channel_id"),
        F.col("o_custkey").alias("client_id"),
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in id_parts], F.col("units_sold").cast("string")).alias("id"),
        "week",
        (F.col("l_suppkey") % 10).alias("agency_id"),
        "channel_id",
        F.col("l_suppkey").alias("route_id"),
        "client_id",
        F.col("l_partkey").alias("product_id"),
        "units_sold",
        "sales_amount",
        "return_units",
        "return_amount",
        "demand",
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the known weeks."""
    return sales_all(spark, sf_dir).where(F.col("week") <= 9)


def planted_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known weeks with a demand that follows the route and the agency, and a little chance, so that models can learn it."""
    return planted(sales(spark, sf_dir))


def planted(lines: DataFrame) -> DataFrame:
    demand = F.col("demand") % 5 + 12 * (F.col("route_id") % 4) + F.when(F.col("agency_id") >= 6, 8).otherwise(0)
    return lines.withColumn("demand", demand.cast("int"))


def planted_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the requests turn out to be where demand is planted."""
    return planted(sales_all(spark, sf_dir).where(F.col("week") >= 10)).select("id", F.col("demand").alias("actual"))


def warm_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known weeks for the back-off queries: some products, clients and routes stay cold, so every step answers rows."""
    product, client = F.col("product_id"), F.col("client_id")
    cold = (
        (product % 50 == 49)
        | (client % 200 >= 190)
        | (F.col("route_id") % 100 == 99)
        | ((product % 50 >= 40) & (F.col("agency_id") == 8))
    )
    return sales(spark, sf_dir).where(~cold)


def forecast_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_all(spark, sf_dir).where(F.col("week") >= 10).select(*REQUEST_COLUMNS)


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the clients: one in twenty has none, and one in a hundred has two."""
    key = F.col("c_custkey")
    named = star(spark, sf_dir, "customer").where(key % 200 < 190)
    names = F.when(key % 100 == 7, F.array("c_name", F.concat("c_name", F.lit(" II")))).otherwise(F.array("c_name"))
    return named.select(key.alias("client_id"), F.explode(names).alias("client_name"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of the products: one in ten products is missing, and one in seven has no brand."""
    key = F.col("p_partkey")
    return star(spark, sf_dir, "part").where(key % 50 < 45).select(
        key.alias("product_id"),
        F.when(key % 7 != 0, F.col("p_brand")).alias("brand"),
        (F.substring("p_brand", 7, 10).cast("int") % 16).alias("cat_brand"),
    )


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir, "events").select(
        F.col("user_id").alias("team_id"), (F.col("value") / 200).alias("score"), F.col("event_id").alias("submitted_seq")
    )


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clients buy in a week, by brand number: single parts are too many to be bought together often."""
    parts = star(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 10).cast("long").alias("product_id"))
    lines = order_lines(spark, sf_dir).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("o_custkey").alias("client_id"), "product_id", week_of("o_orderdate"))


def applicants_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    orders = star(spark, sf_dir, "orders")
    months = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    filled = F.col("o_orderstatus") == "F"
    by_orders = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.avg("o_totalprice").alias("av"),
        F.max("o_totalprice").alias("mx"),
        F.count("*").alias("n"),
        F.count_if(filled).alias("nf"),
        (F.max(months) - F.min(months)).alias("months"),
        F.max((filled & (F.col("o_totalprice") > 450000)).cast("int")).alias("tf"),
    )
    by_lines = (
        star(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_quantity")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n_li"), F.sum("l_quantity").alias("sq"))
    )

    def unless_every(n: int, value: Column) -> Column:
        return F.when(key % n != 0, value.cast("double"))

    return (
        star(spark, sf_dir, "customer")
        .join(by_orders, "c_custkey")
        .join(by_lines, "c_custkey")
        .select(
            key.alias("idx"),
            F.col("tf").alias("target_flag"),
            (F.abs("c_acctbal") * 8).alias("loan"),
            unless_every(11, F.col("av") / 2).alias("mortdue"),
            unless_every(13, F.col("mx") * 0.7).alias("value"),
            F.when(nation % 3 == 0, "").when(nation % 3 == 1, "DebtCon").otherwise("HomeImp").alias("reason"),
            F.col("c_mktsegment").alias("job"),
            unless_every(9, F.col("n")).alias("yoj"),
            unless_every(10, nation % 4).alias("derog"),
            unless_every(17, F.col("nf")).alias("delinq"),
            unless_every(19, F.col("months") * 8.0).alias("clage"),
            unless_every(23, nation % 6).alias("ninq"),
            unless_every(29, F.col("n_li")).alias("clno"),
            unless_every(5, F.col("sq") / 20).alias("debtinc"),
        )
    )


def applicants_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applicants_all(spark, sf_dir).where(F.col("idx") % 4 != 0)


def applicants_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants to score; their flag is hidden."""
    hidden = applicants_all(spark, sf_dir).where(F.col("idx") % 4 == 0)
    return hidden.withColumn("target_flag", F.lit(None).cast("int"))


def applicants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return applicants_train(spark, sf_dir), applicants_test(spark, sf_dir)


_SQL = {
    "sales_all": ((), """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                 CAST(l_linenumber AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS id,
       CAST(3 + CAST(extract(week FROM o_orderdate) AS INT) % 9 AS INT) AS week,
       CAST(l_suppkey % 10 AS BIGINT) AS agency_id,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS channel_id,
       l_suppkey AS route_id, o_custkey AS client_id, l_partkey AS product_id,
       CAST(l_quantity AS INT) AS units_sold, l_extendedprice AS sales_amount,
       CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity * l_discount * 10) AS INT) ELSE 0 END AS return_units,
       CASE WHEN l_returnflag = 'R' THEN floor(l_quantity * l_discount * 10) * l_extendedprice / l_quantity
            ELSE 0.0 END AS return_amount,
       greatest(CAST(l_quantity AS INT) - CASE WHEN l_returnflag = 'R'
                THEN CAST(floor(l_quantity * l_discount * 10) AS INT) ELSE 0 END, 0) AS demand
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "sales": (("sales_all",), "SELECT * FROM sales_all WHERE week <= 9"),
    "planted_all": (("sales_all",), """
SELECT * REPLACE (CAST(demand % 5 + 12 * (route_id % 4) + CASE WHEN agency_id >= 6 THEN 8 ELSE 0 END AS INT) AS demand)
FROM sales_all"""),
    "planted_sales": (("planted_all",), "SELECT * FROM planted_all WHERE week <= 9"),
    "planted_outcomes": (("planted_all",), "SELECT id, demand AS actual FROM planted_all WHERE week >= 10"),
    "forecast_requests": (("sales_all",), """
SELECT id, week, agency_id, channel_id, route_id, client_id, product_id FROM sales_all WHERE week >= 10"""),
    "clients": ((), """
SELECT c_custkey AS client_id, c_name AS client_name FROM customer WHERE c_custkey % 200 < 190
UNION ALL SELECT c_custkey, c_name || ' II' FROM customer WHERE c_custkey % 100 = 7"""),
    "brands": ((), """
SELECT p_partkey AS product_id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS brand,
       CAST(substr(p_brand, 7) AS INT) % 16 AS cat_brand
FROM part WHERE p_partkey % 50 < 45"""),
    "leaderboard": ((), """
SELECT user_id AS team_id, value / 200 AS score, event_id AS submitted_seq FROM events"""),
    "basket_lines": ((), """
SELECT o_custkey AS client_id, CAST(substr(p_brand, 7) AS BIGINT) AS product_id,
       CAST(3 + CAST(extract(week FROM o_orderdate) AS INT) % 9 AS INT) AS week
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""),
    "applicants_all": ((), """
SELECT c_custkey AS idx, CAST(o.tf AS INT) AS target_flag, CAST(abs(c_acctbal) * 8 AS DOUBLE) AS loan,
       CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE o.av / 2 END AS DOUBLE) AS mortdue,
       CAST(CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE o.mx * CAST(0.7 AS DOUBLE) END AS DOUBLE) AS value,
       CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'DebtCon' ELSE 'HomeImp' END AS reason,
       c_mktsegment AS job,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(o.n AS DOUBLE) END AS yoj,
       CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_nationkey % 4 AS DOUBLE) END AS derog,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(o.nf AS DOUBLE) END AS delinq,
       CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(o.months AS DOUBLE) * 8 END AS clage,
       CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST(c_nationkey % 6 AS DOUBLE) END AS ninq,
       CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE CAST(l.n_li AS DOUBLE) END AS clno,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE l.sq / 20 END AS debtinc
FROM customer
JOIN (SELECT o_custkey, avg(o_totalprice) AS av, max(o_totalprice) AS mx, count(*) AS n,
             sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS nf,
             max(year(o_orderdate) * 12 + month(o_orderdate)) - min(year(o_orderdate) * 12 + month(o_orderdate)) AS months,
             max(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 450000 THEN 1 ELSE 0 END) AS tf
      FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey
JOIN (SELECT o_custkey, count(*) AS n_li, sum(l_quantity) AS sq
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) l ON c_custkey = l.o_custkey"""),
    "applicants_train": (("applicants_all",), "SELECT * FROM applicants_all WHERE idx % 4 <> 0"),
    "applicants_test": (("applicants_all",), """
SELECT * REPLACE (CAST(NULL AS INT) AS target_flag) FROM applicants_all WHERE idx % 4 = 0"""),
}


_WARM_SALES = """
SELECT * FROM sales_all
WHERE week <= 9 AND NOT (product_id % 50 = 49 OR client_id % 200 >= 190 OR route_id % 100 = 99
                         OR (product_id % 50 >= 40 AND agency_id = 8))"""


def fx(*names: str, warm: bool = False) -> str:
    """``WITH`` clause that defines the named tables and what they need; append the query to it.

    ``warm`` leaves the cold rows out of ``sales``, as ``warm_sales`` does.
    """
    needed: list[str] = []

    def need(name: str) -> None:
        for parent in _SQL[name][0]:
            need(parent)
        if name not in needed:
            needed.append(name)

    for name in names:
        need(name)
    text = {n: _WARM_SALES if warm and n == "sales" else _SQL[n][1] for n in needed}
    return "WITH " + ",\n".join(f"{n} AS ({text[n]})" for n in needed) + "\n"


def warm_fx(*names: str) -> str:
    return fx(*names, warm=True)
