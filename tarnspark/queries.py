"""One query for each operator family, over the driver's tables, with its SQL oracle.

``QUERIES[name](spark, sf_dir)`` gives the DataFrame, ``ORACLES[name]`` the SQL that an independent
engine answers from the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnspark.functions import dialect as D
from tarnspark.operators import ranking as R
from tarnspark.operators.entities import EntityIndex
from tarnspark.plans.executor import SafeExecutor
from tarnspark.plans.guard import Policy
from tarnspark.session import harden
from tarnspark.sources.tables import NAMES, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables by attribute, read when first named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(*self._at, name)


def query(sql: str):
    """Register a builder that takes the tables, under its own name, with its oracle."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        ORACLES[build.__name__] = sql
        return build

    return register


def lng(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


# --- reference query shapes ------------------------------------------------------------------------


@query("""
    WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, rank() OVER (ORDER BY o_totalprice DESC) AS position FROM orders WHERE o_totalprice IS NOT NULL)
    SELECT CAST(position AS BIGINT) AS position, o_orderkey, c_name, o_totalprice FROM r JOIN customer ON o_custkey = c_custkey WHERE position <= 10
""")
def q01_top_orders(t: Tables) -> DataFrame:
    top = R.top_with_ties(t.orders.where("o_totalprice is not null").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", 10)
    out = top.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return R.order(out.select(lng("position").alias("position"), "o_orderkey", "c_name", "o_totalprice"), "position", "c_name", "o_orderkey")


@query("""
    SELECT r_name, count(*) AS lines, round(avg(l_extendedprice * (1 - l_discount)), 2) AS avg_revenue
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE l_extendedprice IS NOT NULL GROUP BY r_name
""")
def q02_mean_by_group_over_bridge(t: Tables) -> DataFrame:
    # sums by the bridge key first: the dimensions join what is left
    by = t.lineitem.where("l_extendedprice is not null").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s"))
    j = by.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.sum("n").alias("lines"), F.round(F.sum("s") / F.sum("n"), 2).alias("avg_revenue")).orderBy(F.desc("avg_revenue"), "r_name")


@query("""
    WITH m AS (SELECT l_orderkey, l_linenumber, round((l_extendedprice - l_extendedprice * l_discount) / l_extendedprice, 12) AS margin FROM lineitem WHERE l_extendedprice > 0 AND l_discount IS NOT NULL),
    r AS (SELECT *, rank() OVER (ORDER BY margin DESC) AS position FROM m)
    SELECT CAST(position AS BIGINT) AS position, o_orderpriority, count(*) AS lines, max(margin) AS margin FROM r JOIN orders ON l_orderkey = o_orderkey WHERE position <= 10 GROUP BY ALL
""")
def q03_ratio_rounded_then_ranked(t: Tables) -> DataFrame:
    m = t.lineitem.where("l_extendedprice > 0 and l_discount is not null").select("l_orderkey", R.rounded_ratio(F.col("l_extendedprice") - F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice"), 12).alias("margin"))
    # ties may be many: equal margins are counted, and only the ten greatest are ranked
    counts = m.groupBy("margin").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("margin")).limit(10)
    before = Window.orderBy(F.desc("margin")).rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.withColumn("position", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).where("position <= 10").drop("n")
    return m.join(cut, "margin").join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(lng("position").alias("position"), "o_orderpriority").agg(F.count(F.lit(1)).alias("lines"), F.max("margin").alias("margin"))


@query("""
    WITH r AS (SELECT p_partkey, p_name, p_retailprice, rank() OVER (ORDER BY p_retailprice DESC) AS position FROM part WHERE p_retailprice IS NOT NULL)
    SELECT CAST(position AS BIGINT) AS position, p_partkey, p_name, p_retailprice FROM r WHERE position <= 5
""")
def q04_most_expensive_parts(t: Tables) -> DataFrame:
    top = R.top_with_ties(t.part.where("p_retailprice is not null"), "p_retailprice", 5)
    return R.order(top.select(lng("position").alias("position"), "p_partkey", "p_name", "p_retailprice"), "position", "p_name", "p_partkey")


@query("""
    WITH o AS (SELECT o_custkey, avg(o_totalprice) AS mean FROM orders GROUP BY o_custkey),
    d AS (SELECT c_custkey, c_name, round(abs(c_acctbal - mean), 9) AS divergence FROM customer JOIN o ON c_custkey = o_custkey WHERE c_acctbal > 0 AND (mean <> 0 OR c_nationkey > 0)),
    r AS (SELECT *, rank() OVER (ORDER BY divergence DESC) AS position FROM d)
    SELECT CAST(position AS BIGINT) AS position, c_custkey, c_name, round(divergence, 4) AS divergence FROM r WHERE position <= 10
""")
def q05_divergence_of_two_sources(t: Tables) -> DataFrame:
    mean = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    d = t.customer.join(mean, F.col("c_custkey") == F.col("o_custkey")).where("c_acctbal > 0 and (mean <> 0 or c_nationkey > 0)")
    top = R.top_with_ties(d.select("c_custkey", "c_name", F.round(F.abs(F.col("c_acctbal") - F.col("mean")), 9).alias("divergence")), "divergence", 10)
    return R.order(top.select(lng("position").alias("position"), "c_custkey", "c_name", F.round("divergence", 4).alias("divergence")), "position", "c_name", "c_custkey")


@query("SELECT year(o_orderdate) AS y, count(*) AS orders, round(avg(o_totalprice), 4) AS mean_price FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def q06_mean_per_year(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 0").groupBy(lng(F.year("o_orderdate")).alias("y")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("mean_price")).orderBy("y")


@query("""
    WITH w AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate BETWEEN TIMESTAMP '1993-06-15' AND TIMESTAMP '1998-06-15'),
    c AS (SELECT l_suppkey, count(*) AS parts FROM w GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY parts DESC) AS position FROM c)
    SELECT s_name, parts FROM r JOIN supplier ON l_suppkey = s_suppkey WHERE position = 1
""")
def q07_most_active_in_window(t: Tables) -> DataFrame:
    from datetime import date

    from tarnspark.functions.windows import rolling_window

    lo, hi = rolling_window(date(1998, 6, 15), 5)
    w = t.lineitem.where((F.col("l_linestatus") == "F") & F.col("l_shipdate").between(F.lit(str(lo)).cast("timestamp"), F.lit(str(hi)).cast("timestamp")))
    c = R.leaders(w.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts")), "parts")
    return c.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", "parts").orderBy("s_name")


@query("""
    WITH n AS (SELECT o_custkey, count(*) AS placed FROM orders GROUP BY 1 HAVING count(*) >= 5),
    m AS (SELECT n.o_custkey, placed, count(o.o_totalprice) AS priced, round(avg(o.o_totalprice), 4) AS mean FROM n LEFT JOIN orders o ON n.o_custkey = o.o_custkey AND o.o_totalprice > 100000 GROUP BY 1, 2),
    r AS (SELECT *, rank() OVER (ORDER BY mean DESC) AS position FROM m WHERE priced > 0)
    SELECT CAST(position AS BIGINT) AS position, c_name, mean, priced, placed FROM r JOIN customer ON o_custkey = c_custkey WHERE position <= 10
""")
def q08_having_and_filter_in_join(t: Tables) -> DataFrame:
    dear = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))  # the outer join's extra condition, in one pass over one shuffle
    m = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("placed"), F.count(dear).alias("priced"), F.round(F.avg(dear), 4).alias("mean")).where("placed >= 5 and priced > 0")
    top = R.top_with_ties(m, "mean", 10).join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return top.select(lng("position").alias("position"), "c_name", "mean", "priced", "placed").orderBy("position", "c_name")


_PAIRS = """
    WITH p AS (SELECT a.l_suppkey AS supplier, b.l_partkey AS part, count(*) AS together FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b USING (l_orderkey) GROUP BY 1, 2),
    r AS (SELECT *, rank() OVER (ORDER BY together DESC) AS position FROM p)
    SELECT supplier, part, together FROM r WHERE position = 1
"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    line = t.lineitem
    return line.select("l_orderkey", F.col("l_suppkey").alias("supplier")).distinct(), line.select("l_orderkey", F.col("l_partkey").alias("part")).distinct()


@query(_PAIRS)
def q09_top_pair(t: Tables) -> DataFrame:
    return R.leaders(R.pair_counts(*_sides(t), "l_orderkey", "supplier", "part", "together"), "together")


@query(_PAIRS)
def q09_top_pair_pruned(t: Tables) -> DataFrame:
    return R.leaders(R.pruned_pair_counts(*_sides(t), "l_orderkey", "supplier", "part", "together"), "together")


@query("SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9900 GROUP BY n_name")
def q10_zero_filled_counts(t: Tables) -> DataFrame:
    c = t.customer.where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return R.zero_filled(t.nation, c, "n_nationkey", "customers").select("n_name", "customers").orderBy(F.desc("customers"), "n_name")


@query("""
    WITH s AS (SELECT c_nationkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    r AS (SELECT *, rank() OVER (ORDER BY total DESC) AS position FROM s)
    SELECT n_name, CAST(total AS DOUBLE) AS total, orders FROM r JOIN nation ON c_nationkey = n_nationkey WHERE position = 1
""")
def q11_largest_sum(t: Tables) -> DataFrame:
    by = t.orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"), F.count(F.lit(1)).alias("n"))
    s = by.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("s").alias("total"), F.sum("n").alias("orders"))
    return R.leaders(s, "total").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.col("total").cast("double").alias("total"), "orders")


@query("""
    WITH m AS (SELECT p_brand, round(avg((l_extendedprice - l_quantity * p_retailprice) / l_extendedprice), 9) AS mean_margin, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 0 GROUP BY 1),
    r AS (SELECT *, rank() OVER (ORDER BY mean_margin DESC) AS position FROM m)
    SELECT p_brand, mean_margin, lines FROM r WHERE position = 1
""")
def q12_mean_of_ratios(t: Tables) -> DataFrame:
    j = t.lineitem.where("l_extendedprice > 0").select("l_partkey", "l_extendedprice", "l_quantity").join(t.part.select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    m = j.groupBy("p_brand").agg(F.round(F.avg((F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")) / F.col("l_extendedprice")), 9).alias("mean_margin"), F.count(F.lit(1)).alias("lines"))
    return R.leaders(m, "mean_margin")


@query("""
    WITH r AS (SELECT doc_id, n_chars, rank() OVER (ORDER BY n_chars DESC) AS position FROM documents WHERE n_chars > 0)
    SELECT CAST(position AS BIGINT) AS position, doc_id, source, r.n_chars FROM r JOIN documents USING (doc_id) WHERE position <= 10
""")
def q13_longest_documents(t: Tables) -> DataFrame:
    return R.top_with_ties(t.documents.where("n_chars > 0").select("doc_id", "source", "n_chars"), "n_chars", 10).select(lng("position").alias("position"), "doc_id", "source", "n_chars").orderBy("position", "doc_id")


@query("""
    WITH d AS (SELECT s_suppkey, s_name, round(abs(s_acctbal - m), 6) AS divergence FROM supplier JOIN (SELECT l_suppkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey WHERE s_acctbal IS NOT NULL AND m > 0),
    r AS (SELECT *, rank() OVER (ORDER BY divergence DESC) AS position FROM d)
    SELECT CAST(position AS BIGINT) AS position, s_name, round(divergence, 3) AS divergence FROM r WHERE position <= 10
""")
def q14_divergence_user_and_list(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("m")).where("m > 0")
    d = t.supplier.where("s_acctbal is not null").join(m, F.col("s_suppkey") == F.col("l_suppkey")).select("s_name", F.round(F.abs(F.col("s_acctbal") - F.col("m")), 6).alias("divergence"))
    return R.top_with_ties(d, "divergence", 10).select(lng("position").alias("position"), "s_name", F.round("divergence", 3).alias("divergence")).orderBy("position", "s_name")


@query("""
    WITH c AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13') GROUP BY 1),
    r AS (SELECT *, rank() OVER (ORDER BY orders DESC) AS position FROM c)
    SELECT s_name, orders FROM r JOIN supplier ON l_suppkey = s_suppkey WHERE position <= 5
""")
def f1_top_by_group_through_two_bridges(t: Tables) -> DataFrame:
    some = t.part.where("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("l_partkey"))
    c = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey").join(some, "l_partkey", "left_semi").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("orders"))
    return R.top_with_ties(c, "orders", 5).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", "orders").orderBy(F.desc("orders"), "s_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)")
def f2_rows_of_named_rows(t: Tables) -> DataFrame:
    who = t.customer.where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(who, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 0) AS DOUBLE) AS total FROM orders WHERE year(o_orderdate) = 1996 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def f3_scalar_sum(t: Tables) -> DataFrame:
    who = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    o = t.orders.where((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01"))  # a range reaches the scan, year() would not
    return o.join(who, "o_custkey", "left_semi").agg(F.coalesce(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("total"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-02-28' AND TIMESTAMP '1998-02-28'")
def f4_rolling_count(t: Tables) -> DataFrame:
    from datetime import date

    from tarnspark.functions.windows import rolling_window

    lo, hi = rolling_window(date(1998, 2, 28), 3)
    return t.orders.where(F.col("o_orderdate").between(F.lit(str(lo)).cast("timestamp"), F.lit(str(hi)).cast("timestamp"))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def f5_homonyms(t: Tables) -> DataFrame:
    first = t.part.agg(F.min("p_name").alias("m"))
    return t.part.join(F.broadcast(first), F.col("p_name") == F.col("m")).select("p_partkey", "p_name", "p_brand")  # one row by construction


# --- predicates and projection -----------------------------------------------------------------------


@query("SELECT 1 + 2 * 3 AS a, 'x' || 'y' AS b, -7 % 3 AS c, CAST(NULL AS INTEGER) AS d")
def p_constants(t: Tables) -> DataFrame:
    return t._at[0].sql("SELECT 1 + 2 * 3 AS a, 'x' || 'y' AS b, -7 % 3 AS c, CAST(NULL AS INT) AS d")


@query("SELECT count(*) AS n FROM lineitem")
def s_whole_table_count(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM nation")
def p_star(t: Tables) -> DataFrame:
    return t.nation


@query("""
    SELECT o_orderkey, o_orderstatus FROM orders
    WHERE (o_totalprice >= 200000 OR o_orderpriority <> '1-URGENT') AND NOT (o_orderstatus = 'O') AND o_totalprice BETWEEN 1000 AND 300000
      AND o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('5-LOW') AND o_custkey IS NOT NULL AND o_orderstatus IS DISTINCT FROM 'X'
""")
def p_predicates(t: Tables) -> DataFrame:
    o = t.orders
    keep = ((F.col("o_totalprice") >= 200000) | (F.col("o_orderpriority") != "1-URGENT")) & ~(F.col("o_orderstatus") == "O") & F.col("o_totalprice").between(1000, 300000)
    keep = keep & F.col("o_orderstatus").isin("F", "P") & ~F.col("o_orderpriority").isin("5-LOW") & F.col("o_custkey").isNotNull() & ~F.col("o_orderstatus").eqNullSafe("X")
    return o.where(keep).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%e%' AND p_type LIKE '%' AND NOT regexp_matches(p_name, '^[a-f].*$')")
def p_like_and_glob(t: Tables) -> DataFrame:
    return t.part.where(D.like("p_name", "%A%e%") & D.like("p_type", "%") & ~D.glob("p_name", "[a-f]*")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def p_case(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 150000, "high").when(F.col("o_totalprice") > 50000, "mid").otherwise("low").alias("band"))


@query("SELECT p_partkey, CAST(p_retailprice AS BIGINT) AS whole, TRY_CAST(p_brand AS INTEGER) AS no_number, CASE WHEN p_size - 10 = 0 THEN NULL ELSE round(p_retailprice / (p_size - 10), 6) END AS ratio FROM part WHERE abs(p_retailprice - floor(p_retailprice)) < 0.49")
def p_casts_and_division(t: Tables) -> DataFrame:
    p = t.part.where(F.abs(F.col("p_retailprice") - F.floor("p_retailprice")) < 0.49)
    return p.select("p_partkey", F.col("p_retailprice").cast("long").alias("whole"), F.col("p_brand").try_cast("int").alias("no_number"), F.round(D.divide(F.col("p_retailprice"), F.col("p_size") - 10), 6).alias("ratio"))


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
def p_exists(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
def p_scalar_subquery(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("_orders_scalar")
    return t._at[0].sql("SELECT o_orderkey FROM _orders_scalar WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM _orders_scalar)")


@query("""
    WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey, n FROM a WHERE n > 10)
    SELECT b.n, count(*) AS customers, max(x.m) AS largest FROM b JOIN (SELECT max(n) AS m FROM a) x ON true GROUP BY b.n
""")
def p_ctes_and_derived_tables(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("_orders_cte")
    return t._at[0].sql("""
        WITH a AS (SELECT o_custkey, count(*) AS n FROM _orders_cte GROUP BY 1), b AS (SELECT o_custkey, n FROM a WHERE n > 10)
        SELECT b.n, count(*) AS customers, max(x.m) AS largest FROM b JOIN (SELECT max(n) AS m FROM a) x ON true GROUP BY b.n
    """)


# --- joins -----------------------------------------------------------------------------------------


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j_left_outer(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return R.zero_filled(t.customer.select("c_custkey"), o, "c_custkey", "orders")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 200000)")
def j_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j_self_with_inequality(t: Tables) -> DataFrame:
    n = t.nation
    x, y = n.alias("x"), n.alias("y")
    return x.join(y, (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_nationkey") < F.col("y.n_nationkey"))).select(F.col("x.n_name").alias("a"), F.col("y.n_name").alias("b"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def j_cross(t: Tables) -> DataFrame:
    return t.region.crossJoin(t.nation).select("r_name", "n_name")  # the admitted comma join, on two tables of fixed size


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name > b.r_name")
def j_theta(t: Tables) -> DataFrame:
    x, y = t.region.alias("x"), t.region.alias("y")
    return x.join(y, F.col("x.r_name") > F.col("y.r_name")).select(F.col("x.r_name").alias("a"), F.col("y.r_name").alias("b"))


@query("SELECT coalesce(x.n_nationkey, y.s_nationkey) AS k, x.n_name, y.suppliers FROM (SELECT * FROM nation WHERE n_nationkey < 15) x FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_nationkey > 5 GROUP BY 1) y ON x.n_nationkey = y.s_nationkey")
def j_full_outer(t: Tables) -> DataFrame:
    y = t.supplier.where("s_nationkey > 5").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    x = t.nation.where("n_nationkey < 15")
    return x.join(y, F.col("n_nationkey") == F.col("s_nationkey"), "full").select(F.coalesce("n_nationkey", "s_nationkey").alias("k"), "n_name", "suppliers")


# --- aggregates --------------------------------------------------------------------------------------


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, count(*) FILTER (o_totalprice > 100000) AS dear FROM orders GROUP BY 1 HAVING count(*) > 1")
def a_grouped(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count_if(F.col("o_totalprice") > 100000).alias("dear")).where("n > 1")


@query("SELECT count(*) AS n, coalesce(sum(o_totalprice), 0.0) AS total, coalesce(max(o_custkey), 1) AS top, sum(o_totalprice) AS nothing FROM orders WHERE o_totalprice < 0")
def a_empty_input(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice < 0").agg(F.count(F.lit(1)).alias("n"), D.total("o_totalprice").alias("total"), F.coalesce(F.max("o_custkey"), F.lit(1).cast("long")).alias("top"), F.sum("o_totalprice").alias("nothing"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, count(DISTINCT n_name) AS n FROM nation GROUP BY 1")
def a_group_concat(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(D.group_concat("n_name", ", ").alias("names"), F.count_distinct("n_name").alias("n"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def a_distinct(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT sum(DISTINCT p_size) AS s FROM part")
def a_sum_distinct(t: Tables) -> DataFrame:
    return t.part.agg(F.sum_distinct("p_size").alias("s"))


@query("SELECT c_nationkey, any_value(n_name) AS n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def a_bare_column(t: Tables) -> DataFrame:
    by = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return by.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_nationkey", "n_name", "customers")


# --- windows -----------------------------------------------------------------------------------------

_RANKS = "OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)"


@query(f"""
    SELECT c_custkey, CAST(row_number() {_RANKS} AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS dr,
           round(percent_rank() {_RANKS}, 9) AS pr, round(cume_dist() {_RANKS}, 9) AS cd, CAST(ntile(4) {_RANKS} AS BIGINT) AS nt FROM customer
""")
def w_ranks(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    s = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    return t.customer.select("c_custkey", lng(F.row_number().over(w)).alias("rn"), lng(F.rank().over(s)).alias("rk"), lng(F.dense_rank().over(s)).alias("dr"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"), lng(F.ntile(4).over(w)).alias("nt"))


_BY = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT o_orderkey, lag(o_totalprice) {_BY} AS lag1, lead(o_totalprice, 2) {_BY} AS lead2, first_value(o_totalprice) {_BY} AS fv, last_value(o_totalprice) {_BY} AS lv, nth_value(o_totalprice, 2) {_BY} AS nv FROM orders")
def w_offsets(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = "o_totalprice"
    return t.orders.select("o_orderkey", F.lag(p).over(w).alias("lag1"), F.lead(p, 2).over(w).alias("lead2"), F.first(p).over(w).alias("fv"), F.last(p).over(w).alias("lv"), F.nth_value(p, 2).over(w).alias("nv"))


@query("""
    SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving,
           count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_custkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM orders
""")
def w_frames(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    g = Window.partitionBy("o_custkey")
    r = g.orderBy("o_custkey").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("moving"), F.count(F.lit(1)).over(g).alias("n"), F.max("o_totalprice").over(r).alias("top"))


# --- order, limit, sets ------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def o_limit_offset(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 1 OFFSET 9)")
def o_cutoff_value(t: Tables) -> DataFrame:
    cut = t.orders.select("o_totalprice").orderBy(F.desc("o_totalprice")).limit(10).agg(F.min("o_totalprice").alias("cut"))
    return t.orders.join(F.broadcast(cut), F.col("o_totalprice") >= F.col("cut")).select("o_orderkey", "o_totalprice")  # one row by construction


@query("SELECT p_partkey, p_size FROM (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size END AS p_size FROM part) ORDER BY p_size ASC NULLS FIRST, p_partkey LIMIT 30")
def o_null_order(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size")).alias("p_size")).orderBy("p_size", "p_partkey").limit(30)


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def u_union(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("name")).union(t.region.select("r_name")).distinct()


@query("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def u_union_all(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_regionkey").alias("k")).union(t.region.select("r_regionkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def u_except(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).subtract(t.customer.where("c_acctbal > 0").select("c_custkey"))


# --- scalar functions --------------------------------------------------------------------------------


@query("""
    SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS co, CASE WHEN p_size > 20 THEN 1 ELSE 0 END AS ii, length(p_name) AS len, lower(p_name) AS lo, upper(p_name) AS up,
           substr(p_name, 2, 3) AS su, p_name[1:2] AS zero, trim(p_name, 'abcdefgh') AS tr, ltrim(p_name, 'abcdefgh') AS lt, rtrim(p_name, 'abcdefgh') AS rt,
           replace(p_name, 'a', 'A') AS re, instr(p_name, 'e') AS pos, p_brand || '-' || p_type AS cc, concat_ws('/', p_brand, NULL, p_type) AS cw
    FROM part
""")
def fn_text(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select(
        "p_partkey", F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), F.lit("none")).alias("co"), D.iif(F.col("p_size") > 20, F.lit(1), F.lit(0)).alias("ii"), lng(F.length(n)).alias("len"), D.lower(n).alias("lo"), D.upper(n).alias("up"),
        D.substr(n, 2, 3).alias("su"), D.substr(n, 0, 3).alias("zero"), D.trim(n, "abcdefgh").alias("tr"), D.ltrim(n, "abcdefgh").alias("lt"), D.rtrim(n, "abcdefgh").alias("rt"),
        F.replace(n, F.lit("a"), F.lit("A")).alias("re"), lng(F.instr(n, "e")).alias("pos"), D.concat(F.col("p_brand"), F.lit("-"), F.col("p_type")).alias("cc"), F.concat_ws("/", "p_brand", F.lit(None), "p_type").alias("cw"),
    )


@query("""
    SELECT p_partkey, abs(p_size - 25) AS ab, round(p_retailprice / 3, 2) AS ro, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(floor(p_retailprice) AS BIGINT) AS fl, CAST(trunc(p_retailprice - 1000) AS BIGINT) AS tr,
           round(sqrt(p_retailprice), 9) AS sq, round(pow(p_size, 1.5), 6) AS po, round(exp(p_size / 50.0), 9) AS ex, round(ln(p_size), 9) AS ln_, round(log10(p_size), 9) AS l10, round(log2(p_size), 9) AS l2,
           round(log10(p_size), 9) AS lg, CAST(p_size % 7 AS DOUBLE) AS mo, CAST(sign(p_size - 25) AS BIGINT) AS sg, greatest(p_size, 10, 20) AS gr, least(p_size, 10, 20) AS le, CASE WHEN p_size < 25 THEN NULL ELSE round(sqrt(p_size - 25), 9) END AS sn
    FROM part WHERE p_size > 0
""")
def fn_numbers(t: Tables) -> DataFrame:
    s, p = F.col("p_size"), F.col("p_retailprice")
    r9 = lambda c: F.round(c, 9)
    return t.part.where("p_size > 0").select(
        "p_partkey", F.abs(s - 25).alias("ab"), F.round(p / 3, 2).alias("ro"), lng(F.ceil(p)).alias("ce"), lng(F.floor(p)).alias("fl"), lng(D.trunc(p - 1000)).alias("tr"),
        r9(D.sqrt(p)).alias("sq"), F.round(F.pow(s.cast("double"), F.lit(1.5)), 6).alias("po"), r9(F.exp(s / 50.0)).alias("ex"), r9(F.log(s)).alias("ln_"), r9(F.log10(s)).alias("l10"), r9(F.log2(s)).alias("l2"),
        r9(D.log(s)).alias("lg"), D.mod(s, F.lit(7)).alias("mo"), lng(F.sign(s - 25)).alias("sg"), D.scalar_max(s, F.lit(10), F.lit(20)).alias("gr"), D.scalar_min(s, F.lit(10), F.lit(20)).alias("le"), r9(D.sqrt(s - 25)).alias("sn"),
    )


@query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS ti, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt,
           round(epoch(o_orderdate) / 86400.0 + 2440587.5, 6) AS jd, strftime(o_orderdate, '%d/%m/%Y') AS f, CAST(epoch(o_orderdate) AS BIGINT) AS ue, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS plus,
           strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS som, CAST(dayofweek(o_orderdate) AS VARCHAR) AS w
    FROM orders
""")
def fn_dates(t: Tables) -> DataFrame:
    o = F.col("o_orderdate")
    return t.orders.select("o_orderkey", D.date(o).alias("d"), D.time(o).alias("ti"), D.datetime(o).alias("dt"), F.round(D.julianday(o), 6).alias("jd"), D.strftime("%d/%m/%Y", o).alias("f"), D.unixepoch(o).alias("ue"), D.date(o, "+10 days").alias("plus"), D.date(o, "start of month").alias("som"), D.strftime("%w", o).alias("w"))


@query("SELECT 'integer' AS a, 'real' AS b, 'text' AS c, 'null' AS d, CAST(NULL AS INTEGER) AS mx, coalesce(sum(CAST(n_nationkey AS DOUBLE)), 0.0) AS tot, CAST(NULL AS DOUBLE) AS neg, CAST(NULL AS DOUBLE) AS zero, 'abc' AS cc FROM nation WHERE n_nationkey < 0")
def fn_dialect_edges(t: Tables) -> DataFrame:
    one = t.nation.where("n_nationkey < 0").agg(D.total("n_nationkey").alias("tot"))
    return one.select(
        D.typeof(F.lit(1)).alias("a"), D.typeof(F.lit(1.5)).alias("b"), D.typeof(F.lit("x")).alias("c"), D.typeof(F.lit(None)).alias("d"),
        D.scalar_max(F.lit(1), F.lit(None).cast("int")).alias("mx"), "tot", D.sqrt(F.lit(-1.0)).alias("neg"), D.divide(F.lit(1.0), F.lit(0)).alias("zero"), D.concat(F.lit("a"), F.lit(None).cast("string"), F.lit("bc")).alias("cc"),
    )


# --- statements through the guard ----------------------------------------------------------------------


def guarded(name: str, statement: str, oracle: str) -> None:
    """Register a statement of the dialect, admitted and rewritten as any user's, with the same question in DuckDB's SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = harden(spark)
        for t in NAMES:
            load(own, sf_dir, t).createOrReplaceTempView(t)
        return SafeExecutor(own, Policy(tables=frozenset(NAMES), hidden=frozenset())).frame(statement)

    QUERIES[name], ORACLES[name] = run, oracle


guarded(
    "g_like_and_glob",
    "SELECT p_partkey, p_name LIKE '%RING' AS a, p_name NOT LIKE 'r_d%' AS b, p_name GLOB '[a-m]*r*' AS c, glob('*.*', p_name) AS d, like('BLUE%', p_name) AS e FROM part WHERE p_name GLOB '*[^t]' OR p_type LIKE 'e%'",
    "SELECT p_partkey, p_name ILIKE '%ring' AS a, p_name NOT ILIKE 'r_d%' AS b, p_name GLOB '[a-m]*r*' AS c, p_name GLOB '*.*' AS d, p_name ILIKE 'blue%' AS e FROM part WHERE regexp_full_match(p_name, '.*[^t]') OR p_type ILIKE 'e%'",
)
guarded(
    "g_division_and_casts",
    "SELECT p_partkey, p_size / 7 AS whole, p_size / 7.0 AS part, p_size / (p_size - 10) AS by_zero, p_size % 7 AS m, mod(p_size, 0) AS none, CAST(p_name AS REAL) AS no_number, CAST(p_retailprice AS INTEGER) AS i, CAST(substr(p_brand, 7) AS INTEGER) AS brand, '10' = 10 AS same FROM part",
    "SELECT p_partkey, CAST(p_size // 7 AS DOUBLE) AS whole, p_size / 7.0 AS part, CASE WHEN p_size <> 10 THEN CAST(trunc(p_size / (p_size - 10)) AS DOUBLE) END AS by_zero, CAST(p_size % 7 AS BIGINT) AS m, CAST(NULL AS DOUBLE) AS none, 0.0::DOUBLE AS no_number, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(substr(p_brand, 7) AS BIGINT) AS brand, false AS same FROM part",
)
guarded(
    "g_text_functions",
    "SELECT p_partkey, lower(p_brand) AS lo, upper(p_name) AS up, substr(p_name, 0, 3) AS zero, substr(p_name, -3) AS last, substring(p_name, 3, -2) AS back, ltrim(p_name, 'abcdefgh') AS lt, rtrim(p_name, 'abcdefgh') AS rt, trim(p_name, 'rg') AS tr, typeof(p_size) AS ty, typeof(p_name) AS tt, concat(p_brand, NULL, '/', p_size) AS cc, instr(p_name, 'e') AS pos, replace(p_name, 'e', '3') AS re, length(p_name) AS n, iif(p_size > 20, 'big', 'small') AS ii FROM part",
    "SELECT p_partkey, lower(p_brand) AS lo, upper(p_name) AS up, p_name[1:2] AS zero, p_name[-3:] AS last, p_name[1:2] AS back, ltrim(p_name, 'abcdefgh') AS lt, rtrim(p_name, 'abcdefgh') AS rt, trim(p_name, 'rg') AS tr, 'integer' AS ty, 'text' AS tt, p_brand || '/' || p_size AS cc, CAST(instr(p_name, 'e') AS INTEGER) AS pos, replace(p_name, 'e', '3') AS re, CAST(length(p_name) AS INTEGER) AS n, CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END AS ii FROM part",
)
guarded(
    "g_number_functions",
    "SELECT p_partkey, round(log(p_retailprice), 9) AS l, round(log(2, p_retailprice), 9) AS l2, sqrt(p_size - 25) IS NULL AS neg, trunc(p_retailprice - 1000) AS tr, max(p_size, 10, 20) AS gr, min(p_size, 10, NULL) AS le, sign(p_size - 25) AS sg, round(p_retailprice, 1) AS ro, ceil(p_retailprice) AS ce, floor(p_retailprice) AS fl FROM part WHERE p_retailprice > 0",
    "SELECT p_partkey, round(log10(p_retailprice), 9) AS l, round(ln(p_retailprice) / ln(2), 9) AS l2, p_size < 25 AS neg, CAST(trunc(p_retailprice - 1000) AS BIGINT) AS tr, greatest(p_size, 10, 20) AS gr, CAST(NULL AS INTEGER) AS le, CAST(sign(p_size - 25) AS INTEGER) AS sg, round(p_retailprice, 1) AS ro, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(floor(p_retailprice) AS BIGINT) AS fl FROM part WHERE p_retailprice > 0",
)
guarded(
    "g_dates",
    "SELECT o_orderkey, date(o_orderdate) AS d, time(o_orderdate, '+90 minutes') AS ti, datetime(o_orderdate, 'start of month') AS som, date(o_orderdate, '+1 month') AS next, date(o_orderdate, 'weekday 0') AS sunday, strftime('%d/%m/%Y', o_orderdate) AS f, strftime('%w', o_orderdate) AS w, unixepoch(o_orderdate) AS ue, round(julianday(o_orderdate), 6) AS jd, date('nonsense') AS nil FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 90 MINUTE, '%H:%M:%S') AS ti, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d 00:00:00') AS som, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + (o_orderdate - date_trunc('month', o_orderdate)), '%Y-%m-%d') AS next, strftime(o_orderdate + to_days(CAST((7 - dayofweek(o_orderdate)) % 7 AS INTEGER)), '%Y-%m-%d') AS sunday, strftime(o_orderdate, '%d/%m/%Y') AS f, CAST(dayofweek(o_orderdate) AS VARCHAR) AS w, CAST(epoch(o_orderdate) AS BIGINT) AS ue, round(epoch(o_orderdate) / 86400.0 + 2440587.5, 6) AS jd, CAST(NULL AS VARCHAR) AS nil FROM orders",
)
guarded(
    "g_aggregates",
    "SELECT p_brand, group_concat(DISTINCT p_type) AS types, group_concat(p_name, '; ') FILTER (WHERE p_size > 45) AS names, total(p_size) AS t, total(p_size) FILTER (WHERE p_size < 0) AS nothing, string_agg(p_type, '+') AS every FROM part GROUP BY p_brand HAVING count(*) / 2 > 3",
    "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, string_agg(p_name, '; ' ORDER BY p_name) FILTER (p_size > 45) AS names, CAST(sum(p_size) AS DOUBLE) AS t, 0.0::DOUBLE AS nothing, string_agg(p_type, '+' ORDER BY p_type) AS every FROM part GROUP BY p_brand HAVING count(*) // 2 > 3",
)
guarded(
    "g_in_table_and_brackets",
    "WITH rich AS (SELECT c_custkey FROM customer WHERE c_acctbal > 5000), w AS (SELECT [o_orderkey], [o_custkey] AS [the customer] FROM [orders] WHERE o_custkey IN rich AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'building')) SELECT [the customer] AS c, count(*) AS n FROM w GROUP BY [the customer]",
    "SELECT o_custkey AS c, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING' GROUP BY 1",
)
guarded(
    "g_windows",
    "SELECT n_nationkey, group_concat(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS names, total(n_nationkey) OVER (PARTITION BY n_regionkey) AS t, sum(n_nationkey / 2) OVER (ORDER BY n_nationkey) AS halves FROM nation",
    "SELECT n_nationkey, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS names, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey) AS DOUBLE) AS t, CAST(sum(n_nationkey // 2) OVER (ORDER BY n_nationkey) AS DOUBLE) AS halves FROM nation",
)


# --- names -------------------------------------------------------------------------------------------


def lookups(t: Tables, asked: dict[str, list[str]]) -> DataFrame:
    """kind, asked, state, total, place, id, label, via, edits of lookups by name over parts, customers and nations."""
    frames = {"part": t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), "customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")), "nation": t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))}
    index, out = EntityIndex(None, frames), []
    for kind, names in asked.items():
        for name in names:
            m = index.find(kind, name)
            out += [(kind, name, m.state, m.total_matches, i, c.key, c.label, c.matched_via, c.edits) for i, c in enumerate(m.candidates, 1)] or [(kind, name, m.state, 0, 0, None, None, m.reason, None)]
    return t._at[0].createDataFrame(out, "kind string, asked string, state string, total int, place int, id string, label string, via string, edits int")


_NAMES = """
    WITH names AS (SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS label FROM part UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation),
    keyed AS (SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS key FROM names), tokens AS (SELECT DISTINCT kind, key, unnest(string_split(key, ' ')) AS token FROM keyed),
    asked AS (SELECT kind, asked, trim(regexp_replace(lower(asked), '[^a-z0-9]+', ' ', 'g')) AS akey FROM (VALUES {}) a(kind, asked))
"""


@query(_NAMES.format("('nation', 'nation 3'), ('customer', 'CUSTOMER  000000007'), ('part', 'Red Widget')") + """
    , m AS (SELECT a.kind, asked, id, label, count(*) OVER (PARTITION BY a.kind, asked) AS total, row_number() OVER (PARTITION BY a.kind, asked ORDER BY label, id) AS place FROM asked a JOIN keyed k ON a.kind = k.kind AND akey = key)
    SELECT kind, asked, CASE WHEN total = 1 THEN 'exact_unique' ELSE 'exact_multiple' END AS state, CAST(total AS INTEGER) AS total, CAST(place AS INTEGER) AS place, id, label, 'exact' AS via, CAST(NULL AS INTEGER) AS edits FROM m WHERE place <= 10
""")
def e_exact_names(t: Tables) -> DataFrame:
    return lookups(t, {"nation": ["nation 3"], "customer": ["CUSTOMER  000000007"], "part": ["Red Widget"]})


@query(_NAMES.format("('nation', 'Nation'), ('part', 'widget'), ('part', 'sma rin')") + """
    , h AS (
        SELECT a.kind, asked, k.key, akey, len(list_distinct(string_split(k.key, ' '))) - len(list_distinct(string_split(akey, ' '))) AS extra,
               CASE WHEN starts_with(k.key, akey) THEN 0
                    WHEN len(list_filter(string_split(akey, ' '), lambda q: NOT list_contains(string_split(k.key, ' '), q))) = 0 THEN 1
                    WHEN len(list_filter(string_split(akey, ' '), lambda q: len(list_filter(string_split(k.key, ' '), lambda w: starts_with(w, q))) = 0)) = 0 THEN 2 END AS cls
        FROM asked a JOIN (SELECT DISTINCT kind, key FROM keyed) k ON a.kind = k.kind),
    m AS (SELECT h.kind, asked, id, label, cls, count(*) OVER (PARTITION BY h.kind, asked) AS total, row_number() OVER (PARTITION BY h.kind, asked ORDER BY cls, extra, length(h.key), h.key, label, id) AS place FROM h JOIN keyed k ON h.kind = k.kind AND h.key = k.key WHERE cls IS NOT NULL)
    SELECT kind, asked, 'partial_candidates' AS state, CAST(total AS INTEGER) AS total, CAST(place AS INTEGER) AS place, id, label, CASE WHEN cls = 0 THEN 'prefix' ELSE 'tokens' END AS via, CAST(NULL AS INTEGER) AS edits FROM m WHERE place <= 10
""")
def e_partial_names(t: Tables) -> DataFrame:
    return lookups(t, {"nation": ["Nation"], "part": ["widget", "sma rin"]})


@query(_NAMES.format("('part', 'smal rnig'), ('part', 'blue botl'), ('nation', 'natoin 4'), ('nation', 'zzzzzz')") + """
    , w AS (
        SELECT a.kind, asked, q, token, CASE WHEN length(q) < 3 THEN CASE WHEN token = q THEN 0 END ELSE damerau_levenshtein(token, q) END AS e
        FROM (SELECT kind, asked, unnest(list_distinct(string_split(akey, ' '))) AS q FROM asked) a JOIN (SELECT DISTINCT kind, token FROM tokens) v ON a.kind = v.kind
        WHERE length(q) < 3 OR left(token, 1) = left(q, 1) OR right(token, 1) = right(q, 1)),
    n AS (SELECT * FROM w WHERE e <= CASE WHEN length(q) <= 5 THEN 1 ELSE 2 END),
    s AS (SELECT n.kind, asked, key, q, min(e) AS e FROM n JOIN tokens t ON n.kind = t.kind AND n.token = t.token GROUP BY ALL),
    g AS (SELECT s.kind, s.asked, key, sum(e) AS edits, count(*) FILTER (e = 0) AS same, len(list_distinct(string_split(key, ' '))) - count(*) AS extra FROM s JOIN asked a ON s.kind = a.kind AND s.asked = a.asked GROUP BY s.kind, s.asked, key, akey HAVING count(*) = len(list_distinct(string_split(akey, ' ')))),
    m AS (SELECT g.kind, asked, id, label, edits, count(*) OVER (PARTITION BY g.kind, asked) AS total, row_number() OVER (PARTITION BY g.kind, asked ORDER BY edits, -same, extra, length(g.key), g.key, label, id) AS place FROM g JOIN keyed k ON g.kind = k.kind AND g.key = k.key)
    SELECT kind, asked, 'fuzzy_suggestions' AS state, CAST(total AS INTEGER) AS total, CAST(place AS INTEGER) AS place, id, label, 'fuzzy' AS via, CAST(edits AS INTEGER) AS edits FROM m WHERE place <= 10
    UNION ALL SELECT kind, asked, 'none', 0, 0, NULL, NULL, 'no_match', NULL FROM asked WHERE (kind, asked) NOT IN (SELECT (kind, asked) FROM m)
""")
def e_fuzzy_names(t: Tables) -> DataFrame:
    return lookups(t, {"part": ["smal rnig", "blue botl"], "nation": ["natoin 4", "zzzzzz"]})
