"""Sales lines assembled from order facts and their dimensions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import finer, hundredths, money, net_units, sum_units

SALES_SCHEMA = T.StructType([
    T.StructField("ds", T.DateType()),
    T.StructField("nation_key", T.IntegerType()),
    T.StructField("region_key", T.IntegerType()),
    T.StructField("brand", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("customer_key", T.LongType()),
    T.StructField("order_key", T.LongType()),
    T.StructField("qty", T.DoubleType()),
    T.StructField("gross", T.DecimalType(18, 2)),
    T.StructField("discount", T.DecimalType(18, 2)),
    T.StructField("returned", T.BooleanType()),
])

CUSTOMER_COLUMNS = ("nation_key", "region_key", "segment")
LINE_COLUMNS = ("brand",)


@dataclass(frozen=True)
class SalesTables:
    """The source tables, as files or as (bucketed) catalog tables."""

    lineitem: DataFrame
    orders: DataFrame
    customer: DataFrame
    part: DataFrame
    nation: DataFrame
    region: DataFrame


def read_tables(spark: SparkSession, path: str) -> SalesTables:
    """Parquet tables in one folder, one file or folder per table."""
    return SalesTables(**{
        name: spark.read.parquet(f"{path}/{name}.parquet")
        for name in SalesTables.__dataclass_fields__
    })


def order_side(tables: SalesTables, columns, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """One row per order with its date, customer and customer's place.

    Only the dimensions that ``columns`` asks for are joined, and here rather
    than on the lines, so that the larger table is shuffled once. The date range
    ``since <= date < until`` is tested on the raw column to reach the scan.
    """
    wanted = set(columns)
    orders = tables.orders
    if since is not None:
        orders = orders.filter(F.col("o_orderdate") >= since.cast("timestamp_ntz"))
    if until is not None:
        orders = orders.filter(F.col("o_orderdate") < until.cast("timestamp_ntz"))
    orders = orders.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderdate").cast("date").alias("ds"),
        F.col("o_custkey").alias("customer_key"),
    )
    if wanted & set(CUSTOMER_COLUMNS):
        customer = tables.customer.select(
            F.col("c_custkey").alias("customer_key"),
            F.col("c_nationkey").alias("nation_key"),
            F.col("c_mktsegment").alias("segment"),
        )
        if "region_key" in wanted:
            nation = tables.nation.select(
                F.col("n_nationkey").alias("nation_key"), F.col("n_regionkey").alias("region_key")
            )
            customer = customer.join(nation, "nation_key", "left")
        orders = orders.join(customer, "customer_key", "left")
    kept = [c for c in ("order_key", "ds", "customer_key", *CUSTOMER_COLUMNS)
            if c in wanted or c in ("order_key", "ds")]
    return orders.select(*kept)


def _with_brand(lines: DataFrame, tables: SalesTables, columns) -> DataFrame:
    if "brand" in set(columns):
        part = tables.part.select(F.col("p_partkey").alias("part_key"), F.col("p_brand").alias("brand"))
        lines = lines.join(part, "part_key", "left")
    return lines.drop("part_key")


def _raw_lines(tables: SalesTables, exclude_returns: bool) -> DataFrame:
    return tables.lineitem.filter(F.col("l_returnflag") != "R") if exclude_returns else tables.lineitem


def line_side(tables: SalesTables, columns, exclude_returns: bool = False) -> DataFrame:
    """One row per line with exact prices, and the brand only if asked for."""
    lines = _raw_lines(tables, exclude_returns).select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_quantity").alias("qty"),
        money("l_extendedprice").alias("gross"),
        money("l_discount").alias("discount"),
        (F.col("l_returnflag") == "R").alias("returned"),
    )
    return _with_brand(lines, tables, columns)


def order_amounts(tables: SalesTables, keys=(), exclude_returns: bool = False) -> DataFrame:
    """Lines added up per order and ``keys`` (brand, or none).

    ``net`` is in ten-thousandths; ``units`` and ``discounts`` are in hundredths;
    ``lines`` counts the lines.
    """
    raw = _raw_lines(tables, exclude_returns)
    lines = raw.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_partkey").alias("part_key"),
        hundredths("l_quantity").alias("units"),
        hundredths("l_extendedprice").alias("gross"),
        hundredths("l_discount").alias("discount"),
    )
    return _with_brand(lines, tables, keys).groupBy("order_key", *keys).agg(
        sum_units(net_units(F.col("gross"), F.col("discount"))).alias("net"),
        F.sum("units").alias("units"),
        F.sum("discount").alias("discounts"),
        F.count("discount").alias("lines"),
    )


def sales_lines(tables: SalesTables, exclude_returns: bool = False, columns=None,
                since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The ``sales`` table from already opened source tables."""
    columns = list(columns or SALES_SCHEMA.fieldNames())
    lines = line_side(tables, columns, exclude_returns)
    return lines.join(order_side(tables, columns, since, until), "order_key").select(*columns)


def load_sales(spark: SparkSession, path: str, exclude_returns: bool = False, columns=None,
               since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Read ``sales``, one row per sold line.

    Lines need their order; missing dimension rows leave nulls, so asking for
    fewer ``columns`` drops joins without dropping rows. No side is forced into a
    broadcast: Spark broadcasts what it finds small enough and shuffles the rest.
    """
    return sales_lines(read_tables(spark, path), exclude_returns, columns, since, until)


def _nulls(df: DataFrame, table: str, names) -> list[Column]:
    return [F.count_if(F.col(n).isNull()).alias(f"null_{table}_{n}") for n in names]


def _as_rows(df: DataFrame) -> DataFrame:
    """Turn a one-row frame of counts into ``check, n`` rows."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("n")) for c in df.columns
    ])).alias("r")).select("r.check", "r.n")


# Links between tables: child table and key, parent table and key, and the names of the two defects.
LINKS = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey", "lines_without_order", "orders_without_lines"),
    ("orders", "o_custkey", "customer", "c_custkey", "orders_without_customer", "customers_without_orders"),
    ("lineitem", "l_partkey", "part", "p_partkey", "lines_without_part", "parts_without_lines"),
    ("customer", "c_nationkey", "nation", "n_nationkey", "customers_without_nation", "nations_without_customers"),
    ("nation", "n_regionkey", "region", "r_regionkey", "nations_without_region", "regions_without_nations"),
)


def _broken_links(tables: SalesTables) -> DataFrame:
    """Rows without a parent and parents without rows, for all links in one pass over each table.

    Every row gives a tagged key for each link that its table takes part in, and keys are counted by tag and
    side. Counts are combined before the shuffle, so a key that holds a large share of the rows is one row per
    task. A null key meets no other.
    """
    entries = []
    for name in SalesTables.__dataclass_fields__:
        tags = [(i, many_key, 1, 0) for i, (many, many_key, *_) in enumerate(LINKS) if many == name]
        tags += [(i, one_key, 0, 1) for i, (_, _, one, one_key, *_) in enumerate(LINKS) if one == name]
        keys = F.array(*[F.struct(
            F.lit(i).alias("link"), F.col(key).cast("bigint").alias("k"), F.lit(child).cast("bigint").alias("children"),
            F.lit(parent).cast("bigint").alias("parents")) for i, key, child, parent in tags])
        entries.append(getattr(tables, name).select(F.explode(keys).alias("e")).select("e.*"))
    counted = reduce(DataFrame.unionByName, entries).groupBy("link", "k").agg(
        F.sum("children").alias("children"), F.sum("parents").alias("parents"))

    def left_over(link: int, own: str, other: str) -> Column:
        alone = (F.col("link") == link) & (F.col("k").isNull() | (F.col(other) == 0))
        return F.coalesce(F.sum(F.when(alone, F.col(own))), F.lit(0))

    return _as_rows(counted.agg(*[
        total for i, (*_, orphan, childless) in enumerate(LINKS)
        for total in (left_over(i, "children", "parents").alias(orphan), left_over(i, "parents", "children").alias(childless))]))


def _order_defects(orders: DataFrame) -> DataFrame:
    """Nulls, and the orders of a last month that is not whole, through counts by month."""
    day = F.col("o_orderdate").cast("date")
    months = orders.groupBy(F.trunc(day, "MM").alias("m")).agg(
        F.count("*").alias("n"), F.max(day).alias("last"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_orders_{c}") for c in ("o_orderkey", "o_custkey", "o_orderdate")])
    last = F.max("last")
    return _as_rows(months.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in months.columns if c.startswith("null_")],
        F.when(last < F.last_day(last), F.max_by("n", "m")).otherwise(0).alias("orders_in_partial_last_month")))


def sales_quality(tables: SalesTables) -> DataFrame:
    """Counts of defects in the source tables as rows of ``check, n``.

    Lines and orders are read twice each, once for their own defects and once for the links, other tables once.
    """
    lines = _as_rows(tables.lineitem.agg(
        *_nulls(tables.lineitem, "lineitem", ["l_orderkey", "l_partkey", "l_extendedprice", "l_discount"]),
        F.count_if(F.col("l_extendedprice") <= 0).alias("nonpositive_price"),
        F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 1)).alias("discount_out_of_range"),
        *[F.count_if(finer(f"l_{c}")).alias(f"finer_{c}") for c in ("quantity", "extendedprice", "discount")],
    ))
    return lines.unionByName(_order_defects(tables.orders)).unionByName(_broken_links(tables))
