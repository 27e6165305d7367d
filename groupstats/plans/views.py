"""Entry and slot views over the test tables."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groupstats.skew import Heavy, find_heavy, number_sorted, split_heavy

GROUP = "l_orderkey"
ENTRY = "entry_id"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Double cut to ``digits`` decimals: sums depend on the order of their terms."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column * 10.0**digits + 0.5) / 10.0**digits


def heavy_orders(spark: SparkSession, folder: str) -> Heavy:
    """Heavy order keys, counted on ``lineitem`` alone, before any join."""
    return find_heavy(table(spark, folder, "lineitem"), GROUP)


def entries(spark: SparkSession, folder: str, orders: bool = False, parts: bool = False) -> DataFrame:
    """One row per line of an order, in the role of an entry in a group.

    Orders are joined last, on the group key, so that group windows and
    aggregations find the rows already partitioned.
    """
    df = table(spark, folder, "lineitem")
    if parts:
        part = table(spark, folder, "part")
        df = df.join(part, df.l_partkey == part.p_partkey)
    if orders:
        order = table(spark, folder, "orders")
        df = df.join(order, df.l_orderkey == order.o_orderkey)
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    ticks = F.col("l_quantity").cast("int") * 7 + F.col("l_linenumber") * 3
    win = F.when(F.col("l_discount") >= 0.08, F.col("l_extendedprice") * F.col("l_discount"))
    place = F.when(F.col("l_discount") >= 0.05, F.col("l_extendedprice") * F.col("l_tax"))
    added = {
        ENTRY: F.concat_ws(
            "-", GROUP, "l_linenumber", "l_partkey", "l_suppkey", cents,
            F.unix_date(F.col("l_shipdate").cast("date")),
        ),
        "time": F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_extendedprice")),
        "odds": F.nullif(F.col("l_quantity"), F.lit(30)) - 2,
        "finish": F.col("l_linenumber"),
        "pay_win": win,
        "pay_place": place,
        "is_win": win.isNotNull().cast("int"),
        "is_place": place.isNotNull().cast("int"),
        "pred": F.when(F.col("l_tax") != 0.08, (ticks % 50) / 50),
        "score": (ticks % 97) / 97,
        "qty_n": F.nullif(F.col("l_quantity"), F.lit(10)),
        "price_n": F.when(F.col("l_discount") != 0.03, F.col("l_extendedprice")),
        "flag_n": F.nullif(F.col("l_returnflag"), F.lit("R")),
    }
    if parts:
        added["distance"] = F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
        added["brand_n"] = F.nullif(F.col("p_brand"), F.lit("Brand#3"))
    if orders:
        added["year"] = F.year("o_orderdate")
        added["month"] = F.month("o_orderdate")
    return df.withColumns(added)


SLOT_FIELDS = [
    "FinishingTime", "Distance", "OrderOfFinish", "HeadCount", "Weight", "TimeDelta", "Pass1", "Pass2",
    "Pass3", "Pass4", "Discipline", "FieldStatus", "CourseCode", "RaceID", "RegisterdDate",
]


def _slot_fields() -> dict[str, Column]:
    e = F.col("event_id")
    return {
        "FinishingTime": F.col("value"),
        "Distance": (1000 + 200 * (e % 8)).cast("double"),
        "OrderOfFinish": (e % 7).cast("double"),
        "HeadCount": (e % 4).cast("double"),
        "Weight": F.nullif(F.col("value") * 10, F.lit(0)),
        "TimeDelta": F.col("value") - 5,
        "Pass1": (e % 2).cast("double"),
        "Pass2": F.nullif((e % 3).cast("double"), F.lit(1)),
        "Pass3": (e % 5).cast("double"),
        "Pass4": (e % 11).cast("double"),
        "Discipline": F.col("event_type"),
        "FieldStatus": F.substring("event_type", 1, 1),
        "CourseCode": F.concat((e % 3).cast("string"), F.lit("s")),
        "RaceID": F.when(e % 13 != 0, F.concat(F.lit("r"), e.cast("string"))),
        "RegisterdDate": F.when(e % 11 == 0, F.lit("unknown")).otherwise(
            F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("s"))
        ),
    }


def slots(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the fields of the three earlier events of the same user."""
    events = table(spark, folder, "events")
    heavy = find_heavy(events, "user_id")
    fields = _slot_fields()
    rows = events.select(
        "event_id", "user_id", "ts", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("_now")
    )
    order = [F.col("ts").asc(), F.col("event_id").asc()]
    window = Window.partitionBy("user_id").orderBy(*order)

    def windowed(part: DataFrame) -> DataFrame:
        return part.select("*", *[F.lag("_now", i).over(window).alias(f"_pre{i}") for i in (1, 2, 3)])

    if heavy.rows is None:
        df = windowed(rows)
    else:
        large, rest = split_heavy(rows, heavy)
        df = windowed(rest).unionByName(_numbered_slots(large, order))
    now = [F.col(f"_now.{n}").alias(n) for n in SLOT_FIELDS]
    past = [F.col(f"_pre{i}.{n}").alias(f"pre{i}_{n}") for i in (1, 2, 3) for n in SLOT_FIELDS]
    return df.select("event_id", "user_id", *now, *past)


def _numbered_slots(df: DataFrame, order: list[Column]) -> DataFrame:
    """Earlier rows of heavy users: every row is sent to itself and its three successors."""
    placed = number_sorted(df, ["user_id"], order, "_pos")
    sent = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_back"))
    sent = sent.withColumn("_pos", F.col("_pos") + F.col("_back"))

    def at(back: int, c: str) -> Column:
        return F.first(F.when(F.col("_back") == back, F.col(c)), ignorenulls=True)

    met = sent.groupBy("user_id", "_pos").agg(
        at(0, "event_id").alias("event_id"), at(0, "ts").alias("ts"), at(0, "_now").alias("_now"),
        *[at(i, "_now").alias(f"_pre{i}") for i in (1, 2, 3)],
    )
    return met.filter(F.col("event_id").isNotNull()).select(
        "event_id", "user_id", "ts", "_now", "_pre1", "_pre2", "_pre3"
    )


def careers(spark: SparkSession, folder: str) -> DataFrame:
    """Per-customer order counts in the role of career counts.

    Order status stands for the family and priority for first, second, third
    and lose. Family ``Dist`` lacks its lose count.
    """
    orders = table(spark, folder, "orders")
    families = {"Jra": "F", "Inter": "O", "Other": "P"}
    places = {"First": "1", "Second": "2", "Third": "3", "Lose": "4"}
    priority = F.substring("o_orderpriority", 1, 1)
    counts = [
        F.count_if((F.col("o_orderstatus") == status) & (priority == digit)).alias(f"ei_{family}{place}")
        for family, status in families.items()
        for place, digit in places.items()
    ]
    dist = [
        F.count_if(priority == places[p]).alias(f"ei_Dist{p}") for p in ("First", "Second", "Third")
    ]
    return orders.groupBy("o_custkey").agg(*counts, *dist)


