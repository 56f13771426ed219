"""Revenue and prices by product category.

Items outnumber everything else, and one product may hold a large part of them. The operators that
need totals first add up items per product, where each task combines its rows before the shuffle,
and only then look up the category. Operators that return item rows attach what they need to the
product table and join the items to it once; no item row is ever shuffled by category.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartsight.functions import amount, joined_limbs, limb_names, limb_sums, limbs, merged_limbs
from cartsight.operators.joins import lookup_by_group
from cartsight.operators.ranking import top_k, top_ranks

CATEGORY = "product_category_name"
ENGLISH = "product_category_name_english"
# One over the last place of an amount.
_UNITS = Decimal(10**10)


def _sales_by_product(items: DataFrame) -> DataFrame:
    """Per product: items sold, items with a price, and the limbs of what they cost."""
    return items.groupBy("product_id").agg(
        F.count("order_id").alias("sold"),
        F.count(limbs("price")[0]).alias("priced"),
        *limb_sums("price", "amount"),
    )


def _amount() -> Column:
    """Aggregate: the sum of the limbs of :func:`_sales_by_product`."""
    return joined_limbs(merged_limbs("amount"))


def _sales_by_category(items: DataFrame, products: DataFrame) -> DataFrame:
    return (
        _sales_by_product(items)
        .join(products.select("product_id", CATEGORY), "product_id")
        .groupBy(CATEGORY)
        .agg(
            F.sum("sold").alias("sold"),
            F.sum("priced").alias("priced"),
            *merged_limbs("amount"),
        )
    )


def revenue_by_category(
    items: DataFrame, products: DataFrame, translation: DataFrame, k: int = 10
) -> DataFrame:
    """The ``k`` categories with the highest revenue, by translated name."""
    revenue = (
        _sales_by_category(items, products)
        .join(translation.select(CATEGORY, ENGLISH), CATEGORY)
        .groupBy(ENGLISH)
        .agg(
            F.sum("sold").alias("NumberOfItemsSold"),
            F.round(_amount().cast("double"), 2).alias("TotalRevenue"),
        )
    )
    return top_k(revenue, "TotalRevenue", k, tiebreak=ENGLISH)


def _mean_price(
    items: DataFrame, products: DataFrame, translation: DataFrame, names: Sequence[str]
) -> DataFrame:
    wanted = translation.where(F.col(ENGLISH).isin(*names)).select(CATEGORY, ENGLISH)
    known = products.select("product_id", CATEGORY)
    chosen = lookup_by_group(known, wanted, CATEGORY, spread_by="product_id")
    return (
        _sales_by_product(items)
        .join(chosen.select("product_id", ENGLISH), "product_id")
        .groupBy(ENGLISH)
        .agg(
            F.try_divide(_amount().cast("double"), F.sum("sold")).alias("mean_price")
        )
    )


def category_average_price(
    items: DataFrame, products: DataFrame, translation: DataFrame, names: Sequence[str]
) -> DataFrame:
    """Revenue per item sold in the named categories."""
    return _mean_price(items, products, translation, names).select(
        ENGLISH, F.round("mean_price", 2).alias("AvgPricePerItem")
    )


def category_price_gap(
    items: DataFrame, products: DataFrame, translation: DataFrame, dear: str, cheap: str
) -> DataFrame:
    """How many times the mean price of ``cheap`` the mean price of ``dear`` is, to 4 places."""
    prices = _mean_price(items, products, translation, [dear, cheap])

    def price_of(name: str):
        return F.max(F.when(F.col(ENGLISH) == name, F.col("mean_price")))

    return prices.agg(F.round(F.try_divide(price_of(dear), price_of(cheap)), 4).alias("price_gap"))


def _mean_units(total: Column, count: Column) -> Column:
    return ((total * _UNITS).cast("decimal(38,0)") / count).alias("mean_units")


def _dearer(price: str) -> Column:
    """Whether ``price`` is above ``mean_units``, exactly; decimals are made for close calls only."""
    mean = F.col("mean_units").cast("double") / float(_UNITS)
    above, close = F.col(price) - mean, F.abs(mean) * 1e-9 + 1e-9
    exact = (amount(price) * _UNITS).cast("decimal(38,0)") > F.col("mean_units")
    known = F.when(above > close, True).when(above < -close, False).otherwise(exact)
    return F.when(limbs(price)[0].isNotNull(), known)


def above_category_average(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items that cost more than the mean price of their own category.

    Both are compared in units of the tenth decimal place, the mean with six more places. Items
    without a category have no mean to compare with and drop out.
    """
    total = joined_limbs([F.col(c) for c in limb_names("amount")])
    mean_units = _mean_units(total, F.col("priced"))
    means = (
        _sales_by_category(items, products)
        .where(F.col(CATEGORY).isNotNull() & (F.col("priced") > 0))
        .select(CATEGORY, mean_units.alias("mean_units"))
    )
    known = products.select("product_id", CATEGORY)
    lookup = lookup_by_group(known, means, CATEGORY, spread_by="product_id")
    return (
        items.select("order_id", "product_id", "price")
        .join(lookup, "product_id")
        .where(_dearer("price"))
        .select("order_id", CATEGORY, "price")
    )


def above_average_share(items: DataFrame, products: DataFrame) -> DataFrame:
    """Share of all items that :func:`above_category_average` returns, to 4 places.

    Counted on (product, price, copies), for which the items are read once.
    """
    offers = items.groupBy("product_id", "price").agg(F.count(F.lit(1)).alias("copies"))
    known = products.select("product_id", CATEGORY)
    placed = (
        offers.join(known, "product_id", "left")
        .groupBy(CATEGORY, "price")
        .agg(F.sum("copies").alias("copies"))
    )
    weighted = [F.sum(limb * F.col("copies")) for limb in limbs("price")]
    means = (
        placed.where(F.col(CATEGORY).isNotNull() & limbs("price")[0].isNotNull())
        .groupBy(F.col(CATEGORY).alias("category"))
        .agg(_mean_units(joined_limbs(weighted), F.sum("copies")))
    )
    dearer = F.sum(F.when(_dearer("price"), F.col("copies")).otherwise(0))
    return (
        placed.join(means, F.col(CATEGORY) == F.col("category"), "left")
        .agg(dearer.alias("above"), F.sum("copies").alias("total"))
        .select(F.round(F.try_divide(F.col("above"), F.col("total")), 4).alias("above_share"))
    )


def top_prices_per_category(
    items: DataFrame, products: DataFrame, n: int = 3, chunk: int = 10_000
) -> DataFrame:
    """Item rows whose price ranks among the ``n`` highest of their category.

    Equal prices share a rank and leave a gap behind, and all of them are returned, so a category
    may give more than ``n`` rows. Everything the result shows follows from (product, price,
    copies), so the items are read and grouped once; no window ever sees an item row. Many items at
    one product and price are spelled out in chunks, which are dealt out before they are.
    """
    known = products.where(F.col(CATEGORY).isNotNull()).select("product_id", CATEGORY)
    offers = (
        items.groupBy("product_id", "price")
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(known, "product_id")
    )
    prices = offers.groupBy(CATEGORY, "price").agg(F.sum("copies").alias("copies"))
    ranks = top_ranks(prices, CATEGORY, "price", n).withColumnsRenamed(
        {CATEGORY: "category", "price": "top_price"}
    )
    same = (F.col(CATEGORY) == F.col("category")) & F.col("price").eqNullSafe(F.col("top_price"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(chunk).cast("long")))
    size = F.least(F.lit(chunk), F.col("copies") - F.col("first")).cast("int")
    return (
        offers.join(ranks, same)
        .select("category", "product_id", "price", "rank", "copies", first.alias("first"))
        .repartition("product_id", "price", "first")
        .select("category", "product_id", "price", "rank", F.explode(F.array_repeat(F.lit(0), size)))
        .select("category", "product_id", "price", F.col("rank").alias("RankInCategory"))
    )
