"""SKU, product, category and customer analytics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from saleswell import config
from saleswell.functions.keys import canonical_sku, has_prefix, normalize_sku
from saleswell.functions.numeric import as_double, pct_change, ratio
from saleswell.operators.channels import between_days, combine, cost_lookup, cost_value, line_cost_parts
from saleswell.operators.ordered import by_shuffle, first_rows

Period = tuple[dt.date, dt.date]


def tag_periods(df: DataFrame, day: str, periods: Mapping[str, Period]) -> DataFrame:
    """Give each row the periods its day falls in; one scan serves them all."""
    lower, upper = min(p[0] for p in periods.values()), max(p[1] for p in periods.values())
    hits = [F.when(F.col(day).between(F.lit(a), F.lit(b)), F.lit(name)) for name, (a, b) in periods.items()]
    return between_days(df, day, lower, upper).withColumn("period", F.explode(F.array_compact(F.array(*hits))))


def _order_sales(lines, orders, products, variants, costs, statuses, precedence, periods) -> DataFrame:
    """Per period and SKU sales of an order channel.

    Lines are summed per product and variant before any dimension is joined, so
    a hot product crosses the shuffle as one row per map task.
    """
    kept = tag_periods(orders.where(F.col("status").isin(*statuses)), "order_date", periods)
    grouped = (
        lines.join(by_shuffle(kept.select("order_id", "period")), "order_id")
        .groupBy("period", "product_id", "variant_id")
        .agg(F.sum("total_ex_tax").alias("revenue"), F.sum("quantity").alias("units"), *line_cost_parts())
    )
    named = grouped.join(by_shuffle(products.select("product_id", "product_name", "sku")), "product_id", "left").join(
        by_shuffle(variants), ["variant_id", "product_id"], "left"
    )
    keyed = named.withColumn("cost_key", canonical_sku(F.col("variant_sku"), F.col("product_name"), F.col("sku")))
    priced = keyed.join(by_shuffle(cost_lookup(costs, trim=True)), "cost_key", "left")
    return priced.groupBy("period", F.col("cost_key").alias("sku")).agg(
        F.sum("revenue").alias("revenue"), F.sum("units").alias("units"), F.sum(cost_value(precedence)).alias("cogs")
    )


def _marketplace_sales(sku_day, costs, periods) -> DataFrame:
    grouped = (
        tag_periods(sku_day, "business_date", periods)
        .groupBy("period", normalize_sku(F.col("msku")).alias("cost_key"))
        .agg(F.sum("gross_sales").alias("revenue"), F.sum("units").alias("units"))
    )
    priced = grouped.join(by_shuffle(cost_lookup(costs, trim=True)), "cost_key", "left")
    cost = F.coalesce(F.col("cost_per_unit") * F.col("units").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,2)"))
    return priced.groupBy("period", F.col("cost_key").alias("sku")).agg(
        F.sum("revenue").alias("revenue"), F.sum("units").alias("units"), F.sum(cost).alias("cogs")
    )


def sales_by_sku(x, variants: DataFrame, periods: Mapping[str, Period], channel: str = "all") -> DataFrame:
    """``period, sku, revenue, units, cogs, channel_count`` over the chosen channel.

    An accepted channel that no feed carries gives an empty result.
    """
    parts = {
        "storefront": lambda: _order_sales(
            x.storefront_lines, x.storefront_orders, x.products, variants, x.costs,
            config.STOREFRONT_REALISED, config.COGS_PRECEDENCE["storefront"], periods,
        ),
        "marketplace": lambda: _marketplace_sales(x.sku_day, x.costs, periods),
        "wholesale": lambda: _order_sales(
            x.wholesale_lines, x.wholesale_orders, x.products, variants, x.costs,
            config.WHOLESALE_REALISED, config.COGS_PRECEDENCE["wholesale"], periods,
        ),
    }
    if channel not in ("all", "retail", *parts):
        raise ValueError(f"unknown channel: {channel!r}")
    chosen = list(parts) if channel == "all" else [channel] if channel in parts else []
    frames = [parts[c]().withColumn("channel", F.lit(c)) for c in chosen]
    if not frames:
        frames = [parts["marketplace"]().where(F.lit(False)).withColumn("channel", F.lit(channel))]
    both = frames[0]
    for frame in frames[1:]:
        both = both.unionByName(frame)
    return both.where(F.coalesce(F.col("sku"), F.lit("")) != "").groupBy("period", "sku").agg(
        F.sum("revenue").alias("revenue"),
        F.sum("units").alias("units"),
        F.sum("cogs").alias("cogs"),
        F.count("channel").alias("channel_count"),
    )


# ------------------------------------------------------------------ categories
def category_map(source: DataFrame) -> DataFrame:
    """One category per normalised SKU."""
    clean = source.select(normalize_sku(F.col("sku")).alias("sku"), F.trim("category").alias("category"))
    return clean.where((F.col("sku") != "") & (F.col("category") != "")).groupBy("sku").agg(
        F.max("category").alias("category")
    )


def category_totals(sales: DataFrame, categories: DataFrame) -> DataFrame:
    """Current and previous totals per category from one tagged input."""
    cur, prev = F.col("period") == "current", F.col("period") == "previous"
    zero = F.lit(0).cast("decimal(38,2)")
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(zero))
    sums = sales.join(by_shuffle(categories), "sku").groupBy("category").agg(
        *[total(c, cur).alias(c) for c in ("revenue", "units", "cogs")],
        *[total(c, prev).alias(f"previous_{c}") for c in ("revenue", "units", "cogs")],
        F.count_if(cur).alias("sku_count"),
        F.count_if(prev).alias("previous_sku_count"),
    )
    c = F.col
    return sums.select(
        "category", "sku_count", "previous_sku_count",
        *[as_double(c(m)).alias(m) for p in ("", "previous_") for m in (f"{p}revenue", f"{p}units", f"{p}cogs")],
        as_double(c("revenue") - c("cogs")).alias("profit"),
        as_double(c("previous_revenue") - c("previous_cogs")).alias("previous_profit"),
        ratio(c("revenue") - c("cogs"), c("revenue"), 100, 1).alias("gm_pct"),
        as_double(c("revenue") - c("previous_revenue")).alias("delta"),
        pct_change(c("revenue"), c("previous_revenue")).alias("delta_pct"),
    )


def top_categories(totals: DataFrame, limit: int | None = 8) -> DataFrame:
    """Largest categories first; ``None`` keeps all."""
    return first_rows(totals, [F.desc("revenue"), "category"], limit)


def category_movers(totals: DataFrame) -> DataFrame:
    """Largest rise and largest fall, both from one pass over the totals."""
    first = lambda name, delta, sign: F.min(F.when(delta, F.struct((F.col("delta") * sign).alias("by"), "category", F.lit(name).alias("direction"), "delta")))
    both = totals.agg(first("positive", F.col("delta") > 0, -1).alias("up"), first("negative", F.col("delta") < 0, 1).alias("down"))
    return both.select(F.inline(F.array_compact(F.array("up", "down")))).select("direction", "category", "delta")


def category_coverage(sales: DataFrame, categories: DataFrame) -> DataFrame:
    """How much of the SKU revenue has a category."""
    hit = F.col("category").isNotNull()
    zero = F.lit(0).cast("decimal(38,2)")
    sums = sales.join(categories, "sku", "left").agg(
        F.count("*").alias("total_skus"),
        F.count_if(hit).alias("matched_skus"),
        F.count_if(~hit).alias("unmapped_skus"),
        F.coalesce(F.sum("revenue"), zero).alias("t"),
        F.coalesce(F.sum(F.when(hit, F.col("revenue"))), zero).alias("m"),
    )
    return sums.select(
        "total_skus", "matched_skus", "unmapped_skus",
        as_double(F.col("t")).alias("total_revenue"),
        as_double(F.col("m")).alias("matched_revenue"),
        as_double(F.col("t") - F.col("m")).alias("unmapped_revenue"),
        F.coalesce(ratio(F.col("m"), F.col("t"), 100, 1), F.lit(0.0)).alias("matched_revenue_pct"),
    )


def rename_categories(df: DataFrame, renames: DataFrame, column: str = "category") -> DataFrame:
    """Replace categories that a rename table maps; others keep their name."""
    table = renames.select(F.col("old_name").alias(column), "new_name")
    return df.join(table, column, "left").withColumn(column, F.coalesce("new_name", column)).drop("new_name")


# ------------------------------------------------------------------- top lists
def _product_sales(lines, orders, products, periods, exclude=config.WEB_ONLY_PREFIXES) -> DataFrame:
    kept = tag_periods(orders.where(F.col("status").isin(*config.STOREFRONT_REALISED)), "order_date", periods)
    sums = (
        lines.join(kept.select("order_id", "period"), "order_id")
        .groupBy("period", "product_id")
        .agg(F.sum("quantity").alias("units"), F.sum("total_ex_tax").alias("revenue"))
    )
    named = sums.join(products.select("product_id", "sku", "product_name"), "product_id")
    return named.where((F.coalesce(F.col("sku"), F.lit("")) != "") & ~has_prefix(F.col("sku"), exclude))


def top_sku(lines, orders, products, period: Period) -> DataFrame:
    sales = _product_sales(lines, orders, products, {"current": period})
    per_sku = sales.groupBy("sku", "product_name").agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    return per_sku.orderBy(F.desc("revenue"), "sku").limit(1)


def top_sku_compare(lines, orders, products, current: Period, previous: Period) -> DataFrame:
    """Best SKU of the current period with its value in the previous one."""
    sales = _product_sales(lines, orders, products, {"current": current, "previous": previous})
    of = lambda c, p: F.coalesce(
        F.sum(F.when(F.col("period") == p, F.col(c))), F.lit(0).cast("decimal(38,2)")
    )
    per_sku = sales.groupBy("sku").agg(
        F.max(F.when(F.col("period") == "current", F.col("product_name"))).alias("product_name"),
        F.count_if(F.col("period") == "current").alias("_n"),
        *[of(c, p).alias(f"{p}_{c}") for p in ("current", "previous") for c in ("revenue", "units")],
    )
    best = per_sku.where("_n > 0").orderBy(F.desc("current_revenue"), "sku").limit(1)
    return best.select(
        "sku", "product_name",
        *[as_double(F.col(f"{p}_revenue")).alias(f"{p}_revenue") for p in ("current", "previous")],
        *[F.col(f"{p}_units").cast("bigint").alias(f"{p}_units") for p in ("current", "previous")],
    )


def top_skus_per_channel(lines, orders, products, traffic, period: Period, k: int = 5) -> DataFrame:
    order = (F.desc("revenue"), F.asc("sku"))
    store = _product_sales(lines, orders, products, {"current": period}).orderBy(*order).limit(k)
    market = (
        between_days(traffic, "report_date", *period)
        .groupBy(F.col("msku").alias("sku"))
        .agg(F.sum("ordered_sales").alias("revenue"), F.sum("units_ordered").alias("units"))
        .orderBy(*order)
        .limit(k)
    )
    shape = lambda df, ch, name: df.select(
        F.lit(ch).alias("channel"), "sku", name.alias("product_name"), "units", as_double(F.col("revenue")).alias("revenue")
    )
    return shape(store, "storefront", F.col("product_name")).unionByName(shape(market, "marketplace", F.col("sku")))


def sku_variations(lines, orders, variants, product_ids: DataFrame, period: Period) -> DataFrame:
    """Variant breakdown of the requested products, for realised orders only."""
    kept = between_days(orders.where(F.col("status").isin(*config.VARIATION_STATUSES)), "order_date", *period)
    sums = (
        lines.join(product_ids.select("product_id"), "product_id", "left_semi")
        .join(kept.select("order_id"), "order_id", "left_semi")
        .groupBy("product_id", "variant_id")
        .agg(F.sum("quantity").alias("units"), F.sum("total_ex_tax").alias("revenue"))
    )
    named = sums.join(variants.select("variant_id", "variant_sku"), "variant_id", "left")
    return named.select(
        "product_id", "variant_id", F.coalesce("variant_sku", F.lit("No SKU")).alias("sku"), "units",
        as_double(F.col("revenue")).alias("revenue"),
    )


def top_customers(orders: DataFrame, billing: DataFrame, since: dt.date, limit: int | None = 20) -> DataFrame:
    """Wholesale roll-up by company.

    Orders are summed per customer first; only the per-customer rows meet in a
    company, so the name list is built from distinct names, not from orders.
    """
    kept = between_days(orders.where(~F.col("status").isin(*config.WHOLESALE_EXCLUDED)), "order_date", since)
    zero = F.lit(0).cast("decimal(18,2)")
    amount = lambda s: F.sum(F.when(F.col("status").isin(*s), F.col("sub_total")).otherwise(zero))
    company = F.coalesce(F.nullif("company", F.lit("")), F.col("full_name"))
    # Rank first: names are listed for the companies that stay only.
    per_name = (
        kept.join(billing, "order_id", "left")
        .groupBy(company.alias("company_name"), "full_name")
        .agg(
            F.countDistinct("order_id").alias("orders"),
            amount(config.WHOLESALE_REALISED).alias("revenue"),
            amount(config.WHOLESALE_FUTURE).alias("future"),
        )
    )
    out = per_name.groupBy("company_name").agg(
        F.sum("orders").alias("total_orders"),
        F.sum("revenue").alias("r"),
        F.sum("future").alias("f"),
    )
    out = out.select(
        "company_name", "total_orders",
        as_double(F.col("r")).alias("total_revenue"), as_double(F.col("f")).alias("future_revenue"),
        (F.col("r") + F.col("f")).alias("_rank"),
    )
    out = first_rows(out, [F.desc("_rank"), "company_name"], limit).drop("_rank")
    names = (
        per_name.join(out.select("company_name"), "company_name", "left_semi").groupBy("company_name")
        .agg(F.array_join(F.sort_array(F.collect_set("full_name")), ", ").alias("customer_name"))
    )
    return out.join(names, "company_name", "left")


# ------------------------------------------------------------------- SKU report
def report_sku() -> Column:
    """SKU the report groups by: the variant's when there is one, blank or not."""
    return F.lower(F.coalesce("variant_sku", "sku"))


def resolve_aliases(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Add ``sku``: the alias target where one exists, otherwise the lower-cased value."""
    table = aliases.select(F.lower("raw").alias("_raw"), F.lower("canonical").alias("_canonical"))
    joined = df.withColumn("_raw", F.lower(column)).join(table, "_raw", "left")
    return joined.withColumn("sku", F.coalesce("_canonical", "_raw")).drop("_raw", "_canonical")


def constant_aliases(spark, aliases: Mapping[str, str]) -> DataFrame:
    """A shop's own alias table, small enough to be written down."""
    return spark.createDataFrame(list(aliases.items()), "raw string, canonical string")


def report_catalog(products, prefixes=config.REPORT_PREFIXES) -> DataFrame:
    return products.where(has_prefix(F.col("sku"), prefixes)).select(
        F.lower("sku").alias("sku"), "product_name", F.coalesce("brand", F.lit("Other")).alias("brand"),
        F.col("price").alias("list_price"), F.col("cost_price").alias("catalog_cost"),
        F.coalesce("inventory_level", F.lit(0)).alias("inventory_on_hand"), F.lit(True).alias("in_catalog"),
    )


def _named_lines(lines, orders, products, variants, prefixes, order_filter) -> DataFrame:
    names = products.select("product_id", "sku")
    # Only products that can name a wanted SKU, themselves or by a variant, reach the other joins.
    own = names.where(has_prefix(F.col("sku"), prefixes)).select("product_id")
    by_variant = variants.where(has_prefix(F.col("variant_sku"), prefixes)).select("product_id")
    return (
        lines.join(by_shuffle(orders.where(order_filter).select("order_id")), "order_id")
        .join(by_shuffle(own.unionByName(by_variant).distinct()), "product_id", "left_semi")
        .join(by_shuffle(names), "product_id")
        .join(by_shuffle(variants), ["variant_id", "product_id"], "left")
        .where(has_prefix(F.coalesce("variant_sku", "sku"), prefixes))
        .withColumn("sku", report_sku())
    )


def retail_sales(lines, orders, products, variants, since, prefixes=config.REPORT_PREFIXES) -> DataFrame:
    """Paid units apart from bundled free ones (zero price)."""
    live = (F.col("order_date") >= F.lit(since)) & ~F.col("status").isin(*config.SKU_REPORT_EXCLUDED)
    named = _named_lines(lines, orders, products, variants, prefixes, live)
    paid, free = F.col("base_total") > 0, F.col("base_total") == 0
    return named.groupBy("sku").agg(
        F.sum(F.when(paid, F.col("quantity")).otherwise(0)).alias("retail_units"),
        F.sum(F.when(paid, F.col("base_total")).otherwise(F.lit(0).cast("decimal(18,2)"))).alias("retail_gross_sales"),
        F.countDistinct(F.when(paid, F.col("order_id"))).alias("retail_orders"),
        F.sum(F.when(free, F.col("quantity")).otherwise(0)).alias("retail_bundled_units"),
    )


def wholesale_sku_sales(lines, orders, products, variants, since, prefixes=config.REPORT_PREFIXES) -> DataFrame:
    live = (F.col("order_date") >= F.lit(since)) & ~F.col("status").isin(*config.SKU_REPORT_EXCLUDED)
    named = _named_lines(lines, orders, products, variants, prefixes, live)
    return named.groupBy("sku").agg(
        F.sum("quantity").alias("wholesale_units"),
        F.sum("base_total").alias("wholesale_gross_sales"),
        F.countDistinct("order_id").alias("wholesale_orders"),
    )


def refunds_by_sku(refunds, lines, orders, products, variants, since, prefixes=config.REPORT_PREFIXES) -> DataFrame:
    live = orders.where(F.col("order_date") >= F.lit(since)).select("order_id")
    sums = (
        refunds.select("order_id", "line_id", "quantity", "requested_amount")
        .join(by_shuffle(lines.select("line_id", "product_id", "variant_id")), "line_id")
        .join(by_shuffle(live), "order_id")
        .groupBy("product_id", "variant_id")
        .agg(
            F.sum(F.coalesce("quantity", F.lit(0))).alias("units"),
            F.sum(F.coalesce("requested_amount", F.lit(0).cast("decimal(18,2)"))).alias("amount"),
        )
    )
    named = (
        sums.join(by_shuffle(products.select("product_id", "sku")), "product_id")
        .join(by_shuffle(variants), ["variant_id", "product_id"], "left")
        .where(has_prefix(F.coalesce("variant_sku", "sku"), prefixes))
    )
    return named.groupBy(report_sku().alias("sku")).agg(
        F.sum("units").alias("retail_refund_units"), F.sum("amount").alias("retail_refund_amount")
    )


def marketplace_sku_sales(sku_day, aliases, since, until, prefixes=config.REPORT_PREFIXES) -> DataFrame:
    kept = between_days(sku_day, "business_date", since, until).where(has_prefix(F.col("msku"), prefixes))
    per_msku = kept.groupBy("msku").agg(
        F.sum("units").alias("units"), F.sum("gross_sales").alias("gross_sales"),
        F.sum(F.abs("refunds")).alias("refunds"), F.sum("fees").alias("fees"),
        F.sum("ad_spend").alias("ad_spend"), F.sum("net_proceeds").alias("net_proceeds"),
    )
    return resolve_aliases(per_msku, aliases, "msku").groupBy("sku").agg(
        *[F.sum(c).alias(f"marketplace_{c}") for c in ("units", "gross_sales", "refunds", "fees", "ad_spend", "net_proceeds")]
    )


def marketplace_sku_orders(settlements, aliases, since, until, prefixes=config.REPORT_PREFIXES) -> DataFrame:
    kept = between_days(settlements, "posted_date", since, until).where(
        (F.col("transaction_type") == "Order") & F.col("order_id").isNotNull() & has_prefix(F.col("sku"), prefixes)
    )
    pairs = kept.select(F.col("sku").alias("msku"), "order_id").distinct()
    return resolve_aliases(pairs, aliases, "msku").groupBy("sku").agg(
        F.countDistinct("order_id").alias("marketplace_orders")
    )


def sku_universe(frames: Sequence[DataFrame]) -> DataFrame:
    """Distinct SKUs over several relations."""
    return combine([f.select("sku") for f in frames], ["sku"])


def sku_report(x, variants, refunds, aliases, since: dt.date, until: dt.date, prefixes=config.REPORT_PREFIXES) -> DataFrame:
    """Multi-channel SKU report; one shuffle merges the eight relations on SKU."""
    member = lambda df: df.withColumn("_member", F.lit(1))
    cost = cost_lookup(x.costs, "latest_valid", until, case="lower").withColumnRenamed("cost_key", "sku")
    frames = [
        member(report_catalog(x.products, prefixes)),
        cost.withColumnRenamed("cost_per_unit", "dim_cost"),
        member(retail_sales(x.storefront_lines, x.storefront_orders, x.products, variants, since, prefixes)),
        refunds_by_sku(refunds, x.storefront_lines, x.storefront_orders, x.products, variants, since, prefixes),
        member(wholesale_sku_sales(x.wholesale_lines, x.wholesale_orders, x.products, variants, since, prefixes)),
        member(marketplace_sku_sales(x.sku_day, aliases, since, until, prefixes)),
        marketplace_sku_orders(x.settlements, aliases, since, until, prefixes),
    ]
    m = combine(frames, ["sku"]).where("_member = 1")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    d = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(28,2)"))
    active = (F.col("retail_units") > 0) | (F.col("wholesale_units") > 0) | (F.col("marketplace_units") > 0)
    m = m.where(F.col("in_catalog").isNotNull() | active)
    units = n("retail_units") + n("wholesale_units") + n("marketplace_units")
    gross = d("retail_gross_sales") + d("wholesale_gross_sales") + d("marketplace_gross_sales")
    unit_cost = F.coalesce("dim_cost", "catalog_cost")
    margin = (
        d("retail_gross_sales") + d("wholesale_gross_sales") + d("marketplace_net_proceeds")
        - unit_cost * units.cast("decimal(38,0)")
    )
    counts = (
        "retail_units retail_orders retail_bundled_units retail_refund_units wholesale_units wholesale_orders "
        "marketplace_units marketplace_orders"
    ).split()
    amounts = (
        "retail_gross_sales retail_refund_amount wholesale_gross_sales marketplace_gross_sales "
        "marketplace_net_proceeds marketplace_fees marketplace_ad_spend marketplace_refunds"
    ).split()
    return m.select(
        "sku", F.coalesce("product_name", "sku").alias("product_name"), F.coalesce("brand", F.lit("Other")).alias("brand"),
        F.col("list_price").cast("double").alias("list_price"), unit_cost.cast("double").alias("cost_per_unit"),
        n("inventory_on_hand").alias("inventory_on_hand"),
        *[n(c).alias(c) for c in counts], *[as_double(d(c)).alias(c) for c in amounts],
        ratio(F.col("retail_refund_amount"), F.col("retail_gross_sales"), digits=4).alias("retail_refund_rate"),
        units.alias("total_units"), as_double(gross).alias("total_gross_sales"),
        (n("retail_orders") + n("wholesale_orders") + n("marketplace_orders")).alias("total_orders"),
        as_double(F.when(unit_cost.isNotNull() & (units > 0), margin)).alias("gross_margin"),
    )


def channel_split(report: DataFrame) -> DataFrame:
    """Footer: gross sales per channel over active SKUs and their share."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,2)"))
    names = ("retail", "wholesale", "marketplace")
    active = report.where((F.col("total_units") > 0) | (F.col("total_gross_sales") > 0))
    sums = active.agg(*[exact(f"{n}_gross_sales").alias(n) for n in names])
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    rows = [
        F.struct(F.lit(n).alias("channel"), F.col(n).cast("double").alias("gross_sales"),
                 ratio(F.col(n), total, 100, 1).alias("share_pct"))
        for n in names
    ]
    return sums.select(F.inline(F.array(*rows)))


def item_year_rollup(sku_day: DataFrame, item: str = "asin") -> DataFrame:
    """Per item and year with a total row per item."""
    sums = sku_day.withColumn("year", F.year("business_date")).groupBy(item, "year").agg(
        *[F.sum(c).alias(c) for c in ("gross_sales", "units", "fees", "ad_spend", "net_proceeds")]
    )
    # The total row comes from the per-year rows, not from the facts again.
    both = sums.select(item, F.col("year").cast("string").alias("year"), *sums.columns[2:]).unionByName(
        sums.groupBy(item).agg(*[F.sum(c).alias(c) for c in sums.columns[2:]]).withColumn("year", F.lit("Total"))
    )
    per_unit = lambda c: F.when(F.col("units") > 0, ratio(F.col(c), F.col("units"), digits=4)).otherwise(0.0)
    return both.select(
        item, "year", "units",
        *[as_double(F.col(c)).alias(c) for c in ("gross_sales", "fees", "ad_spend", "net_proceeds")],
        per_unit("net_proceeds").alias("net_per_unit"), per_unit("gross_sales").alias("revenue_per_unit"),
    )


# ---------------------------------------------------------- revenue analysis
def classify_line(name: Column, source: Column) -> Column:
    """Business line of an order row; the first matching rule wins."""
    n = F.lower(F.coalesce(name, F.lit("")))
    has = lambda *words: sum((F.contains(n, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    workshop = (has("workshop", "seminar") | (has("class") & ~has("classic"))) & ~has("book")
    return (
        F.when(workshop, "Workshops")
        .when(has("boarding", "repotting service", "consult"), "Services")
        .when(F.lower(source).isin("manual", "pos"), "Retail")
        .otherwise(".Com")
    )


def category_list(product_categories: DataFrame) -> DataFrame:
    """All category names of a product in one string, in category order."""
    pair = F.struct("category_id", "category_name")
    return product_categories.groupBy("product_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_set(pair)), lambda p: p["category_name"]), ", ").alias("category_names")
    )


def first_category(product_categories: DataFrame) -> DataFrame:
    return product_categories.groupBy("product_id").agg(F.min_by("category_name", "category_id").alias("category_name"))


def master_lookup(products: DataFrame, product_categories: DataFrame) -> DataFrame:
    """Cost and category per lower-cased SKU; the last product listed wins."""
    joined = products.join(first_category(product_categories), "product_id", "left").select(
        F.lower("sku").alias("sku_key"), "product_id", "cost_price", "category_name"
    )
    return joined.groupBy("sku_key").agg(
        F.max_by("cost_price", "product_id").alias("unit_cost"), F.max_by("category_name", "product_id").alias("category_name")
    )


def margin_enrich(sales: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add cost, category, COGS and margin; unknown SKUs cost nothing and are 'Uncategorized'.

    ``sales`` needs ``sku, quantity, income``: income is revenue, or net
    proceeds on the marketplace.
    """
    joined = sales.withColumn("sku_key", F.lower("sku")).join(lookup, "sku_key", "left")
    cost = F.coalesce("unit_cost", F.lit(0).cast("decimal(18,2)"))
    cogs = cost * F.col("quantity").cast("decimal(38,0)")
    return joined.withColumns(
        {"category_name": F.coalesce("category_name", F.lit("Uncategorized")), "cogs": cogs, "margin": F.col("income") - cogs}
    ).drop("sku_key", "unit_cost")


def channel_yoy(sales: DataFrame, this_year: int, last_year: int) -> DataFrame:
    """Revenue by channel for two years, change and YoY percent."""
    wide = sales.groupBy("channel").pivot("year", [this_year, last_year]).agg(F.sum("revenue"))
    zero = F.lit(0).cast("decimal(38,2)")
    a, b = F.coalesce(F.col(f"`{this_year}`"), zero), F.coalesce(F.col(f"`{last_year}`"), zero)
    return wide.select(
        "channel", as_double(a).alias("this_year"), as_double(b).alias("last_year"),
        ratio(a - b, b, 100, 1).alias("yoy_pct"), as_double(a - b).alias("delta"),
    )


def margin_drivers(enriched: DataFrame, keys: Sequence[str]) -> DataFrame:
    return enriched.groupBy(*keys).agg(as_double(F.sum("margin")).alias("margin"), as_double(F.sum("revenue")).alias("revenue"))


def noise_products(enriched: DataFrame, minimum: float = 500.0, k: int | None = 5) -> DataFrame:
    """High revenue, lowest margin share."""
    stats = enriched.groupBy("product_name", "channel").agg(
        F.sum("revenue").alias("revenue"), F.sum("margin").alias("margin"), F.sum("quantity").alias("quantity")
    )
    out = stats.where(F.col("revenue") > F.lit(minimum).cast("decimal(18,2)")).select(
        "product_name", "channel", "quantity", as_double(F.col("revenue")).alias("revenue"),
        as_double(F.col("margin")).alias("margin"), ratio(F.col("margin"), F.col("revenue"), digits=6).alias("margin_pct"),
    )
    return out if k is None else out.orderBy("margin_pct", "product_name", "channel").limit(k)


def variant_sales(lines, orders, products, variants, period: Period, prefixes: Sequence[str]) -> DataFrame:
    """Per parent SKU and variant: quantity and revenue in a period."""
    kept = between_days(orders.where(F.col("status").isin(*config.STOREFRONT_REALISED)), "order_date", *period)
    sums = (
        lines.join(kept.select("order_id", "order_date"), "order_id")
        .groupBy("product_id", "variant_id", "order_date")
        .agg(F.sum("quantity").alias("quantity"), F.sum("total_ex_tax").alias("revenue"))
    )
    named = sums.join(products.select("product_id", "sku", "product_name"), "product_id").where(
        has_prefix(F.col("sku"), prefixes)
    )
    return named.join(variants.select("variant_id", "variant_sku"), "variant_id", "left").select(
        F.lower(F.trim("sku")).alias("parent_sku"), "product_name",
        F.trim(F.coalesce("variant_sku", F.lit("Unknown"))).alias("variant_sku"), "order_date", "quantity", "revenue",
    )


def top_parent_variants(sales: DataFrame, stock: DataFrame, k: int = 10) -> DataFrame:
    """Variant breakdown of the ``k`` best parents, with stock.

    The parent list is at most ``k`` rows, so it may be broadcast.
    """
    parents = (
        sales.groupBy("parent_sku").agg(F.sum("revenue").alias("parent_revenue"))
        .orderBy(F.desc("parent_revenue"), "parent_sku").limit(k)
    )
    rows = sales.groupBy("parent_sku", "product_name", "variant_sku").agg(
        F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue")
    )
    return (
        rows.join(F.broadcast(parents), "parent_sku")
        .withColumn("join_sku", F.lower(F.trim("variant_sku")))
        .join(stock_by_sku(stock), "join_sku", "left")
        .select(
            "parent_sku", "product_name", "variant_sku", F.coalesce("stock", F.lit(0.0)).alias("stock"), "quantity",
            as_double(F.col("revenue")).alias("revenue"), as_double(F.col("parent_revenue")).alias("parent_revenue"),
        )
    )


def rank_in_parent(variants: DataFrame) -> DataFrame:
    """Variants with their ``rank_in_parent`` by revenue and their ``share`` of the parent's, for a breakdown of a few parents."""
    order = Window.partitionBy("parent_sku").orderBy(F.desc("revenue"), "variant_sku", "product_name")
    return variants.withColumn("rank_in_parent", F.row_number().over(order)).withColumn("share", ratio(F.col("revenue"), F.col("parent_revenue"), 100.0))


def stock_by_sku(stock: DataFrame) -> DataFrame:
    return stock.groupBy(F.lower(F.trim("sku")).alias("join_sku")).agg(F.max("quantity").alias("stock"))


def buy_forecast(sales: DataFrame, stock: DataFrame, depletion: Period, need: Period) -> DataFrame:
    """Purchase need per variant: later demand minus stock left after the first period.

    One conditional aggregation over both periods, so a variant that sold in
    only one of them keeps its names and its stock.
    """
    qty = lambda p: F.sum(
        F.when(F.col("order_date").between(F.lit(p[0]), F.lit(p[1])), F.col("quantity")).otherwise(0)
    )
    sums = sales.groupBy("parent_sku", "product_name", "variant_sku").agg(
        qty(depletion).alias("sales_before"), qty(need).alias("sales_after")
    )
    joined = sums.where("sales_before <> 0 OR sales_after <> 0").withColumn("join_sku", F.lower(F.trim("variant_sku")))
    stocked = joined.join(stock_by_sku(stock), "join_sku", "left").withColumn("stock", F.coalesce("stock", F.lit(0.0)))
    left = F.greatest(F.col("stock") - F.col("sales_before"), F.lit(0.0))
    return stocked.select(
        "parent_sku", "variant_sku", "product_name", "stock", "sales_before", left.alias("projected_stock"), "sales_after",
        F.greatest(F.col("sales_after") - left, F.lit(0.0)).alias("buy_recommendation"),
    )


def sku_totals(sales: DataFrame, k: int | None = 10) -> DataFrame:
    """Cross-channel totals per SKU with one (deterministic) product name."""
    out = sales.groupBy(F.lower(F.trim("sku")).alias("sku")).agg(
        F.sum("revenue").alias("_r"), F.sum("quantity").alias("quantity"), F.min("product_name").alias("product_name")
    )
    if k is not None:
        out = out.orderBy(F.desc("_r"), "sku").limit(k)
    return out.select("sku", "product_name", "quantity", as_double(F.col("_r")).alias("revenue"))


def sku_lifetime(lines, orders, products, variants, since, prefixes=config.REPORT_PREFIXES) -> DataFrame:
    live = (F.col("order_date") >= F.lit(since)) & ~F.col("status").isin(*config.SKU_REPORT_EXCLUDED)
    kept = orders.where(live).select("order_id", "order_date")
    named = (
        lines.join(by_shuffle(kept), "order_id")
        .join(by_shuffle(products.select("product_id", "sku", "product_name", "brand")), "product_id")
        .join(by_shuffle(variants), ["variant_id", "product_id"], "left")
        .where(has_prefix(F.coalesce("variant_sku", "sku"), prefixes))
    )
    return named.groupBy(report_sku().alias("sku"), "product_name", "brand").agg(
        F.sum("quantity").alias("units"), as_double(F.sum("base_total")).alias("gross_sales"),
        F.countDistinct("order_id").alias("orders"), F.min("order_date").alias("first_sale"), F.max("order_date").alias("last_sale"),
    )


def cost_at_sale(lines, orders, products, costs) -> DataFrame:
    """Cost of goods per SKU with the cost valid on each sale day.

    Equi-join on the SKU with the interval as residual; lines are first summed
    per product and day, and if intervals overlap the newest one counts.
    """
    sums = (
        lines.join(orders.select("order_id", "order_date"), "order_id")
        .groupBy("product_id", "order_date").agg(F.sum("quantity").alias("quantity"))
        .join(products.select("product_id", F.upper("sku").alias("cost_key")), "product_id")
        .groupBy("cost_key", "order_date").agg(F.sum("quantity").alias("quantity"))
    )
    dim = costs.select(F.upper("msku").alias("cost_key"), "cost_per_unit", "valid_from", "valid_to")
    valid = (
        (sums.cost_key == dim.cost_key)
        & (sums.order_date >= dim.valid_from)
        & (dim.valid_to.isNull() | (sums.order_date <= dim.valid_to))
    )
    per_day = sums.join(dim, valid, "left").groupBy(sums.cost_key, sums.order_date).agg(
        F.max(sums.quantity).alias("quantity"),
        F.max(F.when(dim.valid_from.isNotNull(), F.struct(dim.valid_from, dim.cost_per_unit))).alias("top"),
    )
    cost = F.col("top.cost_per_unit") * F.col("quantity").cast("decimal(38,0)")
    return per_day.groupBy(F.col("cost_key").alias("sku")).agg(
        F.sum("quantity").alias("units"), as_double(F.sum(cost)).alias("cogs"),
        F.sum(F.when(F.col("top").isNull(), F.col("quantity")).otherwise(0)).alias("units_without_cost"),
    )
