"""Planned events and accounting requests, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from saleswell import config
from saleswell.functions.accounts import account_key, infer_account_type, path_prefixes
from saleswell.functions.keys import item_key
from saleswell.functions.numeric import number_text
from saleswell.functions.text import name_uuid, sanitize_text, truncate_name
from saleswell.operators.ordered import row_numbers, spread_nulls

BLOCK_CHARS = 6


def route_location(sku: Column, prefix: str, match: str, other: str) -> Column:
    """Home location of a SKU by prefix."""
    return F.when(F.upper(sku).startswith(prefix.upper()), F.lit(match)).otherwise(F.lit(other))


def chunk_lines(lines: DataFrame, keys: Sequence[str], size: int, order: str = "sku", block: Column | None = None) -> DataFrame:
    """Number lines in order within each group and cut them into chunks.

    Adds ``chunk_no`` (from 1) and ``chunk_count``.  Numbering is done block by
    block (leading characters of the order key by default), so one large group
    does not end up in one task.
    """
    block = block if block is not None else F.substring(order, 1, BLOCK_CHARS)
    numbered = row_numbers(lines, keys, [order], block, "_rn")
    sizes = lines.groupBy(*keys).agg(F.count("*").alias("_n"))
    renamed = sizes.select(*[F.col(k).alias(f"_g_{k}") for k in keys], "_n")
    on = [numbered[k].eqNullSafe(renamed[f"_g_{k}"]) for k in keys]
    joined = numbered.join(renamed, on).drop(*[f"_g_{k}" for k in keys])
    return joined.withColumns({
        "chunk_no": F.floor((F.col("_rn") - 1) / size) + 1,
        "chunk_count": F.floor((F.col("_n") - 1) / size) + 1,
    }).drop("_rn", "_n")


def opening_lines(parts: DataFrame, prefix: str, match: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Set-mode opening lines routed to a home location, and the negative ones refused."""
    clean = F.coalesce(F.when(~F.isnan("opening_qty") & (F.abs("opening_qty") != float("inf")), F.col("opening_qty")), F.lit(0.0))
    rows = parts.where(F.trim("sku") != "").select(
        F.trim("sku").alias("sku"), clean.alias("new_qty"), route_location(F.trim("sku"), prefix, match, other).alias("location_code")
    )
    return rows.where("new_qty >= 0"), rows.where("new_qty < 0")


def zero_fill_gap(parts: DataFrame, locations: Sequence[str], queued: DataFrame, prefix: str, match: str, other: str) -> DataFrame:
    """SKU and location pairs still to be zeroed: every location that is not the home one.

    The location list is a short argument, so pairs come from exploding it, not
    from a cross join.
    """
    home = route_location(F.col("sku"), prefix, match, other)
    pairs = parts.select("sku", home.alias("home"), F.explode(F.array(*map(F.lit, locations))).alias("location_code"))
    wanted = pairs.where("home <> location_code").drop("home")
    return wanted.join(queued.select("sku", "location_code").distinct(), ["sku", "location_code"], "left_anti")


def zero_out_lines(skus: DataFrame) -> DataFrame:
    """Clean-up lines: quantity 0, new quantity 0, so balances do not move."""
    unique = skus.select("location_id", F.trim("sku").alias("sku")).where("sku <> ''").distinct()
    return unique.withColumns({"qty": F.lit(0.0), "new_qty": F.lit(0.0)})


def sync_lines(mismatches: DataFrame, fields: Sequence[str], onhand: DataFrame) -> DataFrame:
    """Set-mode lines that restate our on-hand for the SKUs with a mismatch in ``fields``.

    ``reject_reason`` is NULL for a line that may be sent: missing or negative stock must never become a quantity.
    """
    wanted = mismatches.where(F.col("field").isin(*fields) & ~F.col("is_match")).select(F.trim("sku").alias("sku")).where("sku <> ''").distinct()
    reason = F.when(F.col("on_hand").isNull(), "missing stock").when(F.col("on_hand") < 0, "negative stock")
    return wanted.join(onhand, "sku", "left").select("sku", F.when(reason.isNull(), F.col("on_hand")).alias("new_qty"), reason.alias("reject_reason"))


def rebatch(events: DataFrame, lines: DataFrame, size: int) -> DataFrame:
    """Split failed events by location, then into chunks."""
    rows = lines.where(F.col("location_id").isNotNull() & (F.trim("sku") != "")).join(events.select("event_id", "memo"), "event_id")
    return chunk_lines(rows, ["event_id", "location_id"], size, order="line_id", block=F.substring("line_id", 1, 12))


def missing_accounts(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Accounts to create so that a reported missing path exists, parents first.

    ``requests``: ``event_id, item_full_name, missing_account, income_account,
    cogs_account, asset_account``; ``known``: ``account``.
    """
    kind = infer_account_type(F.col("missing_account"), F.col("income_account"), F.col("cogs_account"), F.col("asset_account"))
    steps = requests.select(
        "event_id", "item_full_name", kind.alias("account_type"),
        F.posexplode(path_prefixes(F.col("missing_account"))).alias("depth", "account"),
    ).withColumn("account_key", account_key(F.col("account")))
    fresh = steps.join(known.select(account_key(F.col("account")).alias("account_key")).distinct(), "account_key", "left_anti")
    # The same account asked for by several requests is created once.
    first = fresh.groupBy("account_key").agg(F.min(F.struct("depth", "event_id", "item_full_name", "account", "account_type")).alias("r"))
    out = first.select("account_key", "r.*")
    seed = F.concat_ws("|", F.col("event_id"), F.lit("account_add"), item_key(F.col("item_full_name")), "account_key", "account_type")
    return out.select(
        "event_id", (F.col("depth") + 1).alias("depth"), "account", "account_type",
        F.col("item_full_name").alias("source_item"), name_uuid(seed).alias("request_id"),
    )


def missing_items(lines: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Creation specs for unknown items; ``reject_reason`` names absent accounts."""
    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    name = F.coalesce(text("item_full_name"), text("sku"))
    roles = {"income account": "income_account", "COGS account": "cogs_account", "asset account": "asset_account"}
    account = {c: F.coalesce(text(c), F.nullif(F.lit(defaults.get(c, "")), F.lit(""))) for c in roles.values()}
    lacking = F.array_compact(F.array(*[F.when(account[c].isNull(), F.lit(label)) for label, c in roles.items()]))
    sales = F.coalesce(text("sales_description"), text("sku"), name)
    rows = lines.select(
        "event_id", "line_id", name.alias("item_full_name"), item_key(name).alias("_key"),
        *[v.alias(c) for c, v in account.items()], sales.alias("sales_description"), "sales_price", "purchase_cost",
        F.nullif(F.array_join(lacking, ", "), F.lit("")).alias("reject_reason"),
    ).where(F.col("item_full_name").isNotNull())
    fields = [c for c in rows.columns if c not in ("event_id", "_key")]
    first = rows.groupBy("event_id", "_key").agg(F.min_by(F.struct(*fields), "line_id").alias("r"))
    return first.select("event_id", "r.*").drop("line_id")


def item_modifications(lines: DataFrame, items: DataFrame, matches: DataFrame) -> DataFrame:
    """Account changes per line; a price-cost event takes the accounting side's accounts.

    ``reject_reason`` is NULL when everything required is there.
    """
    detail = items.select(F.col("item_full_name").alias("_name"), F.struct(
        "list_id", "edit_sequence",
        *[F.col(c).alias(f"_{c}") for c in ("income_account", "cogs_account", "asset_account")], F.lit(True).alias("_found"),
    ).alias("_item"))
    # Details meet the matches, one row a SKU, before the lines do: the lines of all SKUs without a match would share one NULL key.
    name = spread_nulls(F.col("matched_name"), "string", F.col("sku"))
    found = matches.withColumn("_name", name).join(detail, "_name", "left").withColumn("_item", F.when(F.col("matched_name").isNotNull(), F.col("_item")))
    rows = lines.join(found.select("sku", "_item.*"), "sku", "left")
    theirs = F.contains(F.lower(F.coalesce("created_by", F.lit(""))), F.lit("price-cost"))
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    chosen = {c: F.when(theirs, text(f"_{c}")).otherwise(F.coalesce(text(c), text(f"_{c}"))) for c in ("income_account", "cogs_account", "asset_account")}
    reason = F.coalesce(
        F.when(F.col("_found").isNull(), F.lit("missing item detail")),
        F.when(text("list_id").isNull(), F.lit("missing list id")),
        F.when(text("edit_sequence").isNull(), F.lit("missing edit sequence")),
        *[F.when(v.isNull(), F.lit(f"missing {c.replace('_', ' ')}")) for c, v in chosen.items()],
    )
    return rows.select(
        "event_id", "line_id", "sku", "list_id", "edit_sequence", *[v.alias(c) for c, v in chosen.items()], reason.alias("reject_reason")
    )


def remap_account(parts: DataFrame, old: str, new: str, column: str = "cogs_account") -> DataFrame:
    """Replace an account everywhere; curly apostrophes compare as straight ones."""
    norm = F.trim(F.replace(F.col(column), F.lit("’"), F.lit("'")))
    clean = lambda s: s.strip().replace("’", "'")
    if not clean(old) or not clean(new) or clean(old) == clean(new):
        raise ValueError("old and new account must be given and differ")
    hit = norm == clean(old)
    return parts.withColumns({"remapped": F.coalesce(hit, F.lit(False)), column: F.when(hit, F.lit(clean(new))).otherwise(F.col(column))})


def remap_summary(remapped: DataFrame, sample: int = 25) -> DataFrame:
    """How many rows change, with a few example SKUs (smallest first)."""
    hits = remapped.where("remapped")
    first = hits.orderBy("sku").limit(sample).agg(F.sort_array(F.collect_list("sku")).alias("sample_skus"))
    return hits.agg(F.count("*").alias("matched")).withColumn("_k", F.lit(0)).join(first.withColumn("_k", F.lit(0)), "_k").drop("_k")


# --------------------------------------------------------------------- rendering
def memo(event_type: Column, event_id: Column, created_by: Column, note: Column) -> Column:
    parts = [F.nullif(sanitize_text(c.cast("string")), F.lit("")) for c in (event_type, event_id, created_by, note)]
    return F.trim(F.concat_ws(" ", *parts))


def account_for_posting(path: Column) -> Column:
    """Account name as the accounting list stores it; deep COGS paths post to their root."""
    clean = F.trim(sanitize_text(path))
    root = F.trim(F.substring_index(clean, ":", 1))
    name = F.when(F.contains(clean, F.lit(":")) & F.lower(root).startswith("cog"), root).otherwise(clean)
    parts = F.filter(F.transform(F.split(name, ":"), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_join(F.transform(parts, lambda s: truncate_name(s)), ":")


def xml_escape(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    # Characters outside ASCII leave as numeric references.
    chars = F.transform(F.split(out, ""), lambda c: F.when(
        c.rlike(r"^[^\x00-\x7F]"), F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c))
    return F.when(out.rlike(r"[^\x00-\x7F]"), F.array_join(chars, "")).otherwise(out)


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def _ref(name: str, value: Column) -> Column:
    return _tag(name, _tag("FullName", xml_escape(value)))


def render_events(
    hydrated: DataFrame, default_account: str, guid_prefix: str = "inventory:", lines_per_part: int | None = None
) -> DataFrame:
    """Request text per event, or ``reject_reason`` when it cannot be sent.

    One row holds the whole request (``part_no`` 1).  With ``lines_per_part`` a
    long event comes in numbered parts, which concatenated in order give the request.
    ``memo_truncated`` tells that the memo was longer than the receiver's field.
    """
    keys = ["event_id", "event_type", "effective_date", "created_by", "memo"]
    transfer = F.col("event_type") == "transfer"
    item = F.trim(sanitize_text(F.coalesce("item_full_name", "sku")))
    qty = number_text(F.coalesce("qty", F.lit(0.0)))
    move = _tag("TransferInventoryLineAdd", F.concat(_ref("ItemRef", item), _tag("QuantityToTransfer", qty)))
    change = F.when(F.col("new_qty").isNotNull(), _tag("NewQuantity", number_text(F.col("new_qty")))).otherwise(_tag("QuantityDifference", qty))
    adjust = _tag("InventoryAdjustmentLineAdd", F.concat(_ref("ItemRef", item), _tag("QuantityAdjustment", change)))
    site = lambda c: F.nullif(F.trim(sanitize_text(F.col(c))), F.lit(""))
    rows = hydrated.select(
        *keys, "line_id", F.when(transfer, move).otherwise(adjust).alias("_line"), (item == "").cast("int").alias("_no_item"),
        site("site_name").alias("_site"), site("from_site_name").alias("_from"), site("to_site_name").alias("_to"),
        F.nullif(F.trim("account_full_name"), F.lit("")).alias("_acct"),
    )
    bodies = F.collect_list(F.struct("line_id", "_line"))
    text_of = lambda pairs: F.array_join(F.transform(F.sort_array(pairs), lambda p: p["_line"]), "").alias("_body")
    # Whole requests come from the same pass as their heads; only parts of a bounded size are grouped on their own.
    whole = lines_per_part is None
    events = rows.groupBy(*keys).agg(
        *([bodies.alias("_pairs")] if whole else []),
        *[f(c).alias(f"{c}_{n}") for c in ("_site", "_from", "_to") for n, f in (("lo", F.min), ("hi", F.max))],
        F.min_by("_acct", F.when(F.col("_acct").isNotNull(), F.col("line_id"))).alias("_acct"),
        F.max("_no_item").alias("_no_item"), F.count("*").alias("line_count"),
    )
    mixed = lambda c: F.col(f"{c}_lo") != F.col(f"{c}_hi")
    none = lambda c: F.col(f"{c}_lo").isNull()
    account = account_for_posting(F.coalesce("_acct", F.lit(default_account)))
    reason = F.coalesce(
        F.when(F.col("_no_item") == 1, F.lit("line without item")),
        F.when(F.col("effective_date").isNull(), F.lit("missing effective date")),
        F.when(transfer & (none("_from") | none("_to")), F.lit("missing transfer site")),
        F.when(transfer & (mixed("_from") | mixed("_to")), F.lit("more than one transfer site")),
        F.when(~transfer & none("_site"), F.lit("missing site")),
        F.when(~transfer & mixed("_site"), F.lit("more than one site")),
        F.when(~transfer & (account == ""), F.lit("missing account")),
    )
    whole_memo = memo(F.col("event_type"), F.col("event_id"), F.col("created_by"), F.col("memo"))
    note = _tag("Memo", xml_escape(F.substring(whole_memo, 1, config.MEMO_MAX)))
    date = _tag("TxnDate", F.col("effective_date").cast("string"))
    guid = _tag("ExternalGUID", F.concat(F.lit("{"), F.upper(name_uuid(F.concat(F.lit(guid_prefix), F.col("event_id").cast("string")))), F.lit("}")))
    head = F.when(transfer, F.concat(date, _ref("FromInventorySiteRef", F.col("_from_lo")), _ref("ToInventorySiteRef", F.col("_to_lo")), note)).otherwise(
        F.concat(_ref("AccountRef", account), date, _ref("InventorySiteRef", F.col("_site_lo")), note, guid)
    )
    kind = F.when(transfer, F.lit("TransferInventory")).otherwise(F.lit("InventoryAdjustment"))
    opening = F.concat(F.lit("<"), kind, F.lit('AddRq requestID="'), F.col("event_id").cast("string"), F.lit('"><'), kind, F.lit("Add>"), head)
    closing = F.concat(F.lit("</"), kind, F.lit("Add></"), kind, F.lit("AddRq>"))
    checked = events.select("event_id", "event_type", "line_count", reason.alias("reject_reason"), (F.length(whole_memo) > config.MEMO_MAX).alias("memo_truncated"), opening.alias("_open"), closing.alias("_close"), *(["_pairs"] if whole else []))
    if whole:
        # Of an id with several heads each request has all lines.
        pairs = F.flatten(F.collect_list("_pairs").over(Window.partitionBy("event_id")))
        out = event_parts(checked.where(F.col("event_id").isNotNull()).withColumn("_pairs", pairs), None).withColumn("_body", text_of(F.col("_pairs")))
    else:
        parts = event_parts(rows.select("event_id", "line_id", "_line"), lines_per_part)
        out = checked.join(parts.groupBy("event_id", "chunk_no", "chunk_count").agg(text_of(bodies)), "event_id")
    text = F.concat(
        F.when(F.col("chunk_no") == 1, F.col("_open")).otherwise(F.lit("")), "_body",
        F.when(F.col("chunk_no") == F.col("chunk_count"), F.col("_close")).otherwise(F.lit("")),
    )
    return out.select(
        "event_id", "event_type", "line_count", F.col("chunk_no").alias("part_no"), "reject_reason", "memo_truncated",
        F.when(F.col("reject_reason").isNull(), text).alias("request_xml"),
    )


def event_parts(lines: DataFrame, size: int | None) -> DataFrame:
    """Number an event's lines into parts of at most ``size``; ``None``: one part."""
    if size is None:
        return lines.withColumns({"chunk_no": F.lit(1).cast("bigint"), "chunk_count": F.lit(1).cast("bigint")})
    return chunk_lines(lines, ["event_id"], size, order="line_id", block=F.substring("line_id", 1, 12))


def nest_lines(hydrated: DataFrame, header: Sequence[str], size: int | None = None) -> DataFrame:
    """One row per event, its lines as a sorted array of structs; with ``size``, one per part of so many lines."""
    rest = [c for c in hydrated.columns if c not in header and c != "line_id"]
    body = F.sort_array(F.collect_list(F.struct("line_id", *rest))).alias("lines")
    return event_parts(hydrated, size).groupBy(*header, F.col("chunk_no").alias("part_no")).agg(body)
