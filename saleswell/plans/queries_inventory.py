"""Registered queries: inventory ledger, sync queue, reconciliation, planned events."""

from __future__ import annotations

from pyspark.sql import functions as F

from saleswell.functions import accounts as acc, keys as ky
from saleswell.operators import generators as gen, ledger, maintenance as mt, paging, parity, refusals, syncqueue as sq
from saleswell.operators.ordered import row_numbers
from saleswell.plans.registry import query
from saleswell.session import work_folder
from saleswell.sources.sample import Feeds

NOW = 915_148_800_000  # 1999-01-01 as epoch milliseconds
DAY_MS = 86_400_000

# ------------------------------------------------------------------- balances
_MOVES = """mv AS (SELECT line_id, event_id, sku, location_id, qty AS delta, 0 AS leg FROM v_event_line WHERE from_location_id IS NULL
    UNION ALL SELECT line_id, event_id, sku, from_location_id, -qty, 0 FROM v_event_line WHERE from_location_id IS NOT NULL
    UNION ALL SELECT line_id, event_id, sku, to_location_id, qty, 1 FROM v_event_line WHERE from_location_id IS NOT NULL)"""
_BAL = f"{_MOVES}, bal AS (SELECT sku, location_id, SUM(delta) AS on_hand FROM mv WHERE event_id IN (SELECT event_id FROM v_event WHERE status = 'committed') GROUP BY 1, 2)"
_ACTIVE = "coalesce(is_active, lower(active_status) = 'active', false)"


def bal(f: Feeds):
    return ledger.balances(ledger.committed_lines(f.event_line, f.event))


@query("balances", f"WITH {_BAL} SELECT sku, location_id, on_hand, CAST(0 AS DOUBLE) AS reserved, on_hand AS available FROM bal")
def balances(f):
    return bal(f)


@query("onhand_by_sku", f"WITH {_BAL} SELECT sku, SUM(on_hand) AS on_hand FROM bal GROUP BY 1")
def onhand_by_sku(f):
    return ledger.onhand_totals(bal(f))


@query("onhand_requested", f"""WITH {_BAL}, w AS (SELECT DISTINCT trim(sku) AS sku FROM (SELECT sku FROM v_part_master UNION ALL SELECT ' GONE-' || sku FROM v_part_master) q)
    SELECT sku, coalesce(s, 0) AS on_hand FROM w LEFT JOIN (SELECT sku, SUM(on_hand) AS s FROM bal WHERE location_id = 3 GROUP BY 1) t USING (sku)""")
def onhand_requested(f):
    p = f.part_master.select("sku")
    asked = p.unionByName(p.select(F.concat(F.lit(" GONE-"), "sku").alias("sku")))
    return ledger.onhand_for(bal(f), asked, location_id=3)


_OVERVIEW = f"""ov AS (SELECT p.sku, p.description, CASE WHEN trim(income_account) <> '' THEN income_account ELSE category END AS category, reorder_point,
    {_ACTIVE} AS active, coalesce(s, 0) AS on_hand, CAST(0 AS DOUBLE) AS reserved, coalesce(s, 0) AS available, coalesce(s, 0) <= reorder_point AS low_stock
    FROM v_part_master p LEFT JOIN (SELECT sku, SUM(on_hand) AS s FROM bal GROUP BY 1) b USING (sku))"""


def overview(f):
    out = ledger.inventory_overview(f.part_master, bal(f))
    return out


@query("inventory_overview", f"WITH {_BAL}, {_OVERVIEW} SELECT * FROM ov")
def inventory_overview(f):
    return overview(f)


@query("overview_cards", f"WITH {_BAL}, {_OVERVIEW} SELECT COUNT(*) AS skus, SUM(on_hand) AS on_hand, SUM(available) AS available, COUNT(*) FILTER (low_stock) AS low_stock FROM ov")
def overview_cards(f):
    return ledger.overview_cards(overview(f))


@query("paged_overview", f"WITH {_BAL}, {_OVERVIEW} SELECT sku, on_hand FROM ov ORDER BY lower(sku), sku LIMIT 25 OFFSET 50")
def paged_overview(f):
    return ledger.page(overview(f), [F.lower("sku"), "sku"], number=3, size=25).select("sku", "on_hand")


@query("paged_rank_index", f"""WITH {_BAL}, {_OVERVIEW}, n AS (SELECT sku, on_hand, row_number() OVER (ORDER BY lower(sku), sku) AS rank, COUNT(*) OVER () AS total FROM ov)
    SELECT rank, sku, on_hand, CAST((total + 24) // 25 AS BIGINT) AS pages FROM n WHERE rank BETWEEN 126 AND 150""")
def paged_rank_index(f):
    """The sixth page and the number of pages, from an index of blocks written once."""
    table = work_folder(f.spark, "rank-index")
    paging.build(overview(f), [F.lower("sku"), "sku"], table, rows_per_block=64)
    return paging.page(f.spark, table, 6, 25).select("rank", "sku", "on_hand", F.lit(paging.pages(f.spark, table, 25)).cast("bigint").alias("pages"))


@query("search_parts", f"SELECT sku, description FROM v_part_master WHERE {_ACTIVE} AND (lower(sku) LIKE '%5%' OR lower(description) LIKE '%red%')")
def search_parts(f):
    hits = ledger.search_parts(f.part_master, "5").select("sku", "description")
    return hits.unionByName(ledger.search_parts(f.part_master, " RED ").select("sku", "description")).distinct()


@query("part_accounts", f"""SELECT sku, CASE WHEN trim(income_account) <> '' THEN income_account ELSE category END AS account, {_ACTIVE} AS active FROM v_part_master""")
def part_accounts(f):
    return f.part_master.select(
        "sku", ledger.income_account(F.col("income_account"), F.col("category")).alias("account"),
        ledger.is_active(F.col("is_active"), F.col("active_status")).alias("active"))


@query("lookup_parts", "SELECT sku, opening_qty FROM v_part_master WHERE sku IN (SELECT DISTINCT sku FROM v_event_line WHERE qty > 40)")
def lookup_parts(f):
    lines = f.event_line.where("qty > 40").select("sku")
    return ledger.lookup_parts(f.part_master, lines.unionByName(lines.select(F.concat(F.lit("no-"), "sku").alias("sku"))))


@query("item_detail", """SELECT l.sku, l.event_id, l.line_id, e.event_type, e.status, e.qb_status, e.created_at, l.qty, l.new_qty, o.code AS location_code
    FROM v_event_line l JOIN v_event e USING (event_id) LEFT JOIN v_location o ON o.location_id = coalesce(l.location_id, l.from_location_id, l.to_location_id)
    WHERE l.sku IN (SELECT sku FROM v_part_master)""")
def item_detail(f):
    return ledger.item_detail(f.event_line, f.event, f.location, f.part_master)


# --------------------------------------------------------------------- replay
def sequenced(f):
    return dated(f)(f.event_line)


def dated(f):
    """Gives event lines their place in the order."""
    return lambda lines: lines.join(f.event.select("event_id", F.col("created_at").alias("seq")), "event_id")


def block():
    """Blocks of one day: never decreasing along the creation time."""
    return F.floor(F.col("seq") / DAY_MS)


@query("running_balance", f"""WITH {_MOVES}, r AS (SELECT m.*, e.created_at AS seq, SUM(delta) OVER (PARTITION BY sku, location_id
        ORDER BY e.created_at, line_id, leg, delta ROWS UNBOUNDED PRECEDING) AS balance FROM mv m JOIN v_event e USING (event_id))
    SELECT sku, location_id, line_id, CAST(leg AS INTEGER) AS leg, delta, balance, balance < -1e-9 AS negative FROM r""")
def running_balance(f):
    return ledger.running_balance(sequenced(f), "seq", block()).select("sku", "location_id", "line_id", "leg", "delta", "balance", "negative")


_REQ = """rq AS (SELECT l.sku, l.location_id, l.line_id, e.created_at * 10 + row_number() OVER (PARTITION BY l.event_id ORDER BY l.line_id) AS seq,
    CASE WHEN l.new_qty IS NULL THEN l.qty ELSE 0 END AS delta, l.new_qty AS set_to FROM v_event_line l JOIN v_event e USING (event_id) WHERE l.location_id IS NOT NULL),
  sg AS (SELECT *, COUNT(set_to) OVER (PARTITION BY sku, location_id ORDER BY seq, line_id ROWS UNBOUNDED PRECEDING) AS seg FROM rq),
  bl AS (SELECT *, SUM(CASE WHEN set_to IS NOT NULL THEN set_to ELSE delta END) OVER (PARTITION BY sku, location_id, seg ORDER BY seq, line_id ROWS UNBOUNDED PRECEDING) AS balance FROM sg)"""


def requests(f):
    """Adjustment lines in order; set-mode ones carry the new quantity."""
    lines = sequenced(f).where(F.col("location_id").isNotNull())
    order = F.struct("seq", "line_id").alias("ord")
    return lines.select("sku", "location_id", "line_id", "seq", order, F.when(F.col("new_qty").isNull(), F.col("qty")).otherwise(0.0).alias("delta"), F.col("new_qty").alias("set_to"))


@query("ledger_replay", f"WITH {_REQ} SELECT sku, location_id, line_id, balance FROM bl")
def ledger_replay(f):
    return ledger.replay_requests(requests(f), "ord", block()).select("sku", "location_id", "line_id", "balance")


@query("ledger_balances", f"WITH {_REQ} SELECT sku, location_id, max_by(balance, (seq, line_id)) AS on_hand FROM bl GROUP BY 1, 2")
def ledger_balances(f):
    return ledger.final_balances(ledger.replay_requests(requests(f), "ord", block()), "ord")


_WALK = """RECURSIVE rq AS (
    SELECT l.sku, e.created_at * 10 + row_number() OVER (PARTITION BY l.event_id ORDER BY l.line_id) AS seq, l.line_id, l.qty, l.new_qty,
      CASE WHEN l.from_location_id IS NOT NULL THEN 'transfer' WHEN l.new_qty IS NOT NULL THEN 'set' ELSE 'delta' END AS mode,
      l.location_id, l.from_location_id, l.to_location_id FROM v_event_line l JOIN v_event e USING (event_id)),
  od AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY seq, line_id) AS n FROM rq),
  wk AS (
    SELECT sku, CAST(0 AS BIGINT) AS n, MAP([CAST(-1 AS BIGINT)], [CAST(0 AS DOUBLE)]) AS held, CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b,
      CAST(NULL AS DOUBLE) AS da, CAST(NULL AS DOUBLE) AS db, CAST(NULL AS BOOLEAN) AS fits FROM (SELECT DISTINCT sku FROM od) q
    UNION ALL
    SELECT sku, n, CASE WHEN NOT fits THEN held WHEN mode = 'transfer' THEN map_concat(map_concat(held, MAP([a], [greatest(ba + da, 0)])), MAP([b], [greatest(CASE WHEN a = b THEN ba + da ELSE bb END + db, 0)]))
      ELSE map_concat(held, MAP([a], [greatest(ba + da, 0)])) END, mode, a, b, da, db, fits
    FROM (SELECT *, ba + da >= -1e-9 AND (mode <> 'transfer' OR bb + db >= -1e-9) AS fits
      FROM (SELECT *, CASE mode WHEN 'transfer' THEN -qty WHEN 'set' THEN new_qty - ba ELSE qty END AS da, qty AS db
        FROM (SELECT o.sku, o.n, o.mode, o.qty, o.new_qty, k.held, coalesce(o.from_location_id, o.location_id) AS a, o.to_location_id AS b,
            coalesce(k.held[coalesce(o.from_location_id, o.location_id)], 0) AS ba, coalesce(k.held[o.to_location_id], 0) AS bb
          FROM wk k JOIN od o ON o.sku = k.sku AND o.n = k.n + 1) x) y) z),
  rj AS (
    SELECT w.sku, o.seq, o.line_id, w.a AS location_id, w.da AS delta, w.held[w.a] AS h, w.fits FROM wk w JOIN od o ON o.sku = w.sku AND o.n = w.n WHERE w.mode <> 'transfer'
    UNION ALL SELECT w.sku, o.seq, o.line_id, w.a, w.da, CASE WHEN w.fits AND w.a = w.b THEN w.held[w.a] - w.db ELSE w.held[w.a] END, w.fits FROM wk w JOIN od o ON o.sku = w.sku AND o.n = w.n WHERE w.mode = 'transfer'
    UNION ALL SELECT w.sku, o.seq, o.line_id, w.b, w.db, w.held[w.b], w.fits FROM wk w JOIN od o ON o.sku = w.sku AND o.n = w.n WHERE w.mode = 'transfer')"""


def change_requests(f):
    """All event lines as requests, not yet in order."""
    mode = F.when(F.col("from_location_id").isNotNull(), "transfer").when(F.col("new_qty").isNotNull(), "set").otherwise("delta")
    return f.event_line.withColumn("mode", mode)


@query("ledger_reject", f"WITH {_WALK} SELECT sku, line_id, location_id, delta, coalesce(h, 0) AS on_hand, fits AS accepted, CASE WHEN NOT fits THEN 'below zero' END AS reason FROM rj")
def ledger_reject(f):
    """Every change of the log, decided: those that would take a location below zero are refused."""
    return refusals.decide(change_requests(f), block(), dated(f)).drop("seq")


@query("ledger_reject_adjustments", f"WITH {_WALK.replace('JOIN v_event e USING (event_id))', 'JOIN v_event e USING (event_id) WHERE l.location_id IS NOT NULL)')} SELECT sku, line_id, location_id, delta, coalesce(h, 0) AS on_hand, fits AS accepted FROM rj")
def ledger_reject_adjustments(f):
    """Adjustments alone: no transfer couples locations, so every hot SKU goes by block functions."""
    return refusals.decide(change_requests(f).where("mode <> 'transfer'"), block(), dated(f)).drop("seq", "reason")


_TO_VOID = "e.event_id % 7 = 3"


@query("void_replay", f"""WITH {_MOVES} SELECT m.sku, m.location_id, SUM(delta * CASE WHEN {_TO_VOID} AND e.status <> 'voided' AND e.qb_status NOT IN ('in_flight', 'applied') THEN 0 ELSE 1 END) AS on_hand
    FROM mv m JOIN v_event e USING (event_id) GROUP BY 1, 2""")
def void_replay(f):
    lines = f.event_line
    undone, _ = ledger.void_lines(f.event, lines, f.event.where("event_id % 7 = 3"))
    return ledger.balances(lines.unionByName(undone.select(*lines.columns))).select("sku", "location_id", "on_hand")


@query("void_outcome", f"""SELECT e.event_id, CASE WHEN e.status = 'voided' THEN 'unchanged' WHEN e.qb_status IN ('in_flight', 'applied') THEN 'refused' ELSE 'voided' END AS outcome
    FROM v_event e WHERE {_TO_VOID}""")
def void_outcome(f):
    return ledger.void_lines(f.event, f.event_line, f.event.where("event_id % 7 = 3"))[1]


_VREQ = """vr AS (SELECT l.line_id, CASE WHEN e.event_type = 'transfer' THEN 'transfer' WHEN l.new_qty IS NOT NULL THEN 'set' ELSE 'delta' END AS mode,
      CASE WHEN l.event_id % 31 = 0 THEN '1999/1/1' ELSE CAST(e.effective_date AS VARCHAR) END AS effective_date,
      CASE WHEN l.event_id % 23 = 0 THEN '  ' WHEN l.event_id % 29 = 0 THEN 'none' ELSE l.sku END AS sku,
      CASE WHEN l.event_id % 37 = 0 THEN NULL WHEN l.event_id % 41 = 0 THEN -l.qty WHEN l.event_id % 43 = 0 THEN 0 ELSE l.qty END AS qty,
      CASE WHEN l.event_id % 13 = 0 THEN -l.new_qty ELSE l.new_qty END AS new_qty, l.location_id, l.from_location_id, l.to_location_id FROM v_event_line l JOIN v_event e USING (event_id))"""


def raw_requests(f):
    rows = f.event_line.join(f.event.select("event_id", "event_type", "effective_date"), "event_id")
    e = F.col("event_id")
    return rows.select(
        "event_id", "line_id", F.when(F.col("event_type") == "transfer", "transfer").when(F.col("new_qty").isNotNull(), "set").otherwise("delta").alias("mode"),
        F.when(e % 31 == 0, F.lit("1999/1/1")).otherwise(F.col("effective_date").cast("string")).alias("effective_date"),
        F.when(e % 23 == 0, F.lit("  ")).when(e % 29 == 0, F.lit("none")).otherwise(F.col("sku")).alias("sku"),
        F.when(e % 37 == 0, None).when(e % 41 == 0, -F.col("qty")).when(e % 43 == 0, 0.0).otherwise(F.col("qty")).alias("qty"),
        F.when(e % 13 == 0, -F.col("new_qty")).otherwise(F.col("new_qty")).alias("new_qty"), "location_id", "from_location_id", "to_location_id")


_RULES = {
    "bad_date": "NOT regexp_matches(v.effective_date, '^\\d{4}-\\d{2}-\\d{2}$')", "empty_sku": "trim(v.sku) = ''",
    "unknown_sku": "trim(v.sku) <> '' AND NOT EXISTS (SELECT 1 FROM v_part_master p WHERE p.sku = trim(v.sku))",
    "qty_missing": "v.mode IN ('transfer', 'delta') AND v.qty IS NULL", "qty_not_positive": "v.mode = 'transfer' AND v.qty <= 0",
    "same_location": "v.mode = 'transfer' AND v.from_location_id IS NOT DISTINCT FROM v.to_location_id",
    "qty_zero": "v.mode = 'delta' AND abs(v.qty) < 1e-9", "new_qty_negative": "v.mode = 'set' AND v.new_qty < 0",
    "inactive_location": "CASE WHEN v.mode = 'transfer' THEN NOT coalesce((SELECT active FROM v_location o WHERE o.location_id = v.from_location_id), false) OR NOT coalesce((SELECT active FROM v_location o WHERE o.location_id = v.to_location_id), false) ELSE NOT coalesce((SELECT active FROM v_location o WHERE o.location_id = v.location_id), false) END",
}


@query("validate_lines", f"""WITH {_VREQ} SELECT line_id, mode, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES.items())}) AS reasons FROM vr v""")
def validate_lines(f):
    out = ledger.validate_lines(raw_requests(f), f.part_master, f.location)
    return out.select("line_id", "mode", F.array_join("reject_reasons", ",").alias("reasons"))


@query("approval_gate", """WITH r AS (SELECT event_id, line_id, qty, CASE WHEN from_location_id IS NULL AND new_qty IS NOT NULL THEN 'set' ELSE 'delta' END AS mode FROM v_event_line),
    g AS (SELECT event_id, bool_or(mode = 'set') AS s, bool_or(abs(qty) >= 25) AS b, min_by(qty, line_id) FILTER (abs(qty) >= 25) AS q FROM r GROUP BY 1)
    SELECT event_id, s OR b AS needs_approval, CASE WHEN s THEN 'set-mode adjustments require approval' WHEN b THEN 'line qty ' || printf('%.1f', q) || ' exceeds threshold 25.0' END AS reason FROM g""")
def approval_gate(f):
    mode = F.when(F.col("from_location_id").isNull() & F.col("new_qty").isNotNull(), "set").otherwise("delta")
    return ledger.approval_gate(f.event_line.withColumn("mode", mode))


@query("approval_status", """SELECT user_id AS request_id, max_by(status, (ts, step)) AS status, max(ts) AS last_change, COUNT(*) AS changes FROM (SELECT user_id, ts, event_id AS step,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'approved' WHEN 'click' THEN 'rejected' ELSE 'error' END AS status FROM events) q GROUP BY 1""")
def approval_status(f):
    status = F.expr("CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'approved' WHEN 'click' THEN 'rejected' ELSE 'error' END")
    return ledger.approval_status(f.events.select(F.col("user_id").alias("request_id"), "ts", F.col("event_id").alias("step"), status.alias("status")))


# ----------------------------------------------------------------- sync queue
@query("next_pending", f"""SELECT event_id, retry_at, created_at FROM v_event WHERE qb_status = 'pending' AND retry_at <= {NOW} AND status = 'committed' ORDER BY retry_at, created_at, event_id LIMIT 20""")
def next_pending(f):
    return sq.next_pending(f.event, NOW, 20).select("event_id", "retry_at", "created_at")


_RES = """rs AS (SELECT l_orderkey AS event_id, l_linenumber AS seq, CAST(l_partkey * 1000 AS BIGINT) + l_suppkey AS at_ms, l_returnflag <> 'R' AND l_linenumber <> 7 AS success,
    CASE WHEN l_suppkey % 5 = 0 THEN '3140' WHEN l_suppkey % 5 = 1 THEN NULL ELSE '500' END AS error_code, CASE WHEN l_linenumber = 4 THEN false END AS retryable FROM lineitem),
  f AS (SELECT event_id, CAST(COUNT(*) FILTER (NOT success) AS INTEGER) AS fails, max_by((success, at_ms), (at_ms, seq)) AS lst,
    max_by((coalesce(error_code, 'UNKNOWN'), coalesce(retryable, true), at_ms, coalesce(error_code, '') NOT IN ('3100', '3140', '3170', '3200', '3250')), (at_ms, seq)) FILTER (NOT success) AS fl FROM rs GROUP BY 1),
  st AS (SELECT e.*, f.lst, f.fl, e.retry_count + coalesce(fails, 0) AS cnt FROM v_event e LEFT JOIN f USING (event_id)),
  s2 AS (SELECT *, coalesce(fl[2], true) AND coalesce(fl[4], true) AND cnt < 10 AS again FROM st)"""


def results(f):
    return f.lineitem.select(
        F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("at_ms"),
        ((F.col("l_returnflag") != "R") & (F.col("l_linenumber") != 7)).alias("success"),
        F.when(F.col("l_suppkey") % 5 == 0, "3140").when(F.col("l_suppkey") % 5 != 1, "500").alias("error_code"),
        F.when(F.col("l_linenumber") == 4, F.lit(False)).alias("retryable"))


_REPLAYED = f"""{_RES}, q2 AS (SELECT event_id, CASE WHEN lst IS NULL THEN qb_status WHEN lst[1] THEN 'applied' WHEN again THEN 'pending' ELSE 'error' END AS qb_status,
    CASE WHEN lst IS NULL THEN error_code WHEN lst[1] THEN NULL ELSE fl[1] END AS error_code, CAST(cnt AS INTEGER) AS retry_count,
    CASE WHEN fl IS NOT NULL THEN fl[3] + CASE WHEN again THEN 1000 * [60, 300, 900, 3600][least(greatest(cnt - 1, 0), 3) + 1] ELSE 0 END ELSE retry_at END AS retry_at,
    coalesce(lst[2], last_attempt_at) AS last_attempt_at FROM s2)"""


@query("queue_replay", f"WITH {_REPLAYED} SELECT * FROM q2")
def queue_replay(f):
    return sq.apply_results(f.event, results(f)).select("event_id", "qb_status", "error_code", "retry_count", "retry_at", "last_attempt_at")


_ASKED = """aq AS (SELECT CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS event_id, CASE WHEN l_linenumber = 6 THEN ' ' ELSE ' t' || CAST(l_suppkey AS VARCHAR) END AS ticket,
    CAST(l_partkey * 1000 AS BIGINT) + l_linenumber AS at_ms FROM lineitem),
  ao AS (SELECT aq.event_id, trim(ticket) AS ticket, at_ms, CASE WHEN trim(ticket) = '' THEN 'ticket required' WHEN e.event_id IS NULL THEN 'event not found' WHEN status <> 'committed' THEN 'not committed'
    WHEN qb_status NOT IN ('pending', 'in_flight') THEN 'not eligible' ELSE 'marked' END AS outcome FROM aq LEFT JOIN v_event e USING (event_id))"""


def marked(f):
    n = F.col("l_linenumber")
    asked = f.lineitem.select(
        F.when(n == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("event_id"),
        F.when(n == 6, F.lit(" ")).otherwise(F.concat(F.lit(" t"), F.col("l_suppkey").cast("string"))).alias("ticket"),
        (F.col("l_partkey") * 1000 + n).cast("bigint").alias("at_ms"))
    return sq.mark_in_flight(f.event, asked)


@query("mark_in_flight", f"""WITH {_ASKED}, m AS (SELECT event_id, max(at_ms) AS marked_at FROM ao WHERE outcome = 'marked' GROUP BY 1)
    SELECT event_id, CASE WHEN marked_at IS NULL THEN qb_status ELSE 'in_flight' END AS qb_status, coalesce(marked_at, last_attempt_at) AS last_attempt_at FROM v_event LEFT JOIN m USING (event_id)""")
def mark_in_flight(f):
    return marked(f)[0].select("event_id", "qb_status", "last_attempt_at")


@query("mark_outcomes", f"WITH {_ASKED} SELECT * FROM ao")
def mark_outcomes(f):
    return marked(f)[1]


@query("sync_sessions", f"""WITH {_ASKED} SELECT ticket, min(at_ms) AS started_at, max(at_ms) AS last_seen_at, max_by(event_id, (at_ms, event_id)) AS in_flight_event_id
    FROM ao WHERE outcome = 'marked' GROUP BY 1""")
def sync_sessions(f):
    return marked(f)[2]


@query("stale_in_flight", f"""SELECT event_id, CASE WHEN s THEN 'pending' ELSE qb_status END AS qb_status, CASE WHEN s THEN {NOW} ELSE retry_at END AS retry_at, s AS released
    FROM (SELECT *, qb_status = 'in_flight' AND coalesce(last_attempt_at, created_at) <= {NOW} - 600000 AS s FROM v_event) q""")
def stale_in_flight(f):
    return sq.release_stale(f.event, NOW).select("event_id", "qb_status", "retry_at", "released")


@query("release_backoff", f"""SELECT event_id, CASE WHEN h THEN {NOW} ELSE retry_at END AS retry_at, h AS released FROM (SELECT *, qb_status = 'pending' AND status = 'committed' AND retry_at > {NOW}
    AND coalesce(created_by, '') = 'user3' AND coalesce(error_code, '') = '500' AS h FROM v_event) q""")
def release_backoff(f):
    return sq.release_backoff(f.event, NOW, "user3", "500").select("event_id", "retry_at", "released")


@query("retry_failed", f"""SELECT event_id, CASE WHEN g THEN 'pending' ELSE qb_status END AS qb_status, CASE WHEN g THEN NULL ELSE error_code END AS error_code FROM
    (SELECT *, event_id % 2 = 0 AND qb_status = 'error' AS g FROM v_event) q""")
def retry_failed(f):
    return sq.retry_failed(f.event, f.event.where("event_id % 2 = 0"), NOW).select("event_id", "qb_status", "error_code")


@query("queue_summary", "SELECT s AS qb_status, COUNT(event_id) AS events FROM (SELECT unnest(['not_ready', 'pending', 'in_flight', 'applied', 'error']) AS s) a LEFT JOIN v_event ON qb_status = s GROUP BY 1")
def queue_summary(f):
    return sq.queue_summary(f.event)


@query("recent_events", """WITH n AS (SELECT * FROM v_event ORDER BY created_at DESC, event_id LIMIT 25)
    SELECT n.event_id, event_type, status, qb_status, effective_date, created_at, created_by, memo, COUNT(l.line_id) AS line_count FROM n LEFT JOIN v_event_line l USING (event_id) GROUP BY ALL""")
def recent_events(f):
    return sq.recent_events(f.event, f.event_line, 25)


@query("events_by_author", """SELECT event_id, created_at, created_by, qb_status, status, memo FROM v_event WHERE created_by = 'user2' AND qb_status IN ('pending', 'error')""")
def events_by_author(f):
    return sq.events_by_author(f.event, " user2 ", ["pending", "error", "nonsense"])


_ZERO = """z AS (SELECT DISTINCT location_id, sku FROM v_event_line JOIN v_event USING (event_id) WHERE event_type = 'adjustment' AND status = 'committed'
    AND created_by = 'zero-cleanup' AND new_qty = 0 AND location_id IS NOT NULL)"""


def zero_pairs(f):
    return sq.zero_coverage(f.event, f.event_line, "zero-cleanup")


@query("queue_coverage", f"WITH {_ZERO} SELECT location_id, COUNT(*) AS queued_sku_count FROM z GROUP BY 1")
def queue_coverage(f):
    return sq.queue_coverage(zero_pairs(f))


@query("dup_events", """SELECT event_id, memo, created_at FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(memo, '') ORDER BY created_at DESC, event_id DESC) AS rn FROM v_event) q WHERE rn > 1""")
def dup_events(f):
    return sq.duplicate_events(f.event).select("event_id", "memo", "created_at")


_HYDRATED = """h AS (SELECT l.event_id, l.line_id, e.event_type, e.effective_date, e.created_by, e.memo, l.sku, l.qty, l.new_qty, l.reason_code,
    coalesce(r.account_full_name, p.cogs_account) AS account_full_name, coalesce(p.item_full_name, l.sku) AS item_full_name, p.income_account, p.cogs_account, p.asset_account,
    p.description AS sales_description, p.price AS sales_price, p.cost AS purchase_cost, o.site_name, a.site_name AS from_site_name, b.site_name AS to_site_name
  FROM v_event_line l JOIN v_event e USING (event_id) LEFT JOIN v_part_master p ON p.sku = l.sku LEFT JOIN v_reason r ON r.reason_code = l.reason_code
    LEFT JOIN v_location o ON o.location_id = l.location_id LEFT JOIN v_location a ON a.location_id = l.from_location_id LEFT JOIN v_location b ON b.location_id = l.to_location_id)"""


def hydrated(f):
    return sq.hydrate(f.event, f.event_line, f.part_master, f.location, f.reason)


@query("hydrate_events", f"WITH {_HYDRATED} SELECT * FROM h")
def hydrate_events(f):
    return hydrated(f)


@query("nested_events", f"WITH {_HYDRATED} SELECT *, CAST(1 AS BIGINT) AS part_no, CAST(COUNT(*) OVER (PARTITION BY event_id) AS INTEGER) AS line_count FROM h")
def nested_events(f):
    """Nested and taken apart again: every event keeps its header, its lines and their fields."""
    header = ["event_id", "event_type", "effective_date"]
    nested = gen.nest_lines(hydrated(f), header)
    return nested.select(*header, "part_no", F.size("lines").alias("line_count"), F.inline("lines"))


_ESC = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_NUM = lambda c: rf"regexp_replace(regexp_replace(CAST(CAST({c} AS DECIMAL(28,8)) AS VARCHAR), '0+$', ''), '\.$', '')"
_TAG = lambda name, *parts: f"'<{name}>' || {' || '.join(parts)} || '</{name}>'"
_FULL = lambda name, c: _TAG(name, _TAG("FullName", _ESC(c)))
_ROOT = "trim(split_part(acct, ':', 1))"
_POSTED = f"array_to_string(list_filter(list_transform(string_split(CASE WHEN acct LIKE '%:%' AND lower({_ROOT}) LIKE 'cog%' THEN {_ROOT} ELSE trim(acct) END, ':'), lambda s: trim(s)), lambda s: s <> ''), ':')"
_BRACED = """'{' || upper(concat_ws('-', k[1:8], k[9:12], '5' || k[14:16], substr('89ab', CAST(strpos('0123456789abcdef', k[17:17]) - 1 AS INTEGER) % 4 + 1, 1) || k[18:20], k[21:32])) || '}'"""
_RENDERED = f"""{_HYDRATED}, x AS (SELECT *, trim(coalesce(item_full_name, sku)) AS item, CASE WHEN event_type = 'transfer' THEN
      {_TAG('TransferInventoryLineAdd', _FULL('ItemRef', "trim(coalesce(item_full_name, sku))"), _TAG('QuantityToTransfer', _NUM('coalesce(qty, 0)')))}
      ELSE {_TAG('InventoryAdjustmentLineAdd', _FULL('ItemRef', "trim(coalesce(item_full_name, sku))"),
        _TAG('QuantityAdjustment', f"CASE WHEN new_qty IS NOT NULL THEN {_TAG('NewQuantity', _NUM('new_qty'))} ELSE {_TAG('QuantityDifference', _NUM('coalesce(qty, 0)'))} END"))} END AS line FROM h),
  g AS (SELECT event_id, event_type, effective_date, created_by, memo, COUNT(*) AS line_count, string_agg(line, '' ORDER BY line_id) AS body, bool_or(item = '') AS no_item,
      min(site_name) AS s, min(from_site_name) AS sf, min(to_site_name) AS st, COUNT(DISTINCT site_name) AS ns, COUNT(DISTINCT from_site_name) AS nf, COUNT(DISTINCT to_site_name) AS nt,
      coalesce(arg_min(trim(account_full_name), line_id) FILTER (trim(account_full_name) <> ''), 'COGS:Inventory Adjustment') AS acct,
      trim(concat_ws(' ', nullif(event_type, ''), CAST(event_id AS VARCHAR), nullif(created_by, ''), nullif(memo, ''))) AS note,
      sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('inventory:' || CAST(event_id AS VARCHAR))) AS k FROM x GROUP BY ALL),
  y AS (SELECT *, CASE WHEN no_item THEN 'line without item' WHEN effective_date IS NULL THEN 'missing effective date'
      WHEN event_type = 'transfer' AND (nf = 0 OR nt = 0) THEN 'missing transfer site' WHEN event_type = 'transfer' AND (nf > 1 OR nt > 1) THEN 'more than one transfer site'
      WHEN event_type <> 'transfer' AND ns = 0 THEN 'missing site' WHEN event_type <> 'transfer' AND ns > 1 THEN 'more than one site' END AS reject_reason,
      {_TAG('TxnDate', 'CAST(effective_date AS VARCHAR)')} AS day, {_TAG('Memo', _ESC('substr(note, 1, 4095)'))} AS said FROM g)"""


@query("render_events", f"""WITH {_RENDERED} SELECT event_id, event_type, line_count, CAST(1 AS BIGINT) AS part_no, reject_reason, length(note) > 4095 AS memo_truncated, CASE WHEN reject_reason IS NULL THEN
    CASE WHEN event_type = 'transfer' THEN '<TransferInventoryAddRq requestID="' || CAST(event_id AS VARCHAR) || '">' || {_TAG('TransferInventoryAdd', 'day', _FULL('FromInventorySiteRef', 'sf'), _FULL('ToInventorySiteRef', 'st'), 'said', 'body')} || '</TransferInventoryAddRq>'
    ELSE '<InventoryAdjustmentAddRq requestID="' || CAST(event_id AS VARCHAR) || '">' || {_TAG('InventoryAdjustmentAdd', _FULL('AccountRef', _POSTED), 'day', _FULL('InventorySiteRef', 's'), 'said', _TAG('ExternalGUID', _BRACED), 'body')} || '</InventoryAdjustmentAddRq>' END END AS request_xml FROM y""")
def render_events(f):
    return gen.render_events(hydrated(f), "COGS:Inventory Adjustment")


@query("render_status", f"""WITH {_HYDRATED}, g AS (SELECT event_id, event_type, COUNT(*) AS line_count, COUNT(DISTINCT site_name) AS ns, COUNT(DISTINCT from_site_name) AS nf, COUNT(DISTINCT to_site_name) AS nt FROM h GROUP BY 1, 2)
    SELECT event_id, event_type, line_count, CASE WHEN event_type = 'transfer' AND (nf = 0 OR nt = 0) THEN 'missing transfer site' WHEN event_type = 'transfer' AND (nf > 1 OR nt > 1) THEN 'more than one transfer site'
      WHEN event_type <> 'transfer' AND ns = 0 THEN 'missing site' WHEN event_type <> 'transfer' AND ns > 1 THEN 'more than one site' END AS reject_reason FROM g""")
def render_status(f):
    return gen.render_events(hydrated(f), "COGS:Inventory Adjustment").drop("request_xml", "part_no", "memo_truncated")


_PAIRS = """mp AS (SELECT sku AS from_sku, sku || 'R' AS to_sku FROM v_part_master WHERE reorder_point % 3 = 0)"""
_TOUCH = f"""{_PAIRS}, tl AS (SELECT l.line_id, l.event_id, l.sku AS from_sku, mp.to_sku FROM v_event_line l JOIN v_event e USING (event_id) JOIN mp ON lower(mp.from_sku) = lower(l.sku)
    WHERE e.created_by = 'zero-cleanup' AND e.qb_status IN ('error', 'in_flight'))"""


def remapped(f):
    mapping = f.part_master.where("reorder_point % 3 = 0").select(F.upper("sku").alias("from_sku"), F.concat("sku", F.lit("R")).alias("to_sku"))
    return sq.remap_requeue(f.event, f.event_line, mapping, "zero-cleanup", ["error", "in_flight"], NOW)


@query("remap_requeue", f"""WITH {_TOUCH} SELECT event_id, CASE WHEN t THEN 'pending' ELSE qb_status END AS qb_status, CASE WHEN t THEN {NOW} ELSE retry_at END AS retry_at,
    CASE WHEN t AND qb_status = 'error' THEN NULL ELSE error_code END AS error_code FROM (SELECT *, event_id IN (SELECT event_id FROM tl) AS t FROM v_event) q""")
def remap_requeue(f):
    return remapped(f)[1].select("event_id", "qb_status", "retry_at", "error_code")


@query("remap_lines", f"WITH {_TOUCH} SELECT l.line_id, coalesce(tl.to_sku, l.sku) AS sku FROM v_event_line l LEFT JOIN tl USING (line_id)")
def remap_lines(f):
    return remapped(f)[0].select("line_id", "sku")


@query("remap_counts", f"WITH {_TOUCH} SELECT from_sku, to_sku, COUNT(*) AS lines FROM tl GROUP BY 1, 2")
def remap_counts(f):
    return remapped(f)[2]


# ------------------------------------------------------------- reconciliation
_MATCH = """cand AS (SELECT sku, 0 AS pr, lower(trim(item_full_name)) AS k FROM v_part_master UNION ALL
      SELECT sku, 1, CASE WHEN item_full_name LIKE '%:%' THEN lower(trim(regexp_extract(item_full_name, '([^:]*)$', 1))) END FROM v_part_master UNION ALL SELECT sku, 2, lower(trim(sku)) FROM v_part_master),
  ik AS (SELECT k, min(item_full_name) AS n FROM (SELECT lower(trim(item_full_name)) AS k, item_full_name FROM v_item UNION ALL
      SELECT lower(trim(regexp_extract(item_full_name, '([^:]*)$', 1))), item_full_name FROM v_item WHERE item_full_name LIKE '%:%') q GROUP BY 1),
  mt AS (SELECT p.sku, (SELECT arg_min(ik.n, c.pr) FROM cand c JOIN ik ON ik.k = c.k WHERE c.sku = p.sku) AS matched_name FROM v_part_master p)"""


def matches(f):
    return parity.match_items(f.part_master, f.item)


@query("item_match", f"WITH {_MATCH} SELECT * FROM mt")
def item_match(f):
    return matches(f)


@query("missing_both_ways", f"""WITH {_MATCH} SELECT 'parts' AS side, sku AS name FROM mt WHERE matched_name IS NULL
    UNION ALL SELECT 'items', item_full_name FROM v_item WHERE item_full_name NOT IN (SELECT matched_name FROM mt WHERE matched_name IS NOT NULL)""")
def missing_both_ways(f):
    m = matches(f)
    ours = parity.missing_in_items(f.part_master, m).select(F.lit("parts").alias("side"), F.col("sku").alias("name"))
    theirs = parity.missing_in_parts(f.item, m).select(F.lit("items").alias("side"), F.col("item_full_name").alias("name"))
    return ours.unionByName(theirs)


_SEG = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(s), '&', ' and '), 'cog''s', 'cogs'), '-[0-9a-f]{6}$', ''), '^\d+\s*[·\-]\s*', ''), '\s+', ' ', 'g'), '^[ \-·]+|[ \-·]+$', '', 'g')"""


def sql_path(col):
    return f"list_filter(list_transform(list_filter(list_transform(string_split(coalesce({col}, ''), ':'), lambda s: trim(s)), lambda s: s <> ''), lambda s: {_SEG}), lambda s: s <> '')"


_CMP = f"""{_MATCH}, {_BAL}, oh AS (SELECT lower(trim(sku)) AS k, SUM(on_hand) AS on_hand FROM bal GROUP BY 1),
  b AS (SELECT p.sku, mt.matched_name AS item_full_name, coalesce(oh.on_hand, 0) AS q1, i.quantity AS q2, p.cost AS c1, i.purchase_cost AS c2, p.price AS p1, i.sales_price AS p2,
      {sql_path('p.income_account')} AS i1, {sql_path('i.income_account')} AS i2, {sql_path('p.cogs_account')} AS g1, {sql_path('i.cogs_account')} AS g2,
      {sql_path('p.asset_account')} AS a1, {sql_path('i.asset_account')} AS a2
    FROM v_part_master p JOIN mt USING (sku) JOIN v_item i ON i.item_full_name = mt.matched_name LEFT JOIN oh ON oh.k = lower(trim(p.sku))),
  cmp AS (SELECT sku, item_full_name, 'quantity' AS field, q2 - q1 AS delta, CASE WHEN q1 IS NOT NULL AND q2 IS NOT NULL THEN abs(q1 - q2) <= 1e-6 ELSE q1 IS NULL AND q2 IS NULL END AS is_match, NULL AS ov, NULL AS tv FROM b
    UNION ALL SELECT sku, item_full_name, 'purchase_cost', c2 - c1, CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN abs(c1 - c2) <= 1e-6 ELSE c1 IS NULL AND c2 IS NULL END, NULL, NULL FROM b
    UNION ALL SELECT sku, item_full_name, 'sales_price', p2 - p1, CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN abs(p1 - p2) <= 1e-6 ELSE p1 IS NULL AND p2 IS NULL END, NULL, NULL FROM b
    UNION ALL SELECT sku, item_full_name, 'income_account', NULL, i1 = i2 OR (len(i1) > 0 AND len(i2) > 0 AND i1[1:least(len(i1), len(i2))] = i2[1:least(len(i1), len(i2))]), array_to_string(i1, ':'), array_to_string(i2, ':') FROM b
    UNION ALL SELECT sku, item_full_name, 'cogs_account', NULL, g1 = g2 OR (len(g1) > 0 AND len(g2) > 0 AND (g1[1:least(len(g1), len(g2))] = g2[1:least(len(g1), len(g2))] OR (g1[1] = 'cogs' AND g2[1] = 'cogs'))), array_to_string(g1, ':'), array_to_string(g2, ':') FROM b
    UNION ALL SELECT sku, item_full_name, 'asset_account', NULL, a1 = a2 OR (len(a1) > 0 AND len(a2) > 0 AND a1[-1] = 'inventory asset' AND a2[-1] = 'inventory asset'), array_to_string(a1, ':'), array_to_string(a2, ':') FROM b)"""


def compared(f):
    return parity.compare_fields(f.part_master, f.item, matches(f), ledger.onhand_totals(bal(f)), "hierarchy")


@query("parity_mismatch", f"WITH {_CMP} SELECT sku, item_full_name, field, delta, is_match FROM cmp")
def parity_mismatch(f):
    return compared(f).select("sku", "item_full_name", "field", "delta", "is_match")


@query("parity_stats", f"WITH {_CMP} SELECT field, COUNT(*) AS compared, COUNT(*) FILTER (is_match) AS matched, COUNT(*) FILTER (NOT is_match) AS mismatched FROM cmp GROUP BY 1")
def parity_stats(f):
    return parity.field_stats(compared(f))


@query("parity_all_match", f"WITH {_CMP} SELECT COUNT(*) AS matched_parts, COUNT(*) FILTER (a) AS all_fields_match FROM (SELECT sku, bool_and(is_match) AS a FROM cmp GROUP BY 1) q")
def parity_all_match(f):
    return parity.all_match_count(compared(f))


@query("account_match", f"WITH {_CMP} SELECT sku, field, ov AS our_path, tv AS their_path, is_match FROM cmp WHERE field LIKE '%account'")
def account_match(f):
    rows = compared(f).where(F.col("field").endswith("account"))
    return rows.select("sku", "field", F.col("our_value").alias("our_path"), F.col("their_value").alias("their_path"), "is_match")


_MODE = lambda o, t, role: f"""SELECT sku, '{role}' AS field, array_to_string({o}, ':') AS our_path, array_to_string({t}, ':') AS their_path, {o} = {t} AS strict, {o} = {t}{" OR " + _ASSET if role == "asset_account" else ""} AS normalized,
    {o} = {t} OR {_ASSET if role == "asset_account" else f"(len({o}) > 0 AND len({t}) > 0 AND {o}[1:least(len({o}), len({t}))] = {t}[1:least(len({o}), len({t}))])"}{_EXTRA.get(role, "")} AS hierarchy FROM b"""  # noqa: E731
_ASSET = "(len(a1) > 0 AND len(a2) > 0 AND a1[-1] = 'inventory asset' AND a2[-1] = 'inventory asset')"
_EXTRA = {"income_account": " OR (len(i1) >= 2 AND len(i2) >= 2 AND i1[1:2] = i2[1:2])", "cogs_account": " OR (len(g1) > 0 AND len(g2) > 0 AND g1[1] = 'cogs' AND g2[1] = 'cogs')"}
_MODES = f"""b AS (SELECT p.sku, {', '.join(f"{sql_path(f'p.{c}')} AS {k}1, {sql_path('q.' + c)} AS {k}2" for k, c in zip('iga', acc.ACCOUNT_ROLES))} FROM v_part_master p JOIN
    (SELECT sku, {', '.join(f"CASE hash4 WHEN 0 THEN {c} WHEN 1 THEN {c} || ':Extra' WHEN 2 THEN 'Stock:Inventory Asset' ELSE regexp_replace({c}, '[^:]+$', 'Other') END AS {c}" for c in acc.ACCOUNT_ROLES)}
     FROM (SELECT *, CAST(reorder_point AS BIGINT) % 4 AS hash4 FROM v_part_master) z) q USING (sku))"""


@query("account_match_modes", f"WITH {_MODES} " + " UNION ALL ".join(_MODE(f"{k}1", f"{k}2", c) for k, c in zip("iga", acc.ACCOUNT_ROLES)))
def account_match_modes(f):
    """Each account of a part against itself, a child, an asset label or a sibling, under the three modes."""
    kind = F.col("reorder_point").cast("bigint") % 4

    def paths(c):
        other = F.when(kind == 0, F.col(c)).when(kind == 1, F.concat(c, F.lit(":Extra"))).when(kind == 2, F.lit("Stock:Inventory Asset")).otherwise(F.regexp_replace(c, "[^:]+$", "Other"))
        return {f"_a_{c}": acc.canonical_path(F.col(c)), f"_b_{c}": acc.canonical_path(other)}

    def pair(c):
        ours, theirs = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        modes = [acc.accounts_match(ours, theirs, c, m).alias(m) for m in ("strict", "normalized", "hierarchy")]
        return F.struct(F.lit(c).alias("field"), F.array_join(ours, ":").alias("our_path"), F.array_join(theirs, ":").alias("their_path"), *modes)

    # Paths are cleaned once per row, as columns of their own; the rows of one small table file are dealt first.
    parts = f.part_master.select("sku", "reorder_point", *acc.ACCOUNT_ROLES).repartition("sku", "reorder_point")
    cleaned = parts.select("sku", *[v.alias(k) for c in acc.ACCOUNT_ROLES for k, v in paths(c).items()])
    return cleaned.select("sku", F.inline(F.array(*map(pair, acc.ACCOUNT_ROLES))))


_RAWPATH = "CAST(p_partkey % 90 + 10 AS VARCHAR) || ' - COG''s : Parts & ' || p_type || ' :: ' || p_brand || '-0A1B2C'"


def raw_path():
    return F.concat((F.col("p_partkey") % 90 + 10).cast("string"), F.lit(" - COG's : Parts & "), "p_type", F.lit(" :: "), "p_brand", F.lit("-0A1B2C"))


@query("account_path", f"SELECT p_partkey, array_to_string({sql_path(_RAWPATH)}, ':') AS path FROM part")
def account_path(f):
    return f.part.select("p_partkey", F.array_join(acc.canonical_path(raw_path()), ":").alias("path"))


@query("path_prefixes", """SELECT p_partkey, CAST(generate_subscripts(l, 1) AS INTEGER) AS depth, array_to_string(l[1:generate_subscripts(l, 1)], ':') AS prefix
    FROM (SELECT p_partkey, [p_type, p_brand, p_name] AS l FROM part) q""")
def path_prefixes(f):
    path = F.concat_ws(" : ", "p_type", "p_brand", F.lit(""), "p_name")
    rows = f.part.select("p_partkey", F.posexplode(acc.path_prefixes(path)).alias("pos", "prefix"))
    return rows.select("p_partkey", (F.col("pos") + 1).alias("depth"), "prefix")


@query("item_keys", """SELECT item_full_name, lower(trim(item_full_name)) AS item_key, CASE WHEN item_full_name LIKE '%:%' THEN lower(trim(regexp_extract(item_full_name, '([^:]*)$', 1))) END AS leaf_key,
    regexp_replace(lower(item_full_name), '[^a-z0-9]', '', 'g') AS header_key FROM v_item""")
def item_keys(f):
    c = F.col("item_full_name")
    return f.item.select(c, ky.item_key(c).alias("item_key"), ky.leaf_key(c).alias("leaf_key"), ky.header_key(c).alias("header_key"))


@query("is_inventory_part", "SELECT sku, item_type = 'Inventory Part' AS inventory_part FROM v_part_master")
def is_inventory_part(f):
    return f.part_master.select("sku", ky.is_inventory_part(F.col("item_type")).alias("inventory_part"))


@query("qb_only_items", "SELECT DISTINCT lower(item_full_name) AS k FROM v_item WHERE lower(item_full_name) NOT IN (SELECT lower(sku) FROM v_part_master)")
def qb_only_items(f):
    theirs = f.item.select(F.lower("item_full_name").alias("k")).distinct()
    return parity.difference(theirs, f.part_master.select(F.lower("sku").alias("k")), "k")


_KNOWN = f"""{_MATCH}, lk AS (SELECT l.line_id, l.sku, mt.matched_name IS NOT NULL AS known FROM v_event_line l JOIN mt ON mt.sku = l.sku)"""


def named_lines(f):
    return f.event_line.join(f.part_master.select("sku", "item_full_name"), "sku", "left")


@query("filter_known_items", f"WITH {_KNOWN} SELECT sku, known, COUNT(*) AS lines FROM lk GROUP BY 1, 2")
def filter_known_items(f):
    kept, dropped = parity.known_item_lines(named_lines(f), f.item)
    tag = lambda df, k: df.select("sku", F.lit(k).alias("known"))
    return tag(kept, True).unionByName(tag(dropped, False)).groupBy("sku", "known").agg(F.count("*").alias("lines"))


# -------------------------------------------------------------- planned events
_HOME = "CASE WHEN upper(trim(sku)) LIKE 'WEB%' THEN 'NORTH' ELSE 'SOUTH' END"


@query("route_location", f"SELECT sku, {_HOME} AS location_code FROM v_part_master")
def route_location(f):
    return f.part_master.select("sku", gen.route_location(F.col("sku"), "web", "NORTH", "SOUTH").alias("location_code"))


@query("opening_lines", f"""SELECT sku, opening_qty AS new_qty, {_HOME} AS location_code, opening_qty >= 0 AS accepted FROM v_part_master""")
def opening_lines(f):
    ok, bad = gen.opening_lines(f.part_master, "web", "NORTH", "SOUTH")
    return ok.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


@query("chunk_events", f"""WITH o AS (SELECT sku, {_HOME} AS location_code FROM v_part_master), r AS (SELECT *, row_number() OVER (PARTITION BY location_code ORDER BY sku) AS rn, COUNT(*) OVER (PARTITION BY location_code) AS n FROM o)
    SELECT sku, location_code, (rn - 1) // 20 + 1 AS chunk_no, (n - 1) // 20 + 1 AS chunk_count FROM r""")
def chunk_events(f):
    rows = f.part_master.select("sku", gen.route_location(F.col("sku"), "web", "NORTH", "SOUTH").alias("location_code"))
    return gen.chunk_lines(rows, ["location_code"], 20)


@query("zero_fill_gap", f"""WITH {_ZERO}, t AS (SELECT p.sku, 'LOC-' || CAST(g AS VARCHAR) AS location_code FROM v_part_master p, (SELECT unnest([1, 2, 3, 4]) AS g) x
      WHERE CASE WHEN upper(p.sku) LIKE 'WEB%' THEN 'LOC-1' ELSE 'LOC-2' END <> 'LOC-' || CAST(g AS VARCHAR))
    SELECT sku, location_code FROM t WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.sku = t.sku AND 'LOC-' || CAST(z.location_id AS VARCHAR) = t.location_code)""")
def zero_fill_gap(f):
    queued = zero_pairs(f).select("sku", F.concat(F.lit("LOC-"), F.col("location_id").cast("string")).alias("location_code"))
    return gen.zero_fill_gap(f.part_master, [f"LOC-{i}" for i in (1, 2, 3, 4)], queued, "web", "LOC-1", "LOC-2")


@query("zero_out_event", "SELECT DISTINCT location_id, sku, CAST(0 AS DOUBLE) AS qty, CAST(0 AS DOUBLE) AS new_qty FROM v_event_line WHERE location_id IS NOT NULL")
def zero_out_event(f):
    rows = f.event_line.where("location_id IS NOT NULL").select("location_id", F.concat(F.lit(" "), "sku").alias("sku"))
    return gen.zero_out_lines(rows.unionByName(rows.withColumn("sku", F.lit("  "))))


@query("sync_lines", f"""WITH {_CMP}, ohs AS (SELECT sku, SUM(on_hand) AS on_hand FROM bal GROUP BY 1) SELECT s.sku, CASE WHEN o.on_hand >= 0 THEN o.on_hand END AS new_qty, CASE WHEN o.on_hand IS NULL THEN 'missing stock' WHEN o.on_hand < 0 THEN 'negative stock' END AS reject_reason
    FROM (SELECT DISTINCT sku FROM cmp WHERE field IN ('quantity', 'sales_price') AND NOT is_match) s LEFT JOIN ohs o USING (sku)""")
def sync_lines(f):
    return gen.sync_lines(compared(f), ["quantity", "sales_price"], ledger.onhand_totals(bal(f)))


@query("rebatch_events", """WITH r AS (SELECT l.event_id, l.location_id, l.line_id, row_number() OVER (PARTITION BY l.event_id, l.location_id ORDER BY l.line_id) AS rn,
      COUNT(*) OVER (PARTITION BY l.event_id, l.location_id) AS n FROM v_event_line l JOIN v_event e USING (event_id) WHERE e.qb_status = 'error' AND l.location_id IS NOT NULL)
    SELECT event_id, location_id, line_id, (rn - 1) // 2 + 1 AS chunk_no, (n - 1) // 2 + 1 AS chunk_count FROM r""")
def rebatch_events(f):
    out = gen.rebatch(f.event.where("qb_status = 'error'"), f.event_line, 2)
    return out.select("event_id", "location_id", "line_id", "chunk_no", "chunk_count")


def account_requests(f):
    """One request per part whose account the accounting side does not know."""
    return f.part_master.select(
        F.col("sku").alias("event_id"), "item_full_name", F.concat("cogs_account", F.lit(":"), "category").alias("missing_account"),
        "income_account", F.concat("cogs_account", F.lit(":"), "category").alias("cogs_account"), "asset_account")


@query("missing_accounts", """WITH s AS (SELECT list_transform(string_split(cogs_account || ':' || category, ':'), lambda x: trim(x)) AS l FROM v_part_master),
    p AS (SELECT generate_subscripts(l, 1) AS depth, array_to_string(l[1:generate_subscripts(l, 1)], ':') AS account FROM s)
    SELECT DISTINCT CAST(depth AS INTEGER) AS depth, account, 'CostOfGoodsSold' AS account_type FROM p WHERE lower(account) <> 'cogs'""")
def missing_accounts(f):
    known = f.part.select(F.lit("COGS").alias("account")).distinct()
    return gen.missing_accounts(account_requests(f), known).select("depth", "account", "account_type")


@query("missing_items", f"""WITH {_HYDRATED}, n AS (SELECT *, coalesce(nullif(trim(item_full_name), ''), nullif(trim(sku), '')) AS name, nullif(trim(income_account), '') AS i, coalesce(nullif(trim(cogs_account), ''), 'COGS') AS c,
      nullif(trim(asset_account), '') AS a FROM h),
    q AS (SELECT *, row_number() OVER (PARTITION BY event_id, lower(trim(name)) ORDER BY line_id) AS rn FROM n WHERE name IS NOT NULL)
    SELECT event_id, name AS item_full_name, i AS income_account, c AS cogs_account, a AS asset_account, coalesce(nullif(trim(sales_description), ''), nullif(trim(sku), ''), name) AS sales_description,
      CAST(sales_price AS DOUBLE) AS sales_price, CAST(purchase_cost AS DOUBLE) AS purchase_cost,
      nullif(concat_ws(', ', CASE WHEN i IS NULL THEN 'income account' END, CASE WHEN a IS NULL THEN 'asset account' END), '') AS reject_reason FROM q WHERE rn = 1""")
def missing_items(f):
    specs = gen.missing_items(hydrated(f), {"cogs_account": "COGS"})
    return specs.withColumns({c: F.col(c).cast("double") for c in ("sales_price", "purchase_cost")})


@query("item_mods", f"""WITH {_MATCH}, j AS (SELECT l.event_id, l.line_id, l.sku, i.list_id, i.edit_sequence, i.item_full_name IS NULL AS gone, e.event_id % 2 = 0 AS pc,
        nullif(trim(p.income_account), '') AS o1, nullif(trim(i.income_account), '') AS t1, nullif(trim(p.cogs_account), '') AS o2, nullif(trim(i.cogs_account), '') AS t2, nullif(trim(p.asset_account), '') AS o3, nullif(trim(i.asset_account), '') AS t3
      FROM v_event_line l JOIN v_event e USING (event_id) JOIN v_part_master p ON p.sku = l.sku LEFT JOIN mt ON mt.sku = l.sku LEFT JOIN v_item i ON i.item_full_name = mt.matched_name),
    k AS (SELECT *, CASE WHEN pc THEN t1 ELSE coalesce(o1, t1) END AS income_account, CASE WHEN pc THEN t2 ELSE coalesce(o2, t2) END AS cogs_account, CASE WHEN pc THEN t3 ELSE coalesce(o3, t3) END AS asset_account FROM j)
    SELECT event_id, line_id, sku, list_id, edit_sequence, income_account, cogs_account, asset_account, CASE WHEN gone THEN 'missing item detail' WHEN edit_sequence IS NULL THEN 'missing edit sequence'
      WHEN income_account IS NULL THEN 'missing income account' WHEN cogs_account IS NULL THEN 'missing cogs account' WHEN asset_account IS NULL THEN 'missing asset account' END AS reject_reason FROM k""")
def item_mods(f):
    author = F.when(F.col("event_id") % 2 == 0, "item-price-cost").otherwise("item-account")
    lines = f.event_line.join(f.part_master.select("sku", "income_account", "cogs_account", "asset_account"), "sku").withColumn("created_by", author)
    return gen.item_modifications(lines, f.item, matches(f))


def _remapped_parts(f):
    return gen.remap_account(f.part_master.withColumn("cogs_account", F.replace("cogs_account", F.lit("'"), F.lit("’"))), "COG's:Brand#3", "COGS:Brand 3")


@query("remap_account", """SELECT sku, CASE WHEN cogs_account = 'COG''s:Brand#3' THEN 'COGS:Brand 3' ELSE replace(cogs_account, '''', chr(8217)) END AS cogs_account, cogs_account = 'COG''s:Brand#3' AS remapped FROM v_part_master""")
def remap_account(f):
    return _remapped_parts(f).select("sku", "cogs_account", "remapped")


@query("remap_summary", """SELECT COUNT(*) AS matched, (SELECT string_agg(sku, ',' ORDER BY sku) FROM (SELECT sku FROM v_part_master WHERE cogs_account = 'COG''s:Brand#3' ORDER BY sku LIMIT 25) q) AS sample
    FROM v_part_master WHERE cogs_account = 'COG''s:Brand#3'""")
def remap_summary(f):
    return gen.remap_summary(_remapped_parts(f)).select("matched", F.nullif(F.array_join("sample_skus", ","), F.lit("")).alias("sample"))


_MSG = "CASE p_partkey % 4 WHEN 0 THEN 'There is an INVALID reference to QuickBooks COGS Account \"' || p_type || ':' || p_brand || '\" in the Item Inventory.' WHEN 1 THEN 'invalid reference to QuickBooks account \"' || p_brand || ' asset\"' WHEN 2 THEN 'Other error' ELSE 'Invalid reference to QuickBooks Post Account \"COGS:' || p_brand || '\" in the item inventory \"x\"' END"


@query("error_account", """SELECT p_partkey, account, CASE WHEN account = '' THEN NULL WHEN p_partkey % 4 = 0 THEN 'Income' WHEN p_partkey % 4 = 1 THEN 'OtherCurrentAsset' ELSE 'CostOfGoodsSold' END AS account_type FROM
    (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type || ':' || p_brand WHEN 1 THEN p_brand || ' asset' WHEN 2 THEN '' ELSE 'COGS:' || p_brand END AS account FROM part) q""")
def error_account(f):
    found = acc.missing_account(F.expr(_MSG))
    rows = f.part.select("p_partkey", found.alias("account"), F.concat("p_type", F.lit(":"), "p_brand", F.lit(":Web")).alias("income"))
    return rows.select("p_partkey", "account", acc.infer_account_type(F.col("account"), F.col("income"), F.lit(None).cast("string"), F.lit("")).alias("account_type"))


_PURGE = f"""{_BAL}, ev AS (SELECT event_id FROM v_event_line WHERE sku LIKE 'web-1%' UNION SELECT event_id FROM v_event WHERE created_by = 'user5'
      UNION SELECT l.event_id FROM v_event_line l JOIN v_location o ON o.location_id IN (l.location_id, l.from_location_id, l.to_location_id) WHERE o.code LIKE 'LOC-9%')"""


def closure(f):
    return mt.purge_closure(f.part_master, f.location, bal(f), f.event, f.event_line, "web-1", "LOC-9", "user5")


@query("purge_selector", f"""WITH {_PURGE} SELECT 'parts' AS table_name, COUNT(*) AS matched FROM v_part_master WHERE sku LIKE 'web-1%' UNION ALL SELECT 'locations', COUNT(*) FROM v_location WHERE code LIKE 'LOC-9%'
    UNION ALL SELECT 'balances', COUNT(*) FROM bal WHERE sku IN (SELECT sku FROM v_part_master WHERE sku LIKE 'web-1%') OR location_id IN (SELECT location_id FROM v_location WHERE code LIKE 'LOC-9%')
    UNION ALL SELECT 'events', COUNT(*) FROM ev UNION ALL SELECT 'lines', COUNT(*) FROM v_event_line WHERE event_id IN (SELECT event_id FROM ev)""")
def purge_selector(f):
    return mt.purge_counts(closure(f))


@query("purge_lines", f"WITH {_PURGE} SELECT line_id FROM v_event_line WHERE event_id NOT IN (SELECT event_id FROM ev)")
def purge_lines(f):
    return mt.purge(f.event_line, closure(f)["lines"]).select("line_id")


@query("ordered_rank", "SELECT line_id, row_number() OVER (PARTITION BY sku ORDER BY line_id) AS rn FROM v_event_line")
def ordered_rank(f):
    """Exact numbering within a SKU, worked in blocks of event ids' leading digits."""
    return row_numbers(f.event_line.select("sku", "line_id"), ["sku"], ["line_id"], F.substring("line_id", 1, 3)).select("line_id", "rn")
