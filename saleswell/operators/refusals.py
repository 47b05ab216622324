"""The inventory ledger in batch, with refusals.

A change is refused when it would take a location below zero, and whether it would depends on every decision
before it.  Still no key is walked row by row as a whole.  For a location that no transfer
touches, a block of changes is one function of the opening balance: on each of a few intervals the block
either adds a fixed amount or leads to a fixed balance.  The functions of all blocks are built side by side, a key's
openings follow by applying one function per block, and then all blocks are replayed side by side
from their openings.

A SKU with transfers has one balance per location and a change couples two of them; its rows are streamed in order
through one task that holds these few balances (the sort spills, the rows are never held together).  So are those of a SKU
of few rows: blocks are for SKUs that would keep one task busy.

``requests``: ``sku, seq, line_id, mode (delta, set, transfer), qty, new_qty, location_id, from_location_id,
to_location_id``, unique by (sku, seq, line_id).  A line without what its mode needs is refused as ``invalid`` and changes
nothing.  Sums of a block are added up before the opening, so fractional balances may differ from a walk in the last digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from saleswell import config

EPS = config.BALANCE_EPSILON
#: A SKU of fewer rows is streamed by one task in seconds.
HOT = 1_000_000
OUTPUT = "sku string, seq bigint, line_id string, location_id bigint, delta double, on_hand double, accepted boolean, reason string"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
_KEY = ["sku", "location_id"]

#: A balance function: pieces (from, slope 0 or 1, offset) over openings from 0 up, in order.
Pieces = list[tuple[float, int, float]]
SAME: Pieces = [(0.0, 1, 0.0)]


def add_delta(pieces: Pieces, delta: float) -> Pieces:
    """The function followed by a change that is refused if it doesn't fit."""
    out: Pieces = []
    for i, (start, slope, offset) in enumerate(pieces):
        if slope == 0:
            out.append((start, 0, after_delta(offset, delta)[0]))
            continue
        end = pieces[i + 1][0] if i + 1 < len(pieces) else math.inf
        fits, whole = max(start, -delta - EPS - offset), max(start, -delta - offset)  # from here it fits; from here nothing is rounded up to zero
        if start < fits:
            out.append((start, 1, offset))
        if fits < min(whole, end):
            out.append((fits, 0, 0.0))
        if whole < end:
            out.append((whole, 1, offset + delta))
    return joined(out)


def set_to(value: float) -> Pieces:
    return [(0.0, 0, max(value, 0.0))]


def joined(pieces: Pieces) -> Pieces:
    """Without pieces that go on as the one before."""
    return [p for i, p in enumerate(pieces) if i == 0 or p[1:] != pieces[i - 1][1:]]


def apply(pieces: Pieces, opening: float) -> float:
    start, slope, offset = next(p for p in reversed(pieces) if p[0] <= opening or p is pieces[0])
    return offset + slope * opening


def after_delta(balance: float, delta: float) -> tuple[float, bool]:
    fits = balance + delta >= -EPS
    return (max(balance + delta, 0.0), True) if fits else (balance, False)


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for frame in frames:
        yield from frame.itertuples(index=False)


def _batches(rows: Iterator[tuple], names: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _number(x) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


def block_functions(changes: DataFrame) -> DataFrame:
    """``sku, location_id, block, starts, slopes, offsets``: what each block of changes does to an opening balance."""

    def functions(rows):
        key, pieces = None, SAME
        for r in rows:
            now = (r.sku, r.location_id, r.block)
            if now != key:
                if key is not None:
                    yield (*key, *map(list, zip(*pieces)))
                key, pieces = now, SAME
            value = _number(r.value)
            if value is not None and not (r.setting and value < -EPS):
                pieces = set_to(value) if r.setting else add_delta(pieces, value)
        if key is not None:
            yield (*key, *map(list, zip(*pieces)))

    names = [*_KEY, "block", "starts", "slopes", "offsets"]
    ordered = changes.repartition(*_KEY, "block").sortWithinPartitions(*_KEY, "block", "seq", "line_id")
    return ordered.mapInPandas(lambda f: _batches(functions(_rows(f)), names), "sku string, location_id bigint, block bigint, starts array<double>, slopes array<int>, offsets array<double>")


def openings(functions: DataFrame) -> DataFrame:
    """``sku, location_id, block, opening``: one function is applied per block, over the small table of blocks."""

    def walk(rows):
        key, balance = None, 0.0
        for r in rows:
            if (r.sku, r.location_id) != key:
                key, balance = (r.sku, r.location_id), 0.0
            yield (*key, r.block, balance)
            balance = apply(list(zip(r.starts, r.slopes, r.offsets)), balance)

    ordered = functions.repartition(*_KEY).sortWithinPartitions(*_KEY, "block")
    return ordered.mapInPandas(lambda f: _batches(walk(_rows(f)), [*_KEY, "block", "opening"]), "sku string, location_id bigint, block bigint, opening double")


def _single(requests: DataFrame, block: Column) -> DataFrame:
    """Decisions for hot SKUs without transfers, location by location."""
    changes = requests.select(
        "sku", F.col("location_id").cast("bigint").alias("location_id"), block.cast("bigint").alias("block"), "seq", "line_id",
        (F.col("mode") == "set").alias("setting"), F.when(F.col("mode") == "set", F.col("new_qty")).otherwise(F.col("qty")).cast("double").alias("value"),
    )
    begun = openings(block_functions(changes.where("location_id is not null and value is not null")))
    placed = changes.join(begun, [*_KEY, "block"], "left")

    def replay(rows):
        key, balance = None, 0.0
        for r in rows:
            now = (r.sku, r.location_id, r.block)
            if now != key:
                key, balance = now, _number(r.opening) or 0.0
            value = _number(r.value)
            if value is None or _number(r.location_id) is None:
                yield (r.sku, r.seq, r.line_id, _number(r.location_id), None, None, False, "invalid")
                continue
            delta = value - balance if r.setting else value
            balance, fits = after_delta(balance, delta)
            yield (r.sku, r.seq, r.line_id, r.location_id, delta, balance, fits, None if fits else "below zero")

    ordered = placed.repartition(*_KEY, "block").sortWithinPartitions(*_KEY, "block", "seq", "line_id")
    return ordered.mapInPandas(lambda f: _typed(_batches(replay(_rows(f)), _NAMES)), OUTPUT)


def _whole(requests: DataFrame, heads: DataFrame, block: Column) -> DataFrame:
    """Decisions for SKUs of one task each: their rows in order, with one balance for each location.

    A SKU's head, which tells whether transfers couple its locations, comes before its rows.
    """

    def walk(frames):
        sku, linked, held = None, False, {}
        for frame in frames:
            decided = []
            columns = (frame[c].tolist() for c in ("sku", "linked", "dated", "mode", "seq", "line_id"))
            numbers = ([None if x != x else x for x in frame[c].tolist()] for c in ("location_id", "from_location_id", "to_location_id", "qty", "new_qty"))
            for key, head, dated, mode, seq, line, here, out, into, qty, new in zip(*columns, *numbers):
                if key != sku:
                    sku, linked, held = key, False, {}
                if head is not None:
                    linked = head
                    continue
                if mode == "transfer":
                    moves = None if out is None or into is None or qty is None else ((out, -qty), (into, qty))
                else:
                    value = new if mode == "set" else qty
                    moves = None if here is None or value is None else ((here, value - held.get(here, 0.0) if mode == "set" else value),)
                if moves is None:
                    place = here if here is not None or not linked else out
                    decided.append((sku, seq, line, place, None, None, False, "invalid"))
                    continue
                fits = all([held.get(place, 0.0) + delta >= -EPS for place, delta in moves])
                reason = None if fits else "below zero"
                for place, delta in moves:
                    if fits:
                        held[place] = max(held.get(place, 0.0) + delta, 0.0)
                    if dated or linked:
                        decided.append((sku, seq, line, place, delta, held.get(place, 0.0), fits, reason))
                if not dated and not linked:  # has no place in the order: shown from an empty location, as by ``_single``
                    balance, alone = after_delta(0.0, value)
                    decided.append((sku, seq, line, here, value, balance, alone, None if alone else "below zero"))
            if decided:
                yield pd.DataFrame(dict(zip(_NAMES, zip(*decided))))

    fields = ["sku", "mode", "seq", "line_id", "qty", "new_qty", "location_id", "from_location_id", "to_location_id"]
    rows = requests.select(*fields, block.isNotNull().alias("dated"), F.lit(None).cast("boolean").alias("linked"))
    ordered = rows.unionByName(heads, allowMissingColumns=True).repartition("sku").sortWithinPartitions("sku", F.col("linked").isNull(), "seq", "line_id")
    return ordered.mapInPandas(lambda f: _typed(walk(f)), OUTPUT)


def _typed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["location_id"] = frame["location_id"].astype("Int64")
        frame[["delta", "on_hand"]] = frame[["delta", "on_hand"]].astype(float)
        yield frame


def decide(requests: DataFrame, block: Column, dated: Callable[[DataFrame], DataFrame] = lambda rows: rows, hot: int = HOT) -> DataFrame:
    """Every change with ``delta, on_hand`` after it, ``accepted`` and ``reason``; a transfer gives two rows.

    ``block`` never decreases along (seq, line_id); it spreads SKUs of ``hot`` or more rows without transfers.  ``dated`` adds
    ``seq`` to requests that lack it: a join is left to it, so that rows are dealt by SKU after they are joined, and once.
    """
    sizes = requests.groupBy("sku").agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.col("mode") == "transfer"), F.lit(False)).alias("linked")
    )
    apart = (F.col("n") >= hot) & ~F.col("linked")
    # One SKU for every ``hot`` rows at most (and NULL), so small enough to be sent to all tasks.
    spread = F.broadcast(sizes.where(apart | F.col("sku").isNull()).select(F.col("sku").alias("_sku")))
    same = F.col("sku").eqNullSafe(F.col("_sku"))
    heads = sizes.where(~apart).select("sku", "linked")
    single = _single(dated(requests.join(spread, same, "left_semi")), block)
    return single.unionByName(_whole(dated(requests.join(spread, same, "left_anti")), heads, block))


def closing(decided: DataFrame) -> DataFrame:
    """On-hand per location after all decisions."""
    known = decided.where("location_id is not null and on_hand is not null")
    leg = F.when(F.col("delta") < 0, 0).otherwise(1)
    return known.groupBy(*_KEY).agg(F.max_by("on_hand", F.struct("seq", "line_id", leg)).alias("on_hand"))
