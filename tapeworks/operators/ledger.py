"""Average-cost ledger, marks, snapshots and equity curves from tables of fills.

Two things depend on every earlier fill of a position: whether a sell finds enough, and what the shares held
have cost. Both are worked on in blocks: the effect of a block on what came before it is a map (of the
quantity by intervals, of average price and fees affine). Maps compose, so the starting states of blocks
follow from one row a block. No account or symbol has to fit in one task.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.blocks import (
    BITS,
    EFFECT,
    bounded_buckets,
    continued,
    each_block,
    edges,
    grouped_rows,
    key_starts,
    known,
    levels_for,
    maps_of,
    ordered_blocks,
    schema_of,
    sparse,
    starting_states,
    starts_of,
)
from tapeworks.functions.cells import local_date
from tapeworks.functions.series import BLOCK, Grid, running
from tapeworks.functions.shift_maps import DELTA, accept_in_order, replayed, screened_blocks
from tapeworks.session import staged

KEYS = ["account", "symbol"]
ORDER = ["ts", "client_order_id"]
VALUE = "decimal(26,4)"
SHARE = "decimal(28,8)"


def _signed(amount: Column) -> Column:
    return F.when(F.col("side") == "buy", amount).otherwise(-amount)


def inventory_clamp(fills: DataFrame, grid: Grid | None = None, *, bits: int = BITS, levels: int | None = None) -> DataFrame:
    """Long-only acceptance: a sell needs as much held as it sells, else it is refused and changes nothing.

    Adds held_before and accepted. Quantities are whole numbers from 1 on. Fills of a position follow each
    other by ts, then client_order_id; rows equal in all of these are taken in any order.
    """
    return accept_in_order(_moves(fills), KEYS, ORDER, bits=bits, levels=levels)


def _moves(fills: DataFrame) -> DataFrame:
    return fills.withColumn(DELTA, _signed(F.col("quantity")).cast("long"))


_PREFIX = ["_a0", "_a1", "_m0", "_m1", "_g0", "_g1", "_f0", "_f1"]


def _affine_then(first: bytes, later: bytes) -> bytes:
    a, m, g, f, short = struct.unpack("<5d", first)
    a2, m2, g2, f2, short2 = struct.unpack("<5d", later)
    return struct.pack("<5d", a * a2, m * a2 + m2, g * g2, f * g2 + f2, max(short, short2))


def _affine_step(state: list[float], one: bytes) -> list[float]:
    a, m, g, f, short = struct.unpack("<5d", one)
    return [a * state[0] + m, g * state[1] + f, max(state[2], short)]


_GIVES = (
    "quantity_before long, quantity_after long, oversold boolean, "
    + ", ".join(f"{k} double" for k in _PREFIX)
    + f", {EFFECT} binary"
)


def _prefixes(table: pa.Table, starts: list[int]) -> pa.Table:
    """Quantities, and average and fees after each fill as an affine function of those before the block.

    Average: ``a * start + m``; fees: ``g * start + f``. ``_held0`` of a key's first row is what is held before it.
    """
    n, pieces = table.num_rows, list(zip(starts, starts[1:], strict=False))
    buys = pc.equal(table.column("side"), "buy").combine_chunks().to_numpy(zero_copy_only=False)
    quantity = np.array(known(table.column("quantity")), np.int64)
    moved = np.where(buys, quantity, -quantity)
    sums, held0 = np.append(0, np.cumsum(moved)), table.column("_held0").to_numpy()
    lengths, firsts = np.diff(starts), np.array(starts[:-1], np.int64)
    after = sums[1:] + np.repeat(held0[firsts] - sums[firsts], lengths)
    before = after - moved
    short = np.append(0, np.cumsum(after < 0))
    over = (short[1:] - np.repeat(short[firsts], lengths) > 0) | np.repeat(held0[firsts] < 0, lengths)
    facts = (buys.tolist(), quantity.tolist(), before.tolist(), after.tolist(),
             known(table.column("price").cast(pa.float64())), known(table.column("cost").cast(pa.float64())))
    found: list[list[float]] = [[], [], [], []]
    add_a, add_m, add_g, add_f = (x.append for x in found)
    for i, b in pieces:
        a, m, g, f = 1.0, 0.0, 1.0, 0.0
        for buy, size, old, held, price, cost in zip(*(x[i:b] for x in facts), strict=True):
            if buy:
                a, m = (a * old / held, (m * old + price * size) / held) if held else (0.0, 0.0)
                f += cost
            elif held <= 0:
                a = m = g = f = 0.0
            else:
                g, f = g - g * size / old, f - f * size / old
            add_a(a)
            add_m(m)
            add_g(g)
            add_f(f)
    columns = {"quantity_before": before, "quantity_after": after, "oversold": over}
    for name, first, column in zip("amgf", (1.0, 0.0, 1.0, 0.0), found, strict=True):
        now = np.array(column, np.float64)
        was = np.append(first, now)[:-1]
        was[firsts] = first
        columns |= {f"_{name}0": was, f"_{name}1": now}
    ends = {
        b - 1: struct.pack("<5d", *(x[b - 1] for x in found), float(over[b - 1])) for _, b in edges(starts) if n
    }
    table = table.drop_columns(["_held0"])
    for name in ("quantity_before", "quantity_after", "oversold", *_PREFIX):
        table = table.append_column(name, pa.array(columns[name]))
    return table.append_column(EFFECT, sparse(ends, n))


def _sorted_prefixes(table: pa.Table) -> pa.Table:
    return _prefixes(*grouped_rows(table, KEYS, ORDER))


def _accepted_prefixes(table: pa.Table) -> pa.Table:
    table = table.filter(table.column("accepted")).drop_columns(["accepted"])
    names = ["_held0" if c == "held_before" else c for c in table.column_names]
    return _prefixes(table.rename_columns(names), key_starts(table, KEYS))


def _facts(table: pa.Table) -> list[list]:
    buys = pc.equal(table.column("side"), "buy").to_pylist()
    amounts = (known(table.column(c).cast(pa.float64())) for c in ("price", "cost"))
    return [buys, known(table.column(DELTA)), *amounts]


def _accepted_effect(held: int, buys: list, deltas: list, prices: list, costs: list) -> bytes | None:
    """The last row of ``_prefixes`` over the fills of a key that are accepted from ``held`` on; none if none is."""
    a, m, g, f, some = 1.0, 0.0, 1.0, 0.0, False
    for buy, delta, price, cost in zip(buys, deltas, prices, costs, strict=True):
        after = held + delta
        if after < 0 and delta < 0:
            continue
        some = True
        if buy:
            a, m = (a * held / after, (m * held + price * delta) / after) if after else (0.0, 0.0)
            f += cost
        elif after <= 0:
            a = m = g = f = 0.0
        else:
            g, f = g + g * delta / held, f + f * delta / held
        held = after
    return struct.pack("<5d", a, m, g, f, 0.0) if some else None


def screened_ledger(
    fills: DataFrame, *, bits: int = BITS, levels: int | None = None, without: Sequence[str] = ()
) -> DataFrame:
    """The ``ledger`` of the fills that ``inventory_clamp`` accepts, with ``sequence``, a number that rises along
    the fills of a position. Columns named in ``without`` serve to order the fills, but are not returned.

    Blocks are gone through once for what they do to the average and fees before them, and once from those; both
    times the decisions are made again, so that no row is written in between.
    """
    own = [c for c in fills.columns if c not in (BLOCK, *without)]
    packed, held = screened_blocks(_moves(fills), KEYS, ORDER, bits=bits, levels=levels, kept=[*own, DELTA])

    def effects(table: pa.Table, block: int, states: list) -> pa.Table:
        facts, firsts, found = _facts(table), [], []
        for a, b in edges(key_starts(table, KEYS)):
            one = _accepted_effect(0 if a or states[0] is None else int(states[0][0]), *(x[a:b] for x in facts))
            if one is not None:
                firsts.append(a)
                found.append(one)
        out = table.select(KEYS).take(pa.array(firsts, pa.int64())).append_column(EFFECT, pa.array(found, pa.binary()))
        return out.append_column(BLOCK, pa.array([block] * len(found), pa.int64()))

    found = each_block(packed, [held], effects, f"{schema_of(fills, KEYS)}, {EFFECT} binary, {BLOCK} long")
    before = _starts(staged(continued(staged(found, "effects"), KEYS), "blocks"), levels)

    def settle(table: pa.Table, block: int, states: list) -> pa.Table:
        number = np.arange(table.num_rows, dtype=np.int64) + (block << bits)
        table = _accepted_prefixes(replayed(table.append_column("sequence", pa.array(number)), KEYS, states[0]))
        first = np.arange(table.num_rows) < (key_starts(table, KEYS)[1] if table.num_rows else 0)
        average, fees, short = (np.where(first, x, 0.0) for x in states[1] or (0.0, 0.0, 0.0))
        a0, a1, m0, m1, g0, g1, f0, f1 = (table.column(c).to_numpy() for c in _PREFIX)
        new = {
            "average_before": a0 * average + m0, "_average": a1 * average + m1,
            "fees_before": g0 * fees + f0, "fees_after": g1 * fees + f1,
            "oversold": table.column("oversold").to_numpy() | (short > 0),
        }
        table = table.drop_columns([*_PREFIX, EFFECT, "oversold"])
        for name, values in new.items():
            table = table.append_column(name, pa.array(values))
        return table

    doubles = ", ".join(f"{c} double" for c in ("average_before", "_average", "fees_before", "fees_after"))
    gives = f"sequence long, quantity_before long, quantity_after long, {doubles}, oversold boolean"
    return _valued(each_block(packed, [held, before], settle, f"{schema_of(fills, own)}, {gives}"))


def ledger(fills: DataFrame, grid: Grid | None = None, *, block_rows: int = 1 << BITS, levels: int | None = None) -> DataFrame:
    """Per accepted fill: quantities, average price, remaining entry fees, realised P&L.

    Entry fees are allocated pro rata on sells; pass a zero ``cost`` for the plain ledger. A fill that would
    go short should have been screened out: it and all later ones of its position are flagged in ``oversold``.
    Rows that come from ``inventory_clamp`` keep their blocks.
    """
    if {BLOCK, "accepted", "held_before"} <= set(fills.columns):
        # What is held at the start of a block is known.
        rows = fills.filter("accepted").withColumnRenamed("held_before", "_held0").drop("accepted")
        own = [c for c in rows.columns if c != "_held0"]
    else:
        rows = ordered_blocks(fills, KEYS, ORDER, bits=max(0, (block_rows - 1).bit_length()))
        own, on = list(rows.columns), [*KEYS, BLOCK]
        earlier = Window.partitionBy(*KEYS).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        nets = rows.groupBy(*on).agg(F.sum(_signed(F.col("quantity"))).alias("_net"))
        nets = nets.select(*on, F.sum("_net").over(earlier).alias("_held0")).filter("_held0 IS NOT NULL")
        rows = rows.join(nets, on, "left").select(*own, "_held0").na.fill(0, ["_held0"])
    found = rows.groupBy(BLOCK).applyInArrow(_sorted_prefixes, f"{schema_of(rows, own)}, {_GIVES}")
    return _settled(found, levels)


def _starts(blocks: DataFrame, levels: int | None) -> DataFrame | None:
    """Average, fees and whether there was an oversell before the later blocks of a position."""
    levels = levels_for(blocks) if levels is None else levels
    if levels is None:
        return None
    maps = maps_of(blocks, KEYS)
    return starts_of(blocks, starting_states(maps, KEYS, [0, 0, 0], _affine_then, _affine_step, levels=levels), KEYS)


def _settled(found: DataFrame, levels: int | None) -> DataFrame:
    """The ledger from ``_prefixes``."""
    found = staged(found, "prefixes")
    starts = _starts(staged(continued(found, KEYS), "blocks"), levels)
    c = F.col
    flat = found.drop(EFFECT)
    if starts is None:
        flat = flat.withColumn("state", F.lit(None).cast("array<double>"))
    else:
        flat = flat.join(starts, [*KEYS, BLOCK], "left")
    average, fees = (F.coalesce(F.get("state", i), F.lit(0.0)) for i in (F.lit(0), F.lit(1)))
    flat = flat.withColumns(
        {
            "average_before": c("_a0") * average + c("_m0"),
            "_average": c("_a1") * average + c("_m1"),
            "fees_before": c("_g0") * fees + c("_f0"),
            "fees_after": c("_g1") * fees + c("_f1"),
            "oversold": c("oversold") | (F.coalesce(F.get("state", F.lit(2)), F.lit(0.0)) > 0),
        }
    )
    return _valued(flat.drop(*_PREFIX, "state", BLOCK))


def _valued(flat: DataFrame) -> DataFrame:
    """Realised P&L and bases from quantities, averages and fees before and after each fill."""
    c = F.col
    share = F.try_divide(c("fees_before") * c("quantity"), c("quantity_before"))
    realised = (
        (c("price").cast("double") - c("average_before")) * c("quantity")
        - share
        - c("cost").cast("double")
    )
    held = c("quantity_after") > 0
    flat = flat.withColumns(
        {
            "average_price": F.when(held, c("_average")),
            "basis_before": c("average_before") * c("quantity_before"),
            "basis_after": c("_average") * c("quantity_after"),
            "realized_pnl": F.when(c("side") == "sell", realised).otherwise(F.lit(0.0)),
        }
    )
    return flat.drop("_average")


def open_positions(book: DataFrame) -> DataFrame:
    """Held quantity and average price per (account, symbol) after the last fill."""
    at = F.struct(*ORDER)
    return (
        book.groupBy(*KEYS)
        .agg(
            F.max_by("quantity_after", at).alias("quantity"),
            F.max_by("average_price", at).alias("average_price"),
            F.max_by("fees_after", at).alias("entry_fees"),
        )
        .filter("quantity > 0")
    )


def latest_quotes(quotes: DataFrame, now: Column | None = None) -> DataFrame:
    known = quotes if now is None else quotes.filter(F.col("ts") <= now)
    return known.groupBy("symbol").agg(F.max_by("price", "ts").alias("mark_price"))


def mark_positions(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Exposure and unrealised P&L of held positions at the latest quote."""
    c = F.col
    mark = c("mark_price").cast("double")
    return positions.join(quotes, "symbol", "left").withColumns(
        {
            "exposure": mark * c("quantity"),
            "unrealized_pnl": (mark - c("average_price")) * c("quantity"),
        }
    )


def snapshots(book: DataFrame, marks: DataFrame, grid: Grid, initial_cash: str) -> DataFrame:
    """Account state after every instant with a fill or a mark.

    Each event changes an account by a known amount, so states are running sums of the changes
    added up per instant. A fill marks its position at the ``open`` seen then, if the book has it,
    else at its price. ``marks`` holds (symbol, ts, price) closes; they apply after fills
    of the same instant. ``book`` is read several times and should be a stored table.

    Over all events of an instant, what a position has cost and is worth moves from before the first of them to
    after the last, so events are added up per position and instant before anything is put in order.
    """
    c = F.col
    money = lambda n: c(n).cast("double")
    # Sums of these are the same in any order.
    exact = lambda n: c(n).cast(SHARE)
    price_q = (c("price") * c("quantity").cast("decimal(12,0)")).cast(VALUE)
    cash = F.when(c("side") == "buy", -price_q - c("cost")).otherwise(price_q - c("cost")).cast(VALUE)
    carried, before = c("basis_after") + c("fees_after"), c("basis_before") + c("fees_before")
    # A number is looked up without a sort.
    at = c("sequence" if "sequence" in book.columns else "client_order_id")
    seen = money("open" if "open" in book.columns else "price")
    fill_events = book.groupBy(*KEYS, "ts").agg(
        F.max_by(money("quantity_after"), at).alias("_q"),
        F.max_by(seen, F.when(seen.isNotNull(), at)).alias("_seen"),
        F.sum(cash).cast(VALUE).alias("_cash"),
        (F.max_by(carried, at) - F.min_by(before, at)).cast(SHARE).alias("_carried"),
        F.sum(exact("realized_pnl")).cast(SHARE).alias("_realized"),
    )
    held = book.select(*KEYS).distinct()
    mark_events = marks.groupBy("symbol", "ts").agg(F.max(money("price")).alias("_mark")).join(held, "symbol")
    events = staged(fill_events.join(mark_events, [*KEYS, "ts"], "full").select(
        *KEYS,
        "ts",
        "_q",
        F.coalesce("_mark", "_seen").alias("_m"),
        F.coalesce("_cash", F.lit(0)).cast(VALUE).alias("_cash"),
        F.coalesce("_carried", F.lit(0)).cast(SHARE).alias("_carried"),
        F.coalesce("_realized", F.lit(0)).cast(SHARE).alias("_realized"),
    ), "events")
    events, bucket = bounded_buckets(events, KEYS, ["ts"], grid.bucket("ts"))
    line = running(
        events,
        KEYS,
        ["ts"],
        bucket,
        {"_q0": ("last", c("_q")), "_m0": ("last", c("_m"))},
        include_current=False,
    )
    old = F.coalesce(c("_q0") * c("_m0"), F.lit(0.0))
    new = F.coalesce(c("_q"), c("_q0"), F.lit(0.0)) * c("_m")
    changes = staged(line.groupBy("account", "ts").agg(
        F.sum("_cash").cast(VALUE).alias("_cash"),
        F.sum(new - old).alias("_exposure"),
        F.sum("_carried").cast(SHARE).alias("_carried"),
        F.sum("_realized").cast(SHARE).alias("_realized"),
    ), "account-changes")
    changes, bucket = bounded_buckets(changes, ["account"], ["ts"], grid.bucket("ts"))
    sums = running(
        changes,
        ["account"],
        ["ts"],
        bucket,
        {
            "cash_moved": ("sum", c("_cash")),
            "exposure": ("sum", c("_exposure")),
            "carried": ("sum", c("_carried")),
            "realized_pnl": ("sum", c("_realized")),
        },
    )
    cash = (F.lit(initial_cash).cast(VALUE) + c("cash_moved")).cast(VALUE)
    return sums.select(
        "account",
        "ts",
        cash.alias("cash"),
        "exposure",
        (cash.cast("double") + c("exposure")).alias("equity"),
        c("realized_pnl").cast("double").alias("realized_pnl"),
        (c("exposure") - c("carried").cast("double")).alias("unrealized_pnl"),
    )


def equity_curve(states: DataFrame, initial_cash: str) -> DataFrame:
    """Equity after each instant, with the initial capital in front of every account."""
    curve = states.select("account", "ts", "equity", "exposure")
    start = states.groupBy("account").agg(F.min("ts").alias("ts")).select(
        "account",
        (F.col("ts") - F.expr("INTERVAL 1 SECOND")).alias("ts"),
        F.lit(initial_cash).cast("double").alias("equity"),
        F.lit(0.0).alias("exposure"),
    )
    return start.unionByName(curve)


def day_baseline(states: DataFrame, key: str = "account", value: str = "equity") -> DataFrame:
    """Adds ``day_start_equity``: the last equity before the market-local day began.

    The first day starts from its own first value. Only one row per (key, day) is windowed.
    """
    df = states.withColumn("trading_day", local_date(F.col("ts")))
    days = df.groupBy(key, "trading_day").agg(
        F.max_by(value, "ts").alias("_close"), F.min_by(value, "ts").alias("_open")
    )
    w = Window.partitionBy(key).orderBy("trading_day")
    days = days.select(
        key,
        "trading_day",
        F.coalesce(F.lag("_close").over(w), F.col("_open")).alias("day_start_equity"),
    )
    return df.join(days, [key, "trading_day"])
