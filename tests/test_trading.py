import random
import re
from datetime import UTC, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tapeworks.functions.blocks import ordered_blocks
from tapeworks.functions.series import Grid
from tapeworks.functions.shift_maps import ShiftMap
from tapeworks.operators import ledger as led
from tapeworks.operators import performance as perf
from tapeworks.operators import pricing, reconcile, risk, sessions, signals

GRID = Grid(bar_seconds=60, bucket_rows=4)
NOW = datetime(2026, 9, 25, 5, 0, tzinfo=UTC)


@pytest.mark.parametrize(
    ("closes", "side"), [([3, 2, 1, 4], "buy"), ([2, 3, 4, 1], "sell"), ([1, 2, 3, 4], "hold")]
)
def test_crossover(spark, closes, side):
    rows = [("A", NOW + timedelta(minutes=i), D(c)) for i, c in enumerate(closes)]
    bars = spark.createDataFrame(rows, "instrument_id string, ts timestamp, close decimal(18,4)")
    out = signals.crossover(bars, GRID, 2, 3).orderBy(F.desc("ts")).first()
    assert out.side == side


def test_costs_slippage_and_ticks(spark):
    schedule = pricing.schedule_row(
        "equity_delivery", gst_rate="0.18", brokerage=("0.01", "0.01", "2"), stt=("0", "0.001", None)
    )
    orders = spark.createDataFrame(
        [("buy", D(100), 10, "equity_delivery"), ("sell", D(100), 10, "equity_delivery"),
         ("buy", D(1), 1, "none")],
        "side string, price decimal(18,4), quantity bigint, product string",
    )
    got = pricing.with_costs(orders, pricing.cost_schedules(spark, [schedule]))
    totals = {(r.side, r.product): r for r in got.collect()}
    assert totals["buy", "equity_delivery"].total_cost == D("2.36")
    assert totals["sell", "equity_delivery"].total_cost == D("3.36")
    assert totals["buy", "none"].cost_reason == "missing_cost_schedule"
    slip = pricing.Slippage(bps="10", percentage="0.01")
    for side, raw, rounded in (("buy", "101.1", "101.25"), ("sell", "98.9", "98.75")):
        price = slip.price(F.lit(D(100)), F.lit(side), F.lit(0))
        tick = pricing.to_tick(price, F.lit(D("0.25")), F.lit(side))
        row = spark.range(1).select(price.alias("p"), tick.alias("t")).first()
        assert row.p == D(raw) and row.t == D(rounded)


def liquidity(rows):
    """All-or-nothing in order, one order at a time."""
    left, out = {}, {}
    for day, arrival, quantity, capacity, eligible in sorted(rows, key=lambda r: (r[0], r[1])):
        room = left.get(day, capacity)
        ok = eligible and quantity <= room
        left[day] = room - quantity if ok else room
        out[day, arrival] = ok
    return out


def test_liquidity_in_order(spark):
    rng = random.Random(11)
    rows = [
        (NOW + timedelta(days=d), i, rng.randint(1, 60), 100 if d else 10**6, rng.random() > 0.2)
        for d in range(12)
        for i in range(40)
    ]
    rows += [(NOW + timedelta(days=20), 0, 75, 100, True), (NOW + timedelta(days=20), 1, 75, 100, True)]
    df = spark.createDataFrame(
        rows, "executed_at timestamp, arrival bigint, quantity bigint, capacity bigint, eligible boolean"
    ).withColumn("instrument_id", F.lit("A"))
    got = {(r.executed_at.timestamp(), r.arrival): r.accepted for r in pricing.full_fills(df, GRID).collect()}
    want = {(d.timestamp(), a): ok for (d, a), ok in liquidity(rows).items()}
    assert got == want


def risk_row(spark, policy=None, **changes):
    row = dict(
        client_order_id="t", symbol="DEMO", instrument_type="equity", side="buy", quantity=10,
        stop_loss=D(90), quote_symbol="DEMO", quote_type="equity", quote_price=D(100), quote_ts=NOW,
        now=NOW, cash=D(100000), equity=D(100000), exposure=D(0), day_start_equity=D(100000),
        open_positions=0, held_quantity=None, repeated=False,
    ) | changes
    types = {
        "quantity": "bigint", "open_positions": "int", "held_quantity": "bigint", "repeated": "boolean",
        "quote_ts": "timestamp", "now": "timestamp",
    }
    money = {"stop_loss", "quote_price", "cash", "equity", "exposure", "day_start_equity"}
    schema = ", ".join(
        f"{k} {'decimal(18,2)' if k in money else types.get(k, 'string')}" for k in row
    )
    df = spark.createDataFrame([tuple(row.values())], schema)
    return risk.risk_screen(df, policy or risk.Policy()).first().reasons


@pytest.mark.parametrize(
    ("changes", "reasons"),
    [
        ({}, []),
        ({"quote_ts": NOW - timedelta(seconds=31)}, ["stale_quote"]),
        ({"quote_ts": NOW - timedelta(seconds=30)}, []),
        ({"quote_ts": NOW + timedelta(seconds=1)}, ["future_quote"]),
        ({"quote_symbol": "OTHER"}, ["quote_mismatch"]),
        ({"repeated": True}, ["duplicate_order"]),
        ({"stop_loss": None}, ["invalid_stop_loss"]),
        ({"stop_loss": D(100)}, ["invalid_stop_loss"]),
        ({"equity": D(95000)}, ["daily_loss"]),
        ({"equity": D("95000.01")}, []),
        ({"cash": D(999)}, ["insufficient_cash"]),
        ({"side": "sell", "stop_loss": D(110)}, ["insufficient_position"]),
        ({"side": "sell", "stop_loss": D(110), "held_quantity": 10}, []),
        ({"open_positions": 5}, ["open_positions"]),
        ({"open_positions": 5, "held_quantity": 1}, []),
        ({"quantity": 101}, ["capital_per_trade"]),
        ({"exposure": D("49000.01")}, ["portfolio_exposure"]),
        ({"symbol": "OTHER", "quote_symbol": "OTHER"}, ["symbol_not_allowed"]),
    ],
)
def test_one_reason_at_a_time(spark, changes, reasons):
    assert risk_row(spark, **changes) == reasons


@pytest.mark.parametrize(
    ("hour", "minute", "days", "closed"),
    [(3, 45, 0, False), (3, 44, 0, True), (9, 59, 0, False), (10, 0, 0, True), (5, 0, 1, True)],
)
def test_market_hours(spark, hour, minute, days, closed):
    at = NOW.replace(hour=hour, minute=minute) + timedelta(days=days)
    assert ("market_closed" in risk_row(spark, now=at, quote_ts=at)) == closed


def fill_table(spark, rows):
    data = [
        ("X", f"o{i:04d}", s, side, q, D(str(p)), D(str(c)), NOW + timedelta(minutes=i))
        for i, (s, side, q, p, c) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "account string, client_order_id string, symbol string, side string, quantity bigint, "
        "price decimal(18,2), cost decimal(18,2), ts timestamp",
    )


def test_ledger_known_values(spark):
    fills = fill_table(spark, [("A", "buy", 10, 100, 0), ("A", "sell", 4, 120, 0)])
    book = led.ledger(fills, GRID)
    last = book.orderBy(F.desc("ts")).first()
    assert (last.quantity_after, last.average_price, last.realized_pnl) == (6, 100.0, 80.0)
    quotes = fills.select("symbol", "ts", F.lit(D(120)).alias("price"))
    state = led.snapshots(book, quotes, GRID, "100000").orderBy(F.desc("ts")).first()
    assert state.cash == D("99480") and state.equity == pytest.approx(100200)
    assert state.realized_pnl == 80 and state.unrealized_pnl == pytest.approx(120)
    fees = led.ledger(fill_table(spark, [("A", "buy", 1, 110, 1.1), ("A", "sell", 1, 120, 1.2)]), GRID)
    assert fees.orderBy(F.desc("ts")).first().realized_pnl == pytest.approx(7.7)


def test_long_histories_fold_in_blocks(spark):
    rng, rows, held = random.Random(3), [], 0
    for _ in range(1500):
        if held and rng.random() < 0.45:
            q = rng.randint(1, held)
            rows.append(("A", "sell", q, rng.randint(50, 150), 0.5))
            held -= q
        else:
            q = rng.randint(1, 5)
            rows.append(("A", "buy", q, rng.randint(50, 150), 0.5))
            held += q
    got = led.ledger(fill_table(spark, rows), GRID, block_rows=7, levels=2).orderBy("ts").collect()
    quantity, average, fees = 0, 0.0, 0.0
    for (_, side, q, price, cost), r in zip(rows, got, strict=True):
        pnl = 0.0
        if side == "buy":
            average = (average * quantity + price * q) / (quantity + q)
            quantity, fees = quantity + q, fees + cost
        else:
            pnl = (price - average) * q - fees * q / quantity - cost
            fees -= fees * q / quantity
            quantity -= q
        assert r.quantity_after == quantity and r.realized_pnl == pytest.approx(pnl, abs=1e-7)
        if quantity:
            assert r.average_price == pytest.approx(average)


def test_as_of_joins_and_baseline(spark):
    bars = [("A", NOW + timedelta(minutes=m), m) for m in (0, 1, 2, 500, 501)]
    right = spark.createDataFrame(bars, "k string, ts timestamp, v int")
    at = [0, 1.5, 2, 30, 501, 900]
    left = spark.createDataFrame([("A", NOW + timedelta(minutes=m), float(m)) for m in at], "k string, ts timestamp, m double")
    nxt = {r.m: r.next_v for r in sessions.next_after(left, right, ["k"], ["v"], GRID).collect()}
    assert nxt == {0: 1, 1.5: 2, 2: 500, 30: 500, 501: None, 900: None}
    last = {r.m: r.last_v for r in sessions.latest_before(left, right, ["k"], ["v"], GRID).collect()}
    assert last == {0: 0, 1.5: 1, 2: 2, 30: 2, 501: 501, 900: 501}
    rows = [("r", NOW, 100.0), ("r", NOW + timedelta(days=1), 90.0), ("r", NOW + timedelta(days=1, hours=1), 95.0)]
    states = spark.createDataFrame(rows, "account string, ts timestamp, equity double")
    assert [r.day_start_equity for r in led.day_baseline(states).orderBy("ts").collect()] == [100, 100, 100]


def series(spark, values):
    rows = [("r", NOW + timedelta(minutes=i), D(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, ts timestamp, equity decimal(18,2)")


def test_performance(spark):
    m = perf.metrics(series(spark, [100, 110, 99]), GRID).first()
    assert m.total_return == pytest.approx(-0.01) and m.max_drawdown == pytest.approx(0.1)
    assert m.annualized_return is None and m.calmar is None
    flat = perf.metrics(series(spark, [100, 100, 100]), GRID).first()
    assert flat.sharpe is None and flat.sortino is None
    broke = perf.metrics(series(spark, [100, 0, 0]), GRID).first()
    assert broke.total_return == -1 and broke.max_drawdown == 1 and broke.annualized_volatility is None
    trades = spark.createDataFrame([("r", 10.0), ("r", -5.0)], "run_id string, realized_pnl double")
    t = perf.trade_metrics(trades).first()
    assert (t.win_rate, t.profit_factor, t.expectancy, t.closed_trade_count) == (0.5, 2, 2.5, 2)
    back = perf.equity_guards(series(spark, [100, 0, 5]), GRID).first()
    assert back.reasons == ["recovers_from_zero"]


def test_reconciliation(spark):
    schema = "client_order_id string, quantity bigint, price double, fees double"
    a = spark.createDataFrame([("m", 5, 10.0, 1.0), ("l", 1, 1.0, 0.0)], schema)
    b = spark.createDataFrame([("m", 4, 9.5, 1.5), ("r", 1, 1.0, 0.0)], schema)
    got = {r.client_order_id: r for r in reconcile.compare_trades(a, b).collect()}
    assert (got["m"].quantity_difference, got["m"].price_difference, got["m"].fee_difference) == (1, 0.5, -0.5)
    assert got["l"].status == "only_simulated" and got["r"].status == "only_paper"
    assert reconcile.repeated_trades(a.unionByName(a)).count() == 2


def test_fill_fraction_is_a_decimal(spark):
    rows = [("A", NOW, i, 100, 1000, True, lot) for i, lot in enumerate((1, 1, 0))]
    df = spark.createDataFrame(
        rows,
        "instrument_id string, executed_at timestamp, arrival bigint, quantity bigint, capacity bigint, "
        "eligible boolean, lot_size bigint",
    )
    got = {r.arrival: r.filled_quantity for r in pricing.partial_fills(df, GRID, "0.29").collect()}
    assert got == {0: 29, 1: 29, 2: 0}


def test_repeated_trades_do_not_multiply(spark):
    schema = "client_order_id string, quantity bigint, price decimal(18,2), fees decimal(18,2)"
    one = spark.createDataFrame([("a", 1, D(5), D(0))] * 2 + [("b", 2, D(5), D(1))], schema)
    got = {r.client_order_id: r for r in reconcile.compare_trades(one, one).collect()}
    assert got["a"].status == "repeated" and got["a"].quantity_difference is None
    assert got["b"].status == "matched" and got["b"].fee_difference == 0 and len(got) == 2


def test_one_run_that_starts_at_zero_leaves_the_others_alone(spark):
    rows = [(run, datetime(2024, 1, 1, h, tzinfo=UTC), D(v)) for run, vs in (("x", (0, 5)), ("y", (10, 20)))
            for h, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run_id string, ts timestamp, equity decimal(18,2)")
    got = {r.run_id: r.total_return for r in perf.metrics(df, Grid(bar_seconds=3600)).collect()}
    assert got == {"x": None, "y": 1.0}


def test_order_ids_are_valid_for_any_instrument_name(spark):
    from tapeworks import schemas as S

    row = ("Brand #12/é", datetime(2024, 1, 1, tzinfo=UTC), D(100), "buy", "equity", "S", 7)
    schema = "instrument_id string, ts timestamp, close decimal(18,4), side string, asset_class string, symbol string, account long"
    got = signals.orders_from(spark.createDataFrame([row], schema)).first()
    assert got.symbol == "S" and got.account == 7
    assert re.fullmatch(S.ORDER_ID_PATTERN, got.client_order_id)


def clamp_loop(fills):
    held, out = {}, {}
    for account, symbol, order, side, quantity, _ in sorted(fills, key=lambda r: (r[0], r[1], r[5], r[2])):
        have = held.get((account, symbol), 0)
        ok = side == "buy" or have >= quantity
        held[account, symbol] = have + (quantity if side == "buy" else -quantity) * ok
        out[account, symbol, order] = (have, ok)
    return out


@pytest.mark.parametrize(("bits", "levels", "sells"), [(16, 1, 0.4), (3, 1, 0.5), (2, 2, 0.7)])
def test_clamp_takes_sells_of_any_size(spark, bits, levels, sells):
    rng, rows = random.Random(bits), []
    for i in range(700):
        symbol = "HOT" if i % 10 else f"S{i % 3}"  # one position has nearly all fills
        side = "sell" if rng.random() < sells else "buy"
        rows.append(("A", symbol, f"o{i:04d}", side, rng.choice([1, 2, 7, 40]), NOW + timedelta(minutes=i // 5)))
    df = spark.createDataFrame(
        rows, "account string, symbol string, client_order_id string, side string, quantity bigint, ts timestamp"
    )
    got = led.inventory_clamp(df.repartition(5), bits=bits, levels=levels).collect()
    assert {(r.account, r.symbol, r.client_order_id): (r.held_before, r.accepted) for r in got} == clamp_loop(rows)
    if bits < 16:
        sizes = {}
        for r in got:
            sizes[r["_block"]] = sizes.get(r["_block"], 0) + 1
        assert max(sizes.values()) <= 1 << bits
    assert led.inventory_clamp(df.limit(0)).count() == 0


def test_shift_maps_compose():
    rng = random.Random(4)
    for _ in range(60):
        runs = [[rng.randint(1, 30) * rng.choice([1, -1, -1]) for _ in range(rng.randrange(0, 12))] for _ in range(2)]
        first, whole = ShiftMap.of(runs[0], 60), ShiftMap.of(runs[0] + runs[1], 60)
        second = ShiftMap.of(runs[1], 60 + 12 * 30)
        both = ShiftMap.unpack(first.then(second).pack())
        for start in range(61):
            held = start
            for delta in runs[0] + runs[1]:
                held += delta if held + delta >= 0 else 0
            assert whole.at(start) == both.at(start) == held


def test_hot_contested_group_in_blocks(spark):
    rng = random.Random(6)
    rows = [(NOW, i, rng.choice([1, 3, 50, 400]), 5000, rng.random() > 0.1) for i in range(900)]
    rows += [(NOW + timedelta(days=1), i, 7, 20, True) for i in range(9)]
    df = spark.createDataFrame(
        rows, "executed_at timestamp, arrival bigint, quantity bigint, capacity bigint, eligible boolean"
    ).withColumn("instrument_id", F.lit("A"))
    got = {(r.executed_at.timestamp(), r.arrival): r.accepted for r in pricing.full_fills(df, bits=4).collect()}
    assert got == {(d.timestamp(), a): ok for (d, a), ok in liquidity(rows).items()}
    refused = pricing.rejected_fills(df).collect()
    assert {(r.accepted, r.liquidity_reason) for r in refused} == {(False, "fill_model_reject"), (False, None)}


def test_blocks_are_bounded_by_counts(spark):
    # Nine tenths of the rows belong to one key and one minute.
    rows = [("HOT" if i % 10 else f"K{i}", NOW, i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would share a task
    cut = ordered_blocks(df, ["k"], ["ts"], bits=7, tie=F.xxhash64("v"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in cut.groupBy("_block").count().collect()]
    assert max(sizes) <= 128 and sum(sizes) == 20_000
    tasks = [r["count"] for r in cut.groupBy(F.shiftright("_block", 33 - 7)).count().collect()]
    assert len(tasks) > 1 and max(tasks) < 0.5 * 20_000
    left = df.withColumn("o", F.lit("order"))
    bars = spark.createDataFrame([("HOT", NOW + timedelta(days=1), 5.0)], "k string, ts timestamp, price double")
    found = sessions.next_after(left, bars, ["k"], ["price"], GRID).groupBy("next_price").count().collect()
    assert {r.next_price: r["count"] for r in found} == {5.0: 18_000, None: 2_000}


def test_a_fill_marks_at_the_open_it_saw(spark):
    fills = fill_table(spark, [("A", "buy", 10, 101, 0), ("A", "sell", 4, 120, 0)]).withColumn("open", F.lit(D("100.00")))
    book = led.ledger(fills)
    states = led.snapshots(book, fills.select("symbol", "ts", "price").limit(0), GRID, "100000").orderBy("ts").collect()
    assert [r.exposure for r in states] == [1000, 600] and states[0].equity == pytest.approx(99990)


def test_all_after_an_oversell_is_flagged(spark):
    book = led.ledger(fill_table(spark, [("A", "buy", 1, 5, 0), ("A", "sell", 2, 5, 0), ("A", "buy", 9, 5, 0), ("B", "buy", 1, 5, 0)]))
    assert [(r.symbol, r.oversold) for r in book.orderBy("symbol", "ts").collect()] == [("A", False), ("A", True), ("A", True), ("B", False)]
    rows = [("A", "buy", 1, 5, 0), ("A", "sell", 2, 5, 0), *[("A", "buy", 9, 5, 0)] * 9]
    cut = led.ledger(fill_table(spark, rows), block_rows=2).orderBy("ts").collect()
    assert [r.oversold for r in cut] == [False] + [True] * 10


def test_clamp_where_nearly_all_is_refused(spark):
    # Sizes and refusals give more intervals than a map made without a bound may have.
    rng, rows = random.Random(12), []
    for i in range(9000):
        side = "sell" if rng.random() < 0.6 else "buy"
        rows.append(("A", "HOT", f"o{i:05d}", side, rng.randint(1, 5000), NOW + timedelta(minutes=i)))
    df = spark.createDataFrame(
        rows, "account string, symbol string, client_order_id string, side string, quantity bigint, ts timestamp"
    )
    got = led.inventory_clamp(df, bits=12).collect()
    assert {(r.account, r.symbol, r.client_order_id): (r.held_before, r.accepted) for r in got} == clamp_loop(rows)


@pytest.mark.parametrize("levels", [None, 1])
def test_screened_ledger_is_clamp_and_ledger(spark, levels):
    rng = random.Random(3)
    rows = [("HOT" if i % 7 else f"S{i % 4}", rng.choice(["buy", "sell"]), rng.randint(1, 9), 100 + i % 11, 1) for i in range(300)]
    fills = fill_table(spark, rows)
    columns = ["symbol", "ts", "quantity_after", "oversold", *[F.round(c, 6) for c in ("average_price", "fees_after", "realized_pnl")]]
    one = led.screened_ledger(fills, bits=3, levels=levels).select(*columns).collect()
    assert sorted(map(str, one)) == sorted(map(str, led.ledger(led.inventory_clamp(fills)).select(*columns).collect()))


def test_fills_are_not_sorted_to_be_told_apart(spark):
    from tapeworks.plans import fixtures as fx

    plan = fx.fills(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_rows_of_blocks_move_once(spark):
    fills = fill_table(spark, [("A", "buy", 1, 5, 0)] * 40)
    plan = led.inventory_clamp(fills, bits=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_orders_far_apart_share_a_bucket(spark, monkeypatch):
    rows = [("A", NOW, i * 10**9, 10, 1000, True, 1) for i in range(200)]
    df = spark.createDataFrame(
        rows,
        "instrument_id string, executed_at timestamp, arrival bigint, quantity bigint, capacity bigint, "
        "eligible boolean, lot_size bigint",
    )
    seen, running = [], pricing.running

    def counted(rows, keys, order, bucket, *args, **kwargs):
        seen.append(rows.select(*keys, bucket.alias("_b")).distinct().count())
        return running(rows, keys, order, bucket, *args, **kwargs)

    monkeypatch.setattr(pricing, "running", counted)
    got = {r.arrival: r.filled_quantity for r in pricing.partial_fills(df, GRID).collect()}
    assert got == {i * 10**9: 10 if i < 100 else 0 for i in range(200)}
    assert sum(r.accepted for r in pricing.full_fills(df).collect()) == 100
    assert seen == [1, 1]


def written(monkeypatch, *modules):
    """Names and row counts of the tables that are written from now on."""
    seen = []
    for module in modules:
        def counted(df, name, real=module.staged):
            out = real(df, name)
            seen.append((name, out.count()))
            return out

        monkeypatch.setattr(module, "staged", counted)
    return seen


def test_ledger_writes_no_row_per_fill(spark, monkeypatch):
    from tapeworks.functions import blocks, shift_maps

    rng = random.Random(8)
    rows = [("HOT" if i % 9 else "S", rng.choice(["buy", "sell"]), rng.randint(1, 9), 100 + i % 11, 1) for i in range(400)]
    fills = fill_table(spark, rows)
    columns = ["symbol", "ts", "quantity_after", *[F.round(c, 6) for c in ("average_price", "fees_after", "realized_pnl")]]
    seen = written(monkeypatch, blocks, shift_maps, led)
    book = led.screened_ledger(fills, bits=4)
    assert seen and max(n for _, n in seen) < 100
    monkeypatch.undo()
    kept = book.orderBy("symbol", "ts").select("sequence").collect()
    assert [r.sequence for r in kept] == sorted({r.sequence for r in kept})
    less = led.screened_ledger(fills, bits=4, without=["client_order_id"])
    assert set(book.columns) - set(less.columns) == {"client_order_id"}
    want = sorted(map(str, led.ledger(led.inventory_clamp(fills)).select(*columns).collect()))
    assert sorted(map(str, book.select(*columns).collect())) == sorted(map(str, less.select(*columns).collect())) == want


def test_fills_are_told_apart_as_numbers(spark, tmp_path):
    import duckdb
    from tapeworks.plans import fixtures as fx
    from tapeworks.plans.views import with_views

    con = duckdb.connect()
    # Ids with a gap may be equal; parts may be listed twice or have two brands.
    con.execute(
        """CREATE TABLE lineitem AS SELECT o::BIGINT AS l_orderkey, n::INTEGER AS l_linenumber, p::BIGINT AS l_partkey,
        s::BIGINT AS l_suppkey, q::DOUBLE AS l_quantity, 10.5 * q AS l_extendedprice, 0.01 * q AS l_tax, r AS l_returnflag,
        TIMESTAMP '1995-01-01' AS l_shipdate FROM (VALUES (1, 2, 3, 4, 5, 'R'), (1, 2, 3, 4, 6, 'N'), (NULL, 1, 3, 4, 7, 'N'),
        (1, NULL, 3, 4, 8, NULL), (1, 3, 3, NULL, 9, 'A'), (1, NULL, 3, NULL, 3, 'R'), (NULL, NULL, 3, 1, 2, 'R'),
        (2, 1, 5, 14, 3, 'N'), (2, 1, NULL, 14, 3, 'N')) t(o, n, p, s, q, r)"""
    )
    con.execute("CREATE TABLE part AS SELECT * FROM (VALUES (3::BIGINT, 'B1'), (3, 'B1'), (5, 'B1'), (5, 'B2')) t(p_partkey, p_brand)")
    for name in ("lineitem", "part"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = fx.fills(spark, str(tmp_path))
    want = con.execute(with_views(f"SELECT {', '.join(got.columns)} FROM fills")).fetchall()
    text = lambda r: [str(x) for x in r]
    assert sorted(text(r) for r in got.collect()) == sorted(text(r) for r in want)
    plan = fx.fills(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*client_order_id", plan)


@pytest.mark.parametrize("numbered", [True, False])
def test_states_from_one_row_per_position_and_instant(spark, monkeypatch, numbered):
    rng, rows = random.Random(2), []
    for i in range(240):  # six fills of two positions at an instant
        at, side = NOW + timedelta(days=i // 6), "buy" if i < 6 else rng.choice(["buy", "sell"])
        rows.append(("A", "XY"[i % 2], f"o{i:04d}", side, rng.randint(1, 9), D(100 + rng.randint(0, 9)), D(1), at))
    fills = spark.createDataFrame(
        rows, "account string, symbol string, client_order_id string, side string, quantity long, price decimal(18,2), "
        "cost decimal(18,2), ts timestamp"
    )
    closes = [("X", NOW + timedelta(days=d), D(90 + d)) for d in range(1, 45, 3)]
    marks = spark.createDataFrame(closes, "symbol string, ts timestamp, price decimal(18,2)")
    book = led.screened_ledger(fills, bits=4) if numbered else led.ledger(led.inventory_clamp(fills))
    seen = written(monkeypatch, led)
    got = {r.ts.timestamp(): r for r in led.snapshots(book, marks, GRID, "100000").collect()}
    assert dict(seen)["events"] <= len({(r[1], r[-1]) for r in rows} | {(s, t) for s, t, _ in closes})
    held, mark, basis, fees, cash = {"X": 0, "Y": 0}, {}, {"X": 0, "Y": 0}, {"X": 0, "Y": 0}, 100000
    for at in sorted({r[-1] for r in rows} | {t for _, t, _ in closes}):
        moved = any(t == at for _, t, _ in closes)
        for _, symbol, _, side, quantity, price, _, ts in rows:
            if ts != at or side == "sell" and held[symbol] < quantity:
                continue
            moved = True
            mark[symbol], old = float(price), held[symbol]
            held[symbol] += quantity if side == "buy" else -quantity
            cash += (-1 if side == "buy" else 1) * quantity * float(price) - 1
            basis[symbol] += quantity * float(price) if side == "buy" else -basis[symbol] * quantity / old
            fees[symbol] += 1 if side == "buy" else -fees[symbol] * quantity / old
        mark |= {s: float(p) for s, t, p in closes if t == at}
        exposure = sum(held[s] * m for s, m in mark.items())
        if not moved:
            continue
        state = got.pop(at.timestamp())
        assert (float(state.cash), state.exposure) == pytest.approx((cash, exposure))
        assert state.unrealized_pnl == pytest.approx(exposure - sum(basis.values()) - sum(fees.values()), abs=1e-4)
    assert not got
