"""Small generated series and slow sequential twins."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

START = datetime(2024, 1, 1, tzinfo=UTC)
BAR_SCHEMA = (
    "instrument_id string, ts timestamp, close double, high double, low double, volume double, "
    "open_interest double, underlying_price double, strike double, expiry timestamp, "
    "provenance string, dataset_version string, synthetic boolean"
)


def wave(n: int, name: str = "A", gap: int = 1) -> list[tuple]:
    """A saw of ten steps on a slow slope; every ``gap`` minutes."""
    rows = []
    for i in range(n):
        close = 80 + 3 * i % 10 + i / 16
        at = START + timedelta(minutes=i * gap)
        rows.append(
            (name, at, close, close + 1.5, close - 1, 40.0 + 2 * i, None, None, None, None, "p", "v", True)
        )
    return rows


def walk(n: int, name: str, seed: int, flat: range = range(0)) -> list[tuple]:
    """Random walk with irregular gaps and an optional stretch without any change."""
    rng = random.Random(seed)
    price, minute, rows = 100.0, 0, []
    for i in range(n):
        minute += rng.choice([1, 1, 1, 2, 600])
        if i not in flat:
            price = max(1.0, price + rng.uniform(-2, 2))
        high, low = (price, price) if i in flat else (price + rng.random(), price - rng.random() / 2)
        at = START + timedelta(minutes=minute)
        rows.append(
            (name, at, price, high, low, float(rng.randint(0, 50)), None, None, None, None, "p", "v", True)
        )
    return rows


def ema_loop(values: list[float], period: int) -> list[float]:
    alpha, out = 2 / (period + 1), []
    for v in values:
        out.append(v if not out else out[-1] + alpha * (v - out[-1]))
    return out


def wilder_loop(values: list[float], seed_at: int, period: int) -> list[float | None]:
    """Mean of the ``period`` values up to ``seed_at``, then one-over-period smoothing."""
    out, last = [], None
    for i, v in enumerate(values):
        if i == seed_at:
            last = sum(values[i - period + 1 : i + 1]) / period
        elif i > seed_at:
            last += (v - last) / period
        out.append(last)
    return out


def rsi_loop(closes: list[float], period: int) -> list[float | None]:
    moves = [0.0] + [b - a for a, b in zip(closes, closes[1:])]
    gains = wilder_loop([max(m, 0.0) for m in moves], period, period)
    losses = wilder_loop([max(-m, 0.0) for m in moves], period, period)
    out = []
    for g, lo in zip(gains, losses):
        if g is None:
            out.append(None)
        elif lo == 0:
            out.append(50.0 if g == 0 else 100.0)
        else:
            out.append(100 - 100 / (1 + g / lo))
    return out


def atr_loop(rows: list[tuple], period: int) -> list[float | None]:
    ranges = []
    for i, r in enumerate(rows):
        spread = r[3] - r[4]
        if i:
            before = rows[i - 1][2]
            spread = max(spread, abs(r[3] - before), abs(r[4] - before))
        ranges.append(spread)
    return wilder_loop(ranges, period - 1, period)
