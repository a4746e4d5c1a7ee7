"""Decisions in order that take from what is held, each only if enough is left.

A refused decision changes nothing, so every decision depends on the ones before it. The effect of a block of
decisions on the quantity held before it is an interval-shift map: starting quantities fall into intervals,
each moved by a number of its own. Maps compose, so blocks of one key are settled side by side: their maps
first, then their starting quantities, then each block once more from its start.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.blocks import (
    BITS,
    EFFECT,
    ROWS,
    continued,
    each_block,
    key_starts,
    known,
    levels_for,
    packed_blocks,
    schema_of,
    starting_states,
    starts_of,
    unpack,
)
from tapeworks.functions.series import BLOCK
from tapeworks.session import staged

#: What a row adds (above 0) or takes if enough is held (below 0), and what a key begins with (nothing, without it).
DELTA, START = "_delta", "_start"
#: Optional: what is held is never more.
MOST = "_most"
UNBOUNDED = 1 << 62
#: Intervals of a map that is made without knowing what may be held before its block.
EASY = 1024
#: A key that has not begun holds this; its first block knows what it begins with.
_UNBEGUN = -1


class ShiftMap:
    """What a run of decisions makes of any quantity held before it, up to ``most``.

    ``lows`` are the first quantities of each interval, ``shifts`` what is added there. Taking acts only on
    quantities that hold enough, so it splits the interval in which its own size, seen backwards, lies.
    """

    def __init__(self, lows: np.ndarray, shifts: np.ndarray, most: int):
        self.lows, self.shifts, self.most = lows, shifts, most

    @classmethod
    def of(cls, deltas: list[int], most: int = UNBOUNDED, limit: int | None = None) -> ShiftMap | None:
        """None if the map has more than ``limit`` intervals on the way."""
        lows, shifts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        # What all starts have gained alike, and the least that any holds without it.
        alike, least = 0, 0
        for delta in deltas:
            if delta >= 0 or least + alike + delta >= 0:
                alike += delta
                continue
            shifts, quantity, alike = shifts + alike, -delta, 0
            need = quantity - shifts  # the least start that holds enough
            ends = np.append(lows[1:], most + 1)
            whole, cut = need <= lows, (need > lows) & (need < ends)
            moved = np.where(whole, shifts - quantity, shifts)
            if cut.any():
                at = np.flatnonzero(cut) + 1
                lows = np.insert(lows, at, need[cut])
                moved = np.insert(moved, at, shifts[cut] - quantity)
            new = np.append(True, moved[1:] != moved[:-1])
            lows, shifts = lows[new], moved[new]
            least = int((lows + shifts).min())
            if limit is not None and len(lows) > limit:
                return None
        return cls(lows, shifts + alike, most)

    def at(self, quantity: int) -> int:
        return quantity + int(self.shifts[np.searchsorted(self.lows, quantity, "right") - 1])

    def then(self, later: ShiftMap) -> ShiftMap:
        """This map and a later one as one; ``later`` must take whatever this one gives."""
        lows, shifts = [], []
        ends = np.append(self.lows[1:], self.most + 1)
        for low, end, shift in zip(self.lows.tolist(), ends.tolist(), self.shifts.tolist(), strict=True):
            i = int(np.searchsorted(later.lows, low + shift, "right")) - 1
            j = int(np.searchsorted(later.lows, end + shift, "left"))
            lows += [low, *(later.lows[i + 1 : j] - shift).tolist()]
            shifts += (later.shifts[i:j] + shift).tolist()
        lows, shifts = np.array(lows, np.int64), np.array(shifts, np.int64)
        new = np.append(True, shifts[1:] != shifts[:-1])
        return ShiftMap(lows[new], shifts[new], self.most)

    def upto(self, most: int) -> ShiftMap:
        n = max(1, int(np.searchsorted(self.lows, most, "right")))
        return ShiftMap(self.lows[:n], self.shifts[:n], most)

    def pack(self) -> bytes:
        return struct.pack("<q", self.most) + self.lows.astype("<i8").tobytes() + self.shifts.astype("<i8").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> ShiftMap:
        both = np.frombuffer(raw, "<i8")
        n = len(both) // 2
        return cls(both[1 : n + 1], both[n + 1 :], int(both[0]))


_HEAD, _HEAD_BYTES = "<3q", 24


def _begin(table: pa.Table, row: int) -> int:
    return table.column(START)[row].as_py() if START in table.column_names else 0


def _effect(table: pa.Table) -> bytes:
    """What the key begins with if this is its first block, what its rows add, the bound on what refused ones
    leave (less what is held before), and their map if it is easy."""
    most = table.column(MOST)[0].as_py() if MOST in table.column_names else UNBOUNDED
    deltas = known(table.column(DELTA))
    moved = np.array(deltas, np.int64)
    sums, takes = np.cumsum(moved), moved < 0
    over = int((-moved - 1 - sums)[takes].max()) if takes.any() else -UNBOUNDED
    found = ShiftMap.of(deltas, most, EASY)
    head = struct.pack(_HEAD, _begin(table, 0), int(sums[-1]), over)
    return head if found is None else head + found.pack()


def _shift_maps(packed: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at, map for every block of a key that goes on in a later one.

    What is held is never larger than a bound that is easy to follow: taking s leaves at most the larger of
    what it would leave if allowed, and s - 1 if not. It keeps maps small where much is refused. Most maps were
    made with the blocks; the others are made here, from the rows of their blocks, up to the bound.
    """
    on, facts = [*keys, BLOCK], ["_begin", "_net", "_over"]

    def heads(batches):
        for batch in batches:
            raw = batch.column(EFFECT).to_pylist()
            found = zip(*(struct.unpack_from(_HEAD, x) for x in raw), strict=True) if raw else ((), (), ())
            arrays = [*(batch.column(c) for c in (*on, "at", EFFECT)), *(pa.array(x, pa.int64()) for x in found)]
            yield pa.RecordBatch.from_arrays(arrays, [*on, "at", EFFECT, *facts])

    going = blocks.filter("more").select(*on, "at", EFFECT)
    kinds = ", ".join(f"{c} long" for c in facts)
    bounds = going.mapInArrow(heads, f"{schema_of(going, going.columns)}, {kinds}")
    begin = F.when(F.col("at") == 0, F.col("_begin")).otherwise(0)
    earlier = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    bounds = bounds.withColumns({"_net": F.col("_net") + begin, "_over": F.col("_over") - begin})
    bounds = bounds.withColumn("_base", F.coalesce(F.sum("_net").over(earlier), F.lit(0)))
    peak = F.greatest(F.lit(0), F.max(F.col("_over") - F.col("_base")).over(earlier))
    bounds = bounds.withColumn(MOST, F.when(F.col("at") == 0, F.col("_begin")).otherwise(F.col("_base") + peak))
    bounds = bounds.withColumn("_easy", F.length(EFFECT) > _HEAD_BYTES)
    bounds = staged(bounds.select(*on, "at", EFFECT, MOST, "_easy"), "bounds")
    named = f"{schema_of(packed, keys)}, at long, map binary"

    def cut(batches):
        for batch in batches:
            both = zip(batch.column(EFFECT).to_pylist(), batch.column(MOST).to_pylist(), strict=True)
            maps = [x[: _HEAD_BYTES] + ShiftMap.unpack(x[_HEAD_BYTES :]).upto(most).pack() for x, most in both]
            arrays = [*(batch.column(c) for c in (*keys, "at")), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, "at", "map"])

    easy = bounds.filter("_easy").mapInArrow(cut, named)
    if not bounds.filter("NOT _easy").limit(1).count():
        return easy

    def make(batches):
        for batch in batches:
            maps = []
            facts = zip(batch.column(ROWS), batch.column(EFFECT).to_pylist(), batch.column(MOST).to_pylist(), strict=True)
            for rows, head, most in facts:
                table = unpack(rows)
                last = key_starts(table, keys)[-2]  # only the last key of a block goes on
                maps.append(head + ShiftMap.of(known(table.column(DELTA).slice(last)), most).pack())
            arrays = [*(batch.column(c) for c in (*keys, "at")), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, "at", "map"])

    hard = staged(bounds.filter("NOT _easy").drop("_easy"), "hard")
    again = hard.join(packed.filter(F.col(ROWS).isNotNull()).select(BLOCK, ROWS), BLOCK)
    return easy.unionByName(again.mapInArrow(make, named))


def _then(first: bytes, later: bytes) -> bytes:
    n = _HEAD_BYTES
    return first[:n] + ShiftMap.unpack(first[n:]).then(ShiftMap.unpack(later[n:])).pack()


def _step(state: list[float], one: bytes) -> list[float]:
    held = struct.unpack_from(_HEAD, one)[0] if state[0] == _UNBEGUN else int(state[0])
    return [float(ShiftMap.unpack(one[_HEAD_BYTES :]).at(held))]


def screened_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, bits: int = BITS, levels: int | None = None,
    kept: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``df`` in packed blocks, and what is held before those blocks in which a key goes on (none if
    no key does)."""
    keys = list(keys)
    packed = packed_blocks(df, keys, order, _effect, bits=bits, kept=kept)
    blocks = staged(continued(packed, keys), "blocks")
    levels = levels_for(blocks) if levels is None else levels
    if levels is None:
        return packed, None
    maps = _shift_maps(packed, blocks, keys)
    return packed, starts_of(blocks, starting_states(maps, keys, [_UNBEGUN], _then, _step, levels=levels), keys)


def replayed(table: pa.Table, keys: Sequence[str], state: list[float] | None) -> pa.Table:
    """The rows of a block with held_before and accepted; ``state`` is what its first key holds if it goes on."""
    starts, deltas = key_starts(table, keys), known(table.column(DELTA))
    before, accepted = [], []
    for a, b in zip(starts, starts[1:], strict=False):
        held = int(state[0]) if state is not None and not a else _begin(table, a)
        for delta in deltas[a:b]:
            before.append(held)
            fits = held + delta >= 0 or delta >= 0
            accepted.append(fits)
            if fits:
                held += delta
    table = table.drop_columns([c for c in (DELTA, START, MOST) if c in table.column_names])
    table = table.append_column("held_before", pa.array(before, pa.int64()))
    return table.append_column("accepted", pa.array(accepted, pa.bool_()))


def accept_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, bits: int = BITS, levels: int | None = None
) -> DataFrame:
    """Adds held_before, accepted and _block to ``df`` (with the whole number ``_delta`` and perhaps ``_start`` and
    ``_most``, which are dropped). ``levels``: how often neighbouring maps are composed first; by default as
    their number asks for."""
    keys = list(keys)
    packed, held = screened_blocks(df, keys, order, bits=bits, levels=levels)
    kept = [c for c in df.columns if c not in (DELTA, START, MOST, BLOCK)]

    def step(table: pa.Table, block: int, states: list) -> pa.Table:
        table = replayed(table, keys, states[0])
        return table.append_column(BLOCK, pa.array(np.full(table.num_rows, block, np.int64)))

    schema = f"{schema_of(df, kept)}, held_before long, accepted boolean, {BLOCK} long"
    return each_block(packed, [held], step, schema)
