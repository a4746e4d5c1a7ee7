"""Ordered series in blocks of a counted size, and states handed from block to block.

Rows are sorted by key and order over the whole table; Spark's range partitioning samples where to cut, so a
key with a large share of all rows spreads over as many tasks as it fills. A block is a run of at most
``2 ** bits`` rows of one partition and may hold many short keys or a piece of a long one. Only keys that go
on in a later block hand something over: the effect of a block as a map of its starting state. Maps compose,
so starts are found without going through the rows of a key one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.series import BLOCK
from tapeworks.session import staged

#: Rows of a block, as a power of two.
BITS = 14
#: What the rows of a key in a block do to what was before them, in the last of them.
EFFECT = "_effect"
#: The rows of a block in their order, as one value.
ROWS = "_rows"
#: Maps of a key that are gone through in one task; neighbouring maps that are composed into one.
ONE_LIST, FANOUT = 4096, 512


def ordered_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, bits: int = BITS, tie: Column | None = None
) -> DataFrame:
    """``df`` with ``_block``, which never falls along (keys, order). With ``tie``, rows equal in both are
    parted by it, so that very many of them don't meet in one task.

    The table is written, as what a sample cut once must stay cut.
    """
    columns = [c for c in df.columns if c != BLOCK]
    by = [F.col(c) for c in (*keys, *order)] + ([] if tie is None else [tie])
    ranged = df.select(*columns).repartitionByRange(*by).sortWithinPartitions(*by)
    number = F.shiftright(F.monotonically_increasing_id(), bits)
    return staged(ranged.withColumn(BLOCK, number), "ordered")


def packed_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], effect: Callable[[pa.Table], bytes], *,
    bits: int = BITS, kept: Sequence[str] | None = None,
) -> DataFrame:
    """keys, _block, _effect, _rows: blocks as ``ordered_blocks`` cuts them, one row for each key of a block that
    may go on in another one, with what ``effect`` makes of the key's rows in the block.

    The first of these rows holds the ``kept`` columns of all rows of the block as one value, in their order.
    What goes through a block later neither sorts it nor hands it over row by row. The table is written.
    """
    by, named = [*keys, *order], schema_of(df, keys)
    ranged = df.drop(BLOCK).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = ranged.select(*(c for c in (kept or df.columns) if c != BLOCK))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << (33 - bits)
        for n, table in enumerate(_runs(batches, 1 << bits)):
            ends = edges(key_starts(table, keys))
            found = table.select(list(keys)).take([a for a, _ in ends])
            effects = [effect(table.slice(a, b - a)) for a, b in ends]
            whole = [pack(table), *[None] * (len(ends) - 1)]
            found = found.append_column(BLOCK, pa.array([first + n] * len(ends), pa.int64()))
            found = found.append_column(EFFECT, pa.array(effects, pa.binary()))
            yield from found.append_column(ROWS, pa.array(whole, pa.binary())).to_batches()

    return staged(ranged.mapInArrow(packed, f"{named}, {BLOCK} long, {EFFECT} binary, {ROWS} binary"), "packed")


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows, so many at a time."""
    held: list[pa.RecordBatch] = []
    missing = rows
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, missing))
            missing -= held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if not missing:
                yield pa.Table.from_batches(held).combine_chunks()
                held, missing = [], rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pack(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def unpack(rows: pa.BinaryScalar) -> pa.Table:
    with pa.ipc.open_stream(rows.as_buffer()) as stream:
        return stream.read_all().combine_chunks()


def each_block(
    packed: DataFrame, starts: Sequence[DataFrame | None], step: Callable[[pa.Table, int, list], pa.Table], schema: str
) -> DataFrame:
    """What ``step`` makes of the rows of a block, the block's number and what its first key carries into it by each
    of ``starts`` (_block, state), none where that key begins. No other key of a block was there before it."""
    rows = packed.filter(F.col(ROWS).isNotNull()).select(BLOCK, ROWS).repartition(BLOCK)
    names = [f"_state{i}" for i in range(len(starts))]
    for name, one in zip(names, starts, strict=True):
        if one is None:
            rows = rows.withColumn(name, F.lit(None).cast("array<double>"))
        else:
            rows = rows.join(one.select(BLOCK, F.col("state").alias(name)), BLOCK, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, states = batch.column(BLOCK).to_pylist(), [batch.column(n).to_pylist() for n in names]
            for i, rows in enumerate(batch.column(ROWS)):
                yield from step(unpack(rows), blocks[i], [s[i] for s in states]).to_batches()

    return rows.mapInArrow(run, schema)


def bounded_buckets(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, *, tie: Column | None = None,
    bits: int = BITS,
) -> tuple[DataFrame, Column]:
    """``df`` and a bucket of at most ``2 ** bits`` rows of a key: the given one if counting shows that none is
    larger, else blocks."""
    largest = df.groupBy(*keys, bucket.alias("_b")).count().agg(F.max("count")).first()[0]
    if (largest or 0) <= 1 << bits:
        return df, bucket
    return ordered_blocks(df, keys, order, bits=bits, tie=tie), F.col(BLOCK)


def levels_for(blocks: DataFrame) -> int | None:
    """How often neighbouring maps are composed before they are gone through; none if no key goes on."""
    most = blocks.agg(F.max("at")).first()[0]
    if not most:
        return None
    return sum(most >= ONE_LIST * FANOUT**i for i in range(4))


def schema_of(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def key_starts(table: pa.Table, keys: Sequence[str]) -> list[int]:
    """Where each key starts (and the last one ends) in rows that are together by key."""
    new = np.arange(table.num_rows) == 0
    for k in keys:
        codes = pc.dictionary_encode(table.column(k), null_encoding="encode").combine_chunks().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return [*np.flatnonzero(new).tolist(), table.num_rows]


def grouped_rows(table: pa.Table, keys: Sequence[str], order: Sequence[str]) -> tuple[pa.Table, list[int]]:
    """The rows of a block in order (nulls first, as Spark sorts), and where each key starts (and the last one
    ends)."""
    by = [(c, "ascending") for c in (*keys, *order)]
    table = table.take(pc.sort_indices(table, sort_keys=by, null_placement="at_start")).combine_chunks()
    return table, key_starts(table, keys)


def edges(starts: list[int]) -> list[tuple[int, int]]:
    """First and last key of a block: no other can go on in another one."""
    both = list(zip(starts, starts[1:], strict=False))
    return both[:1] + both[1:][-1:]


def sparse(values: dict[int, bytes], n: int) -> pa.Array:
    """``n`` places that are null but for ``values``."""
    out: list[bytes | None] = [None] * n
    for at, value in values.items():
        out[at] = value
    return pa.array(out, pa.binary())


def known(column: pa.ChunkedArray) -> list:
    """Numbers of a column, none of which may be missing."""
    if column.null_count:
        raise ValueError("a quantity, price or cost is missing")
    return column.to_numpy().tolist()


def continued(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _block, _effect, at (0, 1, ... in each key) and more (a later block follows), one row a block of a
    key that may go on, from the rows of ``df`` that hold an effect."""
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    return df.filter(F.col(EFFECT).isNotNull()).select(
        *keys, BLOCK, EFFECT, (F.row_number().over(along) - 1).cast("long").alias("at"),
        F.lead(BLOCK).over(along).isNotNull().alias("more"),
    )


def starts_of(blocks: DataFrame, states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _block, state: what a key carries into each of its later blocks; written."""
    starts = blocks.join(states.withColumn("at", F.col("at") + 1), [*keys, "at"])
    return staged(starts.select(*keys, BLOCK, "state"), "starts")


def maps_of(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, at, map of every block that goes on."""
    return blocks.filter("more").select(*keys, "at", F.col(EFFECT).alias("map"))


def starting_states(
    maps: DataFrame,
    keys: Sequence[str],
    zero: Sequence[float],
    then: Callable[[bytes, bytes], bytes],
    step: Callable[[list[float], bytes], list[float]],
    *,
    levels: int = 0,
    fanout: int = FANOUT,
) -> DataFrame:
    """keys, at, state: what a key carries into the block after ``at``, from ``maps`` (keys, at, map).

    ``levels`` times, ``fanout`` neighbouring maps are first composed into one, so the list that is gone
    through for a key is that much shorter than its number of blocks.
    """
    keys = list(keys)
    named = schema_of(maps, keys)
    first = list(map(float, zero))

    def along(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        given = table.column("state")[0].as_py() if "state" in table.column_names else first
        at, states = table.column("at").to_pylist(), []
        for one in table.column("map").to_pylist():
            given = step(given, one)
            states.append(given)
        return _keyed(table, key, at, "state", pa.array(states, pa.list_(pa.float64())))

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        rest = iter(table.column("map").to_pylist())
        out = next(rest)
        for one in rest:
            out = then(out, one)
        return _keyed(table, key, [key[-1].as_py()], "map", pa.array([out], pa.binary()))

    def _keyed(table: pa.Table, key: tuple, at: list[int], name: str, value: pa.Array) -> pa.Table:
        own = {k: pa.array([key[i].as_py()] * len(at), table.column(k).type) for i, k in enumerate(keys)}
        return pa.table(own | {"at": pa.array(at, pa.int64()), name: value})

    if not levels:
        return maps.groupBy(*keys).applyInArrow(along, f"{named}, at long, state array<double>")
    pieces = maps.withColumn("_group", F.floor(F.col("at") / F.lit(fanout)))
    upper = pieces.groupBy(*keys, "_group").applyInArrow(whole, f"{named}, at long, map binary")
    states = starting_states(upper, keys, zero, then, step, levels=levels - 1, fanout=fanout)
    # What stands behind a group of maps stands before the next one.
    before = states.select(*keys, (F.col("at") + 1).alias("_group"), "state")
    start = F.coalesce("state", F.array(*[F.lit(x) for x in first]))
    lists = pieces.join(before, [*keys, "_group"], "left").withColumn("state", start)
    return lists.groupBy(*keys, "_group").applyInArrow(along, f"{named}, at long, state array<double>")
