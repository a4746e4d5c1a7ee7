"""Source divergence audit: how the words of each source differ from those of its language.

One pass over the bytes lowers letters and blanks what separates terms; a split and a counter per document
then give its frequencies. Tasks add up their documents before anything moves, so what is shuffled is one
row for each task, group and term. Shares are integers of a thousand millionth, and all arithmetic is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.base import as_bytes
from tapeworks.session import staged

MIN_DOCS, TERM_RANKS, SCALE = 3, 200, 1_000_000_000
#: A-Z become a-z; all other ASCII but letters becomes a blank; bytes of other characters stay.
TABLE = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
#: Bytes of a text that are split at once; terms of a task that are added up before they are given on.
_PIECE, _HELD = 8 << 20, 400_000
#: Shares that a task compares at once (terms times sources).
CELLS = 400_000


def pieces(text: bytes, most: int = _PIECE) -> Iterator[bytes]:
    """Translated text, cut at blanks into pieces of about ``most`` bytes."""
    text = text.translate(TABLE)
    start = 0
    while len(text) - start > most:
        end = text.find(b" ", start + most)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def terms_of(text: bytes) -> Counter:
    found: Counter = Counter()
    for piece in pieces(text):
        found.update(piece.split())
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs; a row without a term for each group."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def give() -> pa.RecordBatch:
        names: list[tuple] = list(groups)
        of, terms, n, docs = [], [], [], []
        for i, (count, spread) in enumerate(groups.values()):
            of += [i] * (len(count) + 1)
            terms += [None, *count]
            n += [0, *count.values()]
            docs += [0, *map(spread.__getitem__, count)]
        at = pa.array(of, pa.int64())
        lang, source = (pa.array([x[k] for x in names], pa.string()).take(at) for k in (0, 1))
        return pa.RecordBatch.from_arrays(
            [lang, source, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
            ["lang", "source", "term", "n", "docs"],
        )

    for batch in batches:
        texts = as_bytes(batch.column("text"))
        keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for text, key in zip(texts, keys, strict=True):
            count, spread = groups.setdefault(key, (Counter(), Counter()))
            before = len(count)
            found = terms_of(text or b"")
            count.update(found)
            spread.update(found.keys())
            held += len(count) - before
            if held >= _HELD:
                yield give()
                groups.clear()
                held = 0
    if groups:
        yield give()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs over all documents; term is null in one row of each group."""
    rows = docs.select(
        "text", *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in ("lang", "source")]
    )
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str):
    """1 + floor(SCALE * (n + 1) / (total + terms)); decimals hold any product."""
    return F.expr(
        f"1 + (cast({n} + 1 as decimal(20,0)) * cast({SCALE} as decimal(11,0))) div "
        f"cast({total} + {terms} as decimal(20,0))"
    )


def _excess(p, q):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _differences(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the terms of one slice of a language, for each pair of its sources."""
    sources = right.column("source").to_pylist()
    none = right.column("p0").to_numpy()
    at = {x: i for i, x in enumerate(sources)}
    seen: dict[str, int] = {}
    row = np.fromiter((seen.setdefault(x, len(seen)) for x in left.column("term").to_pylist()), np.int64, left.num_rows)
    shares = np.tile(none, (len(seen), 1))
    column = np.fromiter((at[x] for x in left.column("source").to_pylist()), np.int64, left.num_rows)
    shares[row, column] = left.column("p").to_numpy()
    a, b, value = [], [], []
    for i, source in enumerate(sources):
        gap = shares[:, i : i + 1] - shares
        sums = (gap * gap // shares).sum(axis=0)
        for j, other in enumerate(sources):
            if i != j:
                a.append(source)
                b.append(other)
                value.append(int(sums[j]))
    lang = pa.array([key[0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "source": pa.array(a, pa.string()), "item": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: what tells the sources of a language apart.

    Terms are runs of letters A-Z, a-z and characters beyond ASCII, only A-Z in lower case. A language keeps
    the terms that ``min_docs`` of its documents hold. A share p is ``1 + floor(SCALE * (count + 1) / (N + V))``
    with N the counts of the group's kept terms and V the number of kept terms; of a share p against q the
    value is ``floor((p - q)^2 / q)``. Part ``pair``: each other source of the language, q its shares, summed
    over all kept terms (0 without any). Part ``term``: kept terms of the group with p over the q of the whole
    language, up to ``term_ranks``. Ranks go by value, largest first, then by item.

    Null text, lang or source are empty. A group without kept terms still has its pairs. Every row is a
    document, repeated ids and rows too; doc_id and other columns are not read. No rows give none. Counts are
    exact up to about 9e18, sums of values while shares of one group add up to under 3e9.
    """
    rows = staged(counted(docs), "terms")
    words = rows.filter("term IS NOT NULL")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    kept = staged(kept.filter(F.col("docs") >= min_docs).drop("docs"), "kept")
    own = staged(words.drop("docs").join(kept, ["lang", "term"]), "own")

    langs = kept.groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count("*").alias("terms"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").na.fill(0, ["total", "terms", "all_total"])
    width = F.count("*").over(Window.partitionBy("lang"))
    groups = groups.withColumn("slices", (1 + F.expr("cast(terms as decimal(20,0))") * width / cells).cast("long"))
    bare = F.when(F.col("terms") > 0, share("0", "total", "nullif(terms, 0)")).otherwise(1)
    groups = staged(groups.withColumn("p0", bare.cast("long")), "groups")

    shares = own.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share("n", "total", "terms").alias("p"),
        share("all_n", "all_total", "terms").alias("q"),
        F.pmod(F.xxhash64("term"), "slices").alias("slice"),
    )
    shares = staged(shares, "shares")

    over = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _excess("p", "q").alias("value"))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= term_ranks)

    slices = groups.select("lang", "source", "p0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    named = shares.select("lang", "slice", "source", "term", "p")
    sums = (
        named.groupBy("lang", "slice").cogroup(slices.groupBy("lang", "slice"))
        .applyInArrow(_differences, "lang string, source string, item string, value long")
    )
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(ranks))
    return pairs.unionByName(over)
