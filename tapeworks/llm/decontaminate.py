"""Benchmark passages in documents, by a prefix-filtered join and exact windows.

Every run of ten item words is a set that must be contained whole, so the prefix that a match cannot
miss is a single token: the rarest word of the window, by its count in the corpus. Neighbouring windows
with the same rarest word form one anchor. Document words are joined with the anchors' words; position
bounds say how far to either side an anchor reaches, and comparing word by word there gives the windows
that stand in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.base import text_key
from tapeworks.session import staged

WINDOW = 10
#: Rows of a broadcast table or a word list; what has more is joined in several rounds.
BROADCAST_ROWS = 20_000

#: All ASCII characters that are not letters or digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _cut(text: str | Column) -> Column:
    """Words as written; a separator at either end leaves an empty word there."""
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _BETWEEN, -1)


def _lower(word: Column) -> Column:
    """A-Z in lower case, nothing else."""
    ascii_ = F.octet_length(word) == F.char_length(word)
    return F.when(ascii_, F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _n_words(cut: Column) -> Column:
    empty = (F.element_at(cut, 1) == "").cast("long")
    last = ((F.element_at(cut, -1) == "") & (F.size(cut) > 1)).cast("long")
    return F.size(cut) - empty - last


def _rounds(small: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """The table in pieces of about ``rows`` rows, each to be broadcast."""
    n = 1 + small.count() // rows
    piece = F.pmod(F.xxhash64(key), F.lit(n))
    return [F.broadcast(small.filter(piece == i) if n > 1 else small) for i in range(n)]


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def sequences(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct word sequences (seq, words), and the items that have them (seq, item_id)."""
    words = F.transform(F.filter(_cut("text"), lambda w: w != ""), _lower)
    items = benchmark.select("item_id", words.alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("seq", F.sha2(F.array_join("words", " "), 256))
    return items.groupBy("seq").agg(F.first("words").alias("words")), items.select("seq", "item_id").distinct()


def anchors(docs: DataFrame, seqs: DataFrame, window: int, rows: int) -> DataFrame:
    """word, seq, before, after, size and words: the rarest word of neighbouring windows and what
    they hold to either side of it. Windows with a word that no document has are left out."""
    vocabulary = seqs.select(F.explode("words").alias("word")).distinct()
    seen = docs.select(F.explode(_cut("text")).alias("w")).select(_lower(F.col("w")).alias("word"))
    counts = _union(
        [seen.join(v, "word").groupBy("word").agg(F.count("*").alias("n")) for v in _rounds(vocabulary, "word", rows)]
    )
    counts = staged(counts, "word-counts")
    each = seqs.select("seq", F.size("words").alias("len"), F.posexplode("words").alias("at", "word"))
    each = each.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = F.least(F.lit(window), F.col("len"))
    # Each word belongs to the windows that start up to size - 1 words before it.
    first = F.greatest(F.lit(0), F.col("at") - size + 1)
    start = F.explode(F.sequence(first, F.least(F.col("at"), F.col("len") - size)))
    rarest = (
        each.select("seq", "at", "word", "n", size.alias("size"), start.alias("start"))
        .groupBy("seq", "start", "size")
        .agg(F.min(F.struct("n", "word", "at")).alias("r"))
        .filter("r.n > 0")
        .groupBy("seq", "size", F.col("r.at").alias("at"), F.col("r.word").alias("word"))
        .agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    )
    reach = F.col("hi") + F.col("size") - F.col("lo")
    return rarest.join(seqs, "seq").select(
        "word", "seq", "size", (F.col("at") - F.col("lo")).alias("before"),
        (F.col("hi") + F.col("size") - 1 - F.col("at")).alias("after"),
        F.slice("words", F.col("lo") + 1, reach).alias("words"),
    )


def _agreeing(mine: Column, theirs: Column, most: Column) -> Column:
    """How many words agree from the start on."""
    same = F.zip_with(mine, theirs, lambda a, b: _lower(a) == b)
    first = F.array_position(same, False)
    return F.when(first > 0, first.cast("int") - 1).otherwise(most)


def _spots(words: list[str], reach: int):
    """A word that is one of ``words``, with its place and what stands up to ``reach`` words away."""

    def near(w: Column, i: Column) -> Column:
        low, left = _lower(w), F.least(i, F.lit(reach))
        around = F.slice("cut", i - left + 1, left + 1 + reach)
        made = F.struct(low.alias("word"), i.alias("p"), left.alias("at"), around.alias("near"))
        return F.when(low.isin(words), made)

    return near


def passages(docs: DataFrame, found: DataFrame, window: int, rows: int) -> DataFrame:
    """doc_id, key_, seq, first and last word position of the windows found around each anchor.

    Words that anchor nothing are sorted out inside the array of a text; only the others become rows,
    each with the few words around it that an anchor can reach.
    """
    cut = docs.select("doc_id", "key_", _cut("text").alias("cut"))
    hits = []
    for a in _rounds(found, "word", rows):
        words = [r["word"] for r in a.select("word").distinct().collect()]  # at most ``rows``

        each = F.explode(F.filter(F.transform("cut", _spots(words, window - 1)), lambda c: c.isNotNull()))
        spots = cut.select("doc_id", "key_", each.alias("c")).select("doc_id", "key_", "c.*")
        left = F.least("before", "at")
        right = F.least(F.col("after"), F.size("near") - 1 - F.col("at"))
        sides = spots.join(a, "word").select(
            "doc_id", "key_", "seq", "p", "size", left.alias("l"), right.alias("r"),
            F.slice("near", F.col("at") - left + 1, left).alias("dl"),
            F.slice("words", F.col("before") - left + 1, left).alias("wl"),
            F.slice("near", F.col("at") + 2, right).alias("dr"),
            F.slice("words", F.col("before") + 2, right).alias("wr"),
        )
        hits.append(
            sides.select(
                "doc_id", "key_", "seq", "size", "p",
                _agreeing(F.reverse("dl"), F.reverse("wl"), F.col("l")).alias("l"),
                _agreeing(F.col("dr"), F.col("wr"), F.col("r")).alias("r"),
            ).filter(F.col("l") + F.col("r") + 1 >= F.col("size"))
            .select(
                "doc_id", "key_", "seq",
                (F.col("p") - F.col("l")).alias("first"), (F.col("p") + F.col("r")).alias("last"),
            )
        )
    return _union(hits)


def _covered(ranges: Column) -> Column:
    """Positions in the union of sorted ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("upto"))

    def step(acc: Column, r: Column) -> Column:
        new = F.greatest(F.lit(0), r["last"] - F.greatest(acc["upto"], r["first"] - 1))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["upto"], r["last"]).alias("upto"))

    return F.aggregate(ranges, start, step, lambda acc: acc["n"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Benchmark windows in every row of ``docs`` (doc_id, text).

    Words are runs of letters and digits, A-Z in lower case. A window is ``window`` consecutive words
    of an item; a shorter item is one window. Returns doc_id, key_ (a hash of the text, which tells
    rows with the same doc_id apart), n_words, n_hit (words inside a window found), n_items, items (the
    items' ids as sorted strings) and contaminated. A null or empty text has no words and no hits; an
    item without words matches nothing; items that share a text are all named; an item with a null
    item_id counts for the words, not for the items. An empty benchmark leaves all documents clean.
    Repeated rows stay. Other columns are not read.
    """
    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key_"))
    seqs, items = sequences(benchmark)
    seqs = staged(seqs, "sequences")
    found = staged(anchors(rows_of, seqs, window, rows), "anchors")
    hits = staged(passages(rows_of, found, window, rows), "passages")
    by = ["doc_id", "key_"]
    ranges = hits.groupBy(*by).agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("ranges"))
    named = (
        hits.select(*by, "seq").distinct().join(items, "seq")
        .groupBy(*by).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.key_").eqNullSafe(F.col(f"{b}.key_"))

    judged = ranges.alias("r").join(named.alias("i"), same("r", "i"), "left").select(
        "r.doc_id", "r.key_", _covered(F.col("ranges")).alias("n_hit"), "items"
    )
    sizes = rows_of.select(*by, _n_words(_cut("text")).cast("long").alias("n_words"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return sizes.alias("d").join(judged.alias("j"), same("d", "j"), "left").select(
        "d.doc_id", "d.key_", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"), items_.alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
