"""Secrets in text: known forms by pattern, and random-looking strings by two character models.

A character Markov model of random strings and one of ordinary identifiers are trained on labelled
samples: the values of known secret forms on one side, the other long tokens of the same documents on
the other. A token is reported when its mean log-likelihood ratio per character pair is high enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The known forms in the order of kinds, and the length their value must have.
ASSIGN = (
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH = 12
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Tokens that the models judge, and those that the ordinary model learns from.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,}+"
#: About so many documents are learned from.
LEARN_DOCS = 4000
#: Mean log-likelihood ratio from which a token counts as random.
THRESHOLD = 0.5

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _spans(text: Column, pattern: str, kind: int, wanted=None) -> Column:
    """(start, kind, end) of all matches, in code points. Gaps and matches alternate, so running sums
    of their lengths give the places."""
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        first = acc["at"] + F.length(pair["gap"])
        end = first + F.coalesce(F.length(pair["found"]), F.lit(0))
        good = pair["found"].isNotNull()
        if wanted is not None:
            good &= wanted(pair["found"])
        span = F.struct(first.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        out = F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _value_is_long(found: Column) -> Column:
    return F.length(F.regexp_extract(found, ASSIGN, 2)) >= ASSIGN_LENGTH


def base_spans(text: Column) -> Column:
    """Spans of the known forms, sorted; a cheap test spares most texts the patterns."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    low = F.lower(text)
    keyed = F.lit(False)
    for word in _KEYWORDS:
        keyed = keyed | F.contains(low, F.lit(word))
    found = [
        F.when(keyed, _spans(text, ASSIGN, 0, _value_is_long)).otherwise(empty),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1)).otherwise(empty),
        F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(empty),
    ]
    return F.array_sort(F.concat(*found))


def _pairs(samples: DataFrame) -> DataFrame:
    at = F.explode(F.sequence(F.lit(1), F.length("sample") - 1))
    return samples.filter(F.length("sample") > 1).select("random", "sample", at.alias("i")).select(
        "random", F.substring("sample", F.col("i"), F.lit(1)).alias("a"),
        F.substring("sample", F.col("i") + 1, F.lit(1)).alias("b"),
    )


def learn(docs: DataFrame, *, most_docs: int = LEARN_DOCS, weight: float = 20.0) -> list[float]:
    """The log-likelihood ratios of all character pairs, as a table of len(ALPHABET) squared numbers.

    Samples: of about ``most_docs`` documents, taken by a hash of the id and text, the values of known
    forms (random) and all other tokens of four characters or more (ordinary). Pairs seen too seldom lean
    on the frequency of the second character, with a weight of ``weight`` pairs; that has 1 added to each
    count, so a model without samples is uniform.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    n = max(1, docs.count())
    share = min(1_000_000, most_docs * 1_000_000 // n + 1)
    taken = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share).select(text.alias("text"))
    secrets = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LENGTH),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    both = taken.select(secrets.alias("s"), words.alias("w"))
    ordinary = F.filter("w", lambda w: ~F.exists("s", lambda s: F.contains(w, s)))
    samples = both.select(F.lit(True).alias("random"), F.explode("s").alias("sample")).unionByName(
        both.select(F.lit(False).alias("random"), F.explode(ordinary).alias("sample"))
    )
    counts = {
        (r["random"], r["a"], r["b"]): r["n"]
        for r in _pairs(samples).groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()
    }  # at most two squares of the alphabet
    models = {}
    for kind in (True, False):
        single = {b: 1 + sum(counts.get((kind, a, b), 0) for a in ALPHABET) for b in ALPHABET}
        total = sum(single.values())
        for a in ALPHABET:
            after = sum(counts.get((kind, a, b), 0) for b in ALPHABET) + weight
            for b in ALPHABET:
                models[kind, a, b] = (counts.get((kind, a, b), 0) + weight * single[b] / total) / after
    return [math.log(models[True, a, b] / models[False, a, b]) for a in ALPHABET for b in ALPHABET]


def log_ratio(token: Column, table: Column) -> Column:
    """Mean over the pairs of a token of two characters or more."""
    size = len(ALPHABET)

    index = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.zip_with(
        F.slice(index, 1, F.length(token) - 1),
        F.slice(index, 2, F.length(token) - 1),
        lambda a, b: F.element_at(table, (a * size + b + 1).cast("int")),
    )
    total = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)
    return total / (F.length(token) - 1)


def scan(docs: DataFrame, table: list[float], *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``spans`` of every row of ``docs``: (start, kind, end) in code points, sorted.

    ``kind`` is an index into ``KINDS``. Spans of the known forms are always there; random ones are
    added where they touch none of these. A null or empty text has no spans; repeated rows stay; other
    columns are not read.
    """
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("base", base_spans(F.col("text")))
    tokens = F.when(
        F.col("text").rlike(TOKEN), _spans(F.col("text"), TOKEN, 3)
    ).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    rows = rows.withColumn("tokens", tokens)

    def random(span: Column) -> Column:
        token = F.substring(F.col("text"), span["start"] + 1, span["end"] - span["start"])
        apart = ~F.exists("base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        return apart & (log_ratio(token, ratios) > threshold)

    return rows.select("doc_id", F.array_sort(F.concat("base", F.filter("tokens", random))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
