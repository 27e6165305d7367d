"""Order MinHash fingerprints of texts, in DataFrame functions only.

A text's tokens (runs of up to ``TOKEN`` characters without white space) form k-mers of ``k`` tokens; the n-th
occurrence of a k-mer in a text is told apart from the first by its number. Every numbered k-mer has a hash.
The hashes are dealt into ``BINS`` bins by their top bits; of each bin the ``tuple_size`` least are chosen, put back
in text order, and hashed together. Two texts then agree in a bin if they share its least k-mers in the same
order, which makes the share of agreeing bins sensitive to edits and moves and not only to the set of k-mers.

A fingerprint is one hash per bin, NULL where a bin is empty. The likeness of two fingerprints is the share of bins
that agree among those that either fills; two texts without tokens are alike (1), one with and one without are not (0).

Occurrence numbers come from the sorted array of a text's k-mer hashes: equal ones lie together, and the
number is the place in that run, found by doubling steps. All of a fingerprint's work stays inside the row of its text.

In scripts without spaces a text's runs are cut every ``TOKEN`` characters, so an inserted character shifts the tokens
behind it up to the next white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = 12
K = 2
BIN_BITS = 5
BINS = 1 << BIN_BITS
#: Bits for a token's place in its text.
PLACE_BITS = 26
TUPLE = 2
#: Documents are put in order inside ranges of ids; this many ranges at most come back to the driver, one row each.
RANGES = 512


def order_minhash(text: Column, k: int = K, tuple_size: int = TUPLE) -> Column:
    """The fingerprint of a text as an array of ``BINS`` longs.

    Hash and place of a k-mer share a long, the place in its low ``PLACE_BITS``, so sorting is of plain longs.
    """
    tokens = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"[^\\s]{{1,{TOKEN}}}"), F.lit(0))
    hashed = F.transform(tokens, lambda t: F.xxhash64(t))
    # each token with those after it; at the end of a text of enough tokens some are missing: not a k-mer
    placed = _let(
        hashed,
        lambda h: F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - k + 1, F.lit(1))),
            lambda x, i: _with_place(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]), i),
        ),
    )
    numbered = _let(F.sort_array(placed), _numbered)
    return _let(F.sort_array(numbered), lambda row: _signature(row, tuple_size))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


_PLACE = (1 << PLACE_BITS) - 1


def _with_place(value: Column, place: Column) -> Column:
    return value.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.bitwiseAND(F.lit(_PLACE)))


def _numbered(run: Column) -> Column:
    """Hash and place of every k-mer with its occurrence number taken into the hash, from the sorted array."""

    def renewed(x: Column, i: Column) -> Column:
        own = F.shiftright(x, PLACE_BITS)
        same = lambda back: F.shiftright(F.get(run, i - back), PLACE_BITS) == own  # noqa: E731  none before the first
        step = lambda t, bit: F.when(same(t + bit), t + bit).otherwise(t)
        count = lambda top: F.aggregate(F.array(*[F.lit(1 << b) for b in range(top, -1, -1)]), F.lit(0), step)
        # most k-mers occur once or a few times
        number = (
            F.when(~F.coalesce(same(1), F.lit(False)), 0)
            .when(~F.coalesce(same(2), F.lit(False)), 1)
            .when(~F.coalesce(same(16), F.lit(False)), count(3))
            .when(~F.coalesce(same(1024), F.lit(False)), count(9))
            .otherwise(count(PLACE_BITS))
        )
        return _with_place(F.xxhash64(own, number), x)

    return F.transform(run, renewed)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def _signature(row: Column, tuple_size: int) -> Column:
    """One hash per bin from the sorted array: the bin is the top bits, so its least elements come first in its run.

    An element is among them if the one ``tuple_size`` places before it is of another bin.
    """
    least = F.filter(row, lambda x, i: ~_bin(F.get(row, i - tuple_size)).eqNullSafe(_bin(x)))
    pieces = F.transform(
        least, lambda x: F.struct(x.bitwiseAND(F.lit(_PLACE)).alias("p"), F.shiftright(x, PLACE_BITS).alias("h"))
    )
    return _let(
        F.sort_array(pieces),  # by place; at most BINS * tuple_size
        lambda o: F.transform(
            F.sequence(F.lit(0), F.lit(BINS - 1)),
            lambda b: _let(
                F.transform(
                    F.filter(o, lambda x: F.shiftright(x["h"], 64 - BIN_BITS - PLACE_BITS).bitwiseAND(F.lit(BINS - 1)) == b),
                    lambda x: x["h"],
                ),
                lambda hs: F.when(F.size(hs) > 0, F.xxhash64(hs)),
            ),
        ),
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of bins that agree among those that either fingerprint fills."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    filled = F.size(F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
    agree = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(filled == 0, 1.0).otherwise(agree / filled).cast("double")


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as hexadecimal text, bins separated by dots, empty bins blank."""
    return F.array_join(F.transform(fingerprint, lambda x: F.coalesce(F.lower(F.hex(x)), F.lit(""))), ".")


def range_cuts(docs: DataFrame, id_column: str = "doc_id", ranges: int = RANGES) -> list[int]:
    """Up to ``ranges - 1`` ids that cut the ids into ranges of about equal numbers of rows."""
    ids = docs.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("_id"))
    return sorted({int(c) for c in ids.approxQuantile("_id", [i / ranges for i in range(1, ranges)], 0.5 / ranges)})


def range_of(id_: Column, cuts: list[int]) -> Column:
    """The number of cuts below an id, by halving steps."""
    if not cuts:
        return F.lit(0)
    bound = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bound, at + step - 1) < id_, at + step).otherwise(at))


def compare_with_edits(docs: DataFrame, id_column: str = "doc_id", text: str = "text", ranges: int = RANGES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike it is to that and to the next document.

    The edited text has its last third (rounded down, in code points) replaced by as many (or all) first code points of
    the next document, that of the next smaller id (the largest for the smallest). If that id is repeated, the row with
    the least hash of its text is the next document. NULL texts are empty; rows with a NULL id come last and are
    followed by no document (an empty text). Repeated rows stay, other columns are not looked at, and an empty table
    gives no rows.

    Texts are shuffled once, by ranges of ids, with their fingerprints. Inside a range the next document is the last one
    before a row in the order of ids. What crosses ranges is the last document of each, at most ``ranges`` texts.
    """
    spark = docs.sparkSession
    cuts = range_cuts(docs, id_column, ranges)
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("_hash", F.xxhash64("text"))
    known = base.filter("id IS NOT NULL").withColumn("_range", range_of(F.col("id"), cuts))
    # a text's range; rows without id are spread over ranges of their own
    place = F.when(F.col("id").isNull(), -1 - F.pmod("_hash", F.lit(ranges)).cast("int")).otherwise(range_of(F.col("id"), cuts))
    placed = base.select("*", place.alias("_range"), order_minhash(F.col("text")).alias("a"))
    order = Window.partitionBy("_range").orderBy("id", F.desc("_hash"))
    # of the rows of an id the last one in this order stands for it
    marked = placed.withColumn("_stands", F.col("id").isNotNull() & ~F.lead("id").over(order).eqNullSafe(F.col("id")))
    document = F.struct("text", "a")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    met = marked.withColumn("_next", F.last(F.when(F.col("_stands"), document), ignorenulls=True).over(before))

    tops = sorted((r["_range"], r["top"]) for r in known.groupBy("_range").agg(F.max("id").alias("top")).collect())
    follows = [(r, tops[k - 1][0]) for k, (r, _) in enumerate(tops)]  # the first range follows on the last
    follows = spark.createDataFrame(follows, "_range int, _source int")
    last = known.groupBy("_range").agg(F.max_by("text", F.struct("id", F.bitwise_not("_hash"))).alias("_last"))
    crossing = follows.join(last.withColumnRenamed("_range", "_source"), "_source").select(
        "_range", F.struct(F.col("_last").alias("text"), order_minhash(F.col("_last")).alias("a")).alias("_crossing")
    )
    met = met.join(crossing, "_range", "left").withColumn("_next", F.coalesce("_next", "_crossing"))

    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    begin = F.coalesce(F.col("_next.text"), F.lit(""))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(begin, F.lit(1), third))
    empty = F.array_repeat(F.lit(None).cast("long"), BINS)
    made = met.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "a", F.coalesce("_next.a", empty).alias("c"))
    out = made.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), order_minhash(F.col("edited")).alias("b"), "a", "c")
    return out.select(
        F.col("id").alias(id_column), "n_chars", "edited_sha256",
        as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
