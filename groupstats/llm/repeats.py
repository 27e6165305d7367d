"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

A byte goes if a string of ``width`` bytes that covers it also starts earlier (smaller id, or the same
document and an earlier start). Sorting all suffixes would shuffle every byte many times over, so:

1. **Sampled suffixes.** Every string of ``width`` bytes is represented by one place in it, the start of its
   least q-gram (leftmost if tied) in a hash order. Equal strings choose the same place in them, so only
   suffixes at chosen places (about 1 in 40) need sorting. q-grams that are frequent (counted in a hash table
   of fixed size, over a sixteenth of the documents) are ordered last; this moves places, never the result.
2. **Buckets.** A suffix's bucket is its q-gram's identifier. Identifiers of longer strings are made from the
   identifiers of two shorter ones, at the place and at a later offset, each level from the level before:
   8 bytes from 4, ... 64 from 32, then ``width``.
3. **First refinement.** Suffixes whose whole context (all strings they represent) is equal get a common
   identifier. All but the first of them are repeats. Those of the same task are found in it, so a passage in
   very many documents reaches the shuffle once a task. Contexts that are alone in their bucket end here.
4. **Second refinement.** For the first ones of buckets with several contexts, the context's bytes go to the
   bucket, and each of its strings gets its own identifier there; all but the first with it are repeats.
5. The runs found are brought to their documents.

Identifiers of strings are 128 bits: the bucket's 64 and 64 more from a second, independent chain.

NULL texts are empty. A NULL id comes after all others. Rows with the same id and text are one document given
several times (each gets its result); with the same id but different texts they are ordered by the text's
hash. Copies of a document are sampled, refined and listed once, whatever their number. Other columns are carried along,
whatever their names; those named like the appended ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from groupstats.llm.batches import gather, lists, release, slices, text_bytes
from groupstats.session import shared_folder

Q = 32  # bytes of a q-gram; a power of two
_CELLS = 1 << 20
_CHAINS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_PLACE_BITS = 24
#: Bytes of one step in a task; places in it must fit _PLACE_BITS.
STEP_BYTES = 2 << 20
_SHORT_BITS = 7


def _mix(a: np.ndarray, b: np.ndarray, chain: int) -> np.ndarray:
    """An identifier for a pair of identifiers."""
    x, y = (np.uint64(c) for c in _CHAINS[chain])
    h = a * x
    h ^= h >> np.uint64(29)
    h += b
    h *= y
    h ^= h >> np.uint64(32)
    return h


def identifiers(data: np.ndarray, width: int, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the Q bytes and of the ``width`` bytes at every place (meaningless across text ends)."""
    level = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_CHAINS[chain][0])
    size, grams = 1, None
    while size * 2 <= width:
        level = _mix(level[:-size], level[size:], chain) if len(level) > size else level[:0]
        size *= 2
        if size == Q:
            grams = level
    late = width - size
    whole = _mix(level[:-late], level[late:], chain) if 0 < late < len(level) else level if not late else level[:0]
    return grams, whole


def sampled(data: np.ndarray, bounds: np.ndarray, width: int, frequent: np.ndarray | None):
    """For the strings of ``width`` bytes inside texts: runs ``(first, last)`` of starts with the same place,
    and that place; also the identifiers."""
    grams, whole = identifiers(data, width, 0)
    sizes = np.diff(bounds)
    starts_per_text = np.maximum(sizes - width + 1, 0)
    none = np.zeros(0, np.int64)
    if not starts_per_text.any():
        return none, none, none, grams, whole
    shift = np.uint64(_PLACE_BITS)
    order = grams >> shift + np.uint64(1)
    if frequent is not None:
        order |= frequent[(grams & np.uint64(_CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(63 - _PLACE_BITS)
    order <<= shift
    order |= np.arange(len(order), dtype=np.uint64)
    span = width - Q + 1  # q-grams in a string
    least, size = order, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    at = gather(bounds[:-1], starts_per_text)
    place = (least[at] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], place[first], grams, whole


def _document_tie(text: str):
    """The order of documents of one id, or of none: the text's hash of 64 bits."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _pack_place(place: np.ndarray, before: np.ndarray, extent: np.ndarray) -> np.ndarray:
    """Place in the text, first start before it and number of starts (less one), so that order is kept."""
    return (place << 2 * _SHORT_BITS) | (before << _SHORT_BITS) | extent


def _unpack_place(packed: np.ndarray):
    mask = (1 << _SHORT_BITS) - 1
    return packed >> 2 * _SHORT_BITS, (packed >> _SHORT_BITS) & mask, packed & mask


def _fresh(part: pa.RecordBatch, seen: set[tuple[int, int]]) -> pa.RecordBatch:
    """The rows of documents that the task has not met; copies of a document would only say the same again."""
    if len(seen) > 500_000:
        seen.clear()
    new = []
    for key in zip(part.column("doc").to_pylist(), part.column("tie").to_pylist()):
        new.append(key not in seen)
        seen.add(key)
    return part if all(new) else part.filter(pa.array(new))


_SUFFIX = StructType([StructField(n, LongType()) for n in ("bucket", "context", "doc", "tie", "packed")])
_RUN = StructType([StructField(n, LongType()) for n in ("kind", "doc", "tie", "packed")])
_REPEAT, _OPEN = 0, 1


def _table(arrays: list[np.ndarray], schema: StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], schema.names)


def suffixes(docs: DataFrame, width: int, frequent: np.ndarray | None) -> DataFrame:
    """Sampled suffixes ``(bucket, context, doc, tie, packed)``. Of equal contexts in a step all but the first are known
    repeats: their ``packed`` is inverted, hence negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                part = _fresh(part, seen)
                if not part.num_rows:
                    continue
                data, bounds = text_bytes(part.column("text"))
                doc, tie = part.column("doc").to_numpy(), part.column("tie").to_numpy()
                for lo, hi, inner in _windows(bounds, width):
                    piece = data[lo:hi]
                    first, last, place, grams, whole = sampled(piece, inner - lo, width, frequent)
                    if not len(first):
                        continue
                    row = np.searchsorted(bounds, lo + first, side="right") - 1
                    base = bounds[row] - lo
                    before, extent = place - first, last - first
                    second = identifiers(piece, width, 1)[1]
                    context = _mix(_mix(second[first], second[last], 1), (before * 128 + extent).astype(np.uint64), 1)
                    packed = _pack_place(place - base, before, extent)
                    bucket, context = grams[place].view(np.int64), context.view(np.int64)
                    # equal contexts of this step: the first by document and place stands for all
                    order = np.lexsort((packed, tie[row], doc[row], context, bucket))
                    same = np.zeros(len(order), bool)
                    same[1:] = (bucket[order[1:]] == bucket[order[:-1]]) & (context[order[1:]] == context[order[:-1]])
                    same &= ~_is_first(same, doc[row][order], tie[row][order], packed[order])
                    again = np.zeros(len(order), bool)
                    again[order] = same
                    # a known repeat has its place inverted, and goes anywhere
                    spread = _mix(doc[row].view(np.uint64), packed.view(np.uint64), 1).view(np.int64)
                    yield _table(
                        [np.where(again, spread, bucket), context, doc[row], tie[row], np.where(again, ~packed, packed)],
                        _SUFFIX,
                    )

    return docs.mapInArrow(run, _SUFFIX)


def _is_first(same: np.ndarray, doc: np.ndarray, tie: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Which rows of sorted groups (``same`` as the row before) are their group's first one given again."""
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return (doc == doc[first]) & (tie == tie[first]) & (packed == packed[first])


def _windows(bounds: np.ndarray, width: int):
    """Ranges of a step's bytes: whole texts together, very long texts in overlapping parts."""
    total = int(bounds[-1])
    limit = (1 << _PLACE_BITS) - 1
    if total <= limit:
        yield 0, total, bounds
        return
    size = limit // 2
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        for start in range(lo, hi, size):
            stop = min(hi, start + size + width - 1)
            yield start, stop, np.array([start, stop])


def frequent_grams(docs: DataFrame, width: int) -> np.ndarray:
    """Which cells of a hash table of fixed size hold frequent q-grams, from one document in sixteen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros(_CELLS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                data, bounds = text_bytes(part.column("text"))
                for lo, hi, inner in _windows(bounds, width):
                    _, _, place, grams, _ = sampled(data[lo:hi], inner - lo, width, None)
                    if len(place):
                        np.add.at(counts, (grams[place] & np.uint64(_CELLS - 1)).astype(np.int64), 1)
        cells = np.flatnonzero(counts > 1)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    some = docs.filter(F.pmod(F.xxhash64("doc", "tie"), F.lit(16)) == 0)
    counted = some.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n >= 64")
    table = np.zeros(_CELLS, bool)
    table[counted.select("cell").toArrow()["cell"].to_numpy()] = True
    return table


def _by_bucket(batches: Iterator[pa.RecordBatch], key: str, work) -> Iterator[pa.RecordBatch]:
    """Hand runs of whole buckets of a partition sorted by ``key`` to ``work``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        split = int(np.searchsorted(keys, keys[-1], side="left"))
        if split == 0 and (not held or held[-1].column(key)[-1].as_py() == keys[0]):
            held.append(batch)
            continue
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield from work(pa.Table.from_batches(held))
            held = []
        if split:
            yield from work(pa.Table.from_batches([*held, batch.slice(0, split)]))
            held = []
        held.append(batch.slice(split))
    if held:
        yield from work(pa.Table.from_batches(held))


def first_refinement(found: DataFrame) -> DataFrame:
    """Repeats and open suffixes ``(kind, doc, tie, packed)`` of sampled suffixes."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, context, doc, tie, packed = (table[n].to_numpy() for n in _SUFFIX.names)
        known = packed < 0
        if known.any():
            yield _table([np.full(int(known.sum()), _REPEAT), doc[known], tie[known], ~packed[known]], _RUN)
            bucket, context, doc, tie, packed = (x[~known] for x in (bucket, context, doc, tie, packed))
        if not len(bucket):
            return
        order = np.lexsort((packed, tie, doc, context, bucket))
        bucket, context, doc, tie, packed = (x[order] for x in (bucket, context, doc, tie, packed))
        new_bucket = np.ones(len(order), bool)
        new_bucket[1:] = bucket[1:] != bucket[:-1]
        new = new_bucket.copy()
        new[1:] |= context[1:] != context[:-1]
        contexts = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_bucket))
        several = (contexts > 1)[np.cumsum(new_bucket) - 1]
        again = ~new & ~_is_first(~new, doc, tie, packed)
        out = again | (new & several)
        kind = np.where(new, _OPEN, _REPEAT)
        yield _table([kind[out], doc[out], tie[out], packed[out]], _RUN)

    dealt = found.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda batches: _by_bucket(batches, "bucket", work), _RUN)


def second_refinement(contexts: DataFrame, width: int) -> DataFrame:
    """Repeated strings ``(kind, doc, tie, packed)`` among ``(bucket, doc, tie, packed, bytes)``, a context for each suffix."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        data, bounds = text_bytes(table["bytes"].combine_chunks())
        bucket, doc, tie, packed = (table[n].to_numpy() for n in ("bucket", "doc", "tie", "packed"))
        place, before, extent = _unpack_place(packed)
        one, two = identifiers(data, width, 0)[1], identifiers(data, width, 1)[1]
        at = gather(bounds[:-1], extent + 1)
        row = np.repeat(np.arange(len(bucket)), extent + 1)
        step = at - bounds[row]
        start = place[row] - before[row] + step
        key_a, key_b = one[at], two[at]
        order = np.lexsort((start, tie[row], doc[row], key_b, key_a, bucket[row]))
        same = np.zeros(len(order), bool)
        a, b, c = bucket[row][order], key_a[order], key_b[order]
        same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])
        # the same document given twice is not earlier than itself
        p, q, r = doc[row][order], tie[row][order], start[order]
        same[1:] &= (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | (r[1:] != r[:-1])
        again = np.zeros(len(order), bool)
        again[order] = same
        rows, starts = row[again], start[again]
        if not len(rows):
            return
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(rows)))
        kept = rows[first]
        run = _pack_place(starts[first], np.zeros(len(first), np.int64), size - 1)
        yield _table([np.full(len(first), _REPEAT), doc[kept], tie[kept], run], _RUN)

    dealt = contexts.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda batches: _by_bucket(batches, "bucket", work), _RUN)


def open_contexts(docs: DataFrame, width: int) -> DataFrame:
    """``(bucket, doc, tie, packed, bytes)`` of the open suffixes listed in ``open`` of each document."""
    schema = StructType([StructField(n, LongType()) for n in ("bucket", "doc", "tie", "packed")] + [StructField("bytes", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                part = _fresh(part, seen)
                if not part.num_rows:
                    continue
                data, bounds = text_bytes(part.column("text"))
                column = part.column("open")
                counts = np.diff(column.offsets.to_numpy())
                packed = column.flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), counts)
                doc, tie = part.column("doc").to_numpy()[row], part.column("tie").to_numpy()[row]
                place, before, extent = _unpack_place(packed)
                begin = bounds[row] + place
                gram = np.empty(len(row), np.int64)
                for lo in range(0, len(row), 50_000):
                    some = begin[lo : lo + 50_000]
                    cut = data[(some[:, None] + np.arange(Q)[None, :]).ravel()]
                    gram[lo : lo + 50_000] = identifiers(cut, Q, 0)[0][:: Q].view(np.int64)
                size = extent + width
                raw = data[gather(begin - before, size)]
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                cut = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(doc), pa.array(tie), pa.array(packed), cut], schema.names)

    return docs.mapInArrow(run, schema)


def _gather_runs(runs: DataFrame, kind: int, name: str) -> DataFrame:
    """The packed places of one kind, each listed once by document (copies of a document find the same ones)."""
    return runs.filter(F.col("kind") == kind).groupBy("doc", "tie").agg(F.collect_set("packed").alias(name))


def remove_repeats(
    df: DataFrame, width: int = 100, id_column: str = "doc_id", text: str = "text", keep_text: bool = False
) -> DataFrame:
    """Append ``n_removed``, ``spans`` (byte runs removed: begins and ends in turn) and ``kept`` (bytes left) to each row.

    With ``keep_text`` the row also gets ``kept_text``: the characters none of whose bytes are removed.
    ``width`` is from 64 to 127.
    """
    if not 64 <= width < 128:
        raise ValueError("width must be from 64 to 127")
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("n_removed", "spans", "kept", "kept_text")]
    keyed = df.select(
        *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(names)],
        F.coalesce(F.col(id_column).cast("long"), F.lit((1 << 63) - 1)).alias("_doc"),
        _document_tie(text).alias("_tie"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    )
    docs = keyed.select(F.col("_doc").alias("doc"), F.col("_tie").alias("tie"), F.col("_text").alias("text"))
    frequent = frequent_grams(docs, width)
    runs_path = shared_folder(spark, "runs")
    first_refinement(suffixes(docs, width, frequent)).write.parquet(runs_path)
    runs = spark.read.parquet(runs_path)
    listed = _gather_runs(runs, _OPEN, "open").withColumnsRenamed({"doc": "_d", "tie": "_t"})
    joined = docs.join(listed, (docs["doc"] == listed["_d"]) & (docs["tie"] == listed["_t"]))
    more = second_refinement(open_contexts(joined.select("doc", "tie", "text", "open"), width), width)
    repeats = _gather_runs(runs.union(more), _REPEAT, "_runs").withColumnsRenamed({"doc": "_d", "tie": "_t"})
    out = keyed.join(repeats, (keyed["_doc"] == repeats["_d"]) & (keyed["_tie"] == repeats["_t"]), "left")
    held = [f"kept_{i}" for i in range(len(names))]
    carried = out.select(*held, "_text", F.coalesce("_runs", F.array().cast("array<bigint>")).alias("_runs"))
    added = [StructField("n_removed", LongType()), StructField("spans", ArrayType(LongType())), StructField("kept", BinaryType())]
    if keep_text:
        added.append(StructField("kept_text", StringType()))
    fields = [StructField(c, carried.schema[h].dataType, carried.schema[h].nullable) for c, h in zip(names, held)]
    schema = StructType(fields + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", STEP_BYTES):
                made = _cut(part, width, keep_text)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in held] + made, schema.names)

    return carried.mapInArrow(run, schema)


def _cut(part: pa.RecordBatch, width: int, keep_text: bool) -> list[pa.Array]:
    data, bounds = text_bytes(part.column("_text"))
    column = part.column("_runs")
    row = np.repeat(np.arange(part.num_rows), np.diff(column.offsets.to_numpy()))
    place, before, extent = _unpack_place(column.flatten().to_numpy())
    start = bounds[row] + place - before
    depth = np.zeros(len(data) + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + extent + width, -1)
    gone = np.cumsum(depth[:-1]) > 0
    text_of = np.repeat(np.arange(part.num_rows), np.diff(bounds))
    opens = gone.copy()
    opens[1:] &= ~gone[:-1] | (text_of[1:] != text_of[:-1])
    closes = gone.copy()
    closes[:-1] &= ~gone[1:] | (text_of[1:] != text_of[:-1])
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    owner = text_of[begin]
    spans = np.stack([begin - bounds[owner], end - bounds[owner]], axis=1).ravel()
    removed = np.bincount(text_of[gone], minlength=part.num_rows)

    def left(keep: np.ndarray, kind: pa.DataType) -> pa.Array:
        sizes = np.bincount(text_of[keep], minlength=part.num_rows)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.Array.from_buffers(kind, part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes())])

    made = [pa.array(removed.astype(np.int64)), lists(spans, 2 * np.bincount(owner, minlength=part.num_rows)), left(~gone, pa.binary())]
    if keep_text:
        head = (data & 0xC0) != 0x80
        character = np.cumsum(head) - 1
        broken = np.zeros(int(head.sum()), bool)
        broken[character[gone]] = True
        made.append(left(~broken[character] if len(data) else ~gone, pa.string()))
    return made
