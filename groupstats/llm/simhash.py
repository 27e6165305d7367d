"""SimHash fingerprints of word shingles and their near-duplicate classes by the generalised pigeonhole principle.

**Fingerprints.** Text is lower-cased in A-Z, cut into words at white space, and its word shingles
(repeats included) are hashed with XXH64, seed 42. A bit of the fingerprint is set if it is set in over half
of the hashes. Texts with fewer words than a shingle have their whole word sequence as the only one, texts
without words have fingerprint zero.

**Links.** Documents with equal fingerprints are one node, so copies cost nothing from here on. For nodes
that differ in at most ``max_bits`` bits:

1. Bits are grouped into parts: the correlation of bits over the fingerprints is counted (64 x 64 numbers,
   merged from every partition), and the bits that go together are put into the same part, for then the
   parts tell fingerprints apart independently of each other.
2. Every part gets its own threshold, -1 (not looked at) or more, such that they add up to
   ``max_bits - parts + 1``. Two fingerprints within ``max_bits`` must then be within the threshold of some
   part. A dynamic program chooses the thresholds, and the number of parts, by the number of candidates each
   would give, estimated from the counted collisions of hashed part values.
3. Every node is listed under its value in each part, and under the values within the threshold there
   (one side only); equal values meet in a join. Values that very many nodes share are split further by the
   same principle on the other bits, level by level, so no value's nodes are all compared with each other.
4. Candidates are verified by counting the differing bits.

**Classes** are the connected components of the links.

NULL text counts as empty. Rows with a NULL id get a fingerprint and a class like any other; it does not count
as the smallest id of a class of other rows. Repeated rows are copies.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groupstats.llm.batches import gather, long_field, map_batches, text_bytes, unused, whole_text, word_slices
from groupstats.llm.components import components
from groupstats.llm.hashing import xxh64
from groupstats.session import shared_folder

#: Nodes under one value that are compared with each other; more are split by further bits.
BUCKET_ROWS = 64
#: Numbers of parts that are tried.
PART_CHOICES = (2, 3, 4, 5, 6)


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Replace the text by ``_fp``, its 64 fingerprint bits as a long."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    rows = df.select(*[c for c in keep if c not in ("_fp", "_text")], whole_text(text).alias("_text"))

    def work(part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"_fp": pa.array(simhash(*text_bytes(part.column("_text")), shingle))}

    return map_batches(rows, "_text", work, StructType([long_field("_fp")]), drop=("_text",))


def simhash(data: np.ndarray, bounds: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints of the texts ``data[bounds[k] : bounds[k + 1]]``."""
    plain, begin, end, words = word_slices(data, bounds)
    shingles = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    word = gather(np.cumsum(words) - words, shingles)
    last = np.minimum(word + shingle - 1, np.repeat(np.cumsum(words), shingles) - 1)
    hashes = xxh64(plain, begin[word], end[last] - begin[word], 42)
    return majority(hashes, shingles)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of ``sizes`` hashes: a bit is set if over half of a run's hashes have it set."""
    out = np.zeros(len(sizes), np.uint64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):  # runs of about a hundred thousand hashes at a time
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + 100_000, side="right")))
        part = hashes[base : ends[stop - 1]]
        size = sizes[start:stop]
        some = size > 0
        if some.any():
            firsts = (ends[start:stop] - size - base)[some]
            bytes_ = np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8)
            ones = np.empty((int(some.sum()), 64), np.int32)
            for k in range(8):
                bits = np.unpackbits(bytes_[:, k : k + 1], axis=1, bitorder="little")
                ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
            packed = np.packbits(ones * 2 > size[some][:, None], axis=1, bitorder="little")
            out[start:stop][some] = packed.view(np.uint64)[:, 0]
        start = stop
    return out.view(np.int64)


# ------------------------------------------------------- parts and thresholds


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j set, for all i and j."""
    fields = "n long, pairs array<long>"

    def run(batches):
        n, pairs = 0, np.zeros((64, 64), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for start in range(0, len(fp), 100_000):
                raw = np.ascontiguousarray(fp[start : start + 100_000]).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
                pairs += (bits.T @ bits).astype(np.int64)
                n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([pairs.ravel().tolist()])], ["n", "pairs"])

    per_task = nodes.select("_fp").mapInArrow(run, fields)
    summed = (
        per_task.select("n", F.posexplode("pairs")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("c")).toArrow()
    )
    pairs = np.zeros(4096, np.int64)
    if not summed.num_rows:
        return 0, pairs.reshape(64, 64)
    pairs[summed["pos"].to_numpy()] = summed["c"].to_numpy()
    return int(summed["n"][0].as_py()), pairs.reshape(64, 64)


def group_bits(n: int, pairs: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal size, correlated bits together."""
    if n:
        mean = np.diag(pairs) / n
        cover = pairs / n - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(cover), 1e-12))
        near = np.abs(cover / np.outer(spread, spread))
    else:
        near = np.zeros((64, 64))
    free = list(range(64))
    groups = []
    for k in range(parts):
        size = len(free) // (parts - k)
        ties = near[np.ix_(free, free)].sum(axis=1)
        group = [free.pop(int(np.argmax(ties)))]
        while len(group) < size:
            ties = near[np.ix_(free, group)].sum(axis=1)
            group.append(free.pop(int(np.argmax(ties))))
        groups.append(sorted(group))
    return groups


def choose_thresholds(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds per part, -1 or more, that add up to ``total`` at the least summed cost (dynamic program)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for so_far, (value, chosen) in best.items():
            for threshold, price in cost.items():
                key, sum_ = so_far + threshold, value + price
                if key not in grown or sum_ < grown[key][0]:
                    grown[key] = (sum_, [*chosen, threshold])
        best = grown
    return best.get(total, (float("inf"), []))


def mask_of(bits: list[int]) -> int:
    """Bits as a signed long."""
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def plan_parts(nodes: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """Parts with their thresholds.

    Two fingerprints agree in bit i at the rate ``p^2 + (1 - p)^2``, p being how often it is set, and in a part
    at about the product over its bits. A threshold of t lists every fingerprint under all values within t, each
    of which collides at about that rate. The cost of a part is the rows listed and the pairs that meet.
    """
    n, pairs = bit_counts(nodes)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    p = np.diag(pairs) / max(n, 1)
    same = p**2 + (1 - p) ** 2
    for parts in PART_CHOICES:
        total = max_bits - parts + 1
        if total < -parts:
            continue
        groups = group_bits(n, pairs, parts)
        costs = []
        for group in groups:
            rate = float(np.prod(same[group]))
            cost = {-1: 0.0}
            for t in range(max(total + parts - 1, 0) + 1):
                probes = sum(comb(len(group), k) for k in range(t + 1))
                cost[t] = n * (1 + probes) + probes * rate * n * n / 2
            costs.append(cost)
        value, chosen = choose_thresholds(costs, total)
        if chosen and (best is None or value < best[0]):
            best = value, list(zip(groups, chosen))
    return best[1] if best else [(list(range(64)), max_bits)]


# --------------------------------------------------------------------- links


def links(nodes: DataFrame, max_bits: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All pairs ``(a, b)``, a below b, of distinct fingerprints ``_fp`` that differ in at most ``max_bits`` bits."""
    spark = nodes.sparkSession
    plan = [(bits, t) for bits, t in plan_parts(nodes, max_bits) if t >= 0]
    flips = [
        (mask_of(bits), mask_of(list(flip)), int(k > 0))
        for bits, t in plan
        for k in range(t + 1)
        for flip in combinations(bits, k)
    ]
    probes = F.array(*[F.struct(F.lit(u).cast("long").alias("_used"), F.lit(f).cast("long").alias("_flip"), F.lit(p).alias("_probe")) for u, f, p in flips])
    rows = nodes.select("_fp", F.inline(probes))
    rows = rows.select("_used", F.col("_fp").bitwiseXOR(F.col("_flip")).alias("_value"), "_fp", "_probe")
    paths = {mask_of(bits): [b for b in range(64) if b not in bits] for bits, _ in plan}
    found = None
    key = ["_used", "_key"]
    while True:
        path = shared_folder(spark, "listed")
        rows.withColumn("_key", F.col("_value").bitwiseAND(F.col("_used"))).write.parquet(path)
        rows = spark.read.parquet(path)
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
        sizes_path = shared_folder(spark, "sizes")
        sizes.write.parquet(sizes_path)
        sizes = spark.read.parquet(sizes_path)
        deeper = any(len(rest) > max_bits for rest in paths.values())
        small = rows.join(sizes.filter(F.col("_rows") <= bucket_rows) if deeper else sizes, key, "left_semi")
        left, right = small.filter("_probe = 0"), small.withColumnsRenamed({"_fp": "_other", "_probe": "_probe_b"})
        met = left.join(right.select(*key, "_other", "_probe_b"), key).filter(
            (F.bit_count(F.col("_fp").bitwiseXOR(F.col("_other"))) <= max_bits)
            & (F.col("_fp") != F.col("_other"))
            & ((F.col("_probe_b") == 1) | (F.col("_fp") < F.col("_other")))
        ).select(F.least("_fp", "_other").alias("a"), F.greatest("_fp", "_other").alias("b"))
        found = met if found is None else found.union(met)
        large = sizes.filter(F.col("_rows") > bucket_rows)
        if not deeper or large.isEmpty():
            return found.distinct()
        # the nodes of a large value agree in its bits: they must agree in one of max_bits + 1 shares of the rest
        grown, deeper_paths = [], {}
        for used, rest in paths.items():
            if len(rest) <= max_bits:
                grown.append((used, used))
                deeper_paths[used] = rest
                continue
            for share in np.array_split(np.array(rest), max_bits + 1):
                more = used | mask_of(share.tolist())
                grown.append((used, more))
                deeper_paths[more] = [b for b in rest if b not in share]
        steps = spark.createDataFrame(grown, "_used long, _more long")
        rows = rows.join(large, key, "left_semi").join(F.broadcast(steps), "_used")
        rows = rows.select(F.col("_more").alias("_used"), "_value", "_fp", "_probe").distinct()
        paths = deeper_paths


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """``(id, _fp, component_id)`` for every row: its fingerprint and the smallest id of its class."""
    spark = df.sparkSession
    path = shared_folder(spark, "fingerprints")
    fingerprints(df.select(id_column, text), text, shingle).write.parquet(path)
    marked = spark.read.parquet(path)
    nodes_path = shared_folder(spark, "nodes")
    marked.groupBy("_fp").agg(F.min(id_column).alias("_least")).write.parquet(nodes_path)
    nodes = spark.read.parquet(nodes_path)
    roots = components(links(nodes, max_bits))
    in_class = nodes.join(roots, F.col("_fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "_fp"))
    least = in_class.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = in_class.join(least, "root").select("_fp", "component_id")
    return marked.join(classes, "_fp").select(id_column, "_fp", "component_id")


def first_of_classes(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each class of :func:`near_duplicates` one row stays.

    It is the one with the smallest id, rows without an id last; among rows of one id, that of the least hash of all its
    columns. Rows that are equal in all columns are one row. Only fingerprints and hashes are compared and joined before
    the rows that stay are picked.
    """
    spark = df.sparkSession
    row_hash = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns], *[F.col(c).isNull() for c in df.columns])
    key = {
        unused(df, "_no_id"): F.col(id_column).isNull(),
        unused(df, "_id"): F.coalesce(F.col(id_column), F.lit(0)),
        unused(df, "_row"): row_hash,
    }
    path = shared_folder(spark, "fingerprints")
    keyed = df.select(F.col(text), *[c.alias(n) for n, c in key.items()])
    fingerprints(keyed, text, shingle).write.parquet(path)
    marked = spark.read.parquet(path)
    nodes_path = shared_folder(spark, "nodes")
    firsts = marked.groupBy("_fp").agg(F.min(F.struct(*key)).alias("_first"))
    firsts.write.parquet(nodes_path)
    nodes = spark.read.parquet(nodes_path)
    roots = components(links(nodes.select("_fp"), max_bits))
    in_class = nodes.join(roots, F.col("_fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "_fp"))
    stays = in_class.groupBy("root").agg(F.min("_first").alias("_first")).select("_first.*")
    kept = df.withColumns(key).join(stays, list(key), "left_semi")
    return kept.dropDuplicates(list(key)).select(*df.columns)
