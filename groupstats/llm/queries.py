"""One query per operator of this subpackage over the text tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groupstats.llm.labelled_private import labelled_sentences
from groupstats.llm.order_minhash import compare_with_edits
from groupstats.llm.packing import pack
from groupstats.llm.phrases import collocations
from groupstats.llm.private_data import KINDS, find_private, train_field
from groupstats.llm.pseudo_likelihood import score_documents
from groupstats.llm.repeats import remove_repeats
from groupstats.llm.runs import find_runs
from groupstats.llm.simhash import near_duplicates
from groupstats.llm.sentence_pieces import encode_pieces
from groupstats.llm.token_counts import count_tokens
from groupstats.llm.topk import top_k
from groupstats.llm.toxicity import score_toxicity, train_toxicity
from groupstats.llm.wrappers import extract

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_pseudo_likelihood(spark, folder):
    return score_documents(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op2_order_minhash(spark, folder):
    return compare_with_edits(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op3_main_text(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_top_k(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, "vec_id", "embedding", k=5, scale=256)


ORACLES["op4_top_k"] = """
WITH v AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op5_sentence_pieces(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("last_byte"),
    )


@query
def op6_simhash(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, max_bits=2).select(
        "doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def in_training(id_column: str) -> Column:
    """Rows whose label may be learnt: the CRC-32 of the id, as text, leaves another remainder by 4 than 2."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 != 2


@query
def op7_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, folder, "labels"), in_training)
    scored = score_toxicity(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", (~in_training("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op8_token_counts(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    counts = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op9_packing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096, closing_id=2)


@query
def op10_repeats(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    return remove_repeats(docs, width=100).select(
        "doc_id", "n_bytes", "n_removed",
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def with_planted_run(doc_id: Column, text: Column) -> Column:
    """The words of every tenth text, by the CRC-32 of its id, with the end replaced by repeats of one stretch of it.

    Such a text comes back with one space between its words, others as they are; so do those of a NULL id.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def renewed(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        places = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), source)
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(words, i.cast("int"))), " ")).otherwise("")

    words = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return F.when((h % 10 == 0) & text.isNotNull(), F.element_at(F.transform(words, renewed), 1)).otherwise(text)


@query
def op11_word_runs(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", with_planted_run(F.col("doc_id"), F.col("text")).alias("text")
    )
    found = find_runs(docs, least_length=6, least_periods=4, drop=("text",))
    # lengths and periods are whole numbers below 2 ** 26, so unequal quotients are unequal as doubles too
    rank = lambda r: F.struct((-r["length"] / r["period"]).alias("e"), r["start"], r["period"], r["length"])
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.withColumn("best", F.array_min(F.transform("runs", rank))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_collocations(spark, folder):
    docs = table(spark, folder, "documents").select("lang", "text")
    return collocations(docs, most=3, least=10, covered_percent=50, top=2000)


ORACLES["op12_collocations"] = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), phrases AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
    FROM places, (VALUES (1), (2), (3)) AS sizes (k)
    WHERE i + k - 1 <= len(w)
    GROUP BY ALL
), sums AS (
    SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE k = 1 GROUP BY lang
), cuts AS (
    SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut
    FROM phrases WHERE k >= 2 AND f >= 10
), scored AS (
    SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.f AS l, y.f AS r,
           ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c
    JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.cut], ' ')
    JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1 : ], ' ')
), lowest AS (
    SELECT * FROM scored
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
    SELECT lang, phrase, max(a) AS most FROM (
        SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a FROM cuts WHERE k = 3
        UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM cuts WHERE k = 3)
    GROUP BY ALL
), kept AS (
    SELECT o.* FROM lowest o LEFT JOIN longer g ON g.lang = o.lang AND g.phrase = o.phrase AND o.k = 2
    WHERE g.most IS NULL OR 100 * g.most < 50 * o.a
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
    FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sums USING (lang) WHERE rank <= 2000
"""


@query
def op13_private_data(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_private(docs, train_field(labelled_sentences(spark)), drop=("text",))
    kind = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    placed = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], kind(s).alias("k"), s["end"], s["kind"])))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform("base", line), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(placed, line), ",").alias("spans"),
    )
