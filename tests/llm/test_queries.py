"""The queries and the pipeline over the smallest tables."""

import hashlib

import corpus_pipeline
import pytest
from compare import database, difference

from groupstats.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER).toArrow(), database(FOLDER).sql(ORACLES[name]).to_arrow_table()) is None


def test_every_query_gives_a_row_for_every_row(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, made in QUERIES.items():
        if name.split("_")[0] in ("op3", "op4", "op9", "op12"):
            continue
        assert made(spark, FOLDER).select("doc_id").distinct().count() == docs.count(), name


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, kept, FOLDER)
        assert made.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{hashlib.md5(name.encode()).hexdigest()}"
        made.write.mode("overwrite").parquet(path)
        before, kept = kept, spark.read.parquet(path)
        assert 0 < kept.count() <= before.count()
        assert kept.join(before, "doc_id", "left_anti").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert packed.select("doc_id").distinct().count() == kept.count()
