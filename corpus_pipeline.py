"""The corpus pipeline: five operators of ``tandem.llm`` over ``documents``.

Each stage works on all rows its predecessor kept, written to the shared folder of
``spark.checkpoint.dir`` and read again; all but the last return the columns of
``documents``. A stage's staged tables go when the next stage begins, since by then
its result is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tandem.llm.op04_jaccard import one_of_each
from tandem.llm.op05_quality import keep_good
from tandem.llm.op06_mixing import keep_mixed
from tandem.llm.op07_packing import pack
from tandem.llm.op08_lines import dedup_lines
from tandem.llm.queries import QUERIES
from tandem.llm.staging import drop_staged, stage, staging_scope


#: Scope of the tables staged for the running pipeline; a stage called by itself has the scope of its application.
_scope: ContextVar[str] = ContextVar("pipeline_scope", default="pipeline")


@contextmanager
def _fresh(spark: SparkSession) -> Iterator[None]:
    """Drop what the previous stage has staged; what is staged inside belongs to this one."""
    drop_staged(spark, _scope.get())
    with staging_scope(_scope.get()):
        yield


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal lines the first stays; documents that lose their last word go."""
    with _fresh(spark):
        return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents at Jaccard 0.8 of five-word shingles one stays."""
    with _fresh(spark):
        return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix of sources at their target weights, in its order, which packing follows."""
    with _fresh(spark):
        return keep_mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of a document with its sequence and place; sequences come in the order of the mix."""
    with _fresh(spark):
        return pack(docs, ordered=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: MinHash banding, tokenisers and hash orders have no SQL form: tests/llm/test_pipeline.py
#: holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages. What the last stage has staged stays until the caller drops it
    (``drop_staged``), since the result is read from it; another run has tables of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = uuid.uuid4().hex
    token = _scope.set(f"pipeline-{name}")
    try:
        for i, (_, function) in enumerate(STAGES):
            docs = function(spark, docs, sf_dir)
            if i + 1 < len(STAGES):
                with staging_scope(f"stages-{name}/{i}"):
                    docs = stage(docs)
                if i:
                    drop_staged(spark, f"stages-{name}/{i - 1}")
    finally:
        _scope.reset(token)
    return docs


def registered() -> dict:
    """name -> (query, SQL) of the numbered operators and of the pipeline."""
    return dict(QUERIES) | {"pipeline": (run, ORACLE_SQL)}
