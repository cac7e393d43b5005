"""The corpus pipeline: five stages from raw documents to encoded, mixed text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages are joined by
Parquet files, so a lost executor never sends the run back over a stage.

1. language ID: documents without a letter, or like the texts of no language that
   the kernel classifier learned (likeness below LEAST_LIKENESS, whatever the number
   of languages), go.
2. quality classifier: documents scored below the rule ensemble's threshold go.
3. SimHash near-dedup: of each class of near copies one row stays, that of the
   smallest doc_id; of rows that share it in the class, one. What other classes
   hold doesn't matter, so rows of unlike text stay even if they share an id.
4. mixing: rows are put into the order of a Pfair schedule with equal weights for
   all sources; the files' order is the mixture's. No document goes.
5. BPE encoding: doc_id, source, the number of tokens, the digests of ids and of the
   decoded text.

Cases: rows with a null doc_id come after all others of their class in stage 3: one
stays if no row of the class has an id. Null and empty texts have no letter and go in
stage 1; if no language could be learned (no row with a lang), all go. Without labels
of both kinds stage 2 keeps or drops all alike, by the share of label 1. Null sources
are a source of their own. Very long texts are whole in every stage. Empty tables
give empty results. Extra columns pass through the first four stages, whatever their
names. What stages write in ``run`` goes when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe_reuse, language_id, mixing, rule_ensemble, simhash
from quire.llm.common import col, free, materialize, shared_dir, table
from quire.session import delete_on_exit

#: Texts in other scripts have 0.00 to 0.05, the least of the test tables' documents (three letters) 0.13.
LEAST_LIKENESS = 0.06


def _prefix(docs: DataFrame) -> str:
    """A prefix that no column's name begins with."""
    prefix = "stage_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def _columns(docs: DataFrame) -> list:
    return [col(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = _prefix(docs)
    found = language_id.classify(docs, language_id.train(docs), prefix=p)
    return found.filter((F.col(p + "lang_pred") != "und") & (F.col(p + "likeness") >= LEAST_LIKENESS)).select(*_columns(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = _prefix(docs)
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.score(docs, model, prefix=p).filter(F.col(p + "predicted") == 1).select(*_columns(docs))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A row is known by its whole content; a class's survivor is its least row: by id, null last, then by content.
    content = F.md5(F.to_json(F.struct(*_columns(docs))))
    own, key, one = free(docs, "row_key", "kept_key", "first_row")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), content.alias("key"))
    fps = materialize(simhash.fingerprints(docs.select(row.alias("row"), "text"), keep=["row"]), "simhash")
    kept = simhash.classes(fps, "row").select(F.col("component_id.key").alias(key)).distinct()
    found = docs.withColumn(own, content).join(kept, F.col(own) == F.col(key), "left_semi")
    twice = materialize(fps.groupBy(F.col("row.key").alias(key)).count().filter("count > 1").select(key), "twice")
    if twice.isEmpty():
        return found.select(*_columns(docs))
    # Rows of the same content: one stays.
    again = F.col(own) == F.col(key)
    first = found.join(twice, again, "left_semi").groupBy(own).agg(F.first(F.struct(*_columns(docs))).alias(one)).select(f"{one}.*")
    return found.join(twice, again, "left_anti").select(*_columns(docs)).unionByName(first)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = _prefix(docs)
    mixed = mixing.mix(docs, prefix=p)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, p + "position").sortWithinPartitions(p + "position").select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_reuse.digests(docs, keep=["doc_id", "source"])


STAGES = [
    ("language ID", language),
    ("quality classifier", quality),
    ("SimHash near-dedup", dedup),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encode),
]

#: Classifiers can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = delete_on_exit(spark, f"{shared_dir(spark)}/quire-stage{k}-{uuid.uuid4().hex}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
