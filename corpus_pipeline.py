"""From raw documents to tokens: language ID, exact and near dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents, and any others that docs has; the last returns all but the
text, n_tokens and token_ids.  Language models, the mixing classifier and all
statistics are fitted on the stage's own input.

Defined results by stage (more in the operators' modules).  Null, empty and
wordless texts are rejected by language ID; the later stages, given such, keep
null texts apart and count them as 0 tokens (BPE: null ids, -1 tokens).  Nulls in
doc_id, lang, source or n_chars reject nothing; rows without lang are not trained
on.  Very long texts are processed whole by every stage.  Of equal texts the row
with the least doc_id stays (nulls last), of near ones too; ties of scores and
counts are settled as the modules say.  Identical rows leave one in both dedup
stages; the others treat each by itself and alike.  An empty table stays empty in
every stage.  Extra columns pass through under any name, also those that the
operators use inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import _shared, bpe, exact_dedup, langid, mixing, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of which enough words are in a known language."""
    return langid.keep_identified(docs, langid.train(docs))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each text."""
    return exact_dedup.exact_dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the fitted rate of its domains says."""
    return mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    return bpe.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", dedup_exact),
    ("simhash_near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Neither SimHash groups nor fitted rates nor BPE can be put in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = _shared.write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
