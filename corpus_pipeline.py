"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents. Rejected documents go and failing lines of the others too; of each class of near duplicates the first
by doc_id stays, one row where ids repeat or are null; documents with a benchmark window go; the mix takes texts once, up to three times or in
part, so a doc_id may repeat from there on; the last stage writes token files and returns what they hold.

Null and empty texts are rejected by the first stage. Null and repeated doc_ids are documents of their own: near duplicates
go by texts and rows, and ties by the least doc_id, null first, then by a hash of the row. Empty tables give no rows. Extra
columns pass through all stages but the last.
"""

from pyspark.sql import DataFrame, SparkSession

from talliard.llm import decontaminate, jaccard_join, mixing, quality, token_files
from talliard.llm.common import stored
from talliard.tables import table

#: Word shingles and similarity, in percent, of near duplicates.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_docs(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_rows(docs, shingle=SHINGLE, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.where("size(hit_runs) = 0").select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_files(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token files", token_output),
]

#: Near duplicates and token files have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stored(docs), sf_dir)
    return docs
