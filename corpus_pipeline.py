"""From documents to token files: language, near duplicates, test passages, mix, output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's documents. All but the last return the columns of documents. Rows
are told apart by a key of their own, not by their ids: any number may share one or have none.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.llm import arrow_tokens, decontaminate, jaccard, language, mixing
from songloom.llm.catalog import table, tokenizer
from songloom.llm.features import fold
from songloom.session import settle, tune


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: only those without a letter go, whatever their score."""
    tune(spark)
    model = language.fit(language.labelled_sample(docs, fold("doc_id") != 2))
    if not model.languages:  # nothing to learn from: every text would be unknown
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, model, lang_col="_lang", score_col="_score")
    return found.filter(F.col("_lang") != language.UNKNOWN).select(*docs.columns)


def with_keys(docs: DataFrame) -> DataFrame:
    """The documents with ``_key``, a number for each row, whatever its id.

    It is a 64-bit hash of the row's place, the file and the row in it: rows of one file never share
    it, those of different files could in principle. Documents that are not a stored table are stored first, as every step has to read the
    same places.
    """
    stored = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"
    try:
        rows = docs if stored else settle(docs, "rows")
        place = rows.metadataColumn("_metadata")
        rows.select(place["row_index"])
    except AnalysisException:  # stored, but in files whose rows have no number
        rows = settle(docs, "rows")
        place = rows.metadataColumn("_metadata")
    return rows.select(*[rows[c] for c in docs.columns],
                       F.xxhash64(place["file_path"], place["row_index"]).alias("_key"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates; every row is a document of its own.

    First is the least id, missing ones being last, and of equal ids the least hash of the row.
    """
    tune(spark)
    rows = with_keys(docs)
    groups = settle(jaccard.jaccard_components(rows, id_col="_key").select(
        F.col("_key").alias("_row"), "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), "_key")
    ordered = rows.select("_key", order.alias("_order")).join(groups, F.col("_key") == F.col("_row"))
    first = settle(ordered.groupBy("component_id").agg(F.min("_order").alias("_order")).select(
        F.col("_order._key").alias("_first")), "first")
    return rows.join(first, F.col("_key") == F.col("_first"), "left_semi").select(*docs.columns)


def without_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    benchmark = table(spark, sf_dir, "benchmark")
    rows = with_keys(docs)
    found = decontaminate.find_contamination(rows, benchmark, id_col="_key")
    hit = settle(found.filter(F.size("spans") > 0).select(F.col("_key").alias("_hit")), "contaminated")
    return rows.join(hit, F.col("_key") == F.col("_hit"), "left_anti").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    tune(spark)
    rows = with_keys(docs)
    mixed = mixing.mix(rows, key_col="_key")
    return mixing.repeat_documents(rows, mixed, key_col="_key").select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in the token files that are written."""
    tune(spark)
    files = arrow_tokens.write_tokens(docs, tokenizer())
    return arrow_tokens.read_tokens(spark, files)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_test_passages),
    ("mixing sources", mixed_sources),
    ("token-ID output", token_files),
]

# The mix draws at random and tokens come from a tokenizer: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
CHECKS = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
