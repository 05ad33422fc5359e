"""Training-corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
``documents``, and the mixture adds each copy's training position, by which packing orders them.  Each result is written as
Parquet and read again as the next stage's input.  Stages carry whole rows and never look rows up by id, so null and repeated
ids lose nothing; columns besides those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import line_dedup, minhash, mixing, packing, quality
from strataflow.llm.common import SPACE_CHARS, drop_path, load, recording, scratch_path
from strataflow.llm.token_counts import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Each row is judged by itself: null and repeated ids, and repeated rows, make no difference; a null, blank or short text
    fails the base rules and goes; a null language is no reference; an empty table stays empty.
    """
    return quality.good_documents(docs.select(*COLUMNS))


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; what is left without a word is a copy and goes.

    Rows that repeat id and text are one document and get the same result; null ids come last in the order of copies; a
    null text stays; an empty table stays empty.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), maximal=True)
    bare = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACE_CHARS))
    out = out.where((F.col("n_deleted") == 0) | (bare != ""))
    changed = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def by_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least id, or of several such rows any one.

    Rows with a null id are linked like others and go where their group has an id; null and blank texts are linked with
    nothing and stay; an empty table stays empty.
    """
    return minhash.distinct_documents(docs.select(*COLUMNS))


def _first_words(text: Column, n: Column) -> Column:
    """The beginning of a text that holds its first n words."""
    spaces = F.regexp_extract_all(text, F.lit(r"[\x09-\x0D\x20]*[^\x09-\x0D\x20]+"), F.lit(0))
    return F.array_join(F.slice(spaces, F.lit(1), n.cast("int")), "")


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: whole, or for the last one of a source its first words.

    One row per copy with its own training position, in order of the positions.  Rows are taken one by one, whatever their
    ids; texts without a word take nothing and have no copy; a null source is a source of its own; an empty table stays empty.
    """
    out = mixing.schedule(docs.select(*COLUMNS), carry=True).select("row.*", "size", F.explode("copies").alias("copy")).select("*", "copy.words", "copy.position")
    part = F.col("words") < F.col("size")
    text = F.when(part, _first_words(F.col("text"), F.col("words"))).otherwise(F.col("text"))
    n_chars = F.when(part, F.length("cut").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("cut", text).select("doc_id", F.col("cut").alias("text"), "lang", "source", n_chars.alias("n_chars"), "position").orderBy("position", "doc_id")


def by_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens, which follow the curriculum.

    Rows that repeat an id are documents of their own; null ids stay null; a null text has its end token alone, a null
    position comes last; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path(TOKENIZER), position_col="position")


_scratch: dict[str, list[str]] = {}


def _alone(stage):
    """A stage that first deletes the scratch tables of the stage before it, whose result must have been written by then."""

    def start(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        for path in _scratch.pop(app, []):
            drop_path(spark, path)
        with recording(_scratch.setdefault(app, [])):
            return stage(spark, docs, sf_dir)

    return start


STAGES = [(f.__name__, _alone(f)) for f in (by_quality, by_lines, by_near_copies, by_mixture, by_packing)]
#: Tokens, line runs and near-copy groups are more than SQL can express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Of the tables that the stages write only the last one stays."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        drop_path(spark, path)
    return docs
