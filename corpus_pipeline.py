"""A training corpus from raw documents: five stages, each a table that the next one reads.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame with the
columns of documents. Nulls and empty texts are handled as the operators say; an empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, langid, line_dedup, mixing, queries, sentencepiece_viterbi
from tessera.sources.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns profiles from the labels of ``docs``, rejects texts of no language (null, or without a letter) and
    labels rows without ``lang`` with the predicted one. Repeated rows are judged one by one. Without a label to
    learn from nothing is predicted and ``lang`` stays null."""
    profiles = langid.learn_profiles(docs)
    found = langid.predict(docs["text"], profiles)
    if not profiles.languages:
        lettered = F.when(F.col("text").rlike(r"\p{L}"), F.lit(None).cast("string")).otherwise(langid.UNDETERMINED)
        found = F.struct(lettered.alias("lang_pred"))
    told = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("doc"), found.alias("told"))
    told = told.where(~F.col("told.lang_pred").eqNullSafe(langid.UNDETERMINED))
    lang = F.coalesce("doc.lang", "told.lang_pred")
    return told.select(*[(lang if c == "lang" else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs of lines from texts; n_chars follows the text. A document of which nothing is left goes:
    all its lines stand in others, or earlier in itself. Null and empty texts stay as they are."""
    names, deleted = docs.columns, "deleted"
    while deleted in names:
        deleted += "_"
    kept = line_dedup.dedup_lines(docs, count_col=deleted).where((F.col(deleted) == 0) | F.col("text").isNull() | (F.col("text") != ""))
    length = F.when(F.col(deleted) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*[(length if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in names])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the row with the smallest identifier stays; of rows that repeat it, the
    one with the smallest hash of the text, then one of those. Rows without words and rows without identifier
    stay."""
    scratch = Scratch(spark, "near-duplicates")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    # each row is a document of its own, whatever its identifier
    key = F.when(docs["doc_id"].isNotNull(), F.monotonically_increasing_id())
    rows = scratch.table(docs.select(*[docs[f"`{c}`"].alias(n) for c, n in names.items()], key.alias("key")), "rows")
    groups = jaccard_join.jaccard_components(rows, id_col="key", text_col=names["text"]).where("n_shingles > 0 and doc_id is not null")
    groups = scratch.table(groups.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")), "groups")
    order = rows.select("key", F.struct(F.col(names["doc_id"]), F.xxhash64(names["text"]), "key").alias("order"))
    first = groups.join(order, "key").groupBy("component").agg(F.min("order").alias("first")).select(F.col("first.key").alias("key"))
    gone = scratch.table(groups.join(first, "key", "left_anti").select("key"), "gone")
    return rows.join(gone, "key", "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as its source's target asks. A null source is one of its own, rows without words
    are as often taken as others of their source, and rows that repeat an identifier get the same number each."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the identifiers of the text's pieces and their number, and whether they decode to the text.
    A null text has null identifiers, an empty one none; both count 0 and come back. Repeated rows stay; other columns go."""
    model = sentencepiece_viterbi.Model.read(queries.piece_model_path())
    pieces = docs.select("doc_id", "source", "lang", "text", sentencepiece_viterbi.encode_and_decode(F.col("text"), model).alias("p"))
    pieces = pieces.select("doc_id", "source", "lang", "text", F.col("p.ids").alias("piece_ids"), F.col("p.decoded").alias("decoded"))
    return pieces.select("doc_id", "source", "lang", "piece_ids", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), F.expr("decoded <=> text").alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot express the stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as a table in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
