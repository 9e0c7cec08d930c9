"""Cleans `documents` for training, stage by stage.

Every stage works on all that the one before kept, and all but the last return the columns of documents.
Further columns of the input are left out, whatever they are called; ids may be null or stand for several
rows, and rows are kept or dropped one by one. No documents: no rows, from any stage. Very long texts go
through whole.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.llm._common import dropped, making, pick, table, written
from fleetloom.llm.bpe import decoded, encoded
from fleetloom.llm.contamination import leaks
from fleetloom.llm.quality import quality_rules
from fleetloom.llm.simhash import near_copies
from fleetloom.llm.suffix import repeated_bytes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Keys of rows to drop go to all executors up to this many; beyond it both sides are shuffled.
BROADCAST_IDS = 2_000_000


#: Shared folders of the stage before, whose result is in a table of its own when the next one begins.
_left: list[str] = []


def _stage(work):
    """A stage that first deletes what the one before left in the shared folder, but for what docs are read from."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {part for file in docs.inputFiles() for part in file.split("/")} if _left else set()
        for path in _left:
            if path.rsplit("/", 1)[-1] not in names:
                dropped(spark, path)
        _left.clear()
        with making() as made:
            found = work(spark, docs, sf_dir)
        _left.extend(made)
        return found

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row, written once so that it stays the same: an id may be null or stand for several rows."""
    return written(pick(docs, *COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of rows but for those whose key is in gone."""
    gone = written(gone.select(F.col("row").alias("gone")).distinct())
    few = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, F.col("row") == F.col("gone"), "left_anti").select(*COLUMNS)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts fail them; a text on the threshold stays; equal rows are judged alike."""
    judged = quality_rules(docs, table(spark, sf_dir, "labels"), carry=("text", "lang", "source", "n_chars"))
    # A filter on kept alone would go below the expressions that it is made of, and compute them again.
    return judged.withColumn("_row", F.monotonically_increasing_id()).where("kept and _row >= 0").select(*COLUMNS)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id, nulls last; of rows with one id and text, one."""
    rows = _keyed(docs)
    found = near_copies(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    # Texts without a word are in no group; of those only rows alike in id and text are one.
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own = [F.when(~blank, F.col("component_id")).alias("g"), F.when(blank, F.col("doc_id")).alias("id"), F.when(blank, F.col("text")).alias("t")]
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = rows.join(found, "row").groupBy(*own).agg(F.min(order).alias("first")).select("first.row")
    return _without(rows, rows.select("row").join(first, "row", "left_anti"))


@_stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document with a smaller id has; documents that lose all their words go.
    Rows of one id never cost each other bytes; null texts stay as empty ones.

    A cut may leave parts of a character at its borders; they go as well, replacement characters of the text stay.
    """
    kept = repeated_bytes(docs, carry=("lang", "source", "n_chars"))
    found = kept.withColumn("text", F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(_whole_characters("kept")))
    found = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return found.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def _whole_characters(column: str):
    """Bytes as text, without those that are no UTF-8. What Spark puts in their place goes, after the text's own are written otherwise."""
    mark, own, ours = F.lit("\ue000"), F.lit("\ufffd"), (F.lit("\ue000a"), F.lit("\ue000b"))
    text = F.replace(F.replace(F.col(column).cast("string"), mark, ours[0]), own, ours[1])
    return F.replace(F.replace(F.replace(F.make_valid_utf8(text), own, F.lit("")), ours[1], own), ours[0], mark)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. Null and empty texts hold none; without items all stay."""
    rows = _keyed(docs)
    found = leaks(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, found.select(F.col("doc_id").alias("row")))


@_stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): texts as token ids, and what they decode to. Null text: as empty, no ids."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = decoded(encoded(docs, ranks, public_tokenizers.PATTERN), ranks)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", byte_bpe),
]

#: SQL can express neither the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
