"""The stages of the corpus pipeline, each on one operator of this subpackage.

All but the last return the columns of their input.  Rows with nulls pass the stages that have no ground
to judge them; language identification rejects texts without a letter and ambiguous ones.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, neardup, packing, secrets

MIXED = "mixing"     # name of the note that mixed tables carry


def _whole(docs: DataFrame):
    """The row as one column, safe from columns that operators add."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart clearly; learned from labels of three quarters of them."""
    model = langid.fit(docs, ~langid.held_out())
    found = langid.identify(docs.select(_whole(docs), "text"), model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select("doc.*")


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class, of repeated rows one; texts without words all stay."""
    return neardup.kept(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts, n_chars brought up to date where it changes."""
    found = secrets.scan(docs.select(_whole(docs), "text"))
    clean = F.when(F.size("_spans") == 0, F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col("_spans")))
    out = found.select("doc", clean.alias("_clean"), (F.size("_spans") > 0).alias("_hit"))
    new = {"text": F.col("_clean"), "n_chars": F.when(F.col("_hit"), F.length("_clean")).otherwise(F.col("doc.n_chars"))}
    return out.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"doc.`{c}`")
                        for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the mixed order: files and rows follow (slot, offset)."""
    mixed = mixing.mix(docs.select(_whole(docs), "doc_id", "text", "source"), keep=("doc",))
    found, slots = mixing.allotted(docs.select(F.col("source").cast("string").alias("_source"), mixing.in_order()[2]))
    plan = json.dumps([(s, shared, slots[i]) for i, (s, _, shared) in enumerate(found)])
    # the plan goes with the table: queues and shares as a note on the column source, which Parquet keeps
    columns = [F.col(f"doc.`{c}`").alias(c, metadata={MIXED: plan}) if c == "source" else F.col(f"doc.`{c}`") for c in docs.columns]
    return mixed.orderBy("slot", "offset").select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, by the plan that the mixing left with them: its queues, their shares and the order inside a
    queue.  Documents that were not mixed are packed in the order of the packing itself."""
    note = docs.schema["source"].metadata.get(MIXED)
    if note is None:
        return packing.pieces_of(docs)
    plan = json.loads(note)
    source = F.col("source").cast("string")
    own = [s for s, shared, _ in plan if not shared]
    label = lambda s, shared: packing.REST if shared else packing.NULL if s is None else s
    targets = {label(s, shared): n for s, shared, n in plan}
    kept = F.coalesce(source.isin([s for s in own if s is not None]), F.lit(None in own))
    # files come back in any order: rows of a queue sorted by these keys are in the order of (slot, offset)
    keys = mixing.in_order()
    rows = docs.select("doc_id", "text", F.when(kept, source).otherwise(packing.REST).alias("source"), *keys)
    return packing.pieces_of(rows.orderBy("_h", "_id", "_size", "_crc"), targets=targets)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", neardup_stage),
    ("secrets", secrets_stage),
    ("mix", mixing_stage),
    ("pack", packing_stage),
]
