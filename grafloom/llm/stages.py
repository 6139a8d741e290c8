"""The corpus pipeline's stages: each takes (spark, docs, sf_dir), docs with the columns of documents.

All but the last return those columns, and any others that the table has, whatever their names: a
stage's own columns stand beside the row, not in it.

Defined cases: a row without doc_id goes through every stage as a document of its own, last in order;
rows of one doc_id with equal texts are copies of one document; a null text is empty: it has no letter,
so that the language stage drops it; of near copies the one with the smallest doc_id stays, of equal
doc_ids and texts the row whose other columns come first in the order of their hash; ties of the other stages are those of their operators; an empty table stays empty;
very long texts go through whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from grafloom.llm import _store, _words, jaccard, language, mixing, packing, secret_scan

MASK = "[secret]"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the predicted language into ``lang``, and drop documents that have none, as they hold no letter."""
    found = language.predicted(F.col("row.text"), language.train(docs), once=True)
    rows = docs.select(F.struct("*").alias("row")).select("row", found.alias("found")).filter(F.col("found.lang_pred") != "und")
    return rows.select(*(F.col("found.lang_pred").alias("lang") if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each group linked by five-word shingles at 0.8 or more."""
    # a document is its doc_id and text: other texts of the same doc_id are judged by themselves
    own = F.xxhash64("doc_id", "text")
    groups = _store.table(jaccard.join(docs.select(own.alias("doc_id"), "text"), words=5, percent=80).distinct(), "groups")
    named = docs.select(own.alias("key"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")).distinct()
    kept = named.join(groups, F.col("key") == F.col("doc_id")).groupBy("component_id").agg(F.min(F.struct("none", "id", "key")).alias("least")).select(F.col("least.key").alias("key"))
    rows = docs.select(F.struct("*").alias("row"), own.alias("key")).join(kept, "key", "left_semi")
    # rows of one key differ in other columns at most; which stays must not depend on the order they come in
    rest = F.xxhash64(F.to_json(F.struct(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("doc_id", "text")))))
    return rows.groupBy("key").agg(F.min_by("row", rest).alias("row")).select("row.*")


@F.arrow_udf(StringType())
def _masked(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, found in parts:
        done = [pa.array([], pa.string())]
        for b in _words.slices(iter([pa.record_batch({"text": texts, "found": found})])):
            out = []
            for text, spans in zip(b.column("text"), b.column("found"), strict=True):
                text, spans = text.as_py(), spans.as_py()
                if text and spans:
                    kept, at = [], 0
                    for span in spans.split(","):
                        _, start, end = span.split(":")
                        if int(start) >= at:
                            kept += [text[at : int(start)], MASK]
                        at = max(at, int(end))
                    text = "".join(kept) + text[at:]
                out.append(text)
            done.append(pa.array(out, pa.string()))
        yield pa.concat_arrays(done)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found through the blob ledger by a mask; n_chars follows the text."""
    ledger = _store.table(secret_scan.scan(docs), "ledger").filter("spans <> ''").select("blob", "spans")
    rows = docs.select(F.struct("*").alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob")).join(ledger, "blob", "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(_masked(F.col("row.text"), F.col("spans")))
    rows = rows.withColumn("masked", text)
    size = F.when(F.col("masked").isNull(), F.col("row.n_chars")).otherwise(F.char_length("masked").cast("long"))
    new = {"text": F.col("masked"), "n_chars": size}
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does: a row for each copy."""
    taken = mixing.mix(docs).filter("copies > 0").select("doc_id", "source", "copies").distinct()
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source"))
    rows = docs.select(F.struct("*").alias("row")).join(taken, same)
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack(docs)
