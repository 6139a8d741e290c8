"""Exact duplicates through an extendible-hash index on shared files.

Texts are normalised (ASCII white space deleted), hashed to 64 bits and written once as signature rows
(doc_id, hash, SHA-256, length). The distinct hashes are cut into buckets of at most ``capacity`` keys:
a directory of (depth, prefix) starts at the depth that the number of keys asks for, and as long as a
bucket is overfull it doubles, one more bit, splitting just the overfull buckets. A bucket is a range of
keys and belongs to one owner task, which writes its entries in key order; different texts of one hash
are chained there by number. Entries of several rows are then compared byte by byte: only texts whose
hash is shared move, and each task sends one row for each of its texts, so a text that a third of all
rows repeat is one row a task. Everything is built-in functions; no task holds a group.

Defined cases: a null text is empty and equals texts of white space only; of equal texts the row with
the most code points in the original stays, then the smallest doc_id (a null one last); rows that
repeat the doc_id that stays are that document and stay with it, each with a row in the result, if
they are as long; an empty table gives an empty result; other columns are not read, whatever their
names; a very long text is held by one task at a time, some ten bytes a byte. Two different texts of
one hash and one SHA-256 would raise an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from grafloom.llm import _store

#: Keys of a bucket.
CAPACITY = 1 << 14
#: Shared hashes that are broadcast to find the texts to compare (8 bytes each); more are joined by shuffle.
BROADCAST = 1 << 19
#: Deleted before texts are compared.
SPACE = " \t\n\x0b\x0c\r"


def normalised(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def _prefix(depth: int) -> Column:
    """The key's first ``depth`` bits."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(depth, prefix, keys): buckets of at most ``capacity`` of the distinct 64-bit ``key``s.

    Each key lies in one bucket; a bucket without keys has no row. Only one of full depth, which is one key, can't split.
    """
    depth = (keys.count() // capacity).bit_length()
    counted = lambda rows, d: rows.groupBy(_prefix(d).alias("prefix")).agg(F.count("*").alias("keys")).select(F.lit(d).alias("depth"), "prefix", "keys")
    open_, done = _store.table(counted(keys, depth), "directory"), None
    while True:
        fits = open_.filter((F.col("keys") <= capacity) | (F.col("depth") == 64))
        done = fits if done is None else done.unionAll(fits)
        full = open_.filter((F.col("keys") > capacity) & (F.col("depth") < 64)).select(F.col("prefix").alias("full"))
        if full.isEmpty():
            return done
        inside = keys.join(full, _prefix(depth) == F.col("full"), "left_semi")
        depth += 1
        open_ = _store.table(counted(inside, depth), "directory")


def buckets(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Keys with the (depth, prefix) of the bucket that holds them."""
    depths = [r.depth for r in index.select("depth").distinct().collect()]  # 65 at most
    at = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths))) if depths else F.explode(F.lit(None).cast("array<struct<depth:int,prefix:bigint>>"))
    return keys.withColumn("_at", at).select("*", "_at.depth", "_at.prefix").drop("_at").join(index.select("depth", "prefix"), ["depth", "prefix"], "left_semi")


def _compared(docs: DataFrame, entries: DataFrame, key: Callable[[Column], Column], most: int) -> DataFrame:
    """(key, text_sha256, same): how many rows of each entry of several rows are equal byte by byte to the others of its digest."""
    shared = entries.filter("size > 1").select("key").distinct()
    small = shared.limit(most + 1).count() <= most
    texts = docs.select(normalised().alias("norm")).select("norm", key(F.col("norm")).alias("key"))
    texts = texts.join(F.broadcast(shared) if small else shared, "key", "left_semi")
    return texts.groupBy("key", "norm").agg(F.count("*").alias("same")).select("key", F.sha2("norm", 256).alias("text_sha256"), "same").groupBy("key", "text_sha256").agg(F.max("same").alias("same"))


def build(docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64, most: int = BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(rows, entries) on shared files: a signature row for each row of ``docs`` (doc_id, text), and the index.

    Entries: ``depth`` and ``prefix`` of the bucket, ``key``, ``chain`` (0 for the first text of a key),
    ``text_sha256``, ``size`` (rows), ``n`` and ``keep_id`` of the row that stays.
    """
    norm = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), normalised().alias("norm"))
    rows = _store.table(norm.select("doc_id", "n", key(F.col("norm")).alias("key"), F.sha2("norm", 256).alias("text_sha256")), "rows")
    # ~x turns the order of integers round without overflow
    first = F.max(F.struct("n", F.bitwise_not("doc_id").alias("back")))
    found = rows.groupBy("key", "text_sha256").agg(F.count("*").alias("size"), first.alias("first"))
    found = _store.table(found.select("key", "text_sha256", "size", "first.n", F.bitwise_not("first.back").alias("keep_id")), "entries")
    keys = found.select("key").distinct()
    owned = buckets(keys, directory(keys, capacity))
    chain = F.row_number().over(Window.partitionBy("key").orderBy("text_sha256")) - 1
    same = _compared(docs, found, key, most)
    checked = F.when((F.col("size") == 1) | (F.col("size") == F.col("same")), F.col("size")).otherwise(F.raise_error(F.lit("different texts of one hash and one digest")))
    entries = found.join(same, ["key", "text_sha256"], "left").withColumn("size", checked).drop("same").withColumn("chain", chain)
    entries = entries.join(owned, "key").repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "key", "chain")
    return rows, _store.table(entries.select("depth", "prefix", "key", "chain", "text_sha256", "size", "n", "keep_id"), "index")


def groups(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every signature row."""
    index = entries.select("key", "text_sha256", "keep_id", F.col("size").alias("group_size"), F.col("n").alias("_n"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("_n"))
    return rows.join(index, ["key", "text_sha256"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def dedup(docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64, most: int = BROADCAST) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the row of its equal texts that stays."""
    return groups(*build(docs, capacity, key, most))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
