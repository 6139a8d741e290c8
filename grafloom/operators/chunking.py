"""Text units: sliding token windows, sentence chunks, batches, packing of lists by token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grafloom.functions import subword, text as T
from grafloom.operators import graph

#: Spaces of every width, which sentences don't begin or end with.
_SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def token_windows(toks: Column, size: int, overlap: int) -> Column:
    """Windows (start, n_tokens, chunk) of ``size`` tokens, every ``size - overlap``; the last may lie inside the one before."""
    spans = token_spans(toks, size, overlap)
    return F.transform(spans, lambda w: F.struct(w["start"].alias("start"), w["n_tokens"].alias("n_tokens"), F.array_join(w["tokens"], " ").alias("chunk")))


def token_spans(toks: Column, size: int, overlap: int) -> Column:
    """The same windows with their tokens (start, n_tokens, tokens), of whatever kind these are."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the window")
    n = F.size(toks)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(size), n - s).alias("n_tokens"), F.slice(toks, s + 1, size).alias("tokens")))


def base_text_units(documents: DataFrame, size: int = 1200, overlap: int = 100, by: tuple[str, ...] = ("id",), tokenizer: subword.Tokenizer = subword.WORDS) -> DataFrame:
    """Text units of documents (id, text): grouping columns, document_ids, start, n_tokens, chunk and id.

    Documents of a group are one token stream in id order, so a unit may span documents when groups
    are larger than a document. With the default grouping nothing is shuffled. Otherwise running sums
    tell where in its stream a document lies, each gives the units that it overlaps its part of them,
    and a unit is put together from those: no row holds more than a document or a unit. ``tokenizer`` tells what a
    token is: runs between white space, or subwords.
    """
    own = documents.select(*dict.fromkeys([*by, "id"]), tokenizer.split("text").alias("_tokens"))
    if tuple(by) == ("id",):
        rows = own.select("id", F.explode(token_spans(F.col("_tokens"), size, overlap)).alias("w"))
        units = rows.select("id", F.array(F.col("id").cast("string")).alias("document_ids"), "w.start", "w.n_tokens", tokenizer.join("w.tokens").alias("chunk"))
    else:
        step = size - overlap
        if not 0 <= overlap < size:
            raise ValueError("overlap must be less than the window")
        n = F.size("_tokens").cast("long")
        rows = graph.running_sum(own.withColumn("_n", n), F.col("_n"), [F.col("id"), F.col("_n")], list(by), "_hi").filter("_n > 0").withColumn("_lo", F.col("_hi") - F.col("_n"))
        first = F.greatest(F.lit(0), F.floor((F.col("_lo") - size) / step) + 1).cast("long")
        rows = rows.withColumn("_k", F.explode(F.sequence(first, F.floor((F.col("_hi") - 1) / step).cast("long"))))
        lo, hi = F.greatest(F.col("_lo"), F.col("_k") * step), F.least(F.col("_hi"), F.col("_k") * step + size)
        part = F.slice("_tokens", (lo - F.col("_lo") + 1).cast("int"), (hi - lo).cast("int"))
        parts = F.sort_array(F.collect_list(F.struct(F.col("_lo").alias("lo"), F.col("id").cast("string").alias("id"), part.alias("tokens"))))
        whole = rows.groupBy(*by, "_k").agg(parts.alias("_parts"))
        toks = F.flatten(F.transform("_parts", lambda p: p["tokens"]))
        units = whole.select(*by, F.transform("_parts", lambda p: p["id"]).alias("document_ids"), (F.col("_k") * step).cast("int").alias("start"), F.size(toks).alias("n_tokens"), tokenizer.join(toks).alias("chunk"))
    key = T.row_hash(F.concat_ws(",", F.array_sort("document_ids")), F.col("chunk"), F.col("n_tokens"))
    return units.withColumn("chunk_id", key).withColumnRenamed("id", "group_id").withColumn("id", F.col("chunk_id")) if "id" in by else units.withColumn("chunk_id", key).withColumn("id", key)


def split_text(text: Column | str, size: int, overlap: int, tokenizer: subword.Tokenizer = subword.WORDS) -> Column:
    """The windows of one text as an array of texts; null and the empty text have none."""
    return F.transform(token_spans(tokenizer.split(text), size, overlap), lambda w: tokenizer.join(w["tokens"]))


def split_list(texts: str, size: int, overlap: int) -> Column:
    """The windows of a column's list of texts, which are put together with spaces first; null items are left out."""
    return split_text(F.coalesce(F.array_join(texts, " "), F.lit("")), size, overlap)


def text_units(documents: DataFrame, strategy: str = "tokens", size: int = 1200, overlap: int = 100, tokenizer: subword.Tokenizer = subword.WORDS) -> DataFrame:
    """(id, text, n_tokens, document_ids) of documents (id, text) by windows of ``tokens`` or by ``sentence``.

    Sentences have no number of tokens; equal sentences of a document share an id.
    """
    if strategy == "tokens":
        return base_text_units(documents, size, overlap, tokenizer=tokenizer).select("id", F.col("chunk").alias("text"), "n_tokens", "document_ids")
    if strategy != "sentence":
        raise ValueError(f"unknown strategy: {strategy}")
    rows = sentence_units(documents).withColumn("document_ids", F.array(F.col("id").cast("string")))
    return rows.select(T.row_hash("id", "chunk").alias("id"), F.col("chunk").alias("text"), "n_tokens", "document_ids").dropDuplicates(["id"])


def sentence_units(documents: DataFrame) -> DataFrame:
    """A row per sentence of (id, text); n_tokens is null in this mode."""
    # not F.trim itself, which would take transform's index for the characters to trim
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])[ \t\n\f\r]+"), lambda s: F.trim(s, F.lit(_SPACES))), lambda s: s != "")
    return documents.select("id", F.posexplode(parts).alias("ordinal", "chunk")).withColumn("n_tokens", F.lit(None).cast("int"))


def batched(items: Column, n: int) -> Column:
    """An array cut into arrays of ``n``, the last shorter."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(1), F.size(items), F.lit(n)), lambda i: F.slice(items, i, n))).otherwise(F.array())


def pack_list(items: Column, sizes: Column, budget: int) -> Column:
    """Greedy packing of an ordered array: (items of each chunk), cut where the budget would be passed.

    An item over the budget is dropped if the open chunk is empty, and starts a chunk of its own otherwise.
    """
    pairs = F.arrays_zip(items.alias("item"), sizes.alias("size"))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, x: Column) -> Column:
        full = s["used"] + x["size"] > budget
        empty = F.size(s["open"]) == 0
        fresh = F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), F.array(x["item"]).alias("open"), x["size"].cast("long").alias("used"))
        more = F.struct(s["done"].alias("done"), F.concat(s["open"], F.array(x["item"])).alias("open"), (s["used"] + x["size"]).cast("long").alias("used"))
        return F.when(full & empty, s).when(full, fresh).otherwise(more)

    return F.aggregate(pairs, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
