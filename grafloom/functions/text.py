"""Scalar functions over text columns: tokens, hashes, cleaning, parsers. All are JVM expressions, save HTML entities."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

#: A token is a run of characters other than ASCII white space.
TOKEN = r"[^ \t\n\r\f]+"
#: Control characters that cleaning removes.
CONTROL = r"[\x00-\x1f\x7f-\x9f]"
_EDGES = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
_UUID = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def token_count(text: Column | str) -> Column:
    """Tokens of a text; null has none."""
    return F.coalesce(F.regexp_count(_col(text), F.lit(TOKEN)), F.lit(0))


def fits(text: Column | str, limit: int) -> Column:
    """1 if the text has at most ``limit`` tokens, else 0."""
    return (token_count(text) <= limit).cast("int")


def detokenize(column: Column | str) -> Column:
    return F.array_join(_col(column), " ")


def row_hash(*columns: Column | str) -> Column:
    """MD5 of the columns' strings joined; null counts as the empty string."""
    return F.md5(F.concat(*(F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns)))


def stable_id(*columns: Column | str, seed: int = 0) -> Column:
    """An id that follows from names alone: equal on every level, run and partition."""
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns)))


def uuid4_hex(*columns: Column | str, seed: int = 0) -> Column:
    """:func:`stable_id` in the form of a random UUID (version 4, its variant's bits) without dashes."""
    h = stable_id(*columns, seed=seed)
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)), F.lit(1))
    return F.concat(F.substring(h, 1, 12), F.lit("4"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def strip(text: Column | str) -> Column:
    """Drop white space of every kind from both ends; SQL's own trim drops spaces only."""
    return F.regexp_replace(_col(text), _EDGES, "")


def strip_control(text: Column | str) -> Column:
    return F.regexp_replace(strip(text), CONTROL, "")


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Resolve HTML entities; null stays null."""
    return text.map(html.unescape, na_action="ignore")


def clean(text: Column | str) -> Column:
    """Trim, resolve entities, drop control characters."""
    return F.regexp_replace(unescape(strip(text)), CONTROL, "")


def node_name(text: Column | str) -> Column:
    """A node's canonical name: upper case, trimmed, entities resolved."""
    return unescape(strip(F.upper(_col(text))))


def split_list(text: Column | str, separator: str = ",") -> Column:
    """Split at a literal separator; the empty string gives no items, null stays null."""
    c = _col(text)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, _literal(separator)))


def unpack_list(text: Column | str, separator: str = ",") -> Column:
    """As :func:`split_list`, with no items for null."""
    return F.coalesce(split_list(text, separator), F.array().cast("array<string>"))


def null_or_nan(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def is_uuid(c: Column | str) -> Column:
    return _col(c).rlike(_UUID)


def has_typed_keys(m: Column, kinds: dict[str, str]) -> Column:
    """Whether a map of strings holds every key with a value that casts to the key's type."""
    ok = F.lit(True)
    for k, kind in kinds.items():
        ok = ok & m[k].try_cast(kind).isNotNull()
    return F.coalesce(ok, F.lit(False))


def fill_placeholders(template: Column | str, **values: Column | str) -> Column:
    """Put values in the place of ``{name}``."""
    out = _col(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v if isinstance(v, Column) else F.lit(v))
    return out


def strip_citations(text: Column | str) -> Column:
    """Drop ``[Data: ...]`` to the last bracket of its line."""
    return F.regexp_replace(_col(text), r"\[Data: .+\]", "")


def rank_value(rating: Column | str) -> Column:
    """A rating as a number, -1 if it is none."""
    return F.coalesce(_col(rating).try_cast("double"), F.lit(-1.0))


def date_parts(ts: Column) -> dict[str, Column]:
    return {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts)}


def _fenceless(answer: Column) -> Column:
    return F.regexp_replace(strip(F.regexp_replace(answer, "`", "")), "^json\\s*", "")


def _read_points(body: Column) -> Column:
    read = F.from_json(body, "points array<struct<description: string, score: string>>")["points"]
    scored = F.transform(read, lambda p: F.struct(F.coalesce(p["description"], F.lit("")).alias("description"), F.coalesce(p["score"].try_cast("double").cast("int"), F.lit(0)).alias("score")))
    none = F.array(F.struct(F.lit("").alias("description"), F.lit(0).alias("score")))
    return F.coalesce(F.when(F.size(scored) > 0, scored), none)


def points(answer: Column | str) -> Column:
    """The points (description, score) of a model's JSON answer; one point of score 0 if it can't be read.

    Back-quotes and a leading ``json`` of a fenced answer are dropped.
    """
    from grafloom.functions import repair

    return _read_points(repair.json_object(_fenceless(_col(answer))))


def with_points(rows: DataFrame, answer: str, to: str = "points") -> DataFrame:
    """Rows with the points of their answers, as :func:`points` reads them; only answers that need mending leave the JVM."""
    from grafloom.functions import repair

    own = rows.withColumn("_body", _fenceless(F.col(answer)))
    return repair.mended(own, "_body").withColumn(to, _read_points(F.col("_body"))).drop("_body")


def report_markdown(title: Column, summary: Column, findings: Column) -> Column:
    """A report as text: title, summary, a section for each finding (summary, explanation)."""
    parts = F.transform(findings, lambda f: F.concat(F.lit("## "), F.coalesce(f["summary"], F.lit("")), F.lit("\n\n"), F.coalesce(f["explanation"], F.lit(""))))
    return F.concat(F.lit("# "), F.coalesce(title, F.lit("Report")), F.lit("\n\n"), F.coalesce(summary, F.lit("")), F.lit("\n\n"), F.array_join(F.coalesce(parts, F.array().cast("array<string>")), "\n\n"))


def csv_line(*columns: Column, separator: str = ",") -> Column:
    """A line of CSV: a field is quoted where it holds the separator, a quote or a line break; null is empty."""
    return F.to_csv(F.struct(*columns), {"sep": separator, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})


def _literal(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
