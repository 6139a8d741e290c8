"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed (SHA-256 of its UTF-8 bytes). The ledger holds one
row for each (blob, rule version) pair that was scanned, with its findings. A scan takes the
pairs that the ledger lacks, reads each blob once, however many paths carry it, and joins the
findings back to every path.

Defined cases: a null text is the empty blob; repeated rows are paths of one blob and each gets a
result; empty tables give empty results; other columns of the input are not read, whatever their
names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from grafloom.llm import _store, _words

# The base rules, and what this method adds to them.
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# A key reaches over header lines (RFC 1421), blank lines and base64 lines to the END of its own kind; where that
# is missing, to the end of the base64 lines. Line ends may be escaped, as in JSON, and lines indented or quoted.
_EOL = r"[\x20\t\"',;+]*+(?:\r?\n|\r|\\++r\\++n|\\++n)[\x20\t>#*\"'+]*+"
_BASE64 = r"[A-Za-z0-9+/=]"
# possessive throughout, so that no text costs more than in proportion to its size
PEM = re.compile(
    r"-----BEGIN (?P<kind>[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?P=kind)-----"
    rf"|(?:(?:{_EOL})++[A-Za-z][A-Za-z0-9-]*+:\x20[^\r\n\\]*+)*+"
    rf"(?:{_EOL}{_BASE64}++(?={_EOL}|[\x20\t\"']*\Z|[\"'])|(?:(?:{_EOL})++|[\x20\t]*+)(?:{_BASE64}{{16,}}+|[A-Za-z0-9+/]++={{1,2}}))*+)"
)
ADDED = (
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{20,}")),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("pem", PEM),
)
BASE = ("assign", "access", "hex")
KINDS = (*BASE, *(k for k, _ in ADDED))
RULE_VERSION = "base-3+added-5"
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """All spans (start, kind, end), by start, then kind as listed."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    # a run that is greedy to its end has one leftmost match, so the least length may stand in the pattern
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    for (kind, rule), mark in zip(ADDED, ("gh", "xox", "eyJ", "-----BEGIN"), strict=True):
        found += [(m.start(), kind, m.end()) for m in rule.finditer(text)] if mark in text else []
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _words.slices(batches):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in b.column("text"):
            spans = find_spans(text.as_py() or "")
            base = [s for s in spans if s[1] in BASE]
            for kind in BASE:
                out[f"n_{kind}"].append(sum(s[1] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(spans))
        yield pa.record_batch({"blob": b.column("blob"), "rule_version": b.column("rule_version"), **{k: pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items()}})


def paths(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob): the content address of each path's text."""
    return docs.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """The ledger's new rows: findings of each blob of ``docs`` not yet scanned under ``rule_version``.

    A blob's text crosses the shuffle once for each map task that holds it, whatever the number
    of its copies: ``first`` combines them on the map side.
    """
    blobs = docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("rule_version", F.lit(rule_version))
    return unseen.mapInArrow(_scan, LEDGER)


def findings(docs: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Each path with its blob's findings."""
    known = ledger.filter(F.col("rule_version") == rule_version).drop("rule_version")
    return paths(docs, path, text).join(known, "blob").select(F.col("path").alias(path), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, through a ledger that starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = _store.table(scan(docs), "ledger")
    return findings(docs, ledger)
