"""Secret scans over an incremental blob ledger.

Every historical version of every path is content-addressed (SHA-256 of its text). A ledger
on shared storage records, per blob and rule version, what a scan found; a run scans only
(blob, rule version) pairs that the ledger has not seen, each blob once whatever the number
of paths that hold it, and joins the findings back to all paths.

Findings are spans ``kind:start:end`` in code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ship, text_of, with_row

# -- fixed values: the base rules, in this order -----------------------------------------
KINDS = ("assign", "access", "hex", "github", "pem")
BASE_KINDS = KINDS[:3]
_ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # = 18 or more characters; a run is maximal either way
_HEX = re.compile(r"[0-9a-f]{16,}")
# -- rules that the method adds: tokens with a public prefix, private keys in PEM ---------
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_PEM_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
# a line break, also one written as an escape, with quotes, commas or comment signs around it
_BREAK = r"""(?:(?:\\r)?\\n|(?:\\r)?(?:\\n)?[ \t"',\\]*(?:\+[ \t]*)?\r?\n[ \t"'>#*]*)"""
# what follows a header that has no END: lines "Name: value" with a blank line, then base64 lines
_PEM_BODY = re.compile(
    rf"(?:{_BREAK}(?:Proc-Type|DEK-Info|Comment|[A-Z][A-Za-z]*-[A-Z][A-Za-z-]*):[^\r\n\\]*)*(?:{_BREAK}(?={_BREAK}))?"
    rf"""(?:{_BREAK}[A-Za-z0-9+/]+={{0,2}}(?=[ \t"',+\\]*(?:\r?\n|\Z)|\\[rn]))*""")
RULE_VERSION = "3"

LEDGER_SCHEMA = "blob string, spans string, n_assign long, n_access long, n_hex long, base string"


def _pem_end(text: str, at: int) -> int:
    """Where the key ends whose header ends at ``at``: at its END line, which no other header
    comes before; without one, after the base64 lines that follow."""
    other = text.find("-----BEGIN ", at)
    end = _PEM_END.search(text, at, other if other >= 0 else len(text))
    return (end or _PEM_BODY.match(text, at)).end()


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "gh" in text:
        out += [(m.start(), 3, m.end()) for m in _GITHUB.finditer(text)]
    if "-----BEGIN" in text:
        out += [(m.start(), 4, _pem_end(text, m.end())) for m in _PEM.finditer(text)]
    return sorted(out)


def _digest(text: str) -> tuple[str, int, int, int, str]:
    spans = find_spans(text)
    join = lambda which: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in which)
    base = [x for x in spans if x[1] < len(BASE_KINDS)]
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return join(spans), n[0], n[1], n[2], join(base)


def _scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(b, *_digest(t)) for b, t in zip(pdf["blob"], pdf["text"])]
        yield pd.DataFrame(rows, columns=["blob", "spans", "n_assign", "n_access", "n_hex", "base"])


class BlobLedger:
    """An append-only Parquet table of scan results, one folder per rule version.

    A run writes its part in one Spark job; a part counts only once its ``_SUCCESS`` mark
    is there, so a lost run leaves nothing half-read. Parts of two runs may overlap after a
    retry; equal blobs have equal results, and readers take one.
    """

    def __init__(self, spark: SparkSession, path: str, rule_version: str = RULE_VERSION):
        self.spark, self.path = spark, f"{path.rstrip('/')}/rules={rule_version}"

    def _parts(self) -> list[str]:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        subs = [s.getPath() for s in fs.listStatus(p)]
        return sorted(str(s) for s in subs if fs.exists(jvm.org.apache.hadoop.fs.Path(s, "_SUCCESS")))

    def read(self) -> DataFrame | None:
        parts = self._parts()
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*parts) if parts else None

    def append(self, found: DataFrame, run: str) -> None:
        found.write.mode("overwrite").parquet(f"{self.path}/run={run}")


def _bucket(blob: str) -> Column:
    """One of 2^20 buckets: a set of them is a broadcast of a bounded size."""
    return F.pmod(F.xxhash64(blob), F.lit(1 << 20)).cast("int").alias("_b")


def _findings(ledger: BlobLedger) -> DataFrame:
    """One row per blob with findings, written once: a join with it can split a hot blob's paths."""
    found = ledger.read().where("spans <> ''").groupBy("blob").agg(
        *[F.first(c).alias(c) for c in ("n_assign", "n_access", "n_hex", "base", "spans")])
    return materialize(found, "findings")


def scan_versions(versions: DataFrame, ledger: BlobLedger, run: str, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Scan every version (row) of every path ``key``, using and extending ``ledger``.

    Returns one row per input row: ``key``, ``blob``, ``n_assign``, ``n_access``, ``n_hex``,
    ``base`` and ``spans`` (strings of spans). A null text is the empty text; a null or
    repeated key is a path like any other; an empty table gives an empty result.

    Texts move once, and only those that must be scanned: a fixed-size broadcast drops most
    others in the scan, copies are reduced to one row per blob in every task before they move,
    and each unseen blob is scanned once. Keys and hashes of all rows are written to the
    shared folder first.
    """
    ship(versions.sparkSession)
    rows = versions.select(F.col(key).alias("path"), text_of(text).alias("text")).withColumn(
        "blob", F.sha2("text", 256))
    paths = materialize(rows.select("path", "blob"), "blobs")
    unseen = paths.select("blob").distinct()
    seen = ledger.read()
    if seen is not None:
        unseen = unseen.join(seen.select("blob").distinct(), "blob", "left_anti")
    unseen = materialize(unseen, "unseen")
    new = rows.select("blob", "text", _bucket("blob")).join(F.broadcast(unseen.select(_bucket("blob")).distinct()), "_b", "left_semi")
    todo = new.groupBy("blob").agg(F.first("text").alias("text")).join(unseen, "blob", "left_semi")
    ledger.append(todo.mapInPandas(_scan, LEDGER_SCHEMA), run)
    found = _findings(ledger)
    zero, none = F.lit(0).cast("long"), F.lit("")
    return paths.join(found, "blob", "left").select(
        F.col("path").alias(key), "blob", *[F.coalesce(c, zero).alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, ledger: BlobLedger, run: str, key: str = "doc_id", text: str = "text",
           mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span that the scan finds replaced by ``mark`` (overlapping spans by one).

    All rows stay; other columns are as they were, a null text too. Rows whose text shares no
    hash bucket with a blob that has findings do not move.
    """
    scan_versions(docs, ledger, run, key, text)
    found = ledger.read().where("spans <> ''").select(F.col("blob").alias("hit"), "spans").dropDuplicates(["hit"])
    found = materialize(found, "hits")
    blob = F.sha2(text_of(text), 256)
    tagged = with_row(docs, blob=blob, text=F.col(text)).withColumn("_b", _bucket("blob"))
    buckets = F.broadcast(found.select(_bucket("hit")).distinct())
    far = tagged.join(buckets, "_b", "left_anti").select("row.*")
    rows = tagged.join(buckets, "_b", "left_semi").join(found, F.col("blob") == F.col("hit"), "left")

    @F.pandas_udf("string")
    def blank(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cover(t, s, mark) for t, s in zip(texts, spans)], dtype=object)

    # only rows with findings go through Python
    clean = far.unionByName(rows.where("spans IS NULL").select("row.*"))
    hit = rows.where("spans IS NOT NULL").select("row", blank("text", "spans").alias("text"))
    out = hit.select(*[(F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return clean.unionByName(out)


def cover(text: str, spans: str, mark: str) -> str:
    out, at = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
