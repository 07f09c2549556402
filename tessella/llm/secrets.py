"""Secret scanning over an incremental blob ledger, in DataFrame functions only.

Every historical version of a file is content-addressed (SHA-256 of its text).
The ledger is a stored table of the (blob, rule version) pairs that were
scanned, with their findings. A run scans only the pairs that the ledger lacks,
once per distinct blob however many paths share it, appends them to the ledger
and joins findings back to all paths.

Each run appends one folder of Parquet files, whose name tells the rule version,
under the ledger's path. A folder counts once Spark has written its ``_SUCCESS``
file, so a run that was lost leaves nothing behind that later runs would read.
Two runs at once may both scan a blob; its findings are the same and count once.

Texts are moved between tasks only where a rule's trigger is in them. On a first
run, when there is nothing to leave out, the trigger is tested where a row is
read; later runs test it behind the join with the unseen blobs.

A null text is the empty blob. Rows of the same text share a blob; a repeated
or null path gets a row each time. Other columns are ignored. Very long texts
cost about their length.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import cut, shared_dir, whole

# The patterns of the rules, in the order in which kinds are listed.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
PRIVATE = "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
#: What every text with a finding holds.
TRIGGER = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|-----BEGIN "
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "private_key")
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, findings {FINDINGS}"


def _scan(text: str) -> str:
    held = f"length(regexp_extract(v, {spans.quoted(ASSIGN)}, 2)) >= 8"
    found = [spans.matches(text, "assign", ASSIGN, held)] + [spans.matches(text, k, p) for k, p in (("access", ACCESS), ("hex", HEX), ("private_key", PRIVATE))]
    return f"CAST(transform(concat({', '.join(found)}), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end)) AS {FINDINGS})"


#: A digest of everything that the rules say: changed rules find an empty ledger.
RULE_VERSION = hashlib.sha256(f"{TRIGGER}\n{_scan('text')}".encode()).hexdigest()[:16]


def scan(text: str) -> Column:
    """All findings of a column of texts. A failed assignment is dropped and not retried inside."""
    return F.expr(_scan(text))


@dataclass(frozen=True)
class Ledger:
    """A stored ledger: ``path`` is a folder that all executors share, on any file system that Spark writes to."""

    spark: SparkSession
    path: str

    def _folders(self, rule_version: str) -> list[str]:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rules={rule_version}")
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        runs = [status.getPath() for status in system.listStatus(path)]
        done = lambda run: system.exists(context._jvm.org.apache.hadoop.fs.Path(run, "_SUCCESS"))
        return sorted(run.toString() for run in runs if done(run))

    def read(self, rule_version: str = RULE_VERSION) -> DataFrame | None:
        """(blob, findings) of every scanned blob, once each; None before the first run of a rule version."""
        folders = self._folders(rule_version)
        return self.spark.read.schema(LEDGER).parquet(*folders).dropDuplicates(["blob"]) if folders else None

    def append(self, rows: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
        """Store (blob, findings) as a run and read it back."""
        folder = f"{self.path}/rules={rule_version}/run-{uuid.uuid4().hex}"
        rows.select("blob", "findings").write.parquet(folder)
        return self.spark.read.schema(LEDGER).parquet(folder)


def default_ledger(spark: SparkSession) -> Ledger:
    """The ledger that the session names in ``tessella.secrets.ledger``, else a new one in the shared folder."""
    path = spark.conf.get("tessella.secrets.ledger", None)
    return Ledger(spark, path or f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob) of every version."""
    return docs.select(F.col(path).alias("path"), F.sha2(whole(F.col(text).cast("string")), 256).alias("blob"))


def unseen(paths: DataFrame, known: DataFrame | None) -> DataFrame:
    """(blob): what the ledger has no scan of under this rule version."""
    blobs = paths.select("blob").distinct()
    return blobs if known is None else blobs.join(known.select("blob"), "blob", "left_anti")


def scanned(docs: DataFrame, todo: DataFrame, first_run: bool, text: str = "text") -> DataFrame:
    """(blob, findings) of the blobs in ``todo``, each scanned once."""
    source = docs.select(whole(F.col(text).cast("string")).alias("text"))
    keyed = lambda rows: rows.withColumn("blob", F.sha2("text", 256))
    if first_run:
        texts = keyed(source.where(F.col("text").rlike(TRIGGER)))
    else:
        texts = keyed(source).join(todo, "blob", "left_semi").where(F.col("text").rlike(TRIGGER))
    once = texts.groupBy("blob").agg(F.first("text").alias("text")).select("blob", scan("text").alias("findings"))
    return todo.join(once, "blob", "left").select("blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def findings(docs: DataFrame, ledger: Ledger | None = None, path: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(path, blob, findings) of every version, and the rows that this run appended to the ledger."""
    ledger = ledger or default_ledger(docs.sparkSession)
    known = ledger.read(rule_version)
    paths = cut(versions(docs, path, text))
    new = ledger.append(scanned(docs, unseen(paths, known), known is None, text), rule_version)
    found = new if known is None else known.unionByName(new)
    return paths.join(found, "blob").select("path", "blob", "findings"), new


def masked(docs: DataFrame, ledger: Ledger | None = None, path: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """All rows of ``docs`` with every finding in their text masked; other columns stay as they are.

    Only rows with a trigger in their text meet the findings; the others pass through.
    """
    ledger = ledger or default_ledger(docs.sparkSession)
    findings(docs, ledger, path, text)
    found = ledger.read().where(F.size("findings") > 0).select(F.col("blob").alias("_blob"), F.col("findings").alias("_findings"))
    here = F.coalesce(F.col(text).rlike(TRIGGER), F.lit(False))
    joined = docs.where(here).withColumn("_sha", F.sha2(whole(text), 256)).join(found, F.col("_sha") == F.col("_blob"), "left")
    changed = F.when(F.col("_findings").isNull(), F.col(text)).otherwise(F.expr(redacted(f"`{text}`", "_findings", mask)))
    return docs.where(~here).unionByName(joined.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]))


def redacted(text: str, found: str, mask: str = "[SECRET]") -> str:
    """SQL: ``text`` with every span of ``found`` (code points, any order, overlaps allowed) replaced by ``mask``.

    Looking for a code point takes time by its distance from the beginning, so
    spans are taken in chunks, and a chunk's stretch of the text is cut out once.
    """
    order = f"array_sort(transform({found}, s -> named_struct('s', s.start, 'e', s.end)))"
    keep = f"concat(a.out, array(substring(piece, a.at - w.at + 1, x.s - a.at), {spans.quoted(mask)}))"
    walk = f"CASE WHEN x.e > a.at THEN named_struct('at', x.e, 'out', CASE WHEN x.s >= a.at THEN {keep} ELSE a.out END) ELSE a END"
    own = f"aggregate(chunk, named_struct('at', w.at, 'out', CAST(array() AS array<string>)), (a, x) -> {walk})"
    piece = f"substring({text}, w.at + 1, greatest(array_max(transform(chunk, x -> x.e)) - w.at, 0))"
    step = spans.let(piece, "piece", spans.let(own, "own", "named_struct('at', own.at, 'out', concat(w.out, array(array_join(own.out, ''))))"))
    start = "named_struct('at', 0, 'out', CAST(array() AS array<string>))"
    walked = f"aggregate({spans.chunks(order, spans.CHUNK)}, {start}, (w, chunk) -> {step}, w -> concat(array_join(w.out, ''), substring({text}, w.at + 1)))"
    return f"CASE WHEN size({found}) > 0 THEN {walked} ELSE {text} END"
