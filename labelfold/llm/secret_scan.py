"""Secret scan over an incremental blob ledger (operator 10).

Every version of a text is addressed by the SHA-256 of its content.  A ledger
(a Parquet table in a shared folder) holds the findings of each
``(blob, rule version)`` pair scanned so far; a run scans only the pairs not in
it, one document per new blob, appends their findings (clean blobs too) and
joins the findings of all blobs back to every row.  A rule change is a new rule
version, so old blobs are scanned again; nothing is rescanned otherwise.

Scanning is Python's ``re`` over Arrow batches; only the blob column and the ids
take part in joins but for the one document of a new blob whose text is read.

Cases: a null text counts as empty; a null or repeated doc_id is kept row by
row; an empty table gives an empty result; extra columns pass through unless
they bear an output's name.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelfold.session import checkpoint_path

from .common import set_aside, table

#: Kinds in the order of the digest.  The first three are the contract's, the others the method's own.
KINDS = ("assign", "access", "hex", "github", "slack", "jwt", "google", "private_key", "url_login")
BASE = KINDS[:3]
_LETTERS = lambda s: "".join(f"[{c}{c.upper()}]" for c in s)
_ASSIGN = re.compile("(" + "|".join(_LETTERS(w) for w in ("password", "passwd", "secret", "token")) + "|"
                     + _LETTERS("api") + "_?" + _LETTERS("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_RULES = {
    "access": re.compile(r"AKIA[A-Z0-9]{14,}"),  # the leftmost run is maximal, so the length may stand in the pattern
    "hex": re.compile(r"[0-9a-f]{16,}"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{30,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}"),
    "private_key": re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,20}PRIVATE KEY-----"),
    "url_login": re.compile(r"(?<=://)[A-Za-z0-9_.-]{1,64}:[^\s:@/]{6,64}@"),
}
#: Of the rules above; a change of them changes it, and so has every blob scanned anew.
RULE_VERSION = hashlib.sha256("\n".join([_ASSIGN.pattern, *(f"{k} {r.pattern}" for k, r in _RULES.items())]).encode()).hexdigest()[:16]

#: Blobs with findings that one broadcast may hold (about 30 MB); beyond, findings join by shuffle.
BROADCAST_BLOBS = 200_000

FINDING = "array<struct<start:long,end:long,kind:int>>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))


_JWT_RUN = re.compile(r"[A-Za-z0-9_-]++")


def _jwt_spans(text: str) -> Iterator[tuple[int, int]]:
    """The rule's matches in linear time: where it fails at one ``eyJ`` of a run, it fails at the run's later ones."""
    at = text.find("eyJ")
    while at >= 0:
        m = _RULES["jwt"].match(text, at)
        if m:
            yield m.span()
        at = text.find("eyJ", m.end() if m else _JWT_RUN.match(text, at).end())


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of every secret, by start, then kind; code points, end exclusive."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    for kind, rule in _RULES.items():
        number = KINDS.index(kind)
        spans = _jwt_spans(text) if kind == "jwt" else (m.span() for m in rule.finditer(text))
        found += [(a, b, number) for a, b in spans]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(t or "")]
                     for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("blob_id"), pa.array(found, _ARROW)], ["blob_id", "found"])


def ledger_path(spark: SparkSession, name: str | None = None) -> str:
    """A ledger folder beside the checkpoints; a fixed name makes later runs incremental."""
    return checkpoint_path(spark, f"llm/secret-ledger-{name or uuid.uuid4().hex[:12]}")


def _read_ledger(spark: SparkSession, path: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"blob_id string, found {FINDING}, rule_version string")
    return spark.read.schema(f"blob_id string, found {FINDING}, rule_version string").parquet(path)


def blob_id(text="text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def update_ledger(docs: DataFrame, path: str, rule_version: str = RULE_VERSION) -> None:
    """Scan the blobs of ``docs(doc_id, text)`` that the ledger lacks under this rule version and append them."""
    spark = docs.sparkSession
    blobs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), blob_id().alias("blob_id"), F.col("text"))
    known = _read_ledger(spark, path).where(F.col("rule_version") == rule_version).select("blob_id").distinct()
    # one document for each unseen blob: ids and digests only
    one = blobs.groupBy("blob_id").agg(F.min("id").alias("id")).join(known, "blob_id", "left_anti")
    fresh = blobs.join(one, ["id", "blob_id"], "left_semi")
    (fresh.select("blob_id", "text").mapInArrow(_scan, f"blob_id string, found {FINDING}")
     .dropDuplicates(["blob_id"]).withColumn("rule_version", F.lit(rule_version)).write.mode("append").parquet(path))


def scan(docs: DataFrame, path: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Every row of ``docs`` with ``blob_id`` and ``found`` (start, end and kind number of each secret)."""
    spark = docs.sparkSession
    path = path or ledger_path(spark)
    kept = [c for c in docs.columns if c.lower() not in ("blob_id", "found")]
    update_ledger(docs.select("doc_id", "text"), path, rule_version)
    # a blob appended by two runs at once has two equal rows; most blobs are clean, and only the others join
    found = (_read_ledger(spark, path).where((F.col("rule_version") == rule_version) & (F.size("found") > 0))
             .select("blob_id", "found").dropDuplicates(["blob_id"]))
    if found.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS:
        found = F.broadcast(found)
    empty = F.expr(f"cast(array() as {FINDING})")
    return (docs.select(*[F.col(f"`{c}`") for c in kept], blob_id().alias("blob_id")).join(found, "blob_id", "left")
            .select(*[F.col(f"`{c}`") for c in kept], "blob_id", F.coalesce("found", empty).alias("found")))


def joined_spans(found, kinds=KINDS):
    """``kind:start:end`` of the given kinds, comma-joined, by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter(found, lambda x: x["kind"] < len(kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """``op10_secret_scan``: the digest of the findings of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
                        F.sha2(joined_spans(F.col("found"), BASE), 256).alias("base_sha256"),
                        joined_spans(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark`` and ``n_chars`` counted anew where a text changes."""
    df, back = set_aside(docs, ("blob_id", "found", "parts", "clean"))
    df = scan(df)
    # walk the spans by start, keeping the pieces so far and the end of the last span; overlapping spans merge
    parts = F.aggregate("found", F.expr("named_struct('out', cast(array() as array<string>), 'end', 0L)"), lambda s, x: F.struct(
        F.when(x["start"] >= s["end"], F.concat(s["out"], F.array(
            F.substring(F.col("text"), (s["end"] + 1).cast("int"), (x["start"] - s["end"]).cast("int")), F.lit(mark))))
        .otherwise(s["out"]).alias("out"), F.greatest(s["end"], x["end"]).alias("end")))
    hit = F.size("found") > 0
    df = df.withColumn("parts", F.when(hit, parts))
    df = df.withColumn("clean", F.when(hit, F.concat(F.array_join("parts.out", ""), F.expr("substring(text, cast(parts.end as int) + 1)"))))
    new = {"text": F.when(hit, F.col("clean")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(hit, F.length("clean").cast(kind)).otherwise(F.col("n_chars"))
    return df.withColumns(new).select(*back)
