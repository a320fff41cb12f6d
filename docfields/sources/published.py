"""Published tables: every run is written to an attempt folder of its own, and a manifest says which ones count.

Layout below a table's path:

* ``_data/attempt=<id>/doc_type=<type>/*.parquet``: the rows of one attempt, with ``run_id`` and ``epoch`` inside;
* ``_counts/attempt=<id>/*.parquet``: beside them, per (run, epoch, field) the rows and the failures of that attempt;
* ``_manifest/<version>.json``: which attempt holds each (run, epoch); the newest complete version is the table.

A writer first writes its attempt and its counters; only then does it publish a new manifest version, created
with "fail if it exists", so two writers never take the same version (the loser reads the winner's and tries the
next one). A version file ends with a completion mark; a reader takes the newest version that has it. So a reader
sees, for every run, either the old attempt or the new one, never a half-written run, and a broken rerun (a failed
job, a lost driver) leaves the table as it was. Attempts that no recent version names are removed by ``vacuum``;
``compact`` rewrites the small attempts of many epochs into one and publishes that, which changes no row.

Rankings read the counters only (``top_failures``): one small row per field and epoch, merged on read.

The file system must create files exclusively (HDFS, local disks, and object stores with conditional writes do).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfields import rules, schemas
from docfields.operators.records import stamp

MANIFEST, DATA, COUNTS = "_manifest", "_data", "_counts"
END = "end"
# Versions whose attempts ``vacuum`` keeps, so that readers of a recent version can finish.
KEEP_VERSIONS = 10
COMMIT_TRIES = 100
# Rows that one task of ``compact`` writes.
FILE_ROWS = 1_000_000

ROWS = T.StructType([*schemas.EXTRACTIONS.fields, T.StructField("run_id", T.StringType()), T.StructField("epoch", T.LongType())])
COUNTERS = "run_id string, epoch long, field_name string, n_rows long, failures long"


def _jvm(spark: SparkSession):
    return spark.sparkContext._jvm


def _fs(spark: SparkSession, path: str):
    hadoop = _jvm(spark).org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _version_name(version: int) -> str:
    return f"{version:020d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifest versions that exist, complete or not, ascending."""
    fs, folder = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())


def _read_version(spark: SparkSession, path: str, version: int) -> dict | None:
    fs, file = _fs(spark, f"{path}/{MANIFEST}/{_version_name(version)}")
    stream = fs.open(file)
    try:
        reader = _jvm(spark).java.io.BufferedReader(_jvm(spark).java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        while (line := reader.readLine()) is not None:
            lines.append(line)
    finally:
        stream.close()
    try:
        found = json.loads("\n".join(lines))
    except json.JSONDecodeError:
        return None
    return found if isinstance(found, dict) and found.get(END) is True else None


def manifest(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """The newest complete version and its entries (run_id, epoch, attempt); (0, []) for a table never published."""
    for version in reversed(versions(spark, path)):
        found = _read_version(spark, path, version)
        if found is not None:
            return version, found["entries"]
    return 0, []


def _commit(spark: SparkSession, path: str, change) -> int:
    """Publishes ``change(entries)`` as the next version; retries on a version that another writer took."""
    for _ in range(COMMIT_TRIES):
        existing = versions(spark, path)
        base, entries = manifest(spark, path)
        version = (existing[-1] if existing else 0) + 1
        body = json.dumps({"version": version, "base": base, "entries": change(entries), END: True}, sort_keys=True)
        fs, file = _fs(spark, f"{path}/{MANIFEST}/{_version_name(version)}")
        try:
            out = fs.create(file, False)
        except Exception as error:  # another writer created this version first
            if "FileAlreadyExistsException" in str(error) or fs.exists(file):
                continue
            raise
        try:
            out.write(bytearray(body.encode("utf-8")))
        finally:
            out.close()
        return version
    raise RuntimeError(f"no manifest version of {path} could be taken in {COMMIT_TRIES} tries")


def _replace(entries: list[dict], new: Iterable[dict]) -> list[dict]:
    new = list(new)
    taken = {(e["run_id"], e["epoch"]) for e in new}
    return sorted([e for e in entries if (e["run_id"], e["epoch"]) not in taken] + new, key=lambda e: (e["run_id"], e["epoch"]))


def _write_attempt(rows: DataFrame, path: str) -> str:
    """Writes rows (with run_id and epoch) and their counters under a new attempt; returns the attempt's id."""
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    rows.write.partitionBy("doc_type").parquet(f"{path}/{DATA}/attempt={attempt}")
    written = spark.read.schema(ROWS).parquet(f"{path}/{DATA}/attempt={attempt}")
    counters = written.groupBy("run_id", "epoch", "field_name").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("valid")).alias("failures")
    )
    counters.coalesce(1).write.parquet(f"{path}/{COUNTS}/attempt={attempt}")
    return attempt


def publish(rows: DataFrame, path: str, run_id: str, epoch: int = 0) -> int:
    """Stores the field rows of one run (or one epoch of a stream) and makes them visible at once.

    A rerun of the same (run, epoch) replaces the earlier rows in the same step; a failure before the step changes
    nothing that readers see. Returns the published version.
    """
    framed = stamp(rows).select("*", F.lit(run_id).alias("run_id"), F.lit(epoch).cast("long").alias("epoch"))
    attempt = _write_attempt(framed, path)
    entry = {"run_id": run_id, "epoch": int(epoch), "attempt": attempt, "held": 1}
    return _commit(rows.sparkSession, path, lambda entries: _replace(entries, [entry]))


def _published(spark: SparkSession, path: str, kind: str, schema, entries: list[dict]) -> DataFrame:
    attempts = sorted({e["attempt"] for e in entries})
    with_attempt = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
    found = spark.read.option("basePath", f"{path}/{kind}").schema(with_attempt).parquet(
        *[f"{path}/{kind}/attempt={a}" for a in attempts]
    )
    # Only the (run, epoch) that the manifest gives to an attempt count: a compacted attempt may hold epochs that a
    # rerun replaced since. Attempts that still own all they hold need no filter, so scans stay pruned.
    named: dict[str, int] = {}
    for e in entries:
        named[e["attempt"]] = named.get(e["attempt"], 0) + 1
    partial = sorted(a for a in named if any(named[a] < e.get("held", 1) for e in entries if e["attempt"] == a))
    if not partial:
        return found
    keys = [f'{e["attempt"]}/{e["run_id"]}/{e["epoch"]}' for e in entries if e["attempt"] in partial]
    owned = F.concat_ws("/", "attempt", "run_id", F.col("epoch").cast("string")).isin(keys)
    return found.filter(~F.col("attempt").isin(partial) | owned)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows of the newest complete version, with run_id and epoch; empty before the first one."""
    _, entries = manifest(spark, path)
    if not entries:
        return spark.createDataFrame([], ROWS)
    return _published(spark, path, DATA, ROWS, entries).select(*ROWS.names)


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    _, entries = manifest(spark, path)
    schema = T._parse_datatype_string(COUNTERS)
    if not entries:
        return spark.createDataFrame([], schema)
    return _published(spark, path, COUNTS, schema, entries).select(*schema.names)


def top_failures(spark: SparkSession, path: str, limit: int = rules.TOP_FAILURES_LIMIT) -> DataFrame:
    """The fields that fail most often over all published rows, from the counters alone; ties go by name."""
    return (
        read_counters(spark, path).groupBy(F.col("field_name").alias("field")).agg(F.sum("failures").alias("failures"))
        .filter("failures > 0").orderBy(F.desc("failures"), "field").limit(limit)
    )


def compact(spark: SparkSession, path: str, run_id: str, files: int = 1) -> int | None:
    """Rewrites all published epochs of a run into one attempt of about ``files`` files per type and publishes it.

    A run of very many rows gets more files, each task writing about ``FILE_ROWS`` rows, and no row is shuffled. Rows and counters stay the same; readers see the old attempts or the new one. None if the run has no epochs.
    """
    _, entries = manifest(spark, path)
    chosen = [e for e in entries if e["run_id"] == run_id]
    if not chosen:
        return None
    rows = _published(spark, path, DATA, ROWS, chosen).select(*ROWS.names)
    counted = _published(spark, path, COUNTS, T._parse_datatype_string(COUNTERS), chosen).agg(F.sum("n_rows")).first()[0] or 0
    attempt = _write_attempt(rows.coalesce(max(files, -(-counted // FILE_ROWS))), path)
    moved = {(e["run_id"], e["epoch"]) for e in chosen}

    def change(latest: list[dict]) -> list[dict]:
        # Epochs republished meanwhile keep their newer attempt.
        still = {(e["run_id"], e["epoch"]) for e in latest if (e["run_id"], e["epoch"]) in moved and e in chosen}
        return _replace(latest, [{"run_id": r, "epoch": p, "attempt": attempt, "held": len(moved)} for r, p in sorted(still)])

    return _commit(spark, path, change)


def vacuum(spark: SparkSession, path: str, keep: int = KEEP_VERSIONS) -> list[str]:
    """Removes attempts that none of the newest ``keep`` complete versions names, and older manifest files.

    Returns the removed attempts. Attempts younger than the newest version (a writer still at work) are kept too,
    because they are not older than any listed one: only attempts that an older version named are removed.
    """
    numbers = versions(spark, path)
    complete = [(v, m) for v in numbers if (m := _read_version(spark, path, v)) is not None]
    if len(complete) <= keep:
        return []
    recent, old = complete[-keep:], complete[:-keep]
    live = {e["attempt"] for _, m in recent for e in m["entries"]}
    gone = sorted({e["attempt"] for _, m in old for e in m["entries"]} - live)
    for attempt in gone:
        for kind in (DATA, COUNTS):
            fs, folder = _fs(spark, f"{path}/{kind}/attempt={attempt}")
            fs.delete(folder, True)
    for version, _ in old:
        fs, file = _fs(spark, f"{path}/{MANIFEST}/{_version_name(version)}")
        fs.delete(file, False)
    return gone
