"""History of joins, warnings and runs per schema fingerprint.

Each merge is a fold: old and new rows are put together and grouped by key, so keys combine before the shuffle and
"first" and "last" are decided by ``seq`` (old rows come before all new ones).
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


JOIN_KEY = ["schema_hash", "left_table", "right_table", "on_column", "join_type"]
WARNING_KEY = ["schema_hash", "finding_type", "affected"]
SCHEMAS = {
    "joins": "schema_hash string, left_table string, right_table string, on_column string, join_type string, "
    "result_name string, row_count long, score double, created_at timestamp_ntz, last_seen_at timestamp_ntz",
    "warnings": "schema_hash string, finding_type string, affected string, reason string, severity string, "
    "times_seen long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz",
    "runs": "schema_hash string, total_runs long, last_run_at timestamp_ntz",
}


def _seen(now: datetime | None) -> Column:
    return F.col("last_seen_at") if now is None else F.lit(now).cast("timestamp_ntz")


def merge_joins(old: DataFrame, new: DataFrame, now: datetime | None = None) -> DataFrame:
    """Upsert join records: counts, score and last sight are updated, first sight and result name are kept.

    ``new`` has a ``seq`` column ordering its rows; with ``now`` its rows are seen at that time.
    """
    rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(
        new.withColumn("last_seen_at", _seen(now)).withColumn("seq", F.col("seq").cast("long"))
    )
    first = lambda c: F.min_by(c, "seq").alias(c)
    last = lambda c: F.max_by(c, "seq").alias(c)
    return rows.groupBy(*JOIN_KEY).agg(
        first("result_name"), last("row_count"), last("score"), first("created_at"), last("last_seen_at")
    )


def persistent_warnings(new: DataFrame) -> DataFrame:
    """Warnings, and blocks of reports that were approved all the same."""
    return new.where((F.col("severity") == "warn") | ((F.col("severity") == "block") & F.col("approved")))


def merge_warnings(old: DataFrame, new: DataFrame, now: datetime | None = None) -> DataFrame:
    """Upsert warnings: each incoming row counts once; reason, severity and first sight are kept.

    ``new`` has columns ``approved``, ``seq`` and ``last_seen_at`` (or ``now`` is given).
    """
    kept = persistent_warnings(new).withColumn("last_seen_at", _seen(now)).select(
        *WARNING_KEY, "reason", "severity", F.lit(1).cast("long").alias("times_seen"),
        F.col("last_seen_at").alias("first_seen_at"), "last_seen_at", F.col("seq").cast("long").alias("seq"),
    )
    rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(kept)
    first = lambda c: F.min_by(c, "seq").alias(c)
    return rows.groupBy(*WARNING_KEY).agg(
        first("reason"), first("severity"), F.sum("times_seen").alias("times_seen"), first("first_seen_at"),
        F.max_by("last_seen_at", "seq").alias("last_seen_at"),
    )


def bump_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """One more run for each row (schema_hash, last_run_at) of ``new``."""
    added = new.select("schema_hash", F.lit(1).cast("long").alias("total_runs"), "last_run_at")
    return old.unionByName(added).groupBy("schema_hash").agg(
        F.sum("total_runs").alias("total_runs"), F.max("last_run_at").alias("last_run_at")
    )


def prune_joins(joins: DataFrame, schema_hash: str, days: int = 365, now: datetime | None = None) -> DataFrame:
    """Drop a family's join records last seen more than ``days`` days ago."""
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    cutoff = F.lit(now - timedelta(days=days)).cast("timestamp_ntz")
    return joins.where(~((F.col("schema_hash") == schema_hash) & (F.col("last_seen_at") < cutoff)))


def load_history(tables: dict[str, DataFrame], schema_hash: str) -> dict[str, DataFrame]:
    """The rows of one family; a filter on the partition column, so other families are not read."""
    return {name: df.where(F.col("schema_hash") == schema_hash) for name, df in tables.items()}


def findings_to_warnings(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings with their report's family and verdict, in the form ``merge_warnings`` takes."""
    r = reports.select("report", "schema_hash", "approved")
    return findings.join(r, "report").select(
        "schema_hash", "finding_type", F.col("affected_insight").alias("affected"), "reason", "severity", "approved"
    )


def stamp_scores(joins: DataFrame, reports: DataFrame) -> DataFrame:
    """Give the join records of a run the score of its report."""
    s = reports.select("report", F.col("score").alias("_score"))
    return joins.join(s, "report", "left").withColumn("score", F.coalesce("_score", "score")).drop("_score")


def join_records(log: DataFrame, schema_hash: str, now: datetime | None = None) -> DataFrame:
    """New join records from the log of ``run_joins``."""
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    at = F.lit(now).cast("timestamp_ntz")
    return log.where("status = 'done'").select(
        F.lit(schema_hash).alias("schema_hash"), "left_table", "right_table", "on_column", "join_type", "result_name",
        F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"), F.lit(0.0).alias("score"),
        at.alias("created_at"), at.alias("last_seen_at"), F.col("step").cast("long").alias("seq"),
    )


#: Times a writer folds its run into a newer version after another writer came first.
ATTEMPTS = 8


class HistoryStore:
    """The three history tables as parquet below a folder, one folder per family of datasets.

    Commit protocol.  Every write attempt puts its tables into a folder of its own, ``attempt=<uuid>``, below the
    family's folder; nothing is ever written into a folder that a version names.  The attempt then creates the mark
    ``current-<v+1>`` (v: the version it read) with put-if-absent semantics and writes its folder's name into it; the
    version counts from then on.  If the mark exists, another writer came first: the loser deletes its folder, reads
    the version now in force, folds its run into that anew and tries the next number, up to ATTEMPTS times.  So both
    runs count and the loser's data never come into force.  A reader takes the highest mark and the folder it names.
    Marks and folders older than the one before the current are deleted (a reader may still be busy with that one).
    Put-if-absent is what the file system's create without overwrite gives: atomic on HDFS and local disks.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda p: path(p)
        self._fs = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entries(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return [str(s.getPath().getName()) for s in self._fs.listStatus(self._path(folder))]

    def _home(self, schema_hash: str) -> str:
        return f"{self.root}/families/schema_hash={schema_hash}"

    def version(self, schema_hash: str) -> int:
        """The version of a family in force; 0 if nothing was written yet."""
        marks = [e for e in self._entries(self._home(schema_hash)) if e.startswith("current-")]
        return max([int(m.split("-")[1]) for m in marks], default=0)

    def folder(self, schema_hash: str, v: int) -> str:
        """The folder that the mark of version v names."""
        stream = self._fs.open(self._path(f"{self._home(schema_hash)}/current-{v}"))
        try:
            name = str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).strip()
        finally:
            stream.close()
        return f"{self._home(schema_hash)}/{name or f'v={v}'}"

    def families(self) -> list[str]:
        return sorted(e.split("=", 1)[1] for e in self._entries(f"{self.root}/families") if e.startswith("schema_hash="))

    def _read(self, places: list[tuple[str, int]]) -> dict[str, DataFrame]:
        out = {}
        folders = [(h, self.folder(h, v)) for h, v in places]
        for name, schema in SCHEMAS.items():
            if not folders:
                out[name] = self.spark.createDataFrame([], schema)
                continue
            # The schema is given: a hash of digits only must not be read as a number.  The family comes from the
            # folder it was read from.
            parts = [
                self.spark.read.schema(schema).parquet(f"{f}/{name}").withColumn("schema_hash", F.lit(h)).select(*_names(schema))
                for h, f in folders
            ]
            out[name] = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts)
        return out

    def tables(self) -> dict[str, DataFrame]:
        """All families; empty tables if nothing was written yet."""
        return self._read([(h, v) for h in self.families() if (v := self.version(h))])

    def load(self, schema_hash: str, version: int | None = None) -> dict[str, DataFrame]:
        """One family, at the version in force or at the one given: only its own folder is read."""
        v = self.version(schema_hash) if version is None else version
        return load_history(self._read([(schema_hash, v)] if v else []), schema_hash)

    def persist(
        self, schema_hash: str, new_joins: DataFrame, new_warnings: DataFrame, now: datetime | None = None,
        read_version: int | None = None,
    ) -> int:
        """Fold a run of one family into the history and return the family's new version number.

        ``read_version`` is the version this writer read before it began (default: the one in force now); if another
        writer has committed since, the run is folded into the newer version instead."""
        now = now or datetime.now(timezone.utc).replace(tzinfo=None)
        run = self.spark.createDataFrame([(schema_hash, now)], "schema_hash string, last_run_at timestamp_ntz")
        mine = F.col("schema_hash") == schema_hash

        def fold(old: dict[str, DataFrame]) -> dict[str, DataFrame]:
            return {
                "joins": merge_joins(old["joins"], new_joins.where(mine), now),
                "warnings": merge_warnings(old["warnings"], new_warnings.where(mine), now),
                "runs": bump_runs(old["runs"], run),
            }

        return self._commit(schema_hash, fold, read_version)

    def prune(self, schema_hash: str, days: int = 365, now: datetime | None = None) -> int:
        """Drop a family's joins not seen for so long; returns how many."""
        before = self.load(schema_hash)["joins"].count()
        self._commit(schema_hash, lambda old: {**old, "joins": prune_joins(old["joins"], schema_hash, days, now)})
        return before - self.load(schema_hash)["joins"].count()

    def _commit(self, schema_hash: str, fold, read_version: int | None = None) -> int:
        home = self._home(schema_hash)
        seen = self.version(schema_hash) if read_version is None else read_version
        for _ in range(ATTEMPTS):
            tables = fold(self.load(schema_hash, seen))
            name = f"attempt={uuid.uuid4().hex}"
            for table, df in tables.items():
                # Rebalancing keeps a family in few files but splits one that is very large.
                df.drop("schema_hash").hint("rebalance").write.mode("errorifexists").parquet(f"{home}/{name}/{table}")
            try:
                mark = self._fs.create(self._path(f"{home}/current-{seen + 1}"), False)
            except Py4JJavaError:  # another writer made this version first
                self._fs.delete(self._path(f"{home}/{name}"), True)
                seen = self.version(schema_hash)
                continue
            mark.write(bytearray(name.encode()))
            mark.close()
            self._clean(schema_hash, seen + 1)
            return seen + 1
        raise RuntimeError(f"family {schema_hash}: {ATTEMPTS} other writers came first")

    def _clean(self, schema_hash: str, current: int) -> None:
        """Delete the marks of versions before the previous one and the folders they name.  Folders that no mark
        names are left alone: they may belong to a writer that is still at work."""
        home = self._home(schema_hash)
        for entry in self._entries(home):
            if entry.startswith("current-") and (v := int(entry.split("-")[1])) < current - 1:
                self._fs.delete(self._path(self.folder(schema_hash, v)), True)
                self._fs.delete(self._path(f"{home}/{entry}"), True)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
