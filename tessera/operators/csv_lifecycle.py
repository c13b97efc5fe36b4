"""CSV-driven lifecycle of archives: create, append, pending rows, tombstones, and maintenance by policy.

A file that can't be read, or whose rows don't fit, raises before anything is written.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions.schema import Schema
from tessera.sources.archive import Archive
from tessera.sources.csv import CsvOptions, read_csv, read_row_ids

from . import maintenance
from .layout import BuildConfig
from .maintenance import Decision, Policy


def create(spark: SparkSession, root: str, path: str, schema: Schema | None = None, options: CsvOptions | None = None, clustered_by: list[str] | None = None, config: BuildConfig | None = None) -> Archive:
    """A new archive from a file, with its explicit or inferred schema."""
    df, schema = read_csv(spark, path, schema, options)
    return Archive.create(spark, root, df, schema, clustered_by, config)


def append(archive: Archive, path: str, options: CsvOptions | None = None) -> Archive:
    """The file's rows into the base, under the archive's schema and dictionaries."""
    df, _ = read_csv(archive.spark, path, archive.manifest.schema, options)
    return maintenance.append(archive, df)


def delta(archive: Archive, path: str, options: CsvOptions | None = None) -> Archive:
    """The file's rows as pending rows."""
    df, _ = read_csv(archive.spark, path, archive.manifest.schema, options)
    return archive.put_delta(df)


def tombstones(archive: Archive, path: str, options: CsvOptions) -> Archive:
    return archive.put_tombstones(read_row_ids(archive.spark, path, options))


def maintain(archive: Archive, policy: Policy, rows: str | None = None, removed: str | None = None, options: CsvOptions | None = None) -> tuple[Archive, Decision]:
    """Take in a file of rows and a file of row ids, if given, then do what the policy asks for."""
    options = options or CsvOptions()
    if rows is not None:
        archive = delta(archive, rows, options)
    if removed is not None:
        archive = tombstones(archive, removed, options)
    return maintenance.maintain(archive, policy)
