"""A Spark session with the settings that the ledger operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI errors instead of silent NULLs, "x" as an identifier, run-time re-planning, one time zone.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A damaged file must fail the query; skipping it would give wrong sums.
    "spark.sql.files.ignoreCorruptFiles": "false",
}


def build(master: str | None = None, **more: str) -> SparkSession:
    """A session with ``SETTINGS``; ``more`` adds to them, with ``_`` for ``.``."""
    builder = SparkSession.builder.appName("ledgerloom")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
