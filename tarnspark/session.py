"""Session factory, and the settings that guarded execution depends on, set and read back."""

from __future__ import annotations

from pyspark.sql import SparkSession

GUARDED = {
    "spark.sql.runSQLOnFiles": "false",  # no parquet.`/path` relations
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",  # "x" is a name, never a text
    "spark.sql.caseSensitive": "false",
    "spark.sql.session.timeZone": "UTC",
}


class SettingsError(RuntimeError):
    """Some protection could not be put in place; all of them are named."""


def build(app: str = "tarnspark", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def harden(spark: SparkSession) -> SparkSession:
    """A session of its own (views and settings apart) with every protection verified."""
    own = spark.newSession()
    wrong = []
    for key, value in GUARDED.items():
        try:
            own.conf.set(key, value)
        except Exception as e:  # noqa: BLE001
            wrong.append(f"{key}: {type(e).__name__}")
            continue
        if own.conf.get(key, None) != value:
            wrong.append(f"{key}: not in force")
    if wrong:
        raise SettingsError("; ".join(wrong))
    return own
