"""Guarded execution: admit, run under a deadline, return at most so many rows with shortened cells."""

from __future__ import annotations

import math
import re
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from tarnspark.errors import StatementFailed, StatementRejected, StatementTimeout
from tarnspark.plans.guard import Guard, Policy, close_names, quoted_values
from tarnspark.plans.rewrite import Rewriter

DEFAULT_ROWS, DEFAULT_SECONDS = 50, 30.0
BULK_ROWS, BULK_SECONDS = 1_000_000, 3600.0
CELL = 1000


@dataclass(frozen=True)
class QueryResult:
    """Rows are tuples, so columns of one name stay apart."""

    columns: tuple[str, ...]
    rows: tuple[tuple, ...]
    truncated: bool
    max_rows: int
    elapsed_s: float
    truncated_cells: int = 0

    def records(self) -> list[dict]:
        return [dict(zip(self.columns, r)) for r in self.rows]


def check_rows(n: object) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= BULK_ROWS:
        raise ValueError(f"max_rows must be a whole number from 1 to {BULK_ROWS}")
    return n


def check_seconds(s: object) -> float:
    if isinstance(s, bool) or not isinstance(s, int | float) or not math.isfinite(s) or not 0 < s <= BULK_SECONDS:
        raise ValueError(f"timeout_s must be above 0 and at most {BULK_SECONDS:g}")
    return float(s)


def shorten(value: object, limit: int = CELL) -> tuple[object, bool]:
    if isinstance(value, bytes | bytearray):
        return f"<{len(value)} bytes>", False
    if isinstance(value, str) and len(value) > limit:
        return f"{value[:limit]}… [+{len(value) - limit} characters]", True
    return value, False


class Deadline:
    """Cancels a job group from its deadline on, again and again until the action returns.

    A single cancel that arrives before the job is submitted does nothing, hence the repetition.
    """

    def __init__(self, spark: SparkSession, seconds: float):
        self.sc, self.group, self.seconds = spark.sparkContext, f"guarded-{uuid.uuid4().hex}", seconds
        self.fired, self._done = False, threading.Event()

    def __enter__(self) -> Deadline:
        self.sc.setJobGroup(self.group, "guarded statement", True)
        threading.Thread(target=self._watch, daemon=True).start()
        return self

    def _watch(self) -> None:
        if not self._done.wait(self.seconds):
            self.fired = True
            while not self._done.wait(0.2):
                self.sc.cancelJobGroup(self.group)

    def __exit__(self, *_: object) -> None:
        self._done.set()
        self.sc.setLocalProperty("spark.jobGroup.id", None)


class SafeExecutor:
    """Statements over the views of one session, one at a time."""

    def __init__(self, spark: SparkSession, policy: Policy = Policy(), max_rows: int = DEFAULT_ROWS, timeout_s: float = DEFAULT_SECONDS):
        self.spark, self.guard, self.rewriter = spark, Guard(spark, policy), Rewriter(spark)
        self.max_rows, self.timeout_s = check_rows(max_rows), check_seconds(timeout_s)
        self._lock = threading.Lock()

    def frame(self, sql: str) -> DataFrame:
        """The admitted statement as a DataFrame: the way to read in bulk without collecting."""
        plan, body = self.guard.admit(sql)
        try:
            meant = self.rewriter.rewrite(plan, body)
            return DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, meant), self.spark)
        except AnalysisException as e:
            raise self.translated(e, sql) from None

    def execute(self, sql: str, max_rows: int | None = None, timeout_s: float | None = None) -> QueryResult:
        rows = self.max_rows if max_rows is None else check_rows(max_rows)
        seconds = self.timeout_s if timeout_s is None else check_seconds(timeout_s)
        with self._lock, Deadline(self.spark, seconds) as deadline:
            began = time.monotonic()
            try:
                df = self.frame(sql)
                taken = df.take(rows + 1)  # runs only as many partitions as it needs
            except (StatementRejected, StatementFailed):
                raise
            except Exception as e:
                if deadline.fired:
                    raise StatementTimeout(f"stopped after {seconds:g} s", "read less: filter, aggregate, or join fewer rows") from None
                if isinstance(e, PySparkException):
                    raise self.translated(e, sql) from None
                if type(e).__name__ == "Py4JJavaError":
                    raise StatementFailed("the engine failed: " + str(e.java_exception.getMessage())[:300]) from None
                raise
            elapsed = time.monotonic() - began
        cells = 0
        out = []
        for r in taken[:rows]:
            pairs = [shorten(v) for v in r]
            cells += sum(cut for _, cut in pairs)
            out.append(tuple(v for v, _ in pairs))
        return QueryResult(tuple(df.columns), tuple(out), len(taken) > rows, rows, elapsed, cells)

    def translated(self, e: PySparkException, sql: str) -> StatementFailed:
        """The engine's error with what to do about it."""
        kind = (e.getCondition() or "").split(".")[0]
        args = e.getMessageParameters() or {}
        named = re.sub("`", "", str(args.get("objectName") or args.get("relationName") or args.get("routineName") or ""))
        if quoted := quoted_values(sql):
            return StatementFailed(f"column not found: {', '.join(quoted[:3])}", "texts stand in single quotes; double quotes are for names")
        if kind == "TABLE_OR_VIEW_NOT_FOUND":
            return StatementFailed(f"no table {named}", close_names(named, self.guard.policy.tables))
        if kind == "UNRESOLVED_COLUMN":
            return StatementFailed(f"no column {named}", f"near: {args.get('proposal')}" if args.get("proposal") else "")
        if kind == "AMBIGUOUS_REFERENCE":
            return StatementFailed(f"{args.get('name')} is ambiguous", "put the table's name before the column's")
        if kind == "UNRESOLVED_ROUTINE":
            return StatementFailed(f"no function {named}", close_names(named.lower(), self.guard.policy.functions))
        return StatementFailed(str(e).split("\n")[0][:300])
