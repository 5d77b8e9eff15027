"""Errors of guarded execution: a message, a hint, and whether another statement may help."""

from __future__ import annotations


class GuardedError(Exception):
    recoverable = True

    def __init__(self, message: str, hint: str = ""):
        super().__init__(message)
        self.message, self.hint = message, hint


class StatementRejected(GuardedError):
    """Refused before anything ran."""


class StatementFailed(GuardedError):
    """Admitted, but the engine could not run it."""


class StatementTimeout(GuardedError):
    """Stopped at its deadline; the session stays usable."""


class SourceUnavailable(GuardedError):
    """The tables cannot be read; no statement will help."""

    recoverable = False
