"""What can go wrong with a log, as exceptions and as the reasons in tables of rejected commands and rows."""

from __future__ import annotations

WRONG_POSITION = "wrong stream position"
UNSUPPORTED_KIND = "unsupported position kind"
BAD_JSON = "data is not JSON"
BAD_KEY = "could not parse key"


class LogError(Exception):
    """Any error of a log."""


class WrongStreamPosition(LogError):
    def __init__(self, stream: str, expected: int | None, got: int | None):
        super().__init__(f"{WRONG_POSITION} for {stream}: expected {expected}, got {got}")
        self.stream, self.expected, self.got = stream, expected, got


class SchemaVersionError(LogError):
    """A stored log was written by a newer version, or no migration leads from its version to this one."""


class DecodeError(LogError):
    """A row that a strict read can't decode."""


class CommitConflict(LogError):
    """Another writer committed first; read the log again and decide anew."""
