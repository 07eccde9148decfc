"""Errors of the write side: a kind, a status and the operation that failed."""

from __future__ import annotations

KINDS = {  # fixed values: kind -> (shown text, is it worth another try)
    "not_found": ("Not found", False),
    "invalid_input": ("Invalid Input", False),
    "conflict": ("Conflict", True),
    "internal": ("Internal server error", False),
    "business_rule": ("Business rule violation", False),
    "unauthorized": ("Unauthorized", False),
    "forbidden": ("Forbidden", False),
    "unavailable": ("Unavailable", True),
    "rate_limited": ("Rate limited", True),
}


class LogError(Exception):
    """`detail` is always kept; what is shown of an internal error is only its kind."""

    def __init__(self, kind: str, detail: str = "", operation: str | None = None, **context: object) -> None:
        self.kind, self.detail, self.operation, self.context = kind, detail, operation, dict(context)
        self.shown, self.temporary = KINDS[kind]
        super().__init__(str(self))

    def __str__(self) -> str:
        return self.shown if self.kind == "internal" or not self.detail else f"{self.shown}: {self.detail}"

    def within(self, operation: str, **context: object) -> LogError:
        """The same error, told of an operation around it."""
        return LogError(self.kind, self.detail, operation, **(self.context | context))


def conflict(stream_id: str, expected: int, found: int) -> LogError:
    return LogError("conflict", "Stream version mismatch", "append", stream_id=stream_id, expected=expected, found=found)
