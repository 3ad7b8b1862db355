"""Errors with a code, a message and a hint."""

from __future__ import annotations


class LibraryError(Exception):
    code = "error"

    def __init__(self, message: str, hint: str = "") -> None:
        super().__init__(message + (f"; {hint}" if hint else ""))
        self.message, self.hint = message, hint

    def as_dict(self) -> dict[str, str]:
        return {"code": self.code, "message": self.message, "hint": self.hint}


class NotFound(LibraryError, LookupError):
    """What was asked for is not in the library."""

    code = "not_found"

    def __init__(self, what: str, hint: str = "") -> None:
        super().__init__(f"{what} not found", hint)


class Unreadable(LibraryError):
    """A stored file that can't be read."""

    code = "unreadable"


class Locked(LibraryError):
    """Another writer has the library."""

    code = "locked"


class BadRequest(LibraryError, ValueError):
    code = "bad_request"


class CoverageError(LibraryError):
    """An extraction that lost too much."""

    code = "coverage"


class UnsafeUrl(LibraryError):
    code = "unsafe_url"
