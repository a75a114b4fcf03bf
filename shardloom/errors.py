"""Errors of the engine, each with a canonical code, and what clients of an engine expect for it."""

from __future__ import annotations


class EngineError(Exception):
    """Any refusal or failure of the engine."""

    code = "UNKNOWN"

    @property
    def retryable(self) -> bool:
        """Whether the statement surely had no effect and may be sent again."""
        return self.code in RETRYABLE

    def native(self, dialect: str = "mysql") -> tuple[int, str]:
        """Number and SQLSTATE of this error for clients of a dialect."""
        from .dialect.ddl import DIALECTS

        known = NATIVE.get(DIALECTS[dialect].name if dialect in DIALECTS else dialect, NATIVE["mysql"])
        return known.get(self.code, known["UNKNOWN"])


class Unsupported(EngineError):
    """A statement the engine refuses."""

    code = "UNSUPPORTED"


class NotFound(EngineError):
    """A keyspace, table or shard that does not exist."""

    code = "NOT_FOUND"


class Invalid(EngineError):
    """A wrong declaration or argument."""

    code = "INVALID_ARGUMENT"


class AlreadyExists(Invalid):
    """A key, table or name that is there already."""

    code = "ALREADY_EXISTS"


class FailedPrecondition(Invalid):
    """What must go or come first."""

    code = "FAILED_PRECONDITION"


class TransactionError(EngineError):
    """A transaction that cannot go on."""

    code = "FAILED_PRECONDITION"


class Conflict(TransactionError):
    """Another transaction was first; this one had no effect."""

    code = "ABORTED"


#: Codes after which a client may try again.
RETRYABLE = ("UNAVAILABLE", "ABORTED", "RESOURCE_EXHAUSTED")

#: Each engine's number and SQLSTATE by canonical code; UNKNOWN stands for all others.
NATIVE = {
    "mysql": {
        "INVALID_ARGUMENT": (1064, "42000"),
        "NOT_FOUND": (1146, "42S02"),
        "ALREADY_EXISTS": (1062, "23000"),
        "PERMISSION_DENIED": (1045, "28000"),
        "UNAUTHENTICATED": (1045, "28000"),
        "RESOURCE_EXHAUSTED": (1040, "08004"),
        "DEADLINE_EXCEEDED": (1317, "70100"),
        "CANCELED": (1317, "70100"),
        "ABORTED": (1213, "40001"),
        "UNAVAILABLE": (2003, "HY000"),
        "UNIMPLEMENTED": (1235, "42000"),
        "UNSUPPORTED": (1235, "42000"),
        "UNKNOWN": (1105, "HY000"),
    },
    "postgres": {
        "INVALID_ARGUMENT": (0, "42601"),
        "NOT_FOUND": (0, "42P01"),
        "ALREADY_EXISTS": (0, "23505"),
        "PERMISSION_DENIED": (0, "42501"),
        "UNAUTHENTICATED": (0, "28000"),
        "RESOURCE_EXHAUSTED": (0, "53300"),
        "DEADLINE_EXCEEDED": (0, "57014"),
        "CANCELED": (0, "57014"),
        "ABORTED": (0, "40001"),
        "UNAVAILABLE": (0, "08006"),
        "UNIMPLEMENTED": (0, "0A000"),
        "UNSUPPORTED": (0, "0A000"),
        "FAILED_PRECONDITION": (0, "55000"),
        "UNKNOWN": (0, "XX000"),
    },
    "mssql": {
        "INVALID_ARGUMENT": (102, "42000"),
        "NOT_FOUND": (208, "42S02"),
        "ALREADY_EXISTS": (2627, "23000"),
        "PERMISSION_DENIED": (229, "42000"),
        "UNAUTHENTICATED": (18456, "28000"),
        "RESOURCE_EXHAUSTED": (10928, "53000"),
        "DEADLINE_EXCEEDED": (1222, "HY008"),
        "CANCELED": (1222, "HY008"),
        "ABORTED": (1205, "40001"),
        "UNAVAILABLE": (10054, "08S01"),
        "UNIMPLEMENTED": (40515, "0A000"),
        "UNSUPPORTED": (40515, "0A000"),
        "UNKNOWN": (50000, "42000"),
    },
    "sqlite": {
        "INVALID_ARGUMENT": (1, "HY000"),
        "PERMISSION_DENIED": (3, "HY000"),
        "ABORTED": (4, "HY000"),
        "RESOURCE_EXHAUSTED": (5, "HY000"),
        "DEADLINE_EXCEEDED": (9, "HY000"),
        "NOT_FOUND": (12, "HY000"),
        "ALREADY_EXISTS": (19, "HY000"),
        "UNIMPLEMENTED": (23, "HY000"),
        "UNSUPPORTED": (23, "HY000"),
        "UNKNOWN": (1, "HY000"),
    },
}
