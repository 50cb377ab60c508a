"""Failures: which go away by themselves, what a file that is not what its manifest says leads to, and a process's exit code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.plans.evolution import Quarantine
from tidelog.plans.types import PlanError
from tidelog.sources.staging import IntegrityError
from tidelog.sources.store import Conflict

# Exit codes, one for each class.
EXIT = {"transient": 75, "conflict": 73, "integrity": 65, "quarantine": 78, "terminal": 70}
#: Names of errors that another try may mend.
PASSING = ("ConnectionError", "TimeoutError", "InterruptedError", "BrokenPipeError", "ConnectionResetError")


def classify(error: BaseException) -> str:
    """transient, conflict, integrity, quarantine or terminal."""
    for kind, name in ((Conflict, "conflict"), (IntegrityError, "integrity"), (Quarantine, "quarantine"), (PlanError, "quarantine")):
        if isinstance(error, kind):
            return name
    if isinstance(error, OSError) and not isinstance(error, FileNotFoundError | PermissionError) or type(error).__name__ in PASSING:
        return "transient"
    return "terminal"


def retries(error: BaseException) -> bool:
    """Another writer's step or a lost connection: read the state again, then go on."""
    return classify(error) in ("transient", "conflict")


def exit_code(error: BaseException) -> int:
    return EXIT[classify(error)]


@dataclass
class Repairs:
    """Files that fail their check: the table is read anew a bounded number of times, then it stops for a decision."""

    most: int = 3
    tries: dict[str, int] | None = None

    def failed(self, table: str) -> str:
        """resnapshot or quarantine."""
        self.tries = self.tries or {}
        self.tries[table] = self.tries.get(table, 0) + 1
        return "resnapshot" if self.tries[table] <= self.most else "quarantine"

    def done(self, table: str) -> None:
        if self.tries:
            self.tries.pop(table, None)


def verdict(failures: Column, most: int = 3) -> Column:
    """The same decision for a column of failure counts."""
    return F.when(failures == 0, "ok").when(failures <= most, "resnapshot").otherwise("quarantine")
