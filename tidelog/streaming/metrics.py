"""Metrics of streams and tables, in the text exposition format that scrapers read.

Values live on the driver: a series for each name and set of labels, never for each row or key.
"""

from __future__ import annotations

import os
import threading

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

OPS = {"i": "insert", "u": "update", "d": "delete", "t": "truncate"}


class Metrics:
    def __init__(self):
        self._values: dict[tuple, float] = {}
        self._kinds: dict[str, str] = {}
        self._lock = threading.Lock()

    def _put(self, kind: str, name: str, value: float, labels: dict, add: bool) -> None:
        with self._lock:
            if self._kinds.setdefault(name, kind) != kind:
                raise ValueError(f"{name} is a {self._kinds[name]}")
            key = name, tuple(sorted(labels.items()))
            self._values[key] = value + (self._values.get(key, 0) if add else 0)

    def count(self, name: str, by: float = 1, **labels: str) -> None:
        """Add to a counter."""
        if by < 0:
            raise ValueError("a counter never falls")
        self._put("counter", name, by, labels, True)

    def gauge(self, name: str, value: float, **labels: str) -> None:
        self._put("gauge", name, value, labels, False)

    def render(self) -> str:
        with self._lock:
            out, last = [], None
            for (name, labels), value in sorted(self._values.items()):
                if name != last:
                    out.append(f"# TYPE {name} {self._kinds[name]}")
                last = name
                inner = ",".join(f'{k}="{_escaped(v)}"' for k, v in labels)
                out.append(f"{name}{{{inner}}} {value:g}" if inner else f"{name} {value:g}")
            return "\n".join(out) + "\n"

    def write(self, path: str) -> None:
        """Replace a file on the driver's disk, for a collector of text files."""
        with open(f"{path}.draft", "w") as f:
            f.write(self.render())
        os.replace(f"{path}.draft", path)


def _escaped(value: str) -> str:
    return str(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


class StreamListener(StreamingQueryListener):
    """Feeds a stream's progress to metrics; register it with ``spark.streams.addListener``."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        self.metrics.count("stream_starts_total", stream=event.name or "")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.metrics.count("stream_batches_total", stream=p.name or "")
        self.metrics.count("stream_input_rows_total", p.numInputRows, stream=p.name or "")
        self.metrics.count("stream_batch_seconds_total", p.batchDuration / 1000, stream=p.name or "")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.metrics.count("stream_stops_total", stream="", failed=str(event.exception is not None).lower())


def observed(changes: DataFrame) -> tuple[DataFrame, Observation]:
    """Changes with a count of each operation, taken as they pass through whatever action reads them."""
    seen = Observation()
    return changes.observe(seen, *(F.count_if(F.col("_op") == op).alias(name) for op, name in OPS.items())), seen


def record(metrics: Metrics, table: str, seen: Observation) -> None:
    """Add what an observation counted, once its action is done."""
    for name, n in seen.get.items():
        metrics.count("changes_total", n, table=table, op=name)


def lags(metrics: Metrics, behind: DataFrame) -> None:
    """Set each table's lag; ``behind`` is what :func:`tidelog.operators.claim.lag` returns, a row for each table."""
    for r in behind.toLocalIterator():
        metrics.gauge("table_lag_bytes", r["lag"], table=r["table"])
