"""A table's folder: append-only log, mirror snapshots, and a chain of pointers that publishes them.

``log/batch=N`` holds raw changes and ``ledger/batch=N`` the files they came from; ``mirror/vN/b=K`` holds snapshots, by buckets of the key, so a step rewrites only the buckets it
touches; ``pointer/N.json`` is the state after step N: the buckets' folders, batches, watermarks, schema and epoch together.  A pointer is created only if its number
is free, so a step is all or nothing, two writers cannot both publish, and a replay after a crash finds its files in the ledger and does nothing.  Pointers name
batches and buckets, never files or rows.  All file access is Spark's and Hadoop's, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import lsn

#: Buckets of a mirror, fixed when it is first written.
BUCKETS = 8


class Conflict(RuntimeError):
    """Another writer published this step first, or the same was published before with other content."""


class TableStore:
    def __init__(self, spark: SparkSession, path: str, token: int = 0, buckets: int = BUCKETS):
        self.spark, self.path, self.token, self.buckets = spark, path.rstrip("/"), token, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, folder: str = "pointer") -> list[int]:
        p = self._path(f"{self.path}/{folder}")
        if not self._fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def state(self) -> dict:
        """The latest published state."""
        numbers = self._numbers()
        if not numbers:
            return {"step": 0, "epoch": 1, "schema_version": 1, "mirror": None, "buckets": self.buckets, "batches": [], "comments": {}, "raw_appended": lsn.ZERO, "transformed": lsn.ZERO}
        return self.load(f"pointer/{numbers[-1]:012d}.json")

    def load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, state: dict) -> dict:
        """Make ``state`` the next step; fails if another writer was faster."""
        if state["transformed"] > state["raw_appended"]:
            raise ValueError("transformed position beyond what was appended")
        if state.get("token", 0) > self.token:
            raise Conflict("a writer with a later lease has published")
        state = state | {"step": state["step"] + 1, "token": self.token}
        if not self.create(f"pointer/{state['step']:012d}.json", state):
            raise Conflict(f"step {state['step']} is already published")
        return state

    def create(self, name: str, value: dict) -> bool:
        """Write a small document if its name is free.

        It appears whole or not at all, and only one of several writers gets the name: on a local file system by a link, elsewhere by a rename that must not overwrite.
        """
        jvm = self.spark.sparkContext._jvm
        target = self._path(f"{self.path}/{name}")
        draft = self._path(f"{target.getParent().toString()}/.draft-{target.getName()}-{self.spark.sparkContext.applicationId}-{time.time_ns()}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        from py4j.protocol import Py4JJavaError

        try:
            if self._fs.getScheme() == "file":
                local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(local(target), local(draft))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, none)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            self._fs.delete(draft, False)
        return True

    def ledger(self) -> DataFrame | None:
        """(uri, fingerprint, position) of every file that has been appended."""
        paths = [b["ledger"] for b in self.state()["batches"]]
        return self.spark.read.json([f"{self.path}/{p}" for p in paths], schema="uri string, fingerprint string, position string") if paths else None

    def append(self, files: dict[str, DataFrame], position: str, fingerprints: dict[str, str] | None = None, groups: dict[str, str] | None = None) -> dict:
        """Append the rows of new files (uri to rows) to the log, as one step.  Files in the ledger are skipped.

        A file that is there with another fingerprint is an error, and so is a group (uri to name) of which a part is there: its files come together or not at all.
        """
        state, prints = self.state(), fingerprints or {}
        ledger = self.ledger()
        seen = {r["uri"]: r["fingerprint"] for r in ledger.where(F.col("uri").isin(list(files))).collect()} if ledger is not None else {}  # the files of this call at most
        if clash := [u for u, p in seen.items() if p is not None and prints.get(u) not in (None, p)]:
            raise Conflict(f"appended before with other content: {clash[:5]}")
        parts = {}
        for u, g in (groups or {}).items():
            parts.setdefault(g, set()).add(u in seen)
        if split := [g for g, p in parts.items() if len(p) > 1]:
            raise Conflict(f"groups of which a part was appended: {split[:5]}")
        new = {u: f for u, f in files.items() if u not in seen}
        if not new:
            return state
        name = f"batch={state['step'] + 1}"
        rows = None
        for f in new.values():
            rows = f if rows is None else rows.unionByName(f, allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{self.path}/log/{name}")
        self.spark.createDataFrame([(u, prints.get(u), position) for u in new], "uri string, fingerprint string, position string").coalesce(1).write.mode("overwrite").json(f"{self.path}/ledger/{name}")
        low, high = self.spark.read.parquet(f"{self.path}/log/{name}").selectExpr("min(_commit_lsn)", "max(_commit_lsn)").first()
        entry = {"path": f"log/{name}", "ledger": f"ledger/{name}", "low": low or lsn.ZERO, "high": high or lsn.ZERO}
        return self.publish(state | {"batches": [*state["batches"], entry], "raw_appended": max(state["raw_appended"], position)})

    def log(self, after: str | None = None) -> DataFrame | None:
        """Raw changes; only batches that reach the position are read."""
        batches = [b["path"] for b in self.state()["batches"] if b["path"] and (not after or b["high"] >= after)]
        if not batches:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/{b}" for b in batches))

    def mirror(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The mirror, or some of its buckets, with its columns' comments."""
        state = self.state()
        if state["mirror"] is None:
            return None
        chosen = [p for k, p in state["mirror"]["paths"].items() if buckets is None or int(k) in buckets]
        schema = state["mirror"]["schema"]
        from pyspark.sql import types as T

        kind = T.StructType.fromJson(schema)
        frame = self.spark.read.schema(kind).parquet(*(f"{self.path}/{p}" for p in chosen)) if chosen else self.spark.createDataFrame([], kind)
        for column, text in state.get("comments", {}).items():
            if column in frame.columns:
                frame = frame.withMetadata(column, {"comment": text})
        return frame

    def _bucket(self, keys: list[str], state: dict):
        return F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys)), F.lit(state["buckets"])).cast("int")

    def transform(self, keys: list[str]) -> dict:
        """Bring the mirror up to what has been appended, as one step.  Only buckets with changed keys are read and rewritten."""
        from tidelog.operators import reconcile

        state = self.state()
        tail = self.log(state["transformed"])
        if tail is None or state["raw_appended"] == state["transformed"]:
            return state
        tail = tail.where(F.col("_commit_lsn") >= state["transformed"])
        whole = self.mirror()
        fresh = whole is None
        whole = reconcile.empty_mirror(tail) if fresh else whole
        missing = {c: tail.schema[c].dataType for c in tail.columns if c not in whole.columns and c not in reconcile.META}
        wide = lambda m: m.select("*", *(F.lit(None).cast(t).alias(c) for c, t in missing.items()))
        wiped = tail.where("_op = 't'").limit(1).count() > 0
        # At most as many numbers as buckets.
        touched = None if fresh or wiped else sorted(r["b"] for r in tail.select(self._bucket(keys, state).alias("b")).distinct().collect())
        part = wide(whole if touched is None else self.mirror(touched))
        result = reconcile.apply_changes(part, tail, keys, state["transformed"], self.log(), wide(whole))
        return self._snapshot(state, result, state["raw_appended"], keys, touched)

    def _snapshot(self, state: dict, mirror: DataFrame, position: str, keys: list[str], touched: list[int] | None = None) -> dict:
        """Publish ``mirror`` as the next state of the touched buckets, or of all."""
        name = f"mirror/v{state['step'] + 1}"
        mirror.withColumn("b", self._bucket(keys, state)).write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/{name}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{name}"))]
        paths = {n[2:]: f"{name}/{n}" for n in made if n.startswith("b=")}
        if touched is not None:
            paths = {k: p for k, p in state["mirror"]["paths"].items() if int(k) not in touched} | paths
        return self.publish(state | {"mirror": {"paths": paths, "schema": json.loads(mirror.schema.json())}, "transformed": max(state["transformed"], position)})

    def comment(self, comments: dict[str, str | None]) -> dict:
        """Set columns' comments; None takes one off.  Readers see them with the mirror and its view."""
        state = self.state()
        now = {c: t for c, t in (state.get("comments", {}) | comments).items() if t is not None}
        return state if now == state.get("comments", {}) else self.publish(state | {"comments": now})

    def compact(self) -> dict:
        """Put the log's batches together into one, in order of positions.  The old folders stay until :meth:`clean`."""
        state = self.state()
        log, ledger = self.log(), self.ledger()
        if log is None or len(state["batches"]) < 2:
            return state
        name = f"batch={state['step'] + 1}"
        log.repartitionByRange("_commit_lsn").sortWithinPartitions("_commit_lsn", "_lsn").write.mode("overwrite").parquet(f"{self.path}/log/{name}")
        ledger.repartition(1).write.mode("overwrite").json(f"{self.path}/ledger/{name}")
        entry = {"path": f"log/{name}", "ledger": f"ledger/{name}", "low": min(b["low"] for b in state["batches"]), "high": max(b["high"] for b in state["batches"])}
        return self.publish(state | {"batches": [entry]})

    def rebuild(self, keys: list[str], lag: int = 1 << 24) -> dict:
        """The mirror anew from the retained log and itself; then whole batches before the retention floor are let go (their files stay known)."""
        from tidelog.operators import reconcile

        state = self.state()
        if state["mirror"] is None:
            return state
        log = self.log()
        mirror = self.mirror()
        result = reconcile.rebuild(log.where(F.col("_commit_lsn") <= state["transformed"]), mirror, keys) if log is not None else mirror
        state = self._snapshot(state, result, state["transformed"], keys)
        floor = f"{max(0, int(state['transformed'], 16) - lag):016X}"
        return self.publish(state | {"batches": [b if b["high"] >= floor else b | {"path": None} for b in state["batches"]]})

    def replace(self, baseline: DataFrame, fence: str, keys: list[str], changes: DataFrame | None = None) -> dict:
        """A reload: the baseline at the fence, changes after it, published in one step."""
        from tidelog.operators import reload

        state = self.state()
        mirror = reload.shadow(baseline, fence, changes, keys)
        return self._snapshot(state, mirror, max(fence, state["raw_appended"]), keys) if fence <= state["raw_appended"] else self._snapshot(state | {"raw_appended": fence}, mirror, fence, keys)

    def bump_epoch(self) -> dict:
        """A new generation: nothing of the old log, mirror or ledger counts any longer; :meth:`clean` deletes it."""
        state = self.state()
        return self.publish(state | {"epoch": state["epoch"] + 1, "mirror": None, "batches": [], "comments": {}, "raw_appended": lsn.ZERO, "transformed": lsn.ZERO})

    def clean(self, grace: float = 0.0) -> list[str]:
        """Delete folders that the latest state does not name and that are older than ``grace`` seconds, the longest time that a reader may take."""
        state, gone = self.state(), []
        named = {b[k] for b in state["batches"] for k in ("path", "ledger")} | ({p.rsplit("/", 1)[0] for p in state["mirror"]["paths"].values()} if state["mirror"] else set())
        for part in ("log", "ledger", "mirror"):
            p = self._path(f"{self.path}/{part}")
            for s in self._fs.listStatus(p) if self._fs.exists(p) else []:
                name = f"{part}/{s.getPath().getName()}"
                if name not in named and s.getModificationTime() / 1000 <= time.time() - grace:
                    self._fs.delete(s.getPath(), True)
                    gone.append(name)
        return gone

    def publish_view(self, name: str) -> None:
        """The readers' view: the mirror without its guard columns."""
        from tidelog.operators import reconcile

        reconcile.current(self.mirror()).createOrReplaceTempView(name)

