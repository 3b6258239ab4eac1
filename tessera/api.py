"""A record database over the change log: DB, its agents (branches), workspaces and the search facade.

Writes are buffered and appended to the log as one file commit; reads see the buffer over the log. Each
read is a DataFrame plan collected at the end, so batch reads (``get_many``, ``scan``) are what to use.
"""

from __future__ import annotations

import json
import threading
import time
import weakref
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import fuzzy, graph, keyword, namespaces, sessions, state, transactions, vector, versions
from .plans import planner
from .sources import log as logs
from .streaming import watch as watching

FLUSH_ROWS = 50_000
#: Keys whose values ``DB.get`` keeps.
CACHED = 10_000


@dataclass
class Document:
    id: str
    raw: str = ""
    score: float = 0.0
    metadata: dict[str, str] = field(default_factory=dict)
    vector: list[float] | None = None

    @property
    def content(self) -> str:
        return self.raw

    def __str__(self) -> str:
        return self.raw

    def __len__(self) -> int:
        return len(self.raw)

    def __bool__(self) -> bool:
        return bool(self.raw)


def _documents(hits: DataFrame) -> list[Document]:
    return [Document(r["key"], r["value"] or "", float(r["score"])) for r in hits.orderBy("rank").collect()]


class DB:
    """The records of a folder. The log holds what is flushed; a compaction moves it to a base folder that a
    pointer names, so that a failed one changes nothing and watches see only new records. Postings are
    written with the records, and searches read them and not the text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._pending: list[tuple] = []
        self._edges: list[tuple[str, str, str]] = []
        self._vectors: dict[str, tuple[list[float], int]] = {}
        self._closed = False
        self._cache: OrderedDict[str, str | None] = OrderedDict()
        self._log_path = f"{self.path}/log"
        self._open_bases: weakref.WeakSet = weakref.WeakSet()
        base = self._newest("base")
        self._base, self._upto, self._postings_path = (base["folder"], base["upto"], base["postings"]) if base else ("", 0, f"{self.path}/postings")
        refs = self._lines("refs")
        self._refs: dict[str, int] = {}
        for r in sorted(refs, key=lambda r: r["made"]):
            self._refs[r["name"]] = r["seq"]
        self._refs = {n: q for n, q in self._refs.items() if q >= 0}
        self._seq = max(self._upto, self._greatest(self._log_path), self._greatest(f"{self.path}/vectors"))
        indexed = self._greatest(self._postings_path)
        if self._has_log() and self._stored().where(F.col("seq") > indexed).where("op = 'put'").limit(1).count():
            self._index(self._stored().where(F.col("seq") > indexed))  # a failure came between a record and its postings

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _greatest(self, path: str) -> int:
        return (self.spark.read.parquet(path).agg(F.max("seq")).first()[0] or 0) if self._exists(path) else 0

    # small facts, a line of JSON each; the last of a kind counts
    def _lines(self, kind: str) -> list[dict]:
        path = f"{self.path}/{kind}"
        return [json.loads(r["value"]) for r in self.spark.read.text(path).collect()] if self._exists(path) else []

    def _newest(self, kind: str) -> dict | None:
        return max(self._lines(kind), key=lambda r: r["made"], default=None)

    def _note(self, kind: str, **facts) -> None:
        line = self.spark.createDataFrame([(json.dumps({**facts, "made": time.time_ns()}),)], "value string")
        line.write.mode("append").text(f"{self.path}/{kind}")

    def _has_log(self) -> bool:
        return bool(self._base) or self._exists(self._log_path)

    def _stored(self) -> DataFrame:
        """Flushed records of all namespaces. What a compaction has taken over is not read from the log again."""
        parts = []
        if self._exists(self._log_path):
            parts.append(logs.read(self.spark, self._log_path).where(F.col("seq") > self._upto))
        if self._base:
            parts.append(logs.read(self.spark, self._base))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def all_records(self) -> DataFrame:
        """The log of all namespaces."""
        pending = self.spark.createDataFrame(self._pending, logs.SCHEMA)
        return self._stored().unionByName(pending) if self._has_log() else pending

    def log(self, namespace: str = "") -> DataFrame:
        """Everything written so far in a namespace."""
        return self.all_records().where(F.col("namespace") == namespace)

    def state(self, namespace: str = "") -> DataFrame:
        return state.live(self.log(namespace))

    def postings(self, namespace: str = "") -> DataFrame:
        """Postings of what is there: those stored and those of the buffer."""
        new = [r for r in self._pending if r[0] == namespace and r[3] == "put"]
        found = None
        if self._exists(self._postings_path):
            found = self.spark.read.parquet(self._postings_path).where(F.col("namespace") == namespace).drop("namespace")
        if new or found is None:
            fresh = keyword.index(self.spark.createDataFrame(new, logs.SCHEMA), "seq")
            found = fresh if found is None else found.unionByName(fresh)
        return found.join(state.heads(self.log(namespace)), ["key", "seq"], "left_semi")

    def _index(self, records: DataFrame) -> None:
        keyword.store(keyword.index(records.where("op = 'put'"), "namespace", "seq"), self._postings_path)

    def _write(self, rows: list[tuple[str, str | None, str]], namespace: str = "") -> None:
        for key, value, op in rows:
            self._seq += 1
            self._pending.append((namespace, key, value, op, self._seq))
            if not namespace and key in self._cache:
                self._cache[key] = value if op == "put" else None
        if len(self._pending) >= FLUSH_ROWS:
            self.flush()

    def _write_table(self, rows: DataFrame, namespace: str = "") -> int:
        """Appends a table (key, value, op) of any size to the log; of rows with one key the last wins. Returns the number of rows."""
        self.flush()
        self._cache.clear()
        before = self._seq
        numbered = rows.select("key", "value", "op", (F.monotonically_increasing_id() + F.lit(before + 1)).alias("seq"))
        logs.append(numbered.select(F.lit(namespace).alias("namespace"), "key", "value", "op", "seq"), self._log_path)
        new = logs.read(self.spark, self._log_path).where(F.col("seq") > before)
        told = new.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq")).first()
        if told["n"]:
            self._seq = told["seq"]
            self._index(new)
        return told["n"]

    def flush(self) -> None:
        if self._pending:
            rows = self.spark.createDataFrame(self._pending, logs.SCHEMA)
            logs.append(rows, self._log_path)
            self._index(rows)
            self._pending = []
        if self._edges:
            self.spark.createDataFrame(self._edges, "src string, dst string, relation string").write.mode("append").parquet(f"{self.path}/edges")
            self._edges = []
        if self._vectors:
            rows = [(k, v, seq) for k, (v, seq) in self._vectors.items()]
            self.spark.createDataFrame(rows, "key string, vector array<double>, seq long").write.mode("append").parquet(f"{self.path}/vectors")
            self._vectors = {}

    # records
    def put(self, key: str, value: str) -> None:
        self._write([(key, value, "put")])

    def load(self, pairs) -> int:
        rows = [(k, v, "put") for k, v in (pairs.items() if isinstance(pairs, dict) else pairs)]
        self._write(rows)
        return len(rows)

    put_batch = load

    def load_table(self, table: DataFrame) -> None:
        """Records from a DataFrame (key, value), however large, as one append to the log. Of rows with one key
        the last in the order of the table wins."""
        self._write_table(table.select("key", "value", F.lit("put").alias("op")))

    def get(self, key: str) -> str | None:
        """The value, or None. Values of recent keys are kept; a database has one writer, which keeps them right."""
        if key in self._cache:
            self._cache.move_to_end(key)
            return self._cache[key]
        row = state.get(self.state(), key).first()
        self._cache[key] = row["value"] if row else None
        if len(self._cache) > CACHED:
            self._cache.popitem(last=False)
        return self._cache[key]

    def get_profiled(self, key: str) -> tuple[str | None, dict[str, float]]:
        """The value, and seconds of making the plan and of running it, without the kept values."""
        began = time.perf_counter()
        rows = state.get(self.state(), key)
        planned = time.perf_counter()
        row = rows.first()
        return (row["value"] if row else None), {"plan": planned - began, "run": time.perf_counter() - planned}

    def put_profiled(self, key: str, value: str) -> dict[str, float]:
        """Writes through to the log: seconds of the buffer, and of the log with its postings."""
        began = time.perf_counter()
        self.put(key, value)
        buffered = time.perf_counter()
        self.flush()
        return {"buffer": buffered - began, "log": time.perf_counter() - buffered}

    def get_many(self, keys: list[str]) -> list[str]:
        wanted = self.spark.createDataFrame(list(enumerate(keys)), "pos long, key string")
        return [r["value"] for r in state.get_batch(self.state(), wanted).orderBy("pos").collect()]

    def delete(self, key: str) -> None:
        self._write([(key, None, "del")])

    def delete_range(self, start: str, end: str) -> int:
        return self._write_table(state.tombstones(self.state(), start, end, 0))

    def scan(self, prefix: str = "", limit: int = 100) -> list[tuple[str, str]]:
        return [tuple(r) for r in state.scan_prefix(self.state(), prefix, limit).collect()]

    def scan_range(self, start: str, end: str, limit: int | None = None) -> list[tuple[str, str]]:
        return [tuple(r) for r in state.scan(self.state(), start, end, limit).collect()]

    def keys(self, prefix: str = "", limit: int = 10_000) -> list[str]:
        return [r["key"] for r in state.keys(self.state(), prefix, limit).collect()]

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def __len__(self) -> int:
        return self.state().count()

    # indexes
    def index(self, key: str, vector_: list[float]) -> None:
        self._seq += 1
        self._vectors[key] = ([float(x) for x in vector_], self._seq)

    def add_edge(self, src: str, relation: str, dst: str) -> None:
        if relation in graph.RELATIONS:
            self._edges.append((src, dst, relation))

    def edges(self) -> DataFrame:
        new = self.spark.createDataFrame(self._edges, "src string, dst string, relation string")
        return self.spark.read.parquet(f"{self.path}/edges").unionByName(new) if self._exists(f"{self.path}/edges") else new

    def has_node(self, key: str) -> bool:
        return graph.has_node(self.edges(), self.spark.createDataFrame([(key,)], "key string")).first()["found"]

    def _vector_rows(self) -> DataFrame:
        """key, vector, seq of the last vector of each key."""
        rows = [(k, v, seq) for k, (v, seq) in self._vectors.items()]
        found = self.spark.createDataFrame(rows, "key string, vector array<double>, seq long")
        if self._exists(f"{self.path}/vectors"):
            found = self.spark.read.parquet(f"{self.path}/vectors").unionByName(found)
        return found.groupBy("key").agg(F.max_by("vector", "seq").alias("vector"), F.max("seq").alias("seq"))

    def vectors(self) -> DataFrame:
        return self._vector_rows().select("key", "vector")

    def build_vector_index(self, cells: int = 16) -> None:
        """Stores every vector with its cell; :meth:`search_vector` with ``ef`` reads the nearest cells of it."""
        self.flush()
        rows, folder = self.vectors(), f"{self.path}/cells-{time.time_ns()}"
        centres = vector.train_cells(rows, cells)
        vector.assign_cells(rows, centres).write.partitionBy("cell").parquet(folder)
        self._note("vector-index", folder=folder, seq=self._seq, centres=centres.tolist())

    def _near_vectors(self, v: list[float], ef: int) -> DataFrame:
        """Vectors of the ``ef`` nearest cells, and those written since the index was built."""
        index, rows = self._newest("vector-index"), self._vector_rows()
        if index is None:
            return rows.select("key", "vector")
        centres = np.array(index["centres"])
        near = np.argsort(-(centres @ np.asarray(v, float)))[:ef].tolist() if len(v) == centres.shape[1] else []
        later = rows.where(F.col("seq") > index["seq"]).select("key", "vector")
        held = self.spark.read.parquet(index["folder"]).where(F.col("cell").isin(near)).select("key", "vector")
        return held.join(later.select("key"), "key", "left_anti").unionByName(later)

    def _indexes(self) -> planner.Indexes:
        return planner.Indexes(self.state(), self.vectors(), self.edges(), self.postings())

    def query(self, spec: planner.QuerySpec) -> list[Document]:
        """The documents of a query. With a timeout its jobs are cancelled after so many seconds."""
        if spec.timeout is None:
            return _documents(planner.search_documents(self._indexes(), spec))
        context, group, late = self.spark.sparkContext, f"search-{time.time_ns()}", threading.Event()
        timer = threading.Timer(spec.timeout, lambda: (late.set(), context._jsc.sc().cancelJobGroupAndFutureJobs(group)))
        context.setJobGroup(group, "search", True)
        timer.start()
        try:
            found = _documents(planner.search_documents(self._indexes(), spec))
        except Exception as e:
            if not late.is_set():
                raise
            raise TimeoutError(f"the search took more than {spec.timeout} s") from e
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        if late.is_set():
            raise TimeoutError(f"the search took more than {spec.timeout} s")
        return found

    def search(self, text: str, limit: int = 10) -> list[Document]:
        return self.query(planner.QuerySpec(text=text, top_k=limit))

    search_text = search

    def search_fuzzy(self, text: str, limit: int = 5) -> list[Document]:
        return _documents(fuzzy.search_documents(self.state(), text, limit))

    def search_vector(self, v: list[float], limit: int = 10, ef: int | None = None) -> list[Document]:
        """The nearest vectors: of all, or with ``ef`` of so many cells of the stored index."""
        hits = vector.search(self.vectors() if ef is None else self._near_vectors(v, ef), v, limit)
        return _documents(hits.join(self.state(), "key", "left").select("key", "value", "score", "rank"))

    def search_graph(self, start: str, relation: str = "calls", depth: int = 3, limit: int = 20) -> list[Document]:
        return self.query(planner.QuerySpec(text=start, relations=[relation], max_depth=depth, top_k=limit))

    # snapshots
    def snapshot(self, name: str = "") -> str:
        n = len(self._refs) + 1
        while not name or (name.startswith("snap-") and name in self._refs):
            name, n = f"snap-{n:04d}", n + 1
        self._refs[name] = self._seq
        self._note("refs", name=name, seq=self._seq)
        return name

    def snapshots(self) -> list[str]:
        return sorted(self._refs)

    def snapshot_delete(self, name: str) -> bool:
        if self._refs.pop(name, None) is None:
            return False
        self._note("refs", name=name, seq=-1)
        return True

    def read_snapshot(self, name: str) -> DataFrame:
        if name not in self._refs:
            raise KeyError(f"no snapshot {name!r}")
        return versions.snapshot(self.log(), self._refs[name])

    def restore(self, name: str) -> None:
        if name not in self._refs:
            raise KeyError(f"no snapshot {name!r}")
        self._write_table(versions.restore_records(self.log(), self._refs[name], 0))

    # namespaces
    def create_namespace(self, name: str) -> Namespace:
        """Registers a namespace; one that is there stays as it is."""
        if name not in self.namespaces():
            self._note("namespaces", name=name, here=True)
        return Namespace(self, name)

    def namespace(self, name: str) -> Namespace:
        if name not in self.namespaces():
            raise KeyError(f"no namespace {name!r}")
        return Namespace(self, name)

    def namespaces(self) -> list[str]:
        here = {}
        for r in sorted(self._lines("namespaces"), key=lambda r: r["made"]):
            here[r["name"]] = r["here"]
        return sorted(n for n, h in here.items() if h)

    def delete_namespace(self, name: str) -> int:
        """Deletes its records and returns their number."""
        gone = self._write_table(self.state(name).select("key", F.lit(None).cast("string").alias("value"), F.lit("del").alias("op")), name)
        self._note("namespaces", name=name, here=False)
        return gone

    def agent(self, name: str, mode: str = "delta", source: str = "") -> Agent:
        """A branch of the live state, or of a named snapshot. A branch of that name that was saved goes on."""
        if source and source not in self._refs:
            raise KeyError(f"no snapshot {source!r}")
        saved = self._saved_branches().get(name) if not source else None
        if saved:
            return Agent(self, name, saved["mode"], saved["base"], [tuple(r) for r in saved["delta"]])
        return Agent(self, name, mode, self._refs[source] if source else None)

    def _saved_branches(self) -> dict[str, dict]:
        found = {}
        for r in sorted(self._lines("branches"), key=lambda r: r["made"]):
            found[r["name"]] = r
        return {n: r for n, r in found.items() if r["open"]}

    def branches(self) -> list[str]:
        """Names of saved branches."""
        return sorted(self._saved_branches())

    def begin(self, isolation: str = "snapshot") -> Transaction:
        return Transaction(self, isolation)

    _BESIDE = {"edges": "parquet", "vectors": "parquet", "refs": "text", "namespaces": "text", "branches": "text"}

    def backup(self, path: str) -> None:
        """Everything written so far: records, edges, vectors, snapshots, namespaces and saved branches."""
        self.flush()
        path = path.rstrip("/")
        for kind, form in self._BESIDE.items():
            if self._exists(f"{self.path}/{kind}"):
                self.spark.read.format(form).load(f"{self.path}/{kind}").write.mode("errorifexists").format(form).save(f"{path}/{kind}")
        logs.backup(self.all_records(), f"{path}/log")

    def restore_backup(self, path: str) -> None:
        """Fills an empty database from a backup."""
        if self._seq:
            raise RuntimeError("only an empty database can be filled from a backup")
        path = path.rstrip("/")
        for kind, form in self._BESIDE.items():
            if self._exists(f"{path}/{kind}"):
                self.spark.read.format(form).load(f"{path}/{kind}").write.mode("append").format(form).save(f"{self.path}/{kind}")
        logs.append(logs.restore(self.spark, f"{path}/log"), self._log_path)
        self.__init__(self.spark, self.path)

    def skipped_files(self) -> list[str]:
        """Files of the log that are damaged and so not read."""
        return [r["path"] for r in logs.skipped(self.spark, self._log_path).collect()] if self._exists(self._log_path) else []

    def watch(self, pattern: str, deliver, checkpoint: str, credit: int | None = None, once: bool = False):
        """Delivers records whose key starts with ``pattern`` as they are flushed."""
        return watching.start(self.spark, self._log_path, watching.Watch(pattern, credit=credit), deliver, checkpoint, once)

    def watches(self) -> watching.Registry:
        """A registry of watches over all records, buffered ones too, that are read on demand."""
        return watching.Registry(self.all_records)

    def stats(self) -> dict:
        row = state.statistics(self.log()).first()
        return {"records": row["records"] or 0, "tombstones": row["tombstones"] or 0, "bytes": row["bytes"] or 0, "snapshots": len(self._refs), "graph_edges": self.edges().count(), "index_vectors": self.vectors().count()}

    def compact(self, drop_tombstones: bool = True) -> None:
        """Moves the log to a new base that keeps the last record of each key, and those that a snapshot, an open
        or saved branch or an open transaction still reads."""
        self.flush()
        if not self._has_log():
            return
        kept = [*self._refs.values(), *[r["base"] for r in self._saved_branches().values()], *[x.since for x in self._open_bases if x.alive()]]
        mark, upto = time.time_ns(), self._seq
        base, postings = f"{self.path}/base-{mark}", f"{self.path}/postings-{mark}"
        rows = state.compact_history(self._stored(), [q for q in kept if q < upto], drop_tombstones)
        logs.append(rows.select("namespace", "key", "value", "op", "seq"), base)
        if self._exists(self._postings_path):
            held = logs.read(self.spark, base).where("op = 'put'").select("namespace", "key", "seq")
            keyword.store(self.spark.read.parquet(self._postings_path).join(held, ["namespace", "key", "seq"], "left_semi"), postings)
        old = (self._base, self._postings_path)
        self._note("base", folder=base, upto=upto, postings=postings)
        self._base, self._upto, self._postings_path = base, upto, postings
        # what stays behind if this is interrupted is not read
        for x in (self._log_path, *old):
            if x:
                self._delete(x)

    def close(self) -> None:
        if not self._closed:
            self.flush()
            self._closed = True

    def __enter__(self) -> DB:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def __repr__(self) -> str:
        return f"DB({self.path!r})"


class Agent:
    """A branch: reads see its own writes over the state at its start; searches see the main line.
    Leaving the ``with`` block merges it, an exception discards it."""

    def __init__(self, db: DB, name: str, mode: str = "delta", base: int | None = None, delta: list[tuple] | None = None):
        self.db, self.name, self.mode = db, name, mode
        self.base, self._delta, self._done = db._seq if base is None else base, list(delta or []), False
        self.since, self._marks = self.base, {}
        db._open_bases.add(self)

    def alive(self) -> bool:
        return not self._done

    def save(self) -> None:
        """Stores the branch, so that ``db.agent`` of its name goes on with it later."""
        self._open()
        self.db._note("branches", name=self.name, base=self.base, mode=self.mode, delta=self._delta, open=True)

    def _finish(self) -> None:
        self._done = True
        if self.name in self.db._saved_branches():
            self.db._note("branches", name=self.name, base=self.base, mode=self.mode, delta=[], open=False)

    def _open(self) -> None:
        if self._done:
            raise RuntimeError(f"agent {self.name!r} is finished")

    def _own(self) -> DataFrame:
        return self.db.spark.createDataFrame([(k, v, op, self.base + 1 + i) for i, (k, v, op) in enumerate(self._delta)], "key string, value string, op string, seq long")

    def state(self) -> DataFrame:
        return versions.branch_state(self.db.log(), self.base, self._own())

    def put(self, key: str, value: str) -> None:
        self._open()
        self._delta.append((key, value, "put"))

    def load(self, pairs) -> int:
        self._open()
        rows = list(pairs.items() if isinstance(pairs, dict) else pairs)
        self._delta += [(k, v, "put") for k, v in rows]
        return len(rows)

    put_batch = load

    def delete(self, key: str) -> None:
        self._open()
        self._delta.append((key, None, "del"))

    def get(self, key: str) -> str | None:
        row = state.get(self.state(), key).first()
        return row["value"] if row else None

    def scan(self, prefix: str = "", limit: int = 100) -> list[tuple[str, str]]:
        return [tuple(r) for r in state.scan_prefix(self.state(), prefix, limit).collect()]

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def diff(self) -> DataFrame:
        return versions.diff(self.db.state(), self.state())

    def search(self, text: str, limit: int = 10) -> list[Document]:
        return self.db.search(text, limit)

    def search_fuzzy(self, text: str, limit: int = 5) -> list[Document]:
        return self.db.search_fuzzy(text, limit)

    def search_vector(self, v: list[float], limit: int = 10) -> list[Document]:
        return self.db.search_vector(v, limit)

    def search_graph(self, start: str, relation: str = "calls", depth: int = 3, limit: int = 20) -> list[Document]:
        return self.db.search_graph(start, relation, depth, limit)

    def checkpoint(self, name: str = "") -> str:
        """Names the branch's records so far, to go back to with :meth:`rollback_to`."""
        self._open()
        name = name or f"checkpoint-{len(self._marks) + 1:04d}"
        self._marks[name] = len(self._delta)
        return name

    def checkpoints(self) -> list[str]:
        return sorted(self._marks)

    def rollback_to(self, name: str) -> None:
        """Forgets what came after a checkpoint, and later checkpoints."""
        self._open()
        if name not in self._marks:
            raise KeyError(f"no checkpoint {name!r}")
        self._delta = self._delta[: self._marks[name]]
        self._marks = {n: size for n, size in self._marks.items() if size <= len(self._delta)}

    def commit(self) -> int:
        """Merges and returns the number of records written. ``delta`` writes what the agent changed, deletes
        too; ``overlay`` writes every pair the branch sees."""
        self._open()
        if self.mode == "delta":
            self.db._write(self._delta)
            written = len(self._delta)
        else:
            written = self.db._write_table(self.state().select("key", "value", F.lit("put").alias("op")))
        self._finish()
        return written

    merge_to_main = commit

    def discard(self) -> None:
        self._delta = []
        self._finish()

    def __enter__(self) -> Agent:
        return self

    def __exit__(self, kind, *exc) -> None:
        if not self._done:
            self.discard() if kind else self.commit()

    def __repr__(self) -> str:
        return f"Agent({self.name!r})"


class Namespace:
    """The records of one namespace: keys of different namespaces never meet."""

    def __init__(self, db: DB, name: str):
        self.db, self.name = db, name

    def put(self, key: str, value: str) -> None:
        self.db._write([(key, value, "put")], self.name)

    def load(self, pairs) -> int:
        rows = [(k, v, "put") for k, v in (pairs.items() if isinstance(pairs, dict) else pairs)]
        self.db._write(rows, self.name)
        return len(rows)

    def delete(self, key: str) -> None:
        self.db._write([(key, None, "del")], self.name)

    def get(self, key: str) -> str | None:
        row = state.get(self.db.state(self.name), key).first()
        return row["value"] if row else None

    def scan(self, prefix: str = "", limit: int = 100) -> list[tuple[str, str]]:
        return [tuple(r) for r in state.scan_prefix(self.db.state(self.name), prefix, limit).collect()]

    def search(self, text: str, limit: int = 10) -> list[Document]:
        indexes = planner.Indexes(self.db.state(self.name), postings=self.db.postings(self.name))
        return _documents(planner.search_documents(indexes, planner.QuerySpec(text=text, top_k=limit)))

    def stat(self) -> dict:
        named = self.db.state(self.name).withColumn("namespace", F.lit(self.name))
        row = namespaces.statistics(named).first()
        return {"name": self.name, "records": row["n_records"] if row else 0, "bytes": row["bytes"] if row else 0}

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def __repr__(self) -> str:
        return f"Namespace({self.name!r})"


class ConflictError(RuntimeError):
    pass


class Transaction:
    """Buffered writes over the state at begin. Isolation: read_committed, snapshot or serializable; all read
    the begin state, and a serializable commit fails if the value of a key it read has changed since."""

    def __init__(self, db: DB, isolation: str = "snapshot"):
        self.db, self.isolation = db, isolation
        self.begin_seq, self.status = db._seq, "active"
        self.since = self.begin_seq
        db._open_bases.add(self)
        self._buffer: list[tuple[str, str | None, str]] = []
        self._read: set[str] = set()

    def alive(self) -> bool:
        return self.status == "active"

    def _open(self) -> None:
        if self.status != "active":
            raise RuntimeError(f"the transaction is {self.status}")

    def get(self, key: str) -> str | None:
        self._open()
        for k, value, op in reversed(self._buffer):
            if k == key:
                return value if op == "put" else None
        if self.isolation == "serializable":
            self._read.add(key)
        row = state.get(state.live(self.db.log(), self.begin_seq), key).first()
        return row["value"] if row else None

    def put(self, key: str, value: str) -> None:
        self._open()
        self._buffer.append((key, value, "put"))

    def delete(self, key: str) -> None:
        self._open()
        self._buffer.append((key, None, "del"))

    def commit(self) -> int:
        """Applies the buffer in order and returns its length."""
        self._open()
        if self._read:
            log = self.db.log()
            reads = self.db.spark.createDataFrame([(k,) for k in self._read], "key string")
            changed = transactions.conflicts(reads, state.live(log, self.begin_seq), state.live(log)).limit(1).collect()
            if changed:
                self.status = "aborted"
                raise ConflictError(f"{changed[0]['key']!r} has changed since the transaction began")
        self.db._write(self._buffer)
        self.status = "committed"
        return len(self._buffer)

    def rollback(self) -> None:
        self._open()
        self._buffer, self.status = [], "rolled back"


class AgentStore:
    """Typed records of agent sessions, one Parquet table partitioned by nothing but its files; a deleted
    session leaves a row of type ``deleted`` that hides what was stored before it."""

    SCHEMA = "session_id string, thread_id string, step long, pos long, type string, id string, content string, stored long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        exists = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if exists else self.spark.createDataFrame([], self.SCHEMA)

    def records(self) -> DataFrame:
        rows = self._table()
        gone = rows.where("type = 'deleted'").groupBy("session_id").agg(F.max("stored").alias("gone"))
        kept = rows.where("type <> 'deleted'").join(gone, "session_id", "left")
        return kept.where("gone is null or stored > gone").drop("gone", "stored")

    def _write(self, rows: list[tuple]) -> None:
        now = time.time_ns()
        self.spark.createDataFrame([(*r, now) for r in rows], self.SCHEMA).write.mode("append").parquet(self.path)

    def store_payload(self, session: str, records: list[dict]) -> None:
        """Records are dicts of type, id, thread_id, step and content. Threads must be named, steps must not fall."""
        if any(r["session_id"] == session for r in self.list_sessions()):
            self.delete_payload(session)
        self._checked(session, records, 0)

    def append_records(self, session: str, records: list[dict]) -> int:
        last = self.records().where(F.col("session_id") == session).agg(F.max("pos").alias("pos"), F.max("step").alias("step")).first()
        if last["step"] is not None and records and records[0]["step"] < last["step"]:
            raise ValueError("steps must not fall")
        self._checked(session, records, (last["pos"] if last["pos"] is not None else -1) + 1)
        return len(records)

    def _checked(self, session: str, records: list[dict], first: int) -> None:
        if any(not r["thread_id"] for r in records) or any(b["step"] < a["step"] for a, b in zip(records, records[1:], strict=False)):
            raise ValueError("threads must be named and steps must not fall")
        self._write([(session, r["thread_id"], r["step"], first + i, r["type"], r.get("id"), r.get("content", "")) for i, r in enumerate(records)])

    def load_payload(self, session: str) -> list[dict]:
        rows = sessions.load(self.records(), session).orderBy("step", "pos").collect()
        if not rows:
            raise KeyError(session)
        return [r.asDict() for r in rows]

    def delete_payload(self, session: str) -> None:
        self._write([(session, "", 0, 0, "deleted", None, "")])

    def list_sessions(self) -> list[dict]:
        return [r.asDict() for r in sessions.sessions(self.records()).orderBy("session_id").collect()]

    def get_records_by_type(self, session: str, kind: str) -> list[dict]:
        return [r.asDict() for r in sessions.by_type(self.records(), session, kind).collect()]

    def get_recent_records(self, session: str, n: int) -> list[dict]:
        return [r.asDict() for r in sessions.recent(self.records().where(F.col("session_id") == session), n).orderBy("step", "pos").collect()]

    def search_records(self, session: str, text: str, limit: int = 10) -> list[Document]:
        hits = sessions.search(self.records(), session, text, limit).orderBy("rank").collect()
        return [Document(r["key"], "", r["score"]) for r in hits]


class Workspace:
    """Records of one namespace of a database."""

    def __init__(self, db: DB, name: str = "main"):
        self.db, self.name = db, name
        self._prefix = "" if name == "main" else f"{name}/"

    def put(self, key: str, value: str) -> None:
        self.db.put(self._prefix + key, value)

    def put_batch(self, pairs) -> int:
        return self.db.load([(self._prefix + k, v) for k, v in (pairs.items() if isinstance(pairs, dict) else pairs)])

    def get(self, key: str) -> str | None:
        return self.db.get(self._prefix + key)

    def delete(self, key: str) -> None:
        self.db.delete(self._prefix + key)

    def scan(self, prefix: str = "", limit: int = 100) -> list[tuple[str, str]]:
        return [(k[len(self._prefix) :], v) for k, v in self.db.scan(self._prefix + prefix, limit)]

    def snapshot(self, name: str = "") -> str:
        return self.db.snapshot(name)

    def rollback_to(self, name: str) -> None:
        self.db.restore(name)

    def commit(self) -> None:
        self.db.flush()

    merge_to_main = commit

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def __repr__(self) -> str:
        return f"Workspace({self.name!r})"


class ContextEngine:
    """Searches over a database, with ingestion."""

    def __init__(self, db: DB):
        self.db = db

    def ingest(self, pairs) -> int:
        return self.db.load(pairs)

    def query(self, text: str, limit: int = 10) -> list[Document]:
        return self.db.search(text, limit)

    search_text = query

    def search_fuzzy(self, text: str, limit: int = 5) -> list[Document]:
        return self.db.search_fuzzy(text, limit)

    def search_vector(self, v: list[float], limit: int = 10) -> list[Document]:
        return self.db.search_vector(v, limit)

    def search_graph(self, start: str, relation: str = "calls", depth: int = 3, limit: int = 20) -> list[Document]:
        return self.db.search_graph(start, relation, depth, limit)

    def add_edge(self, src: str, relation: str, dst: str) -> None:
        self.db.add_edge(src, relation, dst)

    def index(self, key: str, v: list[float]) -> None:
        self.db.index(key, v)


class Client:
    def __init__(self, db: DB):
        self.db, self._agents = db, {}

    @classmethod
    def connect(cls, spark: SparkSession, target: str) -> Client:
        return cls(DB(spark, target if target.startswith(("file://", "hdfs://", "s3a://")) else target.split("://", 1)[-1]))

    def workspace(self, name: str = "main") -> Workspace:
        return Workspace(self.db, name)

    def context(self) -> ContextEngine:
        return ContextEngine(self.db)

    def branch(self, name: str, source: str = "") -> Agent:
        """A new branch of the live state or of a named snapshot; one of that name is replaced."""
        self._agents[name] = self.db.agent(name, source=source)
        return self._agents[name]

    def agent(self, name: str) -> Agent:
        if name not in self._agents or self._agents[name]._done:
            self._agents[name] = self.db.agent(name)
        return self._agents[name]

    def branches(self) -> list[str]:
        return sorted({n for n, a in self._agents.items() if not a._done} | set(self.db.branches()))

    def stats(self) -> dict:
        return self.db.stats()

    def close(self) -> None:
        self.db.close()

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def __repr__(self) -> str:
        return f"Client({self.db!r})"


def open_db(spark: SparkSession, path: str) -> DB:
    return DB(spark, path)
