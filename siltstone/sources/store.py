"""A key-value store in a folder: Parquet files under a manifest that changes atomically.

Layout: ``STORE`` names the format. Every change writes its files first and then
creates the next numbered manifest step, ``step-N.json``, which lists the files that
come and go; the step with the highest number is in force. A number can be created
only once, so one of two writers that began from the same state fails and nothing is
overwritten. Every so many steps ``whole-N.json`` holds the manifest in full, and
``CURRENT`` names a step from which the last is found. Level -1 is the log of batches,
level 0 holds flushed files, deeper levels have disjoint ranges.

A manifest entry has the key range, rows, bytes, highest lsn and a hash of the content
of its file. Flush, compaction and full rewrite publish only what has the rows and the
hash of the merge of their inputs, which is computed apart from what was written.
Replaced files stay for ``RETAINED`` more steps, for readers that began before.

Writes of all threads of a process queue up and are stored in groups. Durability is
that of the file system's rename and of Spark's committed writes.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections import deque
from concurrent.futures import Future, wait
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.config import Settings
from siltstone.errors import Corrupted, InvalidInput, StorageError
from siltstone.functions.bytes import successor
from siltstone.operators import changelog as cl
from siltstone.operators.changelog import DELETE, MAX_FRAME, MAX_TRANSACTION, PUT, Bound
from siltstone.sources.shared import age_seconds, create_text, few_listings, list_dir, read_text, remove, replace_text

FORMAT = 2
LOG_LEVEL = -1
#: Batches and bytes that one write takes at most; a larger batch is written alone.
GROUP_BATCHES, GROUP_BYTES = 64, 16 << 20
#: Steps between two manifests in full, and steps for which replaced files stay.
WHOLE_EVERY, RETAINED = 16, 4
#: Bytes of a key range that one task of a merge writes, where a file may be smaller.
RANGE_BYTES = 256 << 20
CHANGE = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("lsn", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType()),
    ]
)


@dataclass(frozen=True)
class Put:
    key: bytes
    value: bytes


@dataclass(frozen=True)
class Delete:
    key: bytes


@dataclass(frozen=True)
class CleanStats:
    """What a full rewrite kept and gave back."""

    live_rows: int
    live_bytes: int
    value_bytes: int
    max_lsn: int
    files_before: int
    files_after: int
    bytes_before: int
    bytes_after: int
    generation: int
    seconds: float


def checked_batch(ops: list[Put | Delete]) -> None:
    """Refuse operations that are too large, one by one or together."""
    total = 37
    for op in ops:
        n = len(op.key) + (len(op.value) if isinstance(op, Put) else 0)
        if 42 + n > MAX_FRAME:
            raise InvalidInput("an operation is larger than a frame may be")
        total += 62 + n
    if total > MAX_TRANSACTION:
        raise InvalidInput("the batch is larger than a transaction may be")


def classify(spark: SparkSession, root: str) -> str:
    """'store', 'empty' or 'foreign'; a store without pointer is 'incomplete'."""
    names = list_dir(spark, root)
    if not names:
        return "empty"
    if "STORE" not in names:
        return "foreign"
    return "store" if "CURRENT" in names else "incomplete"


class Store:
    """An open store; ``Store.open`` creates one in an empty folder."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        few_listings(spark)
        self._lock = threading.RLock()
        self._queue: deque[tuple[list[Put | Delete], int, Future]] = deque()
        self._closed = False
        self.maintenance_error: Exception | None = None
        self.manifest: dict = {}

    @classmethod
    def open(
        cls, spark: SparkSession, root: str, settings: Settings | None = None, abandoned_after: float = 3600.0
    ) -> "Store":
        """Open or create; refuse foreign folders, unknown formats and missing files.

        Folders that no manifest names, left by writers that failed, are removed once
        they are ``abandoned_after`` seconds old.
        """
        store = cls(spark, root, settings or Settings())
        kind = classify(spark, root)
        if kind == "foreign":
            raise StorageError(f"{root} holds something else")
        if kind == "incomplete":
            raise Corrupted(f"{root} has no current manifest")
        if kind == "empty":
            replace_text(spark, f"{root}/STORE", json.dumps({"format": FORMAT}))
            first = {"version": 0, "generation": 1, "next_lsn": 1, "next_file": 1, "files": {}, "dropped": []}
            store._publish(first, add=[], gone=[])
            return store
        if json.loads(read_text(spark, f"{root}/STORE") or "{}").get("format") != FORMAT:
            raise Corrupted(f"{root} has a format that this version does not know")
        store.manifest = store._current()
        store._check_files()
        store._remove_abandoned(abandoned_after)
        return store

    # manifest

    def _step(self, n: int) -> str:
        return f"{self.root}/step-{n:012d}.json"

    def _current(self) -> dict:
        """The manifest in force: the last one in full, and all steps after it."""
        try:
            hint = int((read_text(self.spark, f"{self.root}/CURRENT") or "").strip())
        except ValueError as e:
            raise Corrupted("the pointer to the manifest cannot be read") from e
        wholes = [int(m.group(1)) for m in map(re.compile(r"whole-(\d+)\.json").fullmatch, list_dir(self.spark, self.root)) if m]
        start = max([n for n in wholes if n <= hint], default=0)
        try:
            if start:
                found = json.loads(read_text(self.spark, f"{self.root}/whole-{start:012d}.json"))
                found["files"] = {f["file_id"]: f for f in found["files"]}
            else:
                found = {"version": 0, "generation": 1, "next_lsn": 1, "next_file": 1, "files": {}, "dropped": []}
            while True:
                text = read_text(self.spark, self._step(found["version"] + 1))
                if text is None:
                    break
                found = self._after(found, json.loads(text))
        except (ValueError, KeyError, TypeError) as e:
            raise Corrupted("the current manifest cannot be read") from e
        if found["version"] < hint:
            raise Corrupted("a step of the manifest is missing")
        return found

    @staticmethod
    def _after(manifest: dict, step: dict) -> dict:
        """The manifest after one step; the one before is left as it is."""
        files, dropped = dict(manifest["files"]), list(manifest["dropped"])
        for file_id in step["gone"]:
            dropped.append([files.pop(file_id)["path"], step["version"]])
        files.update((f["file_id"], f) for f in step["add"])
        kept = [d for d in dropped if d[1] > step["version"] - RETAINED]
        return {k: step[k] for k in ("version", "generation", "next_lsn", "next_file")} | {"files": files, "dropped": kept}

    def _publish(self, manifest: dict, add: list[dict], gone: list[int]) -> None:
        """Make the next step current; it fails if another writer has taken its number.

        ``manifest`` is the one in force with its counters as they shall be.
        """
        step = {k: manifest[k] for k in ("generation", "next_lsn", "next_file")}
        step |= {"version": manifest["version"] + 1, "at_ms": time.time_ns() // 1_000_000, "add": add, "gone": gone}
        if not create_text(self.spark, self._step(step["version"]), json.dumps(step)):
            raise StorageError("the manifest changed underneath")
        before, self.manifest = manifest, self._after(manifest, step)
        version = step["version"]
        if version % WHOLE_EVERY == 0:
            whole = self.manifest | {"files": list(self.manifest["files"].values())}
            replace_text(self.spark, f"{self.root}/whole-{version:012d}.json", json.dumps(whole))
        replace_text(self.spark, f"{self.root}/CURRENT", str(version))
        if version % WHOLE_EVERY == 0:  # the manifest in full before this one and its steps still stand
            for name in list_dir(self.spark, self.root):
                m = re.fullmatch(r"(?:step|whole)-(\d+)\.json", name)
                if m and int(m.group(1)) < version - WHOLE_EVERY:
                    remove(self.spark, f"{self.root}/{name}")
        kept = {path for path, _ in self.manifest["dropped"]}
        for path, _ in before["dropped"]:
            if path not in kept:
                remove(self.spark, f"{self.root}/{path}")

    @property
    def files(self) -> list[dict]:
        """The entries of all data files."""
        return list(self.manifest["files"].values())

    def _check_files(self) -> None:
        """All files are there; a folder is listed once, whatever the files in it."""
        ended: dict[str, bool] = {}
        for f in self.files:
            folder = f["path"].split("/range=")[0]
            if folder not in ended:
                ended[folder] = "_SUCCESS" in list_dir(self.spark, f"{self.root}/{folder}")
            if not ended[folder]:
                raise Corrupted(f"data file {f['path']} is missing or unfinished")

    def _remove_abandoned(self, older_than: float) -> None:
        known = {f["path"] for f in self.files} | {path for path, _ in self.manifest["dropped"]}
        known = {path.split("/range=")[0] for path in known}
        for generation in list_dir(self.spark, self.root):
            if generation.startswith("generation-"):
                for name in list_dir(self.spark, f"{self.root}/{generation}"):
                    path = f"{generation}/{name}"
                    if path not in known and age_seconds(self.spark, f"{self.root}/{path}") >= older_than:
                        remove(self.spark, f"{self.root}/{path}")

    def verify(self) -> None:
        """Compare every data file with its manifest entry; raise at the first difference."""
        folders: dict[str, list[dict]] = {}
        for f in self.files:
            folders.setdefault(f["path"].split("/range=")[0], []).append(f)
        for folder, entries in folders.items():
            split = "/range=" in entries[0]["path"]
            got = {r["path"]: r for r in self._described(folder, split)}
            for f in entries:
                r = got.get(f["path"])
                if r is None:
                    raise Corrupted(f"data file {f['path']} is missing")
                for name, value in r.items():
                    if f.get(name, value if name == "deletes" else None) != value:  # older entries do not count deletes
                        raise Corrupted(f"{f['path']}: {name} is {value!r}, the manifest says {f[name]!r}")

    def _described(self, folder: str, split: bool) -> list[dict]:
        """What the manifest says of each file of a folder, by one grouped aggregate."""
        schema = T.StructType(list(CHANGE.fields))
        if split:
            schema = schema.add("range", T.IntegerType()).add("part", T.LongType())
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        found = rows.groupBy(*(["range", "part"] if split else [])).agg(
            F.count("*").alias("record_count"),
            F.hex(F.min("key")).alias("smallest_key"),
            F.hex(F.max("key")).alias("largest_key"),
            F.coalesce(F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0))), F.lit(0)).alias("bytes"),
            F.coalesce(F.max("lsn"), F.lit(0)).alias("max_lsn"),
            F.count_if(F.col("op") == DELETE).alias("deletes"),
            cl.content_hash().alias("content"),
        )  # a row per file
        out = []
        for r in found.collect():
            about = r.asDict()
            path = f"{folder}/range={about.pop('range')}/part={about.pop('part')}" if split else folder
            if about["record_count"]:
                out.append({"path": path} | about | {"bytes": int(about["bytes"])})
        return sorted(out, key=lambda f: f["smallest_key"])

    def _options(self, level: int) -> dict:
        """Parquet's settings: a Bloom filter on keys of its own size, and small pages.

        Tasks move their own files to their places. That some are there before the job
        ends does no harm, as nobody reads them before the manifest names them.
        """
        moved = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
        if level == LOG_LEVEL:
            return moved
        return moved | {
            "parquet.bloom.filter.enabled#key": "true",
            "parquet.bloom.filter.adaptive.enabled": "true",
            "parquet.bloom.filter.fpp#key": str(self.settings.bloom_false_positive_rate),
            "parquet.page.size": str(self.settings.sstable_block_size),
        }

    def _write(self, df: DataFrame, level: int, manifest: dict, split: bool = False) -> list[dict]:
        """Write a folder by one job; the entries of its files, none if there is no row.

        With ``split`` the frame has range and part and becomes a file for each.
        """
        folder = f"generation-{manifest['generation']:06d}/L{level}-{uuid.uuid4().hex}"
        writer = df.write.options(**self._options(level))
        (writer.partitionBy("range", "part") if split else writer).parquet(f"{self.root}/{folder}")
        entries = self._described(folder, split)
        if not entries:
            remove(self.spark, f"{self.root}/{folder}")
        for entry in entries:
            entry |= {"file_id": manifest["next_file"], "level": level}
            manifest["next_file"] += 1
        return entries

    def _read(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], CHANGE)
        return self.spark.read.schema(CHANGE).parquet(*[f"{self.root}/{f['path']}" for f in files])

    # reading

    @property
    def sequence(self) -> int:
        """The last sequence number given out."""
        return self.manifest["next_lsn"] - 1

    def changes(self, low: Bound = Bound(), high: Bound = Bound()) -> DataFrame:
        """Stored versions of the files whose key range meets a range."""
        lo = low.key.hex().upper() if low.key is not None else None
        hi = high.key.hex().upper() if high.key is not None else None
        return self._read(
            [f for f in self.files if (lo is None or f["largest_key"] >= lo) and (hi is None or f["smallest_key"] <= hi)]
        )

    def get(self, key: bytes, lsn: int | None = None) -> bytes | None:
        """The value of a key, or None if it is deleted or unknown.

        Files are left out by their key range, row groups by their Bloom filter.
        """
        self._open()
        at = Bound(key)
        row = cl.point_get(self.changes(at, at), key, lsn=self.sequence if lsn is None else lsn).first()
        return None if row is None else bytes(row["value"])

    def scan(self, low: Bound = Bound(), high: Bound = Bound(), lsn: int | None = None) -> DataFrame:
        """(key, value) of live keys in a range, ascending."""
        self._open()
        return cl.scan(self.changes(low, high), low, high, lsn=self.sequence if lsn is None else lsn)

    def prefix_scan(self, prefix: bytes) -> DataFrame:
        above = successor(prefix)
        return self.scan(Bound(prefix), Bound(above, False) if above is not None else Bound())

    # writing

    def _open(self) -> None:
        if self._closed:
            raise StorageError("the store is closed")

    def put(self, key: bytes, value: bytes) -> None:
        self.write_batch([Put(key, value)])

    def delete(self, key: bytes) -> None:
        self.write_batch([Delete(key)])

    def submit(self, ops: list[Put | Delete]) -> Future:
        """Queue a batch; the future ends once it is stored, by this thread or another.

        Batches are stored in the order of their submission, up to ``GROUP_BATCHES`` and
        ``GROUP_BYTES`` of them by one write, a larger batch by itself.
        """
        self._open()
        checked_batch(ops)
        ticket: Future = Future()
        if not ops:
            ticket.set_result(None)
            return ticket
        size = sum(62 + len(op.key) + (len(op.value) if isinstance(op, Put) else 0) for op in ops)
        self._queue.append((list(ops), size, ticket))
        return ticket

    def write_batch(self, ops: list[Put | Delete]) -> None:
        """Apply operations in order, all at once or not at all; an empty list does nothing.

        The batch is stored once this returns. Maintenance that it triggers may fail
        without undoing it; the failure is kept in ``maintenance_error``.
        """
        self.write_batches([ops])

    def write_batches(self, batches: list[list[Put | Delete]]) -> None:
        """Several batches in order by as few writes as the group limits allow.

        All are checked before the first is stored. Each group becomes visible at
        once, so no batch is ever seen in part.
        """
        self._open()
        for ops in batches:
            checked_batch(ops)
        tickets = [self.submit(ops) for ops in batches]
        self._drain()
        for ticket in tickets:
            ticket.result()

    def _drain(self) -> None:
        """Store what is queued; a thread that waited for the lock may find its batch stored."""
        with self._lock:
            wrote = False
            while self._queue:
                group, size = [], 0
                while self._queue and len(group) < GROUP_BATCHES and (not group or size + self._queue[0][1] <= GROUP_BYTES):
                    group.append(self._queue.popleft())
                    size += group[-1][1]
                wrote = True
                try:
                    self._write_group([op for ops, _, _ in group for op in ops], size)
                except Exception as e:
                    for _, _, ticket in group:
                        ticket.set_exception(e)
                else:
                    for _, _, ticket in group:
                        ticket.set_result(None)
            if wrote:
                self._maintain()

    def _write_group(self, ops: list[Put | Delete], size: int) -> None:
        first = self.manifest["next_lsn"]
        rows = [
            (op.key, first + i, PUT if isinstance(op, Put) else DELETE, op.value if isinstance(op, Put) else None)
            for i, op in enumerate(ops)
        ]
        segments = -(-size // self.settings.wal_segment_size)
        self._append(self.spark.createDataFrame(rows, CHANGE).coalesce(segments))

    def apply_versions(self, versions: DataFrame) -> None:
        """Take over rows (key, lsn, op, value) with their own sequence numbers."""
        self._open()
        rows = versions.select(
            "key", F.col("lsn").cast("long").alias("lsn"), F.col("op").cast("byte").alias("op"), "value"
        ).where(F.col("key").isNotNull() & F.col("lsn").isNotNull())
        with self._lock:
            self._append(rows)
            self._maintain()

    def write_changes(self, batches: DataFrame) -> None:
        """Apply a table of operations (batch_id, pos, op, key, value) of any size at once."""
        self._open()
        with self._lock:
            rows = cl.batch_to_changes(batches.where(F.col("key").isNotNull()), self.manifest["next_lsn"])
            self._append(rows.select("key", "lsn", F.col("op").cast("byte").alias("op"), "value"))
            self._maintain()

    def write_at_once(self, rows: DataFrame) -> None:
        """Apply a table (op, key, value) of any size with one operation per key, by one lsn."""
        self._open()
        with self._lock:
            lsn = F.lit(self.manifest["next_lsn"]).cast("long").alias("lsn")
            self._append(rows.select("key", lsn, F.col("op").cast("byte").alias("op"), "value"))
            self._maintain()

    def _append(self, rows: DataFrame) -> None:
        """Write a frame to the log; what was written says which numbers are taken."""
        manifest = dict(self.manifest)
        entries = self._write(rows, LOG_LEVEL, manifest)
        if not entries:
            return
        manifest["next_lsn"] = max(manifest["next_lsn"], entries[0]["max_lsn"] + 1)
        try:
            self._publish(manifest, entries, [])
        except StorageError:
            remove(self.spark, f"{self.root}/{entries[0]['path']}")
            raise

    def await_pending_writes(self) -> None:
        """Return once all writes submitted before are stored."""
        self._open()
        before = [ticket for _, _, ticket in list(self._queue)]
        self._drain()
        wait(before)

    # maintenance

    def level(self, n: int) -> list[dict]:
        return [f for f in self.files if f["level"] == n]

    def _maintain(self) -> None:
        try:
            if sum(f["bytes"] for f in self.level(LOG_LEVEL)) >= self.settings.memtable_size_threshold:
                self.flush()
            self.compact()
            self.maintenance_error = None
        except Exception as e:  # the batch is stored; a later write tries again
            self.maintenance_error = e

    def flush(self) -> None:
        """Merge the log into one file of level 0, one version per key, deletes kept."""
        self._open()
        with self._lock:
            log = self.level(LOG_LEVEL)
            if log:
                image = cl.flush_image(self._read(log))
                ordered = image.repartitionByRange("key").sortWithinPartitions("key")
                self._replace(log, image, ordered, 0)

    def _replace(
        self, inputs: list[dict], image: DataFrame, output: DataFrame, level: int, split: bool = False,
        generation: int | None = None,
    ) -> list[dict]:
        """Publish the written ``output`` in place of ``inputs``, if it is the whole ``image``.

        The image is merged a second time for its rows and content hash. Output that
        lacks, repeats or alters a version is removed and the inputs stay.
        """
        manifest = dict(self.manifest)
        manifest["generation"] = generation or manifest["generation"]
        entries = self._write(output, level, manifest, split)
        want = image.agg(F.count("*").alias("n"), cl.content_hash().alias("content")).first()
        content = 0
        for f in entries:
            content ^= f["content"]
        try:
            if (sum(f["record_count"] for f in entries), content) != (want["n"], want["content"]):
                gaps = cl.image_gaps(image, self._read(entries)).limit(3).collect()
                shown = ", ".join(f"{bytes(g['key']).hex()} at {g['lsn']}" for g in gaps)
                raise Corrupted(f"what was written is not the merge of its inputs: {shown}")
            self._publish(manifest, entries, [f["file_id"] for f in inputs])
        except (Corrupted, StorageError):
            for folder in {f["path"].split("/range=")[0] for f in entries}:
                remove(self.spark, f"{self.root}/{folder}")
            raise
        return entries

    def _due(self) -> int | None:
        """The level to compact next: the deepest over its target, else a full level 0."""
        deepest = max([f["level"] for f in self.files], default=0)
        for n in range(deepest, 0, -1):
            if sum(f["bytes"] for f in self.level(n)) > self._level_bytes(n):
                return n
        return 0 if len(self.level(0)) > self.settings.max_level0_files else None

    def _level_bytes(self, n: int) -> int:
        """The bytes that a level below 0 may hold."""
        return self.settings.level_base_bytes * self.settings.level_size_multiplier ** (n - 1)

    def _seeds(self, n: int) -> set[int]:
        """Files that a compaction of a level begins from: all of level 0, else the oldest.

        Of a level over its bound these are as many as bring it within, so that the
        merges do not grow with the files by which it is over.
        """
        own = sorted(self.level(n), key=lambda f: f["file_id"])
        if n == 0:
            return {f["file_id"] for f in own}
        over, seeds = sum(f["bytes"] for f in own) - self._level_bytes(n), set()
        for f in own:
            if seeds and over <= 0:
                break
            seeds.add(f["file_id"])
            over -= f["bytes"]
        return seeds

    def compact(self) -> int:
        """Compact until no level is over its bound; the number of merges."""
        self._open()
        done = 0
        with self._lock:
            while (n := self._due()) is not None:
                self.compact_level(n)
                done += 1
        return done

    def _hand_down(self, n: int, seeds: set[int]) -> set[int]:
        """Move to the next level, by the manifest alone, the seeds that meet no file there.

        A merge would write them again as they are: of a key they have one version, and
        only those without deletes are moved. The files moved.
        """
        below = self.level(n + 1)
        near = [
            {"file_id": f["file_id"], "lo": f["smallest_key"], "hi": f["largest_key"]} for f in self.level(n) + below
        ]
        met = cl.closure(near, {f["file_id"] for f in below})
        free = [f for f in self.level(n) if f["file_id"] in seeds - met and f.get("deletes") == 0]
        if free:
            self._publish(dict(self.manifest), [f | {"level": n + 1} for f in free], [])
        return {f["file_id"] for f in free}

    def compact_level(self, n: int) -> None:
        """Merge a level's oldest files, or all of level 0, with all they overlap into the next.

        One job writes all files of the merge and one describes them. Files that need no
        merge are handed down as they are.
        """
        with self._lock:
            own = self.level(n)
            if not own:
                return
            seeds = self._seeds(n)
            if n > 0:
                seeds -= self._hand_down(n, seeds)
                if not seeds:
                    return
                own = self.level(n)
            near = [
                {"file_id": f["file_id"], "lo": f["smallest_key"], "hi": f["largest_key"]}
                for f in own + self.level(n + 1)
            ]
            chosen = cl.closure(near, seeds)
            inputs = [f for f in self.files if f["file_id"] in chosen]
            # what a delete may still have to hide: older versions elsewhere
            others = [
                (bytes.fromhex(f["smallest_key"]), bytes.fromhex(f["largest_key"]))
                for f in self.files
                if f["file_id"] not in chosen
            ]
            protected = self.spark.createDataFrame(others, "smallest_key binary, largest_key binary")
            merged = cl.compact(self._read(inputs), protected)
            target, size = self.settings.target_sstable_bytes, sum(f["bytes"] + 62 * f["record_count"] for f in inputs)
            cores = self.spark.sparkContext.defaultParallelism
            ranges = max(1, -(-size // max(target, RANGE_BYTES)), min(cores, size // target))
            self._replace(inputs, merged, cl.cut_in_place(merged, target, ranges), n + 1, split=True)

    def clean(self) -> CleanStats:
        """Rewrite all live keys into a new generation, check it, switch, drop the old one."""
        self._open()
        began = time.time()
        with self._lock:
            before, generation = self.files, self.manifest["generation"] + 1
            live = cl.latest(self._read(before))
            kept = cl.clean_statistics(self._read(before)).first()
            ordered = live.repartitionByRange("key").sortWithinPartitions("key")
            after = self._replace(before, live, ordered, 1, generation=generation)
        return CleanStats(
            kept["live_rows"], kept["live_bytes"], kept["value_bytes"], kept["max_lsn"],
            len(before), len(after), sum(f["bytes"] for f in before), sum(f["bytes"] for f in after),
            generation, time.time() - began,
        )

    def level_report(self) -> list[dict]:
        """Files, records and bytes of each level."""
        out: dict[int, dict] = {}
        for f in self.files:
            r = out.setdefault(f["level"], {"level": f["level"], "n_files": 0, "n_rows": 0, "n_bytes": 0})
            r["n_files"] += 1
            r["n_rows"] += f["record_count"]
            r["n_bytes"] += f["bytes"]
        return [out[k] for k in sorted(out)]

    def close(self) -> None:
        """Store what is queued and refuse later writes."""
        with self._lock:
            if not self._closed:
                self._drain()
            self._closed = True

    def describe(self) -> dict:
        return {"root": self.root, "settings": asdict(self.settings), "levels": self.level_report()}
