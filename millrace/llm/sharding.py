"""Sharding by size-tiered compaction with a versioned manifest.

``ShardStore.append`` writes an arrival as small immutable Parquet shards and
commits a manifest that lists them.  ``compact`` merges runs of similarly sized
shards into files of about ``target`` bytes: shards below ``target / 2`` are
put in tiers by the logarithm of their size; a tier with ``run`` shards or
more is merged, oldest first, and so on until no tier has that many.  Each
merge reads its own shards in one task and writes one file, so nothing is
shuffled and a lost executor costs one merge's repetition.

A version is the file ``manifest-<n>.json``, made by renaming a finished
temporary file to a name that must not exist yet.  It names part files, each a
list of shards: a commit writes one part with its new shards and one with what
is left of parts that lost some, and keeps all others, so it writes in
proportion to what it changes.  Parts beyond ``PARTS`` are folded into one.
Whoever loses the race for a version reads the new one and tries again; shards
that no manifest names are leftovers and never read.  Readers of an old
version keep their files until ``vacuum`` removes what the last versions don't
list.  The driver holds the list of shards, a hundred bytes each; rows are
counted by a scan that asks for no column, which reads footers only.

Defined results: rows are kept as they are - nulls, repeated rows, empty and
very long texts, any columns whatever their names; their order within a merged
file is not defined.  Shards of equal age are merged in order of their names.
An empty arrival commits a version without new shards.  Arrivals must have the
store's schema.  ``compact`` ends when no tier is crowded, and raises
``Conflict`` if other writers come first ``attempts`` times in a row.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET = 128 << 20
RUN = 4
GROWTH = 4
ROWS = 20_000
AT_ONCE = 64
#: Part files that a manifest names at most before a commit folds them.
PARTS = 100


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    """A file of the store: its name, bytes, rows, and the number of its first version."""

    name: str
    bytes: int
    rows: int
    born: int


def tier(size: int, growth: int = GROWTH) -> int:
    return int(math.log(max(size, 1), growth) + 1e-9)


def plan(shards: list[Shard], target: int = TARGET, run: int = RUN, growth: int = GROWTH) -> list[list[Shard]]:
    """The merges of one round: for each crowded tier, runs in order of age that fill a target-sized file."""
    tiers: dict[int, list[Shard]] = {}
    for shard in shards:
        if shard.bytes < target / 2:
            tiers.setdefault(tier(shard.bytes, growth), []).append(shard)
    merges = []
    for _, members in sorted(tiers.items()):
        if len(members) < run:
            continue
        group: list[Shard] = []
        for shard in sorted(members, key=lambda s: (s.born, s.name)):
            if group and sum(s.bytes for s in group) + shard.bytes > target:
                merges.append(group)
                group = []
            group.append(shard)
        merges.append(group)
    return [m for m in merges if len(m) > 1]


class ShardStore:
    """A folder of shards and manifests in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, run: int = RUN, growth: int = GROWTH, rows: int = ROWS):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.run, self.growth, self.rows = target, run, growth, rows
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._bytes = jvm.org.apache.commons.io.IOUtils.toByteArray

    # manifests

    def version(self) -> int:
        """The newest committed version, 0 before the first."""
        folder = self._path(self.root)
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def _json(self, name: str):
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(self._bytes(stream)))
        finally:
            stream.close()

    def _write(self, path, body) -> None:
        out = self._fs.create(path, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``schema`` and ``parts``: the shards of each part file."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "parts": {}}
        found = self._json(f"manifest-{version:08d}.json")
        return found | {"parts": {name: [Shard(**s) for s in self._json(name)] for name in found["parts"]}}

    def shards(self, version: int | None = None) -> list[Shard]:
        return [s for part in self.manifest(version)["parts"].values() for s in part]

    def _part(self, shards: list[Shard]) -> list[str]:
        if not shards:
            return []
        name = f"part-{uuid.uuid4().hex}.json"
        self._write(self._path(f"{self.root}/{name}"), [vars(s) for s in shards])
        return [name]

    def _commit(self, now: dict, schema: str, new: list[Shard], gone: frozenset[str] | set[str] = frozenset()) -> int:
        """Publish the version after ``now`` with ``new`` shards and without those in ``gone``, or raise ``Conflict`` if it exists."""
        whole = {n: p for n, p in now["parts"].items() if not any(s.name in gone for s in p)}
        if len(whole) >= PARTS:
            whole = {}
        rest = [s for n, p in now["parts"].items() if n not in whole for s in p if s.name not in gone]
        names = [*whole, *self._part(rest), *self._part(new)]
        ready = self._path(f"{self.root}/.ready-{uuid.uuid4().hex}")
        base = now["version"]
        self._write(ready, {"version": base + 1, "schema": schema, "parts": names})
        final = self._path(f"{self.root}/manifest-{base + 1:08d}.json")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(final.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        try:
            context.rename(self._fs.makeQualified(ready), self._fs.makeQualified(final), options)
        except Exception as error:
            self._fs.delete(ready, False)
            if self._fs.exists(final):
                raise Conflict(f"version {base + 1} exists") from error
            raise
        return base + 1

    # data

    def _written(self, folder: str, born: int) -> list[Shard]:
        """The shards of a finished write, with the rows that their footers count (no column is asked for)."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        files = [f for f in self._fs.listStatus(path) if f.getPath().getName().endswith(".parquet")]
        if not files:
            return []
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        counts = dict(self.spark.read.parquet(folder).groupBy(name).count().collect())
        short = folder.rsplit("/", 1)[1]
        return [
            Shard(f"{short}/{n}", int(f.getLen()), int(counts[n]), born)
            for f in sorted(files, key=lambda f: f.getPath().getName())
            if counts.get(n := f.getPath().getName())
        ]

    def append(self, arrival: DataFrame, attempts: int = 10) -> int:
        """Write ``arrival`` as shards of at most ``rows`` rows and commit them; returns the version."""
        schema = arrival.schema.json()
        folder = f"{self.root}/shards-{uuid.uuid4().hex}"
        arrival.write.option("maxRecordsPerFile", self.rows).option("compression", "zstd").parquet(folder)
        new = None
        for _ in range(attempts):
            now = self.manifest()
            if now["schema"] and StructType.fromJson(json.loads(now["schema"])).simpleString() != arrival.schema.simpleString():
                raise ValueError("the arrival's schema is not the store's")
            new = self._written(folder, now["version"] + 1) if new is None else new
            try:
                return self._commit(now, now["schema"] or schema, new)
            except Conflict:
                continue
        raise Conflict("too many writers")

    def _read(self, shards: list[Shard], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.root}/{s.name}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        now = self.manifest(version)
        if not now["schema"]:
            raise ValueError("the store is empty")
        return self._read([s for part in now["parts"].values() for s in part], now["schema"])

    def _merge(self, merges: list[list[Shard]], schema: str, born: int) -> list[Shard]:
        """One file for each group; a job writes up to ``AT_ONCE`` groups, one task each."""
        out = []
        for at in range(0, len(merges), AT_ONCE):
            parts = [self._read(group, schema).coalesce(1) for group in merges[at : at + AT_ONCE]]
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.union(part)
            folder = f"{self.root}/shards-{uuid.uuid4().hex}"
            whole.write.option("compression", "zstd").parquet(folder)
            out += self._written(folder, born)
        return out

    def compact(self, attempts: int = 10) -> int:
        """Merge until no tier is crowded; every round commits and leaves fewer shards.  Returns the version."""
        lost = 0
        while True:
            now = self.manifest()
            merges = plan([s for part in now["parts"].values() for s in part], self.target, self.run, self.growth)
            if not merges:
                return now["version"]
            merged = self._merge(merges, now["schema"], now["version"] + 1)
            gone = {s.name for group in merges for s in group}
            if sum(s.rows for s in merged) != sum(s.rows for group in merges for s in group):
                raise RuntimeError("a merge changed the number of rows")
            try:
                self._commit(now, now["schema"], merged, gone)
                lost = 0
            except Conflict:
                lost += 1
                if lost == attempts:
                    raise

    def vacuum(self, keep: int = 1) -> int:
        """Delete shards that none of the last ``keep`` versions lists, and older manifests; returns how many shards went.

        Run it when no append or merge is under way: their shards are not listed yet.
        """
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        parts = {n: p for v in kept for n, p in self.manifest(v)["parts"].items()}
        listed = {s.name for part in parts.values() for s in part}
        gone = 0
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            old = name.startswith("manifest-") and int(name[9:-5]) not in kept
            if old or (name.startswith("part-") and name not in parts):
                self._fs.delete(status.getPath(), False)
            if not status.isDirectory():
                continue
            files = [f.getPath().getName() for f in self._fs.listStatus(status.getPath())]
            dead = [f for f in files if f.endswith(".parquet") and f"{name}/{f}" not in listed]
            gone += len(dead)
            if all(not f.endswith(".parquet") or f in dead for f in files):
                self._fs.delete(status.getPath(), True)
            else:
                for f in dead:
                    self._fs.delete(self._path(f"{self.root}/{name}/{f}"), False)
        return gone
