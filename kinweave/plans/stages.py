"""A resumable chain of stages: what each writes is named by all that it depends on, so nothing stale is ever reused."""

from __future__ import annotations

import hashlib
import inspect
import json
import platform
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from importlib.resources import files as package_files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Subpackages whose modules a stage may run.
CODE = ("functions", "operators", "plans", "sources")


def code_digest(package=None) -> str:
    """Of every module that a stage may run, by name and content; package: its folder, where it isn't the one imported."""
    package = package_files(__package__.split(".")[0]) if package is None else package
    total = hashlib.sha256()
    for part in CODE:
        for file in sorted((f for f in (package / part).iterdir() if f.name.endswith(".py")), key=lambda f: f.name):
            total.update(f"{part}/{file.name}\0".encode() + hashlib.sha256(file.read_bytes()).digest())
    return total.hexdigest()


def file_identity(spark: SparkSession, *paths: str) -> str:
    """Of the files under some paths: their names, lengths and times of change. Summed on the executors; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    each = F.xxhash64("path", "length", "modificationTime")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.bit_xor(each).alias("x"), F.sum(each.cast("decimal(38,0)")).alias("s")).first()
    return ":".join(map(str, row))


class Store:
    """A folder in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self._conf), path

    def exists(self, name: str) -> bool:
        files, path = self._path(name)
        return files.exists(path)

    def create(self, name: str) -> bool:
        """Makes an empty file; False if it is there already."""
        files, path = self._path(name)
        files.mkdirs(path.getParent())
        return files.createNewFile(path)

    def delete(self, name: str) -> None:
        files, path = self._path(name)
        files.delete(path, True)

    def write(self, name: str, text: str) -> None:
        """Replaces a small file by renaming a new one over it, which is one step where the file system has such a rename (HDFS)."""
        files, path = self._path(name)
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        part = hadoop.Path(f"{self.root}/{name}.{uuid.uuid4().hex}.part")
        out = files.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        how = getattr(hadoop, "Options$Rename")
        options = gateway.new_array(how, 1)
        options[0] = how.OVERWRITE
        whole = [files.makeQualified(p) for p in (part, path)]
        hadoop.FileContext.getFileContext(whole[1].toUri(), self._conf).rename(*whole, options)

    def read(self, name: str) -> str:
        files, path = self._path(name)
        stream = files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


class Busy(RuntimeError):
    """Another run holds the stage."""


@dataclass(frozen=True)
class Stage:
    """name; make(inputs, settings) -> DataFrame, given the stages it needs by name; the settings that matter to it; smoke settings."""

    name: str
    make: Callable[[dict[str, DataFrame], dict], DataFrame]
    needs: tuple[str, ...] = ()
    settings: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    gate: Callable[[DataFrame], None] | None = None


@dataclass
class Chain:
    """Stages in order, over source tables (name -> DataFrame, with a text that identifies each), in a store."""

    store: Store
    stages: list[Stage]
    sources: dict[str, DataFrame]
    identities: dict[str, str]
    settings: dict = field(default_factory=dict)
    code: str = field(default_factory=code_digest)

    def stage(self, name: str) -> Stage:
        for s in self.stages:
            if s.name == name:
                return s
        raise KeyError(f"no stage {name!r}; there are {[s.name for s in self.stages]}")

    def fingerprint(self, name: str) -> str:
        """Of the package's code, the stage's own, its settings and, through theirs, all that it needs."""
        if name in self.sources:
            return hashlib.sha256(f"{name}:{self.identities[name]}".encode()).hexdigest()[:16]
        s = self.stage(name)
        parts = [s.name, self.code, inspect.getsource(s.make), json.dumps({k: self.settings.get(k) for k in s.settings}, sort_keys=True), *[self.fingerprint(n) for n in s.needs]]
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]

    def folder(self, name: str) -> str:
        return f"{name}/{self.fingerprint(name)}"

    def done(self, name: str) -> bool:
        return name in self.sources or self.store.exists(f"{self.folder(name)}/_SUCCESS")

    def read(self, name: str) -> DataFrame:
        if name in self.sources:
            return self.sources[name]
        if not self.done(name):
            raise RuntimeError(f"stage {name} hasn't run with these inputs and settings; next is {self.next()}")
        return self.store.spark.read.parquet(f"{self.store.root}/{self.folder(name)}")

    @contextmanager
    def lock(self, name: str):
        held = f"locks/{name}"
        if not self.store.create(held):
            raise Busy(f"stage {name} is running, or was ended: delete {self.store.root}/{held} if it was")
        try:
            yield
        finally:
            self.store.delete(held)

    def run(self, name: str) -> bool:
        """Runs a stage unless its output is there; True if it ran."""
        s = self.stage(name)
        if self.done(name):
            return False
        with self.lock(name):
            began = time.time()
            out = s.make({n: self.read(n) for n in s.needs}, self.settings)
            writer = out.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(*s.partition_by) if s.partition_by else writer).parquet(f"{self.store.root}/{self.folder(name)}")
            if s.gate:
                try:
                    s.gate(self.read(name))
                except Exception:
                    self.store.delete(self.folder(name))
                    raise
            self.log(f"{name}/{self.fingerprint(name)}", f"{name} took {time.time() - began:.1f} s")
        return True

    def run_all(self) -> list[str]:
        return [s.name for s in self.stages if self.run(s.name)]

    def status(self) -> list[tuple[str, str, bool]]:
        return [(s.name, self.fingerprint(s.name), self.done(s.name)) for s in self.stages]

    def next(self) -> str | None:
        """The first stage that hasn't run though all that it needs has."""
        return next((s.name for s in self.stages if not self.done(s.name) and all(map(self.done, s.needs))), None)

    def log(self, marker: str, text: str) -> bool:
        """Adds a line to the progress log, once for each marker."""
        lines = self.store.read("progress.jsonl") if self.store.exists("progress.jsonl") else ""
        if any(json.loads(x)["marker"] == marker for x in lines.splitlines()):
            return False
        self.store.write("progress.jsonl", lines + json.dumps({"marker": marker, "text": text}) + "\n")
        return True


def doctor(spark: SparkSession) -> dict:
    """What the session runs on."""
    context = spark.sparkContext
    conf = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes", "spark.checkpoint.dir")}
    return {"python": platform.python_version(), "spark": spark.version, "master": context.master, "parallelism": context.defaultParallelism, "settings": conf, "works": spark.range(1000).selectExpr("sum(id) s").first().s == 499500}
