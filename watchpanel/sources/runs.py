"""Outputs of one run, visible together or not at all.

Every output of a run is written to a folder of its own under `<base>/<run>/`.  What makes the run
visible is one small file, written last: the manifest, which names the outputs.  Readers look for
manifests only, so a run that was stopped anywhere before leaves nothing that is read.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


@dataclass
class RunWriter:
    """A run being written: `path` hands out folders, `commit` shows them all."""

    spark: SparkSession
    base: str
    # ids sort by the time the run began
    run: str = field(default_factory=lambda: f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}")
    outputs: dict[str, str] = field(default_factory=dict)

    def path(self, name: str) -> str:
        """Where output `name` goes."""
        if name in self.outputs or name == MANIFEST:
            raise ValueError(f"output {name} is there already")
        self.outputs[name] = name
        return f"{self.base}/{self.run}/{name}"

    def commit(self, facts: Mapping[str, object] | None = None) -> str:
        """Write the manifest, beside the outputs first and then renamed; returns the run's id."""
        body = json.dumps({"run": self.run, "outputs": self.outputs, "facts": dict(facts or {})}, ensure_ascii=False, default=str)
        for name in self.outputs:
            fs, folder = _fs(self.spark, f"{self.base}/{self.run}/{name}")
            if not fs.exists(folder):
                raise FileNotFoundError(f"output {name} was not written")
        fs, draft = _fs(self.spark, f"{self.base}/{self.run}/.{MANIFEST}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        _, final = _fs(self.spark, f"{self.base}/{self.run}/{MANIFEST}")
        if not fs.rename(draft, final):
            raise FileExistsError(f"run {self.run} is committed already")
        return self.run


@dataclass(frozen=True)
class CommittedRun:
    run: str
    paths: Mapping[str, str]
    facts: Mapping[str, object]


def committed_runs(spark: SparkSession, base: str) -> list[str]:
    """Ids of the runs with a manifest, oldest first."""
    fs, folder = _fs(spark, base)
    if not fs.exists(folder):
        return []
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/*/{MANIFEST}")) or []
    return sorted(status.getPath().getParent().getName() for status in found)


def open_run(spark: SparkSession, base: str, run: str | None = None) -> CommittedRun:
    """A committed run, the latest one by default."""
    known = committed_runs(spark, base)
    if not known or (run is not None and run not in known):
        raise FileNotFoundError(f"no committed run {run or ''} in {base}")
    run = run or known[-1]
    body = json.loads(spark.read.text(f"{base}/{run}/{MANIFEST}", wholetext=True).first()[0])
    return CommittedRun(run, {n: f"{base}/{run}/{p}" for n, p in body["outputs"].items()}, body["facts"])


def drop_unfinished(spark: SparkSession, base: str, older_than: dt.timedelta) -> list[str]:
    """Delete folders of runs without a manifest that began long ago; returns their ids."""
    fs, folder = _fs(spark, base)
    if not fs.exists(folder):
        return []
    known = set(committed_runs(spark, base))
    latest = f"{dt.datetime.now(dt.timezone.utc) - older_than:%Y%m%dT%H%M%S%f}"
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    gone = sorted(n for n in names if n not in known and n < latest)
    for name in gone:
        fs.delete(_fs(spark, f"{base}/{name}")[1], True)
    return gone
