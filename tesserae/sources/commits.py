"""Tables whose parts become visible together: folders of Parquet files under a numbered log of commits.

A commit writes each of its parts (payload, metadata) to a folder of its own and then makes one small log entry that
names the folders. Readers list the log and read these folders alone, so files of a run that died are never seen, a
unit is there with all its parts or not at all, and a run that is repeated under its id changes nothing. An entry's
number is taken by creating its file, which fails if another writer has it; an entry that is torn names nothing.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the session names for checkpoints; in local mode without one, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tesserae-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Entry:
    """A commit: its run, whether it replaces what was there, and of each part the folder, the schema and the partition columns."""

    number: int
    run: str
    replaces: bool
    parts: dict[str, tuple[str, dict, list[str]]]

    def text(self) -> str:
        return json.dumps({"run": self.run, "replaces": self.replaces, "parts": self.parts})


@dataclass
class Table:
    """Parts under one root, with their log in `log`."""

    spark: SparkSession
    root: str

    def path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def fs(self):
        return self.path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self) -> list[Entry]:
        """Whole entries in order; of several for one run the first."""
        if not self.fs().exists(self.path("log")):
            return []
        rows = self.spark.read.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{self.root}/log").select("value", F.input_file_name().alias("at")).collect()
        found: dict[str, Entry] = {}
        for r in sorted(rows, key=lambda r: r["at"]):
            try:
                e = json.loads(r["value"])
            except ValueError:  # torn: no beginning of an object is JSON itself
                continue
            found.setdefault(e["run"], Entry(int(r["at"].rpartition("/")[2].removesuffix(".json")), e["run"], e["replaces"], e["parts"]))
        return list(found.values())

    def live(self) -> list[Entry]:
        """Entries from the last that replaces what was before."""
        every = self.entries()
        first = max((i for i, e in enumerate(every) if e.replaces), default=0)
        return every[first:]

    def append(self, run: str, replaces: bool, parts: dict[str, tuple[str, dict, list[str]]]) -> Entry:
        """Makes the log entry, under the first number that is free."""
        fs = self.fs()
        fs.mkdirs(self.path("log"))
        number = max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(self.path("log")) if s.getPath().getName().endswith(".json")), default=-1) + 1
        while True:
            entry = Entry(number, run, replaces, parts)
            try:
                out = fs.create(self.path(f"log/{number:012d}.json"), False)
            except Exception as e:
                if "AlreadyExists" not in str(e):
                    raise
                number += 1
                continue
            out.write(bytearray(entry.text().encode()))
            out.close()
            return entry

    def commit(self, parts: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], run: str | None = None, replaces: bool = False, partition_by: dict[str, Sequence[str]] | None = None) -> bool:
        """Writes the parts in order and makes them visible at once; False if the run is there already.

        A part given as a function gets the parts written before it, as they were stored, so nothing is worked out twice.
        """
        run = run or uuid.uuid4().hex
        if any(e.run == run for e in self.entries()):
            return False
        folder, stored, named = f"commit_={run}-{uuid.uuid4().hex[:8]}", {}, {}
        for name, part in parts.items():
            df = part(stored) if callable(part) else part
            by = list((partition_by or {}).get(name, ()))
            (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.root}/{name}/{folder}")
            # Partition columns come last, and may be null.
            schema = StructType([*(f for f in df.schema.fields if f.name not in by), *(f for f in df.schema.fields if f.name in by)])
            named[name] = (folder, schema.jsonValue(), by)
            stored[name] = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{folder}")
        self.append(run, replaces, named)
        return True

    def read(self, part: str) -> DataFrame | None:
        """All rows of a part in live commits; None if there is none. Columns of the last commit; those that earlier ones lack are null."""
        live = [e.parts[part] for e in self.live() if part in e.parts]
        if not live:
            return None
        schema = StructType.fromJson(live[-1][1])
        groups: dict[tuple[str, ...], list[str]] = {}
        for folder, _, by in live:
            groups.setdefault(tuple(by), []).append(f"{self.root}/{part}/{folder}")
        frames = [self.spark.read.schema(schema).option("basePath", f"{self.root}/{part}").parquet(*paths).select(*schema.names) for paths in groups.values()]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def vacuum(self) -> int:
        """Deletes folders that no live commit names; their number. Not while anybody writes."""
        fs, kept, gone = self.fs(), {(p, folder) for e in self.live() for p, (folder, *_) in e.parts.items()}, 0
        for part in fs.listStatus(self.path("")) if fs.exists(self.path("")) else ():
            name = part.getPath().getName()
            if name == "log" or not part.isDirectory():
                continue
            for s in fs.listStatus(part.getPath()):
                if (name, s.getPath().getName()) not in kept:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone
