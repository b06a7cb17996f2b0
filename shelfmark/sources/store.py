"""Generations of tables in a folder: written aside, then named by a pointer that is made once, so readers see whole ones.

A generation is a set of named Parquet tables and some facts. Each has its own pointer file, numbered; the generation in force
is that of the highest whole pointer of the format that this code writes. A pointer is created only where there is none, so
of two writers that go on from the same generation one gets it and the other is told. What a killed writer leaves is no
pointer, or one that breaks off, and counts for nothing. A reader keeps the generation that it opened, as nothing is changed in place.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

FORMAT = 1
POINTERS, DATA = "generations", "data"


class Superseded(RuntimeError):
    """Another writer went on from the same generation first."""


@dataclass(frozen=True)
class Generation:
    """number 0 is the empty one. tables: of each name the folders whose rows together are the table, and its schema."""

    number: int
    tables: dict[str, dict] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)

    def paths(self) -> set[str]:
        return {p for t in self.tables.values() for p in t["paths"]}


class Store:
    def __init__(self, spark: SparkSession, root: str, format: int = FORMAT) -> None:
        self.spark, self.root, self.format = spark, root.rstrip("/"), format

    def _hadoop(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        place, fs = self._hadoop(f"{self.root}/{POINTERS}")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(place)) if fs.exists(place) else []

    def _pointer(self, number: int) -> dict | None:
        place, fs = self._hadoop(f"{self.root}/{POINTERS}/{number}.json")
        stream = fs.open(place)
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        try:
            found = json.loads(raw)
        except ValueError:  # its writer was killed
            return None
        return found if isinstance(found, dict) and "tables" in found else None

    def current(self) -> Generation | None:
        """The generation in force, the empty one if there is none yet, or None if the last whole one is of another format: to be built anew."""
        for number in reversed(self._pointers()):
            found = self._pointer(number)
            if found is not None:
                return Generation(number, found["tables"], found["facts"]) if found["format"] == self.format else None
        return Generation(0)

    def read(self, generation: Generation, name: str) -> DataFrame | None:
        """A table of a generation; None if it has none of that name."""
        table = generation.tables.get(name)
        if table is None:
            return None
        rows = self.spark.read.schema(table["schema"])
        return rows.parquet(*table["paths"]) if table["paths"] else self.spark.createDataFrame([], table["schema"])

    def written(self, rows: DataFrame) -> dict:
        """A table written aside, to be named by a generation."""
        path = f"{self.root}/{DATA}/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        return {"paths": [path], "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)}

    def commit(self, base: Generation | None, tables: dict[str, dict | DataFrame], facts: dict | None = None) -> Generation:
        """The generation after base (None: after whatever is there, of other formats too) with these tables, now in force.

        A DataFrame is written first; a table as `written` gives it, or as base has it, is named as it is. Superseded, and
        nothing is changed, if another writer has gone on from base.
        """
        named = {n: self.written(t) if isinstance(t, DataFrame) else t for n, t in tables.items()}
        known = self._pointers()
        after = base.number if base is not None else known[-1] if known else 0
        if any(n > after and self._pointer(n) is not None for n in known):
            raise Superseded(f"generation {after} of {self.root} is not the last")
        number = max([after, *known]) + 1  # pointers that break off keep their numbers
        made = Generation(number, named, facts or {})
        place, fs = self._hadoop(f"{self.root}/{POINTERS}/{number}.json")
        body = json.dumps({"format": self.format, "tables": named, "facts": made.facts}, sort_keys=True).encode()
        try:
            stream = fs.create(place, False)  # fails where the file is there
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Superseded(f"generation {number} of {self.root} was made by another writer") from e
            raise
        stream.write(bytearray(body))
        stream.close()
        return made

    def sweep(self, keep: int = 2) -> list[str]:
        """Delete folders that the last `keep` whole generations don't name, and their pointers before those; what is deleted.

        Only where no writer is at work and no reader is left of older generations.
        """
        whole = [(n, g) for n in self._pointers() if (g := self._pointer(n)) is not None][-keep:]
        named = {p for _, g in whole for t in g["tables"].values() for p in t["paths"]}
        place, fs = self._hadoop(f"{self.root}/{DATA}")
        gone = []
        for status in fs.listStatus(place) if fs.exists(place) else []:
            if not any(p.endswith("/" + status.getPath().getName()) for p in named):
                fs.delete(status.getPath(), True)
                gone.append(status.getPath().getName())
        for n in self._pointers():
            if whole and n < whole[0][0]:
                fs.delete(self._hadoop(f"{self.root}/{POINTERS}/{n}.json")[0], False)
        return gone
