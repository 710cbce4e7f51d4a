"""The catalog: names of tables, and where their rows are.

A mapping is text: a JSONPath ($.data.items) in the table's own file, or file.json:$.path, or
folder:$.path; further lines:path (JSON lines) and parquet:path. Mappings are kept in a JSON file. DataFrames
can be registered beside them; those and Parquet tables have a type, all others are looked up row by row.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.errors import CatalogError
from vellum.operators.relation import Relation, from_frame, from_variants
from vellum.sources import json_files


class Mappings:
    """Named mappings in a JSON file; every change is saved at once."""

    def __init__(self, path: str | Path | None = None):
        self.path = Path(path) if path else None
        self.entries: dict[str, str] = {}
        if self.path and self.path.exists():
            try:
                read = json.loads(self.path.read_text(encoding="utf-8"))
            except ValueError as e:
                raise CatalogError(f"Failed to load mappings from {self.path}: {e}") from e
            if not isinstance(read, dict):
                raise CatalogError(f"Failed to load mappings from {self.path}: not an object")
            self.entries = {str(k): str(v) for k, v in read.items()}

    def save(self) -> None:
        if self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.write_text(json.dumps(self.entries, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")

    def add(self, name: str, mapping: str) -> None:
        if not name or not name.strip():
            raise CatalogError("A table name can't be blank")
        if not mapping or not mapping.strip():
            raise CatalogError("A JSONPath can't be blank")
        self.entries[name.strip()] = mapping.strip()
        self.save()

    def get(self, name: str) -> str | None:
        return self.entries.get(name)

    def has(self, name: str) -> bool:
        return name in self.entries

    def all(self) -> dict[str, str]:
        return dict(self.entries)

    def file_of(self, name: str) -> str | None:
        """What stands before the path; None where the file is the table's own."""
        return split(self.entries[name])[0] if name in self.entries else None

    def path_of(self, name: str) -> str | None:
        return split(self.entries[name])[1] if name in self.entries else None

    def listing(self) -> str:
        if not self.entries:
            return "No table mappings defined."
        return "\n".join(["Table mappings:", *(f"  {n} -> {self.entries[n]}" for n in sorted(self.entries))])


def split(mapping: str) -> tuple[str | None, str]:
    """File and JSONPath of a mapping, at its first colon (behind a scheme); a mapping that begins with $ has no file."""
    scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://|(?:file|hdfs):/", mapping)
    begin = scheme.end() if scheme else 0
    if mapping.startswith("$") or (at := mapping.find(":", begin)) < 0:
        return None, mapping
    return mapping[:at], mapping[at + 1 :]


class Catalog:
    def __init__(self, spark: SparkSession, mappings: Mappings | None = None, data_dir: str = "."):
        self.spark, self.mappings, self.data_dir = spark, mappings or Mappings(), data_dir
        self.frames: dict[str, DataFrame] = {}
        self.parquet: dict[str, str] = {}

    def register(self, name: str, df: DataFrame, json_columns: dict[str, str | None] | None = None) -> None:
        """A DataFrame as a table; json_columns: texts to be read as JSON, by a schema or (None) row by row."""
        for column, schema in (json_columns or {}).items():
            df = df.withColumn(column, F.from_json(column, schema) if schema else F.try_parse_json(column))
        self.frames[name] = df

    def register_folder(self, path: str, names: list[str]) -> None:
        """Parquet tables path/name.parquet, each opened when a query scans it."""
        self.parquet |= {n: f"{path.rstrip('/')}/{n}.parquet" for n in names}

    def _absolute(self, path: str) -> str:
        return path if path.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else f"{self.data_dir.rstrip('/')}/{path}"

    def scan(self, name: str, binding: str, serial: int) -> Relation:
        if name in self.frames:
            return from_frame(self.frames[name], binding, serial)
        if name in self.parquet:
            return from_frame(self.spark.read.parquet(self.parquet[name]), binding, serial)
        mapping = self.mappings.get(name)
        if mapping is None:
            raise CatalogError(f"Table {name} has no mapping; --add-mapping makes one")
        file, path = split(mapping)
        if file == "parquet":
            return from_frame(self.spark.read.parquet(self._absolute(path)), binding, serial)
        if file == "lines":
            return from_variants(json_files.lines(self.spark, self._absolute(path)), binding, "row", (), serial)
        where = self._absolute(file) if file is not None else self._own_file(name)
        return from_variants(json_files.rows(self.spark, json_files.files_of(self.spark, where), path), binding, "row", ("file", "at"), serial)

    def _own_file(self, name: str) -> str:
        """<table>.json in the data folder, else a file of that name in other case."""
        wanted = f"{name}.json"
        there = json_files.listing(self.spark, self.data_dir)
        found = wanted if wanted in there else next((f for f in there if f.lower() == wanted.lower()), None)
        if found is None:
            raise CatalogError(f"There is no file {self._absolute(wanted)}")
        return self._absolute(found)
