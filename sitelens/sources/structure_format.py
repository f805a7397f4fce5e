"""Structure files as a format of Spark: ``register(spark)``, then ``spark.read.format("structure_files").load(folder)``.

Options: ``table`` is ``whole`` (a row for each file: the structure's scalars and its ``atoms`` as an array; the default),
``atoms`` (a row for each atom) or ``structures``; ``pattern`` the files' names (``*.cif``; ``.gz`` is unpacked);
``partition_bytes`` how much a task parses (8 MB, a file is never cut). A schema of some of the table's columns, in any
order, makes only those. ``ids`` (ids with commas between) and ``cohort`` (a list file, or a folder of them) choose files:
no other is opened. They are options, not pushed filters, as Spark 4.1 shares a Python source's pushed filters between all
scans of one loaded frame, so that a self-join of filtered and whole rows loses some.

Defined cases: the id is the file's name in lower case without ``_final`` and ending, so it is never NULL; two files of one
id are two rows; what a file lacks is NULL, or no atoms; bytes that are no UTF-8 become U+FFFD; files of no bytes and names
that start with '.' or '_', or lie in such a folder, are left out; no files give no rows; an unknown table or column is an error.
"""

from __future__ import annotations

import fnmatch
import gzip
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .. import schemas
from ..shared import address
from .readers import atoms_of, parse_cif, structure_of

NAME = "structure_files"
_ATOM = schemas.ATOMS.removeprefix("pdb_id string, ")
TABLES = {"whole": f"{schemas.STRUCTURES}, atoms array<struct<{_ATOM.replace(' ', ':').replace(',:', ',')}>>", "atoms": schemas.ATOMS, "structures": schemas.STRUCTURES}
_PLACE = {table: {c.split()[0]: i for i, c in enumerate(s.split(", "))} for table, s in (("atoms", schemas.ATOMS), ("structures", schemas.STRUCTURES))}


def _listed(store, root: str) -> list:
    """The files at or below a path that hold bytes and aren't hidden, by path."""
    from pyarrow import fs

    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    shown = lambda f: not any(part[0] in "._" for part in f.path[len(root) :].split("/") if part)
    return sorted((f for f in found if f.type == fs.FileType.File and f.size and shown(f)), key=lambda f: f.path)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class StructureFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _table(self) -> str:
        table = self.options.get("table", "whole")
        if table not in TABLES:
            raise ValueError(f"table {table!r} is none of {', '.join(TABLES)}")
        return table

    def schema(self) -> str:
        return TABLES[self._table()]

    def reader(self, schema: StructType) -> StructureReader:
        return StructureReader(self._table(), schema.names, self.options)


class StructureReader(DataSourceReader):
    def __init__(self, table: str, names: list[str], options: dict[str, str]) -> None:
        self.table, self.names, self.folder = table, names, address(options["path"])
        self.pattern, self.partition_bytes = options.get("pattern", "*.cif"), int(options.get("partition_bytes", 8 << 20))
        self.ids, self.cohort = options.get("ids"), address(options["cohort"]) if "cohort" in options else None
        place = _PLACE["atoms" if table == "atoms" else "structures"]
        unknown = [n for n in names if n not in place and not (table == "whole" and n == "atoms")]
        if unknown:
            raise ValueError(f"the table {table} has no column {', '.join(unknown)}")
        self.place = [place.get(n) for n in names]

    def _wanted(self) -> set[str] | None:
        """The ids asked for, None for all; of a list's line the first token counts, up to its '_'."""
        from pyarrow import fs

        asked = None if self.ids is None else {i.strip().lower() for i in self.ids.split(",")}
        if self.cohort is not None:
            store, root = fs.FileSystem.from_uri(self.cohort)
            lines = []
            for f in _listed(store, root):
                with store.open_input_stream(f.path) as s:
                    lines += s.read().decode("utf-8", "replace").splitlines()
            tokens = (x.split()[0] for x in lines if x.strip() and not x.strip().startswith("#"))
            listed = {x.split("_")[0].lower() for x in tokens} - {""}
            asked = listed if asked is None else asked & listed
        return asked

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        wanted = self._wanted()
        out, size = [], 0
        for f in _listed(store, root):
            pdb_id = re.sub(r"(_final)?\.[^.]*(\.gz)?$", "", f.base_name).lower()
            if not fnmatch.fnmatchcase(f.base_name, self.pattern) or (wanted is not None and pdb_id not in wanted):
                continue
            if not out or size + f.size > self.partition_bytes:
                out.append(Files([]))
                size = 0
            out[-1].files.append((f.path, pdb_id))
            size += f.size
        return out or [Files([])]

    def _rows(self, text: str, pdb_id: str) -> Iterator[tuple]:
        cif = parse_cif(text)
        if self.table == "atoms":
            for row in atoms_of(cif, pdb_id):
                yield tuple(row[k] for k in self.place)
            return
        row = structure_of(cif, pdb_id)
        atoms = [r[1:] for r in atoms_of(cif, pdb_id)] if "atoms" in self.names else None
        yield tuple(atoms if k is None else row[k] for k in self.place)

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        for path, pdb_id in partition.files:
            with store.open_input_stream(path, compression=None) as f:
                raw = f.read()
            yield from self._rows((gzip.decompress(raw) if path.endswith(".gz") else raw).decode("utf-8", "replace"), pdb_id)


def read_whole(spark: SparkSession, path: str, cohort: str | None = None, pattern: str = "*.cif") -> DataFrame:
    """A row for each structure file below a path, parsed once; with a cohort's list file only its structures."""
    register(spark)
    read = spark.read.format(NAME).option("pattern", pattern)
    return (read if cohort is None else read.option("cohort", cohort)).load(path)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(StructureFiles)


def atoms_in(whole: DataFrame) -> DataFrame:
    return whole.select("pdb_id", F.inline("atoms"))


def structures_in(whole: DataFrame) -> DataFrame:
    return whole.drop("atoms")
