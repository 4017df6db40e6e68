"""One self-describing file per scene: bands, masks and labels of any size with their units, CRS and version.

A file is an Arrow stream of the scene's pixels, so a scene is read and written batch by batch; what columns are and in which units
stands in the file's schema. Tasks write below a folder of their own, and the files move to their places when the job is done,
so lost tasks leave nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

FORMAT, VERSION, KEY = "scene_bundle", "1", b"scene_bundle"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    system, at = opened(path)
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name.endswith(".arrow"))


def facts(schema: pa.Schema) -> dict:
    """What a bundle says of itself; unknown versions raise."""
    said = json.loads((schema.metadata or {}).get(KEY, b"{}"))
    if said.get("version") != VERSION:
        raise ValueError(f"bundle version {said.get('version')} is not known")
    return said


def schema_at(path: str, file: str) -> pa.Schema:
    system, _ = opened(path)
    with system.open_input_stream(file) as f:
        return ipc.open_stream(f).schema


@dataclass
class File(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.fieldNames()

    def partitions(self) -> list[File]:
        return [File(f) for f in files_of(self.path)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = opened(self.path)
        with system.open_input_stream(partition.path) as f:
            stream = ipc.open_stream(f)
            facts(stream.schema)
            for batch in stream:
                yield batch.select(self.names)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file is, and its name


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.said = {"version": VERSION, "crs": options.get("crs", ""), "units": json.loads(options.get("units", "{}")), "kinds": json.loads(options.get("kinds", "{}"))}
        self.schema, self.folder = to_arrow_schema(schema), f"_tmp-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = opened(self.path)
        mine = f"{top}/{self.folder}/{uuid.uuid4().hex}"
        system.create_dir(mine, recursive=True)
        schema = self.schema.with_metadata({KEY: json.dumps(self.said).encode()})
        files, scene, out = [], None, None
        for batch in iterator:
            scenes = batch["scene_id"].to_pylist()
            at = 0
            while at < len(scenes):
                to = at + 1
                while to < len(scenes) and scenes[to] == scenes[at]:
                    to += 1
                if out is None or scenes[at] != scene:
                    if out is not None:
                        out.close()
                    scene = scenes[at]
                    files.append((f"{mine}/{len(files)}.arrow", f"scene={scene}.arrow"))
                    out = ipc.new_stream(system.open_output_stream(files[-1][0]), schema)
                part = batch.slice(at, to - at)
                out.write_batch(pa.RecordBatch.from_arrays([part[n].cast(t) for n, t in zip(schema.names, schema.types, strict=True)], schema=schema))
                at = to
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        system, top = opened(self.path)
        made = [f for m in messages if m is not None for f in m.files]
        if len({name for _, name in made}) < len(made):
            self.abort(messages)
            raise ValueError("rows of one scene came in several pieces: write with write_bundles")
        if self.overwrite:
            for old in files_of(self.path):
                system.delete_file(old)
        for at, name in made:
            system.move(at, f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, top = opened(self.path)
        if system.get_file_info(f"{top}/{self.folder}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.folder}")


class SceneBundle(DataSource):
    """Format scene_bundle: a folder with one file per scene. Options when writing: crs, units and kinds (JSON by column)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no scene in {self.options['path']}")
        found = schema_at(self.options["path"], files[0])
        facts(found)
        return from_arrow_schema(found)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema, overwrite)


def write_bundles(px: DataFrame, path: str, crs: str = "", units: dict[str, str] | None = None, kinds: dict[str, str] | None = None, mode: str = "append") -> None:
    """Write pixels (scene_id, row, col, bands, masks, labels) as bundles; a scene is one task's. kinds: image, mask or label by
    column. A scene that is there already is replaced."""
    px.sparkSession.dataSource.register(SceneBundle)
    ready = px.repartition("scene_id").sortWithinPartitions("scene_id", "row", "col")
    writer = ready.write.format(FORMAT).mode(mode).option("crs", crs).option("units", json.dumps(units or {})).option("kinds", json.dumps(kinds or {}))
    writer.save(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of all bundles of a folder; one task a scene."""
    spark.dataSource.register(SceneBundle)
    return spark.read.format(FORMAT).load(path)


def bundle_facts(path: str) -> dict[str, dict]:
    """Version, CRS, units and kinds of the columns, for each file's name."""
    return {f.rsplit("/", 1)[-1]: facts(schema_at(path, f)) for f in files_of(path)}
