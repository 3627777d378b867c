"""GeoJSON out: each task writes a whole collection of its own, a commit makes them the table, an abort leaves nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from verdant.shipping import ship

NAME = "geojson-features"


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class GeoJsonSource(DataSource):
    """Rows of (properties, geometry), both JSON text, as features in files of the folder ``path``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return GeoJsonWriter(self.options["path"], overwrite)


class GeoJsonWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path if "://" in path else f"file://{path}", overwrite, uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        store, root = fs.FileSystem.from_uri(self.path)
        return store, root, f"{root}/_temporary-{self.run}"

    def write(self, iterator: Iterator) -> Written:
        """One valid collection, row by row; a retried task writes a file of another name."""
        store, _, folder = self._folder()
        store.create_dir(folder, recursive=True)
        name, rows = f"part-{uuid.uuid4().hex}.geojson", 0
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            out.write(b'{"type":"FeatureCollection","features":[')
            for row in iterator:
                properties, geometry = (json.dumps(json.loads(x), ensure_ascii=False, separators=(",", ":")) if x is not None else "null" for x in (row["properties"], row["geometry"]))
                out.write(f'{"," if rows else ""}\n{{"type":"Feature","properties":{properties},"geometry":{geometry}}}'.encode())
                rows += 1
            out.write(b"\n]}\n")
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """Only names go through the driver: those of successful tasks become the table's files."""
        store, root, folder = self._folder()
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.base_name.startswith("part-"):
                    store.delete_file(info.path)
        for m in messages:
            if m is not None and m.rows:
                store.move(f"{folder}/{m.file}", f"{root}/{m.file}")
        store.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, folder = self._folder()
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


def write_geojson(df: DataFrame, path: str, properties: str = "properties", geometry: str = "geometry", mode: str = "overwrite") -> None:
    """``df`` as GeoJSON collections in the folder ``path``, one for each task that has rows; text that isn't JSON fails the write, which then leaves nothing."""
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(GeoJsonSource)
    df.selectExpr(f"`{properties}` as properties", f"`{geometry}` as geometry").write.format(NAME).option("path", path).mode(mode).save()
