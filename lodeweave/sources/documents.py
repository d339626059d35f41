"""A sink that writes results as one document, or as parts with a manifest, by a commit protocol.

Tasks write JSON lines below a staging folder of the run. Only the commit makes them visible: as a
manifest that lists the parts, or, where the result is small, as one JSON array. A run that fails
leaves nothing that a reader sees, and what its tasks wrote is removed; so is what repeated
attempts of a task left behind.

spark.dataSource.register(DocumentSink); df.write.format("document").option("path", ...).mode("overwrite").save()
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that a single document may have; larger results are parts with a manifest.
SINGLE_BYTES = 64 << 20
COPY_BYTES = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    size: int


class DocumentWriter(DataSourceArrowWriter):
    """Options: path (an address that Arrow knows), form (`array`: one JSON array; `parts`: a manifest; `auto`: by size), head (a JSON object that an array document carries beside its rows)."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.form, self.overwrite = options["path"].rstrip("/"), options.get("form", "auto"), overwrite
        if self.form not in ("array", "parts", "auto"):
            raise ValueError(f"unknown form: {self.form}")
        self.head = json.loads(options["head"]) if options.get("head") else None
        self.run = uuid.uuid4().hex

    def _system(self) -> tuple[object, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        system, root = self._system()
        context = TaskContext.get()
        folder = f"{root}/_staging-{self.run}"  # made before the tasks began: one that comes late to a failed run doesn't bring it back
        name, rows = f"part-{context.partitionId():06d}-{uuid.uuid4().hex}.json", 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                lines = [json.dumps(r, ensure_ascii=False, default=str) for r in batch.to_pylist()]
                rows += len(lines)
                if lines:
                    out.write(("\n".join(lines) + "\n").encode())
            size = out.tell()
        return Part(name, rows, size)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, root = self._system()
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.name)
        staging, old = f"{root}/_staging-{self.run}", self._current(system, root)
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        whole = sum(p.size for p in parts)
        manifest: dict[str, object] = {"run": self.run, "rows": sum(p.rows for p in parts), "bytes": whole}
        if self.form == "array" and whole > SINGLE_BYTES:
            self.abort(messages)
            raise ValueError(f"{whole} bytes are too many for one document")
        if self.form == "array" or self.form == "auto" and whole <= SINGLE_BYTES:
            manifest["document"] = f"document-{self.run}.json"
            with system.open_output_stream(f"{root}/{manifest['document']}") as out:
                out.write(b"[" if self.head is None else (json.dumps(self.head, ensure_ascii=False)[:-1] + (", " if self.head else "") + '"rows": [').encode())
                first = True
                for part in parts:
                    with system.open_input_stream(f"{staging}/{part.name}") as lines:
                        kept = b""
                        while chunk := lines.read(COPY_BYTES):
                            *done, kept = (kept + chunk).split(b"\n")
                            for line in done:
                                out.write((b"\n" if first else b",\n") + line)
                                first = False
                out.write(b"\n]" if self.head is None else b"\n]}")
            system.delete_dir(staging) if system.get_file_info(staging).type == fs.FileType.Directory else None
        else:
            system.create_dir(f"{root}/parts-{self.run}", recursive=True)
            for part in parts:
                system.move(f"{staging}/{part.name}", f"{root}/parts-{self.run}/{part.name}")
            system.delete_dir(staging) if system.get_file_info(staging).type == fs.FileType.Directory else None
            manifest["parts"] = [{"name": f"parts-{self.run}/{p.name}", "rows": p.rows, "bytes": p.size} for p in parts]
        system.create_dir(root, recursive=True)
        # Only now does a reader see the run: the manifest is put in place as a whole.
        with system.open_output_stream(f"{root}/.manifest-{self.run}") as out:
            out.write(json.dumps(manifest).encode())
        system.move(f"{root}/.manifest-{self.run}", f"{root}/manifest.json")

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, root = self._system()
        if system.get_file_info(f"{root}/_staging-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_staging-{self.run}")

    def _current(self, system: object, root: str) -> dict | None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/manifest.json").type != fs.FileType.File:
            return None
        with system.open_input_stream(f"{root}/manifest.json") as f:
            return json.loads(f.read())


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        writer = DocumentWriter(dict(self.options.items()), overwrite)
        system, root = writer._system()
        system.create_dir(f"{root}/_staging-{writer.run}", recursive=True)
        return writer


def write_document(df: DataFrame, path: str, form: str = "auto", head: dict | None = None, overwrite: bool = True) -> None:
    df.sparkSession.dataSource.register(DocumentSink)
    more = {} if head is None else {"head": json.dumps(head)}
    df.write.format("document").options(path=path, form=form, **more).mode("overwrite" if overwrite else "append").save()


def manifest(path: str) -> dict:
    """What the last committed run wrote."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path.rstrip("/"))
    with system.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the last committed run."""
    found = manifest(path)
    root = path.rstrip("/")
    if "document" not in found:
        names = [f"{root}/{p['name']}" for p in found["parts"]]
        return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)
    name = f"{root}/{found['document']}"
    raw = spark.read.text(name, wholetext=True)
    kind = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>"
    rows = F.from_json(F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.rows")), kind)
    return raw.select(F.inline(rows))
