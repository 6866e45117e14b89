"""Documents as a Spark data source: ``spark.read.format("siftspark")`` and ``df.write.format("siftspark")``.

    datasource.register(spark)
    spark.read.format("siftspark").load("/mnt/docs")              # paragraphs of .md, .markdown, .docx and .pdf files
    df.write.format("siftspark").mode("append").save("/mnt/out")  # documents (document_id, body) as artefacts
    spark.read.format("siftspark").option("kind", "artefacts").load("/mnt/out")

Reading: a partition takes some files; a file that can't be read, or of an unknown type, is one row
of type error. Writing: each task stages its documents in one file under ``_building`` and tells its
name, rows and hash; the commit checks every staged file against that, moves all to
``versions/<id>`` and only then renames a pointer to it, so readers see a write whole or not at all. What fails
a check, and what an aborted write has staged, goes to ``quarantine``. Python reads and writes
the files, so the path is one that the executors mount; stores that only Spark can read are read
with ``loaders.read_files``.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from siftspark.sources import loaders

PARAGRAPHS = "path string, pos int, type string, content string, page int, line_start int, line_end int, heading_level int"
ARTEFACTS = "document_id string, body string, sha256 string"
#: Files of a partition.
FILES = 64

_BLOCKS = {
    ".md": lambda raw: list(loaders.markdown_blocks(_text(raw))),
    ".markdown": lambda raw: list(loaders.markdown_blocks(_text(raw))),
    ".docx": loaders.docx_blocks,
    ".pdf": loaders.pdf_blocks,
}


def _text(raw: bytes) -> str:
    return raw.decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def _sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@dataclass
class _Files(InputPartition):
    paths: list[str]


@dataclass
class _Staged(WriterCommitMessage):
    name: str
    rows: int
    sha256: str


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siftspark"

    def schema(self) -> str:
        return ARTEFACTS if self.options.get("kind") == "artefacts" else PARAGRAPHS

    def reader(self, schema) -> DataSourceReader:
        return _ArtefactReader(self.options) if self.options.get("kind") == "artefacts" else _FileReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {"document_id", "body"} - {f.name for f in schema.fields}
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return _Writer(_local(self.options["path"]), overwrite)


def _listed(root: str) -> list[str]:
    """Files below a folder, or the one file, in order; names that begin with _ or . are left out."""
    if os.path.isfile(root):
        return [root]
    out = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n[0] not in "._")
        out += [os.path.join(folder, n) for n in files if n[0] not in "._"]
    return sorted(out)


class _FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = _local(options["path"]), int(options.get("files", FILES))

    def partitions(self) -> list[_Files]:
        if not os.path.exists(self.root):
            raise FileNotFoundError(self.root)
        found = _listed(self.root)
        return [_Files(found[k : k + self.size]) for k in range(0, len(found), self.size)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths if partition else ():  # Spark gives no partition where there are none
            load = _BLOCKS.get(os.path.splitext(path)[1].lower())
            if load is None:
                blocks = [{"type": "error", "content": "UNSUPPORTED_MEDIA_TYPE"}]
            else:
                with open(path, "rb") as f:
                    blocks = load(f.read())
            for k, b in enumerate(blocks):
                yield path, k, b["type"], b["content"], b.get("page"), b.get("line_start"), b.get("line_end"), b.get("heading_level")


class _ArtefactReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = _local(options["path"])

    def partitions(self) -> list[_Files]:
        pointer = os.path.join(self.root, "pointer")
        if not os.path.exists(pointer):
            return []
        with open(pointer) as f:
            return [_Files([os.path.join(self.root, p)]) for p in json.load(f)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths if partition else ():  # Spark gives no partition where there are none
            with open(path, encoding="utf-8") as f:
                for line in f:
                    row = json.loads(line)
                    yield row["document_id"], row["body"], row["sha256"]


class _Writer(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.id = root, overwrite, uuid.uuid4().hex

    def _at(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def write(self, rows: Iterator[Row]) -> _Staged:
        folder = self._at("_building", self.id)
        os.makedirs(folder, exist_ok=True)
        name, n, digest = f"{uuid.uuid4().hex}.jsonl", 0, hashlib.sha256()
        with open(os.path.join(folder, name), "wb") as f:
            for r in rows:
                body = r["body"] or ""
                own = {"body": body, "document_id": r["document_id"], "sha256": hashlib.sha256(body.encode()).hexdigest()}
                line = (json.dumps(own, sort_keys=True, ensure_ascii=False, separators=(",", ":")) + "\n").encode()
                f.write(line)
                digest.update(line)
                n += 1
        return _Staged(name, n, digest.hexdigest())

    def commit(self, messages: list[_Staged | None]) -> None:
        staged = [m for m in messages if m is not None]
        for m in staged:
            path = self._at("_building", self.id, m.name)
            if not os.path.exists(path) or _sha256(path) != m.sha256:
                self._quarantine()
                raise OSError(f"{m.name} was damaged in writing")
        os.makedirs(self._at("_building", self.id), exist_ok=True)
        os.makedirs(self._at("versions"), exist_ok=True)
        # files of attempts that lost are staged too, but not named by a message
        os.rename(self._at("_building", self.id), self._at("versions", self.id))
        listed = [f"versions/{self.id}/{m.name}" for m in staged if m.rows]
        if not self.overwrite and os.path.exists(self._at("pointer")):
            with open(self._at("pointer")) as f:
                listed = json.load(f) + listed
        new = self._at(f".pointer-{self.id}")
        with open(new, "w") as f:
            json.dump(listed, f)
        os.replace(new, self._at("pointer"))

    def abort(self, messages: list[_Staged | None]) -> None:
        self._quarantine()

    def _quarantine(self) -> None:
        if os.path.exists(self._at("_building", self.id)):
            os.makedirs(self._at("quarantine"), exist_ok=True)
            os.rename(self._at("_building", self.id), self._at("quarantine", self.id))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)
