"""Media columns: texts as images in archives, and a data source that streams the images back.

Writing. A payload becomes a PNG of 8-bit grey samples, 64 a row. Tasks write ZIP archives of stored members
through an Arrow writer of the data source; an archive ends at about `archive_bytes`. Each commit writes a
manifest of its own that names the archives of the tasks that succeeded, so what a lost or repeated task left
behind is never read, and appending adds a manifest. Overwriting writes one that also names the manifests it
replaces: from then on those are not read, and their files are deleted.

Reading. The driver plans byte ranges over the archives of the manifests, without opening them. A task reads
its archive's directory, takes the members that start within its range, fetches neighbours with one request
and yields Arrow batches of bounded size. A member whose request fails or whose CRC is wrong is fetched
again by itself, by its offset, a few times with pauses; other members are not touched by that.

Files are reached by pyarrow.fs, so the folder may be any URI that it knows.

Edge cases. Null text: as empty, 64 zero bytes. Repeated rows: members of their own. No rows: no rows, an
empty manifest. Extra columns are ignored. Equal texts give equal stored bytes.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from changeloom.checkpoints import new_path
from changeloom.llm.common import slices

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_manifest-"
MEMBER_SCHEMA = "doc_id long, n_bytes long, archive string, offset long, tries int, media binary"


def payload_of(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def png_of(payload: bytes, level: int = 4) -> bytes:
    """A grey PNG whose samples are the payload, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with its filter, 0: none
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def samples_of(png: bytes) -> bytes:
    """The samples of such a PNG."""
    if not png.startswith(PNG):
        raise ValueError("not a PNG")
    at, data, size = len(PNG), [], None
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a grey image of 64 samples a row")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a line is filtered")
    return lines[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Height, mean, deviation, mean step between neighbours, and shares of eight brightness bands."""
    image = np.frombuffer(samples, np.uint8)
    counts = np.bincount(image, minlength=256)
    values = np.arange(256)
    mean = float(counts @ values) / len(image)
    deviation = max(0.0, float(counts @ (values * values)) / len(image) - mean * mean) ** 0.5
    step = float(np.abs(np.diff(image.astype(np.int16))).mean())
    bands = counts.reshape(8, 32).sum(axis=1) * 1000 // len(image)
    return f"h{len(image) // WIDTH} m{mean:.4f} d{deviation:.4f} s{step:.4f} b" + "-".join(map(str, bands.tolist()))


def folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def manifests(system: pyarrow.fs.FileSystem, path: str) -> dict[str, list]:
    """The archives [name, size] by manifest, without the manifests that others replace."""
    files = system.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
    found = {}
    for name in sorted(f.base_name for f in files if f.base_name.startswith(MANIFEST)):
        with system.open_input_stream(f"{path}/{name}") as stream:
            found[name] = json.loads(stream.read())
    gone = {name for m in found.values() for name in m["replaces"]}
    return {name: m["archives"] for name, m in found.items() if name not in gone}


@dataclass
class Written(WriterCommitMessage):
    archives: list


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, archive_bytes: int, overwrite: bool):
        self.uri, self.archive_bytes, self.overwrite = uri, archive_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, path = folder(self.uri)
        archives, archive, stream, name = [], None, None, ""

        def close() -> None:
            archive.close()
            size = stream.tell()
            stream.close()
            archives.append([name, size])

        for batch in iterator:
            ids, sizes, media = (batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))
            for doc_id, size, png in zip(ids, sizes, media, strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = system.open_output_stream(f"{path}/{name}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    n = 0
                entry = zipfile.ZipInfo(f"{n}/{'null' if doc_id is None else doc_id}/{size}.png")
                archive.writestr(entry, png)
                n += 1
                if stream.tell() >= self.archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(archives)

    def commit(self, messages: list) -> None:
        system, path = folder(self.uri)
        archives = sorted(a for m in messages if m is not None for a in m.archives)
        old = manifests(system, path) if self.overwrite else {}
        name = f"{MANIFEST}{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{path}/.{name}") as out:
            out.write(json.dumps({"archives": archives, "replaces": sorted(old)}).encode())
        system.move(f"{path}/.{name}", f"{path}/{name}")  # a manifest is there whole or not at all
        for manifest, replaced in old.items():
            for archive, _ in replaced:
                system.delete_file(f"{path}/{archive}")
            system.delete_file(f"{path}/{manifest}")

    def abort(self, messages: list) -> None:
        system, path = folder(self.uri)
        for message in messages:
            for name, _ in message.archives if message is not None else []:
                system.delete_file(f"{path}/{name}")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str, range_bytes: int, batch_bytes: int, tries: int):
        self.uri, self.range_bytes, self.batch_bytes, self.tries = uri, range_bytes, batch_bytes, tries

    def partitions(self) -> list[InputPartition]:
        archives = [a for of_one in manifests(*folder(self.uri)).values() for a in of_one]
        return [ByteRange(name, start, min(size, start + self.range_bytes)) for name, size in archives for start in range(0, size, self.range_bytes)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, ByteRange):  # no archives: Spark still asks for one partition
            return
        system, path = folder(self.uri)
        where = f"{path}/{partition.archive}"
        with system.open_input_file(where) as file:
            with zipfile.ZipFile(file) as archive:
                members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
            run: list[zipfile.ZipInfo] = []
            for member in members:
                if run and member.header_offset + member.file_size - run[0].header_offset > self.batch_bytes:
                    yield self._batch(system, where, file, run, partition.archive)
                    run = []
                run.append(member)
            if run:
                yield self._batch(system, where, file, run, partition.archive)

    def _batch(self, system, where: str, file, run: list[zipfile.ZipInfo], archive: str) -> pa.RecordBatch:
        first, last = run[0].header_offset, run[-1]
        slack = 64 + len(last.filename) + len(last.extra)
        try:
            together = file.read_at(last.header_offset + last.file_size + slack - first, first)
        except OSError:
            together = b""
        rows = []
        for member in run:
            media, tries = member_bytes(together, member.header_offset - first, member), 1
            while media is None:
                if tries > self.tries:
                    raise OSError(f"{archive}: the member at {member.header_offset} can't be read in {tries} tries")
                time.sleep(0.05 * 2**tries if tries > 1 else 0)
                media, tries = self._alone(system, where, member), tries + 1
            _, doc_id, size = member.filename.removesuffix(".png").split("/")
            rows.append((None if doc_id == "null" else int(doc_id), int(size), archive, member.header_offset, tries, media))
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in MEMBER_SCHEMA.split(", ")])

    def _alone(self, system, where: str, member: zipfile.ZipInfo) -> bytes | None:
        try:
            with system.open_input_file(where) as file:
                return member_bytes(file.read_at(64 + len(member.filename) + len(member.extra) + member.file_size, member.header_offset), 0, member)
        except OSError:
            return None


def member_bytes(data: bytes, at: int, member: zipfile.ZipInfo) -> bytes | None:
    """The member whose local header lies in data at `at`; None if it is cut off or damaged."""
    if data[at : at + 4] != b"PK\x03\x04" or len(data) < at + 30:
        return None
    name, extra = struct.unpack("<HH", data[at + 26 : at + 30])
    start = at + 30 + name + extra
    media = data[start : start + member.file_size]
    return media if len(media) == member.file_size and zlib.crc32(media) == member.CRC else None


class MediaArchive(DataSource):
    """format("media_archive"): path, and archive_bytes, range_bytes, batch_bytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def _number(self, key: str, default: int) -> int:
        return int(self.options.get(key, default))

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], self._number("range_bytes", 16 << 20), self._number("batch_bytes", 4 << 20), self._number("tries", 4))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        system, path = folder(self.options["path"])
        system.create_dir(path, recursive=True)
        return ArchiveWriter(self.options["path"], self._number("archive_bytes", 64 << 20), overwrite)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            media = [png_of(payload_of(t)) for t in texts]
            yield pa.record_batch([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def write_archives(docs: DataFrame, uri: str | None = None, *, mode: str = "append", **options) -> str:
    """docs (doc_id, text) as images in archives of the folder, beside what is there or (mode="overwrite") in place of it; its URI."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    uri = uri or new_path(spark, "media")
    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    images = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")
    images.write.format("media_archive").mode(mode).option("path", uri).options(**options).save()
    return uri


def read_archives(spark: SparkSession, uri: str, **options) -> DataFrame:
    """The members of the folder's archives: doc_id, n_bytes, archive, offset, tries, media."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("path", uri).options(**options).load()


FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, text binary"


def _features(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                samples = samples_of(media)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples), samples[:n] if with_text else None))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=[x.split()[0] for x in FEATURE_SCHEMA.split(", ")])

    return run


def media_features(members: DataFrame, *, with_text: bool = False) -> DataFrame:
    """Members to the digests and features of the samples that their stored bytes hold."""
    return members.select("doc_id", "n_bytes", "media").mapInArrow(_features(with_text), FEATURE_SCHEMA)
