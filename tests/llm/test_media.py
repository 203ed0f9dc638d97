import hashlib
import json
import os
import zlib

import pytest

from changeloom.llm import media

ROWS = [(1, "abc"), (2, None), (3, ""), (4, "é" * 32), (5, "x" * 64), (6, "y" * 65), (None, "abc"), (1, "abc"), (7, "long " * 100_000), (8, "\0 nul \0")]


@pytest.fixture
def uri(tmp_path):
    return f"file://{tmp_path}/archives"


def check(rows, found):
    want = sorted((repr(i), hashlib.sha256(media.payload_of((t or "").encode())).hexdigest(), len((t or "").encode())) for i, t in rows)
    assert sorted((repr(r.doc_id), r.payload_sha256, r.n_bytes) for r in found) == want
    for r in found:
        assert r.payload_bytes % 64 == 0 and 0 <= r.payload_bytes - r.n_bytes <= 64 and r.payload_bytes > 0


@pytest.mark.parametrize("options", [{}, {"range_bytes": 500, "batch_bytes": 300}])
def test_round_trip(spark, make_docs, uri, options):
    media.write_archives(make_docs(ROWS, ("media", "offset")), uri, archive_bytes=2000)
    members = media.read_archives(spark, uri, **options)
    found = media.media_features(members, with_text=True).collect()
    check(ROWS, found)
    texts = {r.doc_id: r for r in found}
    assert bytes(texts[4].text).decode() == "é" * 32 and texts[8].tail_crc32 == zlib.crc32(media.payload_of(b"\0 nul \0")[-64:])
    same = [(r.media_sha256, r.media_bytes, r.feature) for r in found if r.doc_id in (1, None)]
    assert len(same) == 3 and len(set(same)) == 1
    assert members.selectExpr("max(tries)").first()[0] == 1 and members.select("archive", "offset").distinct().count() == len(ROWS)


def test_images_are_plain_png():
    payload = bytes(range(64)) * 3
    png = media.png_of(payload)
    assert media.samples_of(png) == payload
    damaged = png[:60] + bytes([png[60] ^ 1]) + png[61:]
    with pytest.raises(ValueError):
        media.samples_of(damaged)


def archive_of(uri):
    folder = uri.removeprefix("file://")
    return f"{folder}/{next(x for x in os.listdir(folder) if x.endswith('.zip'))}"


def test_a_member_is_retried_alone(spark, make_docs, uri, monkeypatch):
    """The request for a run of members fails: each member is fetched by its own offset."""
    media.write_archives(make_docs([(i, f"text {i}") for i in range(5)]).coalesce(1), uri)
    reader = media.ArchiveReader(uri, 1 << 20, 1 << 20, 3)
    system, path = media.folder(uri)
    part = reader.partitions()[0]
    calls = []

    class Flaky:
        def open_input_file(self, where):
            calls.append(where)
            if len(calls) == 2:
                raise OSError("lost")
            return system.open_input_file(where)

    class Cut:
        def read_at(self, n, at):
            raise OSError("cut")

    with system.open_input_file(f"{path}/{part.archive}") as f, media.zipfile.ZipFile(f) as z:
        members = z.infolist()
    batch = reader._batch(Flaky(), f"{path}/{part.archive}", Cut(), members, part.archive)
    assert batch.column("tries").to_pylist() == [2, 3, 2, 2, 2] and len(batch) == 5


def test_a_damaged_member_is_an_error_and_not_a_loss(spark, make_docs, uri):
    media.write_archives(make_docs([(1, "abc"), (2, "def" * 50)]).coalesce(1), uri)
    name = archive_of(uri)
    data = bytearray(open(name, "rb").read())
    data[60] ^= 0xFF
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="can't be read"):
        media.read_archives(spark, uri, tries=1).collect()


def test_what_failed_tasks_left_is_not_read(spark, make_docs, uri):
    media.write_archives(make_docs(ROWS), uri)
    folder = uri.removeprefix("file://")
    with open(archive_of(uri), "rb") as a, open(f"{folder}/left-over.zip", "wb") as b:
        b.write(a.read())
    assert media.read_archives(spark, uri).count() == len(ROWS)
    manifests = [x for x in os.listdir(folder) if x.startswith(media.MANIFEST)]
    assert len(manifests) == 1 and all(n != "left-over.zip" for n, _ in json.load(open(f"{folder}/{manifests[0]}"))["archives"])


def test_append_adds_and_overwrite_replaces(spark, make_docs, uri):
    ids = lambda: sorted(r.doc_id for r in media.read_archives(spark, uri).collect())
    media.write_archives(make_docs([(1, "a"), (2, "b")]), uri)
    media.write_archives(make_docs([(3, "c")]), uri)
    media.write_archives(make_docs([]), uri)
    assert ids() == [1, 2, 3]
    media.write_archives(make_docs([(4, "d")]), uri, mode="overwrite")
    assert ids() == [4]
    media.write_archives(make_docs([(5, "e")]), uri)
    assert ids() == [4, 5]
    files = os.listdir(uri.removeprefix("file://"))
    assert sum(x.startswith(media.MANIFEST) for x in files) == 2 and sum(x.endswith(".zip") for x in files) == 2
    media.write_archives(make_docs([]), uri, mode="overwrite")
    assert ids() == []


def test_reading_and_features_against_other_libraries(spark, make_docs, uri):
    """zipfile and zlib alone, without this module's readers: what lies in the archives, and what the features should be."""
    import statistics
    import zipfile

    media.write_archives(make_docs(ROWS), uri)
    folder, found = uri.removeprefix("file://"), {}
    for name in (x for x in os.listdir(folder) if x.endswith(".zip")):
        with zipfile.ZipFile(f"{folder}/{name}") as archive:
            for member in archive.namelist():
                png = archive.read(member)
                assert png[:8] == b"\x89PNG\r\n\x1a\n" and png[12:16] == b"IHDR"
                width, height = (int.from_bytes(png[a : a + 4], "big") for a in (16, 20))
                at = png.index(b"IDAT")
                lines = zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")])
                assert width == 64 and len(lines) == 65 * height
                found.setdefault(b"".join(lines[65 * k + 1 : 65 * k + 65] for k in range(height)), set()).add(hashlib.sha256(png).hexdigest())
    want = {media.payload_of((t or "").encode()) for _, t in ROWS}
    assert set(found) == want and all(len(v) == 1 for v in found.values())
    for r in media.media_features(media.read_archives(spark, uri)).collect():
        payload = next(p for p in want if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        assert r.media_sha256 in found[payload] and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.payload_bytes == len(payload)
        parts = dict((x[0], x[1:]) for x in r.feature.split())
        steps = [abs(b - a) for a, b in zip(payload, payload[1:], strict=False)]
        assert int(parts["h"]) == len(payload) // 64 and abs(float(parts["m"]) - statistics.fmean(payload)) < 1e-3
        assert abs(float(parts["d"]) - statistics.pstdev(payload)) < 1e-2 and abs(float(parts["s"]) - statistics.fmean(steps)) < 1e-3
        assert [int(x) for x in parts["b"].split("-")] == [sum(32 * k <= v < 32 * k + 32 for v in payload) * 1000 // len(payload) for k in range(8)]


def test_no_rows(spark, make_docs, uri):
    media.write_archives(make_docs([]), uri)
    assert media.media_features(media.read_archives(spark, uri)).count() == 0


def test_on_the_tables(spark, small, uri):
    media.write_archives(small, uri)
    check([(r.doc_id, r.text) for r in small.collect()], media.media_features(media.read_archives(spark, uri)).collect())
