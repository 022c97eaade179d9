import hashlib
import os
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st

from glossaflow.llm import media


@given(st.binary(max_size=2000))
@settings(max_examples=100, deadline=None)
def test_round_trip(data):
    p = media.padded(data)
    assert len(p) % 192 == 0 and len(p) >= 192 and p.startswith(data) and not p[len(data) :].strip(b" ")
    assert media.decode(media.encode(p)) == p


ROWS = [(1, "héllo"), (2, None), (3, ""), (None, "x" * 192), (3, "again"), (3, "again"), (9, "y " * 200_000)]


def test_media_columns(spark):
    df = spark.createDataFrame([(d, t, b"m") for d, t in ROWS], "doc_id long, text string, media binary").repartition(3)
    got = media.media_columns(df, splitBytes=2000).collect()
    want = sorted((str(d), len((t or "").encode()), hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for d, t in ROWS)
    assert sorted((str(r["doc_id"]), r["n_bytes"], hashlib.sha256(r["payload"]).hexdigest()) for r in got) == want
    again = [r for r in got if r["n_bytes"] == 5]
    assert again[0]["media"] == again[1]["media"] and again[0]["feature"] == again[1]["feature"]
    assert all(r["error"] is None for r in got)


def test_damaged_member_alone_fails(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string").coalesce(1)
    uri = f"file://{tmp_path}/arc"
    media.write_archives(df, uri)
    names = sorted(os.listdir(tmp_path / "arc"))
    assert all(n.endswith(".zip") for n in names)
    full = next(tmp_path / "arc" / n for n in names if len(zipfile.ZipFile(tmp_path / "arc" / n).infolist()) >= 1)
    info = zipfile.ZipFile(full).infolist()[0]
    data = bytearray(full.read_bytes())
    data[info.header_offset + 60] ^= 255
    full.write_bytes(bytes(data))
    rows = media.read_archives(spark, uri, retries=1).collect()
    assert len(rows) == 6 and sum(r["error"] is not None for r in rows) == 1


def test_reader_retries_by_offset(tmp_path):
    with zipfile.ZipFile(tmp_path / "part-0.zip", "w") as z:
        for i in range(3):
            info = zipfile.ZipInfo(f"{i}.png")
            info.comment = b'["7", 1]'
            z.writestr(info, media.encode(media.padded(b"a")))
    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "splitbytes": "150"})
    real, failed = media.read_member, []

    def flaky(f, info):
        if info.filename == "1.png" and len(failed) < 2:
            failed.append(1)
            raise OSError("lost connection")
        return real(f, info)

    media.read_member = flaky
    try:
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        media.read_member = real
    assert len(failed) == 2 and [r["member"] for r in rows] == ["0.png", "1.png", "2.png"] and not any(r["error"] for r in rows)


def test_empty(spark):
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0
