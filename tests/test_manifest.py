"""The source manifest of files that one row may not hold."""

from __future__ import annotations

import hashlib

from barline.sources import store

LIMIT = "spark.sql.sources.binaryFile.maxLength"


def test_long_files_are_streamed(spark, tmp_path):
    held = {"a.bin": b"y", "b.bin": b"x" * 999, "c.bin": bytes(range(256)) * 400, "d e%.bin": b"\n" * 5000}
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "other.txt").write_bytes(b"x" * 5000)
    spark.conf.set(LIMIT, "1000")
    try:
        got = sorted(tuple(r) for r in store.manifest(spark, str(tmp_path), "*.bin").collect())
    finally:
        spark.conf.unset(LIMIT)
    assert [r[1:] for r in got] == [(len(c), hashlib.sha256(c).hexdigest()) for c in held.values()]
    assert [r[0] for r in got][:3] == ["a.bin", "b.bin", "c.bin"]
