import re
from pathlib import Path

import pytest

from tidalpanel.llm import shared


def _held_mb(pid: int) -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_collected_gives_freed_native_memory_back(spark):
    """Of 400 compressors, about 100 MB beside the heap, a few that stay keep the rest from going back by itself."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    if not Path(f"/proc/{pid}/smaps_rollup").exists():
        pytest.skip("memory can't be read here")
    made = [spark._jvm.java.util.zip.Deflater() for _ in range(400)]
    for one in made:
        one.setInput(b"some text " * 800)
        one.deflate(bytearray(1 << 16))
    for k, one in enumerate(made):
        if k % 40 != 39:
            one.end()
    for _ in range(4):  # the heap's own share goes back first
        spark._jvm.System.gc()
    before = _held_mb(pid)
    shared.collected(spark)
    assert before - _held_mb(pid) > 30


def test_stage_has_a_full_driver_collect(spark, monkeypatch):
    called = []
    monkeypatch.setattr(shared, "collected", called.append)
    monkeypatch.setattr(shared, "HEAP_SHARE", 1.0)
    shared.discard(shared.stage(spark.range(3), "room-left"))
    assert not called
    monkeypatch.setattr(shared, "HEAP_SHARE", 0.0)
    staged = shared.stage(spark.range(3), "full")
    assert called == [spark] and staged.count() == 3
    shared.discard(staged)
