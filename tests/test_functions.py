import errno
import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapquarry.functions import chunking, scalars
from snapquarry.functions.chunking import ChunkSizes, cut_point, gear_table, split
from snapquarry.sources.store import LocalStore, NotFound, is_unsupported


def lengths(data: bytes, sizes: ChunkSizes = ChunkSizes()) -> list[int]:
    return [len(c) for c in split(io.BytesIO(data).read, sizes)]


def log(first: int, last: int) -> bytes:
    return "".join(f"2026-07-21T10:{i % 60:02d}:{i * 7 % 60:02d} INFO req id={i} status=200 path=/api/items\n" for i in range(first, last + 1)).encode()


def test_gear_table():
    g = gear_table()
    assert [int(g[i]) for i in (0, 1, 2, 255)] == [0x6E789E6AA1B965F4, 0x06C45D188009454F, 0xF88BB8A8724C81EC, 0xCBDC6D34B7C7534D]


def test_chunk_lengths():
    data = bytes((i * i + 7 * i + (i >> 5)) & 255 for i in range(300_000))
    assert lengths(data) == [69199, 65536, 65536, 65536, 34193]
    assert chunking.digest(next(split(io.BytesIO(data).read))) == "5716ff568da2b702b1b9ad0e238d7809641dd5e0393ac3b9be42c48f1ae08293"
    assert lengths(bytes(600_000)) == [262144, 262144, 75712]
    assert lengths(b"") == [] and lengths(b"x" * 16384) == [16384]
    assert lengths(log(1, 28000)) == [155984, *[262144] * 5, 117910, 224280]
    assert lengths(log(28001, 56000)) == [*[262144] * 6, 247136]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_cut_point_matches_a_loop(data, least):
    sizes = ChunkSizes(least, 2 * least, 8 * least)
    gear = [int(x) for x in gear_table()]
    h, expected, n = 0, None, min(len(data), sizes.most)
    if len(data) <= least:
        expected = len(data)
    else:
        for i in range(least, n):
            h = ((h << 1) + gear[data[i]]) % (1 << 64)
            if h % (1 << (18 if i < sizes.average else 14)) == 0:
                expected = i
                break
    assert cut_point(np.frombuffer(data, np.uint8), sizes) == (n if expected is None else expected)


def test_chunks_find_their_place_again_after_an_insert():
    rng = np.random.default_rng(5)
    data = np.where(rng.random(1 << 20) < 0.25, rng.integers(0, 256, 1 << 20), np.arange(1 << 20) % 251).astype(np.uint8).tobytes()
    one = list(split(io.BytesIO(data).read))
    two = list(split(io.BytesIO(data[:500_000] + b"inserts" + data[500_000:]).read))
    assert b"".join(one) == data and len(one) >= 4
    assert len({*map(chunking.digest, one)} & {*map(chunking.digest, two)}) * 2 >= len(one)
    assert lengths(data, ChunkSizes(0, 0, 0)) == [len(c) for c in one]


@given(st.binary(max_size=500))
def test_codec(data):
    assert chunking.inflate(chunking.deflate(data)) == data


CASES = [("/src/root/Documents", "Documents"), ("/src/root/Documents/Personal", "Documents/Personal"), ("/src/root/Documents/Personal/", "Documents/Personal"), ("Documents/Personal", "Documents/Personal"), ("/somewhere/else", "somewhere/else"), ("", "")]


@pytest.mark.parametrize(("given_", "stored"), CASES)
def test_stored_path(given_, stored):
    assert scalars.stored_path(["/src/root/Documents"], given_) == stored
    assert scalars.stored_path(["rel", "/src/root/Documents"], given_.replace("/", "\\")) == stored


def test_stored_roots():
    assert scalars.stored_roots(["/src/root/Documents", "/x/Documents/", "", "/", "."]) == ["Documents"]


def test_parsing():
    assert scalars.parse_time("1970-01-01T00:00:01.5Z") == 1_500_000_000
    assert scalars.parse_time("1970-01-01T01:00:00+01:00") == 0
    assert scalars.parse_time("2026-07-21") < scalars.parse_time("2026-07-21 10:00") < scalars.parse_time("2026-07-21T10:00:01")
    with pytest.raises(ValueError, match="unrecognized"):
        scalars.parse_time("soon")
    assert scalars.parse_tags(["a=b=c", "a=d", "x="]) == {"a": "d", "x": ""}
    for bad in ("a", "=b"):
        with pytest.raises(ValueError, match="invalid tag"):
            scalars.parse_tags([bad])
    assert [scalars.human_size(n) for n in (0, 1023, 1024, 1280, 1536, 1 << 30)] == ["0 B", "1023 B", "1.0 KiB", "1.2 KiB", "1.5 KiB", "1.0 GiB"]


def test_columns(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(scalars.human_bytes(F.lit(1280))) == "1.2 KiB"
    assert get(scalars.mode_string(F.lit(0o755))) == "-rwxr-xr-x"
    assert get(scalars.content_hash(F.array(F.lit("c1"), F.lit("c2")))) == "856dbf250959cd0150a1c43d05c7d5f308357a487c919cf1742cf5f8123954b6"
    assert get(scalars.content_hash(F.array().cast("array<string>"))) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert get(scalars.encode_map(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a":"2","b":"1"}'
    assert get(scalars.encode_map(F.lit(None).cast("map<string,string>"))) == "null"
    assert get(scalars.is_chunk_id(F.lit("abc"))) is False and get(scalars.chunk_id(F.lit("AB" * 32))) == "ab" * 32
    assert get(scalars.under_prefix(F.lit("ab/c"), "a")) is False and get(scalars.under_prefix(F.lit("a/c"), "a/")) is True


def test_store(tmp_path):
    s = LocalStore(str(tmp_path / "s"))
    s.put("a/b", b"0123456789")
    assert s.get_range("a/b", 3, 4) == b"3456" and s.get_range("a/b", 8, 9) == b"89" and s.get("a/b") == b"0123456789"
    s.put("index/x", b"")
    s.put("index/y", b"")
    (tmp_path / "s/index/.tmp-z").write_bytes(b"")
    assert s.list("index") == ["index/x", "index/y"] and s.list("none") == []
    s.delete("a/b")
    s.delete("a/b")
    assert not s.exists("a/b")
    with pytest.raises(NotFound):
        s.get("a/b")
    with pytest.raises(ValueError, match="directory"):
        LocalStore("")
    assert is_unsupported(OSError(errno.EINVAL, "")) and not is_unsupported(OSError(errno.EIO, ""))
