import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from snapquarry.llm import packing, token_files
from snapquarry.llm.encoder import WordEncoder
from snapquarry.llm.packing import _closest_fill, plan_fills

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", "\n", "a\n", "\na", "a\n\nb", "  x", "x ", "x\ty", "\tx", "a \nb", "a\n b", "Ünïcode ÉÀ ß ﬁ İstanbul K", " ", "é x́", "don't it's I'LL", "<|endoftext|> hi", "a<|endoftext|>b", "x <|startoftext|>\n<|ENDOFTEXT|> <|", "≮|endoftext|> <|endoftext|", "x" * 100 + " y", "日本語 テスト", "a|b | c", 'x, y. z!? (a) "b"', "12 345 a1b2", "Aǅ Ω ς", "a\xa0b \xa0c", "x\x1fy z", "a , b .c", " \n ", "word,word, word"]


def exact(name: str) -> Tokenizer:
    return Tokenizer.from_file(P.path(name))


@pytest.mark.parametrize("name", FILES)
def test_encoder_is_exact(name):
    enc, ref = WordEncoder(P.path(name), max_pieces=5), exact(name)
    for text, got in zip(ODD * 2, enc.encode(ODD) + enc.encode(ODD), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ref.encode(text, add_special_tokens=False).ids, text
    assert enc.encode([None, "", "a"])[:2] == [b"", b""]


@pytest.mark.parametrize("name", FILES)
def test_encoder_is_exact_on_any_text(name):
    enc, ref = WordEncoder(P.path(name)), exact(name)

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from(list("abAB é'.,|\n\t 0 ́ß<>日")), max_size=30))
    def same(text):
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == ref.encode(text, add_special_tokens=False).ids

    same()


DOCS = [(3, "the cat"), (1, None), (None, "null id"), (2, ""), (3, "the cat"), (3, "another text"), (9, "word " * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, part int, ids string")


def test_token_files_round_trip(spark, docs, tmp_path):
    path = token_files.write_tokens(docs, str(tmp_path / "t"), P.path(FILES[1]), 2)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    ref, start = exact(FILES[1]), 0
    assert [r["doc_id"] for r in rows] == sorted((d[0] for d in DOCS), key=lambda i: (i is not None, i or 0))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((i, (*ref.encode(text or "", add_special_tokens=False).ids, 2)) for i, text in DOCS)
    for r in rows:
        assert (r["n_tokens"], r["start"]) == (len(r["ids"]), start)
        start += len(r["ids"])
    some = token_files.read_tokens(spark, path, (2, 3), metadata_only=True)
    assert "ids" not in some.columns and some.count() == 4
    assert token_files.read_tokens(spark, path, (9, 9)).first()["start"] == start - 3001
    digests = token_files.digest(token_files.read_tokens(spark, path), "start").collect()
    assert {(r["start"], r["ids_crc32"]) for r in digests} == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in rows}
    meta = [pq.ParquetFile(f).metadata for f in (tmp_path / "t").glob("part-*.parquet")]
    column = next(m.row_group(0).column(j) for m in meta if m.num_row_groups for j in range(m.num_columns) if m.schema.column(j).path.startswith("ids"))
    assert column.has_offset_index and column.has_dictionary_page


def test_token_files_of_nothing(spark, docs, tmp_path):
    path = token_files.write_tokens(docs.limit(0), str(tmp_path / "t"), P.path(FILES[1]), 2)
    assert token_files.read_tokens(spark, path).count() == 0


def test_token_query(spark):
    got = token_files.op5_token_files(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    ref, start = exact(FILES[1]), 0
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    assert len(rows) == len(got)
    for r, g in zip(rows, got, strict=True):
        ids = np.array(ref.encode(r["text"], add_special_tokens=False).ids + [2], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_closest_fill_is_the_best(counts, room):
    items = [k for k, v in counts.items() for _ in range(v)]
    best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
    fill = _closest_fill(counts, room)
    assert sum(k * c for k, c in fill.items()) == best and all(c <= counts[k] for k, c in fill.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 50), max_size=20))
def test_fills_use_every_piece_once(histogram):
    used = {}
    for times, fill in plan_fills(histogram, 64):
        assert sum(k * c for k, c in fill.items()) <= 64
        for k, c in fill.items():
            used[k] = used.get(k, 0) + c * times
    assert used == histogram


def check_packing(rows, docs, window):
    ref, by_sequence, by_document = exact(FILES[0]), {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_to"]))
        by_document.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length, padded in sorted(pieces):
            assert offset == at
            at += length
        assert 0 < at <= window and padded == (at if at & (at - 1) == 0 else window)
    expected = sorted((i is not None, i or 0, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for i, t in docs for ids in [np.array(ref.encode(t or "", add_special_tokens=False).ids + [0], "<u4")] for s in range(0, len(ids), window) for n in [min(window, len(ids) - s)])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == expected
    assert set(by_sequence) == set(range(len(by_sequence)))


def test_packing(spark, docs):
    check_packing(packing.pack(docs, P.path(FILES[0]), 0, 64).collect(), DOCS, 64)
    assert packing.pack(docs.limit(0), P.path(FILES[0]), 0, 64).count() == 0


def test_packing_query_pads_little(spark):
    sf = "/root/testdata/sf0.001"
    rows = packing.op6_packing(spark, sf).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], 1024)
    tokens = sum(r["length"] for r in rows)
    assert sum({r["sequence_id"]: r["padded_to"] for r in rows}.values()) < 1.05 * tokens
