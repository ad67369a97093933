"""Encoding, decoding, counting and token files against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablescope.llm import bpe, counts, wavelet
from tablescope.llm.common import new_path

from ..conftest import SF
from .cases import frame, got, odd_rows

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def texts_of_sf(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def tangled(seed, n=120):
    rnd = random.Random(seed)
    letters = "abest ingrABE'\n0!<|é日"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 300))) for _ in range(n)]


def test_counts_equal_the_library(spark, library):
    rows = odd_rows() + texts_of_sf(spark) + list(enumerate(tangled(1)))
    expected = []
    for i, t in rows:
        n = len(library[BYTE].encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 1024))
    found = got(counts.count_tokens(frame(spark, rows), BYTE), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert found == sorted(expected, key=repr)


@pytest.mark.parametrize("chunk", [1, 3, 64, 100_000])
def test_scan_does_not_depend_on_the_chunks(chunk):
    classes = counts.char_classes()
    text = "it's ''re  don't\n\n x 12a '" * 7
    points = np.frombuffer((text + "\0").encode("utf-32-le"), np.uint32)
    kind = counts.symbols(points, np.array([len(text)]), classes)
    assert counts.scan(kind, chunk).tolist() == counts.scan(kind, 7).tolist()


def test_states_are_forgotten(monkeypatch, library):
    monkeypatch.setattr(counts, "MOST_STATES", 50)
    texts = tangled(2)
    expected = [len(library[BYTE].encode(t, add_special_tokens=False).ids) for t in texts]
    assert counts.TokenCounter(BYTE)(texts) == expected


def test_round_trip_equals_the_library(spark, library):
    rows = odd_rows() + texts_of_sf(spark)
    expected = []
    for i, t in rows:
        ids = library[WORD].encode(t or "", add_special_tokens=False).ids
        text = library[WORD].decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)]
        expected.append((i, len(ids), *digests))
    found = got(bpe.round_trip(frame(spark, rows), WORD), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == sorted(expected, key=repr)
    ids = got(bpe.encode_texts(frame(spark, odd_rows()), WORD), "doc_id", "ids")
    assert ids == sorted([(i, library[WORD].encode(t or "", add_special_tokens=False).ids) for i, t in odd_rows()], key=repr)


def test_stream_with_the_least_window(library):
    encoder = bpe.Encoder(WORD)
    small = bpe.Encoder(WORD, window=(encoder.lookahead + 40) // 2)
    for t in [*(t.replace(" ", "").replace("\n", "") for t in tangled(3)), "a" * 3000, "!" * 1500, "ab" * 900]:
        assert list(small.encode(t)) == library[WORD].encode(t, add_special_tokens=False).ids


def test_decoder_is_incremental():
    decoder, whole = bpe.Decoder(BYTE), Tokenizer.from_file(BYTE)
    text = "日本語 😀 é plain"
    ids = whole.encode(text).ids
    assert "".join([*(decoder.feed([i]) for i in ids), decoder.finish()]) == text
    assert decoder.feed(ids[:1]) + decoder.finish() == whole.decode(ids[:1])


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 512, 513, 3000):
        a = rng.integers(0, 300, n)
        m = wavelet.WaveletMatrix.build(a)
        assert (m.ids() == a).all()
        for i in range(0, n, 97):
            assert m.access(i) == a[i] and m.rank(int(a[i]), i) == (a[:i] == a[i]).sum()
        for v in (0, 5, 299, 100_000):
            assert m.occurrences(v) == np.flatnonzero(a == v).tolist()
    with pytest.raises(IndexError):
        m.select(100_000, 0)


def test_token_files(spark, spread, library, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_IDS", 500)
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 6] + [(100 + i, t) for i, (_, t) in enumerate(texts_of_sf(spark)[:60])]
    path = new_path(spark, "tokens")
    wavelet.write_shards(frame(spark, rows), path, WORD, end_id=2)
    start, expected, all_ids = 0, [], {}
    for i, t in sorted(rows):
        ids = [*library[WORD].encode(t or "", add_special_tokens=False).ids, 2]
        all_ids[i] = ids
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = got(wavelet.read_documents(spark, path), "doc_id", "start", "n_tokens", "ids_crc32")
    assert found == sorted(expected, key=repr)
    token = all_ids[9][0]
    places = sorted((i, p) for i, ids in all_ids.items() for p, x in enumerate(ids) if x == token)
    assert sorted(map(tuple, wavelet.find_token(spark, path, token).collect())) == places
    assert wavelet.count_token(spark, path, token).first()["n"] == len(places)


def test_files_with_null_and_repeated_keys(spark):
    path = new_path(spark, "tokens")
    wavelet.write_shards(frame(spark, odd_rows()), path, WORD, end_id=2)
    out = wavelet.read_documents(spark, path)
    assert out.count() == len(odd_rows())
    rows = sorted(map(tuple, out.select("start", "n_tokens", "doc_id").collect()))
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(rows, rows[1:]))
    assert rows[0][2] is None


def test_empty_tables(spark):
    none = frame(spark, [])
    assert counts.count_tokens(none, BYTE).count() == 0
    assert bpe.round_trip(none, WORD).count() == 0
    path = new_path(spark, "tokens")
    wavelet.write_shards(none, path, WORD)
    assert wavelet.read_documents(spark, path).count() == 0
    assert wavelet.count_token(spark, path, 5).agg(F.sum("n")).first()[0] == 0
