"""Encoding, token files and packing against the tokenizer itself."""

from __future__ import annotations

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubeloom.llm import packing, tokenfiles
from cubeloom.llm import encoding
from cubeloom.llm.encoding import PieceEncoder, encoder

pytest.importorskip("public_tokenizers")
VOCABULARIES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def plain(name, text):
    return encoder(name).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\n\n", "\t", ".", "'s", "é", "é", "İ", "ß", "ﬁ", "日本", "\x1c", "\u0085", " ", "123", "4", "\r\n", "\u3000", "\u2009", "\u0301", "\u0130", "\u0178", "\xd7", "\xf7", "\xb5", "'", "'S", "ll", "_", "...", "?!", "\x00", "\u00b2", "\u01c5", "\ud55c", "<|endoftext|>", "don't", "x" * 70, "\U0001f600"]), max_size=20), st.sampled_from(VOCABULARIES))
def test_chunks_give_the_same_ids(parts, name):
    text = "".join(parts)
    assert np.frombuffer(encoder(name).encode(text), "<u4").tolist() == plain(name, text)


def test_forgetting_changes_nothing(real):
    texts = [r.text for r in real.limit(60).collect()]
    small = PieceEncoder(VOCABULARIES[0], max_bytes=40_000)
    assert [np.frombuffer(b, "<u4").tolist() for b in small.encode_many(texts)] == [plain(VOCABULARIES[0], t) for t in texts]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_long_texts_are_encoded_in_parts(name, monkeypatch):
    monkeypatch.setattr(encoding, "BATCH_BYTES", 200)
    texts = ["word, d\u00e9j\u00e0 vu 12 " * 60, None, "x" * 900, "a", "", "odd\u00a0space " * 40, " " * 450 + "end", "1 " * 300, "tail" + "\n" * 300]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(name).encode_many(texts)] == [plain(name, t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12), st.text("ab1 \n.'\u00e9\u00a0", max_size=12)), max_size=8), st.sampled_from(VOCABULARIES))
def test_texts_of_a_batch_do_not_meet(texts, name):
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(name).encode_many(texts)] == [plain(name, t) for t in texts]


def expected(rows, name):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain(name, text), 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("which", ["hard", "clashing", "real"])
def test_token_files_hold_every_document(spark, request, which):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in tokenfiles.token_digests(spark, docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows, "byte_bpe_50k.json")


def test_no_documents_no_tokens(spark, empty):
    assert tokenfiles.token_digests(spark, empty).count() == 0
    assert packing.pack_documents(empty).count() == 0


def test_reader_touches_only_what_is_asked_for(tmp_path):
    import pyarrow as pa

    path = tmp_path / "t.tok"
    docs = [np.arange(n, dtype="<u4") for n in (1, 3, tokenfiles.FRAME_IDS + 5, 2)]
    w = tokenfiles.TokenFileWriter(open(path, "wb"), 4)
    for i, ids in enumerate(docs):
        w.add(i, ids)
    w.close()
    reader = tokenfiles.TokenFileReader(pa.OSFile(str(path)))
    assert all((reader.ids(i) == ids).all() for i, ids in enumerate(docs)) and len(reader.find(2)[0]) == tokenfiles.FRAME_IDS + 5
    raw = bytearray(path.read_bytes())
    raw[int(reader.place[0]) + 12] ^= 0xFF  # damage the first document
    path.write_bytes(raw)
    damaged = tokenfiles.TokenFileReader(pa.OSFile(str(path)))
    assert (damaged.ids(3) == docs[3]).all()
    with pytest.raises(Exception):
        damaged.ids(0)
    import zstandard

    # Any reader of the format sees the frames one after another; skippable frames are passed over.
    fresh = io.BytesIO()
    w = tokenfiles.TokenFileWriter(fresh, 2)
    w.add(7, np.array([5, 6], "<u4"))
    data = fresh.getvalue()
    assert zstandard.ZstdDecompressor().decompress(data, max_output_size=100) == np.array([5, 6], "<u2").tobytes()


def test_checksums_are_checked(tmp_path):
    import pyarrow as pa

    path = tmp_path / "t.tok"
    w = tokenfiles.TokenFileWriter(open(path, "wb"), 4)
    w.add(1, np.arange(9, dtype="<u4"))
    w.seek[0] = (*w.seek[0][:2], 12345)
    w.close()
    with pytest.raises(ValueError):
        tokenfiles.TokenFileReader(pa.OSFile(str(path))).ids(0)


def check_packing(docs, capacity=2048):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pieces = packing.pack_documents(docs).collect()
    want: dict = {}
    for doc_id, text in rows:
        ids = np.array([*plain("word_bpe_49k.json", text), 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            key = (doc_id, k, at, len(part), zlib.crc32(part.tobytes()))
            want[key] = want.get(key, 0) + 1
    got: dict = {}
    for p in pieces:
        key = (p.doc_id, p.piece, p.start, p.length, p.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    bins: dict = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(p.length for p in pieces)


@pytest.mark.parametrize("which", ["hard", "clashing", "real"])
def test_packing_is_whole_gapless_and_tight(request, which):
    bins, tokens = check_packing(request.getfixturevalue(which))
    assert bins <= 1.05 * tokens / 2048 + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(1, 6))
def test_packer_follows_best_fit(lengths, limit):
    """The bitset against a plain search."""
    packer, bins, count = packing.BestFitPacker(50, limit), [], 0
    for n in lengths:
        fitting = [b for b in bins if b[1] >= n]
        if fitting:
            chosen = min(fitting, key=lambda b: b[1])
        else:
            if len(bins) == limit:
                bins.remove(min(bins, key=lambda b: b[1]))
            chosen = [count, 50]
            count += 1
            bins.append(chosen)
        free = chosen[1]
        place, offset = packer.add(n)
        assert offset == 50 - free  # ties may choose another bin of the same room
        same = next(b for b in bins if b[1] == free and (b[0] == place or b is chosen))
        same[1] -= n
        if not same[1]:
            bins.remove(same)
        assert packer.n_open == len(bins)
        assert sorted(50 - held for _, held in packer.open()) == sorted(b[1] for b in bins)
