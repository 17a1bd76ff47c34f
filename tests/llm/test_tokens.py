import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import dac, packing, tokens

WHOLE = Tokenizer.from_file(public_tokenizers.path(tokens.DEFAULT))


def expected(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\t'sé1_²½ª\x1c\x85\xa0"), max_size=60))
def test_ids_are_the_librarys(text):
    assert tokens.encoder().ended(text).tolist() == expected(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab.,' \n\t1é²_"), max_size=60), st.integers(1, 9))
def test_ids_of_long_texts_in_parts(text, part):
    old = tokens.PART
    try:
        tokens.PART = part
        assert tokens.encoder().ended(text).tolist() == expected(text)
    finally:
        tokens.PART = old


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_codes_round_trip(ids, data):
    ids = np.array(ids, dtype=np.uint32)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(ids)), max_size=4)))
    parts = np.split(ids, cuts)
    codes = dac.Codes(dac.pack([None, *range(1, len(parts))], parts))
    assert [codes.document(k)[2].tolist() for k in range(len(parts))] == [p.tolist() for p in parts]
    assert codes.document(0)[0] is None
    for i in {0, len(ids) // 2, len(ids) - 1} & set(range(len(ids))):
        assert codes.token(i) == ids[i]
    with pytest.raises(IndexError):
        codes.token(len(ids))


def test_every_token_is_addressed():
    ids = np.random.default_rng(3).integers(0, 70_000, 5000).astype(np.uint32)
    codes = dac.Codes(dac.pack([1], [ids]))
    assert [codes.token(i) for i in range(len(ids))] == ids.tolist()


def test_mapped_file(tmp_path):
    (tmp_path / "x.dac").write_bytes(dac.pack([4, None], [np.arange(300), np.arange(70_000, 70_003)]))
    codes = dac.open_file(str(tmp_path / "x.dac"))
    assert (codes.token(299), codes.token(301), codes.document(1)[0]) == (299, 70_001, None)


def test_not_a_file():
    with pytest.raises(ValueError):
        dac.Codes(b"something else entirely")


def test_files_round_trip(spark, odd_docs, no_docs):
    docs = odd_docs.repartition(3)
    rows = sorted(dac.round_trip(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is not None, d))
    want = sorted((tuple([r.doc_id or -1, *expected(r.text)]) for r in docs.collect()))
    assert sorted(tuple([r.doc_id or -1, *np.frombuffer(r.ids, "<u4").tolist()]) for r in rows) == want
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    assert dac.round_trip(no_docs).count() == 0


def test_small_files(spark, odd_docs):
    from quern.session import shared_dir

    folder = shared_dir(spark, "dac-test")
    manifest = dac.write(odd_docs, folder, file_ids=5)
    assert manifest.count() > 5
    rows = sorted(dac.read(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()


def check_packing(docs, pieces, length):
    by_doc, by_seq = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
    sizes = []
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(s == length or (s < length and s & (s - 1) == 0) for s in sizes)
    return by_doc, sizes


@pytest.mark.parametrize("length", [16, 1024])
def test_packing(spark, odd_docs, no_docs, length):
    docs = odd_docs.repartition(5)
    pieces = packing.pack(docs, length=length, windows=4).collect()
    by_doc, sizes = check_packing(docs, pieces, length)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(expected(r.text))
    assert sum(sizes) == sum(len(x) for v in texts.values() for x in v)
    for doc_id, parts in by_doc.items():
        if len(texts[doc_id]) == 1:
            parts.sort()
            assert [i for _, ids, _ in parts for i in ids] == texts[doc_id][0]
            assert all(n == len(texts[doc_id][0]) for _, _, n in parts)
    assert packing.pack(no_docs).count() == 0


def test_packing_merges_rests_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('word and ', int(id % 37)) AS text").repartition(40)
    pieces = packing.pack(docs, length=64, windows=3).collect()
    _, sizes = check_packing(docs, pieces, 64)
    assert sum(s < 64 for s in sizes) <= 6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=60), st.integers(1, 5))
def test_packer_loses_nothing(sizes, windows):
    packer, at = packing.Packer(64, windows), 0
    for k, n in enumerate(sizes):
        packer.add((k, 0, n, np.arange(at, at + n, dtype=np.uint32)))
        at += n
        assert len(packer.open) <= windows and all(used < 64 for used, _ in packer.open)
    rest = packer.finish()
    out = [*packer.full, *packing.powers(rest)]
    assert sorted(i for w in out for p in w for i in p[3].tolist()) == list(range(at))
    assert all(sum(len(p[3]) for p in w) == 64 for w in packer.full)


def test_crc_is_over_little_endian_ids():
    assert dac.crc(np.array([1, 2])) == zlib.crc32(bytes([1, 0, 0, 0, 2, 0, 0, 0]))
