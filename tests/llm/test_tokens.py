"""Token files and packing against the tokenizers library and plain recounts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evigraph.llm import packing, token_files
from evigraph.llm.encode import encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = st.sampled_from([" ", "  ", "\n", " \n", "\t", " ", " ", "\x1c", "\x85", "a", "It's", "É", "é", "́", "Σ", "ΣΑΣ", "12", "...", ".", ",", "!?", "'", "'s", "<|endoftext|>", "<|startoftext|>", "日本", "🙂", "İ", "ﬁ", "ß", "ÿ", "ÀÖ", "Straße", "élève", "ª", "µm", "Word", "x" * 70])


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_encoder_equals_the_library(path, spaced):
    plain, quick = Tokenizer.from_file(path), encoder(path, spaced)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.one_of(PIECES, st.text(max_size=4)), max_size=14).map("".join))
    def same(text):
        got = np.frombuffer(quick.encode(text), dtype="<u4").tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids

    same()


def library_ids(docs, path, end):
    rows = docs.select("doc_id", "text").collect()
    plain = Tokenizer.from_file(path)
    return [(r["doc_id"], plain.encode(r["text"] or "", add_special_tokens=False).ids + [end]) for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def check_files(spark, docs, folder):
    form = token_files.Format(BYTE)
    manifest = token_files.write_token_files(docs, folder, form)
    got = token_files.read_token_files(spark, manifest, with_ids=True).orderBy("start").collect()
    want = library_ids(docs, BYTE, 0)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(r["ids"])) for r in got) == sorted((d is not None, d or 0, tuple(i)) for d, i in want)
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), crc(r["ids"]))
        start += r["n_tokens"]
    names = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert names == sorted(names)
    return manifest


def test_round_trip(spark, docs001, odd_docs, no_docs, tmp_path):
    manifest = check_files(spark, docs001, str(tmp_path / "a"))
    check_files(spark, odd_docs, str(tmp_path / "b"))
    check_files(spark, no_docs, str(tmp_path / "c"))
    check_files(spark, odd_docs.selectExpr("nullif(doc_id, 3) AS doc_id", "text"), str(tmp_path / "d"))
    for row in manifest.collect():
        shard = token_files.Shard(row["file"])
        middle = len(shard.doc_ids) // 2
        text = docs001.filter(f"doc_id = {shard.doc_ids[middle]}").first()["text"]
        assert [shard.ids(i).tolist() for i in shard.find(int(shard.doc_ids[middle]))] == [Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids + [0]]


def check_packing(docs, capacity):
    packed = packing.pack_documents(docs, WORD, capacity, with_ids=True)
    rows = packed.collect()
    pieces = {}
    for doc, ids in library_ids(docs, WORD, 1):
        for n, at in enumerate(range(0, len(ids), capacity)):
            pieces.setdefault((doc, n, at), []).append(ids[at : at + capacity])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["start"], tuple(r["ids"])) for r in rows) == sorted(
        (k[0] is not None, k[0] or 0, k[1], k[2], tuple(v)) for k, vs in pieces.items() for v in vs
    )
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and (r["length"], r["ids_crc32"]) == (len(r["ids"]), crc(r["ids"]))
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= capacity for n in ends.values())
    assert sorted(len(r["ids"]) for r in packing.sequences(packed).collect()) == sorted(ends.values())
    return len(ends), -(-sum(ends.values()) // capacity)


def test_packing(docs001, odd_docs, no_docs):
    used, least = check_packing(docs001, 4096)
    assert used <= least + 1
    check_packing(docs001, 256)
    check_packing(odd_docs, 4096)
    check_packing(no_docs, 4096)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_uses_every_piece(counts):
    array = np.zeros(41, dtype=np.int64)
    for length, n in counts.items():
        array[length] = n
    used = np.zeros(41, dtype=np.int64)
    sequences = 0
    for lengths, times in packing.plan_sequences(array, 40):
        assert sum(lengths) <= 40 and times > 0
        sequences += times
        for length in lengths:
            used[length] += times
    assert (used == array).all()
    # two sequences never fit into one
    assert sequences < 1 + 2 * (array * np.arange(41)).sum() / 40
