"""Encoding by chunks against the library on whole texts; token files and packing against plain restatements."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fundscope.llm import packing, token_files, tokens

TEXTS = ["", None, "one", " lead", "trail ", "a b\nc\n\nd", "it's we'll x1y22 don't!! <|endoftext|> <|startoftext|>z", "é è ç ñ x",
         "tab\tsep  two", "ΑΣ Σας İI éa ½ Ⅷ K", "ab|cd | ef, gh. 😀 😀😀 x😀", "\n", "  ", "a" * 3000, "漢字 かな 한글 a_b __ c"]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_chunks_equal_whole_texts(name, kind):
    path = public_tokenizers.path(name)
    rng = random.Random(5)
    bits = ["the", "Thing", "é", "été,", "x's", "12", " ", "\n", " ", "!!", "$$$", "<|endoftext|>", "\t", "Σ", "_", "'ll", "ß"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    library = Tokenizer.from_file(path)
    own = tokens.Encoder(path, kind)
    for _ in range(2):
        got = own.encode(texts)
        for text, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_files_round_trip(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i * 3 % 101, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(60))), "x") for i in range(101)]
    rows += [(200, "w " * 90_000, "long"), (None, "no id", "n"), (7, "again", "x"), (300, None, "x"), (301, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(7)
    path = public_tokenizers.path("word_bpe_49k.json")
    files = token_files.write_files(docs, str(tmp_path / "out"), path, "word", 1).cache()
    got = sorted(token_files.read_files(token_files.with_starts(files)).collect(), key=lambda r: r["start"])
    library, start = Tokenizer.from_file(path), 0
    expected = []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == expected
    last = sorted(r["file"] for r in files.collect())[-1]
    reader = token_files.Reader(last)
    assert len(reader.entries) >= 2 and reader.doc_ids[-1] == 301 and reader.ids(len(reader.counts) - 1) == b"\1\0\0\0"
    assert token_files.write_files(docs.limit(0), str(tmp_path / "none"), path).count() == 0


def test_damage_is_seen(tmp_path):
    w = token_files.Writer(str(tmp_path), "f")
    w.add(1, b"abcd" * 50)
    w.close()
    data = bytearray((tmp_path / "f").read_bytes())
    data[len(data) // 8] ^= 1
    (tmp_path / "f").write_bytes(bytes(data))
    with pytest.raises(Exception):
        token_files.Reader(str(tmp_path / "f")).ids(0)


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randrange(0, 400), i) for i in range(150)] + [(900, None, 1), (None, "x y", 2), (5, "same id", 3), (901, "long text " * 3000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset long")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, "byte", 2, 256, with_ids=True).collect()
    library = Tokenizer.from_file(path)
    lengths = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sum(r["length"] for r in got) == sum(lengths)
    bins = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["piece"] == 0 or r["length"] == 256
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(lengths) // 256) + 2
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([6, 4, 5, 5, 7, 3, 6, 4])
    bins = [[0], [1, 2], [3, 4 - 1 + 2], [4], [6], [7]]
    bins = [[0, 5], [1, 2], [3], [4], [6], [7]]
    room = np.array([10 - sum(int(lengths[i]) for i in b) for b in bins])
    out = packing.local_search(lengths, bins, room, 10)
    assert sorted(i for b in out for i in b) == list(range(8)) and len(out) == 4
    assert all(sum(int(lengths[i]) for i in b) <= 10 for b in out)


def test_local_search_tries_every_bin():
    lengths = np.array([60] * 70 + [20, 20, 20, 1, 80, 80, 80, 99])
    bins = [[k] for k in range(70)] + [[70, 71, 72, 73]] + [[k] for k in range(74, 78)]
    room = np.array([100 - sum(int(lengths[i]) for i in b) for b in bins])
    out = packing.local_search(lengths, bins, room, 100)
    assert sorted(i for b in out for i in b) == list(range(78)) and len(out) == 74
    assert all(sum(int(lengths[i]) for i in b) <= 100 for b in out)


def test_equal_rows_are_dealt_over_groups(spark):
    cut = spark.createDataFrame([(None, 0, 0, 10, 5)] * 400, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(cut, 100, group_pieces=50).collect()
    groups = {}
    for r in got:
        groups[r["sequence_id"] >> 32] = groups.get(r["sequence_id"] >> 32, 0) + 1
    assert len(got) == 400 and len(groups) == 8 and max(groups.values()) < 100
