"""The exact encoder, the token table and packing."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tokenizers import Tokenizer

from turnloom.llm import encoder, packing, tokens
from turnloom.llm.encoder import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("slots", [64, 1 << 12])
def test_encoder_is_exact(slots):
    enc = Encoder(PATH, slots)
    rnd = random.Random(slots)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "\xa0", " ", "é ", "«", "'s", "1", ".", "…", "\x85", "　", "日本", " the", ",", "!", "<|endoftext|>", "\0"]
    for _ in range(60):
        texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 25))) for _ in range(20)]
        ids, bounds = enc.ids(texts)
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == enc.whole(t).tolist(), repr(t)


def test_units_that_share_a_hash(monkeypatch):
    """With every hash alike, the bytes alone tell units apart."""
    monkeypatch.setattr(encoder, "_MIX", (np.uint64(0),) * encoder.WORDS)
    monkeypatch.setattr(encoder, "LONG_BYTES", 64)
    plain, enc, rnd = Tokenizer.from_file(PATH), Encoder(PATH, 16), random.Random(4)
    parts = [" the", " house", " river", "\0", " a\0", " a", " unquestionably-long-compound-word", "日本語の長い文章です、ほんとうに", "."]
    for _ in range(30):
        texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(10)]
        ids, bounds = enc.ids(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_is_the_plain_library():
    plain, enc, rnd = Tokenizer.from_file(PATH), Encoder(PATH, 64), random.Random(9)
    parts = ["<|endoftext|>", "<|endoftext|", " ", "  ", "\n", "a", ",", ".", " the", "é"]
    texts = ["a <|endoftext|> b", "a  <|endoftext|>  b", "<|endoftext|>", "a <|endof text|> b", "", *("".join(rnd.choices(parts, k=rnd.randint(1, 12))) for _ in range(400))]
    ids, bounds = enc.ids(texts)
    got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [64, 220, 50256, 275]


def test_encoder_long_texts_and_none():
    enc = Encoder(PATH, 64)
    texts = ["", "word " * 400_000, "", "tail"]
    ids, bounds = enc.ids(texts)
    assert [int(b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [len(enc.whole(t)) for t in texts]
    assert enc.ids([])[0].size == 0 and enc.ids([])[1].tolist() == [0]


DOCS = [(3, "hello there, world"), (1, None), (2, ""), (1, "again"), (None, "x y"), (9, "the long one. " * 3000), (8, "ties"), (7, "ties"), (7, "ties")]


PLAIN = Tokenizer.from_file(PATH)


def expected(text):
    """By the library itself."""
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_token_table(spark, tmp_path):
    docs = spark.createDataFrame([(a, b, 1, "p") for a, b in DOCS], "doc_id long, text string, part int, ids string")
    out = f"file://{tmp_path}/t"
    tokens.write_tokens(docs, out, PATH)
    table = tokens.read_tokens(spark, out)
    rows = tokens.checksums(table).join(tokens.positions(table), "part").collect()
    rows.sort(key=lambda r: r["before"] + r["local_start"])
    at = 0
    for r in rows:
        assert r["before"] + r["local_start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 2, 3, 7, 7, 8, 9]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((a, len(e), zlib.crc32(e)) for a, b in DOCS for e in [expected(b)])
    import glob

    import pyarrow.parquet as pq

    meta = pq.ParquetFile(next(f for f in glob.glob(f"{tmp_path}/t/*.parquet") if pq.ParquetFile(f).metadata.num_rows)).metadata
    column = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings and column["ids.list.element"].has_offset_index
    tokens.write_tokens(docs.where("false"), f"{out}0", PATH)
    assert tokens.read_tokens(spark, f"{out}0").count() == 0


def check_packed(rows, docs, length):
    texts = defaultdict(list)
    for a, b in docs:
        texts[a].append(expected(b))
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(a for a, _ in docs)
    for r in rows:
        assert any(zlib.crc32(t[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for t in texts[r["doc_id"]])
    assert sum(r["length"] for r in rows) == sum(len(t) for v in texts.values() for t in v)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    return len(bins)


def test_packing(spark):
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in DOCS], "doc_id long, text string, bin int, uid int")
    rows = packing.pack_documents(docs, PATH).collect()
    total = sum(len(expected(b)) for _, b in DOCS)
    assert check_packed(rows, DOCS, 2048) == -(-total // 2048)
    assert packing.pack_documents(docs.where("false"), PATH).count() == 0


def test_packing_in_rounds(spark):
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(1, 64, 900)
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "uid long, length long")
    rows = packing.pack(items, 64, part=60, rounds=3).collect()
    assert sorted(r["uid"] for r in rows) == list(range(900))
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], int(sizes[r["uid"]])))
    for b in bins.values():
        at = 0
        for o, s in sorted(b):
            assert o == at
            at += s
        assert at <= 64
    one = len(packing.best_fit_decreasing(sizes, 64)[2])
    # fifteen tiny partitions come within a twentieth of one large one
    assert len(bins) <= 1.05 * one + 1 and len(bins) >= packing.lower_bound(sizes, 64)


def test_bounds_hold():
    rnd = np.random.default_rng(1)
    for cap in (10, 30, 100):
        for _ in range(40):
            sizes = rnd.integers(1, cap + 1, rnd.integers(1, 40))
            bins, offsets, fill = packing.best_fit_decreasing(sizes, cap)
            assert packing.lower_bound(sizes, cap) <= len(fill) and fill.max() <= cap and fill.sum() == sizes.sum()
    # six items of 6, capacity 10: volume says 4 bins, two never fit together
    assert packing.lower_bound(np.full(6, 6), 10) == 6
