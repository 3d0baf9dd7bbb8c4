"""Token operators against the tokenizers library."""

import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from arborlake.llm import bpe, bpe_codec, token_counts, token_files

ALPHABET = ["a", "B", "é", " ", " ", "\n", "\t", "'", "'s", "'re", "'ll", "'lle", "1", "²", "!", "?", "  ", " ", "\u0085", "\x1c", "　", "中", "\U0001f600", "<|endoftext|>", "\x00", "​", "x'd", "<|"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(1500)] + ["", "aaaa" * 200, "=-" * 300, "don't 're  'lx"]


def test_encode(library, texts):
    ids, ptr = bpe.vocabulary(bpe.default_path()).encode(texts)
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[ptr[k] : ptr[k + 1]].tolist() == e.ids


def test_every_prefix(library, texts):
    flat, ptr = token_counts.counter(bpe.default_path()).texts(texts)
    for k, t in enumerate(texts[::4] + texts[-4:]):
        k = (texts[::4] + texts[-4:]).index(t)
        i = texts.index(t)
        counts = np.cumsum(flat[ptr[i] : ptr[i + 1]], dtype=np.int64)
        prefixes = [t[:j] for j in range(1, len(t) + 1)]
        want = [len(e.ids) for e in library.encode_batch(prefixes, add_special_tokens=False)]
        assert [int(counts[len(p.encode()) - 1]) for p in prefixes] == want


def test_truncation(spark, library):
    text = "The quick brown fox can't jump over 12 lazy dogs.  No!"
    got = token_counts.prefix_counts(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"))
    kept = {r.doc_id: r.n_bytes_kept for r in token_counts.longest_prefix(got, 7).collect()}
    assert kept[2] == 0 and len(library.encode(text[: kept[1]], add_special_tokens=False).ids) <= 7 < len(library.encode(text[: kept[1] + 1], add_special_tokens=False).ids)


def test_automaton_is_minimal_and_exact():
    words = sorted(f"{a}{b}ing".encode() for a in "abcdef" for b in "xyz")
    block = bpe_codec.compile_lexicon(words, bpe.default_path())
    lex = bpe_codec.Lexicon(block)
    assert lex.find(pa.array([*words, b"axin", b"", b"axings"], pa.binary())).tolist() == [*range(len(words)), -1, -1, -1]
    assert len(bpe_codec.Automaton(words).arcs) == 6  # start, letter, i, n, g, end


def test_codec_with_any_lexicon(spark, library, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts) if "\x00" not in t], "doc_id int, text string")
    want = {k: library.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}
    for lexicon in ([], [b"a", b" ", b"don", b"'ll"], None):
        for r in bpe_codec.round_trip(df, lexicon=lexicon).collect():
            ids = want[r.doc_id]
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe_codec.decode(bpe_codec.encode(df, lexicon=[])).collect()}
    assert all(back[r.doc_id] == r.text for r in df.collect())


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 20])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001)
    assert (token_files.unpack(token_files.pack(ids, bits), len(ids), bits) == ids).all()
    out = io.BytesIO()
    w = token_files.Writer(out, bits, 7)
    w.add([3], ids[:5000], np.array([5000]))
    w.add([None, 4], ids[5000:], np.array([5001, 0]))
    w.close()
    f = token_files.TokenFile(pa.BufferReader(out.getvalue()))
    assert f.bits == bits and f.first == 7 and (f.tokens(4000, 9000) == ids[4000:9000]).all() and (f.document(1) == ids[5000:]).all() and not len(f.document(2))
    assert f.doc_ids.tolist() == [3, 0, 4] and f.valid.tolist() == [1, 0, 1]


def test_token_files(spark, docs, sf, library):
    got = {r.doc_id: r for r in token_files.op10_token_files(spark, sf).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_odd_rows(spark, odd, empty, tmp_path):
    assert token_counts.prefix_counts(odd).count() == bpe_codec.round_trip(odd).count() == odd.count()
    where = f"file://{tmp_path}/t"
    assert token_files.read(token_files.write(odd, where), where).count() == odd.count()
    assert token_counts.prefix_counts(empty).count() == bpe_codec.round_trip(empty).count() == 0
    assert token_files.read(token_files.write(empty, where), where).count() == 0


def test_repeated_ids_have_one_order(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(token_files, "TASK_BYTES", 200)
    monkeypatch.setattr(token_files, "READ_IDS", 5)
    rows = [(k % 3 if k % 4 else None, f"text number {k} {'x ' * k}") for k in range(40)] + [(9, None), (9, ""), (9, "a")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = []
    for k, parts in enumerate((1, 7)):
        where = f"file://{tmp_path}/{k}"
        listed = token_files.write(df.repartition(parts), where)
        assert listed.count() > 2
        got.append(sorted(map(tuple, token_files.read(listed, where).collect()), key=lambda r: r[1]))
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert [r[1] for r in got[0]] == np.concatenate(([0], np.cumsum([r[2] for r in got[0]])[:-1])).tolist()
    want = sorted((i, zlib.crc32(b"".join(struct.pack("<I", x) for x in [*library.encode(t or "", add_special_tokens=False).ids, 2]))) for i, t in rows if i is not None)
    assert sorted((r[0], r[3]) for r in got[0] if r[0] is not None) == want


def test_long_pieces_and_special_strings(library):
    r = random.Random(8)
    texts = ["".join(r.choice("abAB") for _ in range(3000)), "=" * 1000 + "-" * 700, "aa" * 400 + "  " + "<|endoftext|>" * 3 + " \n <|endoftext|>b", "é" * 400]
    flat, ptr = token_counts.counter(bpe.default_path()).texts(texts)
    for k, t in enumerate(texts):
        counts = np.cumsum(flat[ptr[k] : ptr[k + 1]], dtype=np.int64)
        at = sorted({*range(1, len(t) + 1, 97), *range(max(1, len(t) - 60), len(t) + 1)})
        assert [int(counts[len(t[:j].encode()) - 1]) for j in at] == [len(e.ids) for e in library.encode_batch([t[:j] for j in at], add_special_tokens=False)]


def test_frequent_pieces_by_whole_counts(spark):
    """A piece that each small batch has once still counts."""
    df = spark.createDataFrame([(k, f"often w{chr(97 + k % 26)}{k}") for k in range(200)], "doc_id int, text string").repartition(50)
    assert b"often" in bpe_codec.frequent_pieces(df, n=1) or b" w" in bpe_codec.frequent_pieces(df, n=1)
    assert set(bpe_codec.frequent_pieces(df, n=2)) >= {b"often"}
