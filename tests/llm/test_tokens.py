"""Token files and byte-level BPE against whole-text encoding."""
import base64
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from fieldpulse.llm import block_coder, byte_bpe, context_coder, queries, token_files
from fieldpulse.llm._text import buffers


@pytest.fixture(scope="module")
def whole():
    with open(queries.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_safe_boundaries_give_the_same_ids(whole, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 40)
    codec = byte_bpe.codec(queries.RANKS, P.PATTERN)
    rnd = random.Random(1)
    parts = ["word", "'s", " ", "  ", "\n", "\t", "é", "12", "!!", "　", "\x1c", "\x85", "a" * 30, " " * 5]
    for _ in range(200):
        t = "".join(rnd.choice(parts) for _ in range(60))
        t += " " * rnd.choice([0, 513, 600]) + rnd.choice(["", "x", "\n", "\x1d y", "\x1cz"]) + t
        ids = codec.encode(t)
        assert ids == whole.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_cached_pieces_give_the_same_ids(whole):
    encoder = token_files.encoder(queries.TOKENIZER)
    rnd = random.Random(2)
    parts = ["word", "'s", "'", " ", "  ", "\n", "\n\n", "\t", "é", "œ", "Ж", "12", "!!", ".", "　", "\x1c", "²", "×", "A"]
    texts = ["".join(rnd.choice(parts) for _ in range(40)) for _ in range(400)] + ["", " ", "\n", "<|endoftext|>"]
    data, offsets = buffers(pa.array(texts))
    for _ in range(2):                                       # the second time every piece is known
        ids, at = encoder.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [whole.encode_ordinary(t) for t in texts]
    ids, at = encoder.encode(*buffers(pa.array(["", ""])))
    assert len(ids) == 0 and at.tolist() == [0, 0, 0]


def test_added_tokens_give_the_ids_of_the_library():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.TOKENIZER)
    encoder = token_files.encoder(queries.TOKENIZER, True)
    rnd = random.Random(8)
    parts = ["word", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "Ж", "12", "!!", ".", "<", "|>", "<|endof", "text|>"]
    parts += ["<|endoftext|>"] * 4
    texts = ["".join(rnd.choice(parts) for _ in range(30)) for _ in range(400)]
    texts += ["a <|endoftext|> b", "<|endof", "text|>", "<|endoftext|", ">", "", "<|endoftext|>", "<|endoftext|><|endoftext|>x"]
    data, offsets = buffers(pa.array(texts))
    for _ in range(2):
        ids, at = encoder.encode(data, offsets)
        got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[400] == [64, 220, 50256, 275]


def test_plain_words_take_the_short_way():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.TOKENIZER)

    class Counted:
        model, sent = library.model, []

        def encode_batch(self, pieces, **kind):
            self.sent += pieces
            return library.encode_batch(pieces, **kind)

    encoder = token_files.Encoder(queries.TOKENIZER)
    encoder.tokenizer = Counted()
    words = ["word", " word", "A", " Größe", "ÿœǅɏ", " " + "x" * 300, "é"]
    others = ["", " ", "  word", "two words", "it's", "a1", "×", " ÷", "Ж", "x\n", "\nx", "word,", "<|endoftext|>"]
    got = encoder._encoded(words + others)
    assert got == [library.encode(t, add_special_tokens=False).ids for t in words + others]
    assert Counted.sent == others
    # only for a tokenizer that leaves a single word as it is
    parts = json.loads(library.to_str())
    assert token_files._is_plain(parts)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None},
                   {"pre_tokenizer": {**parts["pre_tokenizer"], "add_prefix_space": True}},
                   {"model": {**parts["model"], "dropout": 0.1}}):
        assert not token_files._is_plain({**parts, **change})


def test_token_files_query_keeps_added_tokens(spark, scratch):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.TOKENIZER)
    texts = ["a <|endoftext|> b", "plain", None, "x<|endoftext|>\n<|endoftext|>", "after"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    want, at = [], 0
    for d, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op1_token_files(spark, scratch).collect()) == want


def test_runs_that_overflow_the_library(whole):
    codec = byte_bpe.codec(queries.RANKS, P.PATTERN)
    for t in (" " * 2_000_000, " \n" * 600_000 + "x", "a" * 300_000 + " b"):
        assert codec.decode(codec.encode(t)) == t.encode()


def test_bpe_rows(spark, odd, empty, whole):
    got = byte_bpe.decode(byte_bpe.encode(odd, queries.RANKS, P.PATTERN), queries.RANKS, P.PATTERN)
    rows = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.raw), bytes(r.ids)) for r in got.collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").encode(),
                   np.array(whole.encode_ordinary(r.text or ""), "<u4").tobytes()) for r in odd.collect())
    assert rows == want
    assert byte_bpe.decode(byte_bpe.encode(empty, queries.RANKS, P.PATTERN), queries.RANKS, P.PATTERN).count() == 0
    trips = byte_bpe.round_trip(odd, queries.RANKS, P.PATTERN, keep_ids=True)
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.n_tokens) for r in trips.collect()) == sorted(
        (a, b, ids, len(ids) // 4) for a, b, _, ids in want)
    assert byte_bpe.round_trip(empty, queries.RANKS, P.PATTERN).count() == 0


def test_bpe_query(spark, data_dir, whole):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op5_byte_bpe(spark, data_dir).collect()}
    want = {}
    for d, t in docs.items():
        ids = whole.encode_ordinary(t)
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want


def test_coder_round_trips():
    rng = np.random.default_rng(5)
    n = context_coder.BLOCK
    for ids in (rng.integers(0, 65536, (3, n)), np.zeros((2, n)), np.full((1, n), 65535), rng.integers(0, 3, (4, n)),
                rng.zipf(1.3, (5, n)) % 50000):
        ids = ids.astype(np.uint16)
        blocks = context_coder.encode(ids)
        assert (context_coder.decode(blocks) == ids).all()
        # each block stands for itself
        assert (context_coder.decode(blocks[-1:]) == ids[-1:]).all()
    # the bytes of version 1 of the format
    fixed = ((np.arange(20 * n) ** 2 // 7 % 1013) * (np.arange(20 * n) % 11 > 2)).astype(np.uint16).reshape(20, n)
    assert hashlib.sha256(b"".join(context_coder.encode(fixed))).hexdigest() == "7999e14f4a0c3b110e8d9fbb822d13be6a7def5e356448dffcb9901abbd35ef1"
    assert context_coder.encode(np.zeros((0, n), np.uint16)) == [] and context_coder.decode([]).shape == (0, n)
    skewed = (rng.zipf(1.5, (2, n)) % 300).astype(np.uint16)
    assert sum(map(len, context_coder.encode(skewed))) < skewed.nbytes * 0.6


def test_block_coder_round_trips():
    rng = np.random.default_rng(6)
    n = block_coder.BLOCK
    for ids in (rng.integers(0, 65536, (3, n)), np.zeros((2, n)), np.full((1, n), 65535), rng.integers(0, 3, (4, n)),
                rng.zipf(1.3, (40, n)) % 50000, np.tile(rng.integers(0, 65536, 700), (2, 3))[:, :n]):
        ids = ids.astype(np.uint16)
        blocks = block_coder.encode(ids)
        assert (block_coder.decode(blocks) == ids).all()
        # each block stands for itself
        assert block_coder.encode(ids[-1:]) == blocks[-1:] and (block_coder.decode(blocks[-1:]) == ids[-1:]).all()
        # a model that is renewed in steps is about as good as one that moves with each id
        assert sum(map(len, blocks)) < 1.03 * sum(map(len, context_coder.encode(ids))) + 40 * len(ids)
    assert block_coder.encode(np.zeros((0, n), np.uint16)) == [] and block_coder.decode([]).shape == (0, n)


def test_segments_of_both_versions_are_read(monkeypatch):
    ids = [np.arange(5000, dtype=np.uint32) % 700, np.zeros(3, np.uint32)]
    new = token_files.pack([4, None], ids)
    with monkeypatch.context() as m:
        m.setattr(token_files, "C", context_coder)
        m.setattr(token_files, "VERSION", 1)
        old = token_files.pack([4, None], ids)
    assert new != old and (new[4], old[4]) == (2, 1)
    for blob in (new, old):
        names, lengths, flat = token_files.unpack(blob)
        assert names == [4, None] and lengths.tolist() == [5000, 3] and (flat == np.concatenate(ids)).all()
    with pytest.raises(ValueError):
        token_files.unpack(new[:4] + b"\x03" + new[5:])


def test_cuts_between_bytes():
    texts = ["", "a b", "a\nb", " \nb", "é b", "×,a", "é,a", "a\tb1.c", "\n", "x\n\ny", "1,2 3", "Ж b", "~\nZ"]
    data, offsets = buffers(pa.array(texts))
    raw, want = data.tobytes(), {x for x in offsets[:-1].tolist() if x < len(data)}
    solid, letter = (lambda x: 0x21 <= x < 0x7F), (lambda x: chr(x).isalpha() and x < 0x80)
    for i in range(1, len(raw)):
        one, two, here = raw[i - 1], raw[i - 2] if i > 1 else 0, raw[i]
        latin = two == 0xC3 and one >= 0x80
        punctuation = here == 9 or solid(here) and not letter(here) and not 0x30 <= here < 0x3A
        if ((solid(one) or latin) and here in b" \n" or (letter(one) or latin and one not in (0x97, 0xB7)) and punctuation
                or one == 10 and solid(two) and letter(here)):
            want.add(i)
    assert token_files.cuts(data, offsets).tolist() == sorted(want)


def test_damage_is_noticed():
    blob = token_files.pack([1, None], [np.arange(3000, dtype=np.uint32), np.zeros(1, np.uint32)])
    ids, lengths, flat = token_files.unpack(blob)
    assert ids == [1, None] and lengths.tolist() == [3000, 1] and flat.tolist() == [*range(3000), 0]
    for at in (40, len(blob) - 5):
        bad = blob[:at] + bytes([blob[at] ^ 1]) + blob[at + 1:]
        with pytest.raises(ValueError):
            token_files.unpack(bad)
    with pytest.raises(ValueError):
        token_files.pack([1], [np.array([70000], np.uint32)])


def _expect(rows, whole):
    at, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = whole.encode_ordinary(t or "") + [0]
        out.append((d, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def test_token_files(spark, odd, empty, whole, scratch, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 5000)
    token_files.write(odd, f"{scratch}/t", queries.TOKENIZER)
    got = token_files.read(spark, f"{scratch}/t").orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == _expect(
        [(r.doc_id, r.text) for r in odd.collect()], whole)
    token_files.write(empty, f"{scratch}/e", queries.TOKENIZER)
    assert token_files.read(spark, f"{scratch}/e").count() == 0


def test_token_files_query(spark, data_dir, whole):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op1_token_files(spark, data_dir).collect())
    assert got == sorted((d, at, n, zlib.crc32(raw)) for d, at, n, raw in _expect(rows, whole))
