"""Cross-tokenizer alignment against whole texts and plain loops."""
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldpulse.llm import queries
from fieldpulse.llm import token_alignment as TA

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    return a, b, TA._bytes_of_bpe(A_PATH)[1], TA._bytes_of_pieces(B_PATH)[1]


def plain(tokenizers, texts):
    """Rows by loops over whole texts: encode, join, compare, cut, link, count."""
    a, b, a_bytes, b_bytes = tokenizers
    docs, counts = [], Counter()
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if not text or any(b"".join(v[i] for i in ids) != want for ids, v in ((x, a_bytes), (y, b_bytes))):
            docs.append(None)
            continue
        ends = [np.cumsum([len(v[i]) for i in ids]).tolist() for ids, v in ((x, a_bytes), (y, b_bytes))]
        spans = [list(zip([0] + e[:-1], e)) for e in ends]
        overlaps, j0 = 0, 0
        for lo, hi in spans[0]:
            while spans[1][j0][1] <= lo:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < hi:
                overlaps, j = overlaps + 1, j + 1
        cuts = sorted(set(ends[0]) & set(ends[1]))
        of_a, of_b = dict(zip(ends[0], x)), dict(zip(ends[1], y))
        links = [(of_a[c], of_b[c]) for c in cuts]
        groups, i, j = [], 0, 0
        for c in cuts:
            i2, j2 = i, j
            while i2 < len(x) and ends[0][i2] <= c:
                i2 += 1
            while j2 < len(y) and ends[1][j2] <= c:
                j2 += 1
            groups.append((x[i:i2], y[j:j2]))
            i, j = i2, j2
        counts.update(links)
        docs.append((x, y, groups, links, overlaps))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0, 0))
            continue
        x, y, groups, links, overlaps = d
        told = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(told.encode()).hexdigest(), overlaps,
                    sum(len(p) * len(q) for p, q in groups)))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def test_query_equals_plain_loops(spark, data_dir, tokenizers):
    rows = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, plain(tokenizers, [r.text for r in rows]))]
    got = [tuple(r) for r in queries.op13_token_alignment(spark, data_dir).collect()]
    assert sorted(got) == sorted(want)
    assert sum(g[1] > 0 for g in got) > 100


@pytest.mark.parametrize("limit", [TA.BROADCAST_PAIRS, 0])
def test_odd_rows_joined_either_way(spark, odd, tokenizers, limit):
    rows = odd.select("doc_id", "text").collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, plain(tokenizers, [r.text for r in rows]))]
    got = TA.alignment(spark, odd, A_PATH, B_PATH, broadcast_pairs=limit)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_blocks_and_borders(tokenizers, monkeypatch):
    """Scripts without spaces, newlines, special strings and U+2581, whole and in small blocks."""
    texts = ["日本語のテキスト。\n次の行 ここ", "a\nb\n\nc", "<s> x </s><|endoftext|> y", "tab\there", "naïve café dur",
             "x▁y", "two  spaces", "trailing ", " leading", "\nstart", "emoji 😀😃 mix 😀", "é\né", "Ünï sp",
             "word " * 400 + "end", "日本" * 3000, "it's we'll 12,345.67 --- ...", " ", "á̀ b"]
    want = plain(tokenizers, texts)
    data = [t.encode() for t in texts]
    flat = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(list(map(len, data)))])
    for block in (1 << 20, 64):
        monkeypatch.setattr(TA, "BLOCK", block)
        table = TA.Aligner(A_PATH, B_PATH)
        for _ in range(2):                                       # the second time from the entries kept
            out = TA._Rows(len(texts), np.zeros(len(texts), bool))
            for b in table.align(*TA._spaced(flat, offsets)):
                out.add(*b, len(table.a_length) * len(table.b_length))
            import pyarrow as pa
            rows = out.batch(pa.array(range(len(texts))), 0).to_pylist()
            got = [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_overlaps", "n_shared"))
                   for r in rows]
            assert got == [w[:4] + w[6:] for w in want]


def test_equal_hashes_are_told_apart(tokenizers, monkeypatch):
    monkeypatch.setattr(TA.T, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    table = TA.Aligner(A_PATH, B_PATH)
    text = b"one two three one four"
    blocks = list(table.align(*TA._spaced(np.frombuffer(text, np.uint8), np.array([0, len(text)]))))
    (w,) = plain(tokenizers, [text.decode()])
    assert tuple(blocks[0][2][0][:4]) == w[:4]


def test_links_of_each_kind(spark, tokenizers):
    df = spark.createDataFrame([(1, "Cross-tokenizer alignments überall"), (2, None), (3, "U+2581 \u2581 becomes a space")], "doc_id long, text string")
    (w,) = plain(tokenizers, ["Cross-tokenizer alignments überall"])
    got = {k: TA.links(df, A_PATH, B_PATH, k).collect() for k in ("overlap", "end", "group")}
    assert [len(got[k]) for k in ("end", "overlap", "group")] == [w[3], w[7], w[8]]
    assert {r.doc_id for r in got["overlap"]} == {1}
    assert sum(r.bytes for r in got["overlap"]) == len(" Cross-tokenizer alignments überall".encode())
    assert {(r.a_at, r.b_at, r.bytes) for r in got["overlap"]} == {(r.a_at, r.b_at, r.bytes) for r in got["group"] if r.bytes}


def test_product_adds_equal_columns():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 3, (6, 5)) * (rng.random((6, 5)) < 0.5), rng.integers(0, 3, (5, 4))

    def csr(m):
        return TA.Csr(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), np.nonzero(m)[1], m[m != 0], m.shape[1])

    def dense(c, n):
        out = np.zeros((n, c.width), np.int64)
        out[c.rows(), c.columns] = c.values
        return out

    assert (dense(csr(x).product(csr(y)), 6) == x @ y).all()
    assert (dense(csr(x).transposed(), 5) == x.T).all()


def test_empty_table(spark, empty):
    assert TA.alignment(spark, empty, A_PATH, B_PATH).count() == 0
