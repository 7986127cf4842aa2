"""Line dedup against brute force, and taking documents back."""
import random
from collections import Counter

import numpy as np
import pytest

from fieldpulse.llm import line_dedup as L


def brute(texts, min_docs):
    def key(line):
        return line.strip(" \t\n\v\f\r").translate({i: i + 32 for i in range(65, 91)})

    held = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or held[key(x)] < min_docs]
        out.append((None if t is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def _texts():
    rnd = random.Random(2)
    common = ["Read more", " read MORE\t", "subscribe now", "é accents É", "x"]
    return ["\n".join(rnd.choice(common + [f"own line {rnd.randrange(300)}", "", "  "]) for _ in range(rnd.randrange(8)))
            for _ in range(120)] + [None, "", "read more\nread more\nread more"]


@pytest.mark.parametrize("bound", [L.BROADCAST_BYTES, 0])
def test_drop_lines(spark, bound):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5, "doc_id")
    index = L.LineIndex(spark, min_docs=10).insert(docs)
    got = {r.doc_id: (r.text, r.a, r.b) for r in index.drop_lines(docs, n_lines="a", n_dropped="b", broadcast_bytes=bound).collect()}
    assert got == dict(enumerate(brute(texts, 10)))
    assert any(b for _, _, b in got.values())


def test_odd_rows(spark, odd, empty):
    index = L.LineIndex(spark, min_docs=2).insert(odd)
    for bound in (L.BROADCAST_BYTES, 0):
        got = index.drop_lines(odd, broadcast_bytes=bound)
        assert got.columns == [*odd.columns, "n_lines", "n_dropped"] and got.count() == odd.count()
        rows = odd.collect()
        want = brute([r.text for r in rows], 2)
        key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=key) == sorted(
            ((r.doc_id, *w) for r, w in zip(rows, want)), key=key)
    assert index.drop_lines(empty).count() == 0
    none = L.LineIndex(spark, min_docs=2).insert(empty)
    assert none.refs().count() == 0 and none.drop_lines(odd).agg({"n_dropped": "sum"}).first()[0] == 0


def test_insertions_and_deletions_are_reversible(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first, second = docs.filter("doc_id < 60"), docs.filter("doc_id >= 60")
    state = lambda i: sorted(map(tuple, i.refs().collect()))
    index = L.LineIndex(spark, min_docs=10, keys_per_shard=2).insert(first)
    before = state(index)
    index.insert(second)
    assert state(index) == state(L.LineIndex(spark, min_docs=10).insert(docs))
    filters = [(r.shard, r.shards, L.CuckooFilter.load(bytes(r.filter))) for r in index.filters().collect()]
    for r in index.hot_keys().collect():
        h = np.array([r.h], np.int64).view(np.uint64)
        assert any(f.has(h)[0] for s, n, f in filters if s == L.shard_of(h, n)[0])
    index.delete(second)
    assert state(index) == before
    held = sum(r["keys"] for r in index.filters().collect())
    assert held == index.hot_keys().count()
    got = {r.doc_id: r.text for r in index.drop_lines(first).collect()}
    assert got == {i: t for i, (t, _, _) in enumerate(brute(texts[:60], 10))}
    index.delete(first)
    assert state(index) == [] and index.hot_keys().count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2)
    f = L.CuckooFilter(2 * len(h))
    assert f.add(h) and f.has(h).all()
    other = rng.integers(0, 2**63, 20000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert f.has(other).mean() < 0.002
    f.remove(h[:2000])
    assert f.has(h[2000:]).all() and f.has(h[:2000]).mean() < 0.002
    assert (L.CuckooFilter.load(f.blob()).table == f.table).all()
    assert not L.CuckooFilter(16).add(h)                         # too full to hold


def test_index_is_opened_again(spark, tmp_path):
    """Insert in one job, delete and drop in others, on both sides of the broadcast limit."""
    path = str(tmp_path / "index")
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    L.LineIndex(spark, path, min_docs=10).insert(docs.filter("doc_id < 60"))
    L.LineIndex(spark, path, min_docs=10).insert(docs.filter("doc_id >= 60"))
    index = L.LineIndex(spark, path, min_docs=10)
    assert index.version == 2
    assert sorted(map(tuple, index.refs().collect())) == sorted(map(tuple, L.LineIndex(spark, min_docs=10).insert(docs).refs().collect()))
    # a version that was not finished does not count, and is written over
    index.refs().write.parquet(f"{path}/v3/changed")
    index = L.LineIndex(spark, path, min_docs=10).delete(docs.filter("doc_id < 30"))
    assert index.version == 3
    rest = docs.filter("doc_id >= 30")
    want = {i + 30: t for i, (t, _, _) in enumerate(brute(texts[30:], 10))}
    for bound in (L.BROADCAST_BYTES, 0):
        got = L.LineIndex(spark, path, min_docs=10).drop_lines(rest, broadcast_bytes=bound)
        assert {r.doc_id: r.text for r in got.collect()} == want
    with pytest.raises(ValueError):
        L.LineIndex(spark, path, min_docs=11)


def test_a_document_that_is_not_there_cannot_be_taken_back(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "a\nb"), (2, "a")], "doc_id long, text string")
    index = L.LineIndex(spark, path, min_docs=2).insert(docs)
    before = sorted(map(tuple, index.refs().collect()))
    with pytest.raises(ValueError):
        index.delete(spark.createDataFrame([(3, "a\nc")], "doc_id long, text string"))
    again = L.LineIndex(spark, path, min_docs=2)
    assert again.version == 1 and sorted(map(tuple, again.refs().collect())) == before


def test_clashing_names_on_both_paths(spark):
    names = ["_lines", "_text_key", "_hot", "_n_lines", "_n_dropped", "n_lines"]
    docs = spark.createDataFrame([(i, "same\nown %d" % i, *range(6)) for i in range(4)],
                                 "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    index = L.LineIndex(spark, min_docs=3).insert(docs)
    results = [index.drop_lines(docs, broadcast_bytes=b) for b in (L.BROADCAST_BYTES, 0)]
    assert results[0].columns == results[1].columns == ["doc_id", "text", *names[:-1], "n_lines", "n_dropped"]
    rows = [sorted(map(tuple, r.collect())) for r in results]
    assert rows[0] == rows[1] == [(i, "own %d" % i, 0, 1, 2, 3, 4, 2, 1) for i in range(4)]
