"""Jaccard join, components and decontamination against brute force."""
import random
import re

import pytest

from fieldpulse.llm import components, decontaminate, jaccard_join, queries


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows, percent=80):
    """(sizes, smallest id of each row's component)."""
    sets = [word_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        known = [x for x in (lowest.get(find(i)), d) if x is not None]
        lowest[find(i)] = min(known) if known else None
    return [len(s) for s in sets], [lowest[find(i)] for i in range(len(rows))]


def check(spark, rows, parts=6):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.components(docs).collect()), key=str)
    want = sorted(((d is None, d or 0, n, c) for (d, _), n, c in zip(rows, *brute(rows))), key=str)
    assert got == want


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"edit{rnd.randrange(10**6)}"
    return words


def test_groups_of_copies(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [f"p{i}" for i in range(50)]
    texts = []
    for _ in range(12):                                      # originals with few and many edits, around the threshold
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(40, 160))]
        texts.append(base)
        texts += [edited(rnd, base, rnd.randrange(0, 5)) for _ in range(rnd.randrange(1, 9))]
    for _ in range(40):                                      # no original: copies that don't all reach one another
        texts.append(edited(rnd, texts[0], 3))
    for k in range(60):                                      # a passage and some words: equal crossing tokens
        texts.append([f"q{k}"] * (k % 3) + passage + [f"r{k}x{j}" for j in range(k % 9)])
    for k in range(30):                                      # parts of a longer text
        lo = rnd.randrange(100)
        texts.append([f"c{i}" for i in range(lo, lo + rnd.randrange(60, 200))])
    texts += [texts[1]] * 25 + [[]] * 3 + [["one"]] * 2 + [["a", "b"]] + [rnd.choices(vocabulary, k=30) for _ in range(60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(9000, None), (9001, None)]
    rnd.shuffle(rows)
    check(spark, rows)


def test_small_chunks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", 50)
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(50)}" for _ in range(80)]
    rows = [(k, " ".join(edited(rnd, base, k % 5))) for k in range(60)]
    check(spark, rows, 3)


def test_odd_rows(spark, odd, empty):
    check(spark, [(r.doc_id, r.text) for r in odd.collect()], 3)
    assert jaccard_join.components(empty).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None).count(6) == 1 and 7 not in ids and 101 not in ids
    assert None in ids and {0, 1, 2, 3} <= set(ids)          # nothing in common with anything
    assert jaccard_join.one_of_each(empty).count() == 0


def test_query(spark, data_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op9_jaccard_join(spark, data_dir).collect())
    assert got == sorted((d, n, c) for (d, _), n, c in zip(rows, *brute(rows)))


def test_links_at_the_limit_whatever_the_shuffle_partitions(spark):
    rows = []
    for k, shared in enumerate((8000, 7999, 8001)):              # of 9000 shingles each: 80 % exactly, below, above
        base = [f"b{k}x{i}" for i in range(9004)]
        rows += [(10 * k + 1, " ".join(base)),
                 (10 * k, " ".join(base[:shared + 4] + [f"e{k}x{i}" for i in range(9000 - shared)]))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "300"):                                   # 256 and 1024 shards
            spark.conf.set("spark.sql.shuffle.partitions", n)
            check(spark, rows, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert brute(rows)[1] == [0, 0, 11, 10, 20, 20]


@pytest.mark.parametrize("shards", [256, 1 << 14])
def test_tokens_are_compared_with_all_their_bits(shards):
    import numpy as np
    import pyarrow as pa
    first, last = (0xABCDEF0123456789 + k for k in (0, 1))       # differ in the lowest bit only
    high, other = 0xABCDEF0123456789 ^ (1 << 47), 0x0123456789ABCDEF
    out = []
    for number, held in enumerate(([first, high, other], [last, high ^ (1 << 40), other])):
        tokens = np.sort(np.array(held, np.uint64))
        meta = [np.zeros(1, np.int64).tobytes() + b"\1", np.array([3], np.int64).tobytes(), np.zeros(2, np.uint64).tobytes()]
        out += jaccard_join._pieces(number, shards, tokens, np.zeros(3, np.uint16), None, meta)
    pieces = pa.Table.from_batches(out)
    found = []
    for shard in pieces["shard"].unique().to_pylist():
        mine = pieces.filter(pa.array(pieces["shard"].to_numpy() == shard))
        told = jaccard_join._match(shards)((pa.scalar(shard),), mine)
        for r in told.filter(pa.array(told["kind"].to_numpy() == jaccard_join._KNOWN)).to_pylist():
            found += np.frombuffer(r["a"], np.uint64).tolist()
    assert found == [other, other]


def test_one_of_each_with_clashing_columns(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(2, text, 5, True), (1, text, 6, False), (1, text, 6, False), (None, text, 7, None), (3, "z", 8, None)],
                                 "doc_id long, text string, _odd long, _once boolean")
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((tuple(r) for r in left.collect()), key=str) == [(1, text, 6, False), (3, "z", 8, None), (None, text, 7, None)]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 400)] + [(500, 500), (7, 7)]
    got = {r.v: r.root for r in components.smallest_reachable(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 400)}}
    assert components.smallest_reachable(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def contained(docs, items, percent=80):
    def shingles(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    held = {}
    for d, t in docs:
        if d is not None:
            held.setdefault(d, set()).update(shingles(t))
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(shingles(t))
    return sorted((d, i, len(s & q), len(q)) for d, s in held.items() for i, q in asked.items()
                  if q and 100 * len(s & q) >= percent * len(q))


@pytest.mark.parametrize("rows", [decontaminate.SKETCH_ROWS, 0])
def test_decontamination(spark, odd, empty, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "SKETCH_ROWS", rows)
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(3, 60)))) for i in range(30)]
    items += [(0, items[1][1]), (None, "no id at all here today"), (50, None), (51, ""), (52, "a b c d e"), (53, "One")]
    docs = []
    for d in range(120):
        w = rnd.choices(vocabulary, k=rnd.randrange(0, 400))
        if d % 2:
            quote = rnd.choice(items[:30])[1].split()
            for _ in range(rnd.randrange(0, 3)):             # around the threshold
                quote[rnd.randrange(len(quote))] = "changed"
            at = rnd.randrange(len(w) + 1)
            w[at:at] = " ".join(quote).upper().replace(" ", ",  ").split(" ")
        docs.append((d, " ".join(w)))
    docs += [(r.doc_id, r.text) for r in odd.collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(df, bench)
    assert sorted(tuple(r)[:4] for r in got.collect()) == contained(docs, items)
    leaks = {d for d, *_ in contained(docs, items)}
    kept = decontaminate.remove(df, bench).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(d) for d, _ in docs if d not in leaks)
    assert decontaminate.remove(odd, bench).columns == odd.columns
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.find(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [decontaminate.SKETCH_ROWS, 0])
def test_short_items_are_found_inside_documents(spark, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "SKETCH_ROWS", rows)
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [(0, "Paris"), (1, "forty two"), (2, "a blue whale"), (3, "what is the capital"), (4, "水は百度で沸騰する。"),
             (5, "one two three four five"), (6, "one two three four five six seven"), (7, "..."), (8, None),
             (9, "forty two"), (9, "alpha beta gamma delta epsilon"), (None, "Paris")]
    filler = "some more words stand here so that this text is long "
    docs = [(0, filler + "the answer is PARIS, " + filler), (1, filler + "forty-two " + filler), (2, "a blue whale"),
            (3, filler + "two forty; a blue. Whale " + filler), (4, "What is the capital? " + filler),
            (5, "お茶。水は百度で沸騰する。" + filler), (6, "one two three four five six seven eight"), (7, "comparison parisian"),
            (8, ""), (9, None), (10, "whale"), (11, filler + "forty two " + "alpha beta gamma delta epsilon"),
            (12, "forty"), (12, "two"), (None, "paris")]
    asked, held = {}, {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            asked.setdefault(i, set()).update(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    for d, t in docs:
        if d is not None:
            held.setdefault(d, set()).update(tuple(words(t)[k:k + n]) for n in range(1, 6) for k in range(len(words(t)) - n + 1))
    want = sorted((d, i, len(s & q), len(q)) for d, s in held.items() for i, q in asked.items()
                  if 100 * len(s & q) >= 80 * len(q))
    assert {(0, 0), (1, 1), (3, 2), (4, 3), (5, 4), (11, 9)} <= {(d, i) for d, i, *_ in want}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r)[:4] for r in decontaminate.find(df, bench).collect()) == want
    left = sorted(str(r.doc_id) for r in decontaminate.remove(df, bench).collect())
    assert left == sorted(str(d) for d, _ in docs if d not in {d for d, *_ in want})


def test_native_operators_run_no_python(spark, data_dir):
    import contextlib
    import io
    for query in (queries.op3_url_filter, queries.op7_decontaminate):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            query(spark, data_dir).explain("extended")
        assert not re.search("Python|Pandas|Arrow", text.getvalue())
