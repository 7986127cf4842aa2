"""Row-wise operators against plain Python, and the URL filter against its SQL."""
import random
import re
from collections import Counter

import duckdb
import pytest

from fieldpulse.llm import language_id, license_scan, quality_bands, queries, toxicity_cnn, url_filter

from .conftest import prose

KEY = lambda r: (r[0] is None, r[0] or 0, str(r))


def base_of_licence(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    found = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licence_scan(spark, odd, empty):
    texts = [r.text for r in odd.collect()] + [
        "CC BY 4.0 and cc-by-sa; All Rights Reserved.", "gnu General  public\nlicense", "all rights", "reserved all rights",
        "cc cc by by", "ccby éccby cc by", "rights all rights reserved all rights reserved", "licensed under the MIT license",
        "Licensed under the Apache License, Version 2.0", "general public", "license", ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of_licence(t), t
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels) == bool(r.spans)
    by = {t: rows[k].labels for k, t in enumerate(texts)}
    assert by["CC BY 4.0 and cc-by-sa; All Rights Reserved."] == "cc-by,cc-by-sa,reserved"
    assert by["licensed under the MIT license"] == "mit" and by["Licensed under the Apache License, Version 2.0"] == "apache-2.0"
    assert license_scan.scan(empty).count() == 0
    assert license_scan.scan(odd).count() == odd.count()


def test_a_hit_across_documents_hides_no_licence(spark):
    texts = ["some music", "CC BY licence", "music", "cc by sa", "x", "cc", "cc by"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of_licence(t), t
    assert [rows[k].labels for k in range(len(texts))] == ["", "cc-by", "", "cc-by,cc-by-sa", "", "", "cc-by"]


def test_licence_query(spark, data_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    for r in queries.op8_license_scan(spark, data_dir).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of_licence(texts.pop(r.doc_id))
    assert not texts


def base_of_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_quality_rules(spark, odd, empty):
    rnd = random.Random(6)
    texts = [r.text for r in odd.collect()] + ["a b c d e f g h " * 5, "# * $ % & | < >", "x\nx\n x\n\nx",
                                              prose(rnd, "en", 300) + " " + "same words here again and then some more " * 3,
                                              "".join(chr(rnd.randrange(33, 126)) if rnd.random() > .1 else " " for _ in range(9000))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in quality_bands.score(docs).collect()}
    for k, t in enumerate(texts):
        assert tuple(got[k])[1:7] == base_of_quality(t), t
        assert not (got[k].base_failed and got[k].kept)
    assert not got[len(texts) - 1].kept                     # random characters don't compress
    assert quality_bands.score(empty).count() == 0


def test_compression_bands():
    import zstandard
    z, bands = zstandard.ZstdCompressor(level=1), quality_bands.Bands()
    rnd = random.Random(9)
    for n in (30, 200, 1500, 12000):
        assert quality_bands._verdict(prose(rnd, "en", n).encode(), bands, z)[2], n
    assert not quality_bands._verdict(b"buy now! " * 400, bands, z)[2]
    assert not quality_bands._verdict(rnd.randbytes(5000), bands, z)[2]
    assert not quality_bands._verdict(prose(rnd, "en", 300).encode() + rnd.randbytes(40000), bands, z)[2]
    assert quality_bands._verdict(b"", bands, z)[2]


def test_random_text_lies_below_the_bands():
    import string

    import zstandard
    z, bands = zstandard.ZstdCompressor(level=1), quality_bands.Bands()
    rnd = random.Random(14)
    base64 = string.ascii_letters + string.digits + "+/"
    for n in (260, 300, 511, 512, 700, 1023, 1024, 1500, 4096, 5000, 8191, 8192, 9000, 65535, 65536, 80000):
        words = " ".join("".join(rnd.choices(base64, k=12)) for _ in range(n // 13 + 1))[:n]
        printable = "".join(" " if rnd.random() < 0.1 else chr(rnd.randrange(33, 127)) for _ in range(n))
        for text in (words, printable):
            ratio, share, kept = quality_bands._verdict(text.encode(), bands, z)
            assert not kept and len(text.split()) >= 20, (n, ratio)
            assert share == 1 or n < bands.chunk_bytes, (n, share)


def test_the_end_of_a_text_is_a_chunk():
    import zstandard
    z, bands = zstandard.ZstdCompressor(level=1), quality_bands.Bands()
    rnd = random.Random(15)
    size = bands.chunk_bytes
    clean, noise = prose(rnd, "en", 3000).encode(), rnd.randbytes(3 * size)
    assert quality_bands._verdict(clean[:size] + noise[:size - 1], bands, z)[1] == 1 / 2
    assert quality_bands._verdict(clean[:2 * size] + noise[:size - 1], bands, z)[1] == 1 / 3
    assert quality_bands._verdict(clean[:2 * size], bands, z)[1:] == (0, True)
    assert quality_bands._verdict(noise[:size - 1], bands, z)[1:] == (1, False)
    assert quality_bands._verdict(clean[:size - 1], bands, z)[1:] == (0, True)
    # one clean chunk and a rest of noise beside a chunk of it: two bad of three, whatever the whole text gives
    wide = quality_bands.Bands(whole=((0, 0.0, float("inf")),))
    assert not quality_bands._verdict(clean[:size] + noise[:2 * size - 1], wide, z)[2]


def test_quality_query(spark, data_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    for r in queries.op10_quality_bands(spark, data_dir).collect():
        assert tuple(r)[1:7] == base_of_quality(texts.pop(r.doc_id))
    assert not texts


def test_language_id(spark, odd, empty):
    model = language_id.train(odd)
    got = {(r.doc_id, r.lang_pred): r.score for r in language_id.predict(odd, model).collect()}
    assert len(got) >= 60 and all(0 <= s <= 1 for s in got.values())
    by = {d: p for d, p in got}
    assert [by[d] for d in (0, 1, 2, 3, 102)] == ["und"] * 5 and by[5] != "und"
    rnd = random.Random(12)
    fresh = [(k, prose(rnd, lang, 25), lang) for k, lang in enumerate(["en", "de", "fr", "es"] * 10)]
    rows = language_id.predict(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {d: lang for d, _, lang in fresh}
    nothing = language_id.train(empty)
    assert nothing is None and {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0
    alone = language_id.train(odd.filter("lang = 'fr'"))
    assert {r.lang_pred for r in language_id.predict(odd, alone).collect()} == {"fr", "und"}


def test_language_of_a_long_text_is_counted_in_blocks():
    import numpy as np
    data = np.frombuffer(prose(random.Random(1), "fr", 400).encode(), np.uint8)
    cut = np.array([0, 700, 700, len(data)])
    whole = language_id.counts(data, cut, 512, 1 << 20)
    assert (whole == language_id.counts(data, cut, 512, 97)).all() and whole[1].sum() == 0


def test_language_query(spark, data_dir):
    rows = queries.op2_language_id(spark, data_dir).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) > 20


def _toxic(spark):
    rnd = random.Random(21)
    rows, labels = [], []
    for k in range(900):
        lang = ["en", "de", "fr", "es"][k % 4]
        toxic = k % 5 == 0
        words = prose(rnd, lang, rnd.randrange(20, 80)).split()
        for _ in range(3 * toxic):
            words.insert(rnd.randrange(len(words)), f"{lang}vile" + rnd.choice(["", "er", "est"]))
        rows.append((k, " ".join(words), lang))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, odd, empty):
    docs, labels = _toxic(spark)
    odd_labels = spark.createDataFrame([(0, None), (None, 1), (5, 0), (5, 0), (9999, 1)], "doc_id long, toxic int")
    model = toxicity_cnn.train(docs.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang")),
                               labels.filter("doc_id % 3 <> 0").unionByName(odd_labels))
    rows = toxicity_cnn.score(docs, model).collect()
    held = [r for r in rows if r.doc_id % 3 == 0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    left = toxicity_cnn.reject(docs, model)
    assert left.columns == docs.columns and left.count() == sum(not r.predicted for r in rows)
    got = toxicity_cnn.score(odd, model).collect()
    assert len(got) == odd.count() and len({r.score for r in got if r.doc_id in (0, 1, 2, 3, 102)}) == 1
    assert toxicity_cnn.reject(odd, model).columns == odd.columns
    assert toxicity_cnn.score(empty, model).count() == toxicity_cnn.reject(empty, model).count() == 0
    none = toxicity_cnn.train(empty, labels)
    assert {r.score for r in toxicity_cnn.score(odd, none).collect()} == {0.0}
    assert toxicity_cnn.reject(odd, none).count() == odd.count()


def plain_logit(network, text):
    """The network's forward pass for one text, word by word."""
    import numpy as np

    from fieldpulse.llm import _text as T
    c = network.config
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    vectors = []
    for w in words:
        whole, head = (int(T.hashes_of([b])[0]) for b in (w.encode(), w.encode()[:c.prefix_bytes]))
        again = int(T.mix64(np.array([(whole + 0x51ED27) % 2**64], np.uint64))[0])
        n = c.buckets
        vectors.append(network.embed[whole % n] + network.embed[n + again % n] + network.embed[2 * n + head % n])
    total, k = float(network.bias[0]), 0
    for width in c.widths:
        for f in range(c.filters):
            best = 0.0
            for i in range(len(words) - width + 1):
                best = max(best, float(network.shift[width][f]) + sum(
                    float(np.dot(vectors[i + j], network.kernels[width][j][:, f])) for j in range(width)))
            total += best * float(network.out[k])
            k += 1
    return total


def test_toxicity_query(spark, monkeypatch):
    import pickle
    import zlib

    import numpy as np
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries._toxicity_model(queries._documents(spark, sf, "doc_id", "text", "lang"), spark.read.parquet(f"{sf}/labels.parquet"))
    monkeypatch.setattr(queries, "_toxicity_model", lambda *_: model)
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    rows = {r.doc_id: r for r in docs.select("doc_id", "text", "lang").collect()}
    assert got.keys() == rows.keys()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").collect()
    toxic = {r.doc_id: 0 for r in labels} | {r.doc_id: 1 for r in labels if r.toxic > 0}
    held = [d for d in toxic if d in got and got[d].held_out]
    hit = {}
    for d in held:
        if toxic[d]:
            hit.setdefault(rows[d].lang, []).append(got[d].predicted)
    print({k: (sum(v), len(v)) for k, v in hit.items()})
    assert sum(map(sum, hit.values())) >= 0.9 * sum(map(len, hit.values()))
    assert sum(got[d].predicted for d in held if not toxic[d]) <= 0.1 * sum(map(len, hit.values()))
    assert all(sum(v) >= 0.7 * len(v) for v in hit.values())
    # the scores of a plain forward pass
    m = pickle.loads(model)
    assert len(m.cuts) == len(m.languages) and len(set(m.cuts)) > 1
    short = [d for d in sorted(held) if len(rows[d].text or "") < 1500][:40] + [d for d in sorted(held) if toxic[d]][:5]
    for d in short:
        p = 1 / (1 + np.exp(-np.clip(plain_logit(m.network, rows[d].text), -40, 40)))
        cuts = 1 / (1 + np.exp(-m.cuts))
        want = np.where(p < cuts, 0.3 * p / cuts, 0.3 + 0.7 * (p - cuts) / (1 - cuts))      # by the cut of some language
        assert np.abs(want - got[d].score).min() < 1e-4, d


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Words' shares are those of all rows, one shard or several; several learn what one does."""
    import pickle

    import numpy as np
    import pyarrow as pa

    from fieldpulse.llm import _text as T
    rows = [(k, "calm " * (1 + k % 3) + ("vile" if k % 10 == 0 else f"word{k % 50}"), "xy"[k % 2]) for k in range(6000)]
    docs = spark.createDataFrame([*rows, *rows[:5], (7, "zz a later text of row 7", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(6000)], "doc_id long, toxic int")
    counts = {lang: np.ones(1 << 16) for lang in "xy"}
    for _, text, lang in rows:
        np.add.at(counts[lang], toxicity_cnn.word_ids(*T.buffers(pa.array([text])), toxicity_cnn.Config())[0][:, 0], 1)
    for size in (1 << 20, 30_000):
        config = toxicity_cnn.Config(readings=1, shard_bytes=size)
        monkeypatch.setattr(toxicity_cnn, "_SENT_LABELS", size // 10)
        held, n = toxicity_cnn.shards(docs, labels, config)
        assert held.count() == 6000 and held.rdd.getNumPartitions() == n and (n > 2) == (size == 30_000)
        model = toxicity_cnn.train(docs, labels, config)
        words = pickle.loads(model).words
        assert all(np.allclose(words[:, k], np.log(counts[lang] / counts[lang].sum())) for k, lang in enumerate("xy"))
        got = toxicity_cnn.score(docs.limit(6000), model).collect()
        assert sum(r.predicted == (r.doc_id % 10 == 0) for r in got) >= 0.99 * len(got)
    assert toxicity_cnn.train(docs, labels, config) == model


def test_every_language_has_a_threshold():
    import numpy as np
    rnd, words = random.Random(5), np.random.default_rng(5)
    texts = []
    for k in range(400):                                     # a frequent language, and one with four toxic rows
        lang, toxic = ("aa", k % 4 == 0) if k < 370 else ("bb", k >= 396)
        ids = words.integers(100 * (lang == "bb"), 100 * (lang == "bb") + 90, (rnd.randrange(5, 30), 3)).astype(np.int32)
        ids[:, 1] += toxicity_cnn.Config().buckets
        ids[:, 2] += 2 * toxicity_cnn.Config().buckets
        if toxic:
            ids[rnd.randrange(len(ids)), :] = [900, 900 + (1 << 16), 900 + (2 << 16)]
        texts.append((ids, int(toxic), lang))
    config = toxicity_cnn.Config(readings=4000)
    model = toxicity_cnn.fit(texts, config)
    assert model.languages == ["aa", "bb"] and len(model.cuts) == 2 and np.isfinite(model.cuts).all()
    assert toxicity_cnn.fit(texts, toxicity_cnn.Config(readings=4000, languages=1)).languages == ["aa"]
    only = [t for t in texts if not t[1]] + [t for t in texts if t[1]][:1]    # one toxic row: no network can be judged by it
    assert np.isfinite(toxicity_cnn.fit(only, config).cuts).all()
    assert toxicity_cnn.fit([t for t in texts if t[1]], config).network is None


def test_a_word_of_one_text_is_not_learned():
    import numpy as np
    config = toxicity_cnn.Config(readings=800)
    row = lambda *words: np.array([[w, w + (1 << 16), w + (2 << 16)] for w in words], np.int32)
    texts = [(row(1, 2, 100 + k, *([7] * (k % 2))), k % 2, "x") for k in range(40)]
    network = toxicity_cnn.fit_network(texts, np.arange(40), config)
    assert not network.embed[[100 + k for k in range(40)]].any() and not network.embed[-1].any() and network.embed[7].any()
    logits = network.logits(np.concatenate([row(1, 2, 500, 7), row(1, 2, 501)]), np.array([0, 4, 7]))
    assert logits[0] > 0 > logits[1]


def test_blocks_do_not_change_a_score(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from fieldpulse.llm import _text as T
    texts = [prose(random.Random(k), "en", 30 + 40 * k) for k in range(6)] + ["", "x"]
    ids, first = toxicity_cnn.word_ids(*T.buffers(pa.array(texts)), toxicity_cnn.Config())
    net = toxicity_cnn.Network(toxicity_cnn.Config())
    whole = net.logits(ids, first)
    monkeypatch.setattr(toxicity_cnn, "_BLOCK", 7)
    assert np.allclose(whole, net.logits(ids, first))


def test_url_filter(spark):
    import datetime as dt
    day = dt.date(2024, 1, 1)
    at = lambda n: day + dt.timedelta(n)
    log = [("block", "domain", "bad.org", "add", at(10)), ("block", "domain", "bad.org", "remove", at(20)),
           ("block", "domain", "bad.org", "add", at(30)), ("block", "domain", "bad.org", "add", at(31)),
           ("allow", "host", "www.bad.org", "add", at(15)), ("block", "prefix", "ok.net/x/y", "add", at(0)),
           ("allow", "prefix", "ok.net/x/y", "add", at(40)), ("block", "host", "EVIL.com", "add", at(0)),
           ("block", "host", "evil.com", "remove", at(0)), ("block", "host", None, "add", at(0)),
           ("block", "host", "h", "rename", at(0))]
    pages = [(1, "http://a.bad.org/", 12, "blocked"), (2, "http://a.bad.org/", 9, "unlisted"), (3, "http://bad.org", 20, "unlisted"),
             (4, "https://u:p@BAD.org:8080/q?x#y", 30, "blocked"), (5, "http://www.bad.org/", 16, "allowed"),
             (6, "http://ok.net/X/y/z", 5, "blocked"), (7, "http://ok.net/x/y", 41, "blocked"), (8, "http://ok.net/x", 5, "unlisted"),
             (9, "http://evil.com/", 3, "unlisted"), (10, None, 3, "no_host"), (11, "not a url", 3, "no_host"),
             (12, "http://bad.org", None, "undated"), (None, "http://bad.org", 12, "blocked"), (13, "http://notbad.org/", 12, "unlisted"),
             (1, "http://a.bad.org/", 12, "blocked"), (14, "ftp://x.y.bad.org", 19, "blocked")]
    cap = spark.createDataFrame([(i, u, None if n is None else at(n)) for i, u, n, _ in pages], "page_id long, url string, fetched_at date")
    entries = spark.createDataFrame(log, "list string, kind string, key string, action string, listed_at date")
    got = {r.page_id: r.verdict for r in url_filter.evaluate(cap, entries).collect()}
    assert got == {i: v for i, _, _, v in pages}
    assert url_filter.evaluate(cap.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filter.evaluate(cap, entries.limit(0)).collect()} == {"unlisted", "no_host", "undated"}


def test_url_filter_judges_every_capture(spark):
    import datetime as dt
    day = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame([("block", "host", "bad.org", "add", day(10)), ("allow", "host", "ok.net", "add", day(5))],
                                    "list string, kind string, key string, action string, listed_at date")
    pages = [(1, "http://bad.org/a", day(12), "blocked", 1), (1, "http://ok.net/", day(12), "allowed", 1),
             (1, "http://bad.org/a", day(9), "unlisted", 0), (1, "http://bad.org/a", day(12), "blocked", 1),
             (1, None, day(12), "no_host", 0), (1, "http://bad.org/a", None, "undated", 0),
             (None, "http://bad.org/a", day(12), "blocked", 1), (None, "http://ok.net/", day(12), "allowed", 1),
             (None, "http://ok.net/", day(12), "allowed", 1), (None, None, None, "no_host", 0)]
    cap = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, fetched_at date").repartition(3)
    got = url_filter.evaluate(cap, entries).select("page_id", "host", "fetched_at", "verdict", "n_active").collect()
    want = [(i, u and u.split("/")[2], at, v, n) for i, u, at, v, n in pages]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_url_filter_tries_prefixes_of_any_depth(spark):
    import datetime as dt
    day = dt.date(2024, 1, 1)
    entries = spark.createDataFrame(
        [("allow", "host", "a.org", "add", day), ("block", "prefix", "a.org/1/2/3/4/5/6/7", "add", day),
         ("allow", "prefix", "a.org/1/2/3/4/5/6/7/x", "add", day), ("block", "prefix", None, "add", day)],
        "list string, kind string, key string, action string, listed_at date")
    pages = [("http://a.org/1/2/3/4/5/6/7", "blocked", 2), ("http://a.org/1/2/3/4/5/6/7/y/z/", "blocked", 2),
             ("http://a.org/1/2/3/4/5/6/7/X/8/9/10?q", "allowed", 3), ("http://a.org/1/2/3/4/5/6", "allowed", 1)]
    cap = spark.createDataFrame([(k, u, day) for k, (u, _, _) in enumerate(pages)], "page_id long, url string, fetched_at date")
    got = {r.page_id: (r.verdict, r.n_active) for r in url_filter.evaluate(cap, entries).collect()}
    assert got == {k: (v, n) for k, (_, v, n) in enumerate(pages)}
    few = {r.page_id: r.verdict for r in url_filter.evaluate(cap, entries.filter("kind = 'host'")).collect()}
    assert set(few.values()) == {"allowed"}


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_queries_equal_their_sql(spark, data_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir}/{t}.parquet')")
    got, rel = queries.QUERIES[name](spark, data_dir), con.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    want = [tuple(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want))
