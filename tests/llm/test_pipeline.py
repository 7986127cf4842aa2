"""The pipeline's stages against plain Python, each on its own input."""
import numpy as np

import corpus_pipeline as CP
from fieldpulse.llm import _text, toxicity_cnn

from .test_lines import brute as brute_lines
from .test_pairs import brute as brute_pairs
from .test_pairs import contained

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, data_dir, scratch):
    assert [n for n, _ in CP.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination",
                                        "byte-level BPE"]
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(CP.STAGES):
        out = stage(spark, frames[-1], data_dir)
        assert k == 4 or out.schema.names == COLUMNS == docs.columns
        out.write.parquet(f"{scratch}/{k}")
        frames.append(spark.read.parquet(f"{scratch}/{k}"))
    rows = [{r.doc_id: r for r in f.collect()} for f in frames]
    raw, clean, lined, single, unleaked, ids = rows

    model = toxicity_cnn.train(docs, spark.read.parquet(f"{data_dir}/labels.parquet").filter(
        "crc32(cast(doc_id as string)) % 4 <> 2"))
    bad = {r.doc_id for r in toxicity_cnn.score(docs, model).filter("predicted = 1").collect()}
    assert set(raw) - set(clean) == bad and all(clean[d] == raw[d] for d in clean)

    want = brute_lines([r.text for r in clean.values()], CP.MIN_DOCS)
    assert {d: r.text for d, r in lined.items()} == {d: t for d, (t, _, _) in zip(clean, want)}
    assert all(r.n_chars == (len(r.text) if r.text != clean[d].text else clean[d].n_chars) for d, r in lined.items())

    pairs = [(d, r.text) for d, r in lined.items()]
    assert set(single) == set(brute_pairs(pairs)[1]) and all(single[d] == lined[d] for d in single)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in contained([(d, r.text) for d, r in single.items()], items)}
    assert leaks and set(unleaked) == set(single) - leaks

    assert set(ids) == set(unleaked) and all(len(r.ids) == 4 * r.n_tokens for r in ids.values())
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in CP.run(spark, data_dir).collect())
    assert got == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in ids.values())


def test_stages_take_odd_and_empty_tables(spark, odd, empty, data_dir):
    for _, stage in CP.STAGES[:-1]:
        assert stage(spark, odd, data_dir).columns == odd.columns
        assert stage(spark, empty, data_dir).count() == 0
    assert CP.encode(spark, odd, data_dir).count() == odd.count() and CP.encode(spark, empty, data_dir).count() == 0


def _anonymous_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon")) / 1024


def test_a_worker_keeps_no_freed_memory():
    pins = []

    def run(batches):
        for x in batches:
            held = [np.ones(12_000) for _ in range(2_000)]         # 190 MB in pieces that malloc puts on its heap
            pins.append(np.ones(1_000))                            # stays above them, so that the heap can't shrink
            yield x + len(held)

    list(run([0]))                                                 # malloc's thresholds move with the first large run
    _text.give_back()
    before = _anonymous_mb()
    assert list(_text.tidy(run)([1])) == [2_001]
    assert _anonymous_mb() < before + 40
    assert _text.tidy_group(lambda key, rows: (key, rows))(1, 2) == (1, 2)
