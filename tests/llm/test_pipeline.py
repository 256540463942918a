import hashlib

import brute
import corpus_pipeline
import numpy as np
from brute import ODD
from parapet.llm.queries import tokenizer_path
from parapet.llm.repetition import Rules


def kept_by_quality(text, rules=Rules()):
    m = brute.quality(text, rules.min_repeat)
    n = m["n_words"]
    return not (n < rules.min_words or 100 * m["n_repeat_words"] > rules.repeat_words_pct * n
                or 100 * m["covered_words"] > rules.covered_pct * n or m["longest_repeat"] > rules.longest)


def masked(text):
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in brute.secrets(text)[1])
    out, at = "", 0
    for start, end in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_stages_equal_brute_force(spark, make, sample):
    from tokenizers import Tokenizer

    rows = [r for r in sample if len(r[1]) < 5_000] + [r for r in ODD if len(r[1] or "") < 5_000]
    long = " ".join(f"word{i}" for i in range(80))
    rows += [(90_000, long), (90_001, long + " more"), (90_002, long.replace("word7 ", "x ")),
             (90_003, "token = \"" + "ab12" * 10 + "\" " + long[::-1])]
    items = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows += [(90_004, long.upper()[::-1].lower() + " " + items[0][1])]
    docs, want = make(rows), dict(rows)
    folder, columns = "/root/testdata/sf0.001", make(rows).columns
    steps = [f for _, f in corpus_pipeline.STAGES]

    docs = steps[0](spark, docs, folder)
    want = {i: t for i, t in want.items() if kept_by_quality(t)}
    assert {r.doc_id: r.text for r in docs.collect()} == want and docs.columns == columns

    docs = steps[1](spark, docs, folder)
    groups = brute.near([(i, t) for i, t in want.items() if i is not None], 5, 80)
    want = {i: t for i, t in want.items() if i is None or groups[i][1] == i}
    assert {r.doc_id: r.text for r in docs.collect()} == want and docs.columns == columns
    assert 90_000 in want and 90_001 not in want

    docs = steps[2](spark, docs, folder)
    want = {i: t for i, t in want.items() if not brute.contaminated(t, items)[1]}
    assert {r.doc_id: r.text for r in docs.collect()} == want and 90_004 not in want

    docs = steps[3](spark, docs, folder)
    want = {i: masked(t) for i, t in want.items()}
    assert {r.doc_id: r.text for r in docs.collect()} == want and "[SECRET]" in want[90_003]
    assert docs.columns == columns

    library = Tokenizer.from_file(tokenizer_path())
    expected = {}
    for i, t in want.items():
        ids = library.encode(t, add_special_tokens=False).ids
        expected[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    got = steps[4](spark, docs, folder).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in got} == expected


def test_empty_tables_pass_through(spark, make):
    docs = make([])
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0


def test_run_keeps_clean_documents(spark):
    folder = "/root/testdata/sf0.001"
    ids = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    assert ids < set(rows) and len(ids) > len(rows) / 2
    assert all(kept_by_quality(rows[i]) for i in ids)
