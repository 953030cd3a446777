"""The pipeline stage by stage against brute force, on small tables written for the test."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from panelspark.session import scratch_path
from tests.llm.test_operators import WORD, brute_cut, brute_groups, brute_hits, fill

ITEM = "shared items of the benchmark text that some documents leak into their own words here"


def write_tables(spark, folder):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choice(words, 60))
    rows, labels = [], []
    for i in range(150):
        text = " ".join(rng.choice(words, 60 + i % 40)) + ".\nNext line."
        if i % 5 == 0:
            text = "".join(f"{w}%%% " for w in text.split())
        elif i % 11 == 1:
            text += " " + ITEM
        elif i % 13 == 2:
            text += " " + passage
        elif i % 17 == 3 and rows:
            text = rows[-1][1] + " tail"
        rows.append((i, text))
        labels.append((i, int(i % 5 > 0), 0))
    rows += [(150, None), (151, ""), (2, rows[2][1])]
    docs = [(i, t, "en", f"src{i % 4}" if i % 9 else None, len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_every_stage_does_its_work_on_what_it_gets(spark):
    folder = scratch_path(spark, "pipeline-test")
    write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        before, docs = docs.collect(), spark.read.parquet(f"{folder}/{name}")
        assert docs.columns[:5] == columns and (name == "mixture" or docs.columns == columns)
        got[name] = (before, docs.collect())

    before, after = got["quality"]
    good = [r for r in before if r.doc_id % 5 or r.doc_id >= 150]
    assert {r.doc_id for r in after} - {150, 151} == {r.doc_id for r in good} - {150, 151}      # empty texts: either way

    before, after = got["near_duplicates"]
    groups = brute_groups([(r.doc_id, r.text) for r in before], 5)
    want = Counter(r.doc_id for i, r in enumerate(before) if not groups[i][1])
    want.update(c for c, _ in {(c, number) for _, n, c, number in groups.values() if n})
    assert Counter(r.doc_id for r in after) == want and len(after) < len(before)

    before, after = got["repeated_substrings"]
    cut = {(r.doc_id, r.text): c for r, c in zip(before, brute_cut([(r.doc_id, r.text) for r in before], 100), strict=True)}
    kept = {r.doc_id: r for r in after}
    assert len(after) == len(before) and any(c[2] for c in cut.values())
    for (i, _), c in cut.items():
        assert len((kept[i].text or "").encode()) == c[1] - c[2] and kept[i].n_chars in (None, len(kept[i].text or ""))

    before, after = got["benchmark_leaks"]
    clean = [r for r in before if not brute_hits(r.text, [(1, ITEM)])[1]]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in clean) and len(clean) < len(before)

    before, after = got["mixture"]
    size, taken = defaultdict(int), defaultdict(int)
    for r in before:
        size[r.source] += len(WORD.findall(r.text or ""))
    for r in after:
        taken[r.source] += r.mix.taken
        assert 0 < r.mix.taken <= 3 * len(WORD.findall(r.text))
    order = sorted(size, key=lambda s: (s is None, s))
    for s, target in zip(order, fill([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True):
        assert abs(taken[s] - target) <= 1



def test_run_is_the_stages_one_after_the_other(spark):
    folder = scratch_path(spark, "pipeline-run")
    write_tables(spark, folder)
    first, second = (corpus_pipeline.run(spark, folder).collect() for _ in range(2))
    assert Counter((r.doc_id, r.mix.taken) for r in first) == Counter((r.doc_id, r.mix.taken) for r in second)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
