"""The pipeline's stages one after another, each judged on its own input."""

import os
import subprocess
import sys
from pathlib import Path

import brute
import corpus_pipeline
from scriptorium.runtime import table

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "secret_scans", "mixing", "sentencepiece"]
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen.append((docs, spark.read.parquet(str(tmp_path / name))))
        docs = seen[-1][1]
    (raw, language), (_, unique), (_, clean), (_, mixed), (_, ids) = seen
    assert language.count() == raw.count()  # every text of this corpus is in a learned language
    rows = [(r.doc_id, r.text) for r in language.collect()]
    assert {r.doc_id for r in unique.collect()} == {d for d, (_, c) in brute.near_duplicates(rows).items() if c == d}
    assert clean.count() == unique.count()
    before = {r.doc_id: r.text for r in unique.collect()}
    for r in clean.collect():
        assert brute.secrets(r.text) == [] and r.n_chars == len(r.text)
        if not brute.secrets(before[r.doc_id]):
            assert r.text == before[r.doc_id]
    assert 0 < mixed.count() < clean.count()
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert {r.doc_id: r.decoded for r in ids.collect()} == text


HARD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "b"),
    (2, "another text of the same number, which is no copy of anything", "en", "b"),
    (5, "a row that stands here twice and has password = hunter22 in it", "en", "a"),
    (5, "a row that stands here twice and has password = hunter22 in it", "en", "a"),
    (None, "a text without a number, with token: abcdef123", "en", None),
    (None, "a text without a number, with token: abcdef123", "en", None),
    (7, None, None, "c"),
    (8, "", "en", "c"),
    (9, "12345 --- 67", "en", "c"),
    (10, "ein text ohne besondere kennzeichen steht hier", None, None),
    (11, "noch ein anderer text mit vielen worten der sprache", "de", "c"),
    (12, "long text " * 30_000, "en", "c"),
]


def test_hard_cases(spark):
    """Nulls, empty and long texts, repeated ids and rows, and other columns named like the operators' own."""
    extra = ("_id", "_mark", "id", "mark", "row", "spans", "component", "kept", "_kept", "tokens", "u", "p", "weight", "topic", "lang_pred")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(extra)) for r in HARD], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    language, unique, clean, mixed = (stage for _, stage in corpus_pipeline.STAGES[:4])
    known = corpus_pipeline.cut(language(spark, docs, ""))
    assert known.columns == docs.columns and sorted(str(r.doc_id) for r in known.collect()) == sorted(str(r[0]) for r in HARD if r[0] not in (7, 8, 9))
    one = corpus_pipeline.cut(unique(spark, known, ""))
    assert one.columns == docs.columns
    rows = sorted((str(r.doc_id), r.text) for r in one.collect())
    # 2's first text is a copy of 1's; its other text keeps the rows of id 2.
    assert rows == sorted((str(d), t) for d, t in [(1, HARD[0][1]), (2, HARD[1][1]), (2, HARD[2][1]), (5, HARD[3][1]), (None, HARD[5][1]), (None, HARD[6][1]), (10, HARD[10][1]), (11, HARD[11][1]), (12, HARD[12][1])])
    masked = clean(spark, unique(spark, docs, ""), "").collect()
    assert len(masked) == 12 and all(r.n_chars == len(r.text or "") for r in masked if r.text is not None)
    texts = {r.text for r in masked}
    assert "a row that stands here twice and has [REDACTED] in it" in texts and "a text without a number, with [REDACTED]" in texts and None in texts and "" in texts
    assert all(r.mark == r.id == r.u == "x" for r in masked)
    assert mixed(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() == len(HARD)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0
        empty = out if out.columns == docs.columns else empty


def test_run_reads_each_text_once(spark, sf, monkeypatch):
    """No stage is computed again for a later one."""
    seen = spark.sparkContext.accumulator(0)
    name, stage = corpus_pipeline.STAGES[0]

    def counted(spark, docs, sf_dir):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        out = stage(spark, docs, sf_dir)
        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, counted), *corpus_pipeline.STAGES[1:]])
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert seen.value == stage(spark, table(spark, sf, "documents"), sf).count()


def test_workers_without_the_package(tmp_path):
    """Functions and models travel with the plan; a worker's path holds no copy of the package."""
    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from scriptorium.runtime import local_session
spark = local_session("2", "2")
q = entry.queries()
print("ROWS", q["op10_language_id"](spark, "/root/testdata/sf0.001").count(), q["op9_substring_dedup"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 200 200" in said.stdout, said.stderr[-2000:]
