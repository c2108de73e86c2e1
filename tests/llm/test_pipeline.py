import re

import public_tokenizers
import corpus_pipeline
from pyspark.sql import functions as F

from panelcast.llm import jaccard
from tests.llm.test_links import jaccard_brute, line_brute
from tests.llm.test_text import hits_brute, quality_brute
from tests.llm.test_tokens import check_packing

PASSAGE = " ".join(f"item{i}" for i in range(20))


def words(n, seed):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def fixture_texts():
    shared = "this is a line about the terms of use of the whole site"
    texts = [words(60, i) + "\n" + shared for i in range(12)]
    near = words(80, 99)
    texts += [near, near + " tail", near.replace("w99x7 ", "changed "), texts[0], "too short", None, "", words(30, 50) + " " + PASSAGE, "a b c d e " * 6]
    return texts


def test_stages_against_plain_python(spark, docs_of, tmp_path):
    texts = fixture_texts()
    docs = docs_of(texts, sources=["s"] * len(texts))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    now, results = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "best_fit_packing":
            assert now.columns == docs.columns
            now.write.parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
            rows = {r["doc_id"]: r for r in now.collect()}
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows.values())
            results.append({d: r["text"] for d, r in rows.items()})
    after_quality, after_lines, after_join, after_search = results
    verdicts = quality_brute([(i, t, "s") for i, t in enumerate(texts)], 5, 5, 30)
    assert set(after_quality) == {i for i, v in verdicts.items() if v[-1]}
    order = sorted(after_quality)
    dropped = line_brute([after_quality[d] for d in order], 2, 32)
    want = {d: "\n".join(x for n, x in enumerate(after_quality[d].split("\n")) if n not in dropped[i]) for i, d in enumerate(order)}
    assert after_lines == {d: t for d, t in want.items() if re.search(r"\S", t) or t == after_quality[d]}
    order = sorted(after_lines)
    _, label = jaccard_brute([after_lines[d] for d in order], 5, 80)
    assert set(after_join) == {d for i, d in enumerate(order) if label[i] == i}
    assert set(after_search) == {d for d, t in after_join.items() if not hits_brute(t, [(7, PASSAGE)], 13)[-1]}
    assert 19 not in after_search and 0 in after_search
    check_packing(now.collect(), after_search, 4096)
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(tuple(r)[:5] for r in ran.collect()) == sorted(tuple(r)[:5] for r in now.collect())


def test_stage_functions_take_empty_tables(spark, docs_of, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0
        now = docs_of([])


def test_defaults_of_the_near_duplicate_stage():
    assert jaccard.join_classes.__defaults__ == (5, 80)
    assert public_tokenizers.path(corpus_pipeline.WORD_BPE)


def test_stages_keep_columns_with_clashing_names(spark, docs_of, tmp_path):
    spark.createDataFrame([(7, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["gone", "row_key", "twin", "_twin", "_kept", "_bad", "row", "class", "host", "removed", "id", "number", "dropped"]
    docs = docs_of([*fixture_texts(), fixture_texts()[3]], [*range(21), 3]).withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, docs, str(tmp_path))
        assert now.columns == docs.columns
        rows = now.collect()
        assert rows and all(r[c] == c for r in rows for c in names)
    assert len(corpus_pipeline.ngram_jaccard_join(spark, docs, "").where("doc_id = 3").collect()) <= 1
    assert corpus_pipeline.best_fit_packing(spark, docs, "").count() == 22
