from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import fusefilter, snapshots


def normal(text):
    return (text or "").translate({ord(c): None for c in " \t\n\v\f\r"})


def brute(rows):
    """Sorted (doc_id, keep_id, size, kept, hash) of (doc_id, text) rows; of equal rows one stays."""
    groups = {}
    for row in rows:
        groups.setdefault(normal(row[1]), []).append(row)
    out = []
    for text, held in groups.items():
        best = min(held, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        digest, stays = sha256(text.encode()).hexdigest(), True
        for doc, raw in held:
            kept = stays and (doc, len(raw or "")) == (best[0], len(best[1] or ""))
            stays = stays and not kept
            out.append((doc, best[0], len(held), kept, digest))
    return sorted(out, key=repr)


def run(docs, ledger, batches=3, **options):
    for number in range(batches):
        snapshots.commit(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number), ledger, number, **options)
    return snapshots.by_document(docs, ledger, batches, **options)


def checked(frame):
    return sorted((tuple(r)[:4] + (bytes(r["digest"]).hex(),) for r in frame.collect()), key=repr)


def odd_rows():
    texts = ["same text", "same  text", "sametext\n", "other", None, "", " \t\r\n", "é e", "ée", "long " * 40_000, "long" * 40_000, "tie a", "tiea ", "a b", "a b", "ab"]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    return rows + [(7, "same text"), (7, "same text"), (None, "null id, the longest of its class "), (None, "null id, the longest of its class "), (3, "nullid,thelongestofitsclass")]


def test_odd_rows(spark, tmp_path):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.withColumns({c: F.lit("x") for c in ("digest", "rank", "size", "best", "id", "home", "uid", "kept", "n_points")})
    assert checked(run(clash, str(tmp_path / "a"))) == brute(rows)


def test_texts_that_share_a_digest_are_told_apart_by_their_bytes(spark, tmp_path):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda text: F.unhex(F.sha2((F.char_length(text) % 3).cast("string"), 256))
    got = run(docs, str(tmp_path / "b"), digest=weak).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted((r[:4] for r in brute(rows)), key=repr)


def test_empty_table_and_empty_batches(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert run(docs, str(tmp_path / "c")).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert checked(run(one, str(tmp_path / "d"))) == brute([(1, "a")])


def test_a_repeated_commit_changes_nothing(spark, tmp_path):
    rows, ledger = odd_rows(), str(tmp_path / "e")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, second = docs.where("doc_id < 20"), docs.where("doc_id >= 20 OR doc_id IS NULL")
    for batch, number in ((first, 0), (first, 0), (second, 1), (second, 1)):
        snapshots.commit(batch, ledger, number)
    assert checked(snapshots.by_document(docs, ledger, 2)) == brute(rows)
    held = [r["text"] for n in (0, 1) for r in snapshots.snapshot_texts(spark, ledger, n).collect()]
    assert sorted(held) == sorted({normal(t) for _, t in rows})


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 20_000, 150_000])
def test_filters_know_their_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
    f = fusefilter.build(np.concatenate([keys, keys]))
    assert fusefilter.contains(f, keys).all()
    others = rng.integers(0, 2**64 - 1, 50_000, dtype=np.uint64)
    assert fusefilter.contains(f, others).mean() < 1.5 / 256
    assert n < 20_000 or len(f["prints"]) < 1.35 * n


def test_screens_of_many_shards_and_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "SHARD_KEYS", 64)
    rows = [(i, f"text {i % 700}" + " " * (i % 4)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert checked(run(docs, str(tmp_path / "f"))) == brute(rows)
    assert spark.read.parquet(str(tmp_path / "f/snapshot_0/filters")).count() > 4
