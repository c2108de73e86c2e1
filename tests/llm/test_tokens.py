import struct
import sys
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelcast.llm import grammar, packing, token_queries, tokenizing
from panelcast.llm.tokenizing import ChunkEncoder
import pyarrow as pa

FILES = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]
ODD = ["Hello  World\n\n\nfoo's bar.\n", None, "", " a\tb   c\x01d  ", "x\x00y z", "ÀÉ Ünï  \x1c\x1d q", "\n\n", "   ", "(a) b's 'tis I'LL 12345", "é É ́x", "<|endoftext|> a", " \t", " \t x", "a \n b\n\nc", "ΑΣ ΑΣΑ", "long " * 3000]


def reference(file):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file,folded", FILES)
def test_chunks_give_the_ids_of_whole_texts(file, folded):
    encode, own = reference(file), ChunkEncoder(public_tokenizers.path(file), folded)
    for texts in (ODD, [t for t in ODD if t != "x\x00y z"]):
        ids, sizes = own.encode(pa.array(["first", *texts]).slice(1))
        ends = np.cumsum(sizes)
        assert [list(ids[e - n : e]) for e, n in zip(ends, sizes)] == [encode(t) for t in texts]


@pytest.mark.parametrize("file,folded", FILES)
def test_plain_chunks_skip_the_splitter(file, folded, monkeypatch):
    encode, own = reference(file), ChunkEncoder(public_tokenizers.path(file), folded)
    rng, letters, ends = np.random.default_rng(5), list("abzAZéÉßÿÀøñ"), ["", ".", ",", "!?", "***", "<|", "$%&", "_-", '")', "(`"]
    texts = ["a" + "".join(" \n"[rng.integers(2)] + "".join(rng.choice(letters, rng.integers(1, 12))) + ends[rng.integers(len(ends))] for _ in range(300)) for _ in range(4)]
    slow = []
    encode_all = own.tokenizer.encode_batch_fast
    splitter = SimpleNamespace(encode_batch_fast=lambda chunks, **how: slow.extend(chunks) or encode_all(chunks, **how))
    monkeypatch.setattr(own, "tokenizer", splitter)
    ids, sizes = own.encode(pa.array(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    assert [list(ids[a:b]) for a, b in zip(bounds, bounds[1:])] == [encode(t) for t in texts]
    assert not slow


def test_chunks_in_use_outlive_the_bound_on_kept_ones(monkeypatch):
    monkeypatch.setattr(tokenizing, "KEPT_BYTES", 4_000)
    own, sent = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json")), []
    encoded = own._encoded
    monkeypatch.setattr(own, "_encoded", lambda chunks: sent.extend(chunks) or encoded(chunks))
    for i in range(50):
        own.encode(pa.array([f"x common one{'abcdefghij'[i % 10] * (i + 1)} two{'klmnopqrst'[i % 10] * (i + 1)}"]))
    assert sent.count(" common") == 1 and len(own.kept) + len(own.older) < 45


def test_new_chunks_cost_no_python_calls_besides_their_encoding(monkeypatch):
    own, calls = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    monkeypatch.setattr(own, "_encoded", lambda chunks: [b"abcd"] * len(chunks))
    chunks = [f" w{i}" for i in range(1000)]
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        ids, lengths = own._distinct(chunks)
    finally:
        sys.setprofile(None)
    assert calls["c_call"] < 100 and lengths.tolist() == [1] * 1000 and len(ids) == 1000
    assert own.held == sum(map(len, chunks)) + 1000 * (4 + tokenizing.ENTRY_BYTES) and len(own.kept) == 1000


def checksum(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 500, 40)
    docs = [np.concatenate([phrase] * k + [rng.integers(0, 500, 5)]) for k in (3, 9, 0, 20)] + [np.zeros(0, int), np.full(50, 7)]
    ids, sizes = np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs])
    g = grammar.compress(ids, sizes, 500)
    assert len(g["left"]) > 0 and len(g["sequence"]) < len(ids)
    assert (grammar.expand(g["sequence"], g) == ids).all()
    for n, doc in enumerate(docs):
        for a, b in ((0, len(doc)), (3, 17), (len(doc) - 1, len(doc)), (5, 5)):
            assert (grammar.decode_range(g, n, max(a, 0), max(b, 0)) == doc[max(a, 0) : max(b, 0)]).all()


def left_over(g: dict) -> int:
    """Places of the pair that is most frequent in the sequence; places of a run don't overlap."""
    places, low = Counter(), 0
    for size in g["symbols"].tolist():
        doc, counted = g["sequence"][low : low + size].tolist(), -2
        low += size
        for i, pair in enumerate(zip(doc, doc[1:])):
            if counted == i - 1 and doc[i - 1] == pair[0] == pair[1]:
                continue
            places[pair], counted = places[pair] + 1, i
    return max(places.values(), default=0)


@pytest.mark.parametrize("kinds", [1, 2, 3, 7])
def test_grammar_leaves_no_pair_that_pays_and_no_rule_twice(kinds):
    draw = np.random.default_rng(kinds)
    for _ in range(30):
        sizes = draw.integers(0, 60, draw.integers(1, 12))
        ids = draw.integers(0, kinds, sizes.sum())
        g = grammar.compress(ids, sizes, 100)
        assert (grammar.expand_all(g) == ids).all() and (grammar.expand(g["sequence"], g) == ids).all()
        assert left_over(g) < grammar.MIN_COUNT
        rules = list(zip(g["left"].tolist(), g["right"].tolist()))
        assert len(set(rules)) == len(rules) and g["symbols"].sum() == len(g["sequence"])
        assert (g["symbols"] <= sizes).all()


def test_grammar_query_on_odd_rows(spark, docs_of, tmp_path):
    texts, ids = [*ODD, "same", "same"], [5, 4, 3, 2, 1, 0, 9, 8, 7, 6, 10, 11, 12, 13, 14, 15, None, 16]
    path = str(tmp_path / "shards")
    grammar.write_shards(docs_of(texts, ids).withColumnRenamed("lang", "part"), path, public_tokenizers.path(FILES[0][0]), 2, 50_257, shard_ids=50)
    got = {r["doc_id"]: r for r in grammar.read_documents(spark.read.parquet(path)).collect()}
    encode, start = reference(FILES[0][0]), 0
    for doc, text in sorted(zip(ids, texts), key=lambda p: -1 if p[0] is None else p[0]):
        want = [*encode(text), 2]
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(want), checksum(want))
        start += len(want)


def test_grammar_query_on_documents(spark, small_docs):
    got, encode, start = {r["doc_id"]: r for r in token_queries.grammar_shards(spark, "/root/testdata/sf0.001").collect()}, reference(FILES[0][0]), 0
    for r in sorted(small_docs.collect()):
        want = [*encode(r["text"]), 2]
        assert tuple(got[r["doc_id"]])[:4] == (r["doc_id"], start, len(want), checksum(want))
        start += len(want)


def test_empty_tables(spark, docs_of, tmp_path):
    grammar.write_shards(docs_of([]), str(tmp_path / "none"), public_tokenizers.path(FILES[0][0]), 2, 50_257)
    assert grammar.read_documents(spark.read.schema(grammar.SHARD).parquet(str(tmp_path / "none"))).count() == 0
    assert packing.pack(docs_of([]), public_tokenizers.path(FILES[1][0]), 1).count() == 0


def check_packing(rows, texts, capacity):
    encode = reference(FILES[1][0])
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for doc, text in texts.items():
        ids = [*encode(text), 1]
        total += len(ids)
        pieces = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(by_doc[doc], key=lambda r: r["piece"])] == [(i, i * capacity, len(p), checksum(p)) for i, p in enumerate(pieces)]
    for held in by_sequence.values():
        end = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity
    return len(by_sequence), -(-total // capacity)


def test_packing_query(spark, small_docs):
    rows = token_queries.best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    used, least = check_packing(rows, {r["doc_id"]: r["text"] for r in small_docs.collect()}, 4096)
    assert used <= least * 1.02 + 1


def test_packing_of_odd_rows(docs_of):
    rows = packing.pack(docs_of(ODD).withColumnRenamed("lang", "task"), public_tokenizers.path(FILES[1][0]), 1, 16).collect()
    check_packing(rows, dict(enumerate(ODD)), 16)


def first_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        at = min(fits, key=lambda i: gaps[i], default=None)
        if at is None:
            gaps.append(capacity - n)
        else:
            gaps[at] -= n
    return len(gaps)


def test_plan_places_every_piece_once_and_packs_well():
    rng = np.random.default_rng(2)
    for capacity, size in ((30, 200), (12, 60), (100, 500), (4096, 3000), (5, 1)):
        lengths = rng.integers(1, capacity + 1, size)
        counts = dict(zip(*np.unique(lengths, return_counts=True)))
        groups = packing.plan({int(k): int(v) for k, v in counts.items()}, capacity)
        placed = {}
        for g in groups:
            assert sum(n * c for n, c in g.held) <= capacity
            assert sum(c for n, c in g.held if 3 * n > capacity) <= 2
            for n, c in g.held:
                placed[n] = placed.get(n, 0) + c * g.bins
        assert placed == counts
        assert sum(g.bins for g in groups) <= first_fit(lengths, capacity) * 1.03 + 1
        for n, rows in packing.slots(groups).items():
            assert (np.diff(rows[:, 0]) > 0).all() and rows[0, 0] == 0
