import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from panelcast.llm import manifest_queries, merkle


def h(*digests):
    return sha256("".join(digests).encode()).hexdigest()


def leaf(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return h(*parts)


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, place):
    out = []
    for level in levels[:-1]:
        out += level[place ^ 1 : (place ^ 1) + 1]
        place //= 2
    return out


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof hash, verified) of rows (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    held = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs]
    trees = [tree([leaf(r) for r in rs]) for rs in held]
    top = tree([t[-1][0] for t in trees])
    out = []
    for i, rs in enumerate(held):
        for j, r in enumerate(rs):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            out.append((r[0], leaf(r), trees[i][-1][0], top[-1][0], h(*siblings(trees[i], j), *siblings(top, i)), not changed))
    return sorted(out, key=repr)


def proved(docs):
    longer = merkle.leaf_of([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS])
    own = merkle.leaf_of([F.col(f) for f in merkle.FIELDS])
    return merkle.prove(merkle.manifest(docs, claimed=F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, longer).otherwise(own)))


def checked(frame):
    return sorted(((r["key"], r["leaf"], r["subroot"], r["root"], h(*r["proof"]), r["folded_root"] == r["root"]) for r in frame.collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
ODD = [
    (5, "s", "en", 3, "abc"), (5, "s", "en", 3, "abc"), (5, "s", "en", 3, "abd"), (None, "s", "en", 1, "x"), (None, None, None, None, None),
    (7, "ü", "de", 0, ""), (-3, "s", "", 2, "é€"), (9, "s", None, 300_000, "long " * 60_000), (14, "s", None, 4, None), (3, "t", "zz", None, "lone"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD * 2 + [(i, "s", "en", i, f"text {i}") for i in range(100, 140)], SCHEMA)
    clash = docs.withColumns({c: F.lit(1) for c in ("key", "tree", "place", "size", "leaf", "slice", "name", "block")})
    assert checked(proved(clash)) == brute([tuple(r) for r in docs.collect()])


def test_single_leaf_and_empty_table(spark):
    docs = spark.createDataFrame(ODD[:1], SCHEMA)
    (row,) = proved(docs).collect()
    assert row["proof"] == [] and row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == leaf(ODD[0])
    assert proved(docs.limit(0)).count() == 0


def test_trees_of_several_tiers_and_many_groups(spark):
    rows = [(i, f"s{i % 5}", "en" if i < 9001 else f"l{i}", i * 3, f"text {i}") for i in range(9070)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert checked(proved(docs)) == brute(rows)


def test_proofs_of_some_leaves(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(6000)]
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    some = made.leaves.where("key IN (1, 2, 77, 3000, 3001, 5998)")
    want = [r for r in brute(rows) if r[0] in (1, 2, 77, 3000, 3001, 5998)]
    assert [r[:-1] for r in checked(merkle.prove(made, some))] == [r[:-1] for r in want]


def test_least_union_of_nodes():
    # leaves 2, 3 and 6 of seven: 2 and 3 give their parent, 6 has no partner
    levels = merkle.levels_above(np.array([6, 2, 3]), 7)
    assert [m.tolist() for _, m in levels] == [[], [0, 2], []]
    assert [k.tolist() for k, _ in levels] == [[2, 3, 6], [1, 3], [0, 1]]
    rng = np.random.default_rng(4)
    for size in (1, 2, 5, 64, 100):
        known = set(rng.integers(0, size, 9).tolist())
        fetched = {(n, p) for n, (_, m) in enumerate(merkle.levels_above(np.array(sorted(known)), size)) for p in m.tolist()}
        level, derived, n = 0, known, size
        while n > 1:  # with any one fewer, some parent could not be hashed
            need = {c for p in {k // 2 for k in derived} for c in (2 * p, 2 * p + 1) if c < n}
            assert need - derived == {p for m, p in fetched if m == level}
            level, derived, n = level + 1, {k // 2 for k in derived}, (n + 1) // 2


def test_query(spark, small_docs):
    rows = [tuple(r) for r in small_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = manifest_queries.merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in got), key=repr) == brute(rows)
