import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import bloom, editdistance, jaccard, linededup, linking
from panelcast.llm.queries import QUERIES


def components_of(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(40, 90), rng.randrange(40, 90)) for _ in range(30)] + [(100, 101)]
    want = {i: c for i, c in enumerate(components_of(110, edges)) if any(i in e for e in edges)}
    got = {r["id"]: r["label"] for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and {k for e in edges if e[0] != e[1] for k in e} == set(got)


def test_components_are_a_table_of_files(spark):
    labels = linking.components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long"))
    assert "Exchange" not in labels._jdf.queryExecution().executedPlan().toString()


def test_filter_lets_all_keys_and_few_others_through(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("id"), F.array(F.col("id")).alias("tokens"))
    keys = spark.range(0, 20_000, 100).select(F.xxhash64("id").alias("k"))
    kept = bloom.matching(rows, "id", keys)
    assert kept.schema == rows.schema
    got = {r["tokens"][0] for r in kept.collect()}
    assert got >= set(range(0, 20_000, 100)) and len(got) < 300
    assert not bloom.matching(rows, "id", keys.limit(0)).collect()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            text.insert(at, rng.choice("abcé"))
        elif text and at < len(text):
            text[at : at + 1] = [] if kind == 1 else [rng.choice("abcé𝄞")]
    return "".join(text)


def test_edit_distance_against_plain_programme():
    rng = random.Random(4)
    left, right = [], []
    for _ in range(600):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 40)))
        left.append(a), right.append(edited(rng, a, rng.randrange(0, 6)))
    for k in range(4):
        assert editdistance.within(left, right, k).tolist() == [distance(a, b) <= k for a, b in zip(left, right)]
    assert editdistance.within([], [], 2).tolist() == []


def test_segment_probes_miss_no_pair():
    rng = random.Random(5)
    for _ in range(400):
        k = rng.randrange(1, 4)
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(k + 2, 30)))
        b = edited(rng, a, k)
        long, short = sorted((a, b), key=len, reverse=True)
        if len(short) < k + 1:
            continue
        own = {(len(short), i, short[s : s + n]) for i, (s, n) in enumerate(linededup.segments(len(short), k))}
        assert own & {(other, i, long[at : at + n]) for other, i, at, n, _ in linededup.probes(len(long), k)}


def test_signatures_never_part_a_pair(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abcdefé𝄞") for _ in range(rng.randrange(3, 60)))
        b = edited(rng, a, 2)
        rows.append((len(a), linededup.signature(a), len(b), linededup.signature(b)))
    rows = spark.createDataFrame(rows, "la long, sa long, lb long, sb long")
    side = lambda k: F.struct(F.col(f"l{k}").alias("length"), F.col(f"s{k}").alias("signature"))
    assert rows.where(~linededup.edit_filter(2)(side("a"), side("b"))).count() == 0


def test_signatures_of_opposite_sign(spark):
    rows = spark.createDataFrame([(40, 2**63 - 1, 40, -(2**63))], "la long, sa long, lb long, sb long")
    side = lambda k: F.struct(F.col(f"l{k}").alias("length"), F.col(f"s{k}").alias("signature"))
    assert rows.where(linededup.edit_filter(2)(side("a"), side("b"))).count() == 0


def line_brute(texts, k, least):
    """Dropped line numbers per document by comparing all pairs of long lines."""
    where = [(d, n, raw.strip(linededup.EDGES)) for d, t in enumerate(texts) if t is not None for n, raw in enumerate(t.split("\n"))]
    where = [w for w in where if len(w[2]) >= least]
    distinct = sorted({w[2] for w in where})
    at = {line: i for i, line in enumerate(distinct)}
    links = [(i, j) for i in range(len(distinct)) for j in range(i) if abs(len(distinct[i]) - len(distinct[j])) <= k and distance(distinct[i], distinct[j]) <= k]
    label = components_of(len(distinct), links)
    seen, dropped = set(), {d: [] for d in range(len(texts))}
    for d, n, line in sorted(where):
        if label[at[line]] in seen:
            dropped[d].append(n)
        seen.add(label[at[line]])
    return dropped


def test_line_dedup_against_all_pairs(docs_of):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(34, 50))).strip() + "end of line" for _ in range(12)]
    texts = ["\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 6))) for _ in range(30)]
    texts += [None, "", "short\nshort\nshort", base[0] + "\n  " + base[0], "  " + base[1] + "\r"]
    want = line_brute(texts, 2, 32)
    out = {r["doc_id"]: r for r in linededup.dedup_lines(docs_of(texts).withColumnRenamed("lang", "id")).collect()}
    assert len(out) == len(texts) and out[30]["text"] is None and "id" in out[0].asDict()
    for d, text in enumerate(texts):
        assert out[d]["n_dropped"] == len(want[d])
        if text is not None:
            assert out[d]["text"] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want[d])


def test_line_dedup_of_repeated_and_missing_ids(docs_of):
    line = "a line that is long enough to be compared with others"
    out = linededup.dedup_lines(docs_of([line, line, line + "\nother text", line], [1, 1, None, 2])).collect()
    assert len(out) == 4 and sum(r["n_dropped"] for r in out if r["doc_id"] != None) >= 1  # noqa: E711
    assert linededup.dedup_lines(docs_of([])).count() == 0


def test_equal_lines_of_every_length(docs_of, tmp_path):
    docs = docs_of(["yes\n\n no\nyes", "no \n\n7", "7\nyet"])
    out = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in linededup.dedup_lines(docs, exact_chars=1).collect()}
    assert out == {0: (1, "yes\n\n no"), 1: (1, "\n7"), 2: (1, "yet")}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op3_line_dedup"](docs.sparkSession, str(tmp_path)).collect()}
    assert rows == {0: (0, 1, "3"), 1: (0, 1, "0"), 2: (0, 1, "0")}


def jaccard_brute(texts, n, percent):
    sets = [set(x.tolist()) for x in jaccard.shingles(pa.array(texts, pa.string()), n)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], components_of(len(sets), links)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_classes_against_all_pairs(docs_of, n, percent):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    texts = []
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [None, "", "  \n", "one", "One", "two words", "a b c d", "a b c d e", texts[0].upper(), texts[0], "Ä ä Ä ä Ä ä"]
    sizes, label = jaccard_brute(texts, n, percent)
    got = {r["doc_id"]: r for r in jaccard.join_classes(docs_of(texts).withColumnRenamed("lang", "label"), n, percent).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == label


def test_jaccard_of_a_large_group_and_of_nothing(docs_of):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(150):
        copy = list(words)
        copy[rng.randrange(200)] = "x"
        texts.append(" ".join(copy))
    assert {r["component_id"] for r in jaccard.join_classes(docs_of(texts), 4, 85).collect()} == {0}
    assert jaccard.join_classes(docs_of([]), 4, 85).count() == 0
    twins = jaccard.join_classes(docs_of(["a b c d e f"] * 3, [3, 3, None])).collect()
    assert len(twins) == 3 and {r["component_id"] for r in twins} == {3}


def test_known_sets_in_one_python_step(docs_of):
    texts = [f"w{i} x{i} y{i} z{i} end{i}" for i in range(50)] + [None, "", "short one"]
    sets = {jaccard.set_id(s): s.view("int64").tolist() for s in jaccard.shingles(pa.array(texts, pa.string()), 4) if len(s)}
    docs = docs_of(texts, [*range(49), None, None, 51, 52])
    known = [(jaccard.set_id(jaccard.shingles(pa.array([texts[i]]), 4)[0]), first) for i, first in ((0, 0), (7, 7), (49, None), (52, 52))]
    found = jaccard.token_sets(docs, 4, docs.sparkSession.createDataFrame(known, "id long, first long"))
    # one worker per task: a filter in a second step would hold another one
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["id"]: r["tokens"] for r in found.collect()}
    assert {i for i, _ in known} <= set(got) and len(got) < 10
    assert all(sets[i] == tokens for i, tokens in got.items())


def test_shingles_are_sets_of_word_runs():
    def grams(text, n):
        words = "".join(c.lower() if c.isascii() else c for c in text).split()
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()

    texts = ["A B C D", "a\tb\x0bc\nd", "Ä b c d", "ä b c d", "a b", "b a", "a b c d a b c d e", "", "x"]
    sets = [set(s.tolist()) for s in jaccard.shingles(pa.array(texts), 4)]
    for i, x in enumerate(texts):
        assert len(sets[i]) == len(grams(x, 4))
        for j, y in enumerate(texts):
            assert len(sets[i] & sets[j]) == len(grams(x, 4) & grams(y, 4))


def test_size_classes_keep_pairs_within_the_ratio(spark):
    rows = spark.range(1, 300).select(F.lit(1).alias("bucket"), "id", F.shiftleft("id", 32).alias("place"), F.lit(True).alias("lead"))
    spread = jaccard.by_size(rows, 85).collect()
    held = {}
    for r in spread:
        held.setdefault(r["id"], set()).add(r["bucket"])
    assert all(held[a] & held[b] for a in held for b in held if 100 * min(a, b) >= 85 * max(a, b))
    assert not held[100] & held[200]


def test_filters_keep_every_similar_pair(spark):
    could = jaccard.size_and_position(80)
    place = lambda size, at: (size << 32) + at
    rows = spark.createDataFrame([(place(100, 0), place(80, 0), True), (place(100, 0), place(79, 0), False), (place(10, 2), place(10, 2), False), (place(10, 1), place(10, 1), True)], "x long, y long, want boolean")
    assert rows.where(could(F.col("x"), F.col("y")) != F.col("want")).count() == 0
