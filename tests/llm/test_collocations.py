import re
from collections import Counter
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from panelcast.llm import collocations

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count, max_words, top):
    """Rows (lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            totals[lang] += len(words)
            for size in range(1, max_words + 1):
                counts.update((lang, words[i : i + size]) for i in range(len(words) - size + 1))
    phrases = {k: a for k, a in counts.items() if a >= min_count and len(k[1]) > 1}
    covered = set()
    for (lang, words), a in phrases.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = (lang, words[i : i + size])
                if 100 * a >= 50 * phrases[part]:
                    covered.add(part)
    out = []
    for lang in totals:
        found = []
        for (own, words), a in phrases.items():
            if own != lang or (own, words) in covered:
                continue
            cuts = []
            for k in range(1, len(words)):
                left, right = counts[(lang, words[:k])], counts[(lang, words[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts():
    rng = np.random.default_rng(3)
    words = [*"abcdefghij", "É", "x y", "The", "new", "york", "'s"]
    odd = [None, "", " \t \n", ".,;:!?", "new york city. NEW YORK", "a  a\ta\x0ba a a a", "\x00 b \x85 c", "long word " * 20_000]
    plain = ["".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\r\n", ","]) for w in rng.choice(words, int(n))) for n in rng.integers(0, 60, 80)]
    return odd + plain + plain[:9]


def rows_of():
    langs = ["en", "de", None, "und", "en", ""]
    return [(langs[i % 6], t) for i, t in enumerate(texts())]


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, doc_id long")


def test_against_plain_counts(spark):
    rows = rows_of()
    clash = frame(spark, rows).withColumns({c: F.lit("x") for c in ("shard", "n", "id", "rank", "i", "j", "word", "_order")})
    got = sorted(tuple(r) for r in collocations.collocations(clash.repartition(3), 3, 3, 40).collect())
    assert got == brute(rows, 3, 3, 40) and len(got) > 60


def test_longer_phrases(spark):
    rows = rows_of()
    got = collocations.collocations(frame(spark, rows).repartition(2), 2, 5, 1000)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 2, 5, 1000)


def test_without_rows_or_frequent_phrases(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [("en", "one two three"), (None, None)])).count() == 0


def test_crowded_tiles_and_sorted_pairs_agree():
    rng = np.random.default_rng(5)
    ids = np.sort(rng.choice(40_000, 9_000, replace=False))
    skewed = (rng.zipf(1.3, 400_000) % len(ids)).astype(np.int32)
    left, right = skewed[:-1], skewed[1:]
    i, j, n = collocations.tile_counts(left, right, ids)
    want = Counter(zip(ids[left].tolist(), ids[right].tolist()))
    assert dict(zip(zip(i.tolist(), j.tolist()), n.tolist())) == want and len(i) == len(want)
    none = collocations.tile_counts(left[:0], right[:0], ids)
    assert [len(x) for x in none] == [0, 0, 0]


def test_scores_beyond_64_bits(spark):
    row = spark.range(1).select(collocations._score(*(F.lit(x).cast("long") for x in (9 * 10**12, 9 * 10**12 + 7, 10**13))).alias("s"))
    assert row.first()["s"] == Decimal(10**6) * 81 * 10**24 // ((9 * 10**12 + 7) * 10**13)
