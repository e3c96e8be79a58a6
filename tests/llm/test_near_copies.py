"""Near copies against brute force over all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from sparkbits.llm import near_copies

from .conftest import SCHEMA
from .test_operators import classes


def near(a: set, b: set) -> bool:
    return 5 * len(a & b) >= 4 * len(a | b)


def sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]


def kept(rows):
    """Least (id, null last) of each group."""
    group, first = classes(sets(t for _, t, *_ in rows), near), {}
    for (i, *_), g in sorted(zip(rows, group), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        first.setdefault(g, i)
    return sorted((i is None, i or 0) for i in first.values())


def found(spark, df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())


def test_documents(spark, docs, clash, empty, rows):
    assert found(spark, docs) == kept(rows)
    assert corpus_pipeline.near_duplicates(spark, clash.limit(3), "").columns == clash.columns
    assert found(spark, empty) == []


def test_planted(spark):
    """Edited copies, chains of edits and texts that share a passage, around the bound of 0.8."""
    rng = random.Random(7)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, out = text(60), []
    for _ in range(15):
        base = text(rng.choice([4, 12, 60, 200]))
        out.append(base)
        for _ in range(5):  # some from the last edit, so that groups are chains
            base = list(rng.choice(out[-3:]))
            for _ in range(rng.randrange(5)):
                base[rng.randrange(len(base))] = f"e{rng.randrange(5000)}"
            out.append(base)
    out += [text(rng.randrange(5, 40)) + passage for _ in range(40)]
    rng.shuffle(out)
    rows = [(k, " ".join(w), "en", "s", 1) for k, w in enumerate(out)]
    assert len(kept(rows)) < len({t for _, t, *_ in rows}) - 10
    assert found(spark, spark.createDataFrame(rows, SCHEMA).repartition(4)) == kept(rows)


@pytest.mark.parametrize("size", [150, 300])
def test_large_group(spark, monkeypatch, size):
    """Pairs of a large group aren't all verified, nor those of its copies that aren't similar to each other; a chain of edits stays whole."""
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]

    def edited(words, most):
        words = list(words)
        for _ in range(rng.randrange(1, most + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**7)}"
        return words

    base, chain = text(146), [text(100)]
    for _ in range(30):
        chain.append(edited(chain[-1], 2))
    out = [base, *(edited(base, 5) for _ in range(size)), *chain, *(text(rng.randrange(50, 200)) for _ in range(size))]
    out += [base[:120] + text(14) for _ in range(3)]  # shorter than the group, with its passages
    rng.shuffle(out)
    rows = [(k, " ".join(w), "en", "s", 1) for k, w in enumerate(out)]
    pairs, verified = [], near_copies.verified

    def counted(df, *rest):
        pairs.append(df.count())
        return verified(df, *rest)

    monkeypatch.setattr(near_copies, "verified", counted)
    assert found(spark, spark.createDataFrame(rows, SCHEMA).repartition(4)) == kept(rows)
    assert sum(pairs) < 2 * size, pairs


def test_pairs_apart(spark):
    """Every pair of different groups in a list comes once, whichever group is the largest."""
    rng = random.Random(3)
    rows = [(key, node, 10, 10, (node * 7 + key) % 4) for key in range(6) for node in rng.sample(range(12), 8)]
    rows += [(9, node, 10, 10, 5) for node in range(3)] + [(9, 20, 13, 13, 6)]  # too long for the others
    got = near_copies._apart(spark.createDataFrame(rows, "key long, node long, size long, rest long, root long")).collect()
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[4] != y[4] and 20 not in (x[1], y[1])}
    assert sorted(map(tuple, got)) == sorted(want)
