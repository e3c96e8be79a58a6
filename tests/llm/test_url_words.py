"""Words beyond those sent to executors count like any others."""

from __future__ import annotations

import random

from sparkbits.llm import url_filter


def test_words_beyond_the_vocabulary(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7))) for _ in range(60)] + ["casino", "keygen", "poker"]
    urls = [f"http://{rng.choice(words)}{rng.choice(words)}.{rng.choice(words)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice([*words, 'en', 'de', 'es'] + ['en', 'de', 'es'] * 20)}/{rng.choice(words)}{rng.choice(words)}/{k % 7}" for k in range(150)]
    pages = spark.createDataFrame([(k % 140, u, "<title>" + " ".join(rng.choices(words, k=4)) + "</title>") for k, u in enumerate(urls)], "page_id long, url string, html string").repartition(3)
    columns = ("page_id", "host", "path", "rule", "verdict", "words", "block_score")
    out = {v: sorted(map(str, url_filter.judge(pages, vocabulary=v).select(*columns).collect())) for v in (50_000, 3)}
    assert out[3] == out[50_000]
