"""Languages, quality and URL verdicts against plain Python that follows the definitions letter by letter."""

from __future__ import annotations

import math
import random
from collections import Counter
from functools import cache

import pytest
import regex

from sparkbits.llm import language_id, quality, url_filter


def grams(data: bytes, sizes, bits):
    """Bucket of every n-gram that has no space inside."""
    whole = b" " + data + b" "
    for n in sizes:
        for p in range(len(whole) - n + 1):
            g = whole[p : p + n]
            if b" " in (g if n == 1 else g[1:-1]):
                continue
            value = n
            for byte in g:
                value = (value * 0x01000193 + byte + 1) & 0xFFFFFFFF
            value ^= value >> 15
            value = value * 0x85EBCA6B & 0xFFFFFFFF
            yield value >> (32 - bits)


def words(data: bytes, bits):
    m = (1 << 64) - 1
    for w in data.split(b" "):
        if w:
            total = 0
            for j, byte in enumerate(w):
                x = (byte + 1) * 0x9E3779B97F4A7C15 & m
                x ^= x >> 29
                total += x * (j * 0xBF58476D1CE4E5B9 & m | 1) & m
            total &= m
            total ^= total >> 31
            yield (total * 0x94D049BB133111EB & m) >> (64 - bits)


def test_language_by_hand(docs, rows):
    model = language_id.train(language_id.training_rows(docs, "doc_id", "text", "lang", 1200, 4 << 20))
    found = {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language_id.identify(docs).collect()}
    for i, text, *_ in rows:
        if text and len(text) > 3000:
            continue
        data = b" ".join(bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode()).split())
        if not any(c.isalpha() for c in text or ""):
            assert (i, "und", 0.0) in found
            continue
        buckets = list(grams(data, (1, 2, 3, 4), 14))
        margins = [sum(float(model.weights[b][k]) for b in buckets) / max(1, len(buckets)) + model.bias[k] for k in range(len(model.bias))]
        losses = [sum(t * math.log1p(math.exp(-c * m)) for c, m, t in zip(word, margins, model.trust)) for word in model.code]
        likely = [math.exp(min(losses) - x) for x in losses]
        best = losses.index(min(losses))
        assert any(r[0] == i and r[1] == model.languages[best] and abs(r[2] - likely[best] / sum(likely)) < 1e-4 for r in found), i


def test_quality_by_hand(spark):
    rng = random.Random(6)
    some = lambda n: " ".join(rng.choice("alpha beta gamma delta eps\u00e9lon".split()) for _ in range(n))
    rows = [(k, some(rng.randrange(1, 30)) if k % 2 else some(9).upper() + "!!") for k in range(120)] + [(900, None), (901, ""), (902, "\t x\ny ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(120)], "doc_id long, quality int, toxic int")
    model = quality.train(quality.training_rows(docs, labels, "doc_id", "text", "quality", 5000, 24 << 20))
    found = {r.doc_id: r.score for r in quality.scores(docs, labels).collect()}
    for i, text in rows:
        data = bytes(32 if b in b"\t\n\r\x0b\x0c" else b for b in (text or "").encode())
        buckets = list(grams(data, (2, 3, 4), 15)) + [h | 1 << 15 for h in words(data, 15)]
        z = [sum(float(model.logits[b][c]) for b in buckets) / max(1, len(buckets)) + model.bias[c] for c in (0, 1)]
        assert found[i] == pytest.approx(1 / (1 + math.exp(z[0] - z[1])), abs=1e-5)


def parts(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = regex.match(r"[^/?#]*", after)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), regex.match(r"[^?#]*", after[len(host) :])[0]


def ruled(host, path):
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path), default=None)


def test_urls_by_hand(spark):
    rng = random.Random(8)
    good, bad, all_ = "book shop garden news".split(), "win spin cash".split(), "blog page home".split()
    urls = []
    for k in range(240):
        kind = rng.choice(["ok", "no", "free"])
        pick = lambda own: rng.choice(own + all_)  # noqa: E731, B023
        own = good if kind == "ok" else bad if kind == "no" else rng.choice([good, bad])
        tld, head = {"ok": ("net", "de"), "no": ("org", "es"), "free": ("info", "fr")}[kind]
        urls.append(f"http://{pick(own)}{pick(own)}.{tld}/{head}/{pick(own)}{rng.randrange(3)}")
    urls += [None, "", "no scheme", "x://", "http://A.example.com/en/7", "http://b.example.net/de/8?q#f", "http://UPPER.Net/DE/1", "http://other.zz/" + "q" * 80, "a://" + "book" * 30]
    pages = spark.createDataFrame([(k, u, "<title>" + " ".join(rng.choices(good + bad + all_, k=3)) + "</title>") for k, u in enumerate(urls)] + [(3, urls[3], None)], "page_id long, url string, html string")
    given = [(r.page_id, r.url, r.html) for r in pages.collect()]
    counts = Counter()
    for _, u, html in given:
        title = regex.search(r"(?i)<title>([^<]*)", html or "")
        counts.update(w for w in regex.findall(r"\p{L}+", f"{' '.join(parts(u))} {title[1] if title else ''}".lower()) if len(w) <= 63)
    counts = {w: n - 1 for w, n in counts.items() if n > 1}
    total = sum(counts.values()) + 1
    cost = lambda w: math.log(total / counts[w]) if w in counts else math.log(total) + 2.3 * len(w)

    @cache
    def least(p):
        return min((cost(p[:k]) + least(p[k:]) for k in range(1, min(63, len(p)) + 1)), default=0.0)

    out = url_filter.judge(pages).collect()
    assert len(out) == len(given)
    split = {}
    for r in out:
        u = urls[r.page_id]
        host, path = parts(u)
        pieces = [p for name in (host.split(":")[0], path.lower()) for p in regex.findall(r"[^\W\d_]+|\d+", name)]
        assert (r.host, r.path) == (host, path)
        rest = list(r.words)
        for p in pieces:
            if p[0].isdigit():
                assert rest.pop(0) == "#"
                continue
            own = []
            while "".join(own) != p:
                own.append(rest.pop(0))
            assert sum(map(cost, own)) == pytest.approx(least(p), abs=1e-9)
        assert not rest
        split[r.page_id] = list(r.words)
    label = {i: ruled(*parts(u)) for i, u, _ in given}
    of = {v: Counter() for v in ("block", "allow")}
    n = Counter()
    for i, *_ in given:
        if label[i]:
            of[label[i].verdict].update(split[i])
            n[label[i].verdict] += 1
    known = set(of["block"]) | set(of["allow"])
    size = {v: sum(c.values()) + 0.1 * len(known) for v, c in of.items()}
    verdicts = Counter()
    for r in out:
        odds = math.log((n["block"] + 0.1) / (n["allow"] + 0.1)) + sum(math.log((of["block"][w] + 0.1) / size["block"]) - math.log((of["allow"][w] + 0.1) / size["allow"]) for w in split[r.page_id] if w in known)
        assert r.block_score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)
        rule = label[r.page_id]
        assert r.rule == (rule.host + rule.path if rule else None)
        assert r.verdict == (rule.verdict if rule else "block" if odds > 0 else "allow")
        if not rule and "info" in r.host:
            verdicts[any(b in "".join(split[r.page_id]) for b in bad), r.verdict] += 1
    assert verdicts[True, "block"] > 5 and verdicts[False, "allow"] > 5  # what the method learned from URLs under rules
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages.where("page_id = 243")).collect()} == {"allow"}
