"""Training-data operators against brute force on a small table with the awkward cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbits.llm import common, components, decontaminate, fingerprints, language_id, quality, secrets, sentencepiece_codec, simhash_dedup, subwords, suffix_dedup, url_filter, warc
from sparkbits.llm.queries import tokenizer_file

sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()
low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# ---- 1 SentencePiece


def test_sentencepiece(docs, clash, empty, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    want = Counter((i, len(ids := sp.encode(t or "")), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t, *_ in rows)
    for df in (docs, clash):
        assert got(sentencepiece_codec.encode_decode(df, tokenizer_file(), outputs=columns), "doc_id", *columns) == want
    assert got(sentencepiece_codec.encode_decode(docs, tokenizer_file(), outputs=columns, table_bytes=100), "doc_id", *columns) == want
    assert sentencepiece_codec.encode_decode(empty, tokenizer_file()).count() == 0
    whole = sentencepiece_codec.encode_decode(docs, tokenizer_file()).collect()
    assert all(r.decoded == sp.decode(r.ids) for r in whole)


# ---- 2 SimHash near-dedup


def reference_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(items, linked):
    """Least member of each item's group."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if linked(items[a], items[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(items))]


def test_simhash(docs, clash, empty, rows):
    fps = [reference_fingerprint(t) for _, t, *_ in rows]
    group = classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(lambda: None)
    for (i, *_), g in zip(rows, group):
        if i is not None:
            least[g] = i if least[g] is None else min(least[g], i)
    want = Counter((i, f"{f:016x}", least[g]) for (i, *_), f, g in zip(rows, fps, group))
    for df in (docs, clash):
        assert got(simhash_dedup.report(df), "doc_id", "fingerprint", "component_id") == want
    assert simhash_dedup.report(empty).count() == 0
    kept = simhash_dedup.deduplicate(clash)
    assert kept.columns == clash.columns
    assert sorted(r.doc_id is None or r.doc_id for r in kept.collect()) == sorted(least[g] is None or least[g] for g in set(group))


def test_simhash_long_lists(spark):
    """More fingerprints under one key than a cell holds, and a chain: groups are those of brute force."""
    rng = random.Random(2)
    fps = {0x2BCDEF << 40 | rng.getrandbits(3) << 20 | 1 << rng.randrange(16) | rng.getrandbits(2) << 30 for _ in range(300)} | {rng.getrandbits(63) for _ in range(200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = {r.node: r.root for r in components.components(simhash_dedup.links(df, block=20)).collect()}
    group = classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert [fps[g] for g in group] == [root.get(f, f) for f in fps]


def test_planes_cover():
    from itertools import combinations

    assert len(simhash_dedup.PLANES) == 14
    assert all(any(set(p) <= set(s) for p in simhash_dedup.PLANES) for s in combinations(range(8), 5))


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    root = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for a, b in edges for x in (a, b)})
    pairs = set(edges) | {(b, a) for a, b in edges}
    group = classes(nodes, lambda a, b: (a, b) in pairs)
    assert {n: nodes[g] for n, g in zip(nodes, group) if n != 300} == {n: r for n, r in root.items() if n != 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 3 fingerprints


def test_fingerprints(docs, clash, empty, rows):
    def fp(t):
        import xxhash

        v, total = [0] * 64, 0
        for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower()):
            n = min(8, len(w))
            h = xxhash.xxh64_intdigest(w.encode(), seed=42)
            total += n
            for k in range(64):
                v[k] += n * (h >> k & 1)
        return sum(1 << k for k in range(64) if 2 * v[k] > total)

    known = [r for r in rows if r[0] is not None]
    order = sorted(((i, hashlib.md5((t or "").encode()).hexdigest(), t or "") for i, t, *_ in known), key=lambda x: (-x[0], x[1]))
    order += [(None, "", "a text without an id")]
    want = Counter()
    for n, (i, _, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][2]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = fp(t), fp(e), fp(nxt)
        near = sum((a ^ fp(x[2])).bit_count() <= 3 for x in order) if i is not None and i % 20 == 0 else None
        want[(i, len(t), sha(e), f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64, near)] += 1
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_within")
    for df in (docs, clash.drop("n_chars")):
        assert got(fingerprints.report(df), *columns) == want
    assert fingerprints.report(empty).count() == 0
    one = fingerprints.report(docs.where("doc_id = 7")).first()
    assert one.near_next == 1.0


def stage_plans(monkeypatch, run):
    """The plans of all tables that are written while run() works, and of its result."""
    plans, written = [], common._written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def seen(df, path):
        plans.append(plan(df))
        return written(df, path)

    monkeypatch.setattr(common, "_written", seen)
    return plans, plan(run())


def test_fingerprint_plans_are_native(docs, monkeypatch):
    plans, last = stage_plans(monkeypatch, lambda: fingerprints.report(docs))
    assert len(plans) >= 3 and not any(re.search("Python|Pandas|Arrow", p) for p in [*plans, last])


def test_fingerprint_ranges(docs, rows):
    """As many ranges as rows, and as few as may be: the same next documents."""
    some = docs.where("doc_id is not null")
    want = got(fingerprints.report(some), "doc_id", "edited_sha256", "near_next")
    for count in (2, 60):
        r = fingerprints.with_next(some, count=count)
        assert r.where("_ghost = 0").count() == some.count() and r.where("_ghost = 0 and _next is null").count() == 0
    assert r.select("_range").distinct().count() > 30
    assert sum(want.values()) == some.count()


# ---- 4 decontamination


def hits(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add("" if name is None else str(name))
    out = []
    for i, t, *_ in rows:
        w, hit, names = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    names |= windows[k]
        out.append((i, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return Counter(out)


def test_decontamination(docs, clash, empty, rows, table):
    texts = {i: t for i, t, *_ in rows}
    cut = lambda k, a, b: " ".join((texts[k] or "").split()[a:b])
    items = [(1, cut(55, 100, 140)), (2, cut(3, 2, 9)), (3, cut(55, 100, 140).upper()), (10, cut(9, 0, 11)), (4, None), (5, ""), (6, "!!"), (None, cut(20, 1, 14)), (1, cut(33, 0, 12)), (7, cut(55, 300, 309)), (8, cut(54, 0, 1))]
    bench = table(items, "item_id int, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for df in (docs, clash):
        assert got(decontaminate.report(df, bench), *columns) == hits(rows, items)
    assert decontaminate.report(empty, bench).count() == 0
    assert got(decontaminate.report(docs, bench.limit(0)), *columns) == hits(rows, [])
    few = [(1, "aa bb"), (2, "bb"), (3, "aa bb cc dd"), (4, "b a b a b a b a b a b a")]
    short = [(1, "aa bb cc dd bb"), (2, "x aa x bb"), (3, "b a " * 9), (4, "cc dd")]
    assert got(decontaminate.report(table(short, "doc_id int, text string"), table(few, "item_id int, text string")), *columns) == hits(short, few)


def test_decontamination_in_shards(docs, rows, table):
    items = [(k, " ".join((t or "").split()[3:18])) for k, t, *_ in rows[:40]]
    shards = decontaminate.build(table(items, "item_id int, text string"), shard_words=60)
    assert len(shards.automata) > 3
    found = decontaminate.matches(docs, shards)
    whole = decontaminate.matches(docs, decontaminate.build(table(items, "item_id int, text string")))
    for c in ("runs", "items"):
        key = F.to_json(c).alias(c)
        assert got(found.select("_id", key), "_id", c) == got(whole.select("_id", key), "_id", c)


def test_decontamination_cleans(clash, rows, table):
    text = next(t for i, t, *_ in rows if i == 55)
    leak = " ".join(text.split()[50:90])
    out = decontaminate.clean(clash, table([(1, leak), (2, "a text without an id")], "item_id int, text string"))
    assert out.columns == clash.columns
    left = {r.doc_id: r for r in out.collect()}
    assert leak not in left[55].text and left[55].n_chars == len(left[55].text) and left[55].text.startswith(text[:100])
    assert None not in left and left[50].text is None and len(left) == 70


# ---- 5 and 8 models


def test_language(docs, clash, empty, rows):
    found = {(r.doc_id, r.held_out): r for r in language_id.identify(docs).collect()}
    assert len(found) == 71
    for i, t, lang, *_ in rows:
        r = found[(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0)]
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif i is not None and i < 44 and i not in (3, 9, 20, 33) and len(t) > 200:
            assert r.lang_pred == lang and 0 <= r.score <= 1
    assert language_id.identify(clash).count() == 72 and language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit("xx"))).collect()} == {"und", "xx"}


def test_language_reads_no_labels(docs):
    """Other lang, source or ids outside the training rows change nothing."""
    a = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    other = docs.withColumn("source", F.lit("t")).withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in language_id.identify(other).collect()} == a


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 30):
        code = language_id.codewords(n)
        apart = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert apart >= (1 if n == 2 else 2)


def test_quality(spark, empty):
    rng = random.Random(4)
    rows = [(k, (lambda w: " ".join(w) if k % 3 else "!!! ".join(x.upper() for x in w))([rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(40)])) for k in range(300)] + [(900, None), (901, ""), (902, "x " * 50_000)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(1, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit(0)).withColumn("score", F.lit(0))
    out = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    assert len(out) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    held = [r for k, r in out.items() if k < 300 and r.held_out]
    assert len(held) > 30 and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert out[900].score == out[901].score
    assert quality.scores(empty, labels).count() == 0
    assert {r.score for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}


def test_features_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(5)
    data = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(3000)).encode()
    whole = np.sort(np.concatenate(list(subwords.ngrams(data, (1, 2, 3, 4), 14))))
    monkeypatch.setattr(subwords, "PIECE", 1000)
    assert np.array_equal(whole, np.sort(np.concatenate(list(subwords.ngrams(data, (1, 2, 3, 4), 14)))))


# ---- 6 URLs


def test_urls(spark):
    urls = ["http://A.Example.com/en/5", "https://example.com/en/71?x", "x://shop.net/de/1#a", "http://example.net/de/8", "http://example.org/es/", "http://com/en/", "http://notcom/en/", None, "no scheme", "http://www.casino-win.example.org/fr/1", "http://bookshop.example.org/fr/1", "a://b://c/d", "http://x.com?q=/en/", "http://x.com/en", ""]
    pages = spark.createDataFrame([(k, u, "<title>book shop and more book shop casino</title>") for k, u in enumerate(urls)] + [(100 + k, f"http://www.{w}-win.example.org/fr/{k}", None) for k, w in enumerate(["casino", "book", "shop"] * 8)], "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("host", F.lit("x"))
    out = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(out) == len(urls) + 24
    want = [("a.example.com", "/en/5", "com/en/", "block"), ("example.com", "/en/71", "example.com/en/7", "allow"), ("shop.net", "/de/1", "net/de/", "allow"), ("example.net", "/de/8", "example.net/de/8", "block"), ("example.org", "/es/", "org/es/", "block"), ("com", "/en/", "com/en/", "block"), ("notcom", "/en/", None), ("", "", None), ("", "", None), ("www.casino-win.example.org", "/fr/1", None), ("bookshop.example.org", "/fr/1", None), ("b:", "//c/d", None), ("x.com", "", None), ("x.com", "/en", None), ("", "", None)]
    assert [(out[k].host, out[k].path, out[k].rule, out[k].verdict)[: len(want[k])] for k in range(len(urls))] == want
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_segmentation():
    s = url_filter.Segmenter({"book": 50, "shop": 40, "books": 30, "hop": 5, "casino": 20, "win": 20})
    assert s.split("bookshop") == ("book", "shop") and s.split("casinowin") == ("casino", "win") and "".join(s.split("zzbookq" * 50)) == "zzbookq" * 50


# ---- 7 WARC


def test_warc(spark, tmp_path):
    long = "<p>é" + "x" * 1200
    rows = [(1, "http://a/ b\r\n", long), (2, None, long), (3, "http://c", long), (4, "http://d", "short"), (5, "http://e", "short"), (6, "http://f", None), (7, "http://g", ""), (8, "http://h", "y" * 999), (9, "http://i", "y" * 999), (10, "http://j", "z" * 1000), (11, "http://k", "z" * 1000), (11, "http://k", "z" * 1000), (None, "http://l", "z" * 1000), (12, "http://m", "w" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(0)).withColumn("payload", F.lit(0)).repartition(3)
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        same = [x[0] for x in rows if x[0] is not None and (x[2] or "").encode() == p]
        ref = max(same) if len(p) >= 1000 and i != max(same) else None
        want[(i, len(p), hashlib.sha1(p).hexdigest(), "response" if ref is None else "revisit", ref)] += 1
    assert got(warc.round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder = f"file://{tmp_path}/w"
    index = warc.write(warc.roles(pages), folder, file_bytes=500)
    assert index.select("file").distinct().count() > 3
    some = warc.read(index.where("id in (2, 12)"), folder, body=True).collect()
    assert {(r.id, bytes(r.payload)) for r in some} == {(2, b""), (12, b"w" * 300_000)}


def test_ranges_are_coalesced():
    assert warc.coalesced([("a", 0, 10), ("a", 10, 5), ("a", 100_000, 5), ("b", 0, 5)]) == [("a", 0, 15, 0, 2), ("a", 100_000, 100_005, 2, 3), ("b", 0, 5, 3, 4)]
    assert len(warc.coalesced([("a", k * 100, 100) for k in range(100)], most=1000)) == 10


# ---- 9 secrets


def base(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def test_secrets(docs, clash, empty, rows):
    want = Counter()
    for i, t, *_ in rows:
        s = base(t or "")
        want[(i, *(sum(x[3] == k for x in s) for k in ("assign", "access", "hex")), sha(",".join(f"{k}:{a}:{e}" for a, _, e, k in s)))] += 1
    for df in (docs, clash):
        assert got(secrets.report(df), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    assert secrets.report(empty).count() == 0
    spans = {r.doc_id: r.spans for r in secrets.report(docs).collect()}
    text = next(t for i, t, *_ in rows if i == 61)
    named = {k: text[int(a) : int(e)] for k, a, e in (x.split(":") for x in spans[61].split(","))}
    assert named == {"weak_access": "AKIA12345678", "weak_secret": "secret: abcd12345", "endpoint": "https://store.example.com/a", "access": "AKIA" + "Z9" * 20}


def test_secrets_need_company(table):
    rows = [(1, "secret: abcd12345"), (2, "secret: abcd12345 " + "x " * 150 + "https://a.b/c"), (3, "secret: abcd12345 " + "x " * 90 + "https://a.b/c"), (4, "https://a.b/c AKIA12345678"), (5, "AKIA12345678 " + "😀" * 150 + " token=abcdefghijkl")]
    out = {r.doc_id: r.spans for r in secrets.report(table(rows, "doc_id long, text string")).collect()}
    assert out == {1: "", 2: "", 3: "weak_secret:0:17", 4: "", 5: "weak_access:0:12,assign:164:182"}


def test_secrets_redacted(clash, rows):
    out = secrets.redact(clash)
    assert out.columns == clash.columns
    left = {r.doc_id: r for r in out.collect()}
    assert left[60].text == "key [SECRET] then token=abc and [SECRET] end [SECRET] x" and left[60].n_chars == len(left[60].text)
    assert left[50].text is None and out.count() == len(rows)
    assert all(left[i].text == t for i, t, *_ in rows if i is not None and i < 60 and i != 54)


def test_secret_plans_are_native(docs, monkeypatch):
    plans, last = stage_plans(monkeypatch, lambda: secrets.report(docs))
    assert len(plans) >= 2 and not any(re.search("Python|Pandas|Arrow", p) for p in [*plans, last])


# ---- 10 repeated windows


def cut(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        runs = []
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + length
                else:
                    runs.append([p, p + length])
        kept = b"".join(d[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(d)]))
        out.append((len(d), len(d) - len(kept), len(runs), sha(kept)))
    return out


def shared_words(texts, n=50):
    """Words of each text under windows of n words that start anywhere else."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[p : p + n]) for w in words for p in range(len(w) - n + 1))
    return [len({q for p in range(len(w) - n + 1) if seen[tuple(w[p : p + n])] > 1 for q in range(p, p + n)}) for w in words]


SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words")


def suffixes(ids, texts):
    return Counter((i, *c, n) for i, c, n in zip(ids, cut(texts, 400), shared_words(texts)))


def test_suffixes(spark, docs, clash, empty, rows):
    """Against brute force; tables of the work are gone at its end: a result folder stays, and no table in the catalog."""
    from pathlib import Path

    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {p.name for p in base.iterdir()} if base.exists() else set()
    want = suffixes([r[0] for r in rows], [r[1] for r in rows])
    for df in (docs, clash):
        assert got(suffix_dedup.report(df), *SUFFIX) == want
    assert suffix_dedup.report(empty).count() == 0
    assert {p.name.rpartition("-")[0] for p in base.iterdir() if p.name not in before} == {"suffix-cut"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("distinct_texts")]


def test_suffixes_common_passages(spark):
    """Passages a little under and over the windows' lengths in many contexts, inside one text too; runs of one byte and of short periods."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    under, over, long = word(390), word(405), word(1000)
    texts = [word(rng.randrange(0, 300)) + p + word(rng.randrange(0, 300)) for p in [under, over] * 25]
    texts += [long[:700] + word(5) + long[300:], long, long[10:] + over, word(450) * 2, under + under, over, over[:400], over[1:401], ("ab" * 300), "b" * 401, "b" * 400, "b" * 399]
    some = lambda n: " ".join(rng.choice("a bb ccc dd eee".split()) + str(rng.randrange(50)) for _ in range(n))
    passage = some(52)
    texts += [some(rng.randrange(5, 90)) + " " + passage + "\n" + some(rng.randrange(5, 90)) for _ in range(20)] + [" ".join(passage.split()[:n]) for n in (49, 50, 51)] + ["x " * 300, "x " * 50, "x y " * 40, "- " * 49]
    run = lambda unit, n: (unit * n)[:n]
    texts += [word(rng.randrange(500)) + run(word(rng.choice([1, 2, 3, 7, 50, 333])), rng.randrange(380, 1500)) + word(rng.randrange(500)) for _ in range(30)]
    texts += [run("-=", 401), run("=-", 400), run("-=", 399), run("z", 400) + "q", "p" + run("z", 405) + "r", run("z", 2000), run("abc", 900) + run("z", 700), word(50) + run("z", 400) + word(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(suffix_dedup.report(df), *SUFFIX) == suffixes(range(len(texts)), texts)


def test_runs_give_few_rows():
    """A megabyte of one byte, or of a short period, gives no more rows than random bytes; windows done and known cover the run."""
    n, roller = 1 << 20, suffix_dedup.Roller(suffix_dedup.BYTES)
    rows = {}
    for name, text in (("random", random.Random(13).randbytes(n)), ("one", b"a" * n), ("seven", (b"abcdefg" * n)[:n])):
        values = np.frombuffer(text, np.uint8)
        rows[name], done = suffix_dedup.without_periods(suffix_dedup.zones(values, roller), values, 400)
        assert [d for d in done if d[0] == 0 and d[1] >= n - 407] == done and len(done) == (name != "random")  # what is left of the last period goes on
    assert max(len(rows["one"]), len(rows["seven"])) <= 2 * len(rows["random"])


def test_zones_do_not_depend_on_pieces(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(20_000), np.uint8)
    whole = suffix_dedup.zones(data, suffix_dedup.Roller(suffix_dedup.BYTES)).tolist()
    assert whole[0][1] == 0 and whole[-1][2] == len(data) - 400 and all(x[2] + 1 == y[1] for x, y in zip(whole, whole[1:]))
    monkeypatch.setattr(suffix_dedup, "PIECE", 777)
    assert suffix_dedup.zones(data, suffix_dedup.Roller(suffix_dedup.BYTES)).tolist() == whole
