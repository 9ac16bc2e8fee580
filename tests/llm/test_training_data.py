"""The training-data operators against brute force, and on hard inputs."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from acervo.llm import ann, decontam, html_text, licenses, lm, mixing, repeats, secrets, simhash, toxicity


def rows(df):
    return [tuple(r) for r in df.collect()]


def corpus(n=40, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 150))) for _ in range(n)]
    texts += [texts[0], texts[1] + " w1", texts[2][: len(texts[2]) // 2] + texts[3]]
    return texts


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_decontamination(spark, hard_docs):
    texts, bench = corpus(), [(1, " ".join(corpus()[5].split()[2:20])), (2, "w1"), (3, None), (4, "Never, seen words here at all in any one of these texts")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = rows(decontam.digest(decontam.decontaminate(docs_of(spark, texts), items)))
    want = decontam.brute_force(list(enumerate(texts)), bench)
    assert sorted(got) == sorted(want) and any(w[5] for w in want)
    blocks = rows(decontam.digest(decontam.decontaminate(docs_of(spark, texts), items, block_chars=40)))
    assert sorted(blocks) == sorted(want)
    near = decontam.decontaminate(docs_of(spark, ["w5 w6 x w7 w8 w9 w10 w11 w12 w13 w14"]), spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")], "item_id long, text string"), slop=1).first()
    assert (near["items"], near.near_items) == ([], ["1"])
    bent = ["w5 w6 w7 w8 w9 x w10 w11 w12 w13 w14 y", "w6 w5 w7 w8 w9 w10 w11 w12 w14 w13", "w0 w1 w5 w7", "w6 w7 w8 w9 w10 w11 w12", *corpus()[:20]]
    exam = [(1, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (2, corpus()[3]), (3, "w1 w5 w7")]
    for slop, missing in ((0, 0), (1, 0), (1, 2), (2, 1)):
        out = decontam.decontaminate(docs_of(spark, bent), spark.createDataFrame(exam, "item_id long, text string"), slop=slop, missing=missing).collect()
        assert [set(r.near_items) for r in sorted(out, key=lambda r: r.doc_id)] == decontam.brute_near(list(enumerate(bent)), exam, slop, missing)
    hard = decontam.digest(decontam.decontaminate(hard_docs, items))
    assert hard.count() == 8 and hard.filter("doc_id = 2").first().n_words == 0
    assert decontam.decontaminate(hard_docs.limit(0), items).count() == 0 and decontam.decontaminate(hard_docs, items.limit(0)).count() == 8


def test_secrets(spark, hard_docs):
    key = "password=hunter2xyz"
    assert [x[:3] for x in secrets.scan(f"ü {key}")] == [("assign", 2, 2 + len(key))]
    assert secrets.scan("secret: abc") == [] and secrets.scan("token = \"" + "a1" * 12 + '"')[1][0] == "hex"
    inner = base64.b64encode(gzip.compress(base64.b64encode(key.encode()))).decode()
    assert secrets.scan(f"x {inner} y") == [("assign", 2, 2 + len(inner), "base64/zip/base64")]
    assert secrets.scan("a p%61ssword%3Dabcdefgh b")[0][:3] == ("assign", 2, 23)
    assert secrets.scan("a \\u0070assword=hunter22 b")[0][:3] == ("assign", 2, 24)
    assert secrets.masked(f"a {key} b", "#") == "a # b" and secrets.masked(None, "#") is None
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    # escapes that are none leave the others alone
    assert secrets.scan("x=%FF&u=p%61ssword%3Dabcdefgh")[0][:3] == ("assign", 8, 29)
    assert secrets.scan("q=caf%E9&token%3Dabcdef12")[0][:3] == ("assign", 9, 25)
    assert secrets.scan("\\ud800 \\u0070assword=hunter22 b")[0][:3] == ("assign", 7, 29)
    assert secrets.scan("p%61ssword = hunter2xyz")[0][:3] == ("assign", 0, 23)
    # base64 of bytes that are no text, behind a path, and over lines
    assert secrets.scan(b64("\0" + key))[0][:3] == ("assign", 1, 27)
    assert [secrets.scan(f"{x}{b64(key)} more")[0][:3] for x in ("v/", "a/b", "-x/y")] == [("assign", n, n + 26) for n in (2, 3, 4)]
    zipped = b64(gzip.compress(("lorem " + key + str(list(range(300)))).encode()))
    lines = "\r\n  ".join(zipped[i : i + 76] for i in range(0, len(zipped), 76))
    assert secrets.scan(f"--\n{lines}\n--") == [("assign", 3, 3 + len(lines), "base64/zip")]
    assert secrets.scan("/path/to/" + zipped)[0][3] == "base64/zip"
    # a stream in percent escapes; a layer whose stream ends before other characters
    stream = "".join(f"%{x:02x}" for x in gzip.compress(b"token: abcdef12345"))
    assert secrets.scan(f"z={stream}\u20ac")[0] == ("assign", 2, 2 + len(stream), "url/zip")
    inside = "ééé " + key + " ü"
    assert secrets.scan(b64(inside))[0][:3] == ("assign", 7 * 4 // 3, (8 * (7 + len(key)) - 1) // 6 + 1)
    # an encoding of itself ends
    assert secrets.scan("%2541%2541" * 3) == []
    out = secrets.digest(secrets.find_secrets(hard_docs))
    assert out.count() == 8 and out.filter("doc_id = 2").first().base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.redact(hard_docs.limit(0)).count() == 0


def brute_prints(texts):
    out = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        n = min(3, len(w))
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), 42) for k in range(len(w) - n + 1)] if w else []
        out[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return out


def brute_components(prints):
    ids, parent = sorted(prints), {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, hard_docs):
    rng, texts = random.Random(5), corpus()
    long = " ".join(rng.choice(texts[0].split()) for _ in range(3000))
    texts += [long.replace(f" w{i} ", f" v{i} ", 1) for i in range(30)] + ["", "  "]
    prints = brute_prints(enumerate(texts))
    of = brute_components(prints)
    got = rows(simhash.digest(simhash.near_duplicates(docs_of(spark, texts))))
    assert {r[0]: (int(r[1], 16), r[2]) for r in got} == {i: (prints[i], of[i]) for i in prints}
    assert simhash.keep_one(docs_of(spark, texts)).count() == len(set(of.values()))
    hard = rows(simhash.near_duplicates(hard_docs).select("doc_id", "component_id"))
    assert len(hard) == 8 and (2, 2) in hard and (4, 2) in hard
    assert simhash.near_duplicates(hard_docs.limit(0)).count() == 0


def test_anchors_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63, 200, dtype=np.int64)
    row, anchor, home = simhash.anchors(x)
    own = dict(zip(row[home], anchor[home]))
    reach = {i: set(anchor[row == i]) for i in range(len(x))}
    for i, v in enumerate(x):
        for bits in ((), (3,), (3, 30), (50, 63), (1, 2)):
            y = v.view(np.uint64) if hasattr(v, "view") else np.uint64(v)
            for b in bits:
                y = y ^ np.uint64(1 << b)
            _, a, h = simhash.anchors(np.array([y]).view(np.int64))
            assert a[h][0] in reach[i] and own[i] in set(a)


def test_crowded_anchor():
    rng = np.random.default_rng(2)
    base = np.uint64(0x0123456789ABCDEF)
    flips = rng.integers(0, 64, (9000, 4))
    prints = np.unique(np.array([base ^ np.bitwise_xor.reduce(np.array([np.uint64(1 << int(b)) for b in f[: 1 + k % 4]], np.uint64)) for k, f in enumerate(flips)], np.uint64))
    home = np.ones(len(prints), bool)
    fast = simhash._crowd(prints.view(np.int64), home, 2)
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2)
    slow = simhash._forest(len(prints), i, j)
    assert len(prints) > 2 * 2080 and (fast[0] == slow[0]).all() and (fast[1] == slow[1]).all()


def test_repeats(spark, hard_docs):
    rng = random.Random(3)
    for trial in range(3):
        size, letters = (40, 60, 100)[trial], (b"ab", b"abcdefgh", b"abcdefgh")[trial]
        pool = [bytes(rng.choice(letters) for _ in range(rng.randint(20, 300))) for _ in range(8)] + [b"a" * 200]
        texts = [b"".join(rng.choice(pool) for _ in range(rng.randint(0, 5))).decode() for _ in range(25)]
        texts = [t[:9] + "z" + t[10:] if k % 3 == 0 else t for k, t in enumerate(texts)]
        df = docs_of(spark, texts).repartition(3)
        for short in (None, size // 2):
            got = {r.doc_id: r for r in repeats.repeated_spans(df, size=size, short=short).collect()}
            for name, n in (("spans", size), ("short_spans", short)):
                want = repeats.brute_force([t.encode() for t in texts], n) if n else []
                assert all([tuple(s) for s in got[i][name]] == w for i, w in enumerate(want))
    found = repeats.repeated_spans(hard_docs)
    assert found.columns == [*hard_docs.columns, "spans_"] and found.filter("spans = 's'").count() == 8
    out = repeats.digest(repeats.strip(repeats.repeated_spans(hard_docs.drop("spans"))))
    assert out.count() == 8 and {r.n_removed for r in out.filter("doc_id = 5").collect()} == {60_000}
    assert repeats.repeated_spans(hard_docs.drop("spans").limit(0)).count() == 0


def window_hashes(text: bytes, size: int) -> np.ndarray:
    """A 64-bit polynomial hash of every window, by prefix sums of powers."""
    base, n = 0x9E3779B97F4A7C15, len(text)
    up, down = (np.cumprod(np.full(n, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * up)])
    return (sums[size:] - sums[:-size]) * down[: n - size + 1] if n >= size else np.zeros(0, np.uint64)


def test_repeats_of_whole_documents(spark, monkeypatch):
    """The driver's documents, against hashes of every window; short runs, so that many meet in a merge."""
    monkeypatch.setattr(repeats, "RUN_BYTES", 200_000)
    monkeypatch.setattr(repeats, "TOGETHER", 500)
    monkeypatch.setattr(repeats, "BLOCK", 64)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(5)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = {r.doc_id: r for r in repeats.digest(repeats.strip(repeats.repeated_spans(docs, short=repeats.SHORT, part_bytes=100_000))).collect()}
    covered = {}
    for size in (repeats.SIZE, repeats.SHORT):
        hashes = {i: window_hashes(t, size) for i, t in texts.items()}
        kinds, count = np.unique(np.concatenate(list(hashes.values())), return_counts=True)
        for doc, h in hashes.items():
            edge = np.zeros(len(texts[doc]) + 1, int)
            for i in np.flatnonzero(count[np.searchsorted(kinds, h)] > 1) if len(h) else ():
                edge[i] += 1
                edge[i + size] -= 1
            covered[doc, size] = np.cumsum(edge)[:-1] > 0
    removed = 0
    for doc, t in texts.items():
        r, gone = got[doc], covered[doc, repeats.SIZE]
        removed += int(gone.sum())
        assert r.n_repeated == covered[doc, repeats.SHORT].sum()
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), gone.sum(), int((np.diff(gone.astype(int), prepend=0) == 1).sum()))
        assert r.kept_sha256 == hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()
    assert len(got) == len(texts) and removed > 100_000


def test_merge_uses_known_prefixes():
    rng = random.Random(9)
    items = sorted({bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(200)})
    runs = [repeats.Run(repeats.encode_run([(x, b"", 0, 0, i, False) for i, x in enumerate(items) if i % 7 == k])) for k in range(7)]
    seen, before = [], b""
    for run, shared in repeats.merged(runs):
        assert shared == repeats.common(before, run.right, 0)
        before = run.right
        seen.append(before)
    assert seen == items


@pytest.mark.parametrize("functions", [None, 2])
def test_ann(spark, functions):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16))
    data = [(i, [float(v) for v in x[i]]) for i in range(600)]
    data += [(600 + i, data[7][1]) for i in range(30)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, []), (704, [1.0, None] + [0.0] * 14), (None, data[1][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id % 50 = 0 or vec_id > 690"), k=10, functions=functions).collect()
    good = {i: np.array(v) for i, v in data if i is not None and i < 700}
    by, hit, total = {}, 0, 0
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in good if i % 50 == 0}
    for q, found in by.items():
        d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        hit += len({i for _, i in d} & {r.vec_id for r in found})
        total += 10
        assert [r.rank for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, 11))
        assert all(abs(r.score - np.sqrt(((good[q] - good[r.vec_id]) ** 2).sum())) < 1e-12 for r in found)
    assert hit / total >= 0.9
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e200, 0.0]), (100, [1e200, 3e200]), (200, [-1e200, 1e180])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id): r.score for r in ann.search(huge, huge.filter("vec_id = 0"), functions=1).collect()} == pytest.approx({(0, 200): 2e200, (0, 100): 3e200})


def test_licenses(spark, hard_docs):
    text = "Intro. Licensed under the Apache License, Version 2.0.\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    got = licenses.scan(spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")).select("doc_id", "licences").collect()
    assert {r.doc_id: r.licences for r in got} == {1: ["Apache-2.0", "BSD-1-Clause"], 2: []}
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer.\n"
    gpl = "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version."
    marked = lambda mark, t: "".join(f"{mark}{x}\n" for x in t.split("\n"))
    both = "Licensed under CC BY 4.0. Released under CC0 1.0"
    cases = {mit: "MIT", "MIT License\n\n" + mit: "MIT", "A heading\n" + mit: "MIT", marked("# ", mit): "MIT", marked(" * ", bsd): "BSD-1-Clause", marked("// ", gpl): "GPL-2.0-or-later", mit.replace("\n", "\r\n"): "MIT", both: "CC-BY-4.0,CC0-1.0"}
    got = licenses.digest(licenses.scan(docs_of(spark, list(cases)))).collect()
    assert {list(cases)[r.doc_id]: r.licences for r in got} == cases
    assert all(any(h in s for h in licenses.HINTS) for known in licenses.SENTENCES.values() for s in known)
    assert licenses.digest(licenses.scan(hard_docs)).count() == 8


def test_mixing(spark, hard_docs):
    texts = [(i, "word " * (1 + i % 7), f"s{i % 3 if i % 2 else 0}") for i in range(600)] + [(600, None, None), (601, "lone text", None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    out = mixing.mix(df, {"s0": 3.0, "s1": 1.0}, default_weight=1.0)
    got = Counter()
    for r in out.collect():
        got[r.source] += len(r.text or "")
    total = sum(len(t or "") for _, t, _ in texts)
    for s, w in (("s0", 3), ("s1", 1), ("s2", 1)):
        assert abs(got[s] / total - w / 6) < 0.05
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys)
    # large rates are sums of small ones; no row's copies are held together
    few = spark.createDataFrame([(1, "abc", "s"), (2, "x" * 1000, "t"), (3, None, "t")], "doc_id long, text string, source string").withColumns({"copy": F.lit("c"), "part": F.lit(1)})
    for volume in (1e4, 1e6):
        many = mixing.mix(few, volume=volume)
        assert many.columns == [*few.columns, "copy_", "shuffle_key"]
        n = {r.doc_id: (r.n, r.d) for r in many.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy_").alias("d")).collect()}
        assert n[1][0] == n[1][1] and abs(n[1][0] - volume / 6) < 6 * math.sqrt(volume / 6)
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(2.5)).alias("c")).first().c
    assert all(abs(c - sum(math.exp(-2.5) * 2.5**j / math.factorial(j) for j in range(k + 1))) < 1e-12 for k, c in enumerate(cdf))
    assert mixing.mix(hard_docs).count() >= 1 and mixing.mix(hard_docs.limit(0)).count() == 0


def test_html(spark):
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a href='/'>Home page</a></li></ul></nav><article><h1>Head &amp; tail</h1><p>First <b>bold</b>  line.<br>Second line of the text.<p>Third, {k}.</article><footer>&copy; me</footer></body></html>"
    pages = spark.createDataFrame([(k, "u", page.replace("{k}", "word " * k)) for k in range(1, 40)] + [(90, "u", None), (91, None, ""), (92, "u", "plain text"), (93, "u", "<p>cut <b")], "page_id long, url string, html string")
    model = html_text.train(pages)
    got = {r.page_id: r for r in html_text.digest(html_text.extract(pages, model)).collect()}
    assert got[3].text == "Head & tail First bold line. Second line of the text. Third, word word word ."
    assert got[90].text == got[91].text == "" and got[90].n_chars == 0 and len(got) == 43
    assert html_text.train(pages.limit(0)) is None and html_text.extract(pages.limit(0), None).count() == 0


def test_lm(spark, hard_docs):
    texts = [" ".join(("the cat sat" if i % 2 else "le chat dort").split() * (2 + i % 9)) for i in range(120)]
    df = docs_of(spark, texts + [None])
    got = {r.doc_id: r for r in lm.score(df).collect()}
    count = Counter()
    for i, t in enumerate([*texts, ""]):
        if zlib.crc32(str(i).encode()) % 10:
            count.update(t.split())
            count["\n"] += 1
    n, v = sum(count.values()), len(count)
    for i, t in enumerate([*texts, ""]):
        w = [*t.split(), "\n"]
        assert got[i].base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
    held = [r for r in got.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(hard_docs).count() == 8 and lm.score(hard_docs.limit(0)).count() == 0


def test_lm_is_a_distribution_and_its_gradient():
    model = lm.Model.fresh(3.0, 5.0, list(np.linspace(2, 1, 300)))
    table, state = model.p["embed"] @ model.p["in"], np.zeros((1, lm.HIDDEN), np.float32)
    model.last = np.array([lm.STOP])
    states, _, _ = model.walk(np.array([[7]]), np.array([[True]]), state, table)
    every = np.arange(lm.CLASSES * lm.PER_CLASS)
    every = every[every <= lm.RARE]  # the last class has one symbol
    logp, _ = model.outputs(np.repeat(states[0], len(every), 0), every)
    assert np.exp(logp.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    doc = [np.array([5, 9, 30, 5, lm.STOP])]
    before = model.score(doc)[0]
    optimizer = {}
    for _ in range(30):
        model.train(doc, optimizer, 0.01)
    assert model.score(doc)[0] > before + 1
    assert model.score(doc * 3, lanes=2) == pytest.approx(model.score(doc)[[0, 0, 0]], rel=1e-4)


def test_lm_gradient_by_differences():
    model = lm.Model.fresh(3.0, 5.0, list(np.linspace(2, 1, 300)))
    tokens, fresh = np.array([[5, 9], [30, lm.STOP], [lm.RARE, 7], [lm.STOP, 80]]), np.array([[True, True], [False, False], [False, True], [False, False]])

    def loss(flat, g=None):
        m = lm.Model(flat)
        m.last = np.full(2, lm.STOP)
        states, _, (before, memory) = m.walk(tokens, fresh, np.zeros((2, lm.HIDDEN)), m.p["embed"] @ m.p["in"], True)
        logp, back = m.outputs(states.reshape(-1, lm.HIDDEN).astype(flat.dtype), tokens.ravel(), g)
        if g is not None:
            m._back(back.reshape(*tokens.shape, lm.HIDDEN), fresh, before, memory, g)
        return -logp.sum()

    flat = model.flat.astype(np.float64)
    grad = np.zeros_like(flat)
    loss(flat, lm.Model.named(grad))
    # the largest entries of every part
    checked = [int(i) for name, at in lm.Model.named(np.arange(len(flat))).items() for i in at.ravel()[np.argsort(-np.abs(lm.Model.named(grad)[name]), axis=None)[:6]]]
    for i in checked:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(grad[i], rel=0.02, abs=2e-3)


def test_toxicity(spark, hard_docs):
    rng = random.Random(8)
    plain = lambda: [rng.choice(["house", "river", "stone", "light", "green", "paper", "morning", "water"]) + rng.choice("aeiou") for _ in range(60)]
    texts = []
    for i in range(400):
        w = plain()
        for _ in range(4 if i % 4 == 0 else 0):
            w[rng.randrange(60)] = rng.choice(["wretched", "despicable", "loathsome"])
        texts.append(" ".join(w))
    df = docs_of(spark, texts)
    labels = df.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic"))
    out = toxicity.digest(df, toxicity.train(df, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    tested = [r for r in out if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in tested) / len(tested) > 0.95
    none = toxicity.train(df, labels.limit(0))
    assert {r.score for r in toxicity.digest(hard_docs.drop("score"), none).collect()} == {0.0}
    assert toxicity.score(hard_docs.drop("score").limit(0), none).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l", "en", "s", 1), (2, "a b c d e f g h i j k l", "en", "s", 1), (3, "keep password=hunter2xyz end", "en", "t", 1), (4, "one two three four five six seven eight nine ten eleven", "en", "t", 1), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, d = docs, str(tmp_path)
    for name, stage in P.STAGES[:-1]:
        at = stage(spark, at, d)
        assert at.columns == docs.columns, name
    assert {(r.doc_id, r.text) for r in at.collect()} == {(1, "a b c d e f g h i j k l"), (3, "keep [secret] end"), (None, None)}
    assert set(P.run(spark, d).columns) == {*docs.columns, "copy", "shuffle_key"}


def test_pipeline_removes_rows_by_their_values(spark, tmp_path):
    import corpus_pipeline as P

    leak = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, leak + " more"), (1, "a clean row with the same id"), (None, "x " + leak), (None, "clean without an id"), (2, None)], "doc_id long, text string")
    spark.createDataFrame([(9, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.drop_contaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and {r.text for r in got.collect()} == {"a clean row with the same id", "clean without an id", None}


def test_long_pages_are_labelled_in_small_batches(spark):
    sizes = [0, 3, 20_000, *[5] * 100, 50_000]
    cut = list(html_text.batches_of(sizes))
    assert sorted(i for own in cut for i in own) == [i for i, n in enumerate(sizes) if n]
    assert all(len(own) * max(sizes[i] for i in own) <= html_text.CELLS for own in cut if len(own) > 1)
    long = "<article>" + "".join(f"<p>Sentence number {i} of the text.</p>" for i in range(3000)) + "</article><footer>end</footer>"
    pages = spark.createDataFrame([(1, long), (2, "<nav>menu</nav><article><p>Short text here.</p></article>")], "page_id long, html string").withColumn("text", F.lit("t"))
    out = html_text.extract(pages, html_text.train(pages))
    assert out.columns == ["page_id", "html", "text", "text_"]
    assert {r.page_id: r.text_.count("Sentence number") for r in out.collect()} == {1: 3000, 2: 0}


def test_ann_recall_on_the_embeddings(spark):
    """Two functions a table, on the driver's vectors: those of the nearest ten that are found."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in ann.search(df, df.filter("vec_id % 100 = 0"), functions=2).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows_ = df.collect()
    ids, x = np.array([r.vec_id for r in rows_]), np.array([r.embedding for r in rows_], float)
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(got[ids[q]] & set(ids[np.argsort(d, kind="stable")[:10]].tolist()))
        total += 10
    assert hit / total >= 0.9
