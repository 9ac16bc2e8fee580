"""Spelling variants, chat formatting and word runs against brute force; hard inputs of these, of secrets and of pages."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from acervo.llm import chat, html_text, runs, secrets, variants

TURNS = "conv_id long, turn long, role string, text string"


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def spelled(seed, alphabet, n, lengths):
    rng, out = random.Random(seed), {}
    while len(out) < n:
        word = "".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths)))
        for _ in range(rng.randint(1, 3)):
            out[word] = rng.choice([5, 6, 30, 40, 200, 1000])
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + rng.choice(alphabet) + word[at + 1 :], word[:at] + word[at + 1 :] + "", word[:at] + rng.choice(alphabet) + word[at:]])
    return out


@pytest.mark.parametrize("alphabet, lengths", [("ab", (6, 9)), ("aeéÉiïy", (6, 8)), ("abcdefghijklmnop", (6, 30))])
def test_variants_equal_brute_force(spark, alphabet, lengths):
    counts = spelled(3, alphabet, 250, lengths)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = sorted(map(repr, variants.brute_force(counts)))
    assert rows(variants.group(words)) == want and any("None" not in w for w in want)


def test_variants_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 7)  # blocks of many pieces, batches that cut them
    counts = spelled(4, "abc", 300, (6, 8)) | {"a" * 3000: 9, "a" * 2999: 50, "b" + "a" * 2999: 5}
    assert rows(variants.group(spark.createDataFrame(list(counts.items()), "word string, n long"))) == sorted(map(repr, variants.brute_force(counts)))


def test_vocabulary_and_its_slips(spark, hard_docs):
    texts = ["Straße Naïve naïve NAÏVE abcdefg.abcdefg abcde fünfzig×7 " * 3, "abcdefg ABCDEFG abcdef1 " * 40, None, ""]
    docs = spark.createDataFrame([*((i, texts[i % 4]) for i in range(200)), (None, texts[0])], "doc_id long, text string")
    want = Counter()
    for i, text in [*((i, texts[i % 4]) for i in range(200)), (None, texts[0])]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(variants.UPPER, variants.LOWER))
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert dict(map(tuple, variants.vocabulary(docs, change=variants.deleted).collect())) == want
    hard = variants.vocabulary(hard_docs, min_count=1)
    assert [tuple(r) for r in hard.collect()] == [("é" * 50, 1)] and rows(variants.group(hard)) == [repr(("é" * 50, None, "é" * 50, 1, 0, None))]
    assert variants.group(hard.limit(0)).count() == 0


def told(turns):
    """The digest of one conversation from its turns in order."""
    turns = sorted(((t, r or "", x or "") for t, r, x in turns), key=lambda a: (a[0] is not None, a))
    said = "".join(x for _, r, x in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_chat_reads_back_what_it_wrote(spark):
    bad = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST] <s<s>", "", None, "é😀 [/INST] <s", "[INST", "\\", " [/INST] "]
    rng = random.Random(5)
    given = [(c, t, rng.choice(["user", "assistant", "system", None, " [/INST] x"]), rng.choice(bad)) for c in (1, 2, 3, None) for t in range(rng.randint(1, 9))]
    given += [(4, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(1200)]  # several blocks
    given += [(5, 0, "user", "a"), (5, 0, "user", "a"), (5, None, "assistant", "b"), (5, 0, "assistant", "a"), (6, 1, "user", "alone")]
    made = chat.format_chats(spark.createDataFrame(given, TURNS).withColumns({"start": F.lit("x"), "piece": F.lit(1)}))
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    assert set(got) == {g[0] for g in given}
    for conv, r in got.items():
        assert tuple(r)[1:5] == told([g[1:] for g in given if g[0] == conv])
    whole = chat.texts(made.filter("conv_id IS NULL OR conv_id <> 4")).collect()
    for conv in {r.conv_id for r in whole}:
        own = sorted((r for r in whole if r.conv_id == conv), key=lambda r: r.example)
        assert got[conv].formatted_chars == sum(len(r.text) for r in own) and [r.example for r in own] == list(range(1, len(own) + 1))
        assert all(b.text.startswith(a.text) for a, b in zip(own, own[1:], strict=False))
        assert all(r.text[r.mask_end :] == "</s>" for r in own if r.mask_end is not None)
        assert [r.mask_start for r in own].count(None) <= 1
    assert chat.digest(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


def test_chat_escapes_are_bijective():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "x", "</s>", "[INST]"]) for _ in range(rng.randint(0, 9)))
        inside = re.sub(chat.CONTROL, r"\1\\\2", text)
        assert not re.search(r"</?s>|\[/?INST\]", inside) and re.sub(chat.ESCAPED, r"\1\2", inside) == text


@pytest.mark.parametrize("least", [1, 4, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    docs = []
    for _ in range(400):
        n, letters = rng.randint(0, 70), "abcde"[: rng.choice([1, 2, 3, 5])]
        words = [rng.choice(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        docs.append(words)
    for words, (n, found, rest) in zip(docs, runs.of_texts([" ".join(w) for w in docs], least), strict=True):
        want = runs.brute_force(words, least)
        gone = {i for s, size, q in want for i in range(s + q, s + size)}
        assert (n, found, rest) == (len(words), want, " ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_in_small_batches_and_of_long_texts(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 3)
    texts = ["a b " * 20, "x " * 30 + "y", "c d e " * 9]
    assert [x[1] for x in runs.of_texts(texts)] == [[(0, 40, 2)], [(0, 30, 1)], [(0, 27, 3)]]
    monkeypatch.setattr(runs, "PAIRS", 1 << 20)
    monkeypatch.setattr(runs, "BATCH_WORDS", 10)
    assert [x[1] for x in runs.of_texts([*texts, None, ""])] == [[(0, 40, 2)], [(0, 30, 1)], [(0, 27, 3)], [], []]
    assert next(runs.of_texts(["a " * 100_000]))[1:] == ([(0, 100_000, 1)], "a")


def test_runs_of_documents(spark, hard_docs):
    texts = {i: " ".join(f"w{i}x{k}" for k in range(40 + i)) for i in range(60)}
    bent = {r.doc_id: r.text for r in runs.with_periods(spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"h": F.lit(1), "W": F.lit(2)})).collect()}
    for i, text in texts.items():
        words, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert bent[i] == " ".join(words)
    found = runs.find_runs(hard_docs.withColumn("runs", F.lit("r")))
    assert found.columns[-3:] == ["n_words", "runs_", "collapsed"]
    out = {r.doc_id: r for r in runs.digest(runs.find_runs(hard_docs)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(out[2])[1:] == (0, None, None, None, None, empty, empty)
    assert tuple(out[5])[1:6] == (1, 0, 30_000, 1, 30_000_000) and out[5].collapsed_sha256 == hashlib.sha256(b"w").hexdigest()
    assert runs.digest(runs.find_runs(runs.with_periods(hard_docs))).count() == 8 and runs.find_runs(hard_docs.limit(0)).count() == 0


def test_secrets_in_many_layers(spark):
    deep = "%" + "25" * 1500 + "70assword=abcdefghij"
    found = secrets.scan(deep)
    assert ("assign", 0, len(deep)) in [x[:3] for x in found] and max(len(x[3]) for x in found) <= secrets.PATH + 4
    five = secrets.scan("%" + "25" * 5000 + "70assword=abcdefghij")
    assert five[0][:3] == ("assign", 0, 10_021)
    out = secrets.digest(secrets.find_secrets(spark.createDataFrame([(1, deep)], "doc_id long, text string"))).first()
    assert "assign:0:3021" in out.spans and secrets.masked(deep, "#") == "#"


def test_secrets_in_long_runs_and_streams(monkeypatch):
    began = time.process_time()
    assert secrets.scan("a\n" + "xy" * 1_000_000) == []
    assert time.process_time() - began < 10
    monkeypatch.setattr(secrets, "WINDOW", 4096)
    monkeypatch.setattr(secrets, "OVERLAP", 1024)
    for at in (0, 4000, 4090, 20_000, 65_530):
        text = "ü " * (at // 2) + " password=hunter2xyz " + "- " * 30_000
        packed = base64.b64encode(zlib.compress(text.encode())).decode()
        assert secrets.scan(packed) == [("assign", 0, len(packed.rstrip("=")), "base64/zip")] or secrets.scan(packed)[0][3] == "base64/zip"
    assert secrets.scan(base64.b64encode(zlib.compress(b"token=abcdefgh " * 9)[:-7]).decode()) == []


def test_pages_with_stray_quotes_and_open_tags():
    said = lambda page: [x[1] for x in html_text.blocks(page)]
    assert said("<p title=it's>first text</p><p>second text</p><p>it's third</p>") == ["first text", "second text", "it's third"]
    assert said('<a href="x"">one</a><p>two <b title="a>b">three</b></p>') == ["one", "two three"]
    assert said("<p>a<!-- gone") == ["a"] and said("<p>a <script>x") == ["a"] and said("<p>a</p>b <i") == ["a", "b <i"]
    began = time.process_time()
    assert len(html_text.blocks("<a b " * 400_000)) == 1 and len(html_text.blocks("<div>x" * 20_000)) == 20_000
    assert html_text.blocks("<div>" * 20_000 + "</x>" * 20_000 + "<!" * 20_000) == [] and len(html_text.blocks('<a b="' * 100_000)) == 1
    assert time.process_time() - began < 10
    path = html_text.blocks("<main><nav class='Top-bar'><p>x</p></nav></main>")[0][0]
    assert list(path) == ["main", "nav", "top", "bar", "p"] and html_text.hint(path) == 0
