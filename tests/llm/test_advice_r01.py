"""What the first review found cut short."""

import random

import numpy as np

from acervo.llm import lm, overlap


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_near_copies_of_the_pipeline(spark, hard_docs):
    import corpus_pipeline as P

    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    texts, line = [], " ".join(word() for _ in range(12))
    for k in range(30):
        base = [word() for _ in range(rng.randint(8, 200))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [f"{line} {word()}" for _ in range(40)] + [f"{line} " + " ".join(word() for _ in range(30)) for _ in range(60)]
    crowd = [word() for _ in range(80)]
    for _ in range(60):  # a crowd whose members drift apart
        crowd[rng.randrange(80)] = word()
        texts.append(" ".join(crowd))
    texts += ["", "  ", None, "one two", "One two"]
    root = overlap.brute_force([t.encode() if t is not None else None for t in texts])
    assert len(set(root)) < len(texts) - 100
    got = {r.doc_id for r in P.drop_near_copies(spark, docs_of(spark, texts).repartition(5), "").collect()}
    assert got == set(root)
    # rows are told apart by their values, not their id
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (1, "a b c d e f"), (None, "u v w x y z")], "doc_id long, text string")
    assert sorted(r.text for r in P.drop_near_copies(spark, same, "").collect()) == ["a b c d e f", "u v w x y z"]
    assert overlap.keep_one(hard_docs).count() == 5 and overlap.keep_one(hard_docs.limit(0)).count() == 0


def test_lm_trains_on_whole_documents():
    vocabulary = {b"w%d" % i: i + 1 for i in range(50)}
    texts = [b" ".join(b"w%d" % (i * k % 60) for i in range(n)) for k, n in enumerate((0, 3, 64, 65, 300, 20_000, 700, 701))] + [None]
    taken = [lm.lessons(texts, vocabulary, turn, 3) for turn in range(3)]
    assert sum(len(x) for own in taken for x in own) == sum(len(lm.words(t)) + 1 for t in texts)
    assert sum((x == lm.STOP).sum() for own in taken for x in own) == len(texts)
    whole = {lm._symbols(lm.words(t), vocabulary).tobytes() for t in texts}
    assert {x.tobytes() for own in taken for x in own} == whole
    # all of a long document's windows are learned from
    assert lm.Model.fresh(1.0, 1.0, [1.0] * 58).train([np.full(5000, 7)], {}, 0.01) == 5000
