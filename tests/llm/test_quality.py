import random
import re
from collections import Counter

from siftlake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(windows)
    covered = {j for k, x in enumerate(windows) if n[x] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_base_statistics(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "é" * 9, "a b c d e a b c d e", "\x85 x y", "one\n\none\none \n" * 3, "w " * 5000]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "b", "c ", " ", "\n", "#", "日", "x y z ", "\x0b"]) for _ in range(rng.randint(0, 120))))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.statistics(df).select("doc_id", "stats.*").collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(texts[r.doc_id]), (texts[r.doc_id], got)


def corpus(rng, n=400):
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(40)]
        junk = k % 5 == 0
        rows.append((k, " ".join(w[:-2] + "%%" if junk else w for w in words), "x"))
        labels.append((k, 0 if junk else 1))
    return rows, labels


def test_rules_are_learned_and_take_effect(spark):
    rows, labels = corpus(random.Random(2))
    docs = spark.createDataFrame([*rows, (None, rows[1][1], "x"), (9999, None, "x")], "doc_id long, text string, stats string")
    marks = spark.createDataFrame([*labels, (3, None), (None, 0)], "doc_id long, quality int")
    rules = quality.learn(docs, marks)
    assert rules and any(quality.FEATURES[c.feature] == "symbol_share" for r in rules for c in r)
    kept = quality.keep(docs, rules)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [k for k in range(400) if k % 5] and None in ids
    out = quality.op1_quality_rules(docs, marks)
    assert {r.doc_id for r in out.where("kept").collect()} == set(ids)


def test_without_labels_the_base_decides(spark):
    rows, _ = corpus(random.Random(3), 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.learn(docs, none) == []
    assert quality.op1_quality_rules(docs, none).where("kept").count() == 20
    assert quality.op1_quality_rules(docs.limit(0), none).count() == 0
