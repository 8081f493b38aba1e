import random

from siftlake.llm.bpe import default_vocabulary
from siftlake.llm.wordpiece import Automaton, op3_token_counts, pieces


def greedy(word, initial, inside):
    at, n = 0, 0
    while at < len(word):
        of = inside if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in of), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(5)
    for _ in range(300):
        word = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5)))
        initial, inside = {word() for _ in range(rng.randint(0, 6))}, {word() for _ in range(rng.randint(0, 6))}
        a = Automaton(initial, inside)
        for _ in range(60):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            assert a.count(w) == greedy(w, initial, inside), (w, initial, inside)


def test_query_against_brute_force(spark):
    rows = [(1, "The quick, brown föx\n\njumps"), (1, "The quick, brown föx\n\njumps"), (2, None), (None, " \t "), (3, "a" * 5000 + " x 日本")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words")
    initial, inside = map(set, pieces(open(default_vocabulary()).read()))
    got = sorted(map(tuple, op3_token_counts(df).collect()), key=str)
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        want.append((i, len(words), sum(greedy(w, initial, inside) for w in words)))
    assert got == sorted(want, key=str)
    assert op3_token_counts(df.limit(0)).count() == 0
    assert pieces("un\n##able\n") == ([b"un"], [b"able"])
