import random
import unicodedata

from siftlake.llm import decontaminate as D


def test_matches_against_all_alignments(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6)))
    items = [[word() for _ in range(rng.randint(8, 40))] for _ in range(12)] + [["too", "short"]]
    rows = [(0, None), (1, ""), (2, "too short")]
    for k in range(60):
        text = [word() for _ in range(rng.randint(0, 150))]
        if k % 2:
            own = list(items[rng.randrange(12)])
            for _ in range(rng.randint(0, max(1, len(own) // 6))):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], [word()], [own[at], word()]])
            at = rng.randint(0, len(text))
            text[at:at] = own
        rows.append((10 + k, rng.choice([" ", "\n", ", "]).join(text).title() if k % 3 else " ".join(text)))
    rows += [rows[8], (None, " ".join(items[0])), (300, "pad " * 20_000 + " ".join(items[1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'q' AS score")
    bench = spark.createDataFrame([*((k, " ".join(w)) for k, w in enumerate(items)), (77, None), (None, "a b c d")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.op10_decontamination(docs, bench).collect()}
    want = {}
    for i, t in rows:
        for k, w in enumerate(items):
            if len(w) > 2:
                best, _ = D.align(D.word_sequence(" ".join(w)), D.word_sequence(t))
                if best / (2 * len(w)) >= D.LEAST_SCORE:
                    want[i, k] = round(best / (2 * len(w)), 6)
    assert got == want and len(want) > 25
    left = D.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in rows if i not in {a for a, _ in want})
    assert D.op10_decontamination(docs.limit(0), bench).count() == 0 and D.clean(docs, bench.limit(0)).count() == len(rows)


def test_case_and_composition(spark):
    item = "doesbo dora el ñ es árbol ueciónez no ññci straße él"
    rows = [(0, item.upper()), (1, unicodedata.normalize("NFD", item).title()), (2, f"x {item.upper()} y"), (3, item.replace("ñ", "n")), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for text in (item, unicodedata.normalize("NFD", item.upper())):
        bench = spark.createDataFrame([(7, text)], "item_id long, text string")
        got = {r.doc_id: r.score for r in D.op10_decontamination(docs, bench).collect()}
        assert {k: v for k, v in got.items() if v == 1} == {0: 1, 1: 1, 2: 1}
        assert [r.doc_id for r in D.clean(docs, bench).where("doc_id <> 3").collect()] == [4]


def test_alignment():
    seq = lambda s: D.word_sequence(s)
    assert D.align(seq("a b c d"), seq("x a b q c d y")) == (2 * 4 - 1, 6)
    assert D.align(seq("a b"), seq("")) == (0, 0)


def test_edited_copies_against_all_alignments(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 4)))
    items = [[word() for _ in range(n)] for n in (3, 4, 5, 6, 17, 24, 30, 40)]
    rows = []
    for k in range(240):
        own = []
        for w in items[k % 8]:
            edit = rng.random() < rng.choice([0.2, 0.25, 0.3])
            own += rng.choice([[], [word()], [w, word()]]) if edit else [w]
        text = [word() for _ in range(20)] + own + [word() for _ in range(20)]
        rows += [(len(rows) + c, " ".join(text)) for c in range(10 if k % 20 == 0 else 1)]
    # No three words, or no two, stay side by side; outer words of three.
    spread = lambda w, n: " ".join(x + " q" * (i % n == n - 1) for i, x in enumerate(w))
    rows += [(10_000 + i, spread(w, n)) for n in (1, 2) for i, w in enumerate(items)]
    rows += [(20_000, " ".join("q" if i % 3 == 2 else x for i, x in enumerate(items[4]))), (20_001, f"{items[0][0]} q {items[0][2]}"), (20_002, f"{items[0][0]} {items[0][2]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.op10_decontamination(docs, bench).collect()}
    want = {}
    for i, t in rows:
        for k, w in enumerate(items):
            share = D.align(D.word_sequence(" ".join(w)), D.word_sequence(t))[0] / (2 * len(w))
            if share >= D.LEAST_SCORE:
                want[i, k] = max(want.get((i, k), 0), round(share, 6))
    assert got == want and len(want) > 150
