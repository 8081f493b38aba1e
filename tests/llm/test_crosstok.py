"""Cross-tokenizer alignment against whole texts encoded by both libraries and counted pair by pair."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siftlake.llm import crosstok
from siftlake.llm.bpe import byte_letters


@pytest.fixture(scope="module")
def tools():
    content = open(crosstok.default_a(), encoding="utf-8").read()
    a = Tokenizer.from_str(content)
    a.encode_special_tokens = True
    letters = byte_letters()
    names = {i: bytes(letters[c] for c in t) for t, i in json.loads(content)["model"]["vocab"].items()}
    return a, names, sentencepiece.SentencePieceProcessor(model_file=crosstok.default_b())


def brute(tools, texts):
    a, names, b = tools
    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        y_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        x_bytes = [names[i] for i in x]
        if not text or b"".join(x_bytes) != whole or b"".join(y_bytes) != whole:
            docs.append(None)
            continue
        ends = [set(np.cumsum([len(p) for p in parts]).tolist()) for parts in (x_bytes, y_bytes)]
        cuts = sorted(ends[0] & ends[1])
        groups, i, j, at_x, at_y = [], 0, 0, 0, 0
        for c in cuts:
            own = ([], [])
            while at_x < c:
                own[0].append(x[i])
                at_x, i = at_x + len(x_bytes[i]), i + 1
            while at_y < c:
                own[1].append(y[j])
                at_y, j = at_y + len(y_bytes[j]), j + 1
            groups.append(own)
        docs.append((len(x), len(y), groups, Counter((p, q) for g in groups for p in g[0] for q in g[1])))
    count, best = Counter(), defaultdict(int)
    for d in docs:
        count.update(d[3].keys() if d else ())
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        best_links = sum(n for pair, n in links.items() if count[pair] == best[pair[0]])
        out.append((n_a, n_b, len(groups), sum(links.values()), best_links, sum(n * count[pair] for pair, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def corpus():
    rng = random.Random(4)
    bits = ["the", "there", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", ";\r", "\r", " ", "　", " ", "\x1c", "\x85", "é", "日本語", "🙂👍", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "<|startoftext|>", "'ll", "don't", "1234", ".,!", "x" * 90, "​", "é", "Ünß", "ﬁ", "ø", "İ", "\x00", "\x7f", "﻿"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    words = ["".join(rng.choice("theaionrs") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(80)]
    texts += ["", None, " ", "   ", "\n", " a ", "a▁b", "▁", "a\t", "a \t b", "\na", "a;\r", "repeat me", "repeat me", " ".join(rng.choice(words) for _ in range(70_000)), "ab" * 40_000]
    return texts


@pytest.mark.parametrize("target, packed, slice_docs", [(crosstok.TARGET, crosstok.PACKED, crosstok.SLICE_DOCS), (40, 3000, 7)])
def test_documents_equal_whole_encodings(spark, monkeypatch, tools, target, packed, slice_docs):
    monkeypatch.setattr(crosstok, "PACKED", packed)
    monkeypatch.setattr(crosstok, "SLICE_DOCS", slice_docs)
    texts = corpus()
    want = brute(tools, texts)
    rows = [(None if k % 50 == 3 else k // 2, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS a", "2 AS row", "3 AS n", "4 AS digest").repartition(4)
    got = crosstok.cross_align(df, target=target).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=str)


def test_counts_of_pairs(spark, tools):
    texts = ["the cat", "the the dog", None, "a cat"]
    posted = crosstok.postings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    a, _, b = tools
    the = (a.encode(" the").ids[0], b.encode("the")[0])
    cat = (a.encode(" cat").ids[0], b.encode("cat")[0])
    found = {(r.a, r.b): r.n for r in crosstok.pair_counts(posted).collect()}
    assert found[the] == 2 and found[cat] == 2


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string").limit(0)
    got = crosstok.op12_cross_tokenizer(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.collect() == []


def test_packing_keeps_large_multiplicities():
    doc, key, n = np.array([0, 3, 3]), np.array([5 << 32 | 7, 5 << 32 | 7, 6 << 32 | 1]), np.array([1, 200_000, 65_535])
    a, data = crosstok.pack(doc, key, n)
    records, sizes = crosstok.unpack(data)
    assert a.tolist() == [5, 6] and sizes.tolist() == [5, 1]
    assert records["n"].astype(int).sum() == n.sum()
    assert (records["b"] < crosstok.MORE).sum() == 3 and records["doc"].tolist() == [0, 3, 3, 3, 3, 3]
