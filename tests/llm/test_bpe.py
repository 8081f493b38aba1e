import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftlake.llm.bpe import Bpe, bpe_decode, bpe_encode, default_vocabulary, op8_bpe, unpack_ids


@pytest.fixture(scope="module")
def pair():
    path = default_vocabulary()
    return Bpe(open(path).read()), Tokenizer.from_file(path)


def test_same_ids_as_the_library(pair):
    bpe, library = pair
    rng = random.Random(3)
    bits = ["the", " ", "  ", "<|endoftext|>", "'ll", "\n", "\n\n", "é", "日本", "x" * 400, "12", "\t", "\x85", " ", "\x00", "ĉ", "\U00018d00", "Ünß", ".,!"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    for text, packed in zip(texts, bpe.encode_all(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert bpe.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_every_letter(pair):
    bpe, library = pair
    letters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}" for c in letters[k : k + 64]) for k in range(0, len(letters), 64)]
    for packed, e in zip(bpe.encode_all(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(packed, "<u4").tolist() == e.ids


def test_query_and_corner_cases(spark, pair):
    _, library = pair
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, ""), (3, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op8_bpe(df).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert op8_bpe(df.limit(0)).count() == 0
    wide = bpe_encode(df.selectExpr("doc_id", "text", "1 AS extra"))
    assert wide.columns == ["doc_id", "text", "extra", "ids"]
    first = bpe_decode(wide).select("text", "decoded", unpack_ids().alias("u")).first()
    assert first.decoded == first.text and first.u == library.encode(first.text).ids
    with pytest.raises(ValueError):
        bpe_encode(df.withColumnRenamed("doc_id", "ids"))
