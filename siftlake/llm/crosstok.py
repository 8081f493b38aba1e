"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over the corpus.

1. A text is cut before a space, or a line feed, that follows a letter of a word: no token of either vocabulary reaches
   over such a place (this is looked up in B's pieces; it follows from A's split pattern). Each distinct stretch is
   encoded by both libraries once, verified by its bytes, and cut into groups where tokens of both end; stretches are
   kept in a bounded cache. A text's tokens, groups and links are those of its stretches in order.
2. The pairs that a text holds linked, with their multiplicities, are its postings. They are packed by token of A and
   slice of documents, and written to the shared folder once, with the digest of each document.
3. Documents by pair are counted with a partial sum on the map side. Counts and postings are shuffled by token of A and
   sorted, counts first (Spark sorts and spills); a task reads the stream, keeps the counts of the token at hand, which
   the vocabulary of B bounds, takes their maximum, and passes the postings by. A token of A with more than TARGET
   postings is dealt by slices of documents into as many keys as it needs, each with all its counts.
4. What a task adds to a document is summed before it leaves the task, packed by blocks of documents, and then summed by
   document in a stream sorted by block.

The driver gathers the number of keys of the tokens of A that need several: at most one row for each entry of A.

Cases: null and empty texts, and texts whose joined token bytes differ from a space and the text (a literal U+2581), have
no tokens: zeros and an empty digest; rows are documents of their own, so repeated rows count twice; ties for the highest
count all count; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import textkernel as tk
from siftlake.llm.bpe import SPLIT, byte_letters
from siftlake.session import cut

#: Postings of one key of the shuffle, and of documents that a task packs together; documents of one slice.
TARGET = 250_000
PACKED = 400_000
SLICE_DOCS = 60_000
#: Stretches that a worker keeps, and their letters, checked before each slice.
CACHE = 600_000
CACHE_LETTERS = 20_000_000
#: Letters before this one are of the same kind in all tables of Unicode.
PLAIN = "\u0250"
#: Pairs of a group that are listed one by one.
MANY = 1 << 16
#: Numbers that a task holds before it sums them.
HELD = 1 << 21
#: A posting: token of B, place of the document in its slice, multiplicity. The highest bit of b marks that the
#: multiplicity goes on from the posting before.
POSTING = np.dtype([("b", "<u4"), ("doc", "<u2"), ("n", "<u2")])
MORE = np.uint32(1 << 31)
MOST = 65535

DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
DIGEST_FIELDS = DIGEST.replace(" long", ": long").replace(" string", ": string")
POSTED = f"row long, a int, data binary, digest struct<{DIGEST_FIELDS}>"
#: What a task adds to a document, and the documents that are summed together.
ADDED = np.dtype([("doc", "<u2"), ("n_best", "<i8"), ("count_sum", "<i8")])
BLOCK = 1 << 12


def default_a() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_b() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Grown:
    """An array that grows by appending."""

    def __init__(self, kind: type) -> None:
        self.data, self.size = np.zeros(1024, kind), 0

    def append(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(max(self.size, len(values)), self.data.dtype)])
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)

    def all(self) -> np.ndarray:
        return self.data[: self.size]


class Stretches:
    """Distinct stretches of text in both vocabularies, by number.

    Of each: (n_a, n_b, n_groups, n_links, whether its bytes don't fit), its groups as text, and its linked pairs
    (a << 32 | b) with multiplicities.
    """

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.letters = 0
        self.groups: list[bytes] = []
        self.sums, self.first, self.keys, self.times = Grown(np.int64), Grown(np.int64), Grown(np.int64), Grown(np.int64)
        self.first.append(np.zeros(1, np.int64))


class Aligner:
    """Both vocabularies, made from the contents of their files."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters.get(c, 0) for c in token) for token, i in json.loads(a_json)["model"]["vocab"].items()}
        self.quick = _quick(a_json, self.a_bytes)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, piece in self.a_bytes.items():
            self.a_sizes[i] = len(piece)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)
        # An id as text, with what may follow it in a group.
        self.ids = max(len(self.a_sizes), len(pieces))
        self.names = [f"{i}{end}".encode() for end in (",", "|", ";", "") for i in range(self.ids)]
        self.alone = self.b.piece_to_id("▁")
        # Spaces and line feeds are places to cut if no piece has one after a letter of a word.
        spans = lambda c: any(q == c and p != c for piece in pieces for p, q in zip(piece, piece[1:]))
        cuts = ("" if spans("▁") else " ") + ("" if any("\n" in p[1:] for p in pieces) else "\n")
        # A stretch: white space, letters, and what follows up to white space that starts with a place to cut.
        self.split = re.compile(rf"\s*\S+(?:[^\S{cuts}]\s*(?:\S+|\Z))*|\s+").findall if cuts else lambda text: [text]
        self.known = Stretches()

    def encode(self, stretches: list[str]) -> None:
        """Adds each stretch, as a part of a text, to what is known; the first of a text starts with the space that is put before it."""
        a = [self.quick(s) if max(s) < PLAIN else None for s in stretches] if self.quick else [None] * len(stretches)
        rest = [k for k, own in enumerate(a) if own is None]
        for k, e in zip(rest, self.a.encode_batch_fast([stretches[k] for k in rest], add_special_tokens=False)):
            a[k] = e.ids
        # B puts a space before what it encodes: it takes the place of a leading one, or is dropped.
        b = self.b.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        for k, s in enumerate(stretches):
            if s == " ":
                b[k] = [self.alone]
            elif s[0] != " ":
                b[k] = b[k][1:] if b[k][:1] == [self.alone] else [0]
        whole = [s.encode() for s in stretches]
        fits = self.fit(a, self.a_bytes, whole) & self.fit(b, self.b_bytes, whole)
        if not fits.all():
            a, b = ([own if fit else [] for own, fit in zip(side, fits.tolist())] for side in (a, b))
        self.add(a, b, fits)

    @staticmethod
    def fit(side: list[list[int]], names, whole: list[bytes]) -> np.ndarray:
        """Whether the tokens of each stretch have its bytes."""
        parts = [b"".join([names[i] for i in own]) for own in side]
        return np.array([x == y for x, y in zip(parts, whole)], bool)

    def add(self, a: list[list[int]], b: list[list[int]], fits: np.ndarray) -> None:
        n_a, n_b = (np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b))
        x, y = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
        # Both sides have the same bytes, so ends of tokens compare over all stretches; groups end where both end.
        end_x, end_y = np.cumsum(self.a_sizes[x]), np.cumsum(self.b_sizes[y])
        common = np.intersect1d(end_x, end_y, assume_unique=True)
        of_x, of_y = np.searchsorted(common, end_x), np.searchsorted(common, end_y)
        count = len(common)
        in_x, in_y = np.bincount(of_x, minlength=count), np.bincount(of_y, minlength=count)
        last = np.cumsum(n_a) - 1
        owner = np.searchsorted(np.concatenate([[0], end_x])[last + 1], common) if count else np.zeros(0, np.int64)
        links = in_x * in_y
        sums = np.stack([n_a, n_b, *(np.bincount(owner, w, len(a)).astype(np.int64) for w in (None, links)), ~fits], axis=1)
        known = self.known
        known.sums.append(sums.reshape(-1))
        known.groups += self.texts(x, y, of_x, of_y, n_a + n_b)
        key, own, times = self.pairs(x, y, of_x, in_x, in_y, owner, links > MANY)
        order = np.lexsort((key, own))
        key, own, times = key[order], own[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])) if len(key) else np.zeros(0, np.int64)
        known.first.append(known.keys.size + np.cumsum(np.bincount(own[new], minlength=len(a))))
        known.keys.append(key[new])
        known.times.append(np.add.reduceat(times, new) if len(new) else times)

    def texts(self, x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The groups of each stretch as text."""
        group, side = np.concatenate([of_x, of_y]), np.repeat([0, 1], [len(x), len(y)])
        order = np.lexsort((side, group))
        ids, group, side = np.concatenate([x, y])[order], group[order], side[order]
        ends = np.cumsum(sizes)
        follows = np.zeros(len(ids), np.int64)
        if len(ids):
            last = np.concatenate([(group[1:] != group[:-1]) | (side[1:] != side[:-1]), [True]])
            follows[last] = side[last] + 1
            follows[ends[sizes > 0] - 1] = 3
        names = self.names
        parts = [names[k] for k in (follows * self.ids + ids).tolist()]
        return [b"".join(parts[p:q]) for p, q in zip((ends - sizes).tolist(), ends.tolist())]

    def pairs(self, x: np.ndarray, y: np.ndarray, of_x: np.ndarray, in_x: np.ndarray, in_y: np.ndarray, owner: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs with their stretches and multiplicities; groups of many pairs take each distinct pair once."""
        first_x, first_y = np.cumsum(in_x) - in_x, np.cumsum(in_y) - in_y
        partners = np.where(many[of_x], 0, in_y[of_x])
        key = np.repeat(x << 32, partners) | y[_expand(partners, first_y[of_x])]
        keys, owners, times = [key], [owner[np.repeat(of_x, partners)]], [np.ones(len(key), np.int64)]
        for g in np.flatnonzero(many).tolist():
            p, p_times = np.unique(x[first_x[g] : first_x[g] + in_x[g]], return_counts=True)
            q, q_times = np.unique(y[first_y[g] : first_y[g] + in_y[g]], return_counts=True)
            keys.append(((p << 32)[:, None] | q).reshape(-1))
            times.append((p_times[:, None] * q_times).reshape(-1))
            owners.append(np.full(len(keys[-1]), owner[g]))
        return np.concatenate(keys), np.concatenate(owners), np.concatenate(times)

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the stretches of texts that are split already."""
        if len(self.known.place) > CACHE or self.known.letters > CACHE_LETTERS:
            self.known = Stretches()
        place = self.known.place
        old = len(place)
        at = [np.fromiter([place.setdefault(s, len(place)) for s in parts], np.int64, len(parts)) for parts in texts]
        new = list(islice(place, old, None))
        for low in range(0, len(new), 4096):
            self.encode(new[low : low + 4096])
        self.known.letters += sum(map(len, new))
        return at


def _quick(a_json: str, names: dict[int, bytes]):
    """The same encoding by tiktoken, in half the time, if the vocabulary is one of ranks with the known split pattern."""
    spec = json.loads(a_json)
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    vocab = spec["model"]["vocab"]
    kind = spec.get("pre_tokenizer") or {}
    if kind.get("type") != "ByteLevel" or not kind.get("use_regex") or kind.get("add_prefix_space") or spec.get("normalizer") or any(vocab.get(p + q) != 256 + k for k, (p, q) in enumerate(merges)):
        return None
    import tiktoken

    ranks = {piece: i for i, piece in names.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _expand(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def align(aligner: Aligner, texts: list[str]) -> tuple[list[tuple[int, int, int, int, str]], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text (n_a, n_b, n_groups, n_links, digest of its groups); and the postings: text, pair, multiplicity."""
    at = aligner.numbers([aligner.split(" " + t) if t else [] for t in texts])
    known = aligner.known
    sums, groups = known.sums.all().reshape(-1, 5), known.groups
    digests, docs = [], []
    for k, places in enumerate(at):
        total = sums[places].sum(axis=0).tolist() if len(places) else None
        if total is None or total[4]:
            digests.append((0, 0, 0, 0, ""))
            continue
        digests.append((*total[:4], hashlib.sha256(b";".join([groups[p] for p in places.tolist()])).hexdigest()))
        docs.append(k)
    if not docs:
        none = np.zeros(0, np.int64)
        return digests, none, none, none
    held, times = np.unique(np.concatenate([k * len(groups) + at[k] for k in docs]), return_counts=True)
    doc, stretch = held // len(groups), held % len(groups)
    first = known.first.all()
    sizes = np.diff(first)[stretch]
    places = _expand(sizes, first[:-1][stretch])
    doc, key, n = np.repeat(doc, sizes), known.keys.all()[places], known.times.all()[places] * np.repeat(times, sizes)
    order = np.lexsort((doc, key))
    doc, key, n = doc[order], key[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
    return digests, doc[new], key[new], np.add.reduceat(n, new)


def pack(doc: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Postings sorted by pair as one packed row for each token of A."""
    extra = (n - 1) // MOST
    if extra.any():
        at = np.repeat(np.arange(len(n)), extra + 1)
        going_on = np.concatenate([[False], at[1:] == at[:-1]])
        doc, key, n = doc[at], key[at], np.where(going_on, MOST, (n - extra * MOST)[at])
    else:
        going_on = np.zeros(len(n), bool)
    records = np.empty(len(n), POSTING)
    records["b"] = (key & 0xFFFFFFFF).astype(np.uint32) | np.where(going_on, MORE, np.uint32(0))
    records["doc"], records["n"] = doc, n
    a = key >> 32
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    offsets = np.concatenate([first, [len(a)]]).astype(np.int32) * POSTING.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])
    return a[first].astype(np.int32), data


def unpack(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All postings of packed rows, and how many each row has."""
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    records = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(POSTING)
    return records, np.diff(offsets) // POSTING.itemsize


_LOADED: dict[tuple[int, int], Aligner] = {}


def _aligner(a_json: str, b_model: bytes) -> Aligner:
    """One for each worker and pair of vocabularies."""
    key = (hash(a_json), hash(b_model))
    if key not in _LOADED:
        _LOADED[key] = Aligner(a_json, b_model)
    return _LOADED[key]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        texts = tk.string_column(batch, "text")
        for low, high, _, _ in tk.slices(batch, "text"):
            yield ids[low:high], texts.slice(low, high - low).to_pylist()


def _post(a_json: str, b_model: bytes):
    """Digests of documents, and packed postings of slices of documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_json, b_model)
        row = base = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        kind = pa.struct([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])

        def packed() -> pa.RecordBatch:
            doc, key, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.lexsort((doc, key))
            a, data = pack(doc[order], key[order], n[order])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), base)), pa.array(a), data, pa.nulls(len(a), kind)], ["row", "a", "data", "digest"])

        for ids, texts in _slices(batches):
            if size and (size >= PACKED or row - base + len(ids) > SLICE_DOCS):
                yield packed()
                held, size = [], 0
            if not held:
                base = row
            digests, doc, key, n = align(aligner, texts)
            values = [pa.array(ids, pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in range(4)), pa.array([d[4] for d in digests])]
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(ids))), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary()), pa.StructArray.from_arrays(values, fields=list(kind))], ["row", "a", "data", "digest"])
            if len(doc):
                held.append((doc + (row - base), key, n))
                size += len(doc)
            row += len(ids)
        if size:
            yield packed()

    return rows


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


class Sums:
    """Sums by key of what a task has met so far, made whenever HELD numbers are held."""

    def __init__(self, width: int) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(width + 1))]
        self.size = 0

    def add(self, *part: np.ndarray) -> bool:
        """Whether, even summed, there are as many."""
        self.parts.append(part)
        self.size += len(part[0])
        if self.size < HELD:
            return False
        summed = self.take()
        self.parts, self.size = [summed], len(summed[0])
        return self.size >= HELD // 2

    def take(self) -> tuple[np.ndarray, ...]:
        out = _sum_by(*(np.concatenate([p[k] for p in self.parts]) for k in range(len(self.parts[0]))))
        self.parts, self.size = [tuple(v[:0] for v in out)], 0
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents hold each pair."""

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

    sums = Sums(1)
    for batch in batches:
        if not batch.num_rows:
            continue
        records, sizes = unpack(batch.column(batch.schema.get_field_index("data")))
        a = np.repeat(batch.column(batch.schema.get_field_index("a")).to_numpy().astype(np.int64), sizes)
        whole = records["b"] < MORE
        if sums.add((a << 32 | records["b"])[whole], np.ones(int(whole.sum()), np.int64)):
            yield out(*sums.take())
    yield out(*sums.take())


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sums (n_best, count_sum) of documents, a row for each block of them, of a stream sorted by token of A, part of it, counts before postings."""

    def out(row: np.ndarray, n_best: np.ndarray, count_sum: np.ndarray) -> pa.RecordBatch:
        records = np.empty(len(row), ADDED)
        records["doc"], records["n_best"], records["count_sum"] = row % BLOCK, n_best, count_sum
        block = row // BLOCK
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(row) else np.zeros(0, np.int64)
        offsets = np.concatenate([first, [len(row)]]).astype(np.int32) * ADDED.itemsize
        data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(block[first]), data], ["block", "data"])

    sums = Sums(2)
    last, kept_key, kept_n = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        col = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
        a, salt = col("a").to_numpy().astype(np.int64), col("salt").to_numpy()
        posting = col("data").is_valid().to_numpy(zero_copy_only=False)
        # Counts of this batch, after those of the token that goes on from the batch before.
        c = np.flatnonzero(~posting)
        key, n = a[c] << 32 | col("b").take(pa.array(c)).to_numpy().astype(np.int64), col("n").take(pa.array(c)).to_numpy()
        if last is not None and last == (a[0], salt[0]):
            key, n = np.concatenate([kept_key, key]), np.concatenate([kept_n, n])
        if posting.any():
            order = np.argsort(key, kind="stable")
            by_key, count = key[order], n[order]
            owner = by_key >> 32
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            most = np.repeat(np.maximum.reduceat(count, first), np.diff(np.concatenate([first, [len(owner)]])))
            p = pa.array(np.flatnonzero(posting))
            records, sizes = unpack(col("data").take(p))
            at = np.searchsorted(by_key, np.repeat(a[posting], sizes) << 32 | (records["b"] & ~MORE))
            times = records["n"].astype(np.int64)
            row = np.repeat(col("row").take(p).to_numpy(), sizes) + records["doc"]
            if sums.add(row, times * (count[at] == most[at]), times * count[at]):
                yield out(*sums.take())
        last = (a[-1], salt[-1])
        same = (key >> 32) == a[-1]
        kept_key, kept_n = key[same], n[same]
    yield out(*sums.take())


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, n_best, count_sum) of each document, of a stream sorted by block, digests before sums."""
    at: int | None = None
    digests: list[pa.RecordBatch] = []
    total = np.zeros((BLOCK, 2), np.int64)

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(digests).combine_chunks()
        own = table["row"].to_numpy() % BLOCK
        return pa.RecordBatch.from_arrays([table["digest"].combine_chunks(), pa.array(total[own, 0]), pa.array(total[own, 1])], ["digest", "n_best", "count_sum"])

    for batch in batches:
        blocks = batch.column(batch.schema.get_field_index("block")).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(blocks) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if at != blocks[a]:
                if digests:
                    yield out()
                at, digests, total = int(blocks[a]), [], np.zeros((BLOCK, 2), np.int64)
            run = batch.slice(a, b - a)
            told = run.filter(run.column(run.schema.get_field_index("row")).is_valid()).select(["row", "digest"])
            if told.num_rows:
                digests.append(told)
            for data in run.column(run.schema.get_field_index("data")).drop_null():
                records = np.frombuffer(data.as_buffer(), ADDED)
                total[records["doc"], 0] += records["n_best"]
                total[records["doc"], 1] += records["count_sum"]
    if digests:
        yield out()


def postings(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Written: rows of digests (a null), and of packed postings by token of A and slice of documents."""
    a_json, b_model = Path(a_path or default_a()).read_text(encoding="utf-8"), Path(b_path or default_b()).read_bytes()
    return cut(documents.select("doc_id", "text").mapInArrow(_post(a_json, b_model), POSTED))


def pair_counts(posted: DataFrame) -> DataFrame:
    """a, b, n: how many documents hold a token of A and one of B linked."""
    return posted.where("a IS NOT NULL").select("a", "data").mapInArrow(_count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def cross_align(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, target: int = TARGET) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of each document."""
    posted = postings(documents, a_path, b_path)
    counts = cut(pair_counts(posted))
    many = counts.groupBy("a").agg(F.ceil(F.sum("n") / target).cast("int").alias("salts")).where("salts > 1")
    # At most one row for each entry of vocabulary A.
    many = F.broadcast(cut(many))
    salts = F.coalesce("salts", F.lit(1))
    known = counts.join(many, "a", "left").select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "b", "n", F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("data"))
    passed = posted.where("a IS NOT NULL").join(many, "a", "left").select("a", F.pmod(F.xxhash64("row"), salts).cast("int").alias("salt"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("long").alias("n"), "row", "data")
    stream = known.unionByName(passed).repartition(F.xxhash64("a", "salt")).sortWithinPartitions("a", "salt", F.col("data").isNotNull())
    added = stream.mapInArrow(_contribute, "block long, data binary")
    told = posted.where("a IS NULL").select(F.floor(F.col("row") / BLOCK).cast("long").alias("block"), "row", "digest")
    both = told.unionByName(added, allowMissingColumns=True).repartition(F.xxhash64("block")).sortWithinPartitions("block", F.col("row").isNull())
    out = both.mapInArrow(_finish, f"digest struct<{DIGEST_FIELDS}>, n_best long, count_sum long")
    return out.select("digest.*", "n_best", "count_sum")


def op12_cross_tokenizer(documents: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return cross_align(documents).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
