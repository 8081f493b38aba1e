"""BPE encoding and decoding with a contiguous rank array.

A word (a piece of the pre-tokeniser) is held as one short row of part ids and one row of the ranks of neighbouring
parts. The smallest rank is found by scanning the row, its boundary deleted, and the two ranks beside it refreshed,
until no neighbours merge. Many short words take these steps together, a merge each at a time; words of more than LONG
bytes take the same merges from a heap. Words already seen come from a bounded cache.

Cases: a null text counts as empty; an empty text has no ids and decodes to the empty text; rows are independent, so
repeated rows give repeated results; extra columns are passed through, and a clash with an output name is an error of
the caller that names the column (ValueError).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.textkernel import string_column

#: Fixed value: the split pattern of byte-level BPE vocabularies, as their description gives it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 256
#: Fixed value: letters and numbers newer than the Unicode tables of the tokenizers library, which are no letters there.
LATE = (
    "\U00000558\U0000058b-\U0000058c\U0000088f\U00000c5c\U00000cdc\U0000208f"
    "\U0000209d-\U0000209f\U0000a7ce-\U0000a7cf\U0000a7d2\U0000a7d4\U0000a7dd\U0000a7e2"
    "\U0000a7f1\U0000ab6c-\U0000ab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    "\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f"
    "\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f"
    "\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
CACHE_WORDS = 250_000
CACHE_LETTERS = 48
BATCH_BYTES = 1 << 20
#: Words of one block, bits of a part's id, and the rank of parts that never merge.
ROWS = 8192
PART_BITS = 20
NEVER = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in such vocabularies: itself where printable, else the next free letter from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A vocabulary with its merges; made from the content of a tokenizers JSON file."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.byte_id = np.zeros(256, np.int64)
        for i, piece in self.bytes_of.items():
            if len(piece) == 1:
                self.byte_id[piece[0]] = i
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank: dict[int, int] = {}
        for k, (left, right) in enumerate(merges):
            self.rank.setdefault(vocab[left] << PART_BITS | vocab[right], k)
        self.merged = np.array([vocab[left + right] for left, right in merges] or [0], np.int64)
        self.pairs = np.array(sorted(self.rank), np.int64)
        self.pair_rank = np.array([self.rank[int(p)] for p in self.pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.pattern = regex.compile(SPLIT)
        self.late = regex.compile(f"[{LATE}]")
        self.dated = regex.compile(SPLIT.replace(r"\p{L}+", f"[\\p{{L}}--[{LATE}]]+").replace(r"\p{N}+", f"[\\p{{N}}--[{LATE}]]+").replace(r"[^\s\p{L}\p{N}]+", f"[[^\\s\\p{{L}}\\p{{N}}]||[{LATE}]]+"), regex.V1)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of parts; NEVER where they don't merge, or where a part is missing (-1)."""
        keys = left << PART_BITS | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & (right >= 0) & (left >= 0), self.pair_rank[at], NEVER) if len(self.pairs) else np.full(keys.shape, NEVER)

    def short(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of short words, all of which take one merge at a time together.

        A row holds the parts of a word, closed up to the left, and beside them the ranks of neighbouring parts.
        """
        sizes = np.array([len(p) for p in pieces])
        wide = int(sizes.max())
        raw = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(-1, wide)
        parts = np.full((len(pieces), wide + 2), -1, np.int64)
        parts[:, :wide] = np.where(np.arange(wide) < sizes[:, None], self.byte_id[raw], -1)
        ranks = np.full((len(pieces), wide + 2), NEVER, np.int64)
        ranks[:, : wide + 1] = self._ranks(parts[:, :-1], parts[:, 1:])
        live, column = np.arange(len(pieces)), np.arange(wide + 2)
        done = np.empty_like(parts)
        while len(live):
            at = ranks.argmin(1)
            row = np.arange(len(live))
            least = ranks[row, at]
            go = least < NEVER
            if not go.all():
                done[live[~go]] = parts[~go]
                live, parts, ranks, at, least, row = live[go], parts[go], ranks[go], at[go], least[go], row[: go.sum()]
                if not len(live):
                    break
            shift = column[None, :-1] > at[:, None]
            parts[row, at] = self.merged[least]
            parts[:, :-1] = np.where(shift, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(shift, ranks[:, 1:], ranks[:, :-1])
            ranks[row, at] = self._ranks(parts[row, at], parts[row, at + 1])
            prior = np.maximum(at - 1, 0)
            ranks[row, prior] = np.where(at > 0, self._ranks(parts[row, prior], parts[row, at]), ranks[row, prior])
        lengths = (done >= 0).sum(1)
        blob, size = done.astype("<u4").tobytes(), (wide + 2) * 4
        return [blob[k * size : k * size + n * 4] for k, n in enumerate(lengths.tolist())]

    def long(self, piece: bytes) -> bytes:
        """The same merges for a long word, smallest rank first and leftmost among equals, in n log n steps."""
        parts = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n, rank = len(parts), self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[key], k, key) for k in range(n - 1) if (key := parts[k] << PART_BITS | parts[k + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            r, k, key = heapq.heappop(heap)
            j = after[k]
            if parts[k] < 0 or j < 0 or parts[k] << PART_BITS | parts[j] != key:
                continue
            parts[k], parts[j] = int(self.merged[r]), -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (new := parts[a] << PART_BITS | parts[b]) in rank:
                    heapq.heappush(heap, (rank[new], a, new))
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of distinct words."""
        raws = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        order = np.argsort(sizes, kind="stable")
        out, first, brief = {}, 0, int((sizes <= LONG).sum())
        ordered = sizes[order]
        while first < brief:
            end = min(brief, first + ROWS, int(np.searchsorted(ordered, ordered[first] + 2, "right")))
            block = order[first:end].tolist()
            out |= zip([words[k] for k in block], self.short([raws[k] for k in block]))
            first = end
        return out | {words[k]: self.long(raws[k]) for k in order[brief:].tolist()}

    def _units(self, text: str) -> list[str]:
        """The text cut at boundaries of the pre-tokeniser."""
        if self.specials and self.specials.search(text):
            return [u for t in self.specials.split(text) for u in ([t] if t in self.special else self._units(t))]
        even = text[:1] not in ("", " ", "\n") and text[-1] not in " \n" and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text)
        if even and (flat := text.replace("\n", "\0\n\0")).replace("\0", "").replace("\n", "").isprintable() and "\0" not in text:
            # All white space is single spaces and line feeds: a word starts at each space, and a line feed stands alone.
            return flat.replace(" ", "\0 ").split("\0")
        return (self.dated if self.late.search(text) else self.pattern).findall(text)

    def _cut(self, unit: str) -> list[str]:
        return (self.pattern if unit.isprintable() or not self.late.search(unit) else self.dated).findall(unit)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        units = [self._units(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cache = self.cache
        missing = set().union(*units).difference(cache)
        for t in missing & self.special.keys():
            cache[t] = np.array([self.special[t]], "<u4").tobytes()
            missing.discard(t)
        cut = {u: self._cut(u) for u in missing if not (u[1:].isalpha() and u[0] == " " or u.isalpha())}
        words = missing.difference(cut).union(*cut.values()).difference(cache)
        cache |= self._words(list(words))
        cache |= {u: b"".join([cache[w] for w in ws]) for u, ws in cut.items() if len(ws) > 1}
        out = [b"".join(map(cache.__getitem__, u)) for u in units]
        for u in [u for u in missing if len(u) > CACHE_LETTERS]:
            cache.pop(u, None)
        return out

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[int, Bpe] = {}


def _bpe(content: str) -> Bpe:
    """One vocabulary for each worker process."""
    if (key := hash(content)) not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(content)
    return _LOADED[key]


def _mapped(df: DataFrame, of: str, adds: dict[str, tuple[T.DataType, pa.DataType]], content: str, make) -> DataFrame:
    clash = set(adds) & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    sent = df.sparkSession.sparkContext.broadcast(content)
    schema = T.StructType([*df.schema.fields, *(T.StructField(k, kind) for k, (kind, _) in adds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or _bpe(sent.value)
            size = max(1, batch.num_rows * BATCH_BYTES // max(BATCH_BYTES, batch.nbytes))
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(bpe, part)], [*part.schema.names, *adds])

    return df.mapInArrow(run, schema)


def bpe_encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Adds the ids of each text, packed as little-endian unsigned 32-bit integers (see unpack_ids)."""
    content = Path(vocabulary or default_vocabulary()).read_text()
    return _mapped(df, text, {ids: (T.BinaryType(), pa.binary())}, content, lambda bpe, b: [pa.array(bpe.encode_all(string_column(b, text).to_pylist()), pa.binary())])


def bpe_decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Adds the text of packed ids; null ids count as none."""
    content = Path(vocabulary or default_vocabulary()).read_text()
    return _mapped(df, ids, {decoded: (T.StringType(), pa.string())}, content, lambda bpe, b: [pa.array([bpe.decode(x or b"") for x in b.column(b.schema.get_field_index(ids)).to_pylist()], pa.string())])


def bpe_round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """bpe_encode and bpe_decode in one pass, so that a task needs one Python worker."""
    content = Path(vocabulary or default_vocabulary()).read_text()

    def both(bpe: Bpe, batch: pa.RecordBatch) -> list[pa.Array]:
        packed = bpe.encode_all(string_column(batch, text).to_pylist())
        return [pa.array(packed, pa.binary()), pa.array(map(bpe.decode, packed), pa.string())]

    return _mapped(df, text, {ids: (T.BinaryType(), pa.binary()), decoded: (T.StringType(), pa.string())}, content, both)


def unpack_ids(ids: str = "ids"):
    """Packed ids as array<int>: a column expression without Python."""
    each = F.sequence(F.lit(1), (F.octet_length(ids) / 4).cast("int"))
    byte = lambda k, j: F.conv(F.hex(F.substring(F.col(ids), (k - 1) * 4 + j, F.lit(1))), 16, 10).cast("int")
    one = F.transform(each, lambda k: byte(k, 1) + byte(k, 2) * 256 + byte(k, 3) * 65536 + byte(k, 4) * 16777216)
    return F.when(F.octet_length(ids) > 0, one).otherwise(F.array().cast("array<int>"))


def op8_bpe(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    out = bpe_round_trip(documents.select("doc_id", "text"), vocabulary=vocabulary)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
