"""BPE encoding and decoding: merges chosen by a segment tree over the ranks of adjacent pairs.

The root of the tree holds the leftmost lowest-rank pair; a merge changes three leaves, so a piece of n bytes
takes O(n log n) steps, also when it is one run of a hundred thousand letters. Pieces repeat, so each worker
keeps the ids of short pieces it has seen; the memory of that is bounded by CACHE_PIECES and CACHE_BYTES. The new
short pieces of a batch go through their trees side by side: one numpy row is one tree.

Defined results: a null text is the empty text and has no ids; its digests are those of no bytes. Repeated rows
give repeated results; an empty table gives an empty table; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table, texts

#: The split pattern of the byte-level tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts of code points that both libraries class alike, and what such texts lack: control
#: characters that only one takes for white space, numerals that aren't digits, and all beyond Latin.
SPLIT_LATIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
BEYOND_LATIN = "[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]"
#: Bounds of what a worker remembers: pieces, and bytes of a piece.
CACHE_PIECES = 400_000
CACHE_BYTES = 64
#: Rows of a batch that goes back with its ids and its decoded texts.
OUT_ROWS = 150
NONE = 1 << 62


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest for 256 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    kept = set(own)
    rest = (b for b in range(256) if b not in kept)
    table = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Tokenizer:
    """A byte-level BPE vocabulary from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for piece, k in vocab.items():
            self.bytes_of[k] = bytes(back[c] for c in piece)
        for content, k in self.added.items():
            self.bytes_of[k] = content.encode()
        self.single = [vocab[c] for c in letters]
        #: (left id << 32 | right id) -> (rank << 32 | merged id)
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        self.any_pieces = regex.compile(SPLIT).findall
        self.latin_pieces = re.compile(SPLIT_LATIN).findall
        self.beyond = re.compile(BEYOND_LATIN).search
        #: The merges again, sorted by pair, for lookups of many pairs at once.
        self.pairs = np.array(sorted(self.merge), np.int64)
        found = np.array([self.merge[k] for k in self.pairs.tolist()], np.int64)
        self.ranks, self.wholes = found >> 32, found & 0xFFFFFFFF
        self.singles = np.array(self.single, np.int64)
        self.marks = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.seen: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids of one piece: merge the leftmost lowest-rank pair, as the tree's root gives it, until none is left."""
        ids = [self.single[b] for b in data]
        n = len(ids)
        get = self.merge.get
        if n < 2:
            return ids
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        # A leaf's key: rank << 32 | place, so that the least key is the lowest rank and there the leftmost pair.
        tree = [NONE] * (2 * width)
        into = [0] * n
        for k in range(n - 1):
            m = get(ids[k] << 32 | ids[k + 1])
            if m is not None:
                tree[width + k] = (m >> 32) << 32 | k
                into[k] = m & 0xFFFFFFFF
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def put(k: int, key: int) -> None:
            k += width
            tree[k] = key
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while (root := tree[1]) != NONE:
            k = root & 0xFFFFFFFF
            gone = after[k]
            ids[k] = into[k]
            ids[gone] = -1
            to = after[gone]
            after[k] = to
            if gone < n - 1:
                put(gone, NONE)
            if to < n:
                before[to] = k
                m = get(ids[k] << 32 | ids[to])
                if m is not None:
                    into[k] = m & 0xFFFFFFFF
                    put(k, (m >> 32) << 32 | k)
                else:
                    put(k, NONE)
            else:
                put(k, NONE)
            at = before[k]
            if at >= 0:
                m = get(ids[at] << 32 | ids[k])
                if m is not None:
                    into[at] = m & 0xFFFFFFFF
                    put(at, (m >> 32) << 32 | at)
                else:
                    put(at, NONE)
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> list[str]:
        return self.any_pieces(text) if self.beyond(text) else self.latin_pieces(text)

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no merge) and merged id of each pair."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        hit = self.pairs[at] == keys
        return np.where(hit, self.ranks[at], NONE >> 32), self.wholes[at]

    def merged_together(self, datas: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of 2 to width + 1 bytes: one row of the arrays is one piece's tree."""
        count, places = len(datas), width + 1
        sizes = np.fromiter(map(len, datas), np.int64, count)
        flat = np.frombuffer(b"".join([d.ljust(places, b"\0") for d in datas]), np.uint8).reshape(count, places)
        ids = self.singles[flat]
        place = np.arange(places)
        ids[place >= sizes[:, None]] = -1
        rank, into = self.looked_up(ids[:, :-1], ids[:, 1:])
        rank[place[1:] >= sizes[:, None]] = NONE >> 32
        tree = np.full((count, 2 * width), NONE, np.int64)
        tree[:, width:] = rank << 32 | place[:-1]
        for low in (1 << k for k in reversed(range(width.bit_length() - 1))):
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        after = np.broadcast_to(place + 1, ids.shape).copy()
        before = np.broadcast_to(place - 1, ids.shape).copy()

        def put(row: np.ndarray, at: np.ndarray, key: np.ndarray | int) -> None:
            at = at + width
            tree[row, at] = key
            for _ in range(width.bit_length() - 1):
                at >>= 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

        def paired(row: np.ndarray, at: np.ndarray) -> None:
            rank, whole = self.looked_up(ids[row, at], ids[row, after[row, at]])
            into[row, at] = whole
            put(row, at, rank << 32 | at)

        row = np.arange(count)
        while len(row := row[tree[row, 1] < NONE >> 32 << 32]):
            at = tree[row, 1] & 0xFFFFFFFF
            gone = after[row, at]
            ids[row, at] = into[row, at]
            ids[row, gone] = -1
            to = after[row, gone]
            after[row, at] = to
            pair = gone < width
            put(row[pair], gone[pair], NONE)
            more = to < sizes[row]
            before[row[more], to[more]] = at[more]
            put(row[~more], at[~more], NONE)
            paired(row[more], at[more])
            left = before[row, at]
            paired(row[left >= 0], left[left >= 0])
        kept = ids >= 0
        packed = ids[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of these new short pieces among the seen."""
        by: dict[int, list[str]] = {}
        for x in pieces:
            n = len(x.encode())
            if n < 2:
                self.seen[x] = array("I", [self.single[x.encode()[0]]]).tobytes()
            elif n <= CACHE_BYTES:
                by.setdefault(max(2, 1 << (n - 2).bit_length()), []).append(x)
        for width, own in by.items():
            for k in range(0, len(own), 20_000):
                part = own[k : k + 20_000]
                self.seen.update(zip(part, self.merged_together([x.encode() for x in part], width)))

    def packed(self, piece: str) -> bytes:
        """Ids of a piece too long to keep, as little-endian unsigned 32-bit integers."""
        return array("I", self.merged(piece.encode())).tobytes()

    def parts(self, text: str) -> list[str | int]:
        """The pieces of a text, and the ids of added tokens whose strings are in it."""
        if self.marks is None or not self.marks.search(text):
            return self.pieces(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self.pieces(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return [*out, *self.pieces(text[at:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        cut = [self.parts(t) for t in texts]
        new: set = set()
        for parts in cut:
            new.update(parts)
        ids = {x: array("I", [x]).tobytes() for x in new if isinstance(x, int)}
        new.difference_update(ids)
        fresh = new.difference(self.seen)
        if len(self.seen) + len(fresh) > CACHE_PIECES:
            self.seen.clear()
            fresh = new
        if fresh:
            self.learn(fresh)
        seen, packed = self.seen, self.packed
        return [b"".join([seen.get(x) or ids.get(x) or packed(x) for x in parts]) for parts in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The vocabulary of this file, once for each worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (packed little-endian unsigned 32-bit), decoded text: one row for each row.

    path: a tokenizer file that every executor has; by default the installed public one.
    """

    def make():
        tok = tokenizer(path or vocabulary_path())

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = tok.encode_all(texts(batch, 1))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([tok.decode(x) for x in ids], pa.string())], [id_col, "ids", "decoded"])

        return work

    rows = docs.select(id_col, text_col)
    return map_batches(rows, make, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, ids binary, decoded string", OUT_ROWS)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from the same encoder and decoder; the ids stay in the worker."""

    def make():
        tok = tokenizer(path or vocabulary_path())

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b = [], [], []
            for ids in tok.encode_all(texts(batch, 1)):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(tok.decode(ids).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    rows = docs.select("doc_id", "text")
    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
