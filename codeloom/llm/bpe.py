"""Encoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from codeloom.plans.spread import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose ids a worker keeps; then it starts afresh (long words aren't kept).
CACHE_WORDS = 200_000
CACHE_BYTES = 64
NONE = 1 << 60


def read_ranks(path: str = VOCABULARY) -> bytes:
    """The rank file's bytes, read once on the driver; its size is that of the vocabulary, whatever the corpus."""
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(os.path.basename(path))
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Byte-pair merges by a segment tree over the ranks of adjacent pairs."""

    def __init__(self, ranks: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.byte = [self.rank[bytes([i])] for i in range(256)]
        self.words = regex.compile(PATTERN).findall
        # the rank of a pair of ids is the id of what they make together
        self.spelt = {v: k for k, v in self.rank.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.cache: dict[str, list[int]] = {}

    def _pair(self, a: int, b: int) -> int:
        got = self.pairs.get((a, b))
        if got is None:
            got = self.rank.get(self.spelt[a] + self.spelt[b], NONE)
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            self.pairs[a, b] = got
        return got

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word.

        Leaf i of the tree holds the rank of the pair that starts at symbol i; the root holds the least
        rank of all, and going left wherever the left child holds it too leads to the leftmost such pair. A merge
        changes three leaves, each in as many steps as the tree is high.
        """
        ids = [self.byte[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        pair = self._pair
        leaves = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = pair(ids[i], ids[i + 1])
        for i in range(leaves - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += leaves
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a <= b else b
                if tree[i] == low:
                    return
                tree[i] = low

        while (least := tree[1]) != NONE:
            i = 1
            while i < leaves:
                i *= 2
                if tree[i] != least:
                    i += 1
            i -= leaves
            gone = after[i]
            ids[i], ids[gone] = least, -1
            nxt = after[i] = after[gone]
            if gone < leaves:
                put(gone, NONE)
            if nxt < n:
                before[nxt] = i
                put(i, pair(least, ids[nxt]))
            else:
                put(i, NONE)
            if (prev := before[i]) >= 0:
                put(prev, pair(ids[prev], least))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for w in self.words(text):
            ids = cache.get(w)
            if ids is None:
                ids = self.merge(w.encode("utf-8", "replace"))
                if len(w) <= CACHE_BYTES:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = ids
            out += ids
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    key = hash(shared.value)
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, counts_only: bool = False, keep_text: bool = False) -> DataFrame:
    """(key, ids) of every row, or (key, tokens) with ``counts_only``; the text beside them with ``keep_text``.

    Special tokens are never made: their strings in a text are ordinary text. Null and empty texts
    give an empty list (count 0); every row gives one row, repeated rows and null keys included; other
    columns are dropped, whatever their names. Texts are taken whole; a word of a million letters
    costs n log n steps. The ranks are broadcast (under 1 MB, fixed by the vocabulary).
    """
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    rows = spread(df.select(key, text), key)
    kind = rows.schema[key].dataType.simpleString()
    ids = pa.list_(pa.int32())

    def run(batches):
        enc = _encoder(shared)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for start in range(0, len(texts), 1000):
                part = [enc.encode(t) for t in texts.slice(start, 1000).to_pylist()]
                done = pa.array([len(x) for x in part], pa.int64()) if counts_only else pa.array(part, ids)
                texts_too = [texts.slice(start, 1000)] * keep_text
                yield pa.RecordBatch.from_arrays([keys.slice(start, 1000), done, *texts_too], names=[key, "tokens" if counts_only else "ids", *[text] * keep_text])

    return rows.mapInArrow(run, f"`{key}` {kind}, " + ("tokens bigint" if counts_only else "ids array<int>") + f", `{text}` string" * keep_text)


def decode(ids: list[int], ranks: bytes) -> str:
    """The text of ids, for round trips."""
    spelt = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.splitlines())}
    return b"".join(spelt[i] for i in ids).decode("utf-8", "replace")


def roundtrip(encoded: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, bytes, same): the bytes of each text, and whether its ids spell it; a null text counts as empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        spelt = _encoder(shared).spelt
        for batch in batches:
            want = [(t or "").encode("utf-8", "replace") for t in batch.column(text).to_pylist()]
            same = [b"".join(map(spelt.__getitem__, ids)) == w for ids, w in zip(batch.column("ids").to_pylist(), want)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(map(len, want), pa.int64()), pa.array(same, pa.bool_())], names=[key, "bytes", "same"])

    return encoded.mapInArrow(run, f"`{key}` {kind}, bytes bigint, same boolean")
