"""Byte-level BPE encoding and decoding in linear time.

The bytes of a piece are read as Latin-1 text, so that an Aho-Corasick automaton over the vocabulary finds all its tokens
in one pass. From left to right the longest match is taken first; it stays if it is compatible with the token before it,
that is if merging the two tokens' bytes alone gives the two tokens again. Otherwise the next shorter match is tried, and
where none is left the search steps back over the last token and never comes to that place again. A sequence whose
neighbours are all compatible is the one that merging by rank gives. Compatibilities and whole pieces are remembered in
tables of bounded size. Decoding joins the tokens' bytes.

Null text counts as empty: no tokens, no bytes. The vocabulary is read once by the driver and broadcast; its size is that
of the given file, which doesn't grow with the data. Extra columns are kept, those named like a new one replaced.
"""

from __future__ import annotations

import base64
import gc
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm.common import table, with_text_columns
from lapforge.llm.registry import register

#: Entries in each of a memo's two generations. A worker keeps them from one stage to the next, some 200 bytes each.
REMEMBERED = 1 << 17


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ids must be 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


class Bounded(dict):
    """A memo in two generations: when the younger is full the older goes, but for what is asked for again."""

    def __init__(self, compute, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


class Encoder:
    def __init__(self, tokens: tuple[bytes, ...], pattern: str):
        self.tokens = tokens
        self.ranks = {token: i for i, token in enumerate(tokens)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.compatible = Bounded(self._compatible)
        self.pieces = Bounded(self._piece)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self._longest_first(data))

    def _longest_first(self, data: bytes) -> list[int]:
        """Tokens of ``data``: longest matches, with steps back where neighbours aren't compatible."""
        n, compatible, size = len(data), self.compatible, len(self.tokens)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # matches by start, shorter ones first
        for last, match in self.automaton.iter(data.decode("latin-1")):
            starting[last + 1 - match[1]].append(match)
        dead, ids, ways = set(), [], []  # ways: for each token taken, its start and the shorter matches there
        at, left, before = 0, starting[0], -1
        while at < n:
            while left:
                token, length = left.pop()
                if (before < 0 or compatible[before * size + token]) and at + length not in dead:
                    ids.append(token)
                    ways.append((at, left))
                    at, before = at + length, token
                    left = starting[at].copy()
                    break
            else:
                dead.add(at)
                ids.pop()
                at, left = ways.pop()
                before = ids[-1] if ids else -1
        return ids

    def _compatible(self, pair: int) -> bool:
        left, right = divmod(pair, len(self.tokens))
        return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]

    def merged(self, data: bytes) -> list[int]:
        """Merging by rank, step by step; for the few bytes of two tokens."""
        rank_of, none = self.ranks.get, len(self.tokens)
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [rank_of(data[i:i + 2], none) for i in range(len(data) - 1)]  # what each part and the next would give
        while pairs and (rank := min(pairs)) < none:
            i = pairs.index(rank)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank_of(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank_of(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder; one process serves many tasks and keeps its memos."""
    key = hash(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*shared.value)
        gc.freeze()  # vocabulary and modules stay as long as the worker: collections needn't go through them again and again
    return _ENCODERS[key]


def bpe_round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the token ids of every whole text (``tokens``) and the bytes they decode to (``decoded``)."""
    shared = df.sparkSession.sparkContext.broadcast((tuple(read_ranks(vocabulary)), pattern))

    def make():
        encoder = _encoder(shared)

        def compute(texts):
            ids = [encoder.encode(t.decode()) for t in texts]
            return [pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.decode(x) for x in ids], pa.binary())]

        return compute

    return with_text_columns(df, text, "tokens array<int>, decoded binary", make, () if keep_text else (text,))


def token_digests(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded bytes."""
    coded = bpe_round_trip(df.select("doc_id", "text"), vocabulary, pattern, keep_text=False)
    return coded.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def multilingual_digests(df: DataFrame) -> DataFrame:
    """With the vocabulary for many languages and its own pattern."""
    import public_tokenizers

    return token_digests(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multilingual_digests(table(spark, sf_dir, "documents"))
