"""Byte-level BPE encoding and decoding (operator 9).

The rank file's tokens, as Latin-1 strings, form an Aho-Corasick automaton. A piece is encoded by
taking the longest match at each position and going back when two neighbours could not both
survive the merges; whether a pair is compatible is worked out from how each token was merged and
kept in a memo. This gives the merges' own result in linear time, however long the piece is.
Texts are first cut into runs (an optional space and what follows up to the next white space),
which the splitting pattern never joins; runs already seen come from a bounded memo.

Nulls and empty texts have no ids: n_tokens 0 and the digests of nothing. Repeated rows each give
a row; other columns of the input are not read, so clashing names do no harm. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import arrow_map, table, texts_of

#: White space in Unicode's sense, as the splitting pattern means it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs that no match of the splitting pattern crosses.
RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Entries of a worker's memo. A full memo stays as it is: common runs come early.
MEMO = 700_000


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteBpe:
    """Ranks, automaton and memos of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        plain = pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.split = regex.compile(plain)
        self._pairs: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        reachable = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self._parts[rank] = (rank, rank)
                reachable.append((token, rank))
            elif self._learn(token, rank):
                reachable.append((token, rank))
        known = dict(reachable)
        self.automaton = ahocorasick.Automaton()
        for token, rank in reachable:
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            for cut in range(len(token) - 1, 0, -1):
                if (short := known.get(token[:cut])) is not None:
                    self._shorter[rank] = short
                    break
        self.automaton.make_automaton()
        self._fits.clear()
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.pieces: dict[bytes, list[int]] = {}

    def _learn(self, token: bytes, rank: int) -> bool:
        """Find the pair whose merge makes this token; a token that no merge can make is met only as a whole piece."""
        for cut in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
            if left < rank and right < rank and left in self._parts and right in self._parts and self._compatible(left, right):
                self._pairs[left, right] = rank
                self._parts[rank] = (left, right)
                return True
        return False

    def _compatible(self, left: int, right: int) -> bool:
        """False if some merge across the boundary would have come before one that made left or right."""
        a, b, limit = left, right, 1 << 60
        while True:
            if self._pairs.get((a, b), limit) < limit:
                return False
            for turn in (a > b, a <= b):
                if turn:  # undo the last merge of the left token
                    limit, a2 = a, self._parts[a][1]
                    if a2 != a:
                        a = a2
                        break
                else:
                    limit, b2 = b + 1, self._parts[b][0]
                    if b2 != b:
                        b = b2
                        break
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 4 * MEMO:
                self._fits.clear()
            known = self._fits[key] = self._compatible(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [(-1, 0)] * len(piece)
        for end, (rank, n) in self.automaton.iter(piece.decode("latin-1")):
            if n > longest[end - n + 1][1]:
                longest[end - n + 1] = (rank, n)
        size = len(piece)
        usable = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0][0]
        while True:
            last = out[-1] if out else None
            while True:
                end = at + len(self.bytes_of[token])
                if usable[end] and (last is None or self.fits(last, token)):
                    out.append(token)
                    at = end
                    if at == size:
                        return out
                    token = longest[at][0]
                    break
                shorter = self._shorter.get(token)
                if shorter is None:
                    if last is None:
                        raise ValueError("the vocabulary lacks single bytes")
                    usable[at] = 0
                    out.pop()
                    at -= len(self.bytes_of[last])
                    token = last
                    break
                token = shorter

    def encode_run(self, run: str) -> list[int]:
        ids: list[int] = []
        for piece in self.split.findall(run):
            key = piece.encode("utf-8", "surrogatepass")
            got = self.pieces.get(key)
            if got is None:
                got = self.encode_piece(key)
                if len(key) <= 64 and len(self.pieces) < MEMO:
                    self.pieces[key] = got
            ids += got
        return ids

    def decode(self, ids) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [i for run in RUNS.findall(text) for i in self.encode_run(run)]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids and of the bytes decoded from them."""
        memo, ids, back = self.memo, [], []
        for run in RUNS.findall(text):
            got = memo.get(run)
            if got is None:
                own = self.encode_run(run)
                got = ("".join([f"{i}," for i in own]).encode(), self.decode(own))
                if len(run) <= 64 and len(memo) < MEMO:
                    memo[run] = got
            ids.append(got[0])
            back.append(got[1])
        said = b"".join(ids)
        return said.count(b","), hashlib.sha256(said[:-1]).hexdigest(), hashlib.sha256(b"".join(back)).hexdigest()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def load(vocab: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(vocab), pattern)


def byte_bpe(docs: DataFrame, vocab: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids (array<int>) of every text. The vocabulary is a file that every executor has; its path is a parameter."""
    vocab, pattern = vocab or default_vocab(), pattern or default_pattern()

    def make():
        bpe = load(vocab, pattern)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(x) for x in texts_of(batch)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

        return run

    return arrow_map(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), make, "doc_id long, ids array<int>")


def byte_bpe_decode(encoded: DataFrame, vocab: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """bytes (binary) of every list of ids."""
    vocab, pattern = vocab or default_vocab(), default_pattern()

    def make():
        bpe = load(vocab, pattern)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

        return run

    return arrow_map(encoded.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{ids_col}` ids"), make, "doc_id long, bytes binary")


def byte_bpe_digest(docs: DataFrame, vocab: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode every text in one scan, without a shuffle."""
    vocab, pattern = vocab or default_vocab(), pattern or default_pattern()

    def make():
        bpe = load(vocab, pattern)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [bpe.digest(x) for x in texts_of(batch)]
            n, ids, back = zip(*got) if got else ((), (), ())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return run

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digest(table(spark, sf_dir, "documents"))
