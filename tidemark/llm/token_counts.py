"""Token counts of a unigram vocabulary by count-only Viterbi (operator 3).

An Aho-Corasick automaton enumerates the vocabulary's matches in a run of text; dynamic programming over
the ends keeps, for each, the best score and the number of tokens on the way to it, and no path. Ties
and unknown characters follow the public Unigram tokenizer: at one end an earlier start wins unless a
later one is strictly better, a character that is no piece of its own scores the least piece minus 10,
and unknown text becomes bytes where the vocabulary has them all, else one token for each stretch.

Text is cut before every space, a space being written as the vocabulary's mark, so runs are independent
and a bounded memo keeps those already counted. The vocabulary is a public model file whose path is a
parameter; its pieces and scores are taken as they are (nothing is trained).

Null and empty texts have no tokens. Repeated rows are counted each; only doc_id and text are read.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import arrow_map, table, texts_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 1_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores in order of id, and the unknown piece's id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int):
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown_score = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        known = {piece for piece, _ in vocabulary}
        self.byte_known = [f"<0x{b:02X}>" in known for b in range(256)]
        self.memo: dict[str, int] = {}

    def _bytes(self, text: str) -> int:
        """Tokens of a stretch of unknown text: its bytes, or one."""
        raw = text.encode("utf-8", "surrogatepass")
        return len(raw) if all(self.byte_known[b] for b in raw) else 1

    def count_run(self, run: str) -> int:
        n = len(run)
        matches: list[list] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(run):
            matches[end + 1].append(found)
        single, unknown_score = self.single, self.unknown_score
        score = [0.0] * (n + 1)
        count = [0] * (n + 1)  # tokens that are complete
        open_ = [-1] * (n + 1)  # where the stretch of unknown text that ends here began
        for end in range(1, n + 1):
            best = None
            for length, own, is_unknown in sorted(matches[end], reverse=True):
                start = end - length
                got = own + score[start]
                if best is None or got > best[0]:
                    best = (got, start, is_unknown)
            if run[end - 1] not in single:
                got = unknown_score + score[end - 1]
                if best is None or got > best[0]:
                    best = (got, end - 1, True)
            score[end], start, is_unknown = best
            if is_unknown:
                count[end] = count[start]
                open_[end] = open_[start] if open_[start] >= 0 else start
            else:
                count[end] = count[start] + 1 + (self._bytes(run[open_[start] : start]) if open_[start] >= 0 else 0)
        return count[n] + (self._bytes(run[open_[n] : n]) if open_[n] >= 0 else 0)

    def count(self, text: str) -> int:
        if not text:
            return 0
        memo, total = self.memo, 0
        marked = text.replace(" ", MARK)
        runs = marked.split(MARK)
        if marked[0] == MARK:
            runs = runs[1:]
        for run in runs:
            got = memo.get(run)
            if got is None:
                got = self.count_run(MARK + run)
                if len(run) <= 64 and len(memo) < MEMO:
                    memo[run] = got
            total += got
        return total


@lru_cache(maxsize=2)
def load(path: str) -> UnigramCounter:
    return UnigramCounter(*read_vocabulary(path))


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every text, in one scan."""
    path = model or default_model()

    def make():
        counter = load(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([counter.count(x) for x in texts_of(batch)], pa.int64())], names=["doc_id", "n_tokens"])

        return run

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, "doc_id long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
