"""Best-fit packing of tokenized documents into fixed-length sequences (operator 5).

Documents longer than a sequence are cut into whole sequences and a rest; nothing else is cut.
The pieces are packed by bulk-synchronous best fit, in a few classes: those of which one fills a
sequence at most, then two, and so on, then all shorter ones. In supersteps the pieces of a class and the
gaps are sorted by range (size, pieces before gaps) and swept together: reading upwards, a piece waits
until the nearest gap that holds it comes, and a gap takes the largest piece that waits. As with brackets,
piece and gap belong together if they stand next to each other at the same level, where the level counts the
pieces less the gaps up to there. So the conflict of many pieces for one gap is settled by rank: the
ranks come from row numbers inside salted shares of a size and a prefix sum over the shares' counts,
and one shuffle by level brings the partners together. Gaps are then updated and the sweep is repeated
until nothing fits; what is left opens new sequences. A gap that holds several of the longest pieces
left is dealt into as many slots. The driver sees only how many pieces, tokens and gaps are left.

A level has at most two rows of a size, a sequence at most capacity pieces; a size that many pieces have is numbered
in up to MOST_SHARES tasks, and the one sorted prefix sum runs over the shares' counts (two for each size and share). Null and empty texts are one piece that holds only the
end id; very long texts are cut into many pieces, in one row each. Rows that repeat are packed once
each, and ties of length go by a row number. An empty table gives an empty result. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.llm.common import arrow_map, kept, scratch_path, stored, table

CAPACITY = 2048
#: Items for which there is one more share of each size, the most shares, and the classes before the shortest pieces.
SHARE, MOST_SHARES, CLASSES = 500_000, 128, 4
#: Entries of a worker's memo of runs of text, and the longest run it takes. A full memo stays as it is: common runs come early.
MEMO, LONGEST = 250_000, 64
#: Runs that the tokenizer is given at once; its encodings are much larger than the ids.
AT_ONCE = 2000
#: The pieces into which the public tokenizer splits (fixed value), and the same for plain runs in lower case: printable
#: ASCII and the Latin letters up to U+024F but U+0130, which have one lower-case letter each and compose with nothing here.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^0-9{LATIN}]+")
PLAIN = re.compile(f"[!-@\\[-~{LATIN}]+")
#: ASCII characters that are neither letters nor digits. After an ASCII letter or digit, those at a run's end are a piece of their own.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """ids as little-endian 32-bit bytes. The tokenizer never joins across ASCII white space, so runs between it are kept in a memo."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        splits = [x["pattern"].get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if splits == [SPLIT] and spec["model"].get("end_of_word_suffix") == "</w>":
            self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        # Words of a to z in lower case are pieces as they stand: nothing to compose, lower, split or map.
        self.bare = Tokenizer(self.tokenizer.model)  # the same model, not a copy
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _ids(self, texts: list[str], tokenizer=None) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """The ids of runs. Plain ones are encoded in one text: each of their pieces ends with a token that has the word's end."""
        words, plain, rest = [], [], []
        split = bool(self.ends.any())
        for x in runs:
            if split and x.isalpha() and x.islower():
                words.append(x)
                continue
            text = x.decode("utf-8", "replace")
            (plain if split and PLAIN.fullmatch(text) and "<|" not in text else rest).append((x, text))
        out: dict[bytes, bytes] = {}

        def together(part: list[bytes], text: str, last: np.ndarray, tokenizer) -> bool:
            raw = self._ids([text], tokenizer)[0]
            stops = np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1
            if len(stops) != last[-1]:
                return False
            at = 0
            for x, stop in zip(part, (4 * stops[last - 1]).tolist()):
                out[x] = raw[at:stop]
                at = stop
            return True

        for k in range(0, len(words), AT_ONCE):
            part = words[k : k + AT_ONCE]
            if not together(part, b" ".join(part).decode("ascii"), np.arange(1, len(part) + 1), self.bare):
                rest += [(x, x.decode("ascii")) for x in part]
        for k in range(0, len(plain), AT_ONCE):
            part = plain[k : k + AT_ONCE]
            last = np.cumsum([1 if text.isalpha() else len(PIECE.findall(text)) for _, text in part])
            if not together([x for x, _ in part], " ".join([text for _, text in part]), last, self.tokenizer):
                rest += part
        for k in range(0, len(rest), AT_ONCE):
            part = rest[k : k + AT_ONCE]
            out.update(zip([x for x, _ in part], self._ids([text for _, text in part])))
        return out

    def _known(self, runs: list[bytes]) -> list[bytes]:
        """The ids of distinct runs. Of a run with marks at its end that is not in the memo, the run before them and the marks are looked up."""
        memo, split = self.memo, bool(self.ends.any())
        out = list(map(memo.get, runs))
        whole, cuts, fresh = [], [], {}
        for i in [i for i, ids in enumerate(out) if ids is None]:
            x = runs[i]
            head = x.rstrip(MARKS)
            if len(head) < len(x) and head[-1:].isalnum() and split and b"<|" not in x:
                marks = x[len(head) :]
                one, two = memo.get(head), memo.get(marks)
                if one is None:
                    fresh[head] = None
                if two is None:
                    fresh[marks] = None
                cuts.append((i, head, marks, one, two))
            else:
                fresh[x] = None
                whole.append(i)
        fresh = self._encoded(list(fresh))
        for i in whole:
            out[i] = fresh[runs[i]]
        for i, head, marks, one, two in cuts:
            out[i] = (one or fresh[head]) + (two or fresh[marks])
        if len(memo) < MEMO:
            memo.update((x, ids) for x, ids in islice(fresh.items(), MEMO - len(memo)) if len(x) <= LONGEST)
            memo.update((runs[i], out[i]) for i, *_ in cuts[: MEMO - len(memo)] if len(runs[i]) <= LONGEST)
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Runs are looked up in lower case, as the tokenizer lowers all. It composes before that, so where a mark follows that

        an ASCII letter may be composed with (U+0300 to U+033F, lead byte CC) only ASCII runs are; texts that may hold its special tokens stay as they are.
        Runs are cut, numbered and put together again by Arrow; Python sees each distinct one once."""
        lower = [x if b"<|" in x else x.lower() if b"\xcc" not in x else b" ".join([r.lower() if r.isascii() else r for r in x.split()]) for x in texts]
        whole = pa.array(lower, pa.large_binary())
        runs = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(whole), *whole.buffers()[1:]))
        coded = runs.values.dictionary_encode()
        ids = pa.array(self._known(_items(coded.dictionary)), pa.large_binary()).take(coded.indices)
        return _items(ids, runs.offsets.to_numpy())


def _items(column: pa.Array, at: np.ndarray | None = None) -> list[bytes]:
    """The bytes of a large column's items, or of the spans of items between the places at."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    places = (ends if at is None else ends[at]).tolist()
    view = (data or pa.py_buffer(b"")).to_pybytes()
    return [view[a:b] for a, b in zip(places, places[1:])]


def load(path: str) -> WordBpe:
    return kept(("packing", path), lambda: WordBpe(path))


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for): every document's ids and the end id 0, cut only where longer than capacity."""
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def make():
        bpe = load(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in names]
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode([x or b"" for x in batch.column(1).to_pylist()])):
                ids += b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    row = (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), own)
                    for column, value in zip(out, row):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)

        return run

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as binary) text"), make, schema)


def _standing(items: DataFrame, sizes: list[Column], sign: Column, shares: int) -> DataFrame:
    """Add _row, from 1 inside a share of a size, and _before, the sum of signs of all shares before it; sizes order the items."""
    names = [f"_s{i}" for i in range(len(sizes))]
    salted = items.withColumns({n: c for n, c in zip(names, sizes)} | {"_sign": sign, "_share": F.pmod(F.xxhash64("_id"), F.lit(shares)).cast("int")})
    before = Window.orderBy(*names, "_share").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(*names, "_share").agg(F.sum("_sign").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    rows = salted.withColumn("_row", F.row_number().over(Window.partitionBy(*names, "_share").orderBy("_id", "sequence_id")))
    return rows.join(F.broadcast(counts), [*names, "_share"])  # at most two rows for each possible size and share


def _opened(left: DataFrame, many: int, deep: int, first: int, shares: int = 1) -> DataFrame:
    """left with sequence_id (from first on) for the many longest pieces, deep of them in each; null for the others."""
    rank = F.col("_before") + F.col("_row") - 1
    ranked = _standing(left.withColumn("sequence_id", F.lit(0)), [-F.col("length")], F.lit(1), shares)
    none = F.lit(None).cast("long")
    return ranked.select(*left.columns, F.when(rank < many, F.floor(rank / deep) + first).alias("sequence_id"), none.alias("_gap"), none.alias("_taken"))


def sweep(left: DataFrame, gaps: DataFrame, longest: int, most_slots: int, shares: int = 1) -> DataFrame:
    """One superstep. Rows of left with sequence_id where a gap takes them, and rows of gaps (_gap not null) with _taken."""
    own = [c for c in left.columns if c != "_id"]
    deep = F.least(F.greatest(F.floor(F.col("_gap") / longest), F.lit(1)), F.lit(most_slots)).cast("int")
    slots = gaps.withColumn("_deep", deep).withColumn("_id", F.explode(F.sequence(F.lit(1), F.col("_deep")))).select(
        *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own], F.xxhash64("sequence_id", "_id").alias("_id"),
        "sequence_id", "_gap", F.floor(F.col("_gap") / F.col("_deep")).alias("_size"),
    )
    none = F.lit(None).cast("long")
    items = left.select(*own, "_id", none.alias("sequence_id"), none.alias("_gap"), F.col("length").alias("_size")).unionByName(slots)
    is_gap = F.col("_gap").isNotNull()
    ranked = _standing(items, [F.col("_size"), is_gap], F.when(is_gap, -1).otherwise(1), shares)
    level = F.when(is_gap, F.col("_before") - F.col("_row") + 1).otherwise(F.col("_before") + F.col("_row"))
    there = Window.partitionBy("_level").orderBy("_size", "_s1", "_share", "_row")
    met = ranked.withColumn("_level", level).withColumns({"_to": F.lead("sequence_id").over(there), "_taken": F.lag("length").over(there)})
    # beside a piece stands a gap or nothing, as steps up and down take turns at a level
    return met.select(*own, "_id", F.when(is_gap, F.col("sequence_id")).otherwise(F.col("_to")).alias("sequence_id"), "_gap", F.when(is_gap, F.coalesce("_taken", F.lit(0))).alias("_taken"))


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """Add sequence_id and offset to rows with a length from 1 to capacity."""
    names = pieces.columns
    state = stored(pieces.withColumn("length", F.col("length").cast("long")).withColumn("_id", F.monotonically_increasing_id()), "pieces")
    figures = [F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.min("length"), F.max("length")]
    of_class = F.least(F.floor(F.lit(capacity) / F.col("length")), F.lit(classes + 1)).cast("int")
    start = {r[0]: r[1:] for r in state.groupBy(of_class).agg(*figures).collect()}
    if any(k is None or not 1 <= low <= high <= capacity for k, (_, _, low, high) in start.items()):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    spark = pieces.sparkSession
    steps = scratch_path(spark, "pieces-steps")
    kind = StructType([*state.schema.fields, *(StructField(c, LongType()) for c in ("sequence_id", "_gap", "_taken"))])
    gaps: DataFrame | None = None
    opened, turn = 0, 0
    shares = lambda n: min(MOST_SHARES, 1 + (n + opened) // SHARE)

    def step(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Write a superstep's rows to its own folder of steps; what they are now, and the pieces that are left."""
        nonlocal turn
        now = stored(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields]), "", f"{steps}/_turn={turn}")
        turn += 1
        return now, now.filter("length is not null and sequence_id is null").select(*state.columns)

    for k in sorted(start):
        left, (n, tokens, least, longest) = state.filter(of_class == k), start[k]
        while n:
            before = n + 1
            while gaps is not None and 0 < n < before:
                room = gaps.filter(F.col("_gap") >= least).count()
                if not room:
                    break
                now, left = step(sweep(left, gaps, longest, 1 + 2 * n // room, shares(n)))
                gaps = now.filter("_gap is not null").groupBy("sequence_id").agg((F.max("_gap") - F.sum("_taken")).alias("_gap")).filter("_gap > 0")
                before = n
                n, tokens, least, longest = left.agg(*figures).first()
            if n:
                whole = k <= classes  # any k of these pieces fill a sequence; of the shortest, as many open one as are needed at least
                many, deep = (n, k) if whole else (min(n, -(-tokens // capacity)), 1)
                now, left = step(_opened(left, many, deep, opened, shares(n)))
                opened += -(-many // deep)
                fresh = now.filter("sequence_id is not null").groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("_gap")).filter("_gap > 0")
                gaps = fresh if gaps is None else gaps.unionByName(fresh)
                n, tokens, least, longest = left.agg(*figures).first()
    if not turn:
        return state.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    every = spark.read.schema(StructType([*kind.fields, StructField("_turn", IntegerType())])).parquet(steps).filter("length is not null and sequence_id is not null")
    ahead = Window.partitionBy("sequence_id").orderBy("_turn", "_id").rowsBetween(Window.unboundedPreceding, -1)
    return every.select(*names, "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize once (the pieces are stored, not their ids) and pack them."""
    return best_fit_pack(pieces_of(docs, tokenizer, capacity), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
