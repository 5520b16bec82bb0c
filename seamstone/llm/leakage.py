"""Evaluation passages inside a training corpus (problem 8).

Method: prefix-filtered set join on word shingles.

1. Every item's shingles (by word position) are hashed to 64 bits.  One pass
   over the corpus counts in how many documents each occurs: its rarity.
2. Per item the positions are ordered by rarity.  A document that holds at
   least ``min_share`` of the item's words in stretches of ``width`` words or
   more matches ``least = ceil(need / width)`` positions or more, so it
   matches ``d`` of the first ``positions - least + d``: the item's prefix of
   depth ``d``.  A second pass joins the prefix shingles only; the length bound
   drops documents that are too short, the positional bound those whose
   matches in the prefix and all positions behind it are fewer than ``least``.
3. Candidates are verified word by word: the stretches of the document are
   compared with the item's words as text, so equal hashes of different
   shingles cost time but make no rows.

Tasks know shingles by a Bloom filter whose bits are made by an aggregation and
bounded by ``FILTER_BITS``; a full filter lets more pass to the join and loses
nothing.  The plan is the same at every size.  Documents that hold no prefix
shingle never leave their scan task, the others leave it as their matching
stretches only.  Joins on a shingle or an item are salted by the document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seamstone.functions.arrowmap import OUT_ROWS, map_rows, to_batch
from seamstone.sources.checkpoints import cut_lineage

#: Most bits of a Bloom filter (32 MB), bits a shingle below that, and bits set for each shingle.
FILTER_BITS = 1 << 28
BITS_EACH = 12
HASHES = 3
#: Parts that the documents of a hot shingle or item are spread over.
SALTS = 16
#: Matches asked for in an item's prefix, where it needs as many.
DEPTH = 2
#: Words whose hashes a task keeps.
_WORD_MEMORY = 1_000_000
_WORD = re.compile(r"\w+")
_MULTIPLIER = 0x9E3779B97F4A7C15


def words_in(text: str | None) -> list[str]:
    """Lower-case words; punctuation and layout are left out."""
    return _WORD.findall(text.lower()) if text else []


def passage_in(text: str | None, instruction_lines: int = 1) -> str:
    """An item's passage: what follows its first ``instruction_lines`` lines."""
    for _ in range(instruction_lines):
        text = text.partition("\n")[2] if text else ""
    return text or ""


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


class ShingleHasher:
    """64-bit hashes of the shingles of word lists."""

    def __init__(self, width: int) -> None:
        self.width, self.words = width, _WordHashes()
        self.powers = np.array([pow(_MULTIPLIER, k, 1 << 64) for k in range(width)], np.uint64)

    def of(self, words: list[str]) -> np.ndarray:
        """The hash of the shingle at every position, as signed numbers."""
        n = len(words) - self.width + 1
        if n <= 0:
            return np.empty(0, np.int64)
        if len(self.words) > _WORD_MEMORY:
            self.words.clear()
        ids = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        out = ids[:n] * self.powers[0]
        for k in range(1, self.width):
            out += ids[k : k + n] * self.powers[k]
        out ^= out >> np.uint64(31)
        out *= np.uint64(_MULTIPLIER)
        return out.view(np.int64)


class Filter:
    """Bloom filter over 64-bit hashes; the k-th bit of a hash is taken from other bits of it."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        found = np.ones(len(h), bool)
        for k in range(HASHES):
            at = (h >> np.uint64(_SHIFTS[k])) & self.mask
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


_SHIFTS = (0, 18, 36)


def make_filter(hashes: DataFrame, n: int) -> Filter:
    """The filter of the column ``hash``; ``n`` is about how many hashes there are.

    Bits are set by an aggregation over the filter's words.  What reaches the
    driver is the filter, at most FILTER_BITS whatever ``n`` is.
    """
    size = min(FILTER_BITS, max(1 << 16, 1 << (BITS_EACH * n).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned("hash", k).bitwiseAND(F.lit(size - 1)) for k in _SHIFTS])).alias("at")
    bit = F.expr("shiftleft(1L, CAST(at & 63L AS INT))")
    set_words = hashes.select(at).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[set_words.column("w").to_numpy()] = set_words.column("b").to_numpy()
    return Filter(words.view(np.uint64))


def item_shingles(items: DataFrame, width: int = 6, instruction_lines: int = 1) -> DataFrame:
    """``item_id, n_words, pos, hash`` of every item's passage."""
    id_type = items.schema["item_id"].dataType
    schema = pa.schema([("item_id", to_arrow_type(id_type)), ("n_words", pa.int32()), ("pos", pa.int32()), ("hash", pa.int64())])

    def make() -> Callable:
        hasher = ShingleHasher(width)

        def call(item_id, text):
            words = words_in(passage_in(text, instruction_lines))
            return ((item_id, len(words), pos, h) for pos, h in enumerate(hasher.of(words).tolist()))

        return call

    return map_rows(items.where(F.col("item_id").isNotNull()), ["item_id", "text"], make, f"item_id {id_type.simpleString()}, n_words INT, pos INT, hash BIGINT", schema)


def document_counts(documents: DataFrame, known: Filter, width: int) -> DataFrame:
    """``hash, df``: in how many rows of documents each shingle of a filter occurs, counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, held = ShingleHasher(width), [], 0

        def counted() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(n, pa.int64())], names=["hash", "df"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                hashes = hasher.of(words_in(text))
                found = np.unique(hashes[known.holds(hashes)])
                if len(found):
                    parts.append(found)
                    held += len(found)
                if held > 1_000_000:
                    yield counted()
                    held = 0
        if parts:
            yield counted()

    return documents.select("text").mapInArrow(run, "hash BIGINT, df BIGINT").groupBy("hash").agg(F.sum("df").alias("df"))


def prefix_of(vocabulary: DataFrame, rarity: DataFrame, width: int, min_share: float) -> DataFrame:
    """``item_id, hash, least, n_pos, behind, repeats``: the positions of every item's prefix, rarest first."""
    # an item's positions fit one task: a passage is a single text
    by_rarity = Window.partitionBy("item_id").orderBy("df", "hash", "pos")
    least = F.ceil(F.ceil(F.col("n_words") * F.lit(min_share)) / F.lit(width)).cast("int")
    repeats = F.max("same").over(Window.partitionBy("item_id"))
    ranked = (
        vocabulary.join(rarity, "hash", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("rank", F.row_number().over(by_rarity))
        .withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("item_id", "hash")))
        .withColumn("repeats", repeats)
        .withColumn("least", least)
        .withColumn("n_pos", F.col("n_words") - F.lit(width - 1))
    )
    depth = F.least(F.lit(DEPTH), F.col("least"))
    length = F.least(F.col("n_pos"), F.col("n_pos") - F.col("least") + depth)
    return ranked.where(F.col("rank") <= length).select("item_id", "hash", "least", "n_pos", (F.col("n_pos") - length).alias("behind"), "repeats")


def stretches(documents: DataFrame, prefix: Filter, every: Filter, width: int) -> DataFrame:
    """``doc_id, doc_words, hashes, runs`` of the documents that hold a prefix shingle.

    ``hashes`` are their prefix shingles, ``runs`` the stretches (words joined
    by blanks) whose shingles all are items' shingles.
    """
    id_type = documents.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("doc_words", pa.int32()), ("hashes", pa.list_(pa.int64())), ("runs", pa.list_(pa.string()))])

    def make() -> Callable:
        hasher = ShingleHasher(width)

        def call(doc_id, text):
            words = words_in(text)
            hashes = hasher.of(words)
            first = hashes[prefix.holds(hashes)]
            if not len(first):
                return
            at = np.nonzero(every.holds(hashes))[0]
            runs = [" ".join(words[r[0] : r[-1] + width]) for r in np.split(at, np.nonzero(np.diff(at) > 1)[0] + 1)]
            yield doc_id, len(words), np.unique(first).tolist(), list(dict.fromkeys(runs))

        return call

    return map_rows(documents, ["doc_id", "text"], make, f"doc_id {id_type.simpleString()}, doc_words INT, hashes ARRAY<BIGINT>, runs ARRAY<STRING>", schema)


def covered_words(words: list[str], runs: list[str], width: int) -> tuple[int, int]:
    """(words of a passage that stand in the runs in stretches of ``width`` or more, most of them in one run)."""
    shingles: dict[tuple[str, ...], list[int]] = {}
    for pos in range(len(words) - width + 1):
        shingles.setdefault(tuple(words[pos : pos + width]), []).append(pos)
    total, most = np.zeros(len(words), bool), 0
    for run in runs:
        found, here = run.split(" "), np.zeros(len(words), bool)
        for i in range(len(found) - width + 1):
            for pos in shingles.get(tuple(found[i : i + width]), ()):
                here[pos : pos + width] = True
        most = max(most, int(here.sum()))
        total |= here
    return int(total.sum()), most


def leaked_items(documents: DataFrame, items: DataFrame, width: int = 6, min_share: float = 0.5, instruction_lines: int = 1) -> DataFrame:
    """``doc_id, item_id, n_words, n_covered, n_longest`` of every document and item it leaks.

    ``n_covered`` words of the passage stand in the document in unbroken
    stretches of ``width`` words or more, ``n_longest`` of them in a single
    stretch.  ``documents`` has doc_id and text, ``items`` item_id and text;
    the first ``instruction_lines`` lines of an item are no passage (0: the
    whole text is).  Null and short texts hold nothing, items whose passage is
    shorter than ``width`` words cannot leak, repeated rows of a document or
    item count once, and an empty table gives no rows.  Other columns are
    ignored.
    """
    vocabulary = cut_lineage(item_shingles(items, width, instruction_lines).distinct())
    n = vocabulary.count()
    every = make_filter(vocabulary, n)
    prefix = cut_lineage(prefix_of(vocabulary, document_counts(documents, every, width), width, min_share))
    held = cut_lineage(stretches(documents, make_filter(prefix, n), every, width).distinct())

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    candidates = (
        held.select("doc_id", "doc_words", salt, F.explode("hashes").alias("hash"))
        .join(salted(prefix), ["hash", "salt"])
        .where((F.col("doc_words") - F.lit(width - 1)) * F.col("repeats") >= F.col("least"))
        .groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("matches"), F.max("least").alias("least"), F.max("behind").alias("behind"))
        .where(F.col("matches") + F.col("behind") >= F.col("least"))
        .select("doc_id", "item_id")
    )
    passages = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.col("text").alias("item_text")).distinct()
    pairs = held.select("doc_id", "runs").join(candidates, "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(salted(passages), ["item_id", "salt"])
    doc_type, item_type = documents.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(doc_type)), ("item_id", to_arrow_type(item_type)), ("n_words", pa.int32()), ("n_covered", pa.int32()), ("n_longest", pa.int32())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            values = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for (item_id, text), some in groupby(values, key=lambda r: (r[1], r[2])):
                words = words_in(passage_in(text, instruction_lines))
                for doc_id, _, _, runs in some:
                    covered, longest = covered_words(words, runs, width)
                    if covered and covered >= len(words) * min_share:
                        rows.append((doc_id, item_id, len(words), covered, longest))
            if len(rows) >= OUT_ROWS:
                yield to_batch(rows, schema)
                rows = []
        if rows:
            yield to_batch(rows, schema)

    found = pairs.select("doc_id", "item_id", "item_text", "runs").mapInArrow(verify, f"doc_id {doc_type.simpleString()}, item_id {item_type.simpleString()}, n_words INT, n_covered INT, n_longest INT")
    # rows of one document with different texts count once
    best = F.max(F.struct("n_covered", "n_words", "n_longest")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_words", "b.n_covered", "b.n_longest")
