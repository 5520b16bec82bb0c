"""Fingerprints and vector search: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that go to the executors at once; more queries are more passes.
QUERY_BLOCK = 2_000
#: Characters or vector elements of the queries of a block; a longer query is a block of its own.
QUERY_BLOCK_SIZE = 8_000_000
_WORD_CACHE = 200_000
#: Parts that a weight is rounded to.
_PARTS = 1_000_000


class Fingerprinter:
    """128-bit SimHash of word counts; hashed words are kept up to a bound."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.signs = np.empty((1_024, 128), np.int32)

    def _row(self, word: str) -> int:
        row = self.rows[word] = len(self.rows)
        if row == len(self.signs):
            self.signs = np.concatenate((self.signs, np.empty_like(self.signs)))
        bits = np.unpackbits(np.frombuffer(hashlib.sha256(word.encode()).digest()[:16], np.uint8))
        self.signs[row] = bits.astype(np.int32) * 2 - 1
        return row

    def of(self, text: str | None, stable: float | None = None, chaos: float = 0.0) -> bytes:
        """16 bytes, most significant bit first; with ``stable`` long and short words weigh by it and by ``chaos``."""
        # whole numbers: the order of a sum of fractions would decide ties
        long, short = (1, 1) if stable is None else (round((1 + stable * 0.2) * _PARTS), round((1 - chaos * 0.3) * _PARTS))
        other = 1 if stable is None else _PARTS
        counts = Counter((text or "").lower().split())
        if len(self.rows) + len(counts) > _WORD_CACHE:
            self.rows.clear()
        get = self.rows.get
        at = [row if (row := get(word)) is not None else self._row(word) for word in counts]
        weights = np.fromiter((n * (long if len(word) > 5 else short if len(word) < 4 else other) for word, n in counts.items()), np.int64, len(counts))
        total = weights @ self.signs[at] if at else np.zeros(128, np.int64)
        return np.packbits(total > 0).tobytes()


def simhash(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, hi, lo``: the fingerprint as two signed halves.  Null and empty texts have 0."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = df.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(id_type)), ("hi", pa.int64()), ("lo", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter()
        for batch in batches:
            raw = b"".join(maker.of(t) for t in batch.column(1).to_pylist())
            halves = np.frombuffer(raw, ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves[:, 0], pa.int64()), pa.array(halves[:, 1], pa.int64())], schema=schema)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, hi BIGINT, lo BIGINT")


def weighted_simhash(df: DataFrame, id_col: str, text_col: str, stable: float = 1.0, chaos: float = 0.0) -> DataFrame:
    """``id_col, hi, lo, score, state``: the fingerprint with words weighted as in ``weighted_score``, beside that score.

    Texts that are null have no row, those without words a fingerprint of 0.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = df.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(id_type)), ("hi", pa.int64()), ("lo", pa.int64()), ("score", pa.float64()), ("state", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter()
        for batch in batches:
            raw = b"".join(maker.of(t, stable, chaos) for t in batch.column(1).to_pylist())
            halves = np.frombuffer(raw, ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves[:, 0], pa.int64()), pa.array(halves[:, 1], pa.int64()), batch.column(2), batch.column(3)], schema=schema)

    scored = df.where(F.col(text_col).isNotNull()).select(id_col, text_col, *_weighted(text_col, stable, chaos))
    return scored.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, hi BIGINT, lo BIGINT, score DOUBLE, state STRING")


def weighted_score(df: DataFrame, id_col: str, text_col: str, stable: float = 1.0, chaos: float = 0.0) -> DataFrame:
    """``id_col, score, state`` of the weighted fingerprint: mean word weight (capped at 2) by half.

    Words of more than five letters weigh a fifth of ``stable`` more, words of
    fewer than four three tenths of ``chaos`` less.  A text without words is
    SLEEPING with score 0.
    """
    return df.where(F.col(text_col).isNotNull()).select(id_col, *_weighted(text_col, stable, chaos))


def _weighted(text_col: str, stable: float, chaos: float) -> tuple[Column, Column]:
    words = F.filter(F.split(F.lower(text_col), r"(?U)\s+"), lambda w: w != "")
    count = lambda keep: F.size(F.filter(words, keep)).cast("double")
    long, short, n = count(lambda w: F.length(w) > 5), count(lambda w: F.length(w) < 4), F.size(words).cast("double")
    # whole counts first: the order of a sum of weights would decide the last digits
    mean = (long * (1.0 + stable * 0.2) + short * (1.0 - chaos * 0.3) + (n - long - short)) / F.nullif(n, F.lit(0.0))
    score = F.coalesce(F.least(mean, F.lit(2.0)) / 2, F.lit(0.0))
    return score.alias("score"), F.when(mean.isNull(), "SLEEPING").when(mean < 0.5, "WEAK").otherwise("STABLE").alias("state")


def similarity_percent(hi1, lo1, hi2, lo2):
    """Share of equal bits of two fingerprints, in percent (Columns)."""
    return 100.0 - (F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))) / F.lit(128.0) * 100.0


def _blocks(queries: DataFrame, columns: list[str]) -> Iterator[list]:
    """The queries in blocks of bounded size, streamed to the driver."""
    block: list = []
    size = 0
    for row in queries.select(*columns).toLocalIterator(prefetchPartitions=False):
        block.append(tuple(row))
        size += len(row[1] or ())
        if len(block) >= QUERY_BLOCK or size >= QUERY_BLOCK_SIZE:
            yield block
            block, size = [], 0
    if block:
        yield block


def _best(found: DataFrame | None, k: int | None, order: list) -> DataFrame | None:
    if found is None or k is None:
        return found
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def hybrid_search(queries: DataFrame, corpus: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 70.0) -> DataFrame:
    """``query_id, id, similarity, simhash_score, keyword_score`` of the best ``k`` rows of each query.

    Six tenths fingerprint similarity and four tenths share of the query's
    distinct words; a query finds other rows only.  Every corpus task keeps its
    best ``k`` of a query, so what is shuffled is bounded by queries, tasks and
    ``k``.
    """
    out = None
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64()), ("simhash_score", pa.float64()), ("keyword_score", pa.float64())])
    for block in _blocks(queries.where(F.col(id_col).isNotNull()), [id_col, text_col]):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            maker = Fingerprinter()
            q_ids = np.array([b[0] for b in block])
            q_hi, q_lo = np.frombuffer(b"".join(maker.of(b[1]) for b in block), np.uint64).reshape(-1, 2).T.copy()
            q_words = [set((b[1] or "").lower().split()) for b in block]
            sizes = np.array([max(1, len(w)) for w in q_words], float)
            postings: dict[str, list[int]] = {}
            for n, ws in enumerate(q_words):
                for w in ws:
                    postings.setdefault(w, []).append(n)
            lists = {w: np.array(p) for w, p in postings.items()}
            best = [[] for _ in block]
            for batch in batches:
                for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if row_id is None:
                        continue
                    hi, lo = np.frombuffer(maker.of(text), np.uint64)
                    structural = 100.0 - (np.bitwise_count(q_hi ^ hi) + np.bitwise_count(q_lo ^ lo)) / 128.0 * 100.0
                    overlap = np.zeros(len(block))
                    for w in set((text or "").lower().split()):
                        at = lists.get(w)
                        if at is not None:
                            overlap[at] += 1
                    keyword = overlap / sizes * 100
                    score = structural * 0.6 + keyword * 0.4
                    for n in np.nonzero((score >= threshold) & (q_ids != row_id))[0]:
                        mine = best[n]
                        mine.append((-score[n], row_id, structural[n], keyword[n]))
                        if len(mine) > 8 * k:
                            mine.sort()
                            del mine[k:]
            rows = [(int(q_ids[n]), r[1], -float(r[0]), float(r[2]), float(r[3])) for n, mine in enumerate(best) for r in sorted(mine)[:k]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        part = corpus.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "query_id BIGINT, id BIGINT, similarity DOUBLE, simhash_score DOUBLE, keyword_score DOUBLE")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], "query_id BIGINT, id BIGINT, similarity DOUBLE, simhash_score DOUBLE, keyword_score DOUBLE")
    return _best(out, k, [F.desc("similarity"), F.asc("id")])


def focus_projection(queries: DataFrame, corpus: DataFrame, id_col: str, vec_col: str, threshold: float = 0.8, signed: bool = False) -> DataFrame:
    """``query_id, id, cos2`` of the rows whose squared cosine with a query exceeds ``threshold`` squared.

    Compared without roots.  Null, empty and zero vectors and other lengths
    match nothing; opposite directions match unless ``signed``; a query finds
    other rows only.
    """
    out = None
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("cos2", pa.float64())])
    for block in _blocks(queries.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)), [id_col, vec_col]):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for size in {len(b[1]) for b in block}:
                some = [b for b in block if len(b[1]) == size]
                by_size[size] = (np.array([b[0] for b in some]), np.array([b[1] for b in some], np.float64))
            for batch in batches:
                rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v]
                for size, (q_ids, q) in by_size.items():
                    same = [(i, v) for i, v in rows if len(v) == size]
                    if not same:
                        continue
                    ids, vecs = np.array([i for i, _ in same]), np.array([v for _, v in same], np.float64)
                    dot, norm = q @ vecs.T, (q**2).sum(1)[:, None] * (vecs**2).sum(1)[None, :]
                    hit = (dot * dot > threshold * threshold * norm) & (norm > 0) & (q_ids[:, None] != ids[None, :])
                    if signed:
                        hit &= dot > 0
                    a, b = np.nonzero(hit)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[a], pa.int64()), pa.array(ids[b], pa.int64()), pa.array((dot * dot)[a, b] / norm[a, b], pa.float64())], schema=schema)

        part = corpus.select(F.col(id_col).cast("long"), vec_col).mapInArrow(run, "query_id BIGINT, id BIGINT, cos2 DOUBLE")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else corpus.sparkSession.createDataFrame([], "query_id BIGINT, id BIGINT, cos2 DOUBLE")


#: Parts that the rows of a hot element are spread over.
SALTS = 8


def set_cosine(queries: DataFrame, corpus: DataFrame, id_col: str, set_col: str, floor: float = 0.1, k: int = 10) -> DataFrame:
    """``query_id, id, similarity``: cosine of binary vectors, common / sqrt(sizes), above ``floor``; best ``k`` other rows.

    A prefix-filtered join: elements are ordered by rarity, and a query looks
    for rows of a size class (powers of two) only by its first elements, as
    many as a row of that class has to share one of to come above the floor.
    So an element that very many rows hold is looked up for small sets only;
    its rows are salted.  Candidates are verified on the whole sets.  Null
    elements do not count, null and empty sets are similar to nothing.
    """
    sets = lambda df, name: df.select(F.col(id_col).alias(name), F.array_distinct(F.filter(set_col, lambda x: x.isNotNull())).alias("s")).where((F.size("s") > 0) & F.col(name).isNotNull())
    left, right = sets(queries, "query_id"), sets(corpus, "id")
    size_class = lambda n: F.floor(F.log2(n.cast("double"))).cast("int")
    rows = right.select("id", F.size("s").alias("n2"), F.explode("s").alias("element")).select("id", "element", size_class(F.col("n2")).alias("class"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    rarity = rows.groupBy("element").agg(F.count(F.lit(1)).alias("df"))
    asked = left.select("query_id", F.size("s").alias("n1"), F.explode("s").alias("element")).join(rarity, "element", "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "element"))
    ranked = asked.withColumn("place", place).where(F.col("df").isNotNull())
    # sizes that can come above the floor lie between n1 * floor^2 and n1 / floor^2
    low, high = F.greatest(F.lit(0), size_class(F.greatest(F.lit(1.0), F.col("n1") * floor**2))), size_class(F.col("n1") / floor**2 + 1)
    # at the least size of the class, and a little less for what rounding lifts above the floor
    needed = F.greatest(F.lit(1), F.ceil(floor * F.sqrt(F.col("n1") * F.pow(F.lit(2.0), F.col("class"))) - 0.001))
    probes = ranked.select("*", F.explode(F.sequence(low, high)).alias("class")).where(F.col("place") <= F.col("n1") - needed + 1)
    salted = probes.select("query_id", "element", "class", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    pairs = salted.join(rows, ["element", "class", "salt"]).where(F.col("query_id") != F.col("id")).select("query_id", "id").distinct()
    whole = pairs.join(left.withColumnRenamed("s", "s1"), "query_id").join(right.withColumnRenamed("s", "s2"), "id")
    common = F.size(F.array_intersect("s1", "s2"))
    similarity = F.round(common / F.sqrt(F.size("s1").cast("double") * F.size("s2")), 6)
    return _best(whole.select("query_id", "id", similarity.alias("similarity")).where(F.col("similarity") > floor), k, [F.desc("similarity"), F.asc("id")])
