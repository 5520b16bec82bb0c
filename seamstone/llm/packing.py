"""Filling fixed-capacity containers with texts (problem 7).

Method: best-fit decreasing with a segment tree over remaining capacities.

Texts are sized once, in tokens of a public tokenizer.  A text larger than the
capacity is cut into full pieces, one container each, and a rest.  What is to
be packed is spread by hash over blocks of a bounded number of tokens and
items; each block is packed by itself, so no task holds more than a block and
a block leaves about one container that is not full.  With thousands of
containers in a block that loss is below a thousandth.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamstone.sources.checkpoints import cut_lineage

#: Folder of the public vocabulary files, and the file that sizes are taken in.
TOKENIZERS = os.environ.get("SEAMSTONE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's authors split text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A block holds about so many containers, and at most so many items.
BLOCK_CONTAINERS = 4_000
BLOCK_ITEMS = 200_000
#: Characters encoded at once; longer texts are cut at white space or line ends.
_ENCODE_CHARS = 100_000


class CapacityTree:
    """Open containers by remaining capacity; the tightest fit is found in logarithmic time.

    The leaf of capacity ``c`` stacks the containers with ``c`` left; an inner
    node counts the containers below it.
    """

    def __init__(self, capacity: int) -> None:
        self.base = 1 << max(1, capacity).bit_length()
        self.count = [0] * (2 * self.base)
        self.stacks: dict[int, list[int]] = {}

    def add(self, left: int, container: int) -> None:
        self.stacks.setdefault(left, []).append(container)
        node = self.base + left
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least ``size`` with an open container."""
        node, count = self.base + size, self.count
        if count[node]:
            return size
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.base:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.base
            node >>= 1
        return None

    def take(self, left: int) -> int:
        node = self.base + left
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.stacks[left].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number of every item; sizes must be between 0 and ``capacity``."""
    tree, where, opened = CapacityTree(capacity), [0] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        left = tree.tightest(sizes[k])
        if left is None:
            left, where[k], opened = capacity, opened, opened + 1
        else:
            where[k] = tree.take(left)
        tree.add(left - sizes[k], where[k])
    return where


@functools.lru_cache(maxsize=4)
def load_encoding(path: str | None = None):
    """The tokenizer of a vocabulary file of ranks."""
    import tiktoken

    with open(path or os.path.join(TOKENIZERS, VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("seamstone", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(encoding, text: str | None) -> int:
    """Tokens of a text; very long texts are encoded in parts that begin at white space."""
    if not text:
        return 0
    n, at = 0, 0
    while at < len(text):
        till = at + _ENCODE_CHARS
        if till < len(text):
            cut = max(text.rfind(" ", at + 1, till), text.rfind("\n", at + 1, till))
            till = cut if cut > at else till
        n += len(encoding.encode_ordinary(text[at:till]))
        at = till
    return n


def token_sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col, n_tokens`` of every row; null and empty texts have none."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = documents.schema[id_col].dataType
    arrow = pa.schema([(id_col, to_arrow_type(id_type)), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(vocabulary)
        for batch in batches:
            sizes = [token_count(encoding, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], schema=arrow)

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, n_tokens BIGINT")


def pack(sizes: DataFrame, limits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Assign every item to containers of each limit.

    ``sizes`` has ``id_col`` and n_tokens, ``limits`` limit_id and
    capacity_tokens (a short list, read by the driver; at most 1000).  Returns
    ``limit_id, container, id_col, piece, start_token, n_tokens``: one row per
    piece; only items above the capacity have more than one.  Repeated rows
    are items of their own, a null or negative size counts as 0 and still gets
    a place, limits with a null or no positive capacity are left out, and an
    empty table gives no rows.
    """
    caps = [(r[0], r[1]) for r in limits.where("capacity_tokens > 0").select("limit_id", "capacity_tokens").limit(1001).collect()]
    if len(caps) > 1000:
        raise ValueError("more than 1000 limits")
    id_type = sizes.schema[id_col].dataType.simpleString()
    items = cut_lineage(sizes.select(F.col(id_col), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("_row")))
    tokens, rows = items.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = lambda cap: max(1, -(-tokens // (cap * BLOCK_CONTAINERS)), -(-rows // BLOCK_ITEMS))
    # all limits in one pass: an item is a row for each of them
    each = F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(cap).cast("long").alias("cap"), F.lit(blocks(cap)).cast("long").alias("blocks")) for i, cap in caps] or [F.lit(None).cast("struct<limit_id:int,cap:bigint,blocks:bigint>")])
    asked = items.select(id_col, "_row", "n_tokens", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("l")).select(id_col, "_row", "n_tokens", "l.*")
    cap, n = F.col("cap"), F.col("n_tokens")
    last = F.greatest(F.ceil(n / cap) - 1, F.lit(0)).cast("int")
    # pieces that fill a container are there at once; only the rest of an item is packed
    columns = ["limit_id", "container", id_col, "piece", "start_token", "n_tokens"]
    full = asked.where(n >= cap).select("*", F.explode(F.sequence(F.lit(0), F.floor(n / cap).cast("int") - 1)).alias("piece"))
    full = full.select("limit_id", F.concat_ws("-", F.lit("full"), "_row", "piece").alias("container"), id_col, "piece", (F.col("piece") * cap).cast("long").alias("start_token"), cap.alias("n_tokens"))
    rest = asked.where((n % cap > 0) | (n == 0)).select("limit_id", id_col, "_row", "cap", "blocks", last.alias("piece"), (last * cap).cast("long").alias("start_token"), (n - last * cap).cast("long").alias("n_tokens"))
    # the row keeps repeated ids apart; it is read from the checkpoint, so a task that runs again gets the same
    placed = rest.withColumn("block", F.pmod(F.xxhash64(id_col, "piece", "_row"), F.col("blocks"))).drop("_row", "blocks")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", id_col, "piece"], kind="stable")
        where = best_fit_decreasing(pdf["n_tokens"].tolist(), int(pdf["cap"].iloc[0]))
        pdf["container"] = [f"{b}-{w}" for b, w in zip(pdf["block"], where)]
        return pdf[columns]

    packed = placed.groupBy("limit_id", "block").applyInPandas(fill, f"limit_id INT, container STRING, `{id_col}` {id_type}, piece INT, start_token BIGINT, n_tokens BIGINT")
    return packed.unionByName(full)


def packing_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """``limit_id, containers, tokens, fill`` of every limit."""
    per = packed.groupBy("limit_id").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return per.join(limits.select("limit_id", "capacity_tokens"), "limit_id").select(
        "limit_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill")
    )


def packing_integrity(packed: DataFrame, sizes: DataFrame, limits: DataFrame, id_col: str = "doc_id", least_fill: float = 0.95) -> DataFrame:
    """``limit_id, items, overfull, split, incomplete, well_filled`` of every limit.

    How many items are placed, containers hold more than their capacity, items
    that fit one container are split, and items are not placed whole; and
    whether the containers are filled to ``least_fill`` or are as few as their
    tokens allow.  Ids must be unique.
    """
    cap = limits.select(F.col("limit_id").cast("int").alias("limit_id"), F.col("capacity_tokens").alias("cap"))
    containers = packed.groupBy("limit_id", "container").agg(F.sum("n_tokens").alias("held")).join(cap, "limit_id")
    full = containers.groupBy("limit_id").agg(F.count_if(F.col("held") > F.col("cap")).alias("overfull"), F.count(F.lit(1)).alias("n"), F.sum("held").alias("held"), F.max("cap").alias("cap"))
    filled = (F.col("held") >= F.col("n") * F.col("cap") * F.lit(least_fill)) | (F.col("n") <= F.ceil(F.col("held") / F.col("cap")))
    whole = packed.groupBy("limit_id", id_col).agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces")).join(sizes.select(id_col, F.coalesce("n_tokens", F.lit(0)).alias("size")), id_col).join(cap, "limit_id")
    items = whole.groupBy("limit_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if((F.col("size") <= F.col("cap")) & (F.col("pieces") > 1)).alias("split"), F.count_if(F.col("placed") != F.col("size")).alias("incomplete"),
    )
    return items.join(full, "limit_id").select("limit_id", "items", "overfull", "split", "incomplete", filled.alias("well_filled"))
