"""Texts into containers of a fixed number of tokens."""

from __future__ import annotations

import base64
import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.text import spread
from strandwork.shared import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public vocabulary cuts a text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_pieces(docs: DataFrame, doc_id: str, text: str, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, token_start, tokens): each text as one piece, or as few pieces as can be if it exceeds `capacity`.

    An empty text is a piece of 0 tokens; a null text has no piece. `vocabulary` must be readable on all executors.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoding(vocabulary)
        for batch in batches:
            rows = []
            for doc, body in zip(batch["doc"], batch["body"]):
                size = len(tokens.encode_ordinary(body))
                rows += [(doc, i, at, min(capacity, size - at)) for i, at in enumerate(range(0, max(size, 1), capacity))]
            yield pd.DataFrame(rows, columns=[doc_id, "piece", "token_start", "tokens"])

    rows = spread(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).where("body is not null"), "doc")
    return rows.mapInPandas(count, f"`{doc_id}` {kind}, piece int, token_start int, tokens int")


def best_fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many items of each length come closest to `room` together, of the `counts` there are.

    The sums that can be reached are the bits of a number; taking t items of length l shifts them by l * t.
    What could be reached before each step tells, read backwards, which steps the best sum needs.
    """
    reach, within, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & within
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] += take
    return dict(chosen)


def pack(lengths: list[int], capacity: int) -> list[int]:
    """The container of each item; no container holds more than `capacity`.

    Each container takes the longest item left and what fills the rest best; a filling is repeated as often
    as there are items for it. Items of length 0 go into the first container.
    """
    items: dict[int, list[int]] = defaultdict(list)
    for i, length in enumerate(lengths):
        items[length].append(i)
    where, container = [0] * len(lengths), 0
    items.pop(0, None)
    counts = {length: len(rows) for length, rows in items.items()}
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = best_fill(capacity - longest, {k: n for k, n in counts.items() if n})
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        for _ in range(min(counts[k] // n for k, n in chosen.items())):
            for length, n in chosen.items():
                for _ in range(n):
                    where[items[length].pop()] = container
                counts[length] -= n
            container += 1
        counts = {k: n for k, n in counts.items() if n}
    return where


def fill_containers(pieces: DataFrame, doc_id: str, capacity: int = 2048, per_task: int = 2000, slack: float = 0.01) -> DataFrame:
    """`pieces` of `token_pieces` with the column container: no container exceeds `capacity` tokens, no piece is split.

    The pieces are spread by id over as many tasks as fill about `per_task` containers each, and every task
    packs its own by minimum bin slack. What a task leaves in containers with more than `slack` unused, its last few,
    is taken out and packed again with the leftovers of all others, so little is lost to the split.
    An empty table gives an empty result. The same input gives the same containers.
    """
    scratch = Scratch(pieces.sparkSession)
    kept = scratch.keep(pieces)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", container long, filled int"

    def packed(rows: DataFrame, offset: int) -> tuple[DataFrame, int]:
        tasks = max(1, math.ceil((rows.agg(F.sum("tokens")).first()[0] or 0) / (capacity * per_task)))
        task = F.pmod(F.xxhash64(F.lit(offset), doc_id, "piece"), F.lit(tasks))  # the second time, in other company

        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values([doc_id, "piece"], ignore_index=True)
            number = int(group.pop("task").iloc[0])
            where = pd.Series(pack(group["tokens"].tolist(), capacity), dtype="int64")
            filled = group["tokens"].groupby(where).transform("sum")
            return group.assign(container=where + (offset + number) * (1 << 32), filled=filled)

        return rows.withColumn("task", task).groupBy("task").applyInPandas(one, kinds), offset + tasks

    first, offset = packed(kept, 0)
    first = scratch.keep(first)
    loose = F.col("filled") < capacity * (1 - slack)
    second, _ = packed(first.where(loose).select(kept.columns), offset)
    return first.where(~loose).unionByName(second).drop("filled")
