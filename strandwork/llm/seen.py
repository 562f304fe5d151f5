"""Whether a key was seen before, in an order of records, without holding the earlier keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChainSettings:
    """A chain's first layer holds `first_capacity` keys, each later one `growth` times as many as the one before.

    Layer i answers wrongly at a rate of at most `error` * (1 - tightening) * tightening ** i when full, so
    the rates of all layers, however many, add up to less than `error`.
    """

    error: float = 0.001
    first_capacity: int = 1 << 14
    growth: int = 2
    tightening: float = 0.5


@dataclass
class BloomChain:
    """A Bloom filter that grows by layers. Keys are pairs of 64-bit hashes, in numpy arrays."""

    settings: ChainSettings
    layers: list[np.ndarray] = field(default_factory=list)
    probes: list[int] = field(default_factory=list)
    room: int = 0

    def bound(self) -> float:
        """The compounded bound on wrong answers of the layers so far."""
        s = self.settings
        return sum(s.error * (1 - s.tightening) * s.tightening**i for i in range(len(self.layers)))

    def _grow(self) -> None:
        s, i = self.settings, len(self.layers)
        self.room = s.first_capacity * s.growth**i
        rate = s.error * (1 - s.tightening) * s.tightening**i
        bits = int(np.ceil(self.room * -np.log(rate) / np.log(2) ** 2))
        self.layers.append(np.zeros(bits // 64 + 1, np.uint64))
        self.probes.append(max(1, int(np.ceil(-np.log2(rate)))))

    @staticmethod
    def _places(words: np.ndarray, probe: int, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (one + np.uint64(probe) * (two | np.uint64(1))) % np.uint64(len(words) * 64)
        return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def holds(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """For each key whether the chain may hold it; False is always right."""
        out = np.zeros(len(one), bool)
        for words, probes in zip(self.layers, self.probes):
            left = np.flatnonzero(~out)
            for probe in range(probes):
                if not len(left):
                    break
                word, bit = self._places(words, probe, one[left], two[left])
                left = left[(words[word] & bit) != 0]
            out[left] = True
        return out

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        """Take in different keys; a layer that has its number of keys is closed and a larger, stricter one begun."""
        while len(one):
            if not self.room:
                self._grow()
            n = min(self.room, len(one))
            words = self.layers[-1]
            for probe in range(self.probes[-1]):
                word, bit = self._places(words, probe, one[:n], two[:n])
                np.bitwise_or.at(words, word, bit)
            self.room -= n
            one, two = one[n:], two[n:]


def _first_of_each(one: np.ndarray, two: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each row the index of the row with the same key that comes first in `order` (the least, ties by place)."""
    by = np.lexsort((order, two, one))
    new = np.ones(len(by), bool)
    new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
    first = np.empty(len(by), np.int64)
    first[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    return first


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, one, two = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    return order, one.view(np.uint64), two.view(np.uint64)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, the first record of every key goes on to the chains; later ones are surely repeats."""
    for batch in batches:
        order, one, two = _columns(batch)
        first = _first_of_each(one, two, order)
        repeat = order > order[first]
        keep = repeat | (first == np.arange(len(order)))  # else a record that was delivered again
        out = [order[keep], one[keep].view(np.int64), two[keep].view(np.int64), repeat[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["order", "one", "two", "sure"])


def _answer(settings: ChainSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = BloomChain(settings), None
        for batch in batches:
            order, one, two = _columns(batch)
            sure = batch.column(3).to_numpy(zero_copy_only=False)
            again = np.zeros(len(order), bool)  # the record before, delivered once more
            again[1:] = (order[1:] == order[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            again[:1] = last == (order[0], one[0], two[0]) if len(order) else False
            last = (order[-1], one[-1], two[-1]) if len(order) else last
            order, one, two, sure = (x[~again] for x in (order, one, two, sure))
            seen = sure.copy()
            rows = np.flatnonzero(~sure)
            first = _first_of_each(one[rows], two[rows], order[rows])
            fresh = first == np.arange(len(rows))
            held = np.zeros(len(rows), bool)
            held[fresh] = chain.holds(one[rows[fresh]], two[rows[fresh]])
            new = rows[fresh & ~held]
            chain.add(one[new], two[new])
            seen[rows] = held | (~fresh & (order[rows] > order[rows][first])) | held[first]
            out = [order, one.view(np.int64), two.view(np.int64), sure, seen, np.full(len(order), chain.bound())]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["order", "one", "two", "sure", "seen", "bound"])

    return run


def seen_before(df: DataFrame, order: str, key: Column, settings: ChainSettings = ChainSettings()) -> DataFrame:
    """(order, one, two, sure, seen, bound): for each record whether a record before it in `order` had its key.

    `order` is a LONG, unique to a record; a record may be delivered more than once. Keys become two 64-bit
    hashes. First each chunk of a partition is combined: only the first record of a key per chunk goes to the
    chains, all others are repeats for sure (`sure`) and stay out of the way, so a key that has a third of all
    records does not fill one partition. The rest is shuffled by key, sorted by `order`, and each partition is
    answered by one scalable Bloom chain that holds bits, not keys. `seen` = false is always right; true is
    wrong at a rate of at most `bound` (< `settings.error`) as history grows.

    Left out: rows whose order or key is null. A record may have several rows, one a delivery, whose `seen`
    can be combined by max. An empty table gives an empty result; other columns are not read.
    """
    # as a list of one, so that the key is made once a row and not again for each of its uses
    rows = df.select(F.col(order).cast("long").alias("order"), F.explode(F.array(key)).alias("key")).where("`order` is not null and key is not null")
    rows = rows.select("order", F.xxhash64("key").alias("one"), F.xxhash64(F.lit(1), "key").alias("two"))
    kinds = "order long, one long, two long, sure boolean"
    chunks = rows.mapInArrow(_combine, kinds)
    route = F.when(F.col("sure"), F.xxhash64("order")).otherwise(F.col("one"))
    placed = chunks.repartition(route).sortWithinPartitions("order", "one", "two", "sure")
    return placed.mapInArrow(_answer(settings), kinds + ", seen boolean, bound double")


def with_truth(answers: DataFrame) -> DataFrame:
    """`answers` of `seen_before` and the exact answer `repeat`, by the least order of each key; `sure` rows need none."""
    key = Window.partitionBy("one", "two", F.when(F.col("sure"), F.col("order")))
    first = F.min("order").over(key)
    return answers.withColumn("repeat", F.col("sure") | (F.col("order") > first))
