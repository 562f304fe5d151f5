"""Passages of test items inside a corpus."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.text import folded_words, spread
from strandwork.shared import Scratch

FOLDED = "words array<string>, begins array<int>, ends array<int>"


def run_after(words: list[str], i: int, joined: str, at: int) -> tuple[int, int]:
    """Where `words` from `i` on stop to agree with `joined` from `at` on."""
    while i < len(words) and joined.startswith(words[i], at):
        at += len(words[i])
        i += 1
    return i, at


def follow(words: list[str], i: int, joined: str, at: int, starts: list[int], behind: int = 2) -> tuple[int, int, int]:
    """As `run_after`, past single words that were changed, added or left out, if `behind` words agree after each.

    The third number is how many words that were.
    """
    edits = 0
    i, at = run_after(words, i, joined, at)
    while i < len(words) and at < len(joined):
        after = starts[bisect_right(starts, at)]  # the text's next word
        tries = (run_after(words, j, joined, p) + (j,) for j, p in ((i + 1, after), (i, after), (i + 1, at)))
        n, reached, j = max(tries, key=lambda t: t[0] - t[2])
        if n - j < behind:
            break
        i, at, edits = n, reached, edits + 1
    return i, at, edits


class ItemIndex:
    """One automaton of all runs of `seed_words` words of the items, and of the same read backwards to follow a run."""

    def __init__(self, items: list[tuple[object, str]], seed_words: int) -> None:
        self.ids = [item_id for item_id, _ in items]
        self.words = [[w for w, _, _ in folded_words(text)] for _, text in items]
        self.backwards = [[w[::-1] for w in reversed(words)] for words in self.words]
        self.starts = [list(accumulate(map(len, words), initial=0)) for words in self.words]
        seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, words in enumerate(self.words):
            for at in range(len(words) - seed_words + 1):
                seeds["".join(words[at : at + seed_words])].append((item, at))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        if seeds:
            self.automaton.make_automaton()

    def matches(self, found: list[str], begins: list[int], ends: list[int], min_words: int) -> Iterator[tuple[object, int, int, int]]:
        """(item id, words, start, end) of the longest run of each item in a text, if it has `min_words` words or more.

        The text is given by its folded words and where each begins and ends. They are joined without gaps, so a hyphen, a
        line break or a mark inside a word makes no difference. From a seed the run is followed both ways. Start and end
        are places in the text.
        """
        if not len(self.automaton) or not len(found):
            return
        joined, starts = "".join(found), list(accumulate(map(len, found), initial=0))
        reverse = back_starts = None
        best: dict[int, tuple[int, int, int]] = {}
        within: dict[tuple[int, int], int] = {}  # (item, place of its first word in the text): end of the run known there
        for last, (size, places) in self.automaton.iter(joined):
            at = last + 1 - size
            for item, word in places:
                words, first = self.words[item], at - self.starts[item][word]
                if within.get((item, first), -1) > at:
                    continue
                upto, end, after = follow(words, word, joined, at, starts)
                if reverse is None:
                    reverse, back_starts = joined[::-1], [len(joined) - s for s in reversed(starts)]
                n, back, before = follow(self.backwards[item], len(words) - word, reverse, len(joined) - at, back_starts)
                begin = len(joined) - back
                within[item, first] = run_after(words, word, joined, at)[1]
                count = upto - (len(words) - n)
                if count >= min_words and count > best.get(item, (0,))[0]:
                    best[item] = (count, begin, end)
        for item, (count, begin, end) in best.items():
            yield self.ids[item], count, begins[bisect_right(starts, begin) - 1], ends[bisect_left(starts, end) - 1]


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, min_words: int = 18, seed_words: int = 4, block_bytes: int = 1 << 21
) -> DataFrame:
    """(doc_id, item_id, words, start, end): each document and item that share a run of `min_words` words of the item.

    Words are compared without case, punctuation, markup, invisible characters and variant forms; single words
    that were changed, added or left out do not end a run. If both ids have the same name, that of the item gets
    the prefix item_. Documents are folded once, whole, and scanned by one automaton of all items. Items beyond
    `block_bytes` of text are taken in blocks of about that size, one after the other: the folded documents and each
    block's result are stored, so that neither the driver nor a task ever holds more than one block.

    Of several runs of an item in a document the longest counts, the first of equals. `start` and `end` are places in the
    document's own text. A run is found by any `seed_words` words in a row that are as in the item; one whose changes leave
    no such place is missed.

    A null id or text matches nothing, nor does an item of fewer than `min_words` words; items that are
    delivered again count once; ids need not be numbers. Other columns of both tables are not read.
    """
    spark = docs.sparkSession
    item_name = item_id if item_id != doc_id else f"item_{item_id}"
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("words")).dropna().dropDuplicates()
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("words"))).first()[0] or 0) / block_bytes))
    posts = spread(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).dropna(), "doc")
    kinds = {"doc": posts.schema["doc"].dataType.simpleString(), "item": asked.schema["item"].dataType.simpleString()}
    schema = f"`{doc_id}` {kinds['doc']}, `{item_name}` {kinds['item']}, words int, start int, end int"
    names = [doc_id, item_name, "words", "start", "end"]

    def taken(block: int):
        """The items of one block, about `block_bytes` of text, for all tasks."""
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        return spark.sparkContext.broadcast([tuple(row) for row in rows])

    if blocks == 1:
        return posts.mapInPandas(scanner(taken(0), names, min_words, seed_words, fold=True), schema)
    scratch, out = Scratch(spark), None
    folded = scratch.keep(posts.mapInPandas(fold_all, f"doc {kinds['doc']}, {FOLDED}"))
    for block in range(blocks):
        held = taken(block)
        part = scratch.keep(folded.mapInPandas(scanner(held, names, min_words, seed_words, fold=False), schema))
        held.destroy()
        out = part if out is None else out.unionByName(part)
    scratch.drop(folded)
    return out


def folded_rows(batch: pd.DataFrame) -> Iterator[tuple]:
    """(doc, words, begins, ends) of each document."""
    for doc, body in zip(batch["doc"], batch["body"]):
        yield doc, *(tuple(zip(*folded_words(body))) or ((), (), ()))


def fold_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(doc, *map(list, found)) for doc, *found in folded_rows(batch)], columns=["doc", "words", "begins", "ends"])


def scanner(items, names: list[str], min_words: int, seed_words: int, fold: bool):
    """What each task does with its documents; `items` is a broadcast."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = ItemIndex(items.value, seed_words)
        for batch in batches:
            texts = folded_rows(batch) if fold else zip(batch["doc"], batch["words"], batch["begins"], batch["ends"])
            rows = [(doc, *match) for doc, words, begins, ends in texts for match in index.matches(words, begins, ends, min_words)]
            yield pd.DataFrame(rows, columns=names)

    return scan
