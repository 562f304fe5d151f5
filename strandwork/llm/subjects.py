"""The subject areas of each document, by averaged word and subword embeddings."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.text import spread
from strandwork.shared import Scratch

CODE = re.compile(r"<pre\b.*?</pre>|```.*?(?:```|\Z)|<code\b.*?</code>|`[^`\n]+`", re.S | re.I)
INDENTED = re.compile(r"^(?: {4,}|\t).*$", re.M)
#: Six plain words in a row or more, and what follows them in the line.
PROSE = re.compile(r"(?:[^\W\d_]+(?:[-'’][^\W\d_]+)*[,:]? ){5,}[^\W\d_]+.*$")
MARKUP = re.compile(r"<[^<>]+>|https?://\S+|&#?\w+;")
UNSEEN = re.compile("[­​‌‍⁠﻿]")
WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


@dataclass(frozen=True)
class Training:
    """Of more than `documents` labelled documents, as many are taken, by hash of the id. A step uses all of them."""

    documents: int = 20_000
    steps: int = 34
    rate: float = 0.05
    buckets: int = 1 << 15
    size: int = 16
    subword: int = 5
    parts: int = 8


def prose_words(text: str) -> Counter:
    """The words of `text` in lower case with their counts, without code, markup and addresses.

    Indented lines count as code up to six plain words in a row, if they have that many: line breaks may have been lost.
    """
    prose = INDENTED.sub(lambda line: " " + (found[0] if (found := PROSE.search(line[0])) else ""), CODE.sub(" ", text))
    return Counter(WORD.findall(UNSEEN.sub("", MARKUP.sub(" ", prose)).lower()))


def features(word: str, buckets: int, subword: int) -> list[int]:
    """Buckets of the word itself and, if it is longer than that, of its runs of `subword` letters."""
    marked = f"<{word}>"
    found = [marked]
    if len(marked) > subword + 1:
        found += [f"#{marked[i : i + subword]}" for i in range(len(marked) - subword + 1)]
    return [zlib.crc32(x.encode()) % buckets for x in found]


def average(weights: list[np.ndarray], ids, word_of, share, count, doc_of, docs):
    """Word vectors, word weights, their sum per document, and the documents' weighted averages.

    A word's vector and weight are the means over its buckets; its weight is learned like its vector, so that words
    which say nothing of any subject count for little.
    """
    vectors, _, _, say = weights
    words = len(count)
    v = np.stack([np.bincount(word_of, vectors[ids, k] * share, words) for k in range(vectors.shape[1])], 1)
    w = count * np.exp(np.clip(np.bincount(word_of, say[ids] * share, words), -8, 8))
    total = np.bincount(doc_of, w, docs) + 0.1
    mean = np.stack([np.bincount(doc_of, v[:, k] * w, docs) for k in range(v.shape[1])], 1) / total[:, None]
    return v, w, total, mean


def gradients(weights: list[np.ndarray], ids, sizes, counts, words, target) -> list[np.ndarray]:
    """Summed gradients of the logistic losses of all subjects over some documents."""
    vectors, out, bias, say = weights
    docs = len(words)
    word_of, doc_of = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(docs), words)
    share = (1 / np.maximum(sizes, 1))[word_of]
    v, w, total, mean = average(weights, ids, word_of, share, counts, doc_of, docs)
    wrong = 1 / (1 + np.exp(-(mean @ out + bias))) - target
    back = ((wrong @ out.T) / total[:, None])[doc_of]
    by_vector = back * w[:, None]
    by_weight = ((v - mean[doc_of]) * back).sum(1) * w
    of_vectors = np.stack([np.bincount(ids, by_vector[word_of, k] * share, len(say)) for k in range(vectors.shape[1])], 1)
    return [of_vectors, mean.T @ wrong, wrong.sum(0), np.bincount(ids, by_weight[word_of] * share, len(say))]


def labelled(docs: DataFrame, labels: DataFrame, subjects: list[str], t: Training) -> DataFrame:
    """Features and targets of the labelled documents, in `t.parts` partitions of at most `t.documents` rows in all.

    Labels are compared without case and outer white space; a subject counts if any rater gave it; labels that are
    no subject say that there is none.
    """
    name = F.lower(F.trim("subject"))
    given = labels.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set(name).alias("given"))
    # labels of documents that are not there take no one's place
    known = given.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(t.documents)
    rows = docs.where("text is not null").join(F.broadcast(known), "doc_id")
    rows = rows.repartition(t.parts, "doc_id").sortWithinPartitions("doc_id")
    keys = [s.strip().lower() for s in subjects]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, have in zip(batch["text"], batch["given"]):
                counts = prose_words(text)
                parts = [features(w, t.buckets, t.subword) for w in counts]
                ids = [i for part in parts for i in part]
                out.append((ids, [len(p) for p in parts], [float(n) for n in counts.values()], [float(k in have) for k in keys]))
            yield pd.DataFrame(out, columns=["ids", "sizes", "counts", "target"])

    return rows.select("text", "given").mapInPandas(run, "ids array<int>, sizes array<int>, counts array<float>, target array<float>")


def train(rows: DataFrame, subjects: int, t: Training) -> list[np.ndarray]:
    """The weights after `t.steps` steps. In each, every partition of `rows` sums its gradients and the sums are added up.

    What a partition sends is as large as the weights, so a step moves `t.parts` times `t.buckets` * (`t.size` + 1)
    numbers whatever the corpus.
    """
    spark = rows.sparkSession
    draw = np.random.default_rng(1)
    weights = [draw.normal(0, 0.1, (t.buckets, t.size)), draw.normal(0, 0.3, (t.size, subjects)), np.full(subjects, -2.0), np.zeros(t.buckets)]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    docs = rows.count()
    for step in range(1, t.steps + 1 if docs else 1):
        shared = spark.sparkContext.broadcast([w.astype(np.float32) for w in weights])

        def run(batches):
            import pyarrow as pa

            total = None
            for batch in batches:
                ids, sizes, counts, target = (batch.column(i) for i in range(4))
                flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (ids, sizes, counts, target)]
                words = sizes.value_lengths().to_numpy(zero_copy_only=False)
                sums = gradients(shared.value, *flat[:3], words, flat[3].reshape(len(words), -1))
                total = sums if total is None else [a + b for a, b in zip(total, sums)]
            if total is not None:
                packed = np.concatenate([g.ravel() for g in total]).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["sums"])

        parts = [np.frombuffer(row[0], np.float32).astype(float) for row in rows.mapInArrow(run, "sums binary").collect()]
        shared.destroy()
        flat, at = np.sum(parts, 0) * (10 / docs), 0
        for i, w in enumerate(weights):
            g, at = flat[at : at + w.size].reshape(w.shape), at + w.size
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.98 * second[i] + 0.02 * g * g
            weights[i] = w - t.rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.98**step)) + 1e-7)
    return weights


def score(docs: DataFrame, weights: list[np.ndarray], subjects: list[str], t: Training, least: float) -> DataFrame:
    """(doc_id, subject, score) where the score reaches `least`; every document of `docs` is scored, whole."""
    vectors, out, bias, say = weights
    shared = docs.sparkSession.sparkContext.broadcast([(vectors @ out).astype(np.float32), bias, say.astype(np.float32)])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        votes, bias, say = shared.value
        known: dict[str, tuple[np.ndarray, float]] = {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                sums, total = np.zeros(len(bias)), 0.1
                for word, n in prose_words(text).items():
                    if word not in known:
                        if len(known) > 200_000:
                            known.clear()
                        ids = features(word, t.buckets, t.subword)
                        weight = float(np.exp(np.clip(say[ids].mean(), -8, 8)))
                        known[word] = votes[ids].mean(0) * weight, weight
                    vote, weight = known[word]
                    sums += n * vote
                    total += n * weight
                chance = 1 / (1 + np.exp(-(sums / total + bias)))
                rows += [(doc, subjects[k], float(chance[k])) for k in np.flatnonzero(chance >= least)]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "score"])

    return spread(docs.where("doc_id is not null and text is not null"), "doc_id").mapInPandas(run, f"doc_id {kind}, subject string, score double")


def subject_areas(docs: DataFrame, subjects: DataFrame, labels: DataFrame, t: Training = Training(), least: float = 0.15) -> DataFrame:
    """(doc_id, subject, score): the subject areas of each document, none, one or more.

    `docs` has doc_id and text, `subjects` has subject (a short list, taken to the driver), `labels` has doc_id and
    subject. A text is the average of its words' vectors, each the mean of the vectors of the word and its
    subwords; one logistic output per subject is independent of the others. Code, markup and addresses are not read.

    Without labels nothing is learned and no row comes out; documents with a null id or text, or without a word,
    have no row; labels of unknown documents are ignored, repeated ones count once.
    """
    names = sorted(row[0] for row in subjects.select("subject").dropna().distinct().collect())
    posts = docs.select("doc_id", "text")
    rows = Scratch(docs.sparkSession).keep(labelled(posts, labels.select("doc_id", "subject"), names, t)).persist()
    weights = train(rows, len(names), t)
    rows.unpersist()
    return score(posts, weights, names, t, least)
