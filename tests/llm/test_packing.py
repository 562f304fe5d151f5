import itertools
import random

import pytest

from strandwork.llm.packing import VOCABULARY, best_fill, encoding, fill_containers, pack, token_pieces


def test_best_fill_is_the_best():
    draw = random.Random(4)
    for _ in range(200):
        counts = {draw.randrange(1, 30): draw.randrange(1, 4) for _ in range(5)}
        room = draw.randrange(0, 60)
        sums = {sum(x * n for x, n in zip(counts, ns)) for ns in itertools.product(*(range(c + 1) for c in counts.values()))}
        chosen = best_fill(room, counts)
        assert all(n <= counts[x] for x, n in chosen.items())
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("lengths", [[], [0], [0, 5, 0], [10] * 7, [3, 3, 4, 6, 7, 7, 10, 1]])
def test_pack_keeps_to_the_capacity(lengths):
    where = pack(lengths, 10)
    filled = {}
    for c, n in zip(where, lengths):
        filled[c] = filled.get(c, 0) + n
    assert len(where) == len(lengths) and all(n <= 10 for n in filled.values())


def first_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms[at] -= n
    return len(rooms)


def test_pack_leaves_less_than_first_fit():
    draw = random.Random(8)
    lengths = [draw.randrange(1, 900) for _ in range(3000)]
    assert max(pack(lengths, 2048)) + 1 <= first_fit_decreasing(lengths, 2048)
    assert max(pack(lengths, 2048)) + 1 <= sum(lengths) / 2048 + 1


def test_containers_of_texts(spark):
    draw = random.Random(6)
    texts = [" ".join(draw.choice(["gene", "read", "contig", "é", "<b>"]) for _ in range(draw.randrange(1, 90))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "word " * 1500)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id long, text string, piece int, container string")
    pieces = token_pieces(df, "id", "text", 128).toPandas()
    tokens = encoding(VOCABULARY)
    sizes = {i: len(tokens.encode_ordinary(t)) for i, t in rows if t is not None}
    assert pieces.groupby("id").tokens.sum().to_dict() == sizes
    assert (pieces.groupby("id").size() == [max(1, -(-sizes[i] // 128)) for i in sorted(sizes)]).all()
    placed = fill_containers(token_pieces(df, "id", "text", 128), "id", 128, per_task=20)
    once, twice = placed.toPandas(), fill_containers(token_pieces(df, "id", "text", 128), "id", 128, per_task=20).toPandas()
    assert sorted(zip(once.id, once.piece)) == sorted(zip(pieces.id, pieces.piece))
    filled = once.groupby("container").tokens.sum()
    tasks = -(-sum(sizes.values()) // (128 * 20))  # the split costs at most a container a task
    assert filled.max() <= 128 and len(filled) <= first_fit_decreasing(pieces.tokens, 128) + tasks
    assert sorted(map(tuple, once.values)) == sorted(map(tuple, twice.values))


def test_no_texts(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert fill_containers(token_pieces(df, "id", "text", 128), "id", 128).count() == 0
