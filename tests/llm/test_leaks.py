import random

from strandwork.llm.leaks import find_leaks
from strandwork.llm.text import fold, folded_words

WORDS = [a + b for a in ("ka", "mo", "ri", "su", "te", "vo") for b in ("lan", "der", "min", "gat", "pos", "rel", "tun")]


def sentence(seed, n):
    draw = random.Random(seed)
    return [draw.choice(WORDS) for _ in range(n)]


def leaks(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "id long, text string, words int")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "id long, text string, doc string")
    return {(r[0], r[1]): (r[2], r[3], r[4]) for r in find_leaks(d, q, "id", "text", "id", "text", **more).collect()}


def test_folding_and_places():
    assert fold("So‑Called,") == "socalled" and fold("Ｆｕｌｌ") == "full" and fold("Éa­s​y") == "easy"
    text = "> <i>One</i> &amp; tw​o"
    assert [(w, text[a:b]) for w, a, b in folded_words(text)] == [("one", "One"), ("two", "tw​o")]


def test_runs_of_every_length_and_kind(spark):
    item = sentence(1, 40)
    spoiled = item[5:30]
    spoiled[6], spoiled[14] = "changed", "other"
    added = item[:12] + ["more"] + item[12:24]
    left_out = item[:9] + item[10:25]
    docs = [
        (1, "before " + " ".join(item[3:21]) + " after"),
        (2, " ".join(item[3:20])),
        (3, "x " + " ".join(spoiled)),
        (4, " ".join(added)),
        (5, " ".join(left_out).upper()),
        (6, "".join(f"// {w},\n" for w in item[:20])),
        (7, "<p>" + " ".join(f"**{w[0]}​{w[1:]}**" for w in item[:20]) + "</p>"),
        (8, " ".join(item[:10]) + " this is not it at all " + " ".join(item[10:20])),
        (9, None),
        (10, ""),
        (11, "word " * 50_000 + " ".join(item)),
    ]
    items = [(77, " ".join(item)), (77, " ".join(item)), (78, None), (79, ""), (80, "too short"), (81, " ".join(sentence(2, 30)))]
    got = leaks(spark, docs, items)
    assert {d for d, i in got} == {1, 3, 4, 5, 6, 7, 11} and {i for d, i in got} == {77}
    words, start, end = got[1, 77]
    assert words == 18 and docs[0][1][start:end] == " ".join(item[3:21])
    assert got[3, 77][0] == 25 and got[11, 77][0] == 40


def test_blocks_give_the_same(spark):
    items = [(i, " ".join(sentence(i, 30))) for i in range(12)]
    docs = [(100 + i, "see " + " ".join(sentence(i, 30)[4:28])) for i in range(0, 12, 2)]
    one, many = leaks(spark, docs, items), leaks(spark, docs, items, block_bytes=400)
    assert one == many and set(one) == {(100 + i, i) for i in range(0, 12, 2)}


def test_the_driver_holds_one_block_at_a_time(spark, monkeypatch):
    """Each block of items is gone from the tasks before the next one is taken."""
    held, sizes = [], []
    plain = type(spark.sparkContext).broadcast

    def counted(self, value):
        assert not held
        sizes.append(len(value))
        shared = plain(self, value)
        held.append(shared)
        destroy = shared.destroy
        shared.destroy = lambda *a: (held.clear(), destroy(*a))
        return shared

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    items = [(i, " ".join(sentence(i, 30))) for i in range(40)]
    docs = [(100 + i, "see " + " ".join(sentence(i, 30)[4:28])) for i in range(0, 40, 4)]
    assert len(leaks(spark, docs, items, block_bytes=1200)) == 10
    assert len(sizes) > 3 and sum(sizes) == 40 and max(sizes) < 25


def test_empty_tables(spark):
    assert leaks(spark, [], [(1, "a b c")]) == {} and leaks(spark, [(1, "a b c")], []) == {}
