import random

from strandwork.llm.subjects import Training, labelled, prose_words, subject_areas, train

TERMS = {"Rocks": ["granite", "basalt", "quartz", "magma"], "boats": ["keel", "rudder", "mast", "harbour"], "bread": ["yeast", "dough", "crust", "flour"]}
FILL = "the and with some about when it was never quite there".split()


def text(draw, subjects):
    words = [draw.choice(FILL) for _ in range(12)] + [draw.choice(TERMS[s]) for s in subjects for _ in range(4)]
    draw.shuffle(words)
    return " ".join(words)


def corpus(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        subjects = draw.sample(sorted(TERMS), draw.choice([0, 1, 1, 1, 2]))
        rows.append((i, text(draw, subjects), subjects))
    return rows


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, score int")
    given = spark.createDataFrame(labels, "doc_id long, subject string, rater_id long")
    return docs, spark.createDataFrame([(s,) for s in TERMS] + [(None,)], "subject string"), given


def test_held_out_accuracy(spark):
    rows = corpus(700, 1)
    labels = [(i, draw, 1) for i, _, subjects in rows[:400] for draw in ([f" {s.upper()} " for s in subjects] or [None])]
    labels += labels[:50] + [(90000 + i, "boats", 2) for i in range(500)] + [(99999, "boats", 2), (None, "boats", 2), (5, "no such subject", 3)]
    rows += [(1000, None, []), (1001, "", []), (1002, "```\nkeel rudder mast\n```", [])]
    docs, subjects, given = tables(spark, rows, labels)
    got = {(r[0], r[1]) for r in subject_areas(docs, subjects, given, Training(documents=420, steps=30, parts=2, buckets=4096)).collect()}
    true = {(i, s) for i, _, subjects in rows[400:] for s in subjects}
    got = {x for x in got if x[0] >= 400}
    assert 2 * len(got & true) / (len(got) + len(true)) > 0.95


def test_no_labels_no_documents(spark):
    docs, subjects, given = tables(spark, corpus(5, 2), [])
    few = Training(steps=2, parts=2, buckets=64)
    assert subject_areas(docs, subjects, given, few, least=0.5).count() == 0
    assert subject_areas(docs.where("false"), subjects, given, few).count() == 0


def test_the_number_of_partitions_does_not_matter(spark):
    rows = corpus(60, 3)
    docs, _, given = tables(spark, rows, [(i, s, 1) for i, _, ss in rows for s in ss])
    weights = []
    for parts in (1, 3):
        t = Training(steps=4, parts=parts, buckets=256)
        weights.append(train(labelled(docs, given, sorted(TERMS), t).persist(), len(TERMS), t))
    assert all(abs(a - b).max() < 1e-3 for a, b in zip(*weights))


def test_code_and_markup_are_not_read():
    assert dict(prose_words("    return x; but the mast was never very tall (really)\n    mast mast")) == dict.fromkeys("but the mast was never very tall really".split(), 1)
    assert dict(prose_words("<b>Keel</b> `mast` <pre><code>dough</code></pre>\n    crust\nhttp://a.b/c ke​el")) == {"keel": 2}
