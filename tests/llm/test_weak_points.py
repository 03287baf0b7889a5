"""What earlier rounds left open: mixed texts, repeated ids, features where graded documents are rare."""

import random

from millrace.llm import common, line_rules, severity

SMALL = "/root/testdata/sf0.1"


def test_boilerplate_inside_content_is_marked(spark):
    """Blocks of 1, 2, 4 and 8 lines of rejected documents, put into accepted ones, against the same blocks alone."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = line_rules.fit(docs, labels)
    rows = docs.join(labels, "doc_id").select("text", "quality").collect()
    lines = {q: [[f for f, _ in line_rules.lines_of((r["text"] or "").encode())] for r in rows if r["quality"] == q] for q in (0, 1)}
    good, bad = [x for x in lines[1] if len(x) >= 12], [x for x in lines[0] if len(x) >= 8]

    def marked(found):
        return line_rules.viterbi([sum(model["weights"][k] for k in f) for f in found], model["moves"])

    draw = random.Random(1)
    assert sum(sum(marked(x)) for x in good) < 0.01 * sum(map(len, good))
    for size in (1, 2, 4, 8):
        inside = alone = outside = 0
        for _ in range(300):
            text, other = draw.choice(good), draw.choice(bad)
            low, at = draw.randrange(len(other) - size + 1), draw.randrange(2, len(text) - 1)
            block = other[low:low + size]
            labels_in = marked(text[:at] + block + text[at:])
            inside += sum(labels_in[at:at + size])
            outside += sum(labels_in) - sum(labels_in[at:at + size])
            alone += sum(marked(block))
        assert inside >= 0.7 * alone and outside < 0.01 * 300 * 12, size


def test_a_repeated_id_is_drawn_in_part(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(3_000)] + [(7, "text 1")] * 50 + [(8, "x")], "_id LONG, text STRING")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "_id LONG, label INT")
    assert 40 <= common.drawn(docs, labels, 100).count() <= 200
    assert common.drawn(docs, labels, 10_000).count() == 3_001


def test_mild_words_count_where_graded_documents_are_rare(spark):
    """A word in 8 of 10 graded documents and in 12 of 600 others tells, though most texts that hold it are clean."""
    rows = [(k, "plain text " + ("mildly " if k < 8 or 20 <= k < 32 else "") + f"w{k}", int(k < 10)) for k in range(610)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id LONG, grade INT")
    assert b"mildly" in severity.fit(docs, labels)["names"]


def test_a_memo_keeps_what_is_asked_for():
    made = []
    memo = common.Memo(lambda k: made.append(k) or k * 2, 10)
    for k in range(1_000):
        assert memo[k] == 2 * k and memo[3] == 6
        assert len(memo) + len(memo.former) <= 11
    assert made.count(3) == 1 and len(made) == 1_000


def test_training_on_one_class():
    assert line_rules.mixed([(0, [[0]]), (0, [[0, 1]])]) == []
    assert set(line_rules.train([])["moves"]) == {0.0}
