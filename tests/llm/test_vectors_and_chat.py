"""Operators 11 to 13 against plain Python, on random, awkward, repeated and hot rows."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from checks.compare import connect, differences
from millrace.llm import chat, hard_negatives, vector_codes
from millrace.llm.queries import ODD_TEXT, ORACLES, QUERIES

VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, leaf STRING, n STRING, vec STRING, codes STRING"
LOG = "conv_id LONG, seq LONG, message LONG, kind STRING, role STRING, text STRING, block STRING, low STRING, cut STRING"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "w", "x", "y", "z") for r in rows], VECTORS)


def clusters(seed, rows, width, centres, noise):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, width))
    at = draw.integers(0, centres, rows)
    return (middle[at] + noise * draw.normal(size=(rows, width))).astype(np.float32), at


ODD_ROWS = [(None, [0.5] * 4, 1), (900, None, 1), (901, [0.1, None, 0.2, 0.3], 1), (902, [float("nan")] * 4, 2),
            (903, [float("inf"), 0.0, 0.0, 0.0], 2), (904, [0.25, -0.25, 0.5, 1.0], None), (905, [], 1), (906, [3.0], 2),
            (950, [0.5, 0.5, 0.5, 0.5], 1), (950, [0.5, 0.5, 0.5, 0.5], 1), (951, [0.5, 0.5, 0.5, 0.5], 1),
            (952, [0.5, 0.5, 0.5, 0.0], 2), (953, [0.5, 0.5, 0.5, 0.0], 2), (954, [1e30, 0.0, 0.0, 0.0], 3)]


# -- operator 11 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("entries,width,spread", [(256, 16, 900), (256, 3, 4), (64, 1, 9), (1, 5, 9), (65, 2, 10 ** 8)])
def test_nearest_entry_by_masks(entries, width, spread):
    draw = np.random.default_rng(entries)
    book = vector_codes.Book(draw.integers(-spread, spread, (entries, width)))
    x = np.concatenate([draw.integers(-2 * spread, 2 * spread, (400, width)), book.entries])
    found, distance = book.nearest(x)
    every = ((x[:, None, :] - book.entries[None]) ** 2).sum(2)
    assert (found == every.argmin(1)).all() and (distance == every.min(1)).all()
    near = np.unpackbits(book.candidates(x, np.ceil(np.sqrt(every.min(1))).astype(np.int64)).view(np.uint8), axis=1, bitorder="little")
    assert near[np.arange(len(x)), found].all()


def coded(rows, parts, entries, rounds, scale):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max(len(r[1]) for r in kept) // parts))
    vecs = [[min(max(math.floor(scale * float(np.float32(x))), -2 ** 27), 2 ** 27) for x in r[1]] for r in kept]
    vecs = [v + [0] * (parts * width - len(v)) for v in vecs]
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for v in vecs]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            met = defaultdict(list)
            for v in cut:
                met[nearest(p, v[p])[1]].append(v[p])
            books[p] = [tuple(sum(c) // len(c) for c in zip(*met[k])) if k in met else e for k, e in enumerate(books[p])]
    found = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    total = defaultdict(int)
    for r, f in zip(kept, found):
        total[r[2]] += sum(d for d, _ in f)
    return [(r[0], bytes(k for _, k in f).hex(), sum(d for d, _ in f), total[r[2]]) for r, f in zip(kept, found)]


def key(row):
    return [(x is None, x or 0) if not isinstance(x, str) else x for x in row]


def test_codes_equal_plain_python(spark):
    x, at = clusters(3, 300, 8, 9, 0.2)
    rows = [(k, v.tolist(), None if k % 11 == 0 else int(a)) for k, (v, a) in enumerate(zip(x, at))]
    rows += ODD_ROWS + rows[:3]
    table = vectors(spark, rows)
    books = vector_codes.fit(table, parts=4, entries=24, rounds=3)
    found = vector_codes.with_label_errors(vector_codes.encode(table, books)).collect()
    got = sorted([(r["vec_id"], bytes(r["codes"]).hex(), r["error"], r["label_error"]) for r in found], key=key)
    assert got == sorted(coded(rows, 4, 24, 3, 1024), key=key)
    near = {r["vec_id"]: r["vec"] for r in vector_codes.decode(vector_codes.encode(table, books), books).collect()}
    for k, v in enumerate(x):
        error = next(r["error"] for r in found if r["vec_id"] == k)
        assert sum((math.floor(1024 * float(a)) - round(1024 * b)) ** 2 for a, b in zip(v, near[k])) == error


def test_codes_of_empty_tables(spark):
    empty = vectors(spark, [])
    for table in (empty, vectors(spark, [(1, None, 1), (2, [None], 2)])):
        books = vector_codes.fit(table)
        assert vector_codes.with_label_errors(vector_codes.encode(table, books)).count() == 0
        assert books.digest() == hashlib.sha256(b"").hexdigest()


# -- operator 12 -------------------------------------------------------------------------------------------


def folded(rows):
    """The log of one conversation, event by event."""
    order = {k: i for i, k in enumerate(chat.KINDS)}
    state = {}
    known = {r for r in rows if r[1] is not None and r[2] is not None and r[3] in order}
    for _, _, message, kind, role, text in sorted(known, key=lambda r: (r[1], order[r[3]], r[4] or "", r[5] or "")):
        old_role, old = state.get(message, (None, ""))
        if kind == "regenerate":
            state = {m: s for m, s in state.items() if m < message}
        new = {"message": text or "", "edit": text or "", "delta": old + (text or ""), "regenerate": ""}[kind]
        state[message] = (old_role if role is None else role, new)
    return [(role or "", text) for _, (role, text) in sorted(state.items())]


def test_log_equals_a_plain_fold(spark):
    draw, rows = random.Random(12), []
    texts = ["a", "<turn x>", "</turn>", "\\", "\\l", "\n", "", None, "日本", "\\### Assistant: </turn> ok", "\\b<", "|"]
    for conv in [None, *range(60)]:
        seq = 0
        for _ in range(draw.randint(1, 40)):
            seq += draw.choice([1, 1, 1, 3, 50])
            kind = draw.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "other", None])
            role = draw.choice(["user", "assistant", "system", "a>b<c\\", None]) if kind == "message" else None
            rows.append((conv, seq, draw.randint(1, 5), kind, role, draw.choice(texts)))
            rows += [rows[-1]] * (draw.random() < 0.2)
        rows += [(conv, None, 1, "delta", None, "x"), (conv, 7, None, "delta", None, "y")]
    want = {c: folded([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    draw.shuffle(rows)
    log = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], LOG)
    for block in (1, 4, 4_096):
        done = chat.format_log(log, block).select(
            "*", chat.read_turns(chat.F.col("formatted")).alias("turns"), chat.read_loss(chat.F.col("segments")).alias("said"))
        found = {r["conv_id"]: r for r in done.collect()}
        assert {c: [tuple(t) for t in r["turns"]] for c, r in found.items()} == {c: w for c, w in want.items() if w}
        for c, r in found.items():
            assert r["said"] == "".join(t for role, t in want[c] if role == "assistant")
            assert r["formatted"] == "".join(s["text"] for s in r["segments"])
            assert r["formatted"].count("<turn ") == r["formatted"].count("</turn>") == len(want[c])
    assert chat.format_log(log.limit(0)).count() == 0


def test_one_long_conversation_is_folded_in_runs(spark):
    log = spark.range(60_000).selectExpr(
        "1L AS conv_id", "id AS seq", "id div 30000 AS message", "IF(id % 30000 = 0, 'message', 'delta') AS kind",
        "IF(id % 30000 = 0, 'assistant', NULL) AS role", "cast(id % 10 AS string) AS text")
    found = {r["message"]: r["text"] for r in chat.fold(log, 500).collect()}
    assert found == {0: "0123456789" * 3_000, 1: "0123456789" * 3_000}


def test_turns_of_awkward_tables(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, "user", None), (1, None, None, ""), (2, 0, "assistant", ""),
            (None, 0, "user", "x" * 100_000 + "\U0001f600" * 2_000), (3, 0, "assistant", "\U0001f600<a>" * 700), (None, None, None, None)]
    turns = spark.createDataFrame([(*r, "s", "t") for r in rows], "conv_id LONG, turn LONG, role STRING, text STRING, seq STRING, kind STRING")
    found = {r["conv_id"]: r for r in chat.format_log(chat.log_of(turns)).select(
        "conv_id", chat.read_turns(chat.F.col("formatted")).alias("t"), chat.read_loss(chat.F.col("segments")).alias("s")).collect()}
    for conv in (None, 1, 2, 3):
        own = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        assert [tuple(t) for t in found[conv]["t"]] == [r[2:] for r in own]
        assert found[conv]["s"] == "".join(r[3] for r in own if r[2] == "assistant")
    assert chat.format_log(chat.log_of(turns.limit(0))).count() == 0


def test_chat_query_is_native_and_holds_the_odd_conversation(spark):
    done = QUERIES["op12_chat_formatting"](spark, "/root/testdata/sf0.001")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    odd = done.filter("conv_id = -7").first()
    said = f"user\n{ODD_TEXT}\nassistant\n{ODD_TEXT}\n"
    assert (odd["n_turns"], odd["loss_chars"]) == (2, len(ODD_TEXT))
    assert odd["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert odd["loss_sha256"] == hashlib.sha256(ODD_TEXT.encode()).hexdigest()


# -- operator 13 -------------------------------------------------------------------------------------------


def mined(rows, every, positives, negatives, least, most, scale):
    kept = {(r[0], r[2], tuple(r[1])) for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])}
    width = max((len(v) for _, _, v in kept), default=1)
    made = []
    for i, label, v in sorted(kept):
        v = [min(max(math.floor(scale * float(np.float32(x))), -2 ** 26), 2 ** 26) for x in v]
        made.append((i, label, v + [0] * (width - len(v))))
    out = []
    for a, label, x in made:
        if a % every:
            continue
        scores = sorted({(-sum(p * q for p, q in zip(x, y)), i, own == label) for i, own, y in made if i != a})
        near = [(i, -s) for s, i, same in scores if same][:positives]
        for i, p in near:
            hard = [(j, -s) for s, j, same in scores if not same and least * p <= 100 * -s <= most * p][:negatives]
            out += [(a, i, k + 1, j, p, s) for k, (j, s) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("noise,small", [(0.1, True), (0.6, True), (0.6, False)])
def test_hard_negatives_equal_plain_python(spark, monkeypatch, noise, small):
    x, at = clusters(5, 900, 4, 12, noise)
    draw = random.Random(2)
    rows = [(k, v.tolist(), draw.choice([int(a) % 3, 1])) for k, (v, a) in enumerate(zip(x, at))]
    rows = [r for r in rows if not 899 < r[0] < 960] + ODD_ROWS + [(2_000 + k, rows[0][1], 0) for k in range(300)] + rows[50:51] * 3
    if small:
        for name, value in (("LEAF_ROWS", 60), ("BLOCK_ROWS", 40), ("PART_ANCHORS", 9), ("POINTS", 4), ("SLICE", 4)):
            monkeypatch.setattr(hard_negatives, name, value)
    found = hard_negatives.mine(vectors(spark, rows), sample_rows=300 if small else 4_096).collect()
    want = mined(rows, 50, 5, 3, 50, 95, 256)
    assert len(want) > 100 and sorted(map(tuple, found)) == want


def test_a_window_spares_leaves(spark, monkeypatch):
    """On clustered rows most leaves fall away, and none of them holds an answer."""
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 50)
    x, at = clusters(8, 4_000, 6, 40, 0.05)
    rows = vectors(spark, [(k, v.tolist(), int(a)) for k, (v, a) in enumerate(zip(x, at))])
    index = hard_negatives.build(rows, "vec_id % 50 = 0", sample_rows=1_500)
    whole = hard_negatives.matrix(hard_negatives.pa.array(x.tolist(), hard_negatives.pa.list_(hard_negatives.pa.float64())), 6, 256, 2 ** 26)
    anchors = whole[::50]
    scores = hard_negatives.products(anchors, whole)
    best = np.sort(scores, axis=1)[:, -6:-5]
    visits = index.tree.visits(anchors, best, np.full_like(best, hard_negatives.MOST))
    leaf = index.tree.leaf(whole)
    assert index.tree.leaves > 20 and visits.mean() < 0.3
    for a, need in enumerate(scores >= best):
        assert visits[a][leaf[need]].all()


def test_no_hard_negatives_of_empty_tables(spark):
    for rows in ([], [(50, [0.5], 1)], [(50, [], 1), (100, [], 2)], [(None, None, None)]):
        assert hard_negatives.mine(vectors(spark, rows)).count() == 0


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_chat_formatting", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    _, problems = differences(QUERIES[name](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), ORACLES[name])
    assert not problems
