"""What a Python worker holds of an operator: bounded by word, and nothing of it while another operator works."""

import gc
import random
import tracemalloc

import public_tokenizers
import pyarrow as pa

from millrace.llm import bpe, common

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_idle_workers_give_up_what_the_encoder_remembers(spark):
    """Held before the change as well, in a local session."""
    tokenizer = bpe.read_tokenizer(TOKENIZER)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some text ', id) AS text").repartition(8)
    assert bpe.encode_documents(docs, tokenizer).count() == 400

    def memos(batch):
        gc.collect()
        n = sum(isinstance(x, common.Memo) for x in gc.get_objects())
        return pa.RecordBatch.from_pydict({"n": pa.array([n] * batch.num_rows, pa.int64())})

    found = common.map_batches(spark.range(400).repartition(16), memos, "n long")
    assert {r["n"] for r in found.collect()} == {0}


def test_the_encoder_stays_between_its_own_tasks():
    common.given_up()
    assert common.kept("a", list) is common.kept("a", list)
    first = common.kept("a", list)
    common.given_up("a")
    assert common.kept("a", list) is first
    common.given_up("b")
    assert common.kept("a", list) is not first
    common.given_up()


def test_the_encoder_holds_little_for_a_word():
    encode = bpe.encoder(bpe.read_tokenizer(TOKENIZER))
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000)]
    gc.collect()
    tracemalloc.start()
    for k in range(0, len(words), 100):
        encode(" ".join(words[k:k + 100]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 200 * len(words)
