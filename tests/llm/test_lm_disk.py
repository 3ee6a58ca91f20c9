"""What op5 writes besides its result stays in proportion to its input."""

import glob
import random

from kelvinlake.llm import lm_score


def shuffled(spark, since: int) -> tuple[int, int]:
    """Bytes that the stages from a number on wrote to shuffles, and the next stage's number."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    each = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteBytes()) for i in range(stages.size())]
    return sum(n for i, n in each if i >= since), 1 + max((i for i, _ in each), default=-1)


def test_words_are_exchanged_packed(spark):
    """Every word in one text alone, the dearest for an exchange of words: a row a word, 9.9 times the text was shuffled."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows = [(i, " ".join(word() for _ in range(300))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs.count()
    _, at = shuffled(spark, 0)
    lm_score.coded(docs)[0].count()
    written, _ = shuffled(spark, at)
    assert 0 < written < 6 * sum(len(t) for _, t in rows)

    left = [p.rsplit("/", 1)[1] for p in glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/*-*")]
    assert not any(p.startswith(("blocks-", "vocab-")) for p in left)
