"""What the operators keep on disk and in the driver's memory."""

import random
import tracemalloc

from tidegauge.llm import toxicity
from tidegauge.llm.common import CLEANUP, staged
from tidegauge.llm.passages import pieces_of


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_staged_leaves_no_shuffle_files(spark, tmp_path):
    dealt = lambda: spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(3, "k")
    before, was = shuffle_files(spark), spark.conf.get(CLEANUP)
    rows = staged(dealt(), "shuffled")
    after = shuffle_files(spark)
    dealt().write.parquet(str(tmp_path / "plain"))
    assert after <= before and shuffle_files(spark) > after
    assert rows.count() == 1000 and spark.conf.get(CLEANUP) == was


def test_training_keeps_no_subwords_that_tell_nothing():
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(10)) for _ in range(2000)]
    rows = [({draw.choice(words): 1 for _ in range(200)} | ({"horrid": 2} if i % 4 == 0 else {}), int(i % 4 == 0)) for i in range(600)]
    tracemalloc.start()
    toxicity.train(rows, toxicity.ToxicityParams(epochs=1))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6  # before: 51 MB


def test_keys_take_forty_bits():
    text = " ".join(f"word{i * 7919 % 1009}" for i in range(400)).encode()
    _, _, count, key = pieces_of([text, text[:300]])
    assert count.sum() == len(text) - 49 + 251 and 0 <= key.min() and key.max() < 1 << 40
