"""Chat examples: round trip, loss masks and odd rows."""

from tests.llm import brute
from twinsift.llm.chat import digest, examples, read_target
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "system", "be <|end|>\n<|turn|>user\nkind"), (1, 1, "user", "</s>[INST] \\ ok [/INST]"), (1, 2, "assistant", "\\<|end|>\\"),
    (1, 3, "assistant", "[\\INST] again <s>"), (1, 4, "user", "bye"),
    (2, 0, "user", None), (2, 1, None, "a\nb"), (2, 1, "ro\nle", ""), (2, None, "assistant", "first"),
    (None, 1, "assistant", "x"), (None, 1, "assistant", "x"), (3, 5, "user", "alone"), (4, 0, "assistant", "é" * 5000), (4, 1, "assistant", None),
]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_round_trip(llm):
    found = digest(examples(llm.createDataFrame(ROWS, SCHEMA))).drop("formatted_chars").collect()
    assert order(map(tuple, found)) == order(brute.conversations(ROWS))


def test_empty(llm):
    assert digest(examples(llm.createDataFrame([], SCHEMA))).count() == 0


def test_one_target_per_example(llm):
    found = examples(llm.createDataFrame(ROWS[:5], SCHEMA))
    target = read_target(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    got = [r.t for r in found.orderBy("example").select(target.alias("t")).collect()]
    assert got == ["\\<|end|>\\", "[\\INST] again <s>", None]
    texts = [r.formatted for r in found.collect()]
    assert all("</s>" not in t and "[INST]" not in t and t.count("<|turn|>") == t.count("<|end|>") for t in texts)
