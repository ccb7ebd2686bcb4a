"""Texts of answers and traces: the rule that decides in each case, with nulls and empty texts."""

from pyspark.sql import functions as F

from tessera.functions import answers


def column(spark, rows, names, value):
    return [r[0] for r in spark.createDataFrame(rows, names).select(value).collect()]


def test_final_answer_rules(spark):
    texts = {
        r"x \boxed{ } y \boxed{41}": "41",
        r"\boxed{a}b} z": "a}b",
        r"\boxed{left} then \boxed{ }": "left",
        r"\boxed{open to the end": "open to the end",
        r"\boxed{ }": "",
        "The Final Answer is: `x.`\nFinal answer: 7": "x",
        "so final answer： eight\n9": "eight",
        "so 3 and -4.5 it is": "-4.5",
        "only words\n\n Answer: last ": "last",
        "words\r\nassistant -\r\n": "words",
        "\t tab and more \t": "tab and more",
        "": "",
    }
    assert column(spark, [(t,) for t in texts] + [(None,)], "t string", answers.final_answer(F.col("t"))) == [*texts.values(), ""]


def test_answer_case_is_an_option(spark):
    both = F.array(answers.normalize_answer(F.col("t")), answers.normalize_answer(F.col("t"), lower=False))
    assert column(spark, [("`A  b.`",)], "t string", both) == [["a b", "A b"]]


def test_cipher_trace(spark):
    rule = "Alice's secret encryption rules:\n"
    rows = [
        (rule + "- abc de -> cat is\nfg -> on\ndecrypt the following text: bca fgx zz.", "tac ony yes"),
        (rule + "ab -> xy\nac -> zy\ndecrypt the following text: ab", "q"),  # a has two meanings
        (rule + "ab -> xy\nab -> xyz\nDecrypt the following text: ab", None),  # the last pair of a word counts
        (rule + "ab -> xy\ndecrypt the following text: b-q", ""),  # unknown letters without a word to fall back on
        (rule + "no pairs\ndecrypt the following text: ab", "q"),
        (rule + "ab -> xy\nno query", "q"),
        ("ab -> xy\ndecrypt the following text: ab", "q"),
        ("", ""),
        (None, None),
    ]
    assert column(spark, rows, "p string, a string", answers.cipher_trace(F.col("p"), F.col("a"))) == [
        "Trace: bca->atc; fgx->ony; zz->yes.", None, "Trace: ab->xyz.", "Trace: b-q->y-?.", None, None, None, None, None,
    ]


def test_training_text(spark):
    text = answers.training_text("sys", F.col("p"), F.col("a"), "boxed")
    assert column(spark, [("q", " `B.` "), (None, None)], "p string, a string", text) == [
        "System:\nsys\n\nUser:\nq\n\nAssistant:\n\\boxed{B}", "System:\nsys\n\nUser:\n\n\nAssistant:\n\\boxed{}",
    ]
