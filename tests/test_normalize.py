"""Record normalisation, case by case."""

import json

from pyspark.sql import Observation, Row
from pyspark.sql import functions as F

from prefspark.functions import messages as M
from prefspark.functions.scalars import strip
from prefspark.operators import normalize as N
from prefspark.schema import RAW_MESSAGES, RAW_STRINGS, SHAREGPT


def raw(spark, schema, *records):
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in records]))


def pairs(df):
    return [tuple(r) for r in df.select("prompt", "chosen", "rejected").collect()]


def msg(role, content):
    return {"role": role, "content": content}


def test_prompt_is_stripped_of_all_unicode_whitespace(spark):
    df = raw(spark, RAW_STRINGS, {"prompt": " \n hi  \t", "chosen": "a", "rejected": "b"})
    assert pairs(N.to_preference_pairs(df)) == [("hi", "a", "b")]


def test_strip_matches_python(spark):
    texts = [" a b ", "\n\x1cx\x1f", " y　", "", "  ", "a\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_instruction_beats_prompt_and_a_blank_one_hides_it(spark):
    df = raw(
        spark,
        RAW_MESSAGES,
        {"instruction": "do", "prompt": "p", "chosen": [msg("assistant", "a")], "rejected": [msg("assistant", "b")]},
        {"instruction": "  ", "prompt": "p", "chosen": [msg("user", " q "), msg("gpt", "a")], "rejected": [msg("gpt", "b")]},
        {"instruction": "", "prompt": "p", "chosen": [msg("gpt", "a")], "rejected": [msg("gpt", "b")]},
    )
    # text found in a message is not stripped
    assert pairs(N.to_preference_pairs(df)) == [("do", "a", "b"), (" q ", "a", "b"), ("p", "a", "b")]


def test_first_user_message_wins_even_when_empty(spark):
    df = raw(
        spark,
        RAW_MESSAGES,
        {"chosen": [msg("human", ""), msg("user", "later"), msg("gpt", "a")], "rejected": [msg("user", "x"), msg("gpt", "b")]},
    )
    assert df.select(M.user_text(df)).first()[0] == ""
    assert pairs(N.to_preference_pairs(df)) == []


def test_assistant_text_takes_last_assistant_like_message_else_last(spark):
    df = raw(
        spark,
        RAW_MESSAGES,
        {"chosen": [msg("gpt", "1"), msg("ASSISTANT", "2"), msg("user", "3")], "rejected": [msg("user", "4"), msg("system", "5")]},
        {"chosen": [], "rejected": [{"value": "from value", "content": ""}]},
    )
    got = [tuple(r) for r in df.select(M.assistant_text(df, "chosen"), M.assistant_text(df, "rejected")).collect()]
    assert got == [("2", "5"), ("", "from value")]


def test_drop_rules(spark):
    df = raw(
        spark,
        RAW_STRINGS,
        {"prompt": "p", "chosen": "same", "rejected": "same"},
        {"prompt": "p", "chosen": "same", "rejected": "same "},
        {"prompt": "p", "chosen": " ", "rejected": "b"},
        {"prompt": "p", "chosen": None, "rejected": "b"},
        {"prompt": " ", "chosen": "a", "rejected": "b"},
    )
    assert pairs(N.to_preference_pairs(df)) == [("p", "same", "same "), ("p", " ", "b")]


def test_share_layout_prefers_value_and_strips(spark):
    df = raw(
        spark,
        SHAREGPT,
        {
            "conversations": [{"from": "human", "value": " q\n", "content": "other"}],
            "chosen": {"value": " a ", "content": "no"},
            "rejected": {"content": "b"},
        },
        {"conversations": [], "prompt": " fall ", "chosen": {"value": "a"}, "rejected": {"value": "b"}},
    )
    assert pairs(N.sharegpt_to_pairs(df)) == [("q", "a", "b"), ("fall", "a", "b")]


def test_share_layout_drops_list_answers(spark):
    df = raw(spark, RAW_MESSAGES, {"prompt": "p", "chosen": [msg("gpt", "a")], "rejected": [msg("gpt", "b")]})
    assert pairs(N.sharegpt_to_pairs(df)) == []
    assert pairs(N.to_flat(df)) == [("p", "a", "b")]


def test_flip_and_counts(spark):
    df = raw(
        spark,
        RAW_STRINGS,
        {"prompt": "p", "chosen": "a", "rejected": "b"},
        {"prompt": "", "chosen": "a", "rejected": "b"},
    )
    seen = Observation()
    assert pairs(N.flip_pairs(df, counts=seen)) == [("p", "b", "a")]
    assert seen.get == {"kept": 1, "skipped": 1}
    assert pairs(N.to_preference_pairs(df, flip=True)) == [("p", "b", "a")]


def test_text_columns_are_cast_by_schema(spark):
    df = spark.createDataFrame([Row(chosen=12, rejected=["a"], prompt="p")])
    assert N.normalize_text_columns(df).select("chosen", "rejected").first() == ("12", '["a"]')
