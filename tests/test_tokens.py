"""Tokenizer and template plug-ins."""

import random

import pytest
from pyspark.sql import functions as F

from prefspark.functions import tokens
from prefspark.functions.tokens import ChatTemplate, TokenizerFile, WhitespaceTokenizer, fill_template, say
from prefspark.operators import shaping as T


@pytest.fixture(scope="module")
def token_file(tmp_path_factory):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace
    from tokenizers.processors import TemplateProcessing

    encoder = Tokenizer(WordLevel({"[UNK]": 0, "<s>": 1, "</s>": 2, "a": 3, "b": 4}, unk_token="[UNK]"))
    encoder.pre_tokenizer = Whitespace()
    encoder.post_processor = TemplateProcessing(single="<s> $A", special_tokens=[("<s>", 1)])
    path = str(tmp_path_factory.mktemp("tok") / "tokenizer.json")
    encoder.save(path)
    return path


def test_tokenizer_file(spark, token_file):
    tokenizer = TokenizerFile(token_file, "</s>", 2, 0)
    df = spark.createDataFrame([("a b a", "b"), ("a zzz", None)], "chosen string, rejected string")
    rows = df.select(tokenizer.ids(F.col("chosen")), tokenizer.count(F.col("rejected"))).collect()
    assert [tuple(r) for r in rows] == [([1, 3, 4, 3], 2), ([1, 3, 0], 1)]
    plain = TokenizerFile(token_file, "</s>", 2, 0, add_special_tokens=False)
    out = T.token_lengths(df, plain).collect()
    assert [(r.chosen_len, r.rejected_len, r.len_gap) for r in out] == [(3, 1, 2), (2, 0, 2)]


def test_whitespace_tokenizer(spark):
    tokenizer = WhitespaceTokenizer(vocab_size=100)
    df = spark.createDataFrame([("a  b\n</s> a",), ("",), (" ",)], "t string")
    ids = [r[0] for r in df.select(tokenizer.ids(F.col("t"))).collect()]
    assert ids[0][0] == ids[0][3] and ids[0][2] == 2 and ids[1] == ids[2] == []
    assert all(3 <= i < 100 for i in (ids[0][0], ids[0][1]))
    assert [r[0] for r in df.select(tokenizer.count(F.col("t"))).collect()] == [4, 0, 0]


def test_pair_ids_are_cut_or_padded(spark):
    df = spark.createDataFrame([("q", "one two", "x")], "prompt string, chosen string, rejected string")
    template = ChatTemplate(prefix={}, suffix={"user": " "}, generation_prompt="> ")
    row = T.pair_token_ids(df, WhitespaceTokenizer(), template, 5).first()
    # the full rendering "q one two" loses as many characters as "q > " has
    assert (row.formatted_prompt, row.chosen_response_only) == ("q > ", "e two")
    assert (row.prompt_len, row.chosen_len) == (2, 2)
    assert len(row.chosen_ids) == len(row.rejected_ids) == 5
    assert sum(row.chosen_mask) == min(5, row.prompt_len + row.chosen_len)
    assert row.chosen_ids[sum(row.chosen_mask) :] == [0] * (5 - sum(row.chosen_mask))


def test_template(spark):
    df = spark.range(1)
    messages = F.array(say("User", F.lit("hi")), say("assistant", F.lit("yo")), say("tool", F.lit("!")))
    text = df.select(ChatTemplate().render(messages, True)).first()[0]
    assert text == "<|user|>\nhi\n<|assistant|>\nyo</s>\n!<|assistant|>\n"
    assert df.select(fill_template(F.lit("x"), "{{a}} {} }}")).first()[0] == "{{a}} {} }}".format("x")


def test_samples_wrap_strings_and_drop_long_prompts(spark):
    df = spark.createDataFrame(
        [("w " * 6, "ok"), ("w " * 7, "ok"), ("w", "")], "input string, output string"
    )
    out = T.sft_samples(df, "input", "output", WhitespaceTokenizer(), 9)
    assert [r.prompt_ids_len for r in out.collect()] == [6]
    chat = T.sft_samples(df, "input", "output", WhitespaceTokenizer(), 50, ChatTemplate())
    assert [r.response for r in chat.collect()] == ["ok</s>\n", "ok</s>\n", "</s>\n"]
    whole = T.sft_samples(df, "input", None, WhitespaceTokenizer(), 3, pretrain=True)
    assert whole.count() == 3 and {r.response for r in whole.collect()} == {""}


def test_preference_prompt_from_the_chosen_messages(spark):
    chat = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame(
        [([("user", "q"), ("assistant", "good")], [("user", "q"), ("assistant", "bad")])], f"chosen {chat}, rejected {chat}"
    )
    row = T.preference_samples(df, WhitespaceTokenizer(), 50, None, template=ChatTemplate()).first()
    assert (row.prompt, row.chosen, row.rejected, row.margin) == (
        "<|user|>\nq\n<|assistant|>\n", "good</s>\n", "bad</s>\n", 0.0
    )
    reward = T.preference_samples(df, WhitespaceTokenizer(), 50, None, template=ChatTemplate(), is_dpo=False).first()
    assert reward.prompt == "" and reward.chosen == "<|user|>\nq\n<|assistant|>\ngood</s>\n"


def conversations(seed, n=25):
    rng = random.Random(seed)
    words = ["hello", "World", "  two", "x", "\n", "\n\n", "Don't", "été", "123", "...", "</s>", "<|user|>", "日本", " ", "\t", "a" * 90]
    out = []
    for _ in range(n):
        turns = []
        for _ in range(rng.randint(0, 9)):
            text = rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(0, 25)))
            turns.append((rng.choice(["user", "assistant", "assistant", "system"]), text))
        out.append(turns)
    return out


def plain_ranges(turns, template, count, max_len):
    """Tokens of every rendered prefix, counted anew."""
    render = lambda ts: "".join(template.prefix.get(r, "") + t + template.suffix.get(r, "") for r, t in ts)
    out = []
    for i, (role, _) in enumerate(turns):
        if role == "assistant":
            prompt = render(turns[:i]) + template.generation_prompt
            start = min(count(prompt), max_len)
            out.append((start, start + min(count(render(turns[: i + 1])[len(prompt) :]), max_len) - 1))
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", None])
@pytest.mark.parametrize("max_len", [4096, 60])
def test_multiturn_ranges_equal_prefix_differences(spark, name, max_len):
    templates = [ChatTemplate(), ChatTemplate(prefix={"user": "U: "}, suffix={"assistant": "", "user": "\n\n"}, generation_prompt="")]
    if name is None:
        tokenizer, count = WhitespaceTokenizer(), lambda t: len(t.encode().split())
    else:
        public_tokenizers = pytest.importorskip("public_tokenizers")
        path = public_tokenizers.path(name)
        tokenizer = TokenizerFile(path, "</s>", 2, 0)
        encoder = tokens._load_tokenizer(path)
        count = lambda t: len(encoder.encode(t, add_special_tokens=False).ids)
    found = conversations(max_len)
    df = spark.createDataFrame(
        [(i, [(r, t, None, None) for r, t in turns]) for i, turns in enumerate(found)],
        "id int, m array<struct<role:string,content:string,from:string,value:string>>",
    )
    for template in templates:
        got = df.select("id", T.multiturn_response_ranges(F.col("m"), tokenizer, template, max_len).alias("r")).orderBy("id")
        assert [[tuple(x) for x in r.r] for r in got.collect()] == [plain_ranges(t, template, count, max_len) for t in found]


def test_prefixes_from_one_encoding():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = tokens._load_tokenizer(public_tokenizers.path(name))
        text = "".join(t for turns in conversations(9, 40) for _, t in turns)
        prefixes = tokens.Prefixes(encoder, text, stretch=4)
        for _ in range(150):
            end, more = rng.randint(0, len(text)), rng.choice(["", "\n", " x", "yz"])
            assert prefixes.size(end, more) == len(encoder.encode(text[:end] + more, add_special_tokens=False).ids)
