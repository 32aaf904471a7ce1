"""Prompt, response and token shaping. Row-local except padding to a batch and unmatched pairs."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.functions import arrays as A
from prefspark.functions.messages import message_role
from prefspark.functions.scalars import bind, floor_div
from prefspark.functions.tokens import ChatTemplate, Tokenizer, after, fill_template, say
from prefspark.operators.groups import with_group_stats
from prefspark.operators.normalize import drop_incomplete, normalize_text_columns
from prefspark.schema import as_messages, field_type, require_columns

IGNORE_LABEL = -100


def format_template(text: Column, template: str | None) -> Column:
    """Fill ``template``; one without a placeholder is ignored with a warning."""
    if template and "{}" not in template:
        warnings.warn("template has no {} placeholder and is ignored", stacklevel=2)
        return text
    return fill_template(text, template) if template else text


def _chat(df: DataFrame, name: str, role: str) -> Column:
    """Column as a message array; a plain string is one message of ``role``."""
    if isinstance(field_type(df, name), T.ArrayType):
        return as_messages(df, name)
    return F.array(say(role, F.col(name)))


def _all_but_last(messages: Column) -> Column:
    return F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))


def pair_spans(df: DataFrame, template: ChatTemplate) -> DataFrame:
    """Rendered prompt, and both answers as the text a full rendering adds behind it."""
    head = F.array(say("user", F.col("prompt")))
    rendered = template.render(head, add_generation_prompt=True)
    out = df.withColumn("formatted_prompt", rendered)
    for side in ("chosen", "rejected"):
        full = template.render(F.concat(head, F.array(say("assistant", F.col(side)))))
        out = out.withColumn(f"{side}_response_only", after(full, F.col("formatted_prompt")))
    return out


def _fits(prompt: Column, tokenizer: Tokenizer, max_len: int) -> Column:
    """Prompt tokens, cut at ``max_len``, leave room for two answer tokens."""
    return F.least(tokenizer.count(prompt), F.lit(max_len))


def sft_samples(
    df: DataFrame,
    input_col: str,
    output_col: str | None,
    tokenizer: Tokenizer,
    max_len: int,
    template: ChatTemplate | None = None,
    input_template: str | None = None,
    pretrain: bool = False,
    keep=(),
) -> DataFrame:
    """(prompt, response) of fine-tuning records; empty or over-long prompts are dropped.

    With a chat template and no output column the last message is the response. Pre-training text
    keeps its whole text as prompt.
    """
    if template is not None and not pretrain:
        if output_col:
            head, tail = _chat(df, input_col, "user"), _chat(df, output_col, "assistant")
            whole = F.concat(head, tail)
        else:
            whole = as_messages(df, input_col)
            head = _all_but_last(whole)
        prompt = template.render(head, add_generation_prompt=True)
        response = after(template.render(whole), prompt)
    else:
        prompt = F.col(input_col) if pretrain else format_template(F.col(input_col), input_template)
        response = F.col(output_col) if output_col else F.lit("")
    out = df.select(*keep, prompt.alias("prompt"), response.alias("response"))
    if pretrain:
        return drop_incomplete(out.withColumn("prompt_ids_len", F.lit(0)))
    out = out.withColumn("prompt_ids_len", _fits(F.col("prompt"), tokenizer, max_len))
    return out.where((F.col("prompt") != "") & (F.col("response") != "") & (F.col("prompt_ids_len") < max_len - 2))


def preference_samples(
    df: DataFrame,
    tokenizer: Tokenizer,
    max_len: int,
    prompt_col: str | None = "prompt",
    chosen_col: str = "chosen",
    rejected_col: str = "rejected",
    template: ChatTemplate | None = None,
    input_template: str | None = None,
    is_dpo: bool = True,
    keep=(),
) -> DataFrame:
    """(prompt, chosen, rejected, margin) samples of reward-model or preference training.

    Without a prompt column, preference training takes all but the last chosen message as prompt and
    cuts both renderings by its length; reward-model training keeps whole renderings.
    """
    if template is not None:
        chosen, rejected = _chat(df, chosen_col, "assistant"), _chat(df, rejected_col, "assistant")
        if prompt_col:
            head = _chat(df, prompt_col, "user")
            prompt = template.render(head, add_generation_prompt=True)
            sides = [after(template.render(F.concat(head, s)), prompt) for s in (chosen, rejected)]
        elif is_dpo:
            prompt = template.render(_all_but_last(chosen), add_generation_prompt=True)
            sides = [after(template.render(s), prompt) for s in (chosen, rejected)]
        else:
            prompt = F.lit("")
            sides = [template.render(s) for s in (chosen, rejected)]
    else:
        prompt = format_template(F.col(prompt_col), input_template) if prompt_col else F.lit("")
        sides = [F.col(chosen_col), F.col(rejected_col)]
    margin = F.coalesce(F.col("margin").cast("double"), F.lit(0.0)) if "margin" in df.columns else F.lit(0.0)
    out = df.select(
        *keep, prompt.alias("prompt"), sides[0].alias("chosen"), sides[1].alias("rejected"), margin.alias("margin")
    )
    if not is_dpo:
        return drop_incomplete(out)
    out = out.withColumn("prompt_ids_len", _fits(F.col("prompt"), tokenizer, max_len))
    return out.where(F.col("prompt").isNotNull() & (F.col("prompt_ids_len") < max_len - 2))


def prompt_samples(
    df: DataFrame,
    input_col: str,
    label_col: str | None = None,
    template: ChatTemplate | None = None,
    input_template: str | None = None,
    keep=(),
) -> DataFrame:
    """(datasource, prompt, label) of rollout prompts."""
    if template is not None:
        prompt = template.render(_chat(df, input_col, "user"), add_generation_prompt=True)
    else:
        prompt = format_template(F.col(input_col), input_template)
    source = F.coalesce(F.col("datasource"), F.lit("default")) if "datasource" in df.columns else F.lit("default")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    return df.select(*keep, source.alias("datasource"), prompt.alias("prompt"), label.alias("label"))


def unpaired_samples(
    df: DataFrame,
    input_col: str,
    output_col: str | None,
    label_col: str,
    tokenizer: Tokenizer,
    max_len: int,
    template: ChatTemplate | None = None,
    input_template: str | None = None,
    keep=(),
) -> DataFrame:
    """(prompt, response, label) samples with the over-long prompts dropped."""
    if template is not None:
        if output_col:
            head = _chat(df, input_col, "user")
            whole = F.concat(head, _chat(df, output_col, "assistant"))
        else:
            whole = as_messages(df, input_col)
            head = _all_but_last(whole)
        prompt = template.render(head, add_generation_prompt=True)
        response = after(template.render(whole), prompt)
    else:
        prompt = format_template(F.col(input_col), input_template)
        response = F.col(output_col)
    out = df.select(*keep, prompt.alias("prompt"), response.alias("response"), F.col(label_col).alias("label"))
    out = out.withColumn("prompt_ids_len", _fits(F.col("prompt"), tokenizer, max_len))
    return out.where(F.col("prompt").isNotNull() & (F.col("prompt_ids_len") < max_len - 2))


def assemble_text(prompt: Column, response: Column, eos: str) -> Column:
    """Prompt and response without trailing newlines, ending in the end-of-sequence text."""
    text = F.regexp_replace(F.concat(prompt, response), r"\n+\z", "")
    return F.when(F.endswith(text, F.lit(eos)), text).otherwise(F.concat(text, F.lit(" " + eos)))


def truncate_with_eos(ids: Column, max_len: int, eos_id: int) -> Column:
    """First ``max_len`` ids with the last one replaced by the end-of-sequence id."""
    keep = F.greatest(F.least(F.size(ids), F.lit(max_len)) - 1, F.lit(0))
    return F.when(F.size(ids) > 0, F.concat(A.cut(ids, keep), F.array(F.lit(eos_id)))).otherwise(ids)


def tokenize_truncate(df: DataFrame, text_col: str, tokenizer: Tokenizer, max_len: int, name: str = "ids") -> DataFrame:
    out = df.withColumn(name, tokenizer.ids(F.col(text_col)))
    return out.withColumn(name, truncate_with_eos(F.col(name), max_len, tokenizer.eos_id))


def token_lengths(df: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Token counts of the raw answers and their gap."""
    out = normalize_text_columns(df).withColumns(
        {f"{side}_len": tokenizer.count(F.col(side)) for side in ("chosen", "rejected")}
    )
    return out.withColumn("len_gap", F.col("chosen_len") - F.col("rejected_len"))


def pair_token_ids(df: DataFrame, tokenizer: Tokenizer, template: ChatTemplate, max_len: int) -> DataFrame:
    """Ids and masks of prompt + answer + end of sequence, cut or padded to ``max_len``."""
    out = pair_spans(df, template).withColumn("_p", tokenizer.ids(F.col("formatted_prompt")))
    out = out.withColumn("prompt_len", F.size("_p"))
    for side in ("chosen", "rejected"):
        answer = F.concat(F.col(f"{side}_response_only"), F.lit(tokenizer.eos_token))
        out = out.withColumn(f"_{side}", tokenizer.ids(answer)).withColumn(f"{side}_len", F.size(f"_{side}"))
        ids = A.cut(F.concat("_p", F.col(f"_{side}")), max_len)
        out = out.withColumns(
            {
                f"{side}_ids": A.pad_to(ids, max_len, tokenizer.pad_id),
                f"{side}_mask": A.pad_to(F.transform(ids, lambda _: F.lit(1)), max_len, 0),
            }
        )
    return out.drop("_p", "_chosen", "_rejected")


def pad_batch(df: DataFrame, cols: dict[str, int], batch_col: str, side: str = "right") -> DataFrame:
    """Pad each array of ``cols`` (name to fill value) to the longest of its batch."""
    sized = with_group_stats(df, [batch_col], {f"_max_{c}": F.max(F.size(c)) for c in cols})
    padded = {c: A.pad_to(F.col(c), F.col(f"_max_{c}"), value, side) for c, value in cols.items()}
    return sized.withColumns(padded).select(*df.columns)


def strip_padding(ids: Column, mask: Column) -> Column:
    """Elements whose mask is one."""
    kept = F.filter(F.arrays_zip(ids.alias("x"), mask.alias("m")), lambda c: c["m"] == 1)
    return F.transform(kept, lambda c: c["x"])


def strip_right_padding(values: Column, mask: Column) -> Column:
    """Everything up to the last one of the mask, for arrays aligned with it."""
    return A.cut(values, A.last_one_index(mask) + 1)


def sft_loss_mask(n: Column, prompt_len: Column, pretrain: bool = False) -> Column:
    """One on the positions that predict a response token."""
    if pretrain:
        return F.array_repeat(F.lit(1), n.cast("int"))

    def mask(size: Column) -> Column:
        cells = F.sequence(F.lit(0), size["n"] - 1)
        inside = F.transform(cells, lambda i: ((i >= size["p"] - 1) & (i < size["n"] - 1) & (size["p"] > 0)).cast("int"))
        return F.when(size["n"] > 0, inside).otherwise(F.array().cast("array<int>"))

    return bind(F.struct(n.cast("int").alias("n"), prompt_len.cast("int").alias("p")), mask)


def multiturn_response_ranges(messages: Column, tokenizer: Tokenizer, template: ChatTemplate, max_len: int) -> Column:
    """Closed token ranges of the assistant messages of a conversation.

    A range starts after the tokens of the rendered conversation up to the message, with the opening of an answer, and has
    the tokens of the rest of the message; both counts stop at ``max_len``. Every message is rendered once.
    """
    opening = F.lit(template.generation_prompt)
    parts = F.transform(
        messages,
        lambda m: F.struct(template.message(m).alias("text"), F.coalesce(message_role(m) == "assistant", F.lit(False)).alias("answer")),
    )
    if not getattr(tokenizer, "native", False):
        whole = F.array_join(F.transform(parts, lambda p: p["text"]), "")
        lengths = F.transform(parts, lambda p: F.length(p["text"]))
        return tokenizer.answer_ranges(whole, lengths, F.transform(parts, lambda p: p["answer"]), template.generation_prompt, max_len)

    def answer(p: Column) -> Column:
        return F.struct(p["text"].alias("text"), p["answer"].alias("answer"), after(p["text"], opening).alias("rest"))

    none = F.array().cast("array<struct<start:int,end:int>>")

    def read(state: Column, p: Column) -> Column:
        """Tokens so far and the text that the last of them may go on from, for the next message."""

        def add(now: Column) -> Column:
            start = F.least(now, F.lit(max_len))
            end = start + F.least(tokenizer.count(p["rest"]), F.lit(max_len)) - 1
            span = F.when(p["answer"], F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))))
            return F.concat(state["spans"], F.coalesce(span, none))

        return F.struct(
            tokenizer.extended(state["n"], state["open"], p["text"]).alias("n"),
            tokenizer.goes_on(state["open"], p["text"]).alias("open"),
            bind(tokenizer.extended(state["n"], state["open"], opening), add).alias("spans"),
        )

    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), none.alias("spans"))
    return F.aggregate(F.transform(parts, answer), zero, read, lambda state: state["spans"])


def ranges_loss_mask(n: Column, ranges: Column) -> Column:
    """One on ``[start - 1, end)`` of every range; ranges ascend and do not overlap.

    A range that starts at the first token is a slice from the last cell on, which holds nothing unless it ends there.
    """
    n = n.cast("int")
    from_last = F.exists(ranges, lambda r: (r["start"] == 0) & (r["end"] >= n))
    spans = F.transform(
        F.filter(ranges, lambda r: r["start"] > 0), lambda r: F.struct((r["start"] - 1).alias("start"), r["end"].alias("end"))
    )
    marked = A.range_mask(n, spans)
    last = F.when(from_last, F.array(F.lit(1))).otherwise(F.slice(marked, n, F.lit(1)))
    return F.when(n > 0, F.concat(A.cut(marked, n - 1), last)).otherwise(F.array().cast("array<int>"))


def reward_label_ids(labels: Column, token_ids: dict[str, int]) -> Column:
    """Token ids of textual step labels; a label outside ``token_ids`` fails the row."""

    def look_up(label: Column) -> Column:
        out = F.raise_error(F.concat(F.lit("label not among the reward tokens: "), label)).cast("int")
        for text, token in token_ids.items():
            out = F.when(label == text, F.lit(token)).otherwise(out)
        return out

    return F.transform(labels, look_up)


def process_reward_labels(ids: Column, labels: Column, placeholder_id: int, ignore=IGNORE_LABEL) -> Column:
    """Step labels at the placeholder positions, the ignore label elsewhere.

    Labels of truncated placeholders are dropped; too few labels fail the row.
    """
    slots = F.filter(F.transform(ids, lambda t, i: F.when(t == placeholder_id, i)), lambda i: i.isNotNull())
    blank = F.lit(float(ignore))

    def place(row: Column) -> Column:
        at, steps = row["at"], row["steps"]

        # The stretch in front of each placeholder, then its label; then what follows the last one.
        def stretch(i: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(at, k - 1)).otherwise(F.lit(-1))
            return F.concat(F.array_repeat(blank, i - before - 1), F.array(F.get(steps, k)))

        tail = F.size(ids) - 1 - F.coalesce(F.array_max(at), F.lit(-1))
        filled = F.concat(F.flatten(F.transform(at, stretch)), F.array_repeat(blank, tail))
        failed = F.raise_error(F.lit("fewer step labels than placeholders")).cast("array<double>")
        return F.when(F.size(steps) < F.size(at), failed).otherwise(filled)

    return bind(F.struct(slots.alias("at"), A.as_double(labels).alias("steps")), place)


def kto_unmatched_pairs(df: DataFrame, batch_size: int, position: str = "position") -> DataFrame:
    """Add, within each batch of consecutive rows, prompt i with response i + 1 (wrapping), label -1.

    The partner is found by an equi-join on the unique position, so batches are never gathered.
    """
    require_columns(df, position, "prompt", "response", "label")
    at = F.col(position)
    last = df.agg(F.max(position)).scalar()
    start = at - F.pmod(at, F.lit(batch_size))
    stays = (at + 1 < start + batch_size) & (at + 1 <= last)
    asked = df.drop("response").withColumn("_next", F.when(stays, at + 1).otherwise(start))
    answers = df.select(F.col(position).alias("_next"), "response")
    unmatched = asked.join(answers, "_next").withColumn("label", F.lit(-1).cast(field_type(df, "label")))
    return df.unionByName(unmatched.select(*df.columns)).withColumn("batch", floor_div(at, batch_size))


def csft_prompt_suffix(prompt: Column, csft_prompt: str) -> Column:
    """Append the stripped conditioning text and one blank."""
    return F.concat(prompt, F.lit(csft_prompt.strip() + " "))


def expand_samples(df: DataFrame, n: int, position: str = "position", consecutive: bool = True) -> DataFrame:
    """``n`` copies of every prompt: next to each other, or as ``n`` passes over the table."""
    out = df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if consecutive:
        return out.withColumn("sample_position", F.col(position) * n + F.col("sample_idx"))
    total = df.agg(F.max(position) + 1).scalar()
    return out.withColumn("sample_position", F.col("sample_idx") * total + F.col(position))


def rollout_row(
    df: DataFrame, prompt_ids: str, response_ids: str, prompt_max: int, max_new: int, rollout_logprobs: str | None = None
) -> DataFrame:
    """Sequence, action mask and length metrics of a generated response."""
    limit = prompt_max + max_new
    p, r = F.col(prompt_ids), F.col(response_ids)
    mask = F.concat(F.array_repeat(F.lit(0), F.size(p)), F.array_repeat(F.lit(1), F.size(r)))
    total = F.least(F.size(p) + F.size(r), F.lit(limit))
    out = df.withColumns(
        {
            "sequences": A.cut(F.concat(p, r), limit),
            "action_mask": A.drop_first(A.cut(mask, limit)),
            "response_length": F.size(r),
            "total_length": total,
            "clipped": (F.size(r) >= max_new).cast("int"),
        }
    )
    if rollout_logprobs:
        padded = F.concat(F.array_repeat(F.lit(0.0), F.size(p)), F.col(rollout_logprobs))
        out = out.withColumn("rollout_logprobs", A.drop_first(A.cut(padded, limit)))
    return out


def strip_prompt_echo(output: Column, prompt: Column) -> Column:
    """Generated text without the prompt in front of it."""
    return after(output, prompt)
