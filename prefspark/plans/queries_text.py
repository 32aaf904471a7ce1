"""Queries: record normalisation and prompt / response shaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions import arrays as A
from prefspark.functions import messages as M
from prefspark.functions.tokens import ChatTemplate, WhitespaceTokenizer
from prefspark.operators import normalize as N
from prefspark.operators import shaping as T
from prefspark.plans.registry import joined, query
from prefspark.plans.views import run_sql, table, view
from prefspark.schema import MESSAGE

TOKENIZER = WhitespaceTokenizer()
TEMPLATE = ChatTemplate()
SLOTS = range(4)


def _messages(slots, swap: str = "FALSE") -> Column:
    """Array of the present turns; where ``swap`` holds, in the from / value layout."""
    none = F.lit(None).cast("string")
    items = []
    for i in slots:
        role, text, alt = F.col(f"r{i}"), F.col(f"t{i}"), F.expr(swap)
        item = F.struct(
            F.when(~alt, role).alias("role"),
            F.when(~alt, text).otherwise(F.lit("")).alias("content"),
            F.when(alt, F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)).alias("from"),
            F.when(alt, text).otherwise(none).alias("value"),
        ).cast(MESSAGE)
        items.append(F.when(text.isNotNull(), item))
    return F.filter(F.array(*items), lambda m: m.isNotNull())


def _records(spark, sf):
    """Raw preference records with list answers; prompts blank, missing or padded in turn."""
    rows = view(spark, sf, "v_dialogs")
    prompt = F.expr("CASE dialog_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' \\n ' WHEN 2 THEN NULL ELSE '\\n' || t0 || ' ' END")
    swap = "dialog_id % 3 = 1"
    return rows.select(
        "dialog_id",
        F.expr("CASE WHEN dialog_id % 11 = 3 THEN '  ' WHEN dialog_id % 11 = 4 THEN ' do ' || dialog_id END").alias("instruction"),
        prompt.alias("prompt"),
        _messages((0, 1), swap).alias("chosen"),
        _messages((2, 3), swap).alias("rejected"),
    )


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_STATED = """CASE WHEN dialog_id % 11 = 3 THEN '' WHEN dialog_id % 11 = 4 THEN 'do ' || dialog_id
  WHEN dialog_id % 5 IN (0, 1, 2) THEN '' ELSE """ + _STRIP.format("t0") + " END"
_FIRST_USER = "COALESCE(" + ", ".join(f"CASE WHEN r{i} = 'user' THEN t{i} END" for i in SLOTS) + ", '')"
_USER = f"COALESCE(nullif({_STATED}, ''), {_FIRST_USER})"


def _assistant(a: int, b: int) -> str:
    return f"COALESCE(CASE WHEN r{b} = 'assistant' THEN t{b} WHEN r{a} = 'assistant' THEN t{a} ELSE COALESCE(t{b}, t{a}) END, '')"


_RAW = f"SELECT dialog_id, {_USER} AS prompt, {_assistant(0, 1)} AS chosen, {_assistant(2, 3)} AS rejected FROM v_dialogs"
_GOOD = "prompt <> '' AND chosen <> '' AND rejected <> '' AND chosen <> rejected"


def _turns_sql(value: str) -> str:
    """A value of the present turns, as one text."""
    return "array_to_string(list_filter([" + ", ".join(value.format(i=i) for i in SLOTS) + "], lambda x: x IS NOT NULL), '|')"


_ROLE = "CASE WHEN dialog_id % 3 = 1 AND r{i} = 'user' THEN 'human' WHEN dialog_id % 3 = 1 AND r{i} = 'assistant' THEN 'gpt' ELSE r{i} END"


@query("p01_message_text", f"SELECT dialog_id, {_turns_sql('t{i}')} AS texts FROM v_dialogs", "v_dialogs")
def p01(spark, sf):
    rows = view(spark, sf, "v_dialogs").select("dialog_id", _messages(SLOTS, "dialog_id % 3 = 1").alias("m"))
    return rows.select("dialog_id", F.array_join(F.transform("m", M.message_text), "|").alias("texts"))


@query("p02_message_role", f"SELECT dialog_id, {_turns_sql(_ROLE)} AS roles FROM v_dialogs", "v_dialogs")
def p02(spark, sf):
    rows = view(spark, sf, "v_dialogs").select("dialog_id", _messages(SLOTS, "dialog_id % 3 = 1").alias("m"))
    return rows.select("dialog_id", F.array_join(F.transform("m", M.message_role), "|").alias("roles"))


@query("p03_user_text", f"SELECT dialog_id, {_USER} AS prompt FROM v_dialogs", "v_dialogs")
def p03(spark, sf):
    rows = _records(spark, sf)
    return rows.select("dialog_id", M.user_text(rows).alias("prompt"))


@query("p04_assistant_text", f"SELECT dialog_id, {_assistant(0, 1)} AS chosen, {_assistant(2, 3)} AS rejected FROM v_dialogs", "v_dialogs")
def p04(spark, sf):
    rows = _records(spark, sf)
    return rows.select("dialog_id", *[M.assistant_text(rows, s).alias(s) for s in ("chosen", "rejected")])


@query("p05_to_preference_pairs", f"SELECT * FROM ({_RAW}) WHERE {_GOOD}", "v_dialogs")
def p05(spark, sf):
    return N.to_preference_pairs(_records(spark, sf), keep=["dialog_id"])


def _shares(spark, sf):
    rows = view(spark, sf, "v_dialogs")
    one = _messages((1,), "TRUE"), _messages((3,), "TRUE")
    return rows.select(
        "dialog_id",
        _messages(SLOTS, "TRUE").alias("conversations"),
        F.expr("'fallback ' || dialog_id").alias("prompt"),
        F.get(one[0], F.lit(0)).alias("chosen"),
        F.get(one[1], F.lit(0)).alias("rejected"),
    )


_FIRST_TURN = "COALESCE(t0, t1, t2, t3)"
_SHARE = f"""SELECT dialog_id, COALESCE(nullif({_STRIP.format(_FIRST_TURN)}, ''), 'fallback ' || dialog_id) AS prompt,
  {_STRIP.format("COALESCE(t1, '')")} AS chosen, {_STRIP.format("COALESCE(t3, '')")} AS rejected FROM v_dialogs"""


@query("p06_sharegpt_to_pairs", f"SELECT * FROM ({_SHARE}) WHERE {_GOOD}", "v_dialogs")
def p06(spark, sf):
    return N.sharegpt_to_pairs(_shares(spark, sf), keep=["dialog_id"])


@query("p07_convert_prefs", f"SELECT dialog_id, prompt, rejected AS chosen, chosen AS rejected FROM ({_RAW}) WHERE {_GOOD}", "v_dialogs")
def p07(spark, sf):
    return N.to_preference_pairs(_records(spark, sf), flip=True, keep=["dialog_id"])


# A share record read as a raw one takes its prompt field; where that is blank it has no user text
# (its answers are not user messages), and the share reading applies.
def _mixed(spark, sf):
    return _shares(spark, sf).withColumn("prompt", F.expr("CASE WHEN dialog_id % 2 = 0 THEN '' ELSE prompt END"))


_MIXED_USER = """CASE WHEN dialog_id % 2 = 1 THEN 'fallback ' || dialog_id WHEN r1 = 'user' THEN t1 WHEN r3 = 'user' THEN t3 ELSE '' END"""
_FLAT = f"""
SELECT dialog_id, CASE WHEN raw THEN rp ELSE sp END AS prompt, CASE WHEN raw THEN rc ELSE sc END AS chosen, CASE WHEN raw THEN rr ELSE sr END AS rejected
FROM (SELECT *, rp <> '' AND rc <> '' AND rr <> '' AND rc <> rr AS raw, sp <> '' AND sc <> '' AND sr <> '' AND sc <> sr AS share
  FROM (SELECT dialog_id, {_MIXED_USER} AS rp, COALESCE(t1, '') AS rc, COALESCE(t3, '') AS rr,
    {_STRIP.format(_FIRST_TURN)} AS sp, {_STRIP.format("COALESCE(t1, '')")} AS sc, {_STRIP.format("COALESCE(t3, '')")} AS sr FROM v_dialogs))
WHERE raw OR share"""


@query("p08_flip_pairs", f"SELECT dialog_id, prompt, rejected AS chosen, chosen AS rejected FROM ({_FLAT})", "v_dialogs")
def p08(spark, sf):
    return N.flip_pairs(_mixed(spark, sf), keep=["dialog_id"])


@query("p09_to_flat", _FLAT, "v_dialogs")
def p09(spark, sf):
    return N.to_flat(_mixed(spark, sf), keep=["dialog_id"])


@query("p10_normalize_text_columns", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS chosen, o_orderstatus AS rejected FROM orders")
def p10(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey AS chosen", "o_orderstatus AS rejected")
    return N.normalize_text_columns(rows)


@query("p11_drop_incomplete", "SELECT pair_id, prompt FROM (SELECT pair_id, CASE WHEN rad IS NOT NULL THEN prompt END AS prompt FROM v_margins) WHERE prompt IS NOT NULL", "v_margins")
def p11(spark, sf):
    rows = view(spark, sf, "v_margins").selectExpr("pair_id", "CASE WHEN rad IS NOT NULL THEN prompt END AS prompt")
    return N.drop_incomplete(rows)


@query("p12_select_fields", "SELECT prompt_id, sample_idx, reward FROM v_responses", "v_responses")
def p12(spark, sf):
    return N.select_fields(view(spark, sf, "v_responses"), ["prompt_id", "sample_idx", "reward"])


@query("a14_conversion_counts", f"SELECT count(*) FILTER (WHERE {_GOOD}) AS kept, count(*) FILTER (WHERE NOT ({_GOOD})) AS skipped FROM ({_RAW})", "v_dialogs")
def a14(spark, sf):
    rows = _records(spark, sf)
    return N.conversion_counts(rows, N.raw_texts(rows))


# ---------------------------------------------------------------------------------------------
# rendering


def _say_sql(role: str, text: str) -> str:
    tail = "'</s>' || chr(10)" if role == "assistant" else "chr(10)"
    return f"('<|{role}|>' || chr(10) || {text} || {tail})"


def _turn_sql(i: int) -> str:
    """Rendering of turn i of a dialog, empty when it is missing."""
    return (
        f"COALESCE('<|' || r{i} || '|>' || chr(10) || t{i} || CASE WHEN r{i} = 'assistant' THEN '</s>' ELSE '' END || chr(10), '')"
    )


_ASK = "'<|assistant|>' || chr(10)"
_DIALOG = " || ".join(_turn_sql(i) for i in SLOTS)


def _count_sql(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '\\s+'), lambda t: t <> ''))"


@query("t01_apply_chat_template", f"SELECT dialog_id, {_DIALOG} AS text, {_DIALOG} || {_ASK} AS open_text FROM v_dialogs", "v_dialogs")
def t01(spark, sf):
    rows = view(spark, sf, "v_dialogs").select("dialog_id", _messages(SLOTS).alias("m"))
    m = F.col("m")
    return rows.select("dialog_id", TEMPLATE.render(m).alias("text"), TEMPLATE.render(m, True).alias("open_text"))


_PROMPT = f"{_say_sql('user', 'prompt')} || {_ASK}"


@query("t02_pair_spans", f"""SELECT pair_id, {_PROMPT} AS formatted_prompt, chosen || '</s>' || chr(10) AS chosen_response_only,
rejected || '</s>' || chr(10) AS rejected_response_only FROM v_pairs""", "v_pairs")
def t02(spark, sf):
    out = T.pair_spans(view(spark, sf, "v_pairs"), TEMPLATE)
    return out.select("pair_id", "formatted_prompt", "chosen_response_only", "rejected_response_only")


@query("t03_format_template", "SELECT pair_id, 'Q: {' || prompt || '} A:' AS prompt FROM v_pairs", "v_pairs")
def t03(spark, sf):
    return view(spark, sf, "v_pairs").select("pair_id", T.format_template(F.col("prompt"), "Q: {{{}}} A:").alias("prompt"))


# the last present turn of a dialog is the response, the turns before it the prompt
_LAST = "CASE WHEN t3 IS NOT NULL THEN 3 WHEN t2 IS NOT NULL THEN 2 WHEN t1 IS NOT NULL THEN 1 ELSE 0 END"


def _head_sql(last: str) -> str:
    return " || ".join(f"CASE WHEN {last} > {i} THEN {_turn_sql(i)} ELSE '' END" for i in SLOTS)


_SFT = f"""SELECT dialog_id, prompt, substr(whole, length(prompt) + 1) AS response, least({_count_sql('prompt')}, 120) AS prompt_ids_len
FROM (SELECT dialog_id, {_head_sql(_LAST)} || {_ASK} AS prompt, {_DIALOG} AS whole FROM v_dialogs)"""


@query("t04_sft_samples", f"SELECT * FROM ({_SFT}) WHERE prompt <> '' AND response <> '' AND prompt_ids_len < 118", "v_dialogs")
def t04(spark, sf):
    rows = view(spark, sf, "v_dialogs").select("dialog_id", _messages(SLOTS).alias("messages"))
    return T.sft_samples(rows, "messages", None, TOKENIZER, 120, TEMPLATE, keep=["dialog_id"])


@query("t05_preference_samples", f"""SELECT * FROM (SELECT pair_id, {_PROMPT} AS prompt, chosen || '</s>' || chr(10) AS chosen,
rejected || '</s>' || chr(10) AS rejected, CASE WHEN pair_id % 2 = 0 THEN 0e0 ELSE pair_id / 1e1 END AS margin,
least({_count_sql(_PROMPT)}, 40) AS prompt_ids_len FROM v_pairs) WHERE prompt_ids_len < 38""", "v_pairs")
def t05(spark, sf):
    rows = view(spark, sf, "v_pairs").withColumn("margin", F.expr("CASE WHEN pair_id % 2 = 1 THEN pair_id / 1e1 END"))
    return T.preference_samples(rows, TOKENIZER, 40, template=TEMPLATE, keep=["pair_id"])


@query("t06_prompt_samples", """SELECT position, CASE WHEN position % 6 = 0 THEN 'default' ELSE datasource END AS datasource,
'Ask: ' || input AS prompt, CAST(CAST(score AS BIGINT) AS VARCHAR) AS label FROM v_responses""", "v_responses")
def t06(spark, sf):
    rows = run_sql(spark, sf, """SELECT position, CASE WHEN position % 6 <> 0 THEN datasource END AS datasource, input,
      CAST(score AS BIGINT) AS answer FROM {v_responses}""")
    return T.prompt_samples(rows, "input", "answer", input_template="Ask: {}", keep=["position"])


_UNPAIRED = f"""SELECT d.doc_id, d.text AS prompt, d.lang || ' ' || d.source AS response, l.quality AS label,
  least({_count_sql('d.text')}, 300) AS prompt_ids_len FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""


@query("t07_unpaired_samples", f"SELECT * FROM ({_UNPAIRED}) WHERE prompt_ids_len < 298")
def t07(spark, sf):
    rows = run_sql(spark, sf, """SELECT d.doc_id, d.text AS input, d.lang || ' ' || d.source AS output, l.quality
      FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""")
    return T.unpaired_samples(rows, "input", "output", "quality", TOKENIZER, 300, keep=["doc_id"])


_TEXT = "regexp_replace(prompt || reply, '\\n+$', '')"
_REPLIES = "SELECT pair_id, prompt, CASE pair_id % 3 WHEN 0 THEN chosen || chr(10) || chr(10) WHEN 1 THEN chosen || '</s>' || chr(10) ELSE chosen END AS reply FROM {v_pairs}"


@query("t08_assemble_text", f"""SELECT pair_id, CASE WHEN suffix(x, '</s>') THEN x ELSE x || ' </s>' END AS text
FROM (SELECT pair_id, {_TEXT} AS x FROM ({_REPLIES.format(v_pairs='v_pairs')}))""", "v_pairs")
def t08(spark, sf):
    rows = run_sql(spark, sf, _REPLIES.replace("chr(10)", "char(10)"))
    return rows.select("pair_id", T.assemble_text(F.col("prompt"), F.col("reply"), "</s>").alias("text"))


# ---------------------------------------------------------------------------------------------
# tokens


def _id_sql(token: str) -> str:
    return f"CASE WHEN {token} = '</s>' THEN 2 ELSE ('0x' || substr(md5({token}), 1, 8))::BIGINT % 1000000 + 3 END"


def _ids_sql(text: str) -> str:
    return f"list_transform(list_filter(string_split_regex({text}, '\\s+'), lambda t: t <> ''), lambda t: {_id_sql('t')})"


@query("t09_tokenize_truncate", f"""SELECT doc_id, len(ids) AS n, list_sum(ids[1:len(ids) - 1]) AS head_sum, ids[len(ids)] AS last_id
FROM (SELECT doc_id, list_append(x[1:least(len(x), 512) - 1], 2) AS ids FROM (SELECT doc_id, {_ids_sql("text || ' </s>'")} AS x FROM documents))""")
def t09(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" </s>")).alias("text"))
    out = T.tokenize_truncate(rows, "text", TOKENIZER, 512)
    longs = F.col("ids").cast("array<bigint>")
    head = F.aggregate(A.cut(longs, F.size("ids") - 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", F.size("ids").alias("n"), F.when(F.size("ids") > 1, head).alias("head_sum"), F.element_at("ids", -1).alias("last_id"))


@query("t10_token_lengths", f"""SELECT pair_id, {_count_sql('chosen')} AS chosen_len, {_count_sql('rejected')} AS rejected_len,
{_count_sql('chosen')} - {_count_sql('rejected')} AS len_gap FROM v_pairs""", "v_pairs")
def t10(spark, sf):
    return T.token_lengths(view(spark, sf, "v_pairs"), TOKENIZER).select("pair_id", "chosen_len", "rejected_len", "len_gap")


_LIST = "array_to_string({}, ',')"


@query("t11_pair_token_ids", f"""SELECT pair_id, len(p) AS prompt_len, len(c) AS chosen_len,
{_LIST.format("list_resize(list_concat(p, c)[1:64], 64, 0)")} AS chosen_ids, least(len(p) + len(c), 64) AS kept,
{_LIST.format("list_resize(list_concat(p, r)[1:64], 64, 0)")} AS rejected_ids, least(len(p) + len(r), 64) AS rejected_kept
FROM (SELECT pair_id, {_ids_sql(_PROMPT)} AS p, {_ids_sql("chosen || '</s>' || chr(10) || '</s>'")} AS c,
  {_ids_sql("rejected || '</s>' || chr(10) || '</s>'")} AS r FROM v_pairs)""", "v_pairs")
def t11(spark, sf):
    out = T.pair_token_ids(view(spark, sf, "v_pairs"), TOKENIZER, TEMPLATE, 64)
    kept = {c: F.aggregate(f"{c}_mask", F.lit(0), lambda a, x: a + x) for c in ("chosen", "rejected")}
    return out.select(
        "pair_id", "prompt_len", "chosen_len",
        joined(F.col("chosen_ids")).alias("chosen_ids"), kept["chosen"].alias("kept"),
        joined(F.col("rejected_ids")).alias("rejected_ids"), kept["rejected"].alias("rejected_kept"),
    )


_SHORT = f"SELECT pair_id, CAST(FLOOR(pair_id / 400e0) AS BIGINT) AS batch, {_ids_sql('chosen')} AS ids FROM v_pairs"


def _batched_ids(spark, sf):
    rows = view(spark, sf, "v_pairs").withColumn("batch", F.expr("CAST(FLOOR(pair_id / 400e0) AS BIGINT)"))
    return rows.select("pair_id", "batch", TOKENIZER.ids(F.col("chosen")).alias("ids"))


@query("t12_pad_batch", f"""SELECT pair_id, len(ids) AS n, m AS padded, {_LIST.format("list_concat(list_resize([]::BIGINT[], m - len(ids), 0), ids)")} AS ids
FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS m FROM ({_SHORT}))""", "v_pairs")
def t12(spark, sf):
    rows = _batched_ids(spark, sf).withColumn("n", F.size("ids"))
    out = T.pad_batch(rows, {"ids": 0}, "batch", "left")
    return out.select("pair_id", "n", F.size("ids").alias("padded"), joined(F.col("ids")).alias("ids"))


@query("t13_strip_padding", f"SELECT pair_id, {_LIST.format('ids')} AS ids, {_LIST.format('ids')} AS right_ids FROM ({_SHORT})", "v_pairs")
def t13(spark, sf):
    rows = _batched_ids(spark, sf).withColumn("mask", F.transform("ids", lambda _: F.lit(1))).withColumn("ids2", F.col("ids"))
    left = T.pad_batch(rows, {"ids": 0, "mask": 0}, "batch", "left")
    left = left.withColumn("ids", T.strip_padding(F.col("ids"), F.col("mask")))
    right = left.withColumn("mask", F.transform("ids2", lambda _: F.lit(1)))
    right = T.pad_batch(right, {"ids2": 0, "mask": 0}, "batch", "right")
    kept = T.strip_right_padding(F.col("ids2"), F.col("mask"))
    return right.select("pair_id", joined(F.col("ids")).alias("ids"), joined(kept).alias("right_ids"))


@query("t14_sft_loss_mask", f"""SELECT pair_id, n, {_LIST.format("list_transform(range(n), lambda i: CASE WHEN i >= p - 1 AND i < n - 1 AND p > 0 THEN 1 ELSE 0 END)")} AS mask
FROM (SELECT pair_id, {_count_sql('prompt')} + {_count_sql('chosen')} AS n, {_count_sql('prompt')} AS p FROM v_pairs)""", "v_pairs")
def t14(spark, sf):
    p, c = TOKENIZER.count(F.col("prompt")), TOKENIZER.count(F.col("chosen"))
    rows = view(spark, sf, "v_pairs").select("pair_id", (p + c).alias("n"), p.alias("p"))
    return rows.select("pair_id", "n", joined(T.sft_loss_mask(F.col("n"), F.col("p"))).alias("mask"))


def _range_sql(i: int) -> str:
    head = " || ".join([_turn_sql(j) for j in range(i)] + [_ASK])
    start = f"least({_count_sql(head)}, 4096)"
    answer = f"(t{i} || '</s>' || chr(10))"
    return f"CASE WHEN r{i} = 'assistant' THEN {start} || ':' || ({start} + least({_count_sql(answer)}, 4096) - 1) END"


@query("t15_multiturn_response_ranges", "SELECT dialog_id, array_to_string(list_filter(["
       + ", ".join(_range_sql(i) for i in SLOTS) + "], lambda x: x IS NOT NULL), ',') AS ranges FROM v_dialogs", "v_dialogs")
def t15(spark, sf):
    rows = view(spark, sf, "v_dialogs").select("dialog_id", _messages(SLOTS).alias("m"))
    ranges = T.multiturn_response_ranges(F.col("m"), TOKENIZER, TEMPLATE, 4096)
    text = F.transform(ranges, lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string")))
    return rows.select("dialog_id", F.array_join(text, ",").alias("ranges"))


def _span_sql(i: int) -> str:
    head = " || ".join([_turn_sql(j) for j in range(i)] + [_ASK])
    start = f"least({_count_sql(head)}, 4096)"
    answer = f"(t{i} || '</s>' || chr(10))"
    return f"CASE WHEN r{i} = 'assistant' THEN {{'a': {start} - 1, 'b': {start} + least({_count_sql(answer)}, 4096) - 1}} END"


@query("t15_multiturn_loss_mask", "SELECT dialog_id, n, array_to_string(list_transform(range(n), "
       "lambda i: CASE WHEN len(list_filter(spans, lambda s: s.a <= i AND i < s.b)) > 0 THEN 1 ELSE 0 END), ',') AS mask "
       f"FROM (SELECT dialog_id, {_count_sql(_DIALOG)} AS n, list_filter([" + ", ".join(_span_sql(i) for i in SLOTS)
       + "], lambda x: x IS NOT NULL) AS spans FROM v_dialogs)", "v_dialogs")
def t15b(spark, sf):
    rows = view(spark, sf, "v_dialogs").select("dialog_id", _messages(SLOTS).alias("m"))
    rows = rows.select(
        "dialog_id", TOKENIZER.count(TEMPLATE.render(F.col("m"))).alias("n"),
        T.multiturn_response_ranges(F.col("m"), TOKENIZER, TEMPLATE, 4096).alias("ranges"),
    )
    return rows.select("dialog_id", "n", joined(T.ranges_loss_mask(F.col("n"), F.col("ranges"))).alias("mask"))


# step labels 1, 2, 3, … on the seven-letter words of each document
_WORDS = "SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS w FROM documents"


@query("t16_process_reward_labels", f"""SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE length(w) = 7) AS labelled,
CAST(sum(CASE WHEN length(w) = 7 THEN 0 ELSE -100 END) AS DOUBLE) + count(*) FILTER (WHERE length(w) = 7) * (count(*) FILTER (WHERE length(w) = 7) + 1) / 2e0 AS total
FROM ({_WORDS}) GROUP BY 1""")
def t16(spark, sf):
    ids = F.transform(TOKENIZER.tokens(F.col("text")), F.length)
    rows = table(spark, sf, "documents").select("doc_id", ids.alias("ids")).where(F.size("ids") > 0)
    # one label more than there are placeholders: the surplus is cut
    steps = F.sequence(F.lit(1), F.size(F.filter("ids", lambda t: t == 7)) + 1).cast("array<double>")
    rows = rows.withColumn("labels", T.process_reward_labels(F.col("ids"), steps, 7))
    return rows.select(
        "doc_id", F.size("ids").alias("n"), F.size(F.filter("labels", lambda x: x != -100)).alias("labelled"), A.array_sum(F.col("labels")).alias("total")
    )


@query("t17_kto_unmatched_pairs", """
WITH d AS (SELECT doc_id AS position, source || doc_id AS prompt, lang || '-' || doc_id AS response, doc_id % 2 AS label, doc_id // 8 AS batch FROM documents)
SELECT * FROM d UNION ALL
SELECT position, prompt, COALESCE(lead(response) OVER w, first_value(response) OVER w), -1, batch FROM d WINDOW w AS (PARTITION BY batch ORDER BY position)""")
def t17(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id AS position", "source || doc_id AS prompt", "lang || '-' || doc_id AS response", "doc_id % 2 AS label"
    )
    return T.kto_unmatched_pairs(rows, 8)


@query("t18_csft_prompt_suffix", "SELECT position, input || '<rm_score>: 5.00 ' AS prompt FROM v_responses", "v_responses")
def t18(spark, sf):
    return view(spark, sf, "v_responses").select("position", T.csft_prompt_suffix(F.col("input"), " <rm_score>: 5.00 ").alias("prompt"))


@query("t19_expand_samples", """SELECT o_orderkey AS position, s AS sample_idx, o_orderkey * 3 + s AS consecutive,
s * (SELECT count(*) FROM orders) + o_orderkey AS passes FROM orders, unnest(range(3)) t(s)""")
def t19(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS position")
    near = T.expand_samples(rows, 3).withColumnRenamed("sample_position", "consecutive")
    far = T.expand_samples(rows, 3, consecutive=False).withColumnRenamed("sample_position", "passes")
    return near.join(far, ["position", "sample_idx"])


@query("t20_rollout_row", f"""SELECT pair_id, {_LIST.format('list_concat(p, c)[1:100]')} AS sequences,
{_LIST.format("list_transform(range(1, least(len(p) + len(c), 100)), lambda i: CASE WHEN i >= len(p) THEN 1 ELSE 0 END)")} AS action_mask,
len(c) AS response_length, least(len(p) + len(c), 100) AS total_length, CASE WHEN len(c) >= 60 THEN 1 ELSE 0 END AS clipped
FROM (SELECT pair_id, {_ids_sql('prompt')} AS p, {_ids_sql('chosen')} AS c FROM v_pairs)""", "v_pairs")
def t20(spark, sf):
    rows = view(spark, sf, "v_pairs").select(
        "pair_id", TOKENIZER.ids(F.col("prompt")).alias("p"), TOKENIZER.ids(F.col("chosen")).alias("c")
    )
    out = T.rollout_row(rows, "p", "c", 40, 60)
    return out.select(
        "pair_id", joined(F.col("sequences")).alias("sequences"), joined(F.col("action_mask")).alias("action_mask"),
        "response_length", "total_length", "clipped",
    )


@query("t21_strip_prompt_echo", "SELECT pair_id, chosen AS output FROM v_pairs", "v_pairs")
def t21(spark, sf):
    rows = view(spark, sf, "v_pairs")
    return rows.select("pair_id", T.strip_prompt_echo(F.concat("prompt", "chosen"), F.col("prompt")).alias("output"))
