"""Queries: sources, joins, feature arithmetic and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.functions import scores as S
from prefspark.operators import features as FE
from prefspark.operators import joins as J
from prefspark.operators import positions as P
from prefspark.operators import select as K
from prefspark.plans.pipelines import build_subsets, prepare_features, select_subset
from prefspark.plans.registry import q6, query, r6
from prefspark.plans.views import run_sql, table, view
from prefspark.session import scratch_path
from prefspark.schema import PAIR_KEY
from prefspark.sources import readers, writers

TAU = 20.0
TOP = 30_000  # the usual subset size

# ---------------------------------------------------------------------------------------------
# sources and sinks

_PAIRS_SQL = "SELECT prompt, chosen, rejected FROM v_pairs"


@query("s01_read_pairs", _PAIRS_SQL, "v_pairs")
def s01(spark, sf):
    path = scratch_path(spark, "pairs")
    writers.write_jsonl(view(spark, sf, "v_pairs").select(*PAIR_KEY), path)
    return readers.read_pairs(spark, path)


@query("s02_read_jsonl", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s02(spark, sf):
    docs = table(spark, sf, "documents")
    path = scratch_path(spark, "documents")
    writers.write_jsonl(docs, path)
    return readers.read_jsonl(spark, path, docs.schema)


@query("s03_read_split", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def s03(spark, sf):
    root = scratch_path(spark, "splits")
    turns = table(spark, sf, "conversations").withColumnRenamed("role", "split")
    turns.write.partitionBy("split").parquet(root)
    return readers.read_split(spark, root, "user").select("conv_id", "turn", "text")


@query("s04_read_any", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT page_id, html FROM pages "
       "UNION ALL SELECT item_id, text FROM benchmark")
def s04(spark, sf):
    root = scratch_path(spark, "mixed")
    table(spark, sf, "documents").selectExpr("doc_id AS id", "text").write.parquet(f"{root}/a.parquet")
    table(spark, sf, "pages").selectExpr("page_id AS id", "html AS text").write.json(f"{root}/b.jsonl")
    bench = table(spark, sf, "benchmark").selectExpr("item_id AS id", "text")
    bench.write.option("header", True).option("escape", '"').csv(f"{root}/c.csv")
    parts = readers.read_any(spark, f"{root}/a.parquet, {root}/b.jsonl, {root}/c.csv", bench.schema)
    return reduce(DataFrame.unionByName, parts)


@query("s05_head_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def s05(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return P.head_limit(rows, 500, F.col("o_totalprice"), ["o_orderkey"])


@query("s06_iteration_slice", """
SELECT position, o_orderkey FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders)
WHERE position >= 3 * 256 AND position < 4 * 256""")
def s06(spark, sf):
    placed = P.dense_position(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])
    return P.iteration_slice(placed, 3, 256).select("position", "o_orderkey")


@query("s07_write_jsonl", "SELECT count(*) AS written, count(*) AS read_back, count(rad) AS with_rad FROM v_margins", "v_margins")
def s07(spark, sf):
    path = scratch_path(spark, "margins")
    rows = view(spark, sf, "v_margins")
    written = writers.write_jsonl(rows, path)
    return readers.read_jsonl(spark, path, rows.schema).agg(
        F.lit(written).alias("written"), F.count(F.lit(1)).alias("read_back"), F.count("rad").alias("with_rad")
    )


@query("s08_write_subset", "SELECT prompt, chosen, rejected FROM v_margins ORDER BY im DESC NULLS LAST, pair_id LIMIT 2000", "v_margins")
def s08(spark, sf):
    out = scratch_path(spark, "subsets")
    path = writers.write_subset(K.select_im(view(spark, sf, "v_margins"), 2000), out, "im", 2000)
    return readers.read_pairs(spark, path)


@query("s10_merge_shards", "SELECT o_orderkey, o_custkey FROM orders")
def s10(spark, sf):
    root = scratch_path(spark, "shards")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    sharded = P.shard_round_robin(rows, 4, "o_orderkey")
    sharded.write.partitionBy("shard").json(root)
    writers.merge_shards_to(spark, [f"{root}/shard={i}" for i in range(4)], rows.schema, f"{root}/merged")
    return readers.read_any(spark, root, rows.schema, split="merged")[0]


@query("s09_subset_names", """
SELECT pair_id, 'rad_ang_tau' || CASE WHEN pair_id % 2 = 0 THEN '20' ELSE '2p5' END || '_' ||
  CASE WHEN pair_id % 3 = 0 THEN '30k' ELSE '1500' END AS name FROM v_margins""", "v_margins")
def s09(spark, sf):
    name = lambda t, k: F.lit(writers.subset_name("rad_ang", k, t))
    whole, thousands = F.col("pair_id") % 2 == 0, F.col("pair_id") % 3 == 0
    named = F.when(whole & thousands, name(20.0, 30_000)).when(whole, name(20.0, 1_500))
    named = named.when(thousands, name(2.5, 30_000)).otherwise(name(2.5, 1_500))
    return view(spark, sf, "v_margins").select("pair_id", named.alias("name"))



@query("s11_skip_existing", "SELECT count(*) AS rows_kept, 0 AS rewritten FROM orders")
def s11(spark, sf):
    path = scratch_path(spark, "keep")
    rows = table(spark, sf, "orders").select("o_orderkey")
    writers.write_jsonl(rows, path)
    again = writers.write_jsonl(rows.selectExpr("o_orderkey + 1 AS o_orderkey"), path, force=False)
    return readers.read_jsonl(spark, path, rows.schema).agg(
        F.count(F.lit(1)).alias("rows_kept"), F.lit(again).alias("rewritten")
    )


_ANG = "-ref_chosen_logprob / chosen_len + ref_rejected_logprob / rejected_len"


def _two_stage_sql(tau: float, k: int, columns: str = "pair_id, prompt, chosen, rejected") -> str:
    return f"""
SELECT {columns}, {q6('k.ang')} AS ang FROM (
  SELECT pair_id, prompt, CASE WHEN rad > {tau} THEN chosen ELSE rejected END AS chosen,
    CASE WHEN rad > {tau} THEN rejected ELSE chosen END AS rejected,
    CASE WHEN rad > {tau} THEN 0 ELSE 1 END AS flipped,
    CASE WHEN rad > {tau} THEN 1 ELSE -1 END * ({_ANG}) AS ang
  FROM v_margins WHERE rad > {tau} OR rad < -{tau}) k
ORDER BY k.ang DESC, flipped, pair_id LIMIT {k}"""


def _features(spark, sf):
    return FE.ref_logprob_features(view(spark, sf, "v_margins"))


@query("s12_tau_sweep", " UNION ALL ".join(
    f"(SELECT {t}e0 AS tau, * FROM ({_two_stage_sql(t, 400, 'pair_id')}))" for t in (10, 20, 40)), "v_margins")
def s12(spark, sf):
    out = K.tau_sweep(_features(spark, sf), 400, [10, 20, 40])
    return out.select("tau", "pair_id", r6("ang").alias("ang"))


@query("s12_write_tau_sweep", " UNION ALL ".join(
    f"(SELECT {t}e0 AS tau, prompt, chosen, rejected FROM ({_two_stage_sql(t, 400)}))" for t in (10, 20, 40)), "v_margins")
def s12_written(spark, sf):
    root = scratch_path(spark, "sweep")
    writers.write_tau_sweep(K.tau_sweep(_features(spark, sf), 400, [10, 20, 40]), root)
    return readers.read_jsonl(spark, root, "tau double, prompt string, chosen string, rejected string")


@query("s13_holdout_head", """
SELECT o_orderkey AS position, o_custkey FROM orders
WHERE o_orderkey < least(200, (SELECT CAST(floor(count(*) * 0.01e0) AS BIGINT) FROM orders))""")
def s13(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS position", "o_custkey")
    return P.holdout_head(rows, 200)


# ---------------------------------------------------------------------------------------------
# joins


def _im(spark, sf):
    return view(spark, sf, "v_margins").selectExpr(
        *PAIR_KEY, "pair_id", "im AS margin", "ref_chosen_logprob", "ref_rejected_logprob"
    )


def _rad(spark, sf):
    return run_sql(spark, sf, """
SELECT prompt, chosen, rejected, rad AS margin, policy_chosen_logprob AS ref_chosen_logprob,
  policy_rejected_logprob AS ref_rejected_logprob FROM {v_margins} WHERE rad IS NOT NULL""")


def _em(spark, sf):
    return run_sql(spark, sf, "SELECT prompt, chosen, rejected, em_margin AS em, pair_id % 5 AS aspect FROM {v_margins} WHERE em_margin > -15")


@query("j01_pair_key", "SELECT count(*) AS pairs, count(DISTINCT (prompt, chosen, rejected)) AS keys FROM v_pairs", "v_pairs")
def j01(spark, sf):
    keyed = view(spark, sf, "v_pairs").select(J.pair_key().alias("key"))
    per_key = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("keys"))


@query("j02_merge_im_rad", f"""
SELECT pair_id, im, rad, {q6('CASE WHEN rad IS NOT NULL THEN policy_chosen_logprob END')} AS inv_chosen_logprob,
  {q6('CASE WHEN rad IS NOT NULL THEN policy_rejected_logprob END')} AS inv_rejected_logprob FROM v_margins""", "v_margins")
def j02(spark, sf):
    out = J.merge_im_rad(_im(spark, sf), _rad(spark, sf))
    return out.select("pair_id", "im", "rad", *[r6(f"inv_{s}_logprob").alias(f"inv_{s}_logprob") for s in ("chosen", "rejected")])


@query("j03_merge_em", """
SELECT pair_id, CASE WHEN em_margin > -15 THEN em_margin END AS em, CASE WHEN em_margin > -15 THEN em_margin END AS em_margin,
  CASE WHEN em_margin > -15 THEN pair_id % 5 END AS aspect FROM v_margins""", "v_margins")
def j03(spark, sf):
    return J.merge_em(_im(spark, sf), _em(spark, sf)).select("pair_id", "em", "em_margin", "aspect")


@query("j04_attach_rewards", """
SELECT position AS sample_id, reward, COALESCE(CASE WHEN position % 3 <> 0 THEN score END, reward) AS score,
  COALESCE(CASE WHEN position % 3 <> 0 THEN score END, reward) AS info_score, reward AS info_reward, position * 1e0 AS info_tokens,
  7e0 AS info_old FROM v_responses""", "v_responses")
def j04(spark, sf):
    rows = view(spark, sf, "v_responses")
    samples = rows.selectExpr("position AS sample_id", "map('old', 7e0, 'reward', -1e0) AS info")
    rewards = rows.selectExpr(
        "position AS sample_id", "reward AS rewards", "CASE WHEN position % 3 <> 0 THEN score END AS scores",
        "map('tokens', position * 1e0) AS extra_logs",
    )
    out = J.attach_rewards(samples, rewards)
    info = [F.col("info")[k].alias(f"info_{k}") for k in ("score", "reward", "tokens", "old")]
    return out.select("sample_id", "reward", "score", *info)


_PROMPTS = """
SELECT 'input ' || (event_id - event_id % 8) AS prompt, 'ds' || (event_id % 3) AS datasource, event_id AS position FROM {events}"""


@query("j05_prompt_to_datasource", """
SELECT 'input ' || (event_id - event_id % 8) AS prompt, 'ds' || (max(event_id) % 3) AS datasource FROM events GROUP BY 1""")
def j05(spark, sf):
    return J.prompt_to_datasource(run_sql(spark, sf, _PROMPTS))


@query("j06_policy_reference_join", "SELECT pair_id, policy_chosen_logprob, policy_rejected_logprob, "
       f"{q6('ref_chosen_logprob')} AS ref_chosen_logprob, {q6('ref_rejected_logprob')} AS ref_rejected_logprob FROM v_margins", "v_margins")
def j06(spark, sf):
    rows = view(spark, sf, "v_margins")
    policy, ref = [
        rows.selectExpr("pair_id", f"{m}_chosen_logprob AS chosen_logprob", f"{m}_rejected_logprob AS rejected_logprob")
        for m in ("policy", "ref")
    ]
    out = J.policy_reference_join(policy, ref)
    return out.select(
        "pair_id", "policy_chosen_logprob", "policy_rejected_logprob",
        *[r6(f"ref_{s}_logprob").alias(f"ref_{s}_logprob") for s in ("chosen", "rejected")],
    )


@query("a15_unmatched_count", "SELECT count(*) - count(rad) AS unmatched FROM v_margins", "v_margins")
def a15(spark, sf):
    return J.unmatched_count(J.merge_im_rad(_im(spark, sf), _rad(spark, sf)))


# ---------------------------------------------------------------------------------------------
# feature arithmetic

_H = "(policy_chosen_logprob - policy_rejected_logprob) - (ref_chosen_logprob - ref_rejected_logprob)"


@query("f01_implicit_margin", f"SELECT pair_id, {q6(_H)} AS margin FROM v_margins", "v_margins")
def f01(spark, sf):
    return FE.add_margin(view(spark, sf, "v_margins")).select("pair_id", r6("margin").alias("margin"))


@query("f02_alignment_discrepancy", f"SELECT pair_id, {q6('im - em_margin')} AS rad_by_margins, {q6(_H)} AS rad_by_models FROM v_margins", "v_margins")
def f02(spark, sf):
    rows = view(spark, sf, "v_margins").drop("rad")
    out = FE.add_discrepancy(rows, "im", "em_margin", "rad_by_margins")
    out = FE.add_margin(out, "rad_by_models", "policy", "ref")
    return out.select("pair_id", r6("rad_by_margins").alias("rad_by_margins"), r6("rad_by_models").alias("rad_by_models"))


_F03 = {
    "original_avg_chosen_logprobs": "ref_chosen_logprob / chosen_len",
    "original_avg_rejected_logprobs": "ref_rejected_logprob / rejected_len",
    "original_chosen_ppl": "exp(-ref_chosen_logprob / chosen_len)",
    "original_rejected_ppl": "exp(-ref_rejected_logprob / rejected_len)",
    "ang": _ANG,
    "original_avg_logprobs_gap": "ref_chosen_logprob / chosen_len - ref_rejected_logprob / rejected_len",
    "original_ppl_gap": "exp(-ref_chosen_logprob / chosen_len) - exp(-ref_rejected_logprob / rejected_len)",
}


@query("f03_ref_logprob_features", "SELECT pair_id, " + ", ".join(f"{q6(e)} AS {n}" for n, e in _F03.items())
       + " FROM (SELECT * REPLACE (CASE WHEN pair_id % 17 = 0 THEN 0 ELSE chosen_len END AS chosen_len) FROM v_margins) WHERE chosen_len > 0", "v_margins")
def f03(spark, sf):
    rows = view(spark, sf, "v_margins")
    rows = rows.withColumn("chosen_len", F.when(F.col("pair_id") % 17 == 0, 0).otherwise(F.col("chosen_len")))
    return FE.ref_logprob_features(rows).select("pair_id", *[r6(n).alias(n) for n in _F03])


@query("f04_ensure_im", "SELECT pair_id, em_margin AS margin, em_margin AS im FROM v_margins", "v_margins")
def f04(spark, sf):
    return J.ensure_im(view(spark, sf, "v_margins").selectExpr("pair_id", "em_margin AS margin"))


def _norm(x: str) -> str:
    return f"(CASE WHEN {x} < -2 THEN -2e0 WHEN {x} > 30 THEN 30e0 ELSE {x} END + 2) / 32"


@query("f05_normalize_margin", f"SELECT pair_id, {q6(_norm('im'))} AS p, {q6(_norm('rad'))} AS q FROM v_margins", "v_margins")
def f05(spark, sf):
    rows = view(spark, sf, "v_margins")
    return rows.select("pair_id", r6(S.normalize_margin(F.col("im"))).alias("p"), r6(S.normalize_margin(F.col("rad"))).alias("q"))


_P, _Q = _norm("em_margin"), _norm("im")
_JOINT = f"({_P}) * ({_Q}) / nullif(({_P}) * ({_Q}) + (1 - ({_P})) * (1 - ({_Q})), 0)"


@query("f06_joint_prob", f"SELECT pair_id, {q6(_JOINT)} AS joint_prob FROM v_margins", "v_margins")
def f06(spark, sf):
    return view(spark, sf, "v_margins").select("pair_id", r6(S.joint_score(F.col("em_margin"), F.col("im"))).alias("joint_prob"))


@query("f07_map_score", f"SELECT pair_id, {q6('abs(em_margin) - abs(im)')} AS map FROM v_margins", "v_margins")
def f07(spark, sf):
    return view(spark, sf, "v_margins").select("pair_id", r6(S.disagreement_score(F.col("em_margin"), F.col("im"))).alias("map"))


@query("f18_implicit_rewards", f"""SELECT pair_id, {q6('0.1e0 * (policy_chosen_logprob - ref_chosen_logprob)')} AS chosen_reward,
{q6('0.1e0 * (policy_rejected_logprob - ref_rejected_logprob)')} AS rejected_reward FROM v_margins""", "v_margins")
def f18(spark, sf):
    out = FE.implicit_rewards(view(spark, sf, "v_margins"), 0.1)
    return out.select("pair_id", r6("chosen_reward").alias("chosen_reward"), r6("rejected_reward").alias("rejected_reward"))


# ---------------------------------------------------------------------------------------------
# selection


def _top_sql(key: str, k: int, where: str = "TRUE") -> str:
    return f"""SELECT pair_id, {q6('t.v')} AS v FROM (SELECT pair_id, {key} AS v FROM v_margins WHERE {where}) t
ORDER BY (t.v IS NULL), t.v DESC, pair_id LIMIT {k}"""


@query("k01_select_im", _top_sql("im", 4000), "v_margins")
def k01(spark, sf):
    return K.select_im(view(spark, sf, "v_margins"), 4000).select("pair_id", r6("im").alias("v"))


@query("k02_select_em", _top_sql("em_margin", 4000), "v_margins")
def k02(spark, sf):
    return K.select_em(view(spark, sf, "v_margins"), 4000).select("pair_id", r6("em_margin").alias("v"))


@query("k03_select_longest", "SELECT pair_id, chosen_len FROM v_margins ORDER BY chosen_len DESC, pair_id LIMIT 4000", "v_margins")
def k03(spark, sf):
    return K.select_longest(view(spark, sf, "v_margins"), 4000).select("pair_id", "chosen_len")


@query("k04_select_ppl_gap", _top_sql(_F03["original_ppl_gap"], 4000), "v_margins")
def k04(spark, sf):
    return K.select_ppl_gap(_features(spark, sf), 4000).select("pair_id", r6("original_ppl_gap").alias("v"))


@query("k04_select_logprob_gap", _top_sql(_F03["original_avg_logprobs_gap"], 4000), "v_margins")
def k04b(spark, sf):
    out = K.select_ppl_gap(_features(spark, sf), 4000, use_ppl=False)
    return out.select("pair_id", r6("original_avg_logprobs_gap").alias("v"))


@query("k05_select_map", _top_sql("abs(em_margin) - abs(im)", 4000), "v_margins")
def k05(spark, sf):
    return K.select_map(view(spark, sf, "v_margins"), 4000).select("pair_id", r6("map").alias("v"))


@query("k06_select_joint", _top_sql(_JOINT, 4000), "v_margins")
def k06(spark, sf):
    return K.select_joint(view(spark, sf, "v_margins"), 4000).select("pair_id", r6("joint_prob").alias("v"))


@query("k07_select_rip", """SELECT pair_id, rejected_len FROM v_margins WHERE em_margin > 0.126e0
ORDER BY rejected_len DESC, pair_id LIMIT 4000""", "v_margins")
def k07(spark, sf):
    return K.select_rip(view(spark, sf, "v_margins"), 4000).select("pair_id", "rejected_len")


@query("k08_rank_by_ang", _top_sql(_ANG, 4000), "v_margins")
def k08(spark, sf):
    return K.rank_by_ang(_features(spark, sf), 4000).select("pair_id", r6("ang").alias("v"))


@query("k09_flip_pairs_with_features", f"""SELECT pair_id, rejected AS chosen, chosen AS rejected, rejected_len AS chosen_len,
chosen_len AS rejected_len, {q6('ref_rejected_logprob')} AS ref_chosen_logprob, {q6(_F03['original_rejected_ppl'])} AS original_chosen_ppl,
{q6('-(' + _ANG + ')')} AS ang, {q6('-(' + _F03['original_ppl_gap'] + ')')} AS original_ppl_gap, rad, im FROM v_margins""", "v_margins")
def k09(spark, sf):
    out = K.flip_columns(_features(spark, sf))
    rounded = ("ref_chosen_logprob", "original_chosen_ppl", "ang", "original_ppl_gap")
    return out.select("pair_id", "chosen", "rejected", "chosen_len", "rejected_len", *[r6(c).alias(c) for c in rounded], "rad", "im")


@query("k10_select_rad_ang", _two_stage_sql(20, TOP), "v_margins")
def k10(spark, sf):
    out = K.select_rad_ang(_features(spark, sf), TOP, TAU)
    return out.select("pair_id", "prompt", "chosen", "rejected", r6("ang").alias("ang"))


@query("k10_select_rad_ang_cut", _two_stage_sql(20, 2000), "v_margins")
def k10_cut(spark, sf):
    out = K.select_rad_ang(_features(spark, sf), 2000, TAU)
    return out.select("pair_id", "prompt", "chosen", "rejected", r6("ang").alias("ang"))


@query("k11_order_curriculum", f"""SELECT pair_id, {q6('ang')} AS ang, row_number() OVER (ORDER BY k.ang, pair_id) - 1 AS position
FROM (SELECT pair_id, {_ANG} AS ang FROM v_margins) k""", "v_margins")
def k11(spark, sf):
    out = K.order_curriculum(_features(spark, sf).select("pair_id", "ang"), "easy-to-hard")
    return out.select("pair_id", r6("ang").alias("ang"), "position")


@query("k12_build_subsets", " UNION ALL ".join(
    f"(SELECT '{m}' AS method, prompt, chosen, rejected FROM v_margins WHERE {w} ORDER BY ({k}) IS NULL, {k} DESC, pair_id LIMIT 1000)"
    for m, k, w in (
        ("im", "im", "TRUE"), ("em", "em_margin", "TRUE"), ("lcpp", "chosen_len", "TRUE"),
        ("pplgap", _F03["original_ppl_gap"], "TRUE"), ("map", "abs(em_margin) - abs(im)", "TRUE"),
        ("im_em", _JOINT, "TRUE"), ("rip", "rejected_len", "em_margin > 0.126e0"),
    )) + f" UNION ALL (SELECT 'rad_ang' AS method, prompt, chosen, rejected FROM ({_two_stage_sql(20, 1000)}))", "v_margins")
def k12(spark, sf):
    paths = build_subsets(_features(spark, sf), "all", scratch_path(spark, "k12"), 1000, tau=TAU)
    parts = [readers.read_pairs(spark, p).select(F.lit(m).alias("method"), *PAIR_KEY) for m, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


_TOKENS = "len(list_filter(string_split_regex({}, '\\s+'), lambda t: t <> ''))"


@query("k13_prepare_features", f"""
SELECT pair_id, rad, em_margin, chosen_len, rejected_len, chosen_len - rejected_len AS len_gap,
  {q6('-c / chosen_len + r / rejected_len')} AS ang
FROM (SELECT pair_id, -1e0 * length(chosen) AS c, -0.5e0 * length(rejected) AS r, {_TOKENS.format('chosen')} AS chosen_len,
  {_TOKENS.format('rejected')} AS rejected_len, (pair_id % 81 - 40) * 1e0 AS rad, (pair_id % 31) * 1e0 AS em_margin FROM v_pairs)
WHERE chosen_len > 0 AND rejected_len > 0""", "v_pairs")
def k13(spark, sf):
    scores = run_sql(spark, sf, """
SELECT *, -1e0 * length(chosen) AS ref_chosen_logprob, -0.5e0 * length(rejected) AS ref_rejected_logprob,
  (pair_id % 81 - 40) * 1e0 AS m, (pair_id % 31) * 1e0 AS em FROM {v_pairs}""")
    im = scores.drop("m", "em").withColumn("margin", F.lit(0.0))
    # A triple that occurs twice would match twice: one score row per triple.
    rad = scores.groupBy(*PAIR_KEY).agg(F.min("m").alias("margin"))
    em = scores.groupBy(*PAIR_KEY).agg(F.min("em").alias("em"))
    out = prepare_features(im, rad, em)
    return out.select("pair_id", "rad", "em_margin", "chosen_len", "rejected_len", "len_gap", r6("ang").alias("ang"))


_GROUPS = "SELECT prompt_id FROM v_responses GROUP BY 1 HAVING count(*) = 4 AND avg(score) > 1e-6 AND avg(score) < 1 - 1e-6"


@query("k14_dynamic_filter", f"SELECT prompt_id, sample_idx, reward, score FROM v_responses WHERE prompt_id IN ({_GROUPS})", "v_responses")
def k14(spark, sf):
    return K.dynamic_filter(view(spark, sf, "v_responses"), 4).select("prompt_id", "sample_idx", "reward", "score")


# rounds of 40 groups, batches of 64: the state goes from round to round
@query("k15_dynamic_batch_emit", f"""
WITH RECURSIVE g AS (SELECT prompt_id, min(position) AS f, avg(score) AS m, count(*) AS n FROM v_responses GROUP BY 1),
s AS (SELECT *, (row_number() OVER (ORDER BY f) - 1) // 40 AS r, n = 4 AND m > 1e-6 AND m < 1 - 1e-6 AS kept FROM g),
t AS (SELECT r, count_if(kept) AS kept, sum(n) AS seen FROM s GROUP BY 1),
w AS (
  SELECT -1::BIGINT AS r, 0::BIGINT AS batch, 0::BIGINT AS held, 0::HUGEINT AS seen, FALSE AS done
  UNION ALL
  SELECT t.r, w.batch + w.done::INT, CASE WHEN w.done THEN 0 ELSE w.held END + t.kept, CASE WHEN w.done THEN 0 ELSE w.seen END + t.seen,
    CASE WHEN w.done THEN 0 ELSE w.held END + t.kept >= 64
  FROM w JOIN t ON t.r = w.r + 1),
x AS (SELECT batch, 400e0 * held / seen AS pass_rate FROM w WHERE done),
k AS (SELECT w.batch, s.prompt_id, s.m, row_number() OVER (PARTITION BY w.batch ORDER BY s.f) AS nth FROM s JOIN w ON w.r = s.r WHERE s.kept)
SELECT k.batch, prompt_id, m AS mean_score, {q6('pass_rate')} AS pass_rate FROM k JOIN x ON x.batch = k.batch WHERE nth <= 64""", "v_responses")
def k15(spark, sf):
    out = K.dynamic_batches(view(spark, sf, "v_responses"), 4, 64, round_groups=40)
    return out.select("batch", "prompt_id", "mean_score", r6("pass_rate").alias("pass_rate"))


@query("k16_keep_latest", "SELECT position, output FROM v_responses ORDER BY position DESC LIMIT 3000", "v_responses")
def k16(spark, sf):
    return K.keep_latest(view(spark, sf, "v_responses"), 3000).select("position", "output")


@query("k17_sample_n", """SELECT o_orderkey, o_custkey FROM orders
ORDER BY ('0x' || substr(md5('42:' || o_orderkey), 1, 15))::BIGINT, o_orderkey LIMIT 2000""")
def k17(spark, sf):
    return K.sample_n(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 2000, 42, "o_orderkey")


@query("u03_union_kept_and_flipped", """
SELECT pair_id, chosen, rejected, 0 AS flipped FROM v_margins WHERE rad > 20
UNION ALL SELECT pair_id, rejected, chosen, 1 FROM v_margins WHERE rad < -20""", "v_margins")
def u03(spark, sf):
    rows = view(spark, sf, "v_margins")
    out = K.union_kept_and_flipped(rows.where("rad > 20"), K.flip_columns(rows.where("rad < -20")))
    return out.select("pair_id", "chosen", "rejected", "flipped")


@query("h06_method_registry", f"""(SELECT 'im' AS method, pair_id FROM v_margins ORDER BY im DESC, pair_id LIMIT 500)
UNION ALL (SELECT 'rip', pair_id FROM v_margins WHERE em_margin > 0.126e0 ORDER BY rejected_len DESC, pair_id LIMIT 500)""", "v_margins")
def h06(spark, sf):
    rows = view(spark, sf, "v_margins")
    parts = [
        select_subset(rows, m, 500, TAU).select(F.lit(m).alias("method"), "pair_id") for m in K.parse_methods("IM, rip")
    ]
    return parts[0].unionByName(parts[1])
