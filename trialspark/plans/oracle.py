"""Independent DuckDB statements for the catalog's queries.

Nothing here is shared with the Spark code: the adapters are written again as CTEs.
"""

from __future__ import annotations

CTES = {
    "tr_raw": r"""
SELECT *, CASE WHEN to_subject = correct THEN '[subj]' ELSE '[obj]' END AS response,
  CASE WHEN to_subject THEN '[subj]' ELSE '[obj]' END AS raw_target,
  CASE WHEN passive THEN 'The [obj] has ' || adverb || ' been blorked by the [subj].'
       ELSE 'The [subj] has ' || adverb || ' blorked the [obj].' END AS sentence
FROM (
  SELECT l_suppkey AS subject, l_partkey AS part, CAST(l_partkey AS VARCHAR) AS item,
    l_linenumber, l_quantity, l_discount,
    l_returnflag = 'N' AS is_filler, l_linestatus = 'O' AS passive,
    l_suppkey % 4 = 0 AS human,
    CASE WHEN l_returnflag = 'N' THEN 'filler' ELSE 'experimental' END AS condition,
    'SVO+OSV' AS training,
    CASE WHEN l_returnflag = 'N'
      THEN ['customer','person','guest','child','patient','king','pizza','orange','steak',
            'bread','sandwich','dessert'][l_partkey % 12 + 1]
      WHEN l_partkey = 0 THEN 'pearl' WHEN l_partkey = 1 THEN 'lobster'
      ELSE 'w' || l_partkey END AS word,
    CASE WHEN l_returnflag = 'N' THEN l_partkey % 2 = 0 ELSE l_returnflag = 'A' END AS to_subject,
    CASE WHEN l_returnflag = 'N'
      THEN ['break','buy','eat','read','regret'][l_partkey % 5 + 1]
      ELSE 'buildings_vehicles' END AS args_group,
    CASE WHEN l_linestatus = 'O' THEN 'perfect passive' ELSE 'perfect transitive' END
      AS sentence_type,
    ['always','often','usually','typically'][l_partkey % 4 + 1] AS adverb,
    ['human','BERT','ModernBERT Base','ModernBERT Large'][l_suppkey % 4 + 1] AS data_source,
    CASE WHEN l_suppkey % 4 = 0 THEN ln(l_extendedprice) END AS log_rt,
    l_quantity <= 25 + 5 * (l_suppkey % 5) AS correct,
    CASE WHEN l_suppkey % 4 <> 0 THEN l_discount < 0.05 END AS correct_pre_training,
    CASE WHEN l_linestatus = 'O' THEN 'OVS passive' ELSE 'SVO active' END AS voice,
    CASE WHEN l_suppkey % 8 = 7 THEN 'Mask blork' ELSE 'Don''t mask blork' END
      AS mask_added_tokens,
    CASE WHEN l_suppkey % 8 = 5 THEN '260 epochs' ELSE 'convergence' END AS stop_at,
    CASE WHEN l_suppkey % 4 <> 0 THEN 'model-' || (l_suppkey % 10) END AS model_id
  FROM lineitem)""",
    "tr": r"""
SELECT * EXCLUDE (raw_target),
  CASE WHEN to_subject THEN 'Subject target' ELSE 'Object target' END AS target_response,
  CASE WHEN NOT is_filler THEN 'Seen' END AS seen_in_training
FROM tr_raw""",
    "ev": r"""
SELECT user_id AS subject, event_id, event_type, value AS amount, props,
  epoch_us(ts) // 1000 AS event_time, day(ts) AS trial_day FROM events""",
    "tlog": r"""
SELECT subject, event_id, trial_day, amount,
  CASE WHEN trial_day > 30 THEN 'trial_train_rep4' ELSE
    ['trial_train_rep00','trial_train_rep01','trial_train_rep1','trial_train_rep2',
     'trial_train_rep3'][CAST(floor((trial_day - 1) / 6) AS INT) + 1] END AS condition,
  (subject + trial_day) % 3 = 0 AS flipped
FROM ev WHERE event_type IN ('click', 'view')""",
    "tries": r"""
SELECT subject, condition, run, flipped, count(*) AS n_tries FROM (
  SELECT *, sum(CASE WHEN trial_day IS DISTINCT FROM before THEN 1 ELSE 0 END)
    OVER (PARTITION BY subject ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(trial_day) OVER (PARTITION BY subject ORDER BY event_id) AS before
        FROM tlog)) GROUP BY ALL""",
    "sess_all": r"""
SELECT subject, session_no, n_tries, count(*) AS c FROM (
  SELECT *, CASE WHEN run <= 21 THEN 1 ELSE ceil((run - 21) / 15.0) + 1 END AS session_no
  FROM tries) GROUP BY ALL""",
    "sess": r"""
SELECT subject, CAST(session_no AS BIGINT) AS session_no, n_tries,
  c / sum(c) OVER (PARTITION BY subject, session_no) AS pr,
  min(n_tries) OVER (PARTITION BY subject) AS fewest
FROM sess_all""",
    "below_tr": r"""
SELECT subject, session_no, pr FROM sess WHERE n_tries = fewest
QUALIFY session_no = max(session_no) OVER (PARTITION BY subject) AND pr < 0.9""",
    "brk": r"""
SELECT subject, CAST(ceil(n / 2.0) AS BIGINT) AS break_number,
  max(CASE WHEN n % 2 = 0 THEN t END) - max(CASE WHEN n % 2 = 1 THEN t END) AS duration
FROM (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY event_id) AS n,
        CAST(floor(event_time / 600.0) AS BIGINT) AS t
      FROM ev WHERE event_type = 'signup')
GROUP BY ALL""",
    "brk_label": r"""
SELECT subject, break_number, duration,
  m || ':' || s || '.' || CASE WHEN length(ms) < 3 THEN lpad(ms, 3, '0') ELSE ms END
    AS break_time
FROM (SELECT *,
        CASE WHEN length(m0) < 2 THEN lpad(m0, 2, '0') ELSE m0 END AS m,
        CASE WHEN length(s0) < 2 THEN lpad(s0, 2, '0') ELSE s0 END AS s
  FROM (SELECT *, CAST(CAST(trunc(minutes) AS BIGINT) AS VARCHAR) AS m0,
          CAST(CAST(trunc(seconds) AS BIGINT) AS VARCHAR) AS s0,
          CAST(CAST(round((seconds % 1) * 1000) AS BIGINT) AS VARCHAR) AS ms
    FROM (SELECT *, (minutes % 1) * 60 AS seconds
      FROM (SELECT *, CAST(duration AS DOUBLE) / 60000 AS minutes FROM brk))))""",
    "trlog": r"""
SELECT subject, trial_day, event_id, event_time,
  CASE event_type WHEN 'click' THEN 'response' WHEN 'signup' THEN '_Trial_Start'
    WHEN 'error' THEN '_Trial_End' ELSE 'mouse' END AS element_name,
  CASE event_type WHEN 'signup' THEN CAST(event_time AS VARCHAR)
    WHEN 'error' THEN CAST(event_time AS VARCHAR)
    WHEN 'click' THEN CASE WHEN amount >= 20 THEN '[subj]' ELSE '[obj]' END
    ELSE props END AS value
FROM ev WHERE event_type <> 'purchase'""",
    "wide": r"""
SELECT subject, 'trial' AS condition, CAST(trial_day AS VARCHAR) AS item,
  'The [subj] has ' || ['always','often','usually','typically'][trial_day % 4 + 1]
    || ' blorked the [obj].' AS sentence,
  CASE WHEN subject % 2 = 0 THEN '[subj]' ELSE '[obj]' END AS target_response,
  CASE WHEN trial_day % 3 = 0 THEN 'eat' ELSE 'buildings_vehicles' END AS args_group,
  CASE WHEN trial_day % 5 = 0 THEN 'perfect passive' ELSE 'perfect transitive' END
    AS sentence_type,
  arg_min(value, event_id) FILTER (element_name = '_Trial_Start') AS trial_start,
  arg_min(value, event_id) FILTER (element_name = '_Trial_End') AS trial_end,
  arg_min(value, event_id) FILTER (element_name = 'response') AS response,
  arg_min(value, event_id) FILTER (element_name = 'mouse') AS mouse
FROM trlog GROUP BY subject, trial_day""",
    "tmpl": r"""
SELECT doc_id, lang, 'The ' || CASE WHEN doc_id % 2 = 0 THEN '[subj]' ELSE '[obj]' END || ' '
  || text || ' '
  || ['always','often','usually','typically','rarely','typically and always'][doc_id % 6 + 1]
  || ' blorked the ' || CASE WHEN doc_id % 2 = 0 THEN '[obj]' ELSE '[subj]' END || '.'
  AS sentence
FROM documents""",
    "sc": r"""
SELECT subject + 10000001000 AS random_seed, lower(data_source) AS model_name, data_source,
  subject - min(subject) OVER () AS offset_id, model_id, mask_added_tokens, stop_at,
  CASE WHEN is_filler THEN 'syn_verb' || item || '_ext_for_human_exp'
       ELSE 'syn_blorked_SVO-OSV_for_human_exp' END AS eval_data,
  is_filler, item, condition, word, adverb, sentence, sentence_type, voice, training,
  CASE WHEN is_filler THEN 'verb' || item ELSE args_group END AS args_group,
  CASE WHEN is_filler THEN CASE WHEN l_linenumber = 1 THEN 'eval added' ELSE 'eval special' END
       WHEN part % 3 = 2 THEN 'eval added' ELSE 'tuning' END AS token_type,
  raw_target AS target_response, correct, correct_pre_training,
  25.5 + 5 * (subject % 5) - l_quantity AS odds,
  CASE WHEN correct THEN raw_target WHEN raw_target = '[subj]' THEN '[obj]' ELSE '[subj]' END
    AS response,
  dense_rank() OVER (ORDER BY subject) + 10000000000 AS subject
FROM tr_raw WHERE NOT human""",
    "scr": r"""
SELECT * EXCLUDE (word),
  CASE WHEN data_source LIKE 'Modern%' AND token_type <> 'tuning' AND word = 'pearl' THEN 'chalk'
       WHEN data_source LIKE 'Modern%' AND token_type <> 'tuning' AND word = 'lobster'
         THEN 'crab' ELSE word END AS word,
  CASE token_type WHEN 'tuning' THEN 'True' WHEN 'eval added' THEN 'False' END AS seen
FROM sc WHERE NOT is_filler OR token_type = 'eval special'""",
    "pitems": r"""
SELECT DISTINCT part AS item, condition, word, sentence_type, adverb,
  CASE WHEN is_filler THEN 'verb' || item ELSE args_group END AS args_group
FROM tr_raw WHERE human""",
    "exp_ids": r"""
SELECT s.*, i.item AS exp_item FROM scr s LEFT JOIN
  (SELECT * FROM pitems WHERE condition = 'experimental') i
  USING (condition, word, sentence_type, adverb)""",
    "all_ids": r"""
SELECT s.*, coalesce(s.exp_item, f.item) AS found FROM exp_ids s LEFT JOIN
  (SELECT DISTINCT item, condition, args_group, sentence_type FROM pitems
   WHERE condition = 'filler') f
  ON s.condition = f.condition AND s.args_group = f.args_group
     AND s.sentence_type = f.sentence_type""",
    "norm": r"""
SELECT subject, condition, training, CAST(found AS VARCHAR) AS item, word, target_response,
  args_group, sentence_type, sentence, adverb, seen AS seen_in_training, data_source,
  CAST(NULL AS VARCHAR) AS mouse, response, CAST(NULL AS DOUBLE) AS log_rt, correct,
  correct_pre_training, voice, mask_added_tokens, stop_at, model_id
FROM all_ids WHERE found IS NOT NULL""",
    "merged": r"""
SELECT * FROM norm UNION ALL BY NAME
SELECT subject, condition, training, item, word, raw_target AS target_response,
  CASE WHEN is_filler THEN 'verb' || item ELSE args_group END AS args_group, sentence_type,
  sentence, adverb, CASE WHEN NOT is_filler THEN 'True' END AS seen_in_training, data_source,
  CAST(NULL AS VARCHAR) AS mouse, response, log_rt, correct, correct_pre_training, voice,
  mask_added_tokens, stop_at, CAST(NULL AS VARCHAR) AS model_id
FROM tr_raw WHERE human""",
    "exp": "SELECT * FROM tr WHERE NOT is_filler",
    "fil": "SELECT * FROM tr WHERE is_filler",
    "facc": r"""
SELECT subject, data_source, mask_added_tokens, stop_at, avg(CAST(correct AS INT)) AS mean
FROM fil GROUP BY ALL""",
    "struct": r"""
SELECT subject, data_source, mask_added_tokens, stop_at, training,
  count(*) FILTER (correct) AS correct_total, count(*) FILTER (NOT correct) AS incorrect_total
FROM exp WHERE sentence_type = 'perfect transitive' AND seen_in_training = 'Seen' GROUP BY ALL""",
    "chance": r"""
SELECT *, (correct_total - incorrect_total)^2
  / CAST(nullif(correct_total + incorrect_total, 0) AS DOUBLE) AS statistic
FROM struct
WHERE (correct_total - incorrect_total)^2
  / CAST(nullif(correct_total + incorrect_total, 0) AS DOUBLE) < 1.642374415149818
  OR correct_total < incorrect_total""",
    "lin": r"""
SELECT subject, data_source, mask_added_tokens, stop_at, training,
  count(*) FILTER (to_subject AND NOT passive) AS n_active_subj,
  count(*) FILTER (to_subject AND passive) AS n_passive_subj,
  count(*) FILTER (to_subject AND NOT passive AND NOT correct) AS inv_correct_subj,
  count(*) FILTER (to_subject AND passive AND correct) AS pass_correct_subj,
  count(*) FILTER (NOT to_subject AND NOT passive) AS n_active_obj,
  count(*) FILTER (NOT to_subject AND passive) AS n_passive_obj,
  count(*) FILTER (NOT to_subject AND NOT passive AND NOT correct) AS inv_correct_obj,
  count(*) FILTER (NOT to_subject AND passive AND correct) AS pass_correct_obj
FROM exp GROUP BY ALL""",
    "lin_stat": r"""
SELECT *,
  (n_active_subj + n_passive_subj) * greatest(0.0, abs(CAST(inv_correct_subj AS DOUBLE)
     * (n_passive_subj - pass_correct_subj)
     - (n_active_subj - inv_correct_subj) * CAST(pass_correct_subj AS DOUBLE))
     - (n_active_subj + n_passive_subj) / 2.0) ** 2
  / nullif(CAST(n_active_subj AS DOUBLE) * n_passive_subj
     * (inv_correct_subj + pass_correct_subj)
     * (n_active_subj + n_passive_subj - inv_correct_subj - pass_correct_subj), 0)
  AS statistic_subj,
  (n_active_obj + n_passive_obj) * greatest(0.0, abs(CAST(inv_correct_obj AS DOUBLE)
     * (n_passive_obj - pass_correct_obj)
     - (n_active_obj - inv_correct_obj) * CAST(pass_correct_obj AS DOUBLE))
     - (n_active_obj + n_passive_obj) / 2.0) ** 2
  / nullif(CAST(n_active_obj AS DOUBLE) * n_passive_obj
     * (inv_correct_obj + pass_correct_obj)
     * (n_active_obj + n_passive_obj - inv_correct_obj - pass_correct_obj), 0)
  AS statistic_obj
FROM lin""",
    "linear": r"""
SELECT * FROM lin_stat WHERE (statistic_subj IS NULL OR statistic_subj < 3.841458820694124)
  AND (statistic_obj IS NULL OR statistic_obj < 3.841458820694124)""",
    "tagged": r"""
SELECT *, CASE WHEN subject IN (SELECT subject FROM linear) THEN 'Linear' ELSE 'Non-linear' END
  AS linear FROM tr""",
    "runs": "SELECT DISTINCT subject, data_source, mask_added_tokens, stop_at FROM tr",
    "excl_all": r"""
SELECT subject, data_source, mask_added_tokens, stop_at, concat_ws('; ',
    CASE WHEN subject IN (SELECT subject FROM below_tr) THEN '<90% on training' END,
    CASE WHEN subject IN (SELECT subject FROM facc WHERE mean < 0.75)
      THEN '<75% on fillers' END,
    CASE WHEN subject IN (SELECT subject FROM chance)
      THEN 'n.d. from chance on training structure' END,
    CASE WHEN subject IN (SELECT subject FROM brk WHERE duration > 900000)
      THEN 'break time > 15 minutes' END,
    CASE WHEN subject IN (SELECT subject FROM linear) THEN 'n.d. from linear' END)
  AS why_excluded
FROM (SELECT subject FROM below_tr UNION SELECT subject FROM facc WHERE mean < 0.75
      UNION SELECT subject FROM chance UNION SELECT subject FROM brk WHERE duration > 900000
      UNION SELECT subject FROM linear) LEFT JOIN runs USING (subject)""",
    "out_trials": r"""
SELECT subject FROM facc WHERE mean < 0.75 UNION SELECT subject FROM chance""",
    "cs": r"""
SELECT 'model-' || label AS model_id,
  ['BLORKED', 'other', 'BLORKED most similar'][vec_id % 3 + 1] AS target_group,
  CASE WHEN vec_id % 2 = 0 THEN '0' ELSE 'convergence' END AS eval_epoch,
  round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
    (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS cossim
FROM embeddings""",
    "csm": r"""
SELECT model_id, eval_epoch, max(cossim) AS max_cossim_to_targets,
  avg(cossim) AS mean_cossim_to_targets
FROM cs WHERE target_group = 'BLORKED' GROUP BY ALL""",
    "csw": r"""
SELECT model_id,
  round(max(max_cossim_to_targets) FILTER (eval_epoch = '0'), 6)
    AS max_cossim_to_targets_pre_training,
  round(max(mean_cossim_to_targets) FILTER (eval_epoch = '0'), 6)
    AS mean_cossim_to_targets_pre_training,
  round(max(max_cossim_to_targets) FILTER (eval_epoch <> '0'), 6) AS max_cossim_to_targets,
  round(max(mean_cossim_to_targets) FILTER (eval_epoch <> '0'), 6) AS mean_cossim_to_targets
FROM csm GROUP BY model_id""",
    "pre": r"""
SELECT *, CASE WHEN correct = correct_pre_training THEN response
  WHEN response = '[subj]' THEN '[obj]' ELSE '[subj]' END AS response_pre FROM exp""",
    "draw_long": r"""
SELECT vec_id, n AS position, CAST(embedding[n + 1] AS DOUBLE) AS x,
  CASE WHEN n < 9 THEN ['b_Intercept', 'b_voice.n', 'b_data_source.n', 'b_target_response.n',
      'b_voice.n:data_source.n', 'b_voice.n:target_response.n',
      'b_data_source.n:target_response.n', 'b_voice.n:data_source.n:target_response.n',
      'b_voice.n_i_n_tr_a_t_object_target_i_n_ds_a_t_human'][n + 1]
    WHEN n < 36 THEN 'sd_subject_' || (n - 9) ELSE 'cor_subject_' || (n - 36) END AS name
FROM embeddings, (SELECT unnest(range(64)) AS n)""",
    "pm": r"""
SELECT *, CASE WHEN share > 0.5 THEN 1 - share ELSE share END AS p FROM (
  SELECT CAST(position AS INT) AS position, name,
    count(*) FILTER (x > 0) / CAST(count(*) AS DOUBLE) AS share
  FROM draw_long WHERE name LIKE 'b\_%' ESCAPE '\' GROUP BY ALL)""",
    "pairs": "SELECT DISTINCT l_suppkey AS subject, l_partkey AS item FROM lineitem",
}

F_SCORES = """
SELECT subject, voice, target_response, round(precision_subjects, 6) AS precision_subjects,
  round(precision_objects, 6) AS precision_objects, round(recall_subjects, 6) AS recall_subjects,
  round(recall_objects, 6) AS recall_objects,
  round(CASE WHEN target_response = 'Subject target'
    THEN 2 * precision_subjects * recall_subjects
      / nullif(precision_subjects + recall_subjects, 0)
    ELSE 2 * precision_objects * recall_objects
      / nullif(precision_objects + recall_objects, 0) END, 6) AS {name}
FROM (SELECT subject, voice, tps / nullif(tps + fps, 0) AS precision_subjects,
        tpo / nullif(tpo + fpo, 0) AS precision_objects,
        tps / nullif(tps + fns, 0) AS recall_subjects,
        tpo / nullif(tpo + fno, 0) AS recall_objects FROM ({counts})),
  (SELECT unnest(['Subject target', 'Object target']) AS target_response)
"""

F_COUNTS = """
SELECT subject, voice,
  CAST(count(*) FILTER (to_subject AND correct) AS DOUBLE) AS tps,
  CAST(count(*) FILTER (NOT to_subject AND correct) AS DOUBLE) AS tpo,
  count(*) FILTER (NOT to_subject AND response = '[subj]') AS fps,
  count(*) FILTER (to_subject AND response = '[obj]') AS fpo,
  count(*) FILTER (NOT correct AND NOT (NOT to_subject AND response = '[subj]')) AS fns,
  count(*) FILTER (NOT correct AND NOT (to_subject AND response = '[obj]')) AS fno
FROM {rows} GROUP BY ALL
"""

F_COUNTS_PRE = """
SELECT subject, voice,
  CASE WHEN count(*) FILTER (to_subject AND correct_pre_training IS NULL) = 0 THEN
    CAST(count(*) FILTER (to_subject AND correct_pre_training) AS DOUBLE) END AS tps,
  CASE WHEN count(*) FILTER (NOT to_subject AND correct_pre_training IS NULL) = 0 THEN
    CAST(count(*) FILTER (NOT to_subject AND correct_pre_training) AS DOUBLE) END AS tpo,
  count(*) FILTER (NOT to_subject AND response_pre = '[subj]') AS fps,
  count(*) FILTER (to_subject AND response_pre = '[obj]') AS fpo,
  count(*) FILTER (NOT correct_pre_training
    AND NOT (NOT to_subject AND response_pre = '[subj]')) AS fns,
  count(*) FILTER (NOT correct AND NOT (to_subject AND response_pre = '[obj]')) AS fno
FROM {rows} GROUP BY ALL
"""

F_AFTER = F_SCORES.format(name="f_score", counts=F_COUNTS.format(rows="exp"))
F_BEFORE = F_SCORES.format(
    name="f_score", counts=F_COUNTS_PRE.format(rows="pre")
)
F_BEFORE_NAMED = F_SCORES.format(
    name="f_score_pre_training", counts=F_COUNTS_PRE.format(rows="pre")
)

BARS = """
SELECT data_source, voice, target_response,
  CASE WHEN count(c) = count(*) THEN count(*) FILTER (c) END AS k, count(*) AS n,
  round(CASE WHEN count(c) = count(*) THEN avg(CAST(c AS INT)) END, 6) AS mean
FROM (SELECT CASE WHEN human THEN 'People' ELSE data_source || ' (fine-tuned)' END
        AS data_source, voice, target_response, correct AS c FROM {rows}
      UNION ALL
      SELECT data_source || ' (pre-fine-tuning)', voice, target_response,
        correct_pre_training FROM {rows} WHERE NOT human)
GROUP BY ALL
"""

TRIAL_COLUMNS = (
    "subject, condition, training, item, word, target_response, args_group, sentence_type, "
    "sentence, adverb, seen_in_training, data_source, mouse, response, "
    "round(log_rt, 6) AS log_rt, correct, correct_pre_training, voice, mask_added_tokens, "
    "stop_at, model_id"
)

RUN = "subject, data_source, mask_added_tokens, stop_at"
TAGS = ("'human' AS data_source, 'Don''t mask blork' AS mask_added_tokens, "
        "'convergence' AS stop_at")

EFFECTS = [
    "Intercept", "Voice", "Data Source", "Target Response", "Voice × Data Source",
    "Voice × Target Response", "Data Source × Target Response",
    "Voice × Data Source × Target Response",
    "Voice (in) Target response @ Object Target (in) Data source @ Human",
]

NESTED = {
    "tr_a_t_object_target": "NOT to_subject",
    "tr_a_t_subject_target": "to_subject",
    **{
        f"ds_a_t_{s.lower().replace(' ', '_')}": f"data_source = '{s}'"
        for s in ("human", "BERT", "ModernBERT Base", "ModernBERT Large")
    },
    **{
        f"tr_a_t_{t}_target_i_n_ds_a_t_{s.lower().replace(' ', '_')}":
            f"{test} AND data_source = '{s}'"
        for t, test in (("object", "NOT to_subject"), ("subject", "to_subject"))
        for s in ("human", "BERT", "ModernBERT Base", "ModernBERT Large")
    },
}

V = "CASE WHEN passive THEN -0.5 ELSE 0.5 END"
D = "CASE WHEN human THEN 0.5 ELSE -0.5 END"
R = "CASE WHEN to_subject THEN -0.5 ELSE 0.5 END"

# The same steps as the column expressions: nested series, continued fraction, Newton on areas.
AREA = "list_sum(list_transform(pts, lambda pt: pt.w * exp(up * ln(sin(lo + ({t} - lo) * pt.x) / sin(mode))" \
    " + down * ln(cos(lo + ({t} - lo) * pt.x) / cos(mode))))) * ({t} - lo)"
DENSITY = "exp(up * ln(sin({t}) / sin(mode)) + down * ln(cos({t}) / cos(mode)))"


def _quantile(p: float) -> str:
    step = f"t - ({AREA.format(t='t')} - {p} * total) / {DENSITY.format(t='t')}"
    return f"""round(CASE WHEN k IS NOT NULL THEN pow(sin(list_reduce(list_prepend(mode, list_transform(range(16), lambda i: 0.0::DOUBLE)),
        lambda t, i: greatest(lo, least(hi, {step})))), 2) END, 6)"""


def _points() -> str:
    import numpy as np

    nodes, weights = np.polynomial.legendre.leggauss(8)
    return "[" + ", ".join(
        f"{{'x': ({panel} + 0.5 + 0.5 * {x!r}::DOUBLE) / 12, 'w': 0.5 * {w!r}::DOUBLE / 12}}"
        for panel in range(12) for x, w in zip(map(float, nodes), map(float, weights))
    ) + "]"


def _upper_tail(statistic: str) -> str:
    x = f"sqrt({statistic} / 2)"
    fold = "list_reduce(list_prepend(1.0::DOUBLE, range(60, 0, -1)::DOUBLE[]), lambda f, n: {step})"
    series = fold.format(step=f"1 + 2 * pow({x}, 2) / (2 * n + 1) * f")
    fraction = fold.format(step=f"1 + n / (2 * pow({x}, 2)) / f")
    tail = f"exp(-pow({x}, 2)) / sqrt(pi())"
    return f"""round(coalesce(CASE WHEN {x} < 3 THEN 1 - 2 * {tail} * {x} * {series}
        ELSE {tail} / {x} / {fraction} END, 'Infinity'::DOUBLE), 6)"""


DESIGN = [
    ("Intercept", "1.0"), ("voice_n", V), ("data_source_n", D), ("target_response_n", R),
    ("voice_n:data_source_n", f"({V}) * ({D})"), ("voice_n:target_response_n", f"({V}) * ({R})"),
    ("data_source_n:target_response_n", f"({D}) * ({R})"),
    ("voice_n:data_source_n:target_response_n", f"({V}) * ({D}) * ({R})"),
]

SELECTS = {
    "project_range": "SELECT subject, item, word, response AS answer, correct FROM tr",
    "tag_source": f"""SELECT event_id, user_id, CAST(NULL AS BOOLEAN) AS correct_pre_training,
        {TAGS} FROM events""",
    "filter_null_safe": """SELECT subject, item, word, model_id, voice FROM tr
        WHERE (model_id IS NULL OR model_id NOT IN ('model-1', 'model-3'))
        AND (seen_in_training IS NULL OR passive) AND word <> 'pizza'""",
    "filter_regex": r"""SELECT doc_id, lang FROM tmpl
        WHERE regexp_matches(sentence, '\[obj\].*\[subj\]', 's')
        AND contains(sentence, 'typically') AND sentence LIKE 'The%'
        AND lang NOT LIKE '%en' AND lang NOT LIKE '%es'""",
    "case_labels": """SELECT subject, item,
        CASE WHEN contains(args_group, '_') THEN 'experimental' ELSE 'filler' END AS condition,
        coalesce(response = target_response, false) AS correct,
        CASE WHEN contains(sentence_type, 'passive') THEN 'OVS passive' ELSE 'SVO active' END
          AS voice, 'buildings+vehicles args' AS args_label FROM wide""",
    "recode_map": """SELECT word, recoded, count(*) AS n FROM (
        SELECT word, CASE word WHEN 'customer' THEN 'girl' WHEN 'person' THEN 'man'
          WHEN 'guest' THEN 'boy' WHEN 'child' THEN 'woman' WHEN 'patient' THEN 'person'
          WHEN 'king' THEN 'customer' WHEN 'pizza' THEN 'water' WHEN 'orange' THEN 'milk'
          WHEN 'steak' THEN 'wine' WHEN 'bread' THEN 'beer' WHEN 'sandwich' THEN 'coffee'
          WHEN 'dessert' THEN 'tea' END AS recoded FROM tr) GROUP BY ALL""",
    "level_order": """SELECT *,
        CASE target_response WHEN 'Subject target' THEN 1 ELSE 2 END AS target_response_rank,
        CASE args_group WHEN 'buildings+vehicles args' THEN 1 WHEN 'break args' THEN 2
          WHEN 'buy args' THEN 3 WHEN 'drink args' THEN 4 WHEN 'eat args' THEN 5
          WHEN 'read args' THEN 6 ELSE 7 END AS args_group_rank,
        CASE sentence_type WHEN 'perfect transitive' THEN 1 ELSE 6 END AS sentence_type_rank,
        CASE voice WHEN 'SVO active' THEN 1 ELSE 2 END AS voice_rank,
        CASE data_source WHEN 'human' THEN 1 WHEN 'BERT' THEN 2 WHEN 'ModernBERT Base' THEN 3
          ELSE 4 END AS data_source_rank,
        CASE mask_added_tokens WHEN 'Mask blork' THEN 2 ELSE 1 END AS mask_added_tokens_rank,
        CASE stop_at WHEN 'convergence' THEN 1 ELSE 2 END AS stop_at_rank
        FROM (SELECT target_response, replace(args_group, '_', '+') || ' args' AS args_group,
          sentence_type, voice, data_source, mask_added_tokens, stop_at, count(*) AS n
          FROM tr GROUP BY ALL)""",
    "subject_view": """SELECT subject, item, correct FROM tr
        WHERE subject IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""",
    "keep_sources": """SELECT subject, data_source, item, correct FROM tr
        WHERE data_source IN ('human', 'BERT')""",
    "reading_delay": """SELECT doc_id,
        (length(text) - length(replace(text, ' ', '')) + 1) * 325 AS delay_ms FROM documents""",
    "sentence_case": r"""SELECT doc_id, array_to_string(list_transform(
        regexp_extract_all(text, '[0-9]+|[^0-9]+'), lambda s:
          CASE WHEN length(s) > 1 AND NOT regexp_matches(s, '^[0-9]')
            THEN upper(s[1]) || lower(s[2:]) ELSE s END), '') AS sentence FROM documents""",
    "decode_feedback": """SELECT doc_id AS subject, text AS feedback FROM documents
        WHERE lang <> 'de'""",
    "find_adverb": """SELECT doc_id, CASE WHEN contains(sentence, 'always') THEN 'always'
        WHEN contains(sentence, 'often') THEN 'often'
        WHEN contains(sentence, 'usually') THEN 'usually'
        WHEN contains(sentence, 'typically') THEN 'typically' END AS adverb FROM tmpl""",
    "split_template": r"""SELECT doc_id, 'The ' AS before,
        CASE WHEN doc_id % 2 = 0 THEN '[subj]' ELSE '[obj]' END AS first_blank,
        substr(sentence, strpos(sentence, 'bj]') + 3,
          length(sentence) - strpos(sentence, 'bj]') - 2 - length(tail) - 1) AS middle,
        tail AS second_blank, '.' AS after
        FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '[obj]' ELSE '[subj]' END AS tail
          FROM tmpl)""",
    "model_label": """SELECT model_name, data_source, count(*) AS n FROM sc GROUP BY ALL""",
    "clean_token": """SELECT CASE WHEN data_source LIKE 'Modern%' AND word = 'pearl' THEN 'chalk'
        WHEN data_source LIKE 'Modern%' AND word = 'lobster' THEN 'crab' ELSE word END AS word,
        count(*) AS n FROM sc GROUP BY 1""",
    "alt_response": """SELECT random_seed, CASE target_response WHEN '[subj]'
        THEN '[subj]/[obj]' ELSE '[obj]/[subj]' END AS ratio_name,
        CASE target_response WHEN '[subj]' THEN '[obj]' ELSE '[subj]' END AS response FROM sc""",
    "eval_group": """SELECT eval_data, CASE WHEN is_filler THEN args_group ELSE eval_data END
        AS args_group, count(*) AS n FROM sc GROUP BY ALL""",
    "run_ids": """SELECT conv_id, turn, role, CAST(sum(CASE WHEN role IS DISTINCT FROM before
        THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
        AS BIGINT) AS run FROM (SELECT conv_id, turn, role,
          lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)""",
    "first_seen_id": """SELECT event_id, subject FROM events JOIN (
        SELECT user_id, row_number() OVER (ORDER BY min(event_id)) AS subject
        FROM events GROUP BY user_id) USING (user_id)""",
    "interleave_every_n": """WITH t AS (SELECT conv_id, turn,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS i
          FROM conversations)
        SELECT conv_id, turn, i + (i // 2) * 2 AS position, CAST(NULL AS VARCHAR) AS row_kind
        FROM t
        UNION ALL SELECT conv_id, NULL, i + (i // 2) * 2 + 1, 'break' FROM t
          WHERE i % 2 = 1 AND rn > 1
        UNION ALL SELECT conv_id, NULL, i + (i // 2) * 2 + 2, 'pause' FROM t
          WHERE i % 2 = 1 AND rn > 1""",
    "sorted_scores": """SELECT random_seed, word, adverb, correct FROM scr
        ORDER BY random_seed, word, adverb""",
    "break_times": "SELECT subject, break_number, break_time, duration FROM brk_label",
    "excessive_breaks": """SELECT subject, break_number, break_time, duration FROM brk_label
        WHERE duration > 900000""",
    "count_tries": f"SELECT subject, {TAGS}, condition, CAST(run AS BIGINT) AS run, n_tries "
                   "FROM tries",
    "session_accuracy": f"""SELECT subject, {TAGS}, session_no,
        round(pr, 6) AS pr_first_choice_correct FROM sess WHERE n_tries = fewest""",
    "session_accuracy_reversed": f"""SELECT subject, {TAGS}, CAST(session_no AS BIGINT)
        AS session_no, n_tries, CAST(total AS BIGINT) AS total,
        round(c / total, 6) AS pr_first_choice_correct FROM (
          SELECT *, sum(c) OVER (PARTITION BY subject, session_no) AS total,
            min(n_tries) OVER (PARTITION BY subject) AS fewest FROM (
              SELECT subject, n_tries, count(*) AS c,
                CASE WHEN run <= 21 THEN 1 ELSE ceil((run - 21) / 15.0) + 1 END AS session_no
              FROM tries WHERE flipped GROUP BY ALL)) WHERE n_tries = fewest""",
    "below_training": f"""SELECT subject, {TAGS}, session_no,
        round(pr, 6) AS pr_first_choice_correct FROM below_tr""",
    "training_gate": """WITH firsts AS (
          SELECT subject, condition, trial_day, arg_min(amount >= 5, event_id) AS ok
          FROM tlog GROUP BY ALL),
        blocks AS (SELECT subject, CASE condition WHEN 'trial_train_rep01' THEN 1
            WHEN 'trial_train_rep1' THEN 2 WHEN 'trial_train_rep2' THEN 3
            WHEN 'trial_train_rep3' THEN 4 ELSE 5 END AS attempt,
            avg(CAST(ok AS INT)) AS accuracy
          FROM firsts WHERE condition <> 'trial_train_rep00' GROUP BY ALL),
        gates AS (SELECT subject, CAST(min(attempt) FILTER (accuracy >= 0.9) AS BIGINT)
            AS passed_at, CAST(max(attempt) AS BIGINT) AS last FROM blocks GROUP BY subject)
        SELECT g.subject, passed_at, coalesce(passed_at, last) AS attempts,
          round(accuracy, 6) AS final_accuracy, passed_at IS NOT NULL AS passed
        FROM gates g JOIN blocks b
          ON g.subject = b.subject AND b.attempt = coalesce(passed_at, last)""",
    "trials_wide": "SELECT * FROM wide",
    "read_event_log": """SELECT s.subject, event_type AS condition, trial_day AS "order",
        CASE WHEN event_type <> 'view' THEN 'Drop' END AS parameter, props AS value,
        CASE WHEN event_type <> 'error' THEN event_time END AS event_time,
        CASE WHEN event_type = 'click' THEN '' ELSE CAST(trial_day AS VARCHAR) END AS item,
        CASE WHEN event_type = 'signup' THEN '' ELSE 'x' END AS word, 'human' AS data_source
        FROM ev JOIN (SELECT subject AS person, row_number() OVER (ORDER BY min(event_id))
          AS subject FROM ev GROUP BY 1) s ON ev.subject = s.person""",
    "read_model_scores": """SELECT model_id, random_seed, token_type,
        round(odds, 6) AS odds_ratio, mask_added_tokens = 'Mask blork' AS mask_added_tokens,
        CASE WHEN NOT is_filler THEN args_group END AS args_group, lower(sentence) AS sentence
        FROM sc""",
    "accuracy_csv": f"""SELECT CAST(subject AS VARCHAR) AS subject, item, data_source,
        target_response, voice, correct, CAST({R} AS DOUBLE) AS target_response_n,
        CAST({D} AS DOUBLE) AS data_source_n, CAST({V} AS DOUBLE) AS voice_n FROM exp""",
    "repeated_elements": """SELECT subject, CAST(trial_day AS VARCHAR) AS item, element_name,
        count(*) AS n FROM trlog GROUP BY ALL HAVING count(*) > 1""",
    "log_rt": """SELECT subject, item, round(CASE WHEN net > 0 THEN ln(net) END, 6) AS log_rt
        FROM (SELECT subject, item, CAST(trial_end AS BIGINT) - CAST(trial_start AS BIGINT)
          - 325 * (length(sentence) - length(replace(sentence, ' ', '')) + 1) AS net
          FROM wide)""",
    "distinct_items": """SELECT DISTINCT item, condition, word, args_group, sentence_type, adverb
        FROM tr""",
    "synth_items": """WITH i AS (SELECT DISTINCT part AS item, condition, word, args_group,
          sentence_type, adverb FROM tr)
        SELECT * FROM i UNION ALL BY NAME
        SELECT (SELECT max(item) FROM i) - (SELECT min(item) FROM i WHERE args_group = 'eat')
          + item + 1 AS item, condition,
          CASE word WHEN 'customer' THEN 'girl' WHEN 'person' THEN 'man'
          WHEN 'guest' THEN 'boy' WHEN 'child' THEN 'woman' WHEN 'patient' THEN 'person'
          WHEN 'king' THEN 'customer' WHEN 'pizza' THEN 'water' WHEN 'orange' THEN 'milk'
          WHEN 'steak' THEN 'wine' WHEN 'bread' THEN 'beer' WHEN 'sandwich' THEN 'coffee'
          WHEN 'dessert' THEN 'tea' END AS word, 'drink' AS args_group, sentence_type, adverb
        FROM i WHERE args_group = 'eat'""",
    "attach_item_ids": """SELECT random_seed, condition, word, args_group, sentence_type, adverb,
        exp_item AS item FROM exp_ids""",
    "resolve_item": """SELECT random_seed, condition, word, args_group, sentence_type, adverb,
        found AS item FROM all_ids""",
    "normalise_scores": f"SELECT {TRIAL_COLUMNS} FROM norm",
    "union_sources": f"""SELECT {TRIAL_COLUMNS} FROM (SELECT * REPLACE (
        CASE seen_in_training WHEN 'True' THEN 'Seen' WHEN 'False' THEN 'Unseen' END
          AS seen_in_training,
        CASE target_response WHEN '[subj]' THEN 'Subject target' ELSE 'Object target' END
          AS target_response,
        replace(args_group, '_', '+') || ' args' AS args_group) FROM merged)""",
    "filler_accuracy": f"SELECT {RUN}, round(mean, 6) AS mean FROM facc",
    "below_fillers": f"SELECT {RUN}, round(mean, 6) AS mean FROM facc WHERE mean < 0.75",
    "training_structure_counts": "SELECT * FROM struct",
    "training_structure_test": """SELECT * REPLACE (round(statistic, 6) AS statistic)
        FROM chance""",
    "linear_counts": "SELECT * FROM lin",
    "linear_test": """SELECT * REPLACE (round(statistic_subj, 6) AS statistic_subj,
        round(statistic_obj, 6) AS statistic_obj) FROM linear""",
    "p_values": f"""SELECT * REPLACE (round(statistic_subj, 6) AS statistic_subj,
          round(statistic_obj, 6) AS statistic_obj),
        {_upper_tail("statistic_subj")} AS p_value_subj, {_upper_tail("statistic_obj")} AS p_value_obj
        FROM lin_stat""",
    "beta_interval": f"""SELECT data_source, voice, target_response, k, n, mean,
          {_quantile((1 - 0.95) / 2)} AS ymin, {_quantile(0.95 + (1 - 0.95) / 2)} AS ymax
        FROM (SELECT *, {AREA.format(t="hi")} AS total FROM (
          SELECT *, greatest(0, mode - 12 * width) AS lo, least(pi() / 2, mode + 12 * width) AS hi,
            {_points()} AS pts
          FROM (SELECT *, 2.0 * k + 1 AS up, 2.0 * (n - k) + 1 AS down,
              atan2(sqrt(2.0 * k + 1), sqrt(2.0 * (n - k) + 1)) AS mode, 0.5 / sqrt(n + 1.0) AS width
            FROM ({BARS.format(rows="exp")}))))""",
    "flag_linear": "SELECT subject, item, correct, linear FROM tagged",
    "exclusion_reasons": f"SELECT {RUN}, why_excluded FROM excl_all",
    "drop_excluded": """SELECT subject, item, correct, condition AS part FROM tr
        WHERE subject NOT IN (SELECT subject FROM out_trials)""",
    "complete_sessions": f"""WITH s AS (SELECT subject, session_no, pr FROM sess
          WHERE n_tries = fewest),
        out AS (SELECT subject FROM out_trials UNION SELECT subject FROM below_tr)
        SELECT subject, {TAGS}, session_no, round(pr, 6) AS pr_first_choice_correct, included,
          subject || ' (' || included || ')' AS title FROM (
          SELECT g.subject, l.session_no, s.pr,
            CASE WHEN g.subject IN (SELECT subject FROM out) THEN 'Excluded'
              ELSE 'Included' END AS included
          FROM (SELECT DISTINCT subject FROM s) g
          CROSS JOIN (SELECT DISTINCT session_no FROM s) l
          LEFT JOIN s ON s.subject = g.subject AND s.session_no = l.session_no)""",
    "cossim_means": """SELECT model_id, eval_epoch,
        round(max_cossim_to_targets, 6) AS max_cossim_to_targets,
        round(mean_cossim_to_targets, 6) AS mean_cossim_to_targets FROM csm""",
    "cossim_wide": "SELECT * FROM csw",
    "attach_cossim": """SELECT subject, item, tr.model_id,
        csw.* EXCLUDE (model_id) FROM tr LEFT JOIN csw ON tr.model_id = csw.model_id""",
    "fscore_long": F_AFTER,
    "fscore_pre": F_BEFORE,
    "attach_fscore": f"""SELECT e.subject, e.voice, e.target_response, item, f_score,
        f_score_pre_training FROM exp e
        LEFT JOIN ({F_AFTER}) USING (subject, voice, target_response)
        LEFT JOIN ({F_BEFORE_NAMED}) USING (subject, voice, target_response)""",
    "semi_seen_by_people": """SELECT subject, data_source, word, sentence FROM exp
        WHERE (word, sentence) IN (SELECT (word, sentence) FROM exp WHERE human)""",
    "accuracy_table": """WITH f AS (SELECT * FROM pre
          WHERE subject NOT IN (SELECT subject FROM out_trials))
        SELECT f.subject, f.item, f.target_response, f.sentence_type, f.data_source, f.response,
          round(f.log_rt, 6) AS log_rt, f.correct, f.voice, f.mask_added_tokens, f.stop_at,
          f.model_id, csw.max_cossim_to_targets_pre_training,
          csw.mean_cossim_to_targets_pre_training, csw.max_cossim_to_targets,
          csw.mean_cossim_to_targets, s.f_score_pre_training,
          CASE WHEN to_subject THEN -0.5 ELSE 0.5 END AS target_response_n,
          CASE WHEN human THEN 0.5 ELSE -0.5 END AS data_source_n,
          CASE WHEN passive THEN -0.5 ELSE 0.5 END AS voice_n, round(exp(f.log_rt), 6) AS rt
        FROM f LEFT JOIN csw ON f.model_id = csw.model_id
        LEFT JOIN (""" + F_BEFORE_NAMED + """) s ON s.subject = f.subject AND s.voice = f.voice
          AND s.target_response = f.target_response
        WHERE f.mask_added_tokens = 'Don''t mask blork' AND f.stop_at = 'convergence'
          AND (f.word, f.sentence) IN (SELECT (word, sentence) FROM f WHERE human)""",
    "facet_counts": """SELECT data_source, mask_added_tokens, stop_at, linear,
        printf('n=%02d', count(DISTINCT subject)) AS count FROM tagged WHERE NOT is_filler
        GROUP BY data_source, mask_added_tokens, stop_at, linear""",
    "pre_post_stack": """SELECT subject, CASE WHEN human THEN 'People'
          ELSE data_source || ' (fine-tuned)' END AS data_source, item, voice, correct FROM exp
        UNION ALL SELECT subject, data_source || ' (pre-fine-tuning)', item, voice,
          correct_pre_training FROM exp WHERE NOT human""",
    "beta_counts": """SELECT data_source, condition, voice, count(*) FILTER (correct) AS k,
        count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS mean FROM tr
        GROUP BY data_source, condition, voice""",
    "accuracy_bars": BARS.format(rows="exp"),
    "filler_bars": BARS.format(rows="fil"),
    "accuracy_bars_linear": """SELECT *, printf('%.2f', mean) AS label FROM (
        SELECT data_source, linear, voice, target_response, count(*) FILTER (correct) AS k,
          count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS mean
        FROM tagged WHERE NOT is_filler GROUP BY ALL)""",
    "rt_rank": """SELECT subject, item, round(log_rt, 6) AS log_rt, rank FROM tr LEFT JOIN (
        SELECT subject, row_number() OVER (ORDER BY m, subject) AS rank FROM (
          SELECT subject, quantile_cont(log_rt, 0.5) AS m FROM tr WHERE human
          GROUP BY subject)) USING (subject)""",
    "rt_box": """WITH p AS (SELECT subject, linear, log_rt FROM tagged WHERE human),
        q AS (SELECT subject, linear, quantile_cont(log_rt, 0.25) AS q1,
          quantile_cont(log_rt, 0.5) AS median, quantile_cont(log_rt, 0.75) AS q3
          FROM p GROUP BY ALL),
        r AS (SELECT subject, row_number() OVER (ORDER BY median, subject) AS rank FROM q)
        SELECT subject, linear, round(q1, 6) AS q1, round(median, 6) AS median,
          round(q3, 6) AS q3,
          round(min(log_rt) FILTER (log_rt >= q1 - 1.5 * (q3 - q1)), 6) AS low,
          round(max(log_rt) FILTER (log_rt <= q3 + 1.5 * (q3 - q1)), 6) AS high,
          count(*) FILTER (log_rt < q1 - 1.5 * (q3 - q1) OR log_rt > q3 + 1.5 * (q3 - q1))
            AS n_outliers, rank, subject IN (SELECT subject FROM out_trials) AS excluded
        FROM p JOIN q USING (subject, linear) JOIN r USING (subject) GROUP BY ALL""",
    "nested_contrasts": "SELECT subject, CAST(" + V + " AS DOUBLE) AS voice_n, " + ", ".join(
        f"CAST(sum(CASE WHEN {test} THEN {V} ELSE 0 END) AS DOUBLE) AS voice_n_i_n_{name}"
        for name, test in NESTED.items()
    ) + " FROM exp GROUP BY 1, 2",
    "interaction_terms": f"""SELECT subject,
        CAST(sum(({V}) * ({D})) AS DOUBLE) AS voice_n_x_data_source_n,
        CAST(sum(({V}) * ({R})) AS DOUBLE) AS voice_n_x_target_response_n,
        CAST(sum(({D}) * ({R})) AS DOUBLE) AS data_source_n_x_target_response_n,
        CAST(sum(({V}) * ({D}) * ({R})) AS DOUBLE)
          AS voice_n_x_data_source_n_x_target_response_n
        FROM exp GROUP BY subject""",
    "pmcmc": """SELECT position, name, round(share, 6) AS p_mcmc, round(p, 6) AS p,
        CASE WHEN share > 0.5 THEN ' < 0' ELSE ' > 0' END AS direction,
        CASE WHEN p < 0.0001 THEN '***' WHEN p < 0.001 THEN '**' WHEN p < 0.05 THEN '*'
          ELSE '' END AS stars FROM pm""",
    "pmcmc_report": """SELECT position + 4 AS line_no, printf('%.4f', p) || ': '
          || ['""" + "', '".join(EFFECTS) + """'][position + 1]
          || CASE WHEN share > 0.5 THEN ' < 0' ELSE ' > 0' END || ' '
          || CASE WHEN p < 0.0001 THEN '***' WHEN p < 0.001 THEN '**' WHEN p < 0.05 THEN '*'
          ELSE '' END AS line FROM pm
        UNION ALL SELECT 1, repeat('#', 81)
        UNION ALL SELECT 2, 'Crossed model (accuracy) posteriors'
        UNION ALL SELECT 3, repeat('-', 81)
        UNION ALL SELECT 13, repeat('#', 81)""",
    "posterior_summary": r"""SELECT name, round(avg(x), 6) AS mean,
        round(quantile_cont(x, 0.005), 6) AS low_99, round(quantile_cont(x, 0.025), 6) AS low_95,
        round(quantile_cont(x, 0.975), 6) AS high_95,
        round(quantile_cont(x, 0.995), 6) AS high_99,
        ['Voice', 'Data Source', 'Target Response', 'Voice × Data Source',
         'Voice × Target Response', 'Data Source × Target Response',
         'Voice × Data Source × Target Response',
         'Voice in T.R. @ Object Target in D.S. @ Human'][min(position)] AS label
        FROM draw_long WHERE name LIKE 'b\_%' ESCAPE '\' AND name <> 'b_Intercept'
        GROUP BY name""",
    "draw_histogram": """SELECT name, CAST(least(floor((x - lo) / ((hi - lo) / 30)) + 1, 30)
        AS BIGINT) AS bin, count(*) AS n, round(min(lo), 6) AS lo, round(min(hi), 6) AS hi
        FROM draw_long JOIN (SELECT name, min(x) AS lo, max(x) AS hi FROM draw_long
          GROUP BY name) USING (name) GROUP BY 1, 2""",
    "draw_density": r"""WITH sp AS (
          SELECT name, lo, (hi - lo) / 127 AS step, 1.06 * sd * pow(n, -0.2) AS width, n, q FROM (
            SELECT name, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd, count(x) AS n,
              quantile_cont(x, [0.005, 0.025, 0.975, 0.995]) AS q
            FROM draw_long WHERE name LIKE 'b\_%' ESCAPE '\' AND name <> 'b_Intercept' GROUP BY name)),
        cells AS (SELECT name, CAST(round((x - lo) / step) AS INT) AS cell, count(*) AS m
          FROM draw_long JOIN sp USING (name) GROUP BY ALL),
        grid AS (SELECT *, lo + point * step AS x FROM sp, (SELECT unnest(range(128))::INT AS point))
        SELECT name, point, round(x, 6) AS x,
          round(coalesce(sum(m * exp(-pow((point - cell) * step / width, 2) / 2)
            / (n * width * sqrt(2 * pi()))) FILTER (abs(point - cell) <= ceil(3 * width / step)), 0), 6) AS density,
          CASE WHEN x BETWEEN q[2] AND q[3] THEN 'inner' WHEN x BETWEEN q[1] AND q[4] THEN 'outer'
            ELSE 'tail' END AS part
        FROM grid JOIN cells USING (name) GROUP BY ALL""",
    "draw_trace": r"""WITH d AS (SELECT vec_id % 4 AS chain, vec_id // 4 AS position, name, x AS value
          FROM draw_long WHERE name LIKE 'b\_%' ESCAPE '\'),
        p AS (SELECT d.*, CASE WHEN b - a + 1 <= 50 THEN position - a
              ELSE ((position - a) * 50) // (b - a + 1) END AS pixel
          FROM d JOIN (SELECT chain, min(position) AS a, max(position) AS b FROM d GROUP BY chain) USING (chain))
        SELECT DISTINCT chain, name, pixel, position, round(value, 6) AS value FROM (
          SELECT *, row_number() OVER (PARTITION BY chain, name, pixel ORDER BY position) AS i1,
            row_number() OVER (PARTITION BY chain, name, pixel ORDER BY position DESC) AS i2,
            row_number() OVER (PARTITION BY chain, name, pixel ORDER BY value, position) AS i3,
            row_number() OVER (PARTITION BY chain, name, pixel ORDER BY value DESC, position DESC) AS i4
          FROM p) WHERE 1 IN (i1, i2, i3, i4)""",
    "design_gram": "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{a}' AS row_term, '{b}' AS column_term,
          CAST(sum(({x}) * ({y})) AS DOUBLE) AS total FROM exp WHERE correct IS NOT NULL"""
        for i, (a, x) in enumerate(DESIGN) for b, y in DESIGN[i:]
    ) + ")",
    "assign_words": """SELECT subject, item, p_name || ' ' || i AS word,
        CASE WHEN i < 6 THEN '[subj]' ELSE '[obj]' END AS target_response FROM (
          SELECT subject, item, CAST('0x' || substr(md5('0|' || subject || '|' || item), 1, 8)
            AS BIGINT) % 12 AS i FROM pairs) JOIN part ON item = p_partkey""",
    "read_items": """SELECT p_partkey AS item, 'The "' || p_name || '" has, ' || p_brand
        AS sentence, p_type AS sentence_type, p_brand AS filler_group, """ + ", ".join(
        f"p_name || ' {i}' AS word_{i}" for i in range(12)
    ) + ", 'always' AS adverb FROM part",
    "read_cossims": """SELECT model_id, 'blork' AS token, target_group,
        'all_but_the_top' AS correction,
        CAST(CASE WHEN eval_epoch = '0' THEN 0 ELSE 1 END AS BIGINT) AS eval_epoch, cossim
        FROM cs""",
    "nested_long": f"""WITH r AS (SELECT subject, CAST({V} AS DOUBLE) AS v, data_source AS ds,
          CASE WHEN to_subject THEN 'Subject target' ELSE 'Object target' END AS tr FROM exp),
        t AS (SELECT DISTINCT tr FROM r), d AS (SELECT DISTINCT ds FROM r),
        b AS (SELECT DISTINCT tr, ds FROM r)
        SELECT subject, 'voice_n_i_n_target_response' AS contrast, t.tr AS levels,
          sum(CASE WHEN r.tr = t.tr THEN v ELSE 0 END) AS value FROM r, t GROUP BY ALL
        UNION ALL SELECT subject, 'voice_n_i_n_data_source', d.ds,
          sum(CASE WHEN r.ds = d.ds THEN v ELSE 0 END) FROM r, d GROUP BY ALL
        UNION ALL SELECT subject, 'voice_n_i_n_target_response_i_n_data_source',
          b.tr || ', ' || b.ds, sum(CASE WHEN r.tr = b.tr AND r.ds = b.ds THEN v ELSE 0 END)
          FROM r, b GROUP BY ALL""",
    "nested_sparse": f"""WITH r AS (SELECT CAST({V} AS DOUBLE) AS v, data_source AS ds,
          CASE WHEN to_subject THEN 'Subject target' ELSE 'Object target' END AS tr FROM exp),
        e AS (SELECT 'voice_n_i_n_target_response' AS contrast, [tr] AS own, v FROM r
          UNION ALL SELECT 'voice_n_i_n_data_source', [ds], v FROM r
          UNION ALL SELECT 'voice_n_i_n_target_response_i_n_data_source', [tr, ds], v FROM r)
        SELECT contrast, array_to_string(own, ', ') AS levels,
          row_number() OVER (ORDER BY contrast, own) - 1 AS slot, sum(v) AS value, count(*) AS n
        FROM e GROUP BY contrast, own""",
    "assign_practice_words": """SELECT subject, item, p_name || ' ' || i AS word,
        CASE WHEN i < 4 THEN '[subj]' ELSE '[obj]' END AS target_response FROM (
          SELECT subject, item, CAST('0x' || substr(md5('0|' || subject || '|' || item), 1, 8)
            AS BIGINT) % 8 AS i FROM pairs) LEFT JOIN part ON item = p_partkey""",
    "schedule": """WITH t AS (SELECT subject, item,
          row_number() OVER (PARTITION BY subject ORDER BY h, item) AS rn,
          row_number() OVER (PARTITION BY subject ORDER BY h DESC, item DESC) - 1 AS i
          FROM (SELECT *, md5('0|' || subject || '|' || item) AS h FROM pairs))
        SELECT subject, item, i + i // 44 AS position, 'trial' AS row_kind FROM t
        UNION ALL SELECT subject, NULL, i + i // 44 + 1, 'break' FROM t
          WHERE i % 44 = 43 AND rn > 1""",
}


def statement(name: str) -> str:
    """The full statement of a query: all CTEs, then its SELECT."""
    ctes = ",\n".join(f"{cte} AS ({body})" for cte, body in CTES.items())
    return f"WITH {ctes}\nSELECT * FROM ({SELECTS[name]})"

# The online criterion is the same table.
SELECTS["training_gate_online"] = SELECTS["training_gate"]

# Parts of the logs give the same exclusions as the whole.
SELECTS["exclusions_kept_up"] = SELECTS["exclusion_reasons"]


def statements() -> dict[str, str]:
    return {name: statement(name) for name in SELECTS}
