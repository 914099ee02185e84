"""DuckDB SQL for the registered queries, over the given tables."""

from __future__ import annotations

from catalog import texts as t
from catalog.texts import MIN_K

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, **values: str) -> str:
    """A template as a SQL concatenation."""
    from string import Formatter

    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(q(literal))
        if field is not None:
            parts.append(f"CAST({values[field]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


def digest(text: str) -> str:
    encoded = f"to_base64(unhex(md5({text})))"
    return f"rtrim(replace(replace({encoded}, '+', '-'), '/', '_'), '=')"


# --- views ------------------------------------------------------------------------------------

MC = """
k AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk
      FROM lineitem GROUP BY l_orderkey, l_linenumber),
r AS (SELECT k.*, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS l0 FROM k),
mc AS (SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS uuid,
  CASE WHEN l_linenumber = l0 THEN NULL
    ELSE concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l0 AS VARCHAR)) END AS parent_uuid,
  l_orderkey * 10 + l_linenumber AS ord,
  CAST(l_orderkey % 4 AS INT) AS answer_idx,
  CASE WHEN l_linenumber = l0 THEN NULL ELSE CAST(l_linenumber % 4 AS INT) END AS rot,
  CASE pk % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN ' C ' WHEN 3 THEN 'D'
    WHEN 4 THEN 'Answer: B' WHEN 5 THEN 'so D.' WHEN 6 THEN '???' ELSE '(C) C. it is' END
    AS generated_text
FROM r)"""

SCORED = MC + """,
parsed AS (SELECT *, CAST(CASE trim(generated_text) WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2
    WHEN 'D' THEN 3 ELSE CASE WHEN contains(generated_text, 'A') THEN 0
      WHEN contains(generated_text, 'B') THEN 1 WHEN contains(generated_text, 'C') THEN 2
      WHEN contains(generated_text, 'D') THEN 3 END END AS INT) AS prediction_index FROM mc),
scored AS (SELECT *, CAST(CASE WHEN prediction_index IS NULL THEN 0
    WHEN coalesce((prediction_index + rot) % 4, prediction_index) = answer_idx THEN 1
    ELSE 0 END AS INT) AS hit FROM parsed),
grouped AS (SELECT coalesce(parent_uuid, uuid) AS uuid, CAST(sum(hit) AS BIGINT) AS hits,
    count(*) AS n FROM scored GROUP BY 1)"""

CHOICES = "['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']"

PROBLEMS = f"""
p0 AS (SELECT o_orderkey AS ord,
    concat('Order ', CAST(o_orderkey AS VARCHAR), ' has which priority?') AS problem,
    {CHOICES} AS choices, CAST(substring(o_orderpriority, 1, 1) AS INT) - 1 AS answer_idx,
    concat('{{"id": "', CAST(o_orderkey AS VARCHAR), '"}}') AS extra_json FROM orders)"""


def uuid_of(problem="problem", choices="choices", answer="answer_idx", perm="'None'",
            extra="extra_json") -> str:
    return digest(
        f"{problem} || '$choices$' || array_to_string({choices}, ';') || '$ans$' || "
        f"CAST({answer} AS VARCHAR) || '$perm$' || {perm} || '$ex$' || {extra}"
    )


def lines_of(template: str, choices: str) -> str:
    """All choice lines of a list."""
    line = filled(template, choice_key="chr(CAST(64 + i AS INT))", choice_text=f"{choices}[i]")
    return f"array_to_string(list_transform(range(1, len({choices}) + 1), lambda i: {line}), '')"


ROTATED = PROBLEMS + f""",
rp AS (SELECT *, ord % 2 = 1 AS turned,
    CASE WHEN ord % 2 = 1 THEN list_transform([0, 1, 2, 3, 4], lambda i: (ord + i) % 5)
      ELSE [0, 1, 2, 3, 4] END AS perm FROM p0),
rot AS (SELECT *, list_transform(perm, lambda i: choices[i + 1]) AS shown,
    CASE WHEN turned THEN '[' || array_to_string(list_transform(perm, lambda i: CAST(i AS VARCHAR)), ', ') || ']'
      ELSE 'None' END AS perm_text FROM rp)"""

METRICS = ["accuracy", "logic", "relevance", "coherence", "conciseness", "overall"]

# whether a score was given as text
TEXTS = ", ".join(
    f"coalesce(json_type(j, '$.{'overall_score' if m == 'overall' else m + '.score'}') = 'VARCHAR', false) AS {m}_text"
    for m in METRICS
)

JUDGE = """
s AS (SELECT events.*, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq
      FROM events),
raw AS (SELECT concat(CAST(user_id AS VARCHAR), '-', CAST(CAST(floor(seq / 5) AS BIGINT) AS VARCHAR))
    AS conv_id, CAST(seq % 5 AS INT) AS round,
  concat('m', CAST(user_id % 4 AS VARCHAR)) AS model,
  concat('d', CAST(user_id % 3 AS VARCHAR)) AS dataset,
  concat('note {"accuracy": {"comment": "c", "score": ', CAST(event_id % 7 AS VARCHAR),
    '}, "logic": {"score": "', CAST(event_id % 5 AS VARCHAR), '"}, "relevance": {"score": ',
    CAST(event_id % 4 + 1 AS VARCHAR), '}, "coherence": {"score": null}, "overall_score": ',
    CAST(event_id % 4 + 1 AS VARCHAR), ', "stop_conversation": ',
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'true' ELSE 'false' END,
    ', "stop_reason": "',
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'off_topic' ELSE 'none' END,
    '"} end') AS content
FROM s),
body AS (SELECT *, regexp_extract(content, '\\{.*\\}') AS j FROM raw),
judged AS (SELECT conv_id, round, model, dataset, content,
    TRY_CAST(json_extract_string(j, '$.accuracy.score') AS DOUBLE) AS accuracy,
    TRY_CAST(json_extract_string(j, '$.logic.score') AS DOUBLE) AS logic,
    TRY_CAST(json_extract_string(j, '$.relevance.score') AS DOUBLE) AS relevance,
    TRY_CAST(json_extract_string(j, '$.coherence.score') AS DOUBLE) AS coherence,
    TRY_CAST(json_extract_string(j, '$.conciseness.score') AS DOUBLE) AS conciseness,
    TRY_CAST(json_extract_string(j, '$.overall_score') AS DOUBLE) AS overall,
    {TEXTS},
    coalesce(json_extract_string(j, '$.accuracy.comment'), '') AS accuracy_comment,
    coalesce(json_extract_string(j, '$.logic.comment'), '') AS logic_comment,
    json_extract_string(j, '$.stop_conversation') = 'true' AS stop,
    json_extract_string(j, '$.stop_reason') AS stop_reason FROM body),
stopping AS (SELECT *, min(CASE WHEN stop THEN round END) OVER (PARTITION BY conv_id) AS first_stop
    FROM judged),
kept AS (SELECT * FROM stopping WHERE first_stop IS NULL OR round <= first_stop)""".replace("{TEXTS}", TEXTS)


def long_scores(source: str, strict: bool) -> str:
    """One row per round and metric with the score that counts."""
    parts = []
    for m in METRICS:
        value = m if strict or m == "overall" else f"CASE WHEN {m} BETWEEN 0 AND 5 THEN {m} END"
        parts.append(
            f"SELECT conv_id, round, model, dataset, '{m}' AS metric, {value} AS v, {m}_text AS txt FROM {source}"
        )
    return " UNION ALL ".join(parts)


def conversations(strict: bool) -> str:
    """Per conversation and metric statistics and the decayed score."""
    odd = "CASE WHEN bool_or(txt OR v NOT IN (0, 1, 2, 3, 4)) THEN NULL ELSE " if strict else "("
    close = " END" if strict else ")"
    return JUDGE + f""",
long AS ({long_scores('kept', strict)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, metric ORDER BY round) - 1 AS i
    FROM long WHERE v IS NOT NULL{" OR txt" if strict else ""}),
decayed AS (SELECT conv_id, metric, min(v) AS min, max(v) AS max, avg(v) AS mean,
    {odd} sum((CASE v WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 3.0 WHEN 3 THEN 7.0
        WHEN 4 THEN 10.0 ELSE v / 4.0 * 10 END) * exp(CAST(-0.2 AS DOUBLE) * i))
      / sum(exp(CAST(-0.2 AS DOUBLE) * i)) * 10.0{close} AS score
    FROM placed GROUP BY conv_id, metric),
convs AS (SELECT conv_id, any_value(model) AS model, any_value(dataset) AS dataset,
    count(*) AS rounds, bool_or(stop) AS stopped FROM kept GROUP BY conv_id),
cells AS (SELECT conv_id, model, dataset, rounds, metric FROM convs,
    (SELECT unnest({METRICS}) AS metric)),
scores AS (SELECT cells.*, d.min, d.max, d.mean, d.score FROM cells
    LEFT JOIN decayed d ON d.conv_id = cells.conv_id AND d.metric = cells.metric)"""


DIALOGUE = """
turns AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS seq,
  CASE role WHEN 'user' THEN 'interactor' ELSE 'candidate' END AS party, text AS content
FROM conversations WHERE role <> 'system')"""

CLOZE = """
k AS (SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS p, min(l_quantity) AS q,
      min(l_discount) AS d FROM lineitem GROUP BY l_orderkey, l_linenumber),
cz AS (SELECT CAST(l_orderkey AS VARCHAR) AS parent_uuid,
  concat('c', CAST(l_linenumber AS VARCHAR)) AS choice, l_linenumber AS pos,
  -p / 1000 AS ll, CAST(q AS INT) AS len, -d * 10 AS un,
  concat('c', CAST(min(l_linenumber) OVER (PARTITION BY l_orderkey) AS VARCHAR)) AS answer_text
FROM k)"""

TOKENS = """
tok AS (SELECT CAST(vec_id AS VARCHAR) AS uuid, CAST(label < 5 AS INT) AS group_label,
  list_transform(list_concat(embedding, embedding[1 : 1 + vec_id % 62]), lambda x: -abs(CAST(x AS DOUBLE)))
    AS token_logprobs FROM embeddings)"""

TRANSCRIPT = JUDGE + """,
said AS (SELECT conv_id, round * 3 AS seq, round, 'interactor' AS party,
    concat('Why ', CAST(round AS VARCHAR), ' of ', conv_id) AS content FROM raw
  UNION ALL SELECT conv_id, round * 3 + 1, round, 'candidate',
    concat('As ', CAST(round AS VARCHAR), ' of ', conv_id) FROM raw
  UNION ALL SELECT conv_id, round * 3 + 2, round, 'evaluator', content FROM raw)"""


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --- multiple choice --------------------------------------------------------------------------

_ACC = "round(num_hits / num_groups, 9) AS accuracy, num_hits, num_groups, num_instances"

oracle("mc_accuracy_strict", f"""WITH {SCORED}, a AS (
SELECT count(*) FILTER (hits = n) AS num_hits, count(*) AS num_groups,
  CAST(sum(n) AS BIGINT) AS num_instances FROM grouped)
SELECT {_ACC}, 'strict' AS aggregate_mode FROM a""")
oracle("mc_accuracy_mean", f"""WITH {SCORED}, a AS (
SELECT CAST(sum(hits) AS BIGINT) AS num_hits, CAST(sum(n) AS BIGINT) AS num_groups,
  CAST(sum(n) AS BIGINT) AS num_instances FROM grouped)
SELECT {_ACC}, 'mean' AS aggregate_mode FROM a""")
oracle("mc_accuracy_ignore_augmented", f"""WITH {SCORED}, a AS (
SELECT CAST(sum(hit) FILTER (parent_uuid IS NULL) AS BIGINT) AS num_hits,
  count(*) FILTER (parent_uuid IS NULL) AS num_groups, count(*) AS num_instances FROM scored)
SELECT {_ACC}, 'ignore_augmented' AS aggregate_mode FROM a""")
oracle("mc_accuracy_vote", f"""WITH {SCORED}, a AS (
SELECT count(*) FILTER (hits / n >= 0.5) AS num_hits, count(*) AS num_groups,
  CAST(sum(n) AS BIGINT) AS num_instances FROM grouped)
SELECT {_ACC}, 'vote' AS aggregate_mode FROM a""")
oracle("mc_predictions", f"WITH {SCORED} SELECT uuid, hits, n FROM grouped")
oracle("mc_predictions_vote", f"""WITH {SCORED}
SELECT uuid, CAST(hits / n >= 0.5 AS BIGINT) AS hits, CAST(1 AS BIGINT) AS n FROM grouped""")
oracle("answer_parse_breakdown", f"""WITH {SCORED}
SELECT generated_text, prediction_index, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS n
FROM scored GROUP BY generated_text, prediction_index""")
oracle("responses_attached", f"""WITH {SCORED}
SELECT uuid, parent_uuid, generated_text, prediction_index, hit FROM scored""")
oracle("responses_from_files", f"WITH {MC} SELECT uuid, parent_uuid, generated_text FROM mc")
oracle("responses_rerun", f"WITH {MC} SELECT uuid, parent_uuid, generated_text FROM mc")
oracle("empty_responses", f"""WITH {SCORED}
SELECT count(*) FILTER (prediction_index IS NULL) AS empty, count(*) AS originals
FROM scored WHERE parent_uuid IS NULL""")

# --- problems ---------------------------------------------------------------------------------

oracle("problem_uuid", f"WITH {ROTATED} SELECT ord, {uuid_of(perm='perm_text')} AS uuid FROM rot")

_PART = "CAST(CAST(concat('0x', substr(md5(uuid), {}, 15)) AS BIGINT) AS HUGEINT)"
_TAIL = q("$tmpl$default$sysprompt$Be brief.")
oracle("dataset_fingerprint", f"""WITH {PROBLEMS}, u AS (SELECT {uuid_of()} AS uuid FROM p0),
a AS (SELECT count(*) AS n_problems, sum({_PART.format(1)}) AS a, sum({_PART.format(16)}) AS b FROM u)
SELECT n_problems, {digest("CAST(n_problems AS VARCHAR) || '$' || CAST(a AS VARCHAR) || '$' || "
                           "CAST(b AS VARCHAR) || " + _TAIL)} AS fingerprint FROM a""")

_GOLD = filled(
    t.CHOICE_TEMPLATES["default"],
    choice_key="chr(CAST(65 + perm[answer_idx + 1] AS INT))",
    choice_text="choices[answer_idx + 1]",
)
_PLAIN_GOLD = filled(
    t.CHOICE_TEMPLATES["default"],
    choice_key="chr(65 + answer_idx)",
    choice_text="choices[answer_idx + 1]",
)
oracle("choices_rendered", f"""WITH {ROTATED} SELECT ord, {", ".join(
    f"{lines_of(text, 'shown')} AS choices_{name}" for name, text in t.CHOICE_TEMPLATES.items()
)}, {_GOLD} AS gold FROM rot""")


def question(tmpl: str, choices: str) -> str:
    return filled(
        t.QUESTION_TEMPLATES[tmpl],
        problem="problem",
        choices=lines_of(t.CHOICE_TEMPLATES[tmpl], choices),
    )


SEP = q("\n\n")
oracle("prompt_rendered", f"""WITH {ROTATED}
SELECT ord, {q("Answer with one key." + chr(10) * 2)} || {question('default', 'shown')} || {SEP}
  AS prompt FROM rot""")
oracle("fewshot_prompt", f"""WITH {PROBLEMS}, five AS (SELECT * FROM p0 ORDER BY ord LIMIT 5),
shots AS (SELECT string_agg({question('default', 'choices')} || {SEP} || {_PLAIN_GOLD} || {SEP}, ''
    ORDER BY ord) AS text FROM five)
SELECT ord, (SELECT text FROM shots) || {question('default', 'choices')} || {SEP} AS prompt
FROM p0""")
_QA = filled(t.QUESTION_TEMPLATES["qa"], problem="problem")
oracle("qa_prompt", f"""WITH {PROBLEMS}, five AS (SELECT * FROM p0 ORDER BY ord LIMIT 5),
shots AS (SELECT string_agg({_QA} || {SEP} || choices[answer_idx + 1] || {q(chr(10))} || {SEP}, ''
    ORDER BY ord) AS text FROM five)
SELECT ord, CASE WHEN ord % 100 = 7 THEN 'Own prompt'
  ELSE (SELECT text FROM shots) || {_QA} END AS prompt FROM p0""")
oracle("fewshot_text", f"""WITH {PROBLEMS}
SELECT ord, choices[answer_idx + 1] AS answer_text,
  choices[answer_idx + 1] || '. ' || choices[answer_idx + 1] || {q(chr(10))} AS gold FROM p0""")
oracle("augment_invariants", f"""WITH {PROBLEMS}
SELECT {uuid_of()} AS uuid, CAST(4 AS BIGINT) AS copies, true AS bijective, true AS keeps_gold
FROM p0""")
_DRAWN = "list_sort(list_transform([0, 1, 2, 3, 4], lambda j: md5(uuid || '$' || c || '$2$' || j) || j))"
_PLACED = "list_transform(p, lambda x, i: CASE WHEN i - 1 = answer_idx THEN answer_idx WHEN x = answer_idx THEN p[answer_idx + 1] ELSE x END)"
oracle("augment_permutations", f"""WITH {PROBLEMS},
u AS (SELECT ord, answer_idx, {uuid_of()} AS uuid, unnest(range(4)) AS c FROM p0),
d AS (SELECT *, list_transform({_DRAWN}, lambda s: CAST(s[33:] AS INT)) AS p FROM u)
SELECT ord, array_to_string(CASE WHEN c < 1 THEN {_PLACED} ELSE p END, ',') AS permutation FROM d""")
oracle("fewshot_sample", f"""WITH {PROBLEMS}, u AS (SELECT ord, {uuid_of()} AS uuid FROM p0)
SELECT ord, uuid FROM u ORDER BY md5(uuid || '$2'), uuid LIMIT 5""")
oracle("augment_dataset", f"""WITH {PROBLEMS}
SELECT true AS original, count(*) AS n, count(*) AS problems,
  CAST(sum(answer_idx) AS BIGINT) AS answers FROM p0
UNION ALL SELECT false, count(*) * 4, count(*), CAST(sum(answer_idx) * 4 AS BIGINT) FROM p0""")

_UNROLLED = PROBLEMS + f""",
un AS (SELECT *, {uuid_of()} AS parent, unnest(range(5)) AS pos,
    choices[answer_idx + 1] AS answer_text FROM p0),
ch AS (SELECT *, choices[pos + 1] AS choice FROM un)"""
_CHOICE_UUID = uuid_of(choices="[choice]", answer="answer_text")
_BARE_UUID = uuid_of(problem="'None'", choices="[choice]", answer="answer_text")
oracle("cloze_unroll", f"""WITH {_UNROLLED} SELECT ord, CAST(pos AS INT) AS pos,
  {_CHOICE_UUID} AS uuid, parent AS parent_uuid, choice, answer_text FROM ch""")
oracle("cloze_uncond_unroll", f"""WITH {_UNROLLED}
SELECT ord, CAST(pos AS INT) AS pos, false AS unconditional, {_CHOICE_UUID} AS uuid,
  parent AS parent_uuid, choice, answer_text, CAST(NULL AS VARCHAR) AS prompt FROM ch
UNION ALL SELECT ord, CAST(pos AS INT), true, {_BARE_UUID}, parent, choice, answer_text, 'Answer:'
FROM ch""")
oracle("qa_unroll", f"""WITH {PROBLEMS}
SELECT ord, {uuid_of()} AS uuid, choices[answer_idx + 1] AS answer_text,
  choices[answer_idx + 1] AS choices FROM p0""")
oracle("first_n", f"WITH {PROBLEMS} SELECT ord, {uuid_of()} AS uuid FROM p0 ORDER BY ord LIMIT 100")
oracle("max_instances", f"""WITH {SCORED}
SELECT ord, uuid, prediction_index FROM scored
WHERE parent_uuid IS NULL AND prediction_index IS NOT NULL ORDER BY ord LIMIT 200""")
oracle("max_instances_grouped", f"""WITH {ROTATED},
g AS (SELECT 0 AS a, 0 AS b, 'few' AS dataset, ord, {uuid_of()} AS uuid FROM p0 WHERE ord % 50 = 3
  UNION ALL SELECT 0, 1, 'rotated', ord, {uuid_of(perm='perm_text')} FROM rot
  UNION ALL SELECT 1, 0, 'plain', ord, {uuid_of()} FROM p0)
SELECT dataset, ord, uuid FROM g ORDER BY a, b, ord LIMIT 200""")
oracle("group_union", f"""WITH {PROBLEMS}
SELECT d.dataset, answer_idx, count(*) AS n, max(ord) AS last_ord
FROM p0, (SELECT unnest(['plain', 'rotated']) AS dataset) d GROUP BY d.dataset, answer_idx""")
oracle("sft_rows", f"""WITH {PROBLEMS}
SELECT {question('default', 'choices')} AS instruction, {_PLAIN_GOLD} AS output FROM p0""")
oracle("pt_rows", f"""WITH {PROBLEMS}
SELECT {question('default', 'choices')} || {_PLAIN_GOLD} AS instruction FROM p0""")

_Q = question("default", "choices")
oracle("request_build", f"""WITH {PROBLEMS}, x AS (SELECT *, {_Q} AS question FROM p0)
SELECT ord,
  CASE WHEN ord % 2 = 0 THEN 'Be brief. ' || {SEP} || question || {SEP} ELSE problem || {SEP} END
    AS text,
  CASE WHEN ord % 2 = 0 THEN question ELSE problem END AS no_system,
  CASE WHEN ord % 2 = 0 THEN 'Be brief. ' || question || '|' ELSE problem || '|' END AS folded,
  1 AS n_folded,
  {filled(t.SYSTEM_WRAPPERS["llama2"], prompt="problem")} AS wrapped,
  CASE WHEN ord % 3 = 0
    THEN '{{"max_new_tokens":"20","temperature":"0.7","stop_sequences":"[\\"A\\"]"}}'
    ELSE '{{"max_new_tokens":"20","temperature":"0.0"}}' END AS config,
  CASE WHEN ord % 3 = 0 THEN '{{"max_new_tokens":"20","temperature":"0.7"}}'
    ELSE '{{"max_new_tokens":"20","temperature":"0.0"}}' END AS chat_config
FROM x""")
oracle("response_text", f"WITH {MC} SELECT uuid, trim(generated_text) AS text FROM mc")

# --- benchmarks -------------------------------------------------------------------------------

_FIVE = q('["A","B","C","D","E"]')
_FOUR = q('["A","B","C","D"]')
_ROW = "'{\"id\": ' || CAST(ord AS VARCHAR) || '}'"
_NONE = "CAST(NULL AS VARCHAR)"


FOUR = MC + """,
p0 AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, ord AS key, 'Pick for ' || uuid AS problem,
  ['alpha', 'beta', 'gamma', 'delta'] AS choices, answer_idx,
  '{"id": "' || CAST(ord AS VARCHAR) || '"}' AS extra_json FROM mc)"""


def benchmark(name, problem="problem", choices="choices", answer="answer_idx",
              extra="extra_json", stops=_FIVE, source=PROBLEMS) -> None:
    extra_text = "'null'" if extra == _NONE else extra
    oracle(f"benchmark_{name}", f"""WITH {source}
SELECT ord, {uuid_of(problem, choices, answer, extra=extra_text)} AS uuid, {problem} AS problem,
  array_to_string({choices}, ';') AS choices, CAST({answer} AS INT) AS answer_idx,
  {extra} AS extra_json, {stops} AS stops FROM p0""")


benchmark("arc")
benchmark("mmlu", extra=_NONE, stops=_NONE)
benchmark("truthful_qa", extra=_ROW)
benchmark("hellaswag", extra=_ROW)
benchmark("ceval", extra=_ROW, stops=_FOUR, source=FOUR)
benchmark("medmcqa", stops=_FOUR, source=FOUR)
benchmark(
    "reclor",
    problem="('Context: No ' || CAST(key AS VARCHAR) || " + q("\n Question: ") + " || problem)",
    stops=_FOUR,
    source=FOUR,
)
benchmark("hotpot_qa", choices="[choices[answer_idx + 1]]", answer="0", stops=q('["\\n\\n"]'))
benchmark("gsm8k", choices="[choices[answer_idx + 1]]", answer="0", extra="'{}'", stops=q('["A"]'))
benchmark("self_instruct", extra="'{}'")
benchmark(
    "mathqa",
    choices="['1-URGENT ', '2-HIGH ', '3-MEDIUM ', '4-NOT SPECIFIED ', '5-LOW']",
    extra="'{\"id\": \"' || sha256(problem) || '\"}'",
)

# --- cloze and log-probabilities --------------------------------------------------------------


def cloze(ln: bool, un: bool) -> str:
    score = "(ll - un)" if un else "ll"
    score = f"{score} / len" if ln else score
    return f"""{CLOZE},
best AS (SELECT *, row_number() OVER (PARTITION BY parent_uuid ORDER BY {score} DESC, pos) AS rn
    FROM cz),
pred AS (SELECT parent_uuid, choice AS prediction, answer_text,
    CAST(choice = answer_text AS INT) AS hit FROM best WHERE rn = 1)"""


for _name, _ln, _un in (("", False, False), ("_ln", True, False), ("_un", False, True),
                        ("_ln_un", True, True)):
    oracle(f"cloze_accuracy{_name}", f"""WITH {cloze(_ln, _un)}
SELECT round(sum(hit) / count(*), 9) AS accuracy, CAST(sum(hit) AS BIGINT) AS num_hits,
  count(*) AS num_groups, (SELECT count(*) * {2 if _un else 1} FROM cz)::BIGINT AS num_instances,
  {str(_ln).lower()} AS apply_ln, {str(_un).lower()} AS apply_un
FROM pred""")
oracle("cloze_from_responses", ORACLES["cloze_accuracy_ln_un"])
oracle("cloze_predictions", f"WITH {cloze(True, False)} SELECT * FROM pred")
oracle("cloze_unconditional_join", f"""WITH {CLOZE},
best AS (SELECT *, row_number() OVER (PARTITION BY parent_uuid
    ORDER BY ll / len - un / len DESC, pos) AS rn FROM cz)
SELECT parent_uuid, choice AS prediction, answer_text, CAST(choice = answer_text AS INT) AS hit
FROM best WHERE rn = 1""")
oracle("lm_loss_mean", f"""WITH {TOKENS}
SELECT round(avg(-list_sum(token_logprobs) / len(token_logprobs)), 9) AS avg_loss FROM tok""")
oracle("sequence_loss", f"""WITH {TOKENS}
SELECT uuid, round(-list_sum(token_logprobs) / len(token_logprobs), 9) AS lm_loss FROM tok""")
oracle("target_loglik", f"""WITH {TOKENS}
SELECT uuid, round(list_sum(token_logprobs[greatest(len(token_logprobs) - 4, 1):]), 9)
  AS loglikelihood FROM tok""")

_KS = ", ".join(f"CAST({k} AS DOUBLE)" for k in MIN_K)
_MINK = TOKENS + f""",
ks AS (SELECT uuid, group_label, list_sort(token_logprobs) AS lp, unnest([{_KS}]) AS k FROM tok),
cut AS (SELECT *, CAST(trunc(len(lp) * k) AS BIGINT) AS n FROM ks),
mk AS (SELECT uuid, group_label, k, -list_sum(lp[1:n]) / n AS stat FROM cut WHERE n > 0),
hist AS (SELECT k, -stat AS score, count(*) FILTER (group_label = 1) AS p,
    count(*) FILTER (group_label = 0) AS g FROM mk GROUP BY k, -stat),
cum AS (SELECT *, coalesce(sum(g) OVER (PARTITION BY k ORDER BY score
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hist),
auc AS (SELECT 'min_k_prob_' || CAST(k AS VARCHAR) AS metric, k,
    CAST(sum(p * (below + g / 2)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * CAST(sum(g) AS DOUBLE)) AS auc,
    CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(g) AS BIGINT) AS n_neg FROM cum GROUP BY k)"""
oracle("min_k_stats", f"""WITH {_MINK}
SELECT uuid, group_label, k, round(stat, 9) AS stat FROM mk""")
oracle("labelled_union", f"""WITH {TOKENS}
SELECT group_label, count(*) AS n, CAST(sum(len(token_logprobs)) AS BIGINT) AS tokens
FROM tok GROUP BY group_label""")
oracle("min_k_auc", f"""WITH {_MINK}
SELECT metric, round(auc, 9) AS auc, n_pos, n_neg FROM auc""")
oracle("markdown_row", f"""WITH {_MINK}
SELECT string_agg(printf(' %.3f |', auc), '' ORDER BY k) AS markdown FROM auc""")
oracle("roc_auc_events", """WITH hist AS (SELECT value AS score,
    count(*) FILTER (event_type = 'error') AS p, count(*) FILTER (event_type <> 'error') AS g
  FROM events GROUP BY value),
cum AS (SELECT *, coalesce(sum(g) OVER (ORDER BY score
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hist)
SELECT round(CAST(sum(p * (below + g / 2)) AS DOUBLE)
    / (CAST(sum(p) AS DOUBLE) * CAST(sum(g) AS DOUBLE)), 9) AS auc,
  CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(g) AS BIGINT) AS n_neg FROM cum""")

# --- judged rounds ----------------------------------------------------------------------------

oracle("judge_parse", f"""WITH {JUDGE}
SELECT conv_id, round, accuracy AS accuracy_score, logic AS logic_score,
  relevance AS relevance_score, coherence AS coherence_score, conciseness AS conciseness_score,
  accuracy_comment, logic_comment, '' AS comment, overall AS overall_score,
  stop AS stop_conversation, stop_reason FROM judged""")
oracle("judge_parse_lenient", """WITH e AS (
  SELECT event_id, CAST(event_id % 4 AS DOUBLE) AS n, CAST(floor(event_id / 4) AS BIGINT) % 12 AS k FROM events)
SELECT event_id, CASE k WHEN 9 THEN '+' || CAST(event_id % 4 AS VARCHAR) || ' .5 0x1'
    WHEN 11 THEN chr(CAST(64 + event_id % 4 AS INT)) ELSE '' END AS comment,
  CASE k WHEN 1 THEN n / 10 WHEN 10 THEN n * power(2.0, 76) WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE n END AS overall_score,
  CASE k WHEN 8 THEN 'overall' ELSE '' END AS texts, k NOT IN (4, 5) AS parsed FROM e""")
oracle("judge_invalid_scores", f"""WITH {JUDGE}, g AS ({long_scores('judged', True)}),
v AS ({long_scores('judged', False)}),
a AS (SELECT metric, count(v) AS given FROM g GROUP BY metric),
b AS (SELECT metric, count(v) AS valid FROM v GROUP BY metric)
SELECT a.metric, given, valid FROM a JOIN b ON a.metric = b.metric""")
oracle("rounds_until_stop", f"""WITH {JUDGE}, f AS (SELECT *, min(CASE WHEN stop THEN round END)
    OVER (PARTITION BY conv_id) AS first FROM judged WHERE round < 4)
SELECT conv_id, round, overall AS overall_score, stop AS stop_conversation FROM f
WHERE first IS NULL OR round <= first""")
oracle("round_stats", f"""WITH {JUDGE}, l AS ({long_scores('kept', False)})
SELECT round, metric, count(v) AS nonempty_values, round(avg(v), 9) AS mean, min(v) AS min,
  max(v) AS max FROM l WHERE v IS NOT NULL GROUP BY round, metric""")
oracle("round_histogram", f"""WITH {JUDGE}, l AS ({long_scores('kept', False)})
SELECT round, metric, v AS score, count(*) AS n FROM l WHERE v IS NOT NULL
GROUP BY round, metric, v""")
oracle("valid_positions", f"""WITH {JUDGE}
SELECT conv_id, round, accuracy AS value,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY round) - 1 AS INT) AS position
FROM judged WHERE accuracy BETWEEN 0 AND 5""")
oracle("conversation_scores", f"""WITH {conversations(False)}
SELECT conv_id, metric, min, max, round(mean, 9) AS mean, round(score, 6) AS score FROM scores""")
oracle("conversation_scores_strict", f"""WITH {conversations(True)}
SELECT conv_id, metric, round(score, 6) AS score FROM scores""")
oracle("run_scores", f"""WITH {conversations(False)}
SELECT metric, count(score) AS nonempty_values, round(avg(score), 6) AS mean,
  round(min(score), 6) AS min, round(max(score), 6) AS max FROM scores GROUP BY metric""")
oracle("active_conversations", f"""WITH {JUDGE}
SELECT conv_id, CAST(max(round) + 1 AS INT) AS next_round FROM judged GROUP BY conv_id
HAVING NOT bool_or(stop)""")
oracle("stopped_count", f"""WITH {JUDGE}, c AS (SELECT conv_id, bool_or(stop) AS stopped FROM judged
  GROUP BY conv_id) SELECT count(*) FILTER (stopped) AS stopped, count(*) AS conversations FROM c""")
oracle("last_round", f"""WITH {JUDGE}, l AS (SELECT *, row_number() OVER (PARTITION BY conv_id
    ORDER BY round DESC) AS rn FROM kept)
SELECT conv_id, round, overall AS overall_score, stop AS stop_conversation, stop_reason FROM l
WHERE rn = 1""")

# --- leaderboard ------------------------------------------------------------------------------


def board(strict: bool) -> str:
    means = ", ".join(f"avg(score) FILTER (metric = '{m}') AS {m}" for m in METRICS)
    mc = SCORED.replace("k AS (", "lk AS (", 1).replace("FROM k)", "FROM lk)").replace("k.*", "lk.*")
    return f"""{conversations(strict)}, {mc},
acc AS (SELECT concat('d', CAST(CAST(floor(ord / 10) AS BIGINT) % 3 AS VARCHAR)) AS dataset,
    concat('m', CAST(answer_idx AS VARCHAR)) AS model, avg(hit) * 100.0 AS mcp_acc
    FROM scored WHERE parent_uuid IS NULL GROUP BY 1, 2),
means AS (SELECT dataset, model, {means} FROM scores GROUP BY dataset, model),
per AS (SELECT conv_id, dataset, model, any_value(rounds) AS rounds,
    count(score) < {len(METRICS)} AS unscored FROM scores GROUP BY conv_id, dataset, model),
sizes AS (SELECT dataset, model, avg(rounds) AS conversation_completeness,
    count(*) AS conversations, count(*) FILTER (unscored) AS unscored
    FROM per GROUP BY dataset, model),
board AS (SELECT means.dataset, means.model,
    {", ".join(f"round(means.{m}, 6) AS {m}" for m in METRICS)},
    round(conversation_completeness, 6) AS conversation_completeness, conversations, unscored,
    round(coalesce(mcp_acc, -100.0), 6) AS mcp_acc
    FROM means JOIN sizes ON means.dataset = sizes.dataset AND means.model = sizes.model
    LEFT JOIN acc ON acc.dataset = means.dataset AND acc.model = means.model)"""


oracle("leaderboard", f"WITH {board(True)} SELECT * FROM board ORDER BY overall DESC")
oracle("leaderboard_tolerant", f"WITH {board(False)} SELECT * FROM board ORDER BY overall DESC")
_BOARD_METRICS = [*METRICS, "conversation_completeness", "mcp_acc"]
oracle("leaderboard_pivot", f"""WITH {board(False)}, l AS ({" UNION ALL ".join(
    f"SELECT dataset, model, '{m}' AS metric, {m} AS value FROM board" for m in _BOARD_METRICS)})
SELECT dataset, metric, {", ".join(
    f"max(value) FILTER (model = 'm{i}') AS m{i}" for i in range(4))}
FROM l GROUP BY dataset, metric""")
oracle("completeness", f"""WITH {JUDGE}, c AS (SELECT dataset, model, conv_id, count(*) AS n
    FROM kept GROUP BY dataset, model, conv_id)
SELECT dataset, model, round(avg(n), 9) AS conversation_completeness, count(*) AS conversations
FROM c GROUP BY dataset, model""")
_REASONS = """l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round DESC) AS rn
    FROM kept),
reasons AS (SELECT dataset, model, stop_reason, count(*) AS n FROM l WHERE rn = 1
    GROUP BY dataset, model, stop_reason)"""
oracle("stop_reasons", f"WITH {JUDGE}, {_REASONS} SELECT * FROM reasons")


def _json_number(m: str) -> str:
    return f"'\"{m}\":' || coalesce(CAST({m} AS VARCHAR), 'null')"


oracle("scores_json", f"""WITH {board(False)}, {_REASONS},
why AS (SELECT dataset, model, '{{' || string_agg('"' || stop_reason || '":' || CAST(n AS VARCHAR), ','
    ORDER BY stop_reason) || '}}' AS stop_reasons FROM reasons GROUP BY dataset, model),
obj AS (SELECT board.dataset, board.model, overall, '"' || board.model || '":{{' ||
    {" || ',' || ".join(_json_number(m) for m in [*METRICS, "conversation_completeness"])}
    || ',"stop_reasons":' || stop_reasons || ',' || {_json_number("mcp_acc")} || '}}' AS js
    FROM board JOIN why ON why.dataset = board.dataset AND why.model = board.model)
SELECT dataset, '{{' || string_agg(js, ',' ORDER BY overall DESC, model) || '}}' AS json
FROM obj GROUP BY dataset""")
oracle("run_names", f"""WITH {MC}, x AS (SELECT concat('m', CAST(answer_idx AS VARCHAR)) AS model,
    concat('d', CAST(CAST(floor(ord / 10) AS BIGINT) % 3 AS VARCHAR)) AS dataset FROM mc)
SELECT model || '@' || dataset || '.json' AS file, model, dataset, count(*) AS n
FROM x GROUP BY model, dataset""")
oracle("runs_attached", f"""WITH {JUDGE}
SELECT model || '-' || dataset AS run_key, model, dataset, count(*) AS rounds,
  round(avg(overall), 9) AS overall FROM judged GROUP BY model, dataset""")
oracle("results_json", f"""WITH {SCORED}, a AS (
SELECT CAST(sum(hits) AS BIGINT) AS num_hits, CAST(sum(n) AS BIGINT) AS num_groups FROM grouped)
SELECT 'simple_multiple_choice:mc-demo' AS key,
  '{{"accuracy":' || CAST(round(num_hits / num_groups, 9) AS VARCHAR) || ',"num_hits":'
  || CAST(num_hits AS VARCHAR) || ',"num_groups":' || CAST(num_groups AS VARCHAR)
  || ',"num_instances":' || CAST(num_groups AS VARCHAR) || ',"aggregate_mode":"mean"}}' AS json
FROM a""")

# --- dialogues --------------------------------------------------------------------------------


def _pair(tmpl: str) -> str:
    return filled(t.EVALUATOR_TURNS[tmpl], interactor_content="a.content",
                  candidate_content="b.content")


oracle("turn_pairs", f"""WITH {DIALOGUE}
SELECT a.conv_id, a.seq, CAST(row_number() OVER (PARTITION BY a.conv_id ORDER BY a.seq) - 1 AS INT)
  AS round, {_pair('add_detailed_criteria')} AS prompt
FROM turns a JOIN turns b ON b.conv_id = a.conv_id AND b.seq = a.seq + 1
WHERE a.party = 'interactor' AND b.party = 'candidate'""")
oracle("unpaired_turns", f"""WITH {DIALOGUE}
SELECT count(*) AS unpaired FROM turns b LEFT JOIN turns a ON a.conv_id = b.conv_id
  AND a.seq = b.seq - 1 AND a.party = 'interactor'
WHERE b.party = 'candidate' AND a.conv_id IS NULL""")
oracle("role_views", f"""WITH {DIALOGUE}
SELECT conv_id, seq, CASE WHEN party = v THEN 'assistant' ELSE 'user' END AS role, content,
  v AS party FROM turns, (SELECT unnest(['interactor', 'candidate']) AS v)
UNION ALL SELECT a.conv_id, b.seq, 'user', {_pair('default')}, 'evaluator'
FROM turns a JOIN turns b ON b.conv_id = a.conv_id AND b.seq = a.seq + 1
WHERE a.party = 'interactor' AND b.party = 'candidate'""")

_NAMES = "['alpha', 'beta', 'gamma', 'delta']"
_LINE = t.CHOICE_TEMPLATES["default"]


def _key(index: str) -> str:
    return f"chr(CAST(65 + coalesce(({index} + rot) % 4, {index}) AS INT))"


SEEDS = SCORED + f""",
named AS (SELECT *, 'Pick for ' || uuid AS problem, {_NAMES} AS choices,
    list_transform([0, 1, 2, 3], lambda i: {_NAMES}[(i + coalesce(rot, 0)) % 4 + 1]) AS shown
    FROM scored WHERE prediction_index IS NOT NULL),
texts AS (SELECT *, {filled(t.SEED_QUESTION_TEMPLATES["default"], problem="problem",
                            choices=lines_of(_LINE, "shown"))} AS mcp,
    {filled(_LINE, choice_key=_key("answer_idx"), choice_text="choices[answer_idx + 1]")} AS gold,
    {filled(_LINE, choice_key=_key("prediction_index"),
            choice_text="choices[prediction_index + 1]")} AS pred FROM named)"""


def openings(p: dict[str, str]) -> list[tuple[str, int, str, str]]:
    judge_system = p["evaluator_system_prompt"] + p["evaluator_system_prompt_json_example"]
    return [
        ("interactor", 0, "system", q(p["interactor_system_prompt"])),
        ("interactor", 1, "user", filled(p["interactor_init_user_prompt"], mcp_prompt="mcp",
                                         correct_answer="gold", model_prediction="pred")),
        ("candidate", 0, "system", q(p["candidate_system_prompt"])),
        ("candidate", 1, "user", "mcp"),
        ("candidate", 2, "assistant", "pred"),
        ("evaluator", 0, "system", q(judge_system)),
        ("evaluator", 1, "user", filled(p["evaluator_init_user_prompt"], mcp_prompt="mcp",
                                        model_prediction="pred")),
        ("evaluator", 2, "assistant", f"CASE WHEN pred = gold THEN {q(p['evaluator_fewshot_correct'])}"
                                      f" ELSE {q(p['evaluator_fewshot_incorrect'])} END"),
    ]


oracle("opening_messages", f"""WITH {SEEDS}, m AS ({" UNION ALL ".join(
    f"SELECT uuid AS conv_id, '{party}' AS party, CAST({seq} AS INT) AS seq, '{role}' AS role, "
    f"{content} AS content FROM texts" for party, seq, role, content in openings(t.PROMPTER))})
SELECT conv_id, party, seq, role, CAST(length(content) AS INT) AS n_chars,
  md5(content) AS content_md5 FROM m""")
oracle("seed_conversations", f"""WITH {SEEDS}
SELECT uuid AS conv_id, 'remote_hf: m' AS candidate_name,
  md5({" || ".join(f"{c} || {SEP}" for party, _, _, c in openings(t.CLEAR_PROMPTER)
                   if party == "evaluator")}) AS evaluator_md5,
  pred AS prediction FROM texts WHERE parent_uuid IS NULL""")
oracle("validated_filter", f"""WITH {MC}
SELECT uuid, ord FROM mc WHERE parent_uuid IS NULL AND CAST(floor(ord / 10) AS BIGINT) % 3 = 0""")
oracle("validated_missing", f"""WITH {MC}
SELECT uuid, ord FROM mc WHERE parent_uuid IS NULL AND CAST(floor(ord / 10) AS BIGINT) % 3 = 2""")
oracle("resume_pending", f"WITH {MC} SELECT uuid, ord FROM mc WHERE ord % 2 = 1")
oracle("transcript_filter", f"""WITH {TRANSCRIPT},
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS rn FROM said)
SELECT l.conv_id, CAST(l.seq AS INT) AS last_seq, j.overall AS overall_score
FROM l JOIN judged j ON j.conv_id = l.conv_id AND j.round = l.round
WHERE rn = 1 AND party = 'evaluator' AND NOT j.stop AND j.overall BETWEEN 2 AND 4""")
oracle("transcript_render", f"""WITH {JUDGE}, x AS (SELECT *, CAST(round AS VARCHAR) AS r,
    regexp_extract(content, '\\{{.*\\}}') AS j FROM raw)
SELECT conv_id, round, '## Interactor(Round ' || r || {q(")" + chr(10))} || 'Why ' || r || ' of ' || conv_id
    AS interactor,
  '## Candidate(Round ' || r || {q(")" + chr(10))} || 'As ' || r || ' of ' || conv_id AS candidate,
  '## Evaluation(Round ' || r || {q(")" + chr(10))}
    || ' + Accuracy(' || json_extract_string(j, '$.accuracy.score') || {q("): c" + chr(10))}
    || ' + Logic(' || json_extract_string(j, '$.logic.score') || {q("): " + chr(10))}
    || ' + Relevance(' || json_extract_string(j, '$.relevance.score') || {q("): " + chr(10))}
    || {q(" + Coherence(None): " + chr(10))}
    || ' + Overall_score: ' || json_extract_string(j, '$.overall_score') || {q(chr(10))}
    || ' + Stop_conversation: ' || CASE json_extract_string(j, '$.stop_conversation')
         WHEN 'true' THEN 'True' ELSE 'False' END || {q(chr(10))}
    || ' + Stop_reason: ' || json_extract_string(j, '$.stop_reason') || {q(chr(10))} AS evaluation
FROM x""")
_JUDGE_PROMPT = filled(t.SINGLE_JUDGE_TEMPLATE, question="question", answer="answer")
oracle("judge_requests", f"""WITH {DIALOGUE}, x AS (SELECT conv_id AS file,
    string_agg(CASE party WHEN 'interactor' THEN 'user' ELSE 'assistant' END || ': ' || content,
      {q(chr(10))} ORDER BY seq) FILTER (seq BETWEEN 1 AND 3) AS question,
    max(content) FILTER (seq = 4) AS answer FROM turns GROUP BY conv_id)
SELECT file, 2 AS n, 'user' AS role, {_JUDGE_PROMPT} AS content FROM x WHERE answer IS NOT NULL""")
oracle("transcripts_roundtrip", f"""WITH {TRANSCRIPT},
a AS (SELECT conv_id, count(*) AS turns FROM said GROUP BY conv_id),
b AS (SELECT conv_id, count(*) AS judged, sum(overall) AS overall_sum FROM judged
  GROUP BY conv_id)
SELECT a.conv_id, turns, judged, overall_sum FROM a LEFT JOIN b ON a.conv_id = b.conv_id""")

# --- inference and streaming ------------------------------------------------------------------

ORACLES["transcripts_json"] = ORACLES["transcripts_roundtrip"]
oracle("batch_inference", f"""WITH {DIALOGUE}
SELECT conv_id || '-' || CAST(seq AS VARCHAR) AS uuid, CASE WHEN seq % 2 = 0 THEN 'stored'
  ELSE 'len ' || CAST(length(content) AS VARCHAR) END AS generated_text, 'run' AS run_key
FROM turns""")
MULTI = DIALOGUE + """, f AS (SELECT conv_id || '/' || CAST(seq AS VARCHAR) AS conv_id,
    CAST(length(content) AS INT) AS size FROM turns),
rounds AS (SELECT *, unnest([0, 1, 2]) AS round FROM f),
stops AS (SELECT *, (size + 4 + 2 * round) % 7 = 0 AS stop FROM rounds),
alive AS (SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY conv_id ORDER BY round
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM stops),
x AS (SELECT *, 'Q' || CAST(2 + 2 * round AS VARCHAR) AS ask FROM alive WHERE NOT over)"""


def said(ask: str, where: str = "true") -> str:
    return f"""SELECT conv_id, CAST(round * 3 AS INT) AS seq, CAST(round AS INT) AS round,
  'interactor' AS party, {ask} AS content FROM x WHERE {where}
UNION ALL SELECT conv_id, round * 3 + 1, round, 'candidate',
  CAST(size AS VARCHAR) || ' for ' || {ask} FROM x WHERE {where}
UNION ALL SELECT conv_id, round * 3 + 2, round, 'evaluator', 'so {{"overall_score": '
  || CAST(size % 5 AS VARCHAR) || ', "stop_conversation": '
  || CASE WHEN stop THEN 'true' ELSE 'false' END || '}}' FROM x WHERE {where}"""


oracle("multi_round", f"WITH {MULTI} {said('ask')}")
oracle("multi_round_resumed", f"""WITH {MULTI}
{said("CASE WHEN size % 2 = 0 THEN 'stored' ELSE ask END", "round = 0")}""")
oracle("multi_round_duplicates", f"""WITH {MULTI}
SELECT conv_id, CAST(count(*) * 6 AS BIGINT) AS turns, CAST(2 AS BIGINT) AS dialogues FROM x
WHERE round < 2 GROUP BY conv_id""")
oracle("multi_round_reused", f"""WITH {MULTI}
SELECT run, asked_by, (SELECT count(*) FROM f) AS questions
FROM (VALUES ('first', 'first'), ('again', 'first'), ('model', 'model'), ('settings', 'settings'), ('seeds', 'seeds')) t(run, asked_by)""")
oracle("response_store_unfinished", f"""WITH {MC}
SELECT 'kept' AS run_key, uuid, parent_uuid, generated_text FROM mc
UNION ALL SELECT 'repeated', uuid, parent_uuid, generated_text FROM mc WHERE ord < 100""")
oracle("live_accuracy", f"""WITH {SCORED}
SELECT concat('run', CAST(answer_idx AS VARCHAR)) AS run_key, CAST(sum(hit) AS BIGINT) AS num_hits,
  count(*) AS num_groups, round(avg(hit), 9) AS accuracy, round(avg(ord % 100 / 10.0), 6) AS avg_loss
FROM scored GROUP BY answer_idx""")
oracle("live_rounds", f"""WITH {conversations(False)}
SELECT conv_id, any_value(convs.rounds) AS rounds, any_value(convs.stopped) AS stopped,
  round(max(score) FILTER (metric = 'accuracy'), 6) AS accuracy_score,
  round(max(score) FILTER (metric = 'overall'), 6) AS overall_score
FROM scores JOIN convs USING (conv_id) GROUP BY conv_id""")

ORACLES["live_accuracy_late"], ORACLES["live_rounds_gaps"] = ORACLES["live_accuracy"], ORACLES["live_rounds"]

# --- files ------------------------------------------------------------------------------------

oracle("benchmark_split", f"""WITH {PROBLEMS}, n AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS i FROM p0)
SELECT i AS ord, {uuid_of(extra="'null'")} AS uuid, problem, answer_idx FROM n
WHERE i % 3 = 0 AND i % 2 = 1""")
oracle("responses_roundtrip", f"""WITH {MC}
SELECT uuid, parent_uuid, generated_text, lpad(CAST(ord AS VARCHAR), 20, '0') AS arrival, 'run' AS run_key FROM mc""")
oracle("response_store", f"WITH {MC} SELECT uuid, parent_uuid, generated_text, 'a' AS run_key FROM mc")
oracle("request_list", f"""WITH {PROBLEMS}
SELECT {uuid_of()} AS uuid, problem, array_to_string(choices, ';') AS choices, CAST(ord AS VARCHAR) AS answer FROM p0""")
oracle("predictions_sink", f"WITH {SCORED} SELECT uuid, prediction_index, hit FROM scored")
oracle("choice_predictions_sink", f"WITH {SCORED} SELECT uuid, hits, n FROM grouped")
oracle("interactive_results", f"""WITH {JUDGE}, l AS ({long_scores('kept', False)})
SELECT 'key' AS hash, CAST(round AS VARCHAR) AS round,
  CASE metric WHEN 'overall' THEN 'overall_score' ELSE metric END AS metric,
  count(v) AS nonempty_values, round(avg(v), 9) AS mean, min(v) AS min, max(v) AS max
FROM l WHERE v IS NOT NULL GROUP BY round, metric""")
oracle("validated_ids", f"""WITH {MC}, o AS (SELECT uuid, CAST(floor(ord / 10) AS BIGINT) % 3 AS part FROM mc
  WHERE parent_uuid IS NULL)
SELECT uuid, CASE part WHEN 0 THEN 'kept' ELSE 'missing' END AS kind FROM o WHERE part <> 1""")
oracle("results_scan", f"""WITH {SCORED}, a AS (SELECT concat('m', CAST(answer_idx AS VARCHAR)) AS model,
    concat('d', CAST(CAST(floor(ord / 10) AS BIGINT) % 3 AS VARCHAR)) AS dataset,
    round(sum(hit) / count(*), 9) AS accuracy FROM scored GROUP BY 1, 2)
SELECT CAST(0 AS INT) AS pos, 'simple_multiple_choice:a' AS key, accuracy, CAST(NULL AS VARCHAR) AS hash FROM a
UNION ALL SELECT 1, 'interactive_evaluation_step:b', NULL, model || '-' || dataset FROM a""")
oracle("samples_scan", f"""WITH {DIALOGUE}
SELECT party AS role, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM turns GROUP BY party""")
_CONTEXT = ORACLES["dataset_fingerprint"]
_RUN = "'$type: openai$openai_model: ' || model || '$generation_config: {{}}$context_hash: ' || fingerprint"
oracle("run_keys", f"""WITH {MC}, m AS (SELECT concat('m', CAST(answer_idx AS VARCHAR)) AS model, count(*) AS n FROM mc
  GROUP BY 1), f AS ({_CONTEXT})
SELECT model, m.n, {digest(_RUN.format())} AS run_key FROM m, f""")
_NUMBERED = PROBLEMS + f""",
n AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, problem, choices, answer_idx,
    {uuid_of(extra="'null'")} AS uuid FROM p0)"""
_BRIEF = q("Brief." + chr(10) * 2)
oracle("benchmark_group", f"""WITH {_NUMBERED},
i AS (SELECT '0.0' AS part, ord, {question('reasoning', 'choices')} || {SEP} AS prompt FROM n WHERE ord % 2 = 1
  UNION ALL SELECT '0.1', ord, {_BRIEF} || {question('default', 'choices')} || {SEP} FROM n WHERE ord % 2 = 0),
shots AS (SELECT string_agg({question('default', 'choices')} || {SEP} || {_PLAIN_GOLD} || {SEP}, '' ORDER BY ord) AS text
  FROM (SELECT * FROM n WHERE ord % 2 = 1 ORDER BY md5(uuid || '$3'), uuid LIMIT 2))
SELECT * FROM (SELECT * FROM i ORDER BY part, ord LIMIT 1000)
UNION ALL SELECT '1', ord, (SELECT text FROM shots) || {question('default', 'choices')} || {SEP} FROM n WHERE ord % 2 = 0""")
