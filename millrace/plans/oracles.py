"""DuckDB SQL for the registered queries, written from the rules and not from the operators' code."""

from __future__ import annotations

from ..fixed import BOTS, CHATTER_PATTERN, CONCEPTS, EMPTY_BODIES, FAILURE_MODES, OTHER_FAILURE, PROMO_DECISION, PROMO_PATTERNS, SHORT_CONCEPTS, STOP_WORDS, SYSTEM_PROMPT
from ..functions.text import NO_SPACE, SPACE, WHITE
from .views import ASKED, BASE_RECORDS, COMPLETIONS, DECISIONS, ITEM_ROWS, ITEMS, ODD_LINES, RAW_LINES, RECORDS, SHAPES, SOUND_ITEMS, duck


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(WHITE)})"


def words(x: str) -> str:
    return f"[t for t in regexp_split_to_array({x}, '{SPACE}+') if t <> '']"


def norm(x: str) -> str:
    kept = r"[^\p{L}\p{N}_\-" + SPACE[1:]
    return strip(f"regexp_replace(regexp_replace(lower({x}), '{kept}', ' ', 'g'), '{SPACE}+', ' ', 'g')")


def listed(texts: list[str]) -> str:
    return "[" + ", ".join(map(q, texts)) + "]"


THINK = "'(?s)<think>(.*?)</think>'"
HAS = f"regexp_matches(text, {THINK})"
FIRST = f"regexp_extract(text, {THINK}, 1)"
REST = strip(f"regexp_replace(text, {THINK}, '', 'g')")

IS_BOT = f"(lower({strip('author')}) IN ({', '.join(map(q, BOTS))}) OR (lower({strip('author')}) LIKE '%bot' AND length({strip('author')}) > 3 AND author LIKE '%\\_%' ESCAPE '\\'))"
VALID = f"(length({strip('body')}) >= 15 AND lower({strip('body')}) NOT IN ({', '.join(map(q, EMPTY_BODIES))}))"

KEPT = f"""
records AS ({duck(BASE_RECORDS)}),
judged AS (
  SELECT *, CASE WHEN created_at < '2023-01-01' THEN 'pre_min_date' WHEN {IS_BOT} THEN 'bot' WHEN score < 0 THEN 'negative_score'
                 WHEN parent_id = '' AND length({strip('title')}) < 5 AND NOT {VALID} THEN 'invalid_body'
                 WHEN parent_id <> '' AND NOT {VALID} THEN 'invalid_body' ELSE 'kept' END AS reason
  FROM records
),
posts AS (SELECT * FROM judged WHERE reason = 'kept' AND parent_id = ''),
comments AS (
  SELECT c.*, p.author AS op, p.id AS thread_id FROM judged c JOIN posts p ON c.post_id = p.id WHERE c.reason = 'kept' AND c.parent_id <> ''
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY score DESC, created_at, ord) AS place FROM comments),
sizes AS (SELECT thread_id, count(*) AS n FROM comments GROUP BY thread_id),
best AS (
  SELECT p.id AS thread_id, coalesce(s.n, 0) AS comment_count, coalesce(r.id, '') AS best_answer_id, coalesce(r.author, '') AS best_answer_author,
         coalesce(r.score, 0) AS best_answer_score, coalesce({strip('r.body')}, '') AS best_answer_body
  FROM posts p LEFT JOIN sizes s ON p.id = s.thread_id LEFT JOIN ranked r ON p.id = r.thread_id AND r.place = 1
),
said AS (
  SELECT id AS thread_id, 0 AS later, '' AS created_at, -1 AS ord, 'user' AS role,
         CASE WHEN body <> '' AND body <> title THEN {strip("title || chr(10) || chr(10) || body")} ELSE {strip('title')} END AS text FROM posts
  UNION ALL
  SELECT thread_id, 1, created_at, ord, CASE WHEN author <> '[deleted]' AND author = op THEN 'user' ELSE 'assistant' END, {strip('body')} FROM comments
),
steps AS (
  SELECT *, CASE WHEN lag(role) OVER w <> role THEN 1 ELSE 0 END AS step FROM said WINDOW w AS (PARTITION BY thread_id ORDER BY later, created_at, ord)
),
placed AS (SELECT *, sum(step) OVER (PARTITION BY thread_id ORDER BY later, created_at, ord) AS turn FROM steps),
turns AS (
  SELECT thread_id, turn::BIGINT AS turn, role, string_agg(text, chr(10) || chr(10) ORDER BY later, created_at, ord) AS content FROM placed GROUP BY thread_id, turn, role
),
bodies AS (
  SELECT thread_id, string_agg(body, ' ' ORDER BY created_at, ord) AS bodies,
         string_agg('**[' || author || ']** *(Score: ' || score || ', ' || created_at || ')*:' || chr(10) || {strip('body')} || chr(10), chr(10) ORDER BY created_at, ord) AS blocks
  FROM comments GROUP BY thread_id
),
lengths AS (SELECT thread_id, count(*) AS conversation_turns FROM turns GROUP BY thread_id)
"""

FULL = "p.title || ' ' || p.body || ' ' || coalesce(b.bodies, '')"
HEAD = """'# ' || p.title || chr(10) || '**Author:** ' || p.author || ' | **Score:** ' || p.score || ' | **Date:** ' || p.created_at || chr(10) || chr(10)
  || CASE WHEN p.body = '' THEN '*(No body text)*' ELSE p.body END || chr(10) || chr(10) || '---' || chr(10) || '## Discussion & Solutions' || chr(10)"""

INNER = "|".join(p.removeprefix(r"\b").removesuffix(r"\b") for p in PROMO_PATTERNS).replace(r"\s", SPACE)
PROMO = rf"""(regexp_matches(' ' || both_ || ' ', '[^\p{{L}}\p{{N}}_]({INNER})[^\p{{L}}\p{{N}}_]')
  OR (regexp_matches(body_, '^https?://') AND len(words_) <= 10)
  OR (length(body_) < 100 AND regexp_matches(body_, 'https?://') AND len([w for w in words_ if w NOT LIKE 'http%']) < 6))"""

DECIDED = f"""
rows_ AS ({duck(DECISIONS)}),
shaped AS (SELECT *, {strip("lower(title || ' ' || post_body)")} AS both_, {strip('post_body')} AS body_, {words('post_body')} AS words_ FROM rows_),
marked AS (SELECT *, {PROMO} AS promo FROM shaped),
decided AS (
  SELECT thread_id, promo AS pre_filtered,
         CASE WHEN promo THEN {PROMO_DECISION[0]} ELSE round_even(noul, 4) END::DOUBLE AS is_rag_related,
         CASE WHEN promo THEN {PROMO_DECISION[1]} ELSE round_even(score, 4) END::DOUBLE AS technical_quality_score,
         CASE WHEN promo THEN {q(PROMO_DECISION[2])} ELSE choice END AS taxonomy_topic,
         CASE WHEN promo THEN {PROMO_DECISION[3]} ELSE round_even(confidence, 4) END::DOUBLE AS topic_confidence,
         NOT promo AND noul >= 0.6::DOUBLE AND score >= 0.6::DOUBLE AS curation_passed
  FROM marked
)
"""

SPLIT = """
hashed AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents),
split_ AS (
  SELECT doc_id, lang, CASE WHEN place <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN place <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM hashed
)
"""

TITLE, BODY = strip("title"), strip("post_body")
PROMPTED = f"""
rows_ AS ({duck(DECISIONS)}),
prompts AS (
  SELECT thread_id, {q(SYSTEM_PROMPT)} AS system,
         CASE WHEN {BODY} <> '' AND {BODY} <> {TITLE} THEN 'Title: ' || {TITLE} || chr(10) || chr(10) || 'Technical Question / Context:' || chr(10) || {BODY}
              ELSE 'Technical Question:' || chr(10) || {TITLE} END AS user,
         choice AS taxonomy_topic, best_answer_body AS reference_answer, title
  FROM rows_ WHERE length({strip("title || ' ' || post_body")}) >= 20
)
"""
CHATTER = CHATTER_PATTERN.replace(r"\b", "")
CLEAN = strip(
    f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(reference_answer, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), 'https?://{NO_SPACE}+', '', 'g'),
    '(?i)(^|[^\\p{{L}}\\p{{N}}_]){CHATTER}($|[^\\p{{L}}\\p{{N}}_\\n][^\\n]*)', '\\1', 'g'), '{SPACE}+', ' ', 'g')"""
)
SHORT = listed(list(dict.fromkeys(t for terms in SHORT_CONCEPTS.values() for t in terms)))
LOWERED = "regexp_replace(lower(title || ' ' || clean), '" + r"[^\p{L}\p{N}_\-" + SPACE[1:] + "', ' ', 'g')"
FAILURE = "CASE taxonomy_topic " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in FAILURE_MODES.items()) + f" ELSE {q(OTHER_FAILURE)} END"


def concept_sql(concepts: dict[str, list[str]]) -> str:
    every = listed(list(dict.fromkeys(t for terms in concepts.values() for t in terms)))
    own = "CASE topic " + " ".join(f"WHEN {q(k)} THEN {listed(v)}" for k, v in concepts.items()) + " ELSE [] END"
    hit = lambda terms, t: f"[x for x in {terms} if contains({t}, x) OR contains(replace({t}, '-', ' '), x)]"
    found, mine = hit(every, "body_"), hit(own, "body_")
    plan = f"CASE WHEN topic IS NULL OR topic = '' THEN {hit(every, 'think_')} ELSE {hit(own, 'think_')} END"
    return f"least(0.15::DOUBLE * CASE WHEN thinks THEN len({plan}) ELSE 0 END + 0.4::DOUBLE * len({mine}) + 0.2::DOUBLE * (len({found}) - len({mine})), 2.0::DOUBLE)"


def content(x: str) -> str:
    return f"list_distinct([t for t in {words(norm(x))} if t NOT IN ({', '.join(map(q, STOP_WORDS))}) AND length(t) > 2])"


def repetition_sql(limit: int | None, least: int) -> str:
    over = "0.0" if limit is None else f"CASE WHEN length(text) > {limit} THEN least(1.0, (length(text) - {limit}) / 1000.0::DOUBLE) ELSE 0.0 END"
    return f"""CASE WHEN length({strip('text')}) < {least} THEN -1.5::DOUBLE ELSE 0.0::DOUBLE - ({over})::DOUBLE - CASE WHEN ratio < 0.65::DOUBLE THEN (0.65::DOUBLE - ratio) * 2.0::DOUBLE ELSE 0.0::DOUBLE END
      - CASE WHEN regexp_matches(text, '(?i)https?://|www\\.') THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END
      - CASE WHEN regexp_matches(' ' || text || ' ', '(?i)[^\\p{{L}}\\p{{N}}_]{CHATTER}[^\\p{{L}}\\p{{N}}_]') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END END"""


ANSWERS = f"answers AS ({duck(COMPLETIONS)})"
VARIANTS = f"""
items AS (SELECT *, string_split(concepts, '|') AS expected FROM ({duck(ITEM_ROWS)}) r),
concepts_ AS (SELECT id, unnest(expected) AS concept, generate_subscripts(expected, 1) AS place FROM items),
pieces AS (SELECT *, regexp_split_to_array(concept, '{SPACE}*/{SPACE}*|{SPACE}+or{SPACE}+') AS parts FROM concepts_),
raw AS (
  SELECT id, concept, place, list_concat(parts, list_concat(flatten([regexp_extract_all(p, '\\(([^)]+)\\)', 1) for p in parts]), [regexp_replace(p, '\\([^)]*\\)', '', 'g') for p in parts])) AS texts FROM pieces
),
plain AS (SELECT id, concept, place, [{norm('t')} for t in texts] AS texts FROM raw),
variants AS (
  SELECT DISTINCT id, concept, place, unnest([v for v in list_concat(texts, list_concat([replace(t, '-', ' ') for t in texts], [replace(t, '-', '') for t in texts])) if length(v) >= 2]) AS v FROM plain
),
normal AS (SELECT id AS doc_id, item AS id, text, tokens, seconds, {norm('text')} AS n, replace({norm('text')}, '-', ' ') AS s FROM answers)
"""
LOOSE = "CASE WHEN length(v) < 4 AND NOT contains(v, ' ') THEN contains(' ' || s || ' ', ' ' || v || ' ') ELSE contains(n, v) OR contains(s, v) END"
STRICT = "contains(' ' || n || ' ', ' ' || v || ' ') OR contains(' ' || s || ' ', ' ' || v || ' ')"


def covered(match: str, name: str = "covered") -> str:
    return f"""
{name}_hits AS (SELECT doc_id, a.id, concept, place, bool_or({match}) AS hit FROM normal a JOIN variants USING (id) GROUP BY ALL),
{name}_sums AS (
  SELECT doc_id, id, count(*) FILTER (hit) / count(*)::DOUBLE AS recall, coalesce(string_agg(concept, '|' ORDER BY place) FILTER (hit), '') AS matched,
         coalesce(string_agg(concept, '|' ORDER BY place) FILTER (NOT hit), '') AS missing
  FROM {name}_hits GROUP BY doc_id, id
),
{name} AS (SELECT c.*, n.text, n.tokens, n.seconds, i.category, i.difficulty FROM {name}_sums c JOIN normal n USING (doc_id, id) JOIN items i USING (id))
"""


ROLLUP = """
SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS level,
       coalesce(category, difficulty, 'all') AS name, count(*) AS questions, avg(recall) AS avg_recall, sum(tokens)::BIGINT AS total_tokens,
       sum(tokens)::DOUBLE / sum(seconds) AS tokens_per_second
FROM covered GROUP BY GROUPING SETS ((), (category), (difficulty))
"""
LOOSELY = f"WITH {ANSWERS}, {VARIANTS}, {covered(LOOSE)}"
STRICTLY = f"WITH {ANSWERS}, {VARIANTS}, {covered(STRICT)}"

FORMAT = f"""
CASE WHEN contains(text, '<think>') AND contains(text, '</think>') THEN
       CASE WHEN NOT {HAS} THEN 0.0 WHEN length({strip(FIRST)}) >= 50 AND length({REST}) >= 30 THEN CASE WHEN contains(text, '<answer>') AND contains(text, '</answer>') THEN 1.0 ELSE 0.8 END
            WHEN length({strip(FIRST)}) >= 50 THEN 0.5 ELSE 0.0 END
     WHEN contains(text, '<think>') OR contains(text, '</think>') THEN -0.5 ELSE -1.0 END::DOUBLE"""
NOTEBOOK_FORMAT = f"""
CASE WHEN contains(text, '<think>') AND contains(text, '</think>') THEN
       CASE WHEN {HAS} AND length({strip(FIRST)}) >= 50 THEN CASE WHEN contains(text, '<answer>') AND contains(text, '</answer>') THEN 1.0 ELSE 0.8 END ELSE 0.4 END
     WHEN contains(text, '<think>') OR contains(text, '</think>') THEN -0.5 ELSE -1.0 END::DOUBLE"""



def member(name: str) -> str:
    """A member as text, null where it is absent, null, empty, zero or false."""
    return f"""CASE WHEN json_type(v -> '$.{name}') IS NULL OR json_type(v -> '$.{name}') = 'NULL' OR (v ->> '$.{name}') = ''
      OR (json_type(v -> '$.{name}') <> 'VARCHAR' AND (v ->> '$.{name}') IN ('0', '0.0', 'false', '[]', '{{}}')) THEN NULL ELSE v ->> '$.{name}' END"""


def stripped(*names: str) -> str:
    return strip(f"coalesce({', '.join(member(n) for n in names)}, '')")


NORMAL = f"""
lines AS (SELECT src, ord, TRY_CAST({strip('line')} AS JSON) AS j FROM ({duck(RAW_LINES)}) r WHERE {strip('line')} <> ''),
opened AS (SELECT src, ord, CASE WHEN json_type(j) <> 'OBJECT' THEN NULL WHEN json_type(j -> '$.data') = 'OBJECT' THEN j -> '$.data' ELSE j END AS v FROM lines),
members AS (
  SELECT src, ord, v, {stripped('id')} AS id, {stripped('link_id')} AS link, {stripped('parent_id')} AS parent, {strip(f"coalesce({member('author')}, '[deleted]')")} AS author,
         lower({strip(f"coalesce({member('subreddit')}, {member('community')}, 'rag')")}) AS community, TRY_CAST(coalesce({member('created_utc')}, {member('created')}) AS DOUBLE) AS seconds,
         {stripped('title')} AS title, {stripped('selftext', 'body')} AS post_body, {stripped('body')} AS comment_body, json_type(v -> '$.score') AS kind, v ->> '$.score' AS score_
  FROM opened
),
normal AS (
  SELECT src, ord, coalesce(id, '') = '' AS malformed, 'community_forum' AS source, community, id, CASE WHEN src = 1 THEN parent ELSE '' END AS parent_id,
         CASE WHEN src = 0 THEN id WHEN link LIKE 't3\\_%' ESCAPE '\\' THEN substr(link, 4) WHEN parent LIKE 't3\\_%' ESCAPE '\\' THEN substr(parent, 4) WHEN link <> '' THEN link ELSE parent END AS post_id,
         author, CASE WHEN seconds BETWEEN 946684800 AND 4102444800 THEN strftime(make_timestamp(CAST(floor(seconds) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S')
                      || CASE WHEN seconds > floor(seconds) THEN '.' || lpad(CAST(CAST(round((seconds - floor(seconds)) * 1000000) AS BIGINT) AS VARCHAR), 6, '0') ELSE '' END || '+00:00' ELSE '' END AS created_at,
         CASE WHEN src = 0 THEN title ELSE '' END AS title, CASE WHEN src = 0 THEN post_body ELSE comment_body END AS body,
         CASE WHEN kind = 'VARCHAR' THEN CASE WHEN regexp_matches(score_, '^[+-]?[0-9]+$') THEN TRY_CAST(score_ AS BIGINT) ELSE 0 END WHEN kind = 'BOOLEAN' THEN CAST(score_ = 'true' AS BIGINT)
              WHEN kind = 'NULL' OR kind IS NULL THEN 0 ELSE CAST(trunc(TRY_CAST(score_ AS DOUBLE)) AS BIGINT) END::BIGINT AS score
  FROM members
)
"""
FIELDS = "source, community, id, parent_id, post_id, author, created_at, title, body, score, ord"

FIRSTS = f"firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, ord) AS rn FROM ({duck(RECORDS)}) r) x WHERE rn = 1)"
RECORD_COLUMNS = "source, community, id, parent_id, post_id, author, created_at, title, body, score, src, ord"

LEAKED = f"""
rows_ AS ({duck(ASKED)}), asked_ AS (SELECT DISTINCT {norm('question')} AS q_ FROM ({duck(ITEMS)}) i WHERE {norm('question')} <> ''),
marked_ AS (SELECT *, coalesce({norm('title')} IN (SELECT q_ FROM asked_), false) OR coalesce({norm('post_body')} IN (SELECT q_ FROM asked_), false) AS leaked FROM rows_)
"""

ORACLES = {
    "ingest_normalize_posts": f"WITH {NORMAL} SELECT {FIELDS} FROM normal WHERE src = 0 AND NOT malformed",
    "ingest_normalize_comments": f"WITH {NORMAL} SELECT {FIELDS} FROM normal WHERE src = 1 AND NOT malformed",
    "ingest_malformed": f"WITH {NORMAL} SELECT src, count(*) FILTER (malformed) AS malformed, count(*) FILTER (NOT malformed) AS well_formed FROM normal GROUP BY src",
    "ingest_distinct_ids": f"WITH {NORMAL} SELECT id, src, ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, ord) AS rn FROM normal WHERE NOT malformed) x WHERE rn = 1",
    "ingest_dedup_first": f"WITH {FIRSTS} SELECT {RECORD_COLUMNS} FROM firsts",
    "ingest_health": f"""WITH {FIRSTS}
SELECT count(*) AS total_records, count(*) FILTER (src = 0) AS posts, count(*) FILTER (src = 1) AS comments,
       count(*) FILTER (author = '[deleted]' OR body IN ('[deleted]', '[removed]')) AS deleted,
       count(*) FILTER (src = 0 AND title = '' AND body = '') AS empty_posts, count(*) FILTER (src = 1 AND body = '') AS empty_comments,
       min(nullif(created_at, '')) AS min_date, max(nullif(created_at, '')) AS max_date
FROM firsts""",
    "reject_reasons": f"WITH {KEPT} SELECT reason, count(*) AS n FROM judged GROUP BY reason",
    "thread_best_answer": f"WITH {KEPT} SELECT * FROM best",
    "thread_rows": f"""WITH {KEPT}
SELECT p.id AS thread_id, p.community, p.title, p.author AS post_author, p.created_at AS post_created_at, p.score AS post_score, p.body AS post_body,
       comment_count, best_answer_id, best_answer_author, best_answer_score, best_answer_body, conversation_turns,
       len({words(FULL)}) AS total_word_count, length({FULL}) AS total_char_count
FROM posts p JOIN best ON best.thread_id = p.id JOIN lengths l ON l.thread_id = p.id LEFT JOIN bodies b ON b.thread_id = p.id""",
    "thread_transcript": f"WITH {KEPT} SELECT p.id AS thread_id, {HEAD} || coalesce(chr(10) || b.blocks, '') AS discussion_transcript FROM posts p LEFT JOIN bodies b ON b.thread_id = p.id",
    "thread_conversation": f"""WITH {KEPT}
SELECT thread_id, '[' || string_agg('{{"role": "' || role || '", "content": ' || to_json(content)::VARCHAR || '}}', ', ' ORDER BY turn) || ']' AS conversation_json
FROM turns GROUP BY thread_id""",
    "thread_report": f"""WITH {KEPT}
SELECT count(*) AS total_cleaned_threads, count(*) FILTER (comment_count > 0) AS threads_with_comments, count(*) FILTER (comment_count = 0) AS standalone_posts,
       coalesce(avg(comment_count), 0) AS avg_comments_per_thread, coalesce(avg(conversation_turns), 0) AS avg_turns_per_conversation
FROM best JOIN lengths USING (thread_id)""",
    "conversation_turns": f"WITH {KEPT} SELECT * FROM turns",
    "promo_filter": f"WITH {DECIDED} SELECT thread_id, promo FROM marked",
    "curation_decisions": f"WITH {DECIDED} SELECT * FROM decided",
    "curation_report": f"""WITH {DECIDED}
SELECT count(*) AS total_evaluated, count(*) FILTER (pre_filtered) AS pre_filtered_promos, count(*) FILTER (curation_passed) AS curated_passed,
       count(*) FILTER (NOT curation_passed) AS curated_rejected, 100.0::DOUBLE * count(*) FILTER (curation_passed) / count(*) AS pass_rate_pct
FROM decided""",
    "taxonomy_distribution": f"WITH {DECIDED} SELECT taxonomy_topic, count(*) AS n FROM decided WHERE NOT pre_filtered GROUP BY taxonomy_topic",
    "model_states": f"""WITH rows_ AS ({duck(DECISIONS)})
SELECT thread_id, {TITLE} AS title, nullif(substring({BODY}, 1, 600), '') AS post_body, nullif(substring({strip('best_answer_body')}, 1, 600), '') AS best_answer FROM rows_""",
    "notebook_states": f"""WITH rows_ AS ({duck(DECISIONS)})
SELECT thread_id, title, nullif(substring(post_body, 1, 600), '') AS post_body, nullif(substring({strip('best_answer_body')}, 1, 600), '') AS best_answer FROM rows_""",
    "audit_rows": f"""WITH {DECIDED}
SELECT thread_id, title, taxonomy_topic, translate(substring(post_body, 1, 140), chr(10), ' ') AS post, translate(substring(best_answer_body, 1, 140), chr(10), ' ') AS answer
FROM decided JOIN rows_ USING (thread_id) WHERE curation_passed ORDER BY thread_id LIMIT 20""",
    "scored_by_plugin": f"""WITH {DECIDED}, asked AS (
  SELECT thread_id, promo, length(substring({BODY}, 1, 600)) % 100 / 100.0::DOUBLE AS noul, (length({TITLE}) % 3)::DOUBLE AS score FROM marked
)
SELECT thread_id, CASE WHEN promo THEN {PROMO_DECISION[0]} ELSE noul END::DOUBLE AS is_rag_related, CASE WHEN promo THEN {PROMO_DECISION[1]} ELSE score END::DOUBLE AS technical_quality_score,
       CASE WHEN promo THEN {q(PROMO_DECISION[2])} ELSE 'retrieval' END AS taxonomy_topic, NOT promo AND noul >= 0.6::DOUBLE AND score >= 0.6::DOUBLE AS curation_passed
FROM asked""",
    "split_by_language": f"WITH {SPLIT} SELECT * FROM split_",
    "split_distribution": f"WITH {SPLIT} SELECT split, lang, count(*) AS n FROM split_ GROUP BY split, lang",
    "split_leakage": f"WITH {SPLIT} SELECT count(*) AS shared_ids FROM (SELECT doc_id FROM split_ GROUP BY doc_id HAVING count(DISTINCT split) > 1) x",
    "rl_prompts": f"WITH {PROMPTED} SELECT * FROM prompts",
    "sft_records": f"""WITH {PROMPTED}, cleaned AS (SELECT *, {CLEAN} AS clean FROM prompts WHERE length(reference_answer) >= 150),
found AS (SELECT *, [x for x in {SHORT} if contains({LOWERED}, x)][1:3] AS top FROM cleaned WHERE length(clean) >= 100)
SELECT thread_id, user,
       '<think>' || chr(10) || '1. Problem Analysis: The question asks about ' || taxonomy_topic || ' regarding "' || title || '".' || chr(10)
       || '2. Diagnostic Mechanism: Key vulnerability to consider is ' || {FAILURE} || '.' || chr(10)
       || CASE WHEN len(top) > 0 THEN '3. Target Architectural Components: Evaluated mechanisms include ' || array_to_string(top, ', ') || '.'
               ELSE '3. Solution Strategy: Formulate grounded engineering principles for ' || taxonomy_topic || '.' END || chr(10)
       || '4. Verified Resolution: Structure definitive technical guidance with explicit operational steps.' || chr(10) || '</think>' || chr(10)
       || '<answer>' || chr(10) || clean || chr(10) || '</answer>' AS assistant
FROM found""",
    "sft_first": None,
    "sft_text": None,
    "reasoning_traces": f"""WITH {ANSWERS}
SELECT id, CASE WHEN {HAS} THEN {strip(FIRST)} END AS trace, CASE WHEN {HAS} THEN {REST} ELSE {strip('text')} END AS answer,
       CASE WHEN NOT (contains(text, '<think>') AND contains(text, '</think>')) THEN text
            WHEN regexp_matches(text, '(?s)<answer>.*?</answer>') THEN {strip("regexp_extract(text, '(?s)<answer>(.*?)</answer>', 1)")}
            ELSE {strip("string_split(text, '</think>')[-1]")} END AS tagged
FROM answers""",
    "reward_format": f"WITH {ANSWERS} SELECT id, {FORMAT} AS reward, {NOTEBOOK_FORMAT} AS notebook_reward FROM answers",
    "reward_concepts": f"""WITH {ANSWERS}, normal AS (SELECT id, topic, {HAS} AS thinks, {norm('text')} AS body_, {norm(FIRST)} AS think_ FROM answers)
SELECT id, {concept_sql(CONCEPTS)} AS reward, {concept_sql(SHORT_CONCEPTS)} AS notebook_reward FROM normal""",
    "reward_grounding": f"""WITH {ANSWERS}, sets AS (SELECT id, reference, {content('text')} AS c, {content("coalesce(reference, '')")} AS r FROM answers),
sized AS (SELECT id, reference, len(c) AS nc, len(r) AS nr, len(list_intersect(c, r))::DOUBLE AS both_ FROM sets)
SELECT id, CASE WHEN reference IS NULL OR reference = '' OR nr = 0 THEN 0.5::DOUBLE
                ELSE least(0.5::DOUBLE * CASE WHEN nc > 0 THEN both_ / (nc + nr - both_) ELSE 0.0::DOUBLE END + 0.5::DOUBLE * least(both_ / nr * 1.5::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE) END AS reward
FROM sized""",
    "reward_repetition": f"""WITH {ANSWERS}, split_ AS (SELECT id, text, {words('lower(text)')} AS w FROM answers),
grams AS (SELECT id, text, CASE WHEN len(w) >= 16 THEN [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] END AS g FROM split_),
ratios AS (SELECT id, text, CASE WHEN g IS NULL THEN 1.0::DOUBLE ELSE len(list_distinct(g)) / len(g)::DOUBLE END AS ratio FROM grams)
SELECT id, {repetition_sql(3500, 40)} AS reward, {repetition_sql(None, 30)} AS notebook_reward FROM ratios""",
    "concept_coverage": f"{LOOSELY} SELECT doc_id, id, matched, missing, recall FROM covered",
    "strict_coverage": f"{STRICTLY} SELECT doc_id, id, recall FROM covered",
    "question_rows": f"""{LOOSELY}
SELECT doc_id, {HAS} AS has_thinking_trace, CASE WHEN {HAS} THEN length({strip(FIRST)}) ELSE 0 END AS thinking_length_chars,
       length(CASE WHEN {HAS} THEN {REST} ELSE {strip('text')} END) AS answer_length_chars, tokens::DOUBLE / seconds AS tokens_per_second
FROM covered""",
    "eval_rollup": f"{LOOSELY} {ROLLUP}",
    "eval_categories": f"{LOOSELY} SELECT category, 100 * avg(recall) AS recall_pct FROM covered GROUP BY category",
    "eval_answers": f"""{STRICTLY}
SELECT doc_id, id, CASE WHEN {HAS} THEN {strip(FIRST)} ELSE '' END AS thinking_trace, recall,
       CASE WHEN NOT (contains(text, '<think>') AND contains(text, '</think>')) THEN text
            WHEN regexp_matches(text, '(?s)<answer>.*?</answer>') THEN {strip("regexp_extract(text, '(?s)<answer>(.*?)</answer>', 1)")}
            ELSE {strip("string_split(text, '</think>')[-1]")} END AS final_answer
FROM covered""",
    "eval_compare": f"""{LOOSELY}, {covered(STRICT, 'strictly')}
SELECT category, left_pct, coalesce(right_pct, 0.0::DOUBLE) AS right_pct
FROM (SELECT category, 100 * avg(recall) AS left_pct FROM covered GROUP BY category) a
LEFT JOIN (SELECT category, 100 * avg(recall) AS right_pct FROM strictly WHERE category <> 'retrieval' GROUP BY category) b USING (category)""",
    "trained_report": f"""{STRICTLY}
SELECT 100 * avg(recall) AS recall_pct, 100 * avg(recall) - 23.08::DOUBLE AS delta_pct,
       100 * avg((contains(text, '<think>') AND contains(text, '</think>'))::INT) AS thinking_trace_pct
FROM covered""",
    "benchmark_metadata": f"""WITH items AS ({duck(ITEMS)})
SELECT 'category' AS field, category AS value, count(*) AS n FROM items GROUP BY category
UNION ALL SELECT 'difficulty', difficulty, count(*) FROM items GROUP BY difficulty
UNION ALL SELECT 'test_type', test_type, count(*) FROM items GROUP BY test_type""",
    "benchmark_faults": f"""WITH items AS ({duck(ITEMS)})
SELECT count(*) - count(DISTINCT id) AS repeated_ids, count(*) FILTER (category = '' OR difficulty = '' OR test_type = '') AS blank_labels,
       count(*) FILTER (length({strip('question')}) < 21) AS short_questions, count(*) FILTER (len(string_split(concepts, '|')) < 3) AS few_concepts,
       count(*) FILTER (length({strip('reasoning')}) < 51) AS short_reasoning, count(*) FILTER (coalesce(correctness, '') = '' OR coalesce(grounding, '') = '' OR coalesce(tradeoffs, '') = '') AS blank_rubrics,
       6 - count(DISTINCT category) FILTER (category IN ({', '.join(map(q, CONCEPTS))})) AS missing_categories, count(*) FILTER (category NOT IN ({', '.join(map(q, CONCEPTS))})) AS foreign_categories,
       greatest(10 - count(*), 0) AS missing_items
FROM items""",
    "ingest_strict": f"""WITH lines AS ({duck(ODD_LINES)}), judged AS (
  SELECT ord, k, ord // 1000 AS conv, k % 12 IN (0, 6, 7, 8, 11) AS malformed FROM lines
)
SELECT ord, CASE WHEN malformed THEN NULL WHEN k % 12 = 3 THEN concat(conv + 1, '.0') WHEN k % 12 = 9 THEN 'True' ELSE concat('c', conv) END AS id,
       CASE WHEN malformed THEN NULL ELSE CASE k % 12 WHEN 1 THEN 7 WHEN 3 THEN -3 WHEN 5 THEN 5 WHEN 9 THEN 1 ELSE 0 END END::BIGINT AS score, malformed
FROM judged""",
    "completion_texts": f"""WITH shapes AS ({duck(SHAPES)}), said AS (
  SELECT id, shape, CASE shape WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN 'why' || chr(10) || text WHEN 3 THEN text || chr(10) || 'tail' || chr(10) || 'end'
    WHEN 5 THEN chr(10) || id || chr(10) || 'True' || chr(10) || 'None' || chr(10) || text WHEN 6 THEN 'None' ELSE '' END AS text FROM shapes
)
SELECT id, shape, text, CASE WHEN contains(text, '<think>') OR contains(text, '</think>') THEN NULL ELSE -1.0::DOUBLE END AS reward FROM said""",
    "benchmark_leaks": f"""WITH {LEAKED} , cut AS (
  SELECT *, row_number() OVER (PARTITION BY taxonomy_topic ORDER BY md5('42|' || thread_id), thread_id) AS place, count(*) OVER (PARTITION BY taxonomy_topic) AS size FROM marked_
)
SELECT CASE WHEN place <= floor(size * 0.8::DOUBLE) THEN 'train' WHEN place <= floor(size * 0.8::DOUBLE) + floor(size * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(*) FILTER (leaked) AS leaks
FROM cut GROUP BY 1""",
    "isolated_threads": f"WITH {LEAKED} SELECT thread_id, title FROM marked_ WHERE NOT leaked",
}
ORACLES |= {
    "stage_ingest": f"""WITH {NORMAL}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, ord) AS rn FROM normal WHERE NOT malformed) x WHERE rn = 1)
SELECT count(*) AS rows, count(*) AS total_records, count(*) FILTER (src = 0) AS posts, count(*) FILTER (src = 1) AS comments,
       count(*) FILTER (author = '[deleted]' OR body IN ('[deleted]', '[removed]')) AS deleted, count(*) FILTER (body = '' AND (src = 1 OR title = '')) AS empty,
       (SELECT count(*) FROM normal WHERE malformed) AS malformed, (SELECT count(*) FROM normal WHERE NOT malformed) - count(*) AS duplicate_ids,
       min(nullif(created_at, '')) AS min_date, max(nullif(created_at, '')) AS max_date FROM firsts""",
    "stage_clean": f"""WITH {KEPT}, reasons AS (
  SELECT count(*) AS total_input_records, count(*) FILTER (reason = 'pre_min_date') AS filtered_pre_min_date, count(*) FILTER (reason = 'bot') AS filtered_bots,
         count(*) FILTER (reason = 'negative_score') AS filtered_negative_score, count(*) FILTER (reason = 'invalid_body') AS filtered_invalid_body FROM judged
), told AS (
  SELECT count(*) AS rows, count(*) AS total_cleaned_threads, count(*) FILTER (comment_count > 0) AS threads_with_comments, count(*) FILTER (comment_count = 0) AS standalone_posts,
         round_even(avg(comment_count), 2) AS avg_comments_per_thread, round_even(avg(conversation_turns), 2) AS avg_turns_per_conversation FROM best JOIN lengths USING (thread_id)
)
SELECT * FROM reasons, told""",
    "stage_curate": f"SELECT thread_id, CASE WHEN curation_passed THEN 'passed' ELSE 'rejected' END AS found_in, curation_passed, taxonomy_topic FROM ({ORACLES['scored_by_plugin']}) s",
    "stage_partition": f"""WITH {LEAKED}, cut AS (
  SELECT thread_id, row_number() OVER (PARTITION BY taxonomy_topic ORDER BY md5('42|' || thread_id), thread_id) AS place, count(*) OVER (PARTITION BY taxonomy_topic) AS size FROM marked_ WHERE NOT leaked
)
SELECT thread_id, CASE WHEN place <= floor(size * 0.8::DOUBLE) THEN 'train' WHEN place <= floor(size * 0.8::DOUBLE) + floor(size * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM cut""",
    "stage_prepare": f"""WITH {PROMPTED}
SELECT CASE WHEN noul < 0.9::DOUBLE THEN 'train' ELSE 'val' END AS part, thread_id, p.title, reference_answer, taxonomy_topic, p.user, 2 AS messages FROM prompts p JOIN rows_ USING (thread_id)""",
    "stage_benchmark": f"""WITH items AS ({duck(SOUND_ITEMS)}), counted AS (
  SELECT 'category' AS field, category AS value, count(*) AS n FROM items GROUP BY category
  UNION ALL SELECT 'difficulty', difficulty, count(*) FROM items GROUP BY difficulty UNION ALL SELECT 'test_type', test_type, count(*) FROM items GROUP BY test_type
)
SELECT field, value, n, n AS reported FROM counted""",
    "stage_evaluate": f"""{LOOSELY}, rounded AS (SELECT category, difficulty, round_even(recall, 4) AS recall FROM covered)
SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS level, coalesce(category, difficulty, 'all') AS name,
       round_even(avg(recall), 4) AS recall, (SELECT count(*) FROM covered) AS result_rows FROM rounded GROUP BY GROUPING SETS ((), (category), (difficulty))""",
}
SFT = ORACLES["sft_records"]
#: The first long answers are taken before their cleaned text is judged; the template wraps the three messages.
ORACLES["sft_first"] = "SELECT thread_id, assistant FROM (" + SFT.replace("WHERE length(reference_answer) >= 150)", "WHERE length(reference_answer) >= 150 ORDER BY thread_id LIMIT 150)") + ") t"
ORACLES["sft_text"] = f"""SELECT thread_id, '<|system|>' || chr(10) || {q(SYSTEM_PROMPT)} || chr(10) || '<|user|>' || chr(10) || "user" || chr(10) || '<|assistant|>' || chr(10) || assistant || chr(10) AS text FROM ({SFT}) t"""
ORACLES["reward_composite"] = "SELECT id, f.reward AS reward_format, c.reward AS reward_concepts, g.reward AS reward_grounding, r.reward AS reward_repetition FROM " + " JOIN ".join(
    f"({ORACLES[k]}) {a}" + (" USING (id)" if n else "") for n, (k, a) in enumerate([("reward_format", "f"), ("reward_concepts", "c"), ("reward_grounding", "g"), ("reward_repetition", "r")])
)
