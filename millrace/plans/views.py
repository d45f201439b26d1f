"""Derived inputs in SQL that Spark and DuckDB both take: forum records, model answers and decisions made from the shared tables by integer rules.

`{name}` stands for a table; Spark fills in a DataFrame, DuckDB the table's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Conversations as a forum: posts, comments, orphans, bots, deleted authors and bodies, old rows, short titles, standalone posts.
BASE_RECORDS = """
SELECT 'community_forum' AS source, 'rag' AS community,
       concat('c', conv_id, '_', turn) AS id,
       CASE WHEN turn = 0 THEN '' ELSE concat('t3_c', conv_id, '_0') END AS parent_id,
       CASE WHEN turn > 0 AND (conv_id * 7 + turn) % 53 = 5 THEN 'gone' ELSE concat('c', conv_id, '_0') END AS post_id,
       CASE WHEN role = 'system' OR (conv_id * 5 + turn) % 41 = 7 THEN 'helper_bot'
            WHEN turn = 0 OR (conv_id + turn) % 3 = 0 THEN concat('op_', conv_id)
            WHEN (conv_id + turn) % 7 = 1 THEN '[deleted]'
            ELSE concat('user_', (conv_id * 13 + turn) % 50) END AS author,
       CASE WHEN conv_id % 11 = 3 THEN '2022-06-01T00:00:00+00:00'
            ELSE concat('2024-01-', lpad(concat('', 1 + conv_id % 28), 2, '0'), 'T', lpad(concat('', (turn * 5) % 7), 2, '0'), ':00:00+00:00') END AS created_at,
       CASE WHEN turn > 0 THEN '' WHEN conv_id % 13 = 5 THEN ' Hm ' ELSE concat('Question ', conv_id, ' on "chunking"') END AS title,
       CASE WHEN (conv_id * 3 + turn) % 17 = 4 THEN '[removed]' WHEN (conv_id * 3 + turn) % 17 = 9 THEN '' ELSE text END AS body,
       CAST((conv_id * 31 + turn * 17) % 40 - 5 AS BIGINT) AS score,
       CASE WHEN turn = 0 THEN 0 ELSE 1 END AS src,
       CAST(conv_id * 1000 + turn * 2 AS BIGINT) AS ord
FROM {conversations}
WHERE NOT (conv_id % 5 = 4 AND turn > 0)
"""

#: The same with a slice of later lines that repeat an id.
RECORDS = f"""
WITH base AS ({BASE_RECORDS})
SELECT * FROM base
UNION ALL
SELECT source, community, id, parent_id, post_id, author, created_at, concat(title, ' again'), concat(body, ' again'), score + 1, src, ord + 1
FROM base WHERE ord % 9 = 2
"""

#: Conversations as raw lines of JSON: envelopes, aliases, cut and foreign lines, blank ones, numbers as text, times of every kind.
RAW_LINES = """
WITH escaped AS (
  SELECT conv_id, turn, conv_id * 7 + turn AS k,
         replace(replace(replace(replace(coalesce(text, ''), chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), chr(9), concat(chr(92), 't')) AS body
  FROM {conversations}
),
objects AS (
  SELECT conv_id, turn, k, concat(chr(123), '"',
    CASE k % 29 WHEN 3 THEN 'id": null, "' WHEN 8 THEN '' WHEN 11 THEN concat('id": ', 100000 + k, ', "') ELSE concat('id": " c', conv_id, '_', turn, ' ", "') END,
    CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'author": null, "' WHEN 2 THEN 'author": "", "' ELSE concat('author": " user_', k % 50, ' ", "') END,
    CASE k % 5 WHEN 0 THEN 'subreddit": "RAG ", "' WHEN 1 THEN 'community": "LocalModels", "' ELSE '' END,
    CASE k % 6 WHEN 0 THEN 'created_utc": 1704067200.5, "' WHEN 1 THEN concat('created_utc": "', 1704067200 + k, '", "') WHEN 2 THEN concat('created": ', 1704067200 + k * 60, ', "')
               WHEN 3 THEN 'created_utc": 12, "' WHEN 4 THEN 'created_utc": "soon", "' ELSE 'created_utc": 0, "created": 1706659200, "' END,
    CASE k % 8 WHEN 0 THEN 'score": "12", "' WHEN 1 THEN 'score": 3.7, "' WHEN 2 THEN 'score": "4.5", "' WHEN 3 THEN 'score": null, "' WHEN 4 THEN 'score": true, "'
               WHEN 5 THEN '' WHEN 6 THEN 'score": -3, "' ELSE concat('score": ', k, ', "') END,
    CASE k % 4 WHEN 0 THEN concat('link_id": "t3_c', conv_id, '_0", "parent_id": "t1_x", "') WHEN 1 THEN concat('parent_id": "t3_c', conv_id, '_0", "')
               WHEN 2 THEN 'link_id": "abc", "' ELSE 'parent_id": " t1_z", "' END,
    concat('title": " Turn ', turn, ' of ', conv_id, '", "'),
    CASE k % 3 WHEN 0 THEN 'selftext": "' ELSE 'body": "' END, body, '"', chr(125)) AS line
  FROM escaped
)
SELECT CASE WHEN turn = 0 THEN 0 ELSE 1 END AS src, CAST(conv_id * 1000 + turn AS BIGINT) AS ord,
       CASE k % 23 WHEN 4 THEN substr(line, 1, length(line) - 5) WHEN 9 THEN concat('[', line, ']') WHEN 14 THEN concat(chr(123), '"kind": "t1", "data": ', line, chr(125))
                   WHEN 17 THEN '   ' WHEN 19 THEN concat('  ', line, ' ') ELSE line END AS line
FROM objects
"""

#: Documents as completions with reasoning tags, answers, links, chatter and loops; topics and references to score against.
COMPLETIONS = """
SELECT doc_id AS id,
       CASE doc_id % 9
            WHEN 0 THEN concat('<think>', text, '</think> <answer>Use Hybrid-Search with a cross-encoder, chunk overlap and context recall.</answer>')
            WHEN 1 THEN concat('<think>First plan graph-rag and BM25, then rerank with a reranker for mrr.</think>', text)
            WHEN 2 THEN concat('<think>', text)
            WHEN 3 THEN concat(text, ' See https://example.org/x, hope this helps')
            WHEN 4 THEN concat('<think>short</think>', text)
            WHEN 5 THEN concat('<think>', text, '</think> ok')
            WHEN 6 THEN repeat('try the knowledge graph first ', 12)
            WHEN 7 THEN concat('</think>', text, '<think>')
            ELSE text END AS text,
       CASE doc_id % 8 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'chunking_and_indexing' WHEN 2 THEN 'generation_and_grounding'
            WHEN 3 THEN 'evaluation_and_benchmarks' WHEN 4 THEN 'agentic_and_graph_rag' WHEN 5 THEN 'tooling_and_frameworks'
            WHEN 6 THEN 'unknown' END AS topic,
       CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'is it the one' ELSE replace(text, 'on', 'an') END AS reference,
       CAST(doc_id % 500 + 1 AS BIGINT) AS tokens,
       CAST(doc_id % 17 AS DOUBLE) + 0.5 AS seconds,
       concat('q', doc_id % 40) AS item
FROM {documents}
"""

#: Documents and labels as threads with a model's recorded answers.
DECISIONS = """
SELECT concat('t', d.doc_id) AS thread_id,
       CASE WHEN d.doc_id % 29 = 0 THEN 'Join  our Discord server' WHEN d.doc_id % 37 = 0 THEN 'rebuild telegrams' ELSE concat('On ', d.source) END AS title,
       CASE WHEN d.doc_id % 31 = 0 THEN concat('https://example.org/', d.doc_id, ' look at this')
            WHEN d.doc_id % 23 = 0 THEN 'a link: http://example.org/y and four plain words'
            ELSE d.text END AS post_body,
       CASE WHEN d.doc_id % 3 = 0 THEN concat('See [the page](http://example.org/z) at https://example.org/q : ', d.text, ' Cheers, all') ELSE d.text END AS best_answer_body,
       CAST((d.doc_id * 37) % 100 AS DOUBLE) / 100 AS noul,
       CAST(coalesce(l.quality, 0) * 2 AS DOUBLE) / 3 + 0.1 AS score,
       CASE d.doc_id % 6 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'chunking_and_indexing' WHEN 2 THEN 'generation_and_grounding'
            WHEN 3 THEN 'evaluation_and_benchmarks' WHEN 4 THEN 'agentic_and_graph_rag' ELSE 'tooling_and_frameworks' END AS choice,
       CAST(d.doc_id % 10 AS DOUBLE) / 10 AS confidence
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

#: Benchmark items with concepts that occur in the prose.
ITEMS = """
SELECT concat('q', item_id % 40) AS id, text AS question,
       CASE item_id % 6 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'chunking_and_indexing' WHEN 2 THEN 'generation_and_grounding'
            WHEN 3 THEN 'evaluation_and_benchmarks' WHEN 4 THEN 'agentic_and_graph_rag' ELSE 'tooling_and_frameworks' END AS category,
       CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
       CASE item_id % 2 WHEN 0 THEN 'conceptual' ELSE 'practical' END AS test_type,
       CASE item_id % 4 WHEN 0 THEN 'the and|Thou-gh / onre or erea|Une (LA)'
            WHEN 1 THEN 'with by|of the|hybrid-search'
            WHEN 2 THEN 'Der Die / und|for (in)|knowledge graph'
            ELSE 'que|thatre or de la|ed' END AS concepts,
       CASE WHEN item_id % 7 = 3 THEN 'too short' ELSE text END AS reasoning,
       CASE WHEN item_id % 5 = 2 THEN NULL ELSE 'right' END AS correctness, 'sourced' AS grounding, CASE WHEN item_id % 11 = 4 THEN '' ELSE 'weighed' END AS tradeoffs
FROM {benchmark}
"""
#: Items in one row per id.
ITEM_ROWS = f"SELECT id, min(question) AS question, min(category) AS category, min(difficulty) AS difficulty, min(test_type) AS test_type, min(concepts) AS concepts FROM ({ITEMS}) i GROUP BY id"


#: Benchmark items without a fault.
SOUND_ITEMS = """
SELECT concat('b', item_id) AS id, concat('On this: ', text) AS question,
       CASE item_id % 6 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'chunking_and_indexing' WHEN 2 THEN 'generation_and_grounding'
            WHEN 3 THEN 'evaluation_and_benchmarks' WHEN 4 THEN 'agentic_and_graph_rag' ELSE 'tooling_and_frameworks' END AS category,
       CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
       CASE item_id % 2 WHEN 0 THEN 'conceptual' ELSE 'practical' END AS test_type,
       'one|two|three' AS concepts, concat('Because of what is said here, which is long enough: ', text) AS reasoning, 'right' AS correctness, 'sourced' AS grounding, 'weighed' AS tradeoffs
FROM {benchmark}
"""

#: Threads some of which ask a question of the benchmark, in other case and with other marks, as a title or as a body.
ASKED = """
SELECT concat('t', d.doc_id) AS thread_id,
       CASE WHEN d.doc_id % 17 = 3 THEN concat('  ', translate(b.text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ?!') WHEN d.doc_id % 17 = 5 THEN NULL WHEN d.doc_id % 17 = 6 THEN ' ?! ' WHEN d.doc_id % 17 = 7 THEN concat(b.text, ' indeed') ELSE concat('On ', d.source) END AS title,
       CASE WHEN d.doc_id % 19 = 4 THEN replace(b.text, ' ', ' , ') ELSE d.text END AS post_body,
       d.lang AS taxonomy_topic
FROM {documents} d LEFT JOIN {benchmark} b ON d.doc_id % 40 = b.item_id
"""

#: Lines on which readers of JSON differ: trailing text, repeated keys, NaN, numbers as ids, wide integers, values that are no objects.
ODD_LINES = """
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS ord, conv_id * 7 + turn AS k,
       CASE (conv_id * 7 + turn) % 12
            WHEN 0 THEN concat(chr(123), '"id": "c', conv_id, '", "score": 3.7', chr(125), ' trailing')
            WHEN 1 THEN concat(chr(123), '"id": "first", "score": 1, "score": "7", "id": "c', conv_id, '"', chr(125))
            WHEN 2 THEN concat(chr(123), '"id": "c', conv_id, '", "score": NaN', chr(125))
            WHEN 3 THEN concat(chr(123), '"id": ', conv_id + 1, '.0, "score": -3.7', chr(125))
            WHEN 4 THEN concat(chr(123), '"id": "c', conv_id, '", "score": 12345678901234567890', chr(125))
            WHEN 5 THEN concat(chr(123), '"id": " c', conv_id, ' ", "score": " 5 "', chr(125))
            WHEN 6 THEN '[1]' WHEN 7 THEN '"data"' WHEN 8 THEN 'null'
            WHEN 9 THEN concat(chr(123), '"id": true, "score": true', chr(125))
            WHEN 10 THEN concat(chr(123), '"data": ', chr(123), '"id": "c', conv_id, '", "score": "3.7"', chr(125), chr(125))
            ELSE concat(chr(123), '"id": 0, "score": 3', chr(125)) END AS line
FROM {conversations}
"""

#: Documents as completions of every shape that a trainer hands over, in JSON: a text, a message, messages, messages and texts mixed, a message without content, scalars.
SHAPES = """
WITH escaped AS (
  SELECT doc_id, text, concat('"', replace(replace(replace(replace(replace(coalesce(text, ''), chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), chr(9), concat(chr(92), 't')), chr(13), concat(chr(92), 'r')), '"') AS body
  FROM {documents}
)
SELECT doc_id AS id, coalesce(text, '') AS text, doc_id % 8 AS shape,
       CASE doc_id % 8
            WHEN 0 THEN body
            WHEN 1 THEN concat(chr(123), '"role": "assistant", "content": ', body, chr(125))
            WHEN 2 THEN concat('[', chr(123), '"role": "user", "content": "why"', chr(125), ', ', chr(123), '"content": ', body, chr(125), ']')
            WHEN 3 THEN concat('[', body, ', ', chr(123), '"content": "tail"', chr(125), ', "end"]')
            WHEN 4 THEN concat(chr(123), '"role": "assistant"', chr(125))
            WHEN 5 THEN concat('[', chr(123), '"role": "x"', chr(125), ', ', doc_id, ', true, null, ', body, ']')
            WHEN 6 THEN concat(chr(123), '"content": null', chr(125))
            ELSE '[]' END AS completion
FROM escaped
"""


#: Tables in as many pieces (4 GB or so) are left as they are, however many cores there are.
SPREAD_PIECES = 32


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out over the cores if it is a small table in fewer pieces than there are cores: work per row outweighs a shuffle of so little."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < min(cores, SPREAD_PIECES) else df


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = ["conversations", "documents", "labels", "benchmark"]
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names if "{" + n + "}" in sql}
    return spark.sql(sql, **tables | ({"documents": spread(tables["documents"])} if "documents" in tables else {}))


def duck(sql: str) -> str:
    for name in ("conversations", "documents", "labels", "benchmark"):
        sql = sql.replace("{" + name + "}", name)
    return sql
