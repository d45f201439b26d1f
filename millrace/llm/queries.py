"""The queries of this subpackage by registered name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.views import spread
from . import chat, decontamination, exact_dedup, language_id, mixing, packing, prefix_trie, similarity_join, spelling, suffix_dedup, token_counts, url_filters, warc
from .common import materialize, with_copies

# Queries that end in a map over texts write their result first: batches for Python are small meanwhile, and the session's setting is as it was.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one in fewer pieces than there are cores is dealt out, as the work on a text outweighs its shuffle."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", digest.alias("text_sha256"))
    out = exact_dedup.exact_duplicates(docs, same="text_sha256")
    return out.select(
        "doc_id",
        F.col("__keep_id").alias("keep_id"),
        F.col("__group_size").alias("group_size"),
        F.col("__kept").alias("kept"),
        "text_sha256",
    )


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_plan(docs, keep=["doc_id"]).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sums
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST)
), targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * w) AS target FROM levels
), drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       (size * least(3, floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""

def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    rows = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    out = language_id.identify(rows, model, keep=["doc_id", "held_out"])
    return materialize(out.withColumnsRenamed({"__lang": "lang_pred", "__score": "score"}), "languages")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return materialize(token_counts.count_tokens(docs, keep=["doc_id"]).withColumnsRenamed({"__pretokens": "n_pretokens", "__tokens": "n_tokens"}), "counts")


def op1_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(packing.pack_documents(table(spark, sf_dir, "documents")), "packs")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.render(chat.fold(event_log(with_copies(rows, ["conv_id", "turn"], ["role", "text"])))))


def event_log(rows: DataFrame) -> DataFrame:
    """The messages as they might have come about: streamed in pieces; every fourth drafted and edited after the next
    message began, every fourth drafted and regenerated, some with a message beside them that was deleted."""
    text, k = F.coalesce("text", F.lit("")), F.pmod(F.coalesce("conv_id", F.lit(0)) * 31 + F.coalesce("turn", F.lit(0)), F.lit(4))
    seq = F.coalesce("turn", F.lit(0)).cast("long") * 16
    draft = F.concat(F.lit("[draft] "), F.reverse(text))
    event = lambda at, op, said=F.lit(""), role=F.lit(""), ghost=False: F.struct((seq + at).alias("seq"), F.lit(op).alias("op"), role.alias("role"), said.alias("text"), F.lit(ghost).alias("ghost"))
    third = F.ceil(F.length(text) / 3).cast("int")
    piece = lambda c, n: F.substring(c, third * n + 1, third)
    start = event(0, "start", role=F.col("role"))
    streamed = [event(n + 1, "delta", piece(text, F.lit(n))) for n in range(3)]
    edited = [event(1, "delta", draft), event(30, "edit", text)]
    again = [event(1, "delta", draft), event(2, "regenerate"), *(event(n + 3, "delta", piece(text, F.lit(n))) for n in range(3))]
    deleted = [event(6, "start", role=F.lit("user"), ghost=True), event(7, "delta", draft, ghost=True), event(20, "delete", ghost=True)]
    events = F.when(k == 1, F.array(start, *edited)).when(k == 2, F.array(start, *again)).when(k == 3, F.array(start, *streamed, *deleted)).otherwise(F.array(start, *streamed))
    log = rows.select(F.col("conv_id").alias("conv"), F.col("turn").alias("msg"), "copy", F.explode(events).alias("e")).select("conv", "msg", "copy", "e.*")
    return log.withColumn("copy", F.when(F.col("ghost"), -F.col("copy")).otherwise(F.col("copy"))).drop("ghost")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.read_archives(warc.write_archives(warc.plan_records(pages))).drop("url")


OP4_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM firsts
"""

OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), shown AS (
  SELECT *, length(regexp_replace(text, '([\\<\[])', '\\\1', 'g'))
            + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6
              ELSE 20 + length(regexp_replace(role, '([\\<\[>])', '\\\1', 'g')) END AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""

def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.similar_classes(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s
  FROM worded
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM sets
  UNION
  SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.id
), roots AS (
  SELECT id, min(root) AS component_id FROM reach GROUP BY id
)
SELECT doc_id, len(s) AS n_shingles, component_id, (SELECT count(*) FROM links WHERE x = doc_id) AS n_links
FROM sets JOIN roots ON id = doc_id
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_join(F.transform("__items", lambda x: x.cast("string")), ",", "null")
    return out.select("doc_id", (F.size("__items") > 0).alias("contaminated"), items.alias("item_ids"), F.col("__overlap").cast("long").alias("overlap"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}])+') AS w FROM documents
), i AS (
  SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}])+') AS w FROM benchmark
), sized AS (
  SELECT iid, item_id, w, len(w) AS n, least(len(w), 13) AS win, least(len(w), 13) - least(len(w), 13) * 2 // 13 AS agree FROM i WHERE len(w) > 0
), dw AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), iw AS (
  SELECT iid, agree, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM sized
), aligned AS (
  SELECT rid, iid, p - q AS shift, list(q) AS qs FROM dw JOIN iw USING (word) GROUP BY rid, iid, p - q HAVING count(*) >= min(agree)
), placed AS (
  SELECT a.rid, a.iid, item_id, shift, qs, win, agree, len(d.w) AS dn, unnest(range(1, n - win + 2)) AS start FROM aligned a JOIN sized USING (iid) JOIN d USING (rid)
), judged AS (
  SELECT rid, iid, item_id, len([x for x in qs if x >= start AND x < start + win]) AS same, agree FROM placed WHERE start + shift >= 1 AND start + shift + win - 1 <= dn
), items AS (
  SELECT rid, iid, item_id, max(same) AS same FROM judged WHERE same >= agree GROUP BY rid, iid, item_id
), found AS (
  SELECT rid, string_agg(coalesce(item_id::VARCHAR, 'null'), ',' ORDER BY item_id NULLS LAST) AS item_ids, max(same) AS overlap FROM items GROUP BY rid
)
SELECT doc_id, item_ids IS NOT NULL AS contaminated, coalesce(item_ids, '') AS item_ids, coalesce(overlap, 0)::BIGINT AS overlap FROM d LEFT JOIN found USING (rid)
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, keep=["doc_id"], payload=False)
    digests = out.select(
        "doc_id",
        F.col("__n_bytes").alias("n_bytes"),
        F.col("__n_removed").alias("n_removed"),
        F.size("__spans").cast("long").alias("n_spans"),
        F.col("__kept_sha256").alias("kept_sha256"),
    )
    return materialize(digests, "digests")


OP5_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents
), starts AS (
  SELECT rid, unnest(range(1, octet_length(b) - 198)) AS s FROM docs WHERE octet_length(b) >= 200
), windows AS (
  SELECT rid, s, count(*) OVER (PARTITION BY md5(b[s:s + 199])) AS n FROM starts JOIN docs USING (rid)
), steps AS (
  SELECT rid, s, CASE WHEN s > lag(s) OVER (PARTITION BY rid ORDER BY s) + 200 THEN 1 ELSE 0 END AS step FROM windows WHERE n > 1
), numbered AS (
  SELECT rid, s, sum(step) OVER (PARTITION BY rid ORDER BY s) AS span FROM steps
), spans AS (
  SELECT rid, span, min(s) AS lo, max(s) + 200 AS hi FROM numbered GROUP BY rid, span
), cuts AS (
  SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 1) AS before FROM spans
), kept AS (
  SELECT rid, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS rest,
         string_agg(CASE WHEN lo > before THEN hex(b[before:lo - 1]) ELSE '' END, '' ORDER BY lo) AS head FROM cuts JOIN docs USING (rid) GROUP BY rid
)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       CASE WHEN rest IS NULL THEN sha256(b) ELSE sha256(unhex(head || CASE WHEN rest <= octet_length(b) THEN hex(b[rest:octet_length(b)]) ELSE '' END)) END AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.word_counts(table(spark, sf_dir, "documents")))


#: The 256 remainders that a CRC-32 by bytes takes, made from its fixed polynomial.
CRC_TABLE = """
bits AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
)"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8, beside a column t of the table of remainders."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INTEGER, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, {crc32_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM counted, crc
), kept AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run) + 2)::INTEGER) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (
  SELECT word, n, i, left(word, (i - 1)::INTEGER) || substr(word, (i + 1)::INTEGER) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON cut.rest = words.word
), best AS (
  SELECT word, count(*) AS n_near, (list(other ORDER BY n DESC, other))[1] AS other, max(n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)
), climbed AS (
  SELECT word, word AS root FROM formed UNION ALL SELECT climbed.word, formed.form FROM climbed JOIN formed ON formed.word = climbed.root WHERE formed.form IS NOT NULL
), roots AS (
  SELECT climbed.word, climbed.root FROM climbed JOIN formed ON formed.word = climbed.root WHERE formed.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""


#: Rules of the urls of the web pages: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    out = url_filters.judge(table(spark, sf_dir, "pages"), rules, keep=["page_id"])
    return out.withColumnsRenamed({f"__{k}": k for k in ("host", "path", "rule", "verdict")})


OP12_SQL = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), rules AS (
  SELECT * FROM (VALUES {", ".join(map(str, URL_RULES))}) AS r(verdict, rule_host, rule_path)
), best AS (
  SELECT rid, rule_host || rule_path AS rule, verdict FROM parts JOIN rules ON ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule_host) DESC, length(rule_path) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (rid)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))))


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own), crc
), heads AS (
  SELECT convs.conv_id, own.p, own.role, own.text FROM convs JOIN own ON own.conv_id = base AND own.p < h
), lent AS (
  SELECT conv_id, count(*) AS m FROM heads GROUP BY conv_id
), turns AS (
  SELECT * FROM heads UNION ALL SELECT own.conv_id, own.p - h + coalesce(m, 0), role, text FROM own JOIN convs USING (conv_id) LEFT JOIN lent USING (conv_id) WHERE own.p >= h
), lists AS (
  SELECT convs.conv_id, coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY p) FILTER (p IS NOT NULL), []) AS keys,
         coalesce(list(length(text) ORDER BY p) FILTER (p IS NOT NULL), []) AS chars FROM convs LEFT JOIN turns USING (conv_id) GROUP BY convs.conv_id
), prefixes AS (
  SELECT conv_id, d, sha256(array_to_string(keys[1:d], ',')) || d AS node, CASE WHEN d > 0 THEN sha256(array_to_string(keys[1:d - 1], ',')) || (d - 1) END AS up, len(keys) = d AS ends, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM lists)
), grouped AS (
  SELECT node, any_value(d) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY node
), counted AS (
  SELECT g.*, (SELECT count(*) FROM grouped c WHERE c.up = g.node) AS n_children FROM grouped g
), below AS (
  SELECT prefixes.node AS top, n_children, saved FROM counted JOIN prefixes ON prefixes.conv_id = counted.conv_id AND prefixes.d <= counted.depth
), sums AS (
  SELECT top AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY top
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (node) LEFT JOIN counted p ON p.node = c.up
"""


QUERIES = {
    "op1_packed_tokens": op1_packed_tokens,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_chat_format": op8_chat_format,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_url_filters": op12_url_filters,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op2_ngram_jaccard": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_chat_format": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_url_filters": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
