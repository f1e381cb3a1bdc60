"""The registered queries of this package and their DuckDB SQL.

Each ``opN_<name>`` applies its operator with production parameters to a whole
table.  ``SQL`` holds a twin where SQL can express the result; the others are
tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefsight.llm.op1_tool_calls import TOOLS, conversation_calls, link_tool_calls
from prefsight.llm.op2_lm_score import lm_scores
from prefsight.llm.op3_redirect_filter import filter_urls
from prefsight.llm.op4_rotation_codes import vector_links
from prefsight.llm.op5_toxicity import score_toxicity, train_toxicity
from prefsight.llm.op6_merge_dropout import encode_pieces
from prefsight.llm.op7_length_histogram import length_counts, suffix_sums
from prefsight.llm.op8_decontaminate import decontaminate
from prefsight.llm.op9_tag_path import extract_pages
from prefsight.llm.op10_ngram_join import ngram_components
from prefsight.llm.op11_period_runs import period_runs, repeat_tails
from prefsight.llm.op12_repeated_spans import repeated_spans
from prefsight.llm.op13_collocations import collocations
from prefsight.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, spark.createDataFrame(list(TOOLS.items()), "name string, schema string"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # crc32 of a null id is null: such a row is scored as held out, never learnt from.
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    docs = docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(True)))
    return lm_scores(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


def op3_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op4_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


def toxicity_held_out():
    """Fold whose labels are never learnt; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", toxicity_held_out())
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"))
    return score_toxicity(docs, model, keep=["doc_id", "held_out"])


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(length_counts(table(spark, sf_dir, "documents")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op9_tag_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs(repeat_tails(table(spark, sf_dir, "documents")), keep=["doc_id"]).drop("runs", "n_words")


def op12_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_tool_calls, op2_lm_score, op3_redirect_filter, op4_rotation_codes, op5_toxicity, op6_merge_dropout, op7_length_histogram,
                                    op8_decontaminate, op9_tag_path,
                                    op10_ngram_join, op11_period_runs, op12_repeated_spans,
                                    op13_collocations)
}

#: Words of operator 8 of a text column, as SQL.
_WORDS8 = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
           "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

SQL: dict[str, str] = {
    "op8_decontaminate": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS8} AS w FROM benchmark),
wins AS (
  SELECT item, list_slice(w, s, s + least(len(w), 10) - 1) AS win
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s
        FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS size FROM wins),
spans AS (
  SELECT doc_id, size, w, unnest(generate_series(1, len(w) - size + 1)) AS s
  FROM docs, sizes WHERE len(w) >= size),
hits AS (
  SELECT DISTINCT p.doc_id, p.s, p.size, v.item
  FROM (SELECT doc_id, s, size, list_slice(w, s, s + size - 1) AS win FROM spans) p
  JOIN wins v ON p.win = v.win),
words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS pos FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words h ON d.doc_id = h.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
""",
}


def _host(url: str) -> str:
    return (f"coalesce(translate(regexp_extract({url}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz'), '')")


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), '')"


def _target(tag: str, attribute: str) -> str:
    value = f"""regexp_extract({tag}, '(?is)\\b{attribute}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+)', 1)"""
    return f"""replace(trim(regexp_replace({value}, '^["'']|["'']$', '', 'g')), '&amp;', '&')"""


SQL["op4_rotation_codes"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a
  JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS x, vec_id AS root FROM embeddings
  UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.x WHERE r.root < l.y),
comps AS (SELECT x, min(root) AS c FROM reach GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, c.c AS component_id,
       e.vec_id = c.c AS kept
FROM embeddings e JOIN comps c ON c.x = e.vec_id
"""

SQL["op3_redirect_filter"] = f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
found AS (
  SELECT url AS src, {_target('t', 'href')} AS t FROM (
    SELECT url, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*>')) AS t FROM pages WHERE url IS NOT NULL)
  WHERE regexp_matches(t, '(?is)\\brel\\s*=\\s*["'']?\\s*canonical\\b')
  UNION ALL
  SELECT url, replace(regexp_extract(t, '(?is)\\burl\\s*=\\s*[''"]?([^"''>\\s]+)', 1), '&amp;', '&') FROM (
    SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')) AS t FROM pages WHERE url IS NOT NULL)
  WHERE regexp_matches(t, '(?is)\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b')),
linked AS (
  SELECT src, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(src, '^([^?#]*?:)//', 1) || t
    WHEN starts_with(t, '/') THEN regexp_extract(src, '^([^?#]*?://[^/?#]*)', 1) || t
    WHEN regexp_extract(src, '^([^?#]*?://[^?#]*/)', 1) = ''
      THEN regexp_extract(src, '^([^?#]*?://[^/?#]*)', 1) || '/' || t
    ELSE regexp_extract(src, '^([^?#]*?://[^?#]*/)', 1) || t END AS dst
  FROM found WHERE t <> ''),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT src FROM linked UNION SELECT dst FROM linked),
forms AS (
  SELECT url AS src, 'canonical ' || regexp_replace(regexp_replace({_host('url')}, '^www[.]', ''), ':(80|443)$', '')
    || regexp_replace({_path('url')}, '(/index[.]html?)?/*$', '')
    || CASE WHEN q = '' THEN '' ELSE '?' || q END AS dst
  FROM (SELECT url, regexp_replace(regexp_replace(regexp_extract(url, '://[^?#]*[?]([^#]*)', 1),
          '(^|&)(utm_[^=&]*|ref|gclid|fbclid)(=[^&]*)?', '', 'g'), '^&+', '') AS q FROM urls)
  WHERE contains(url, '://')),
edges AS (SELECT src, dst FROM linked UNION SELECT src, dst FROM forms),
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reach AS (
  SELECT DISTINCT x, x AS root FROM (SELECT url AS x FROM urls UNION SELECT dst FROM edges)
  UNION SELECT e.dst, r.root FROM reach r JOIN both_ways e ON e.src = r.x WHERE r.root < e.dst),
groups AS (SELECT x, min(root) AS g FROM reach GROUP BY x),
fitted AS (
  SELECT u.url, arg_max(r.host || r.path, length(r.host || r.path) * 2 + (r.verdict = 'allow')::INT) AS rule,
         arg_max(r.verdict, length(r.host || r.path) * 2 + (r.verdict = 'allow')::INT) AS verdict
  FROM urls u JOIN rules r ON ({_host('u.url')} = r.host OR ends_with({_host('u.url')}, '.' || r.host))
    AND starts_with({_path('u.url')}, r.path) GROUP BY u.url),
decided AS (
  SELECT g.g, max(CASE f.verdict WHEN 'allow' THEN 1 WHEN 'block' THEN 0 END) AS decision
  FROM groups g JOIN fitted f ON f.url = g.x GROUP BY g.g)
SELECT p.page_id, {_host('p.url')} AS host, {_path('p.url')} AS path, f.rule,
       coalesce(f.verdict, CASE d.decision WHEN 0 THEN 'block' ELSE 'allow' END) AS verdict, g.g AS alias_group
FROM pages p LEFT JOIN fitted f ON f.url = p.url LEFT JOIN groups g ON g.x = p.url LEFT JOIN decided d ON d.g = g.g
"""

SQL["op10_ngram_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, list_slice(w, s, s + least(len(w), 5) - 1) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS s
        FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS root FROM docs
  UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.x WHERE r.root < l.y)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
       (SELECT min(root) FROM reach r WHERE r.x = d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

SQL["op12_repeated_spans"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, list_slice(w, s, s + 49) AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS pos
  FROM windows JOIN firsts USING (win) WHERE first < doc_id),
removed AS (SELECT doc_id, count(*) AS n, list(pos) AS places FROM gone GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, string_agg(word, ' ' ORDER BY pos) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM docs) d
  ANTI JOIN gone g ON g.doc_id = d.doc_id AND g.pos = d.pos GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN removed r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, size, list_slice(w, s, s + size - 1) AS g
  FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s
        FROM words, (VALUES (1), (2), (3), (4), (5)) t(size) WHERE len(w) >= size)),
counts AS (SELECT lang, size, g, count(*) AS f FROM grams GROUP BY lang, size, g HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.size, c.g, c.f AS a, x.f AS l, y.f AS r, t.n, k,
         CAST((1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM counts WHERE size > 1) c
  JOIN counts x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k)
  JOIN counts y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, c.size)
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, list_slice(g, s, s + m - 1) AS g, max(f) AS f
  FROM (SELECT *, unnest(generate_series(1, size - m + 1)) AS s
        FROM (SELECT *, unnest(generate_series(2, size - 1)) AS m FROM counts WHERE size > 2))
  GROUP BY 1, 2),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g
  WHERE i.f IS NULL OR 100 * i.f < 100 * b.a),
ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (
    PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return QUERIES[name](spark, sf_dir)
