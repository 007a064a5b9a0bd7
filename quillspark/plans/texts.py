"""Text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import filings
from quillspark.operators import texts as T
from quillspark.plans.registry import query, table, texts_table

#: Words that occur in the test documents stand in for a lexicon.
LEX = {"positive": ["the", "eau", "ciudad", "schein"], "negative": ["that", "des", "los", "nicht"], "uncertainty": ["this", "pour", "para", "und"]}
TOK = r"list_transform(regexp_extract_all(text, '(?i)[a-z][a-z\-'']*[a-z]|[a-z]'), lambda x: lower(x))"
IN = {k: "(" + ", ".join(f"'{w}'" for w in v) + ")" for k, v in LEX.items()}


@query(
    f"""
WITH t AS (SELECT doc_id, {TOK} AS t FROM documents), c AS (SELECT doc_id, len(t) AS total_words, len(list_filter(list_distinct(t), lambda x: x IN {IN["positive"]})) AS positive, len(list_filter(list_distinct(t), lambda x: x IN {IN["negative"]})) AS negative, len(list_filter(list_distinct(t), lambda x: x IN {IN["uncertainty"]})) AS uncertainty FROM t)
SELECT *, round((positive - negative) / greatest(total_words, 1), 6) AS net_sentiment, round((positive - negative - uncertainty) / greatest(total_words, 1), 6) AS tone_score FROM c"""
)
def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment of every document."""
    out = T.sentiment(texts_table(spark, sf_dir, "documents", "doc_id", "text"), "text", LEX)
    return out.select("doc_id", "total_words", "positive", "negative", "uncertainty", "net_sentiment", "tone_score")


SECTION_SQL = f"""
WITH w AS (SELECT source, lang, unnest({TOK}) AS w FROM documents),
s AS (SELECT source, lang, count(*) AS total_words, count(DISTINCT w) FILTER (WHERE w IN {IN["positive"]}) AS positive, count(DISTINCT w) FILTER (WHERE w IN {IN["negative"]}) AS negative, count(DISTINCT w) FILTER (WHERE w IN {IN["uncertainty"]}) AS uncertainty FROM w GROUP BY ALL)"""


@query(SECTION_SQL + " SELECT *, round((positive - negative) / greatest(total_words, 1), 6) AS net_sentiment, round((positive - negative - uncertainty) / greatest(total_words, 1), 6) AS tone_score FROM s")
def sentiment_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment of sections, a word counted once a section."""
    out = T.section_sentiment(texts_table(spark, sf_dir, "documents", "source", "lang", "doc_id", "text"), ["source", "lang"], "text", LEX)
    return out.select("source", "lang", "total_words", "positive", "negative", "uncertainty", "net_sentiment", "tone_score")


@query(SECTION_SQL + ", f AS (SELECT source, sum(total_words) AS n, sum(positive) AS positive FROM s GROUP BY source), o AS (SELECT *, lag(n) OVER w AS pn, lag(positive) OVER w AS pp FROM f WINDOW w AS (ORDER BY source)) SELECT source, CAST(n - pn AS BIGINT) AS delta, round((n - pn) / greatest(pn, 1) * 100, 1) AS delta_pct, CAST(positive - pp AS BIGINT) AS delta_positive FROM o WHERE pn IS NOT NULL")
def sentiment_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from filing to filing (one row a source, so the ordering window is small)."""
    s = T.section_sentiment(texts_table(spark, sf_dir, "documents", "source", "lang", "doc_id", "text"), ["source", "lang"], "text", LEX)
    f = s.groupBy("source").agg(F.sum("total_words").alias("n"), F.sum("positive").alias("positive"))
    w = Window.orderBy("source")
    pn, pp = F.lag("n").over(w), F.lag("positive").over(w)
    return f.select("source", (F.col("n") - pn).alias("delta"), F.round((F.col("n") - pn) / F.greatest(pn, F.lit(1)) * 100, 1).alias("delta_pct"), (F.col("positive") - pp).alias("delta_positive")).filter("delta is not null")


@query(
    r"""
WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l, regexp_extract_all(text, '[^ \t\n\r\f\v]+') AS t FROM documents),
g AS (SELECT *, list_distinct(list_transform(l, lambda x: len(regexp_extract_all(x, '[ \t]{3,}')))) AS g FROM l)
SELECT doc_id, coalesce(len(l) >= 3 AND (len(list_filter(l, lambda x: contains(x, '|'))) >= len(l) * 0.6 OR len(list_filter(t, lambda x: regexp_full_match(x, '[$(]?[0-9][0-9,.]*[%)]?'))) > len(t) * 0.25 OR (len(g) = 1 AND g[1] >= 2)), false) AS is_table FROM g"""
)
def table_block_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that look like tables."""
    return table(spark, sf_dir, "documents").select("doc_id", T.is_table(F.col("text")).alias("is_table"))


@query(
    r"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?])[ \t\n\r\f]+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '\n{2,}', chr(1), 'g') AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: regexp_replace(x, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: x <> '') AS s FROM m)
SELECT doc_id, len(s) AS n_sentences, max(list_aggregate(list_transform(s, lambda x: length(x)), 'max')) AS longest FROM s GROUP BY ALL"""
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document; the SQL marks the ends instead of looking behind."""
    d = texts_table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic chunks with their places."""
    d = texts_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    chunks = d.select("doc_id", F.posexplode(T.semantic_chunks(F.col("text"))).alias("chunk_index", "chunk"))
    return chunks.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, CAST(i * 2000 + 1 AS BIGINT), 2000)) AS chunk_md5 FROM documents, range(0, 200) r(i) WHERE i * 2000 < length(text)")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 2000 characters."""
    c = T.fixed_chunks(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return c.select("doc_id", "chunk_index", F.md5("chunk_text").alias("chunk_md5"))


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of pages, by a parser."""
    return texts_table(spark, sf_dir, "pages", "page_id", "html").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS text_md5 FROM pages"""
)
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text by built-in expressions alone."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.visible_text(F.col("html"))).alias("text_md5"))


@query(
    r"""WITH t AS (SELECT l_orderkey, string_agg('| line ' || l_linenumber || ' | ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' | ' || l_returnflag || l_linestatus || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS body, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey AS order_key, length('Order ' || l_orderkey || ' of a customer.') AS start, length('Order ' || l_orderkey || ' of a customer.') + 1 + length(body) AS "end", md5(body) AS body_md5 FROM t WHERE n > 1 AND length(body) > 100"""
)
def table_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables within texts, as spans, by a table function in SQL; the texts hold every order's lines as a table between prose."""
    filings.register_table_functions(spark)
    row = F.concat(F.lit("| line "), "l_linenumber", F.lit(" | "), F.col("l_quantity").cast("int"), F.lit(" | "), "l_returnflag", "l_linestatus", F.lit(" |"))
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", row.alias("row")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["row"]), "\n")
    texts = listed.select(F.col("l_orderkey").alias("order_key"), F.concat(F.lit("Order "), "l_orderkey", F.lit(" of a customer.\n"), body, F.lit("\nThat is all of it.")).alias("text"))
    return spark.sql("SELECT order_key, t.start, t.end, md5(t.body) AS body_md5 FROM {texts}, LATERAL table_spans(text) t", texts=texts)


PROSPECTUS = ["Prospectus Summary", "RISK FACTORS", "Use  of Proceeds", "  Business overview of the company"]
SECTIONED_SQL = "WITH f AS (SELECT doc_id, text, " + " || chr(10) || ".join(f"'{h}'" for h in PROSPECTUS) + " || chr(10) || " + " || chr(10) || ".join(f"'{h}' || chr(10) || substr(text, {1 + 400 * i})" for i, h in enumerate(PROSPECTUS)) + " AS t FROM documents WHERE text IS NOT NULL)"


@query(
    rf"""{SECTIONED_SQL},
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM f),
p AS (SELECT doc_id, n, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
h AS (SELECT *, CASE {' '.join(f"WHEN regexp_full_match(line, '(?i)[ \t]*{p.replace(chr(39), chr(39) * 2)}[^\n]{{0,80}}') THEN '{n}'" for n, p in filings.PROSPECTUS_HEADERS.items())} END AS label FROM p),
s AS (SELECT doc_id, label, start, lead(start) OVER (PARTITION BY doc_id ORDER BY n) AS stop FROM h WHERE label IS NOT NULL),
b AS (SELECT s.doc_id, label, start, trim(CASE WHEN stop IS NULL THEN substr(t, CAST(start + 1 AS BIGINT)) ELSE substr(t, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) END, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS body FROM s JOIN f USING (doc_id)),
k AS (SELECT doc_id, label, body FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY length(body) DESC, start) = 1),
g AS (SELECT * FROM k WHERE length(body) > 200)
SELECT doc_id, label, length(body) AS size, md5(body) AS body_md5 FROM g UNION ALL SELECT doc_id, 'full_text', length(t), md5(t) FROM f WHERE doc_id NOT IN (SELECT doc_id FROM g)"""
)
def prospectus_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titled sections of prospectuses, made of every document: a list of contents, then four sections of falling length."""
    part = lambda i, h: F.concat(F.lit(f"{h}\n"), F.expr(f"substr(text, {1 + 400 * i})"))
    contents = "\n".join(PROSPECTUS) + "\n"
    d = texts_table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    made = d.select("doc_id", F.concat(F.lit(contents), F.concat_ws("\n", *[part(i, h) for i, h in enumerate(PROSPECTUS)])).alias("t"))
    found = filings.titled_sections(made, ["doc_id"], "t")
    return found.select("doc_id", "label", F.length("body").cast("long").alias("size"), F.md5("body").alias("body_md5"))


def map_sql(named: dict[str, str]) -> str:
    return "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in named.items()) + " END"


@query(f"WITH p AS (SELECT p_partkey, 'item_' || p_size AS label FROM part) SELECT p_partkey, coalesce({map_sql(T.SECTION_TYPES)}, {map_sql(T.FOREIGN_SECTION_TYPES)}, 'narrative') AS domestic, coalesce({map_sql(T.FOREIGN_SECTION_TYPES)}, {map_sql(T.SECTION_TYPES)}, 'narrative') AS abroad FROM p")
def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section types of labels, numbered by every part's size and spelled as filings do, by the form."""
    label = T.normal_section(F.concat(F.lit("Item "), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", T.section_type(label, F.lit("10-K")).alias("domestic"), T.section_type(label, F.lit("20-F/A")).alias("abroad"))


@query(
    "WITH n AS (SELECT doc_id, 'Revenue was $' || CAST(n_chars AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.5 Billion' WHEN 1 THEN ' million' WHEN 2 THEN 'K' ELSE '' END || ' in 2024' AS t, n_chars FROM documents) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (n_chars + 0.5) * 1e9 WHEN 1 THEN n_chars * 1e6 WHEN 2 THEN n_chars * 1e3 ELSE n_chars * 1.0 END AS amount FROM n"
)
def scaled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first number of a text with its scale."""
    k = F.col("doc_id") % 4
    t = F.concat(F.lit("Revenue was $"), F.col("n_chars").cast("string"), F.when(k == 0, ".5 Billion").when(k == 1, " million").when(k == 2, "K").otherwise(""), F.lit(" in 2024"))
    return table(spark, sf_dir, "documents").select("doc_id", X.scaled_number(t).alias("amount"))


@query(
    "WITH a AS (SELECT doc_id, lpad(CAST(doc_id + 7 AS VARCHAR), 10, '0') || '-24-' || lpad(CAST(doc_id % 1000000 AS VARCHAR), 6, '0') AS acc, source FROM documents) SELECT doc_id, source || ':' || acc || ':' || CASE WHEN doc_id % 3 = 0 THEN '-' ELSE CAST(doc_id AS VARCHAR) END AS chunk_key, 'https://www.sec.gov/Archives/edgar/data/' || ltrim(substr(acc, 1, 10), '0') || '/' || replace(acc, '-', '') || '/' || acc || '-index.htm' AS url, sha1(lower(source)) AS s1, substr(md5(acc), 1, 16) AS m16 FROM a"
)
def keys_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk keys, filing links and hashes."""
    acc = F.concat(F.lpad((F.col("doc_id") + 7).cast("string"), 10, "0"), F.lit("-24-"), F.lpad((F.col("doc_id") % 1000000).cast("string"), 6, "0"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", acc.alias("acc"))
    index = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))
    return d.select("doc_id", X.chunk_id(F.col("source"), F.col("acc"), index).alias("chunk_key"), X.accession_url(F.col("acc")).alias("url"), F.sha1(F.lower("source")).alias("s1"), F.substring(F.md5("acc"), 1, 16).alias("m16"))
