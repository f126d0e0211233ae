"""The driver's queries: each operator over whole tables that stand in for reviews, with its SQL twin.

documents stand for reviews, labels for judgements, orders with their lines for annotated sentences (a line is an aspect;
predictions are the lines with a discount, with some polarities changed), events for training logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import aspects as A
from tallyloom.functions import jsonx, taxonomy, text
from tallyloom.functions.domains import DOMAINS
from tallyloom.operators import assemble, chatml, clean, config, evaluate, history, match, sample, stats
from tallyloom.schemas import SCORES
from tallyloom.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Rules for the stand-in names; users give their own.
RULES = (("cheap", ("economy", "promo")), ("plain", ("standard", "medium")))
PART_RULES = (("warm", ("red", "hot")), ("cold", ("blue", "cold")), ("sized", ("small", "large")))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), F.col("text").alias("review_text"), F.col("source").alias("object_name"), (F.col("doc_id") % 5 + 1).cast("int").alias("rating"))


def score_of(name: str) -> Column:
    k = SCORES.index(name) + 3
    return ((F.col("doc_id") * k + F.col("quality") * 3 + F.col("toxic")) % 5 + 1).cast("int")


SCORE_SQL = {s: f"(doc_id * {i + 3} + quality * 3 + toxic) % 5 + 1" for i, s in enumerate(SCORES)}
JUDGED_SQL = "SELECT doc_id, " + ", ".join(f"CAST({v} AS INT) AS {k}" for k, v in SCORE_SQL.items()) + " FROM labels"


def judgements(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels")
    return rows.select(F.col("doc_id").alias("review_id"), F.struct(*[score_of(s).alias(s) for s in SCORES], F.lit("").alias("explanation")).alias("judge_scores"))


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as annotations of doc_id % 8 aspects, every ninth unparsed."""
    docs = table(spark, sf, "documents")
    one = lambda i: A.aspect(F.concat(F.lit("t"), i.cast("string")), F.when(i % 4 != 0, F.concat(F.lit("c"), (i % 3).cast("string"))), F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral")), (i % 3 + 1).cast("int")))
    n = (F.col("doc_id") % 8).cast("int")
    made = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), one)).otherwise(A.empty())
    return docs.select(F.col("doc_id").alias("review_id"), F.col("doc_id").alias("ordinal"), "text", F.col("source").alias("business_name"), F.col("source").alias("business_category"), (F.col("doc_id") % 5 + 1).cast("int").alias("user_rating"), made.alias("aspects"), n.alias("num_aspects"), F.lit("stand-in").alias("annotation_source"), (F.col("doc_id") % 9 != 0).alias("parse_success"), F.lit("").alias("raw_output"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    polarity = F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("neutral")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax", polarity.alias("polarity"))
    return rows.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_name").alias("term"), F.col("p_type").alias("category"), "polarity", "l_discount", "l_tax")


LINES_SQL = "SELECT l_orderkey, l_linenumber, p_name AS term, p_type AS category, CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS polarity, l_discount, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey"
GOLD_SQL = f"l AS ({LINES_SQL}), g AS (SELECT DISTINCT l_orderkey AS k, lower(trim(term)) AS term, polarity FROM l), p AS (SELECT DISTINCT l_orderkey AS k, lower(trim(term)) AS term, CASE WHEN l_tax > 0.06 THEN 'neutral' ELSE polarity END AS polarity FROM l WHERE l_discount >= 0.02)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each order: gold and predicted aspects."""
    rows = lines(spark, sf)
    gold = A.aspect(F.col("term"), F.col("category"), F.col("polarity"))
    made = F.when(F.col("l_discount") >= 0.02, A.aspect(F.col("term"), F.col("category"), F.when(F.col("l_tax") > 0.06, "neutral").otherwise(F.col("polarity"))))
    return rows.groupBy("l_orderkey").agg(F.collect_list(gold).alias("gold"), F.collect_list(made).alias("predicted"))


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as annotated sentences: a line's part is a term, and its type a category; some polarities are `conflict`."""
    polarity = F.when(F.col("l_linenumber") == 7, "conflict").otherwise(F.upper("polarity"))
    rows = lines(spark, sf).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("term"), polarity.alias("polarity")))).alias("t"), F.sort_array(F.collect_list(F.when(F.col("l_linenumber") <= 2, F.struct("l_linenumber", F.col("category"), polarity.alias("polarity"))))).alias("c")
    )
    return rows.select(F.col("l_orderkey").alias("sentence_id"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("text"), F.transform("t", lambda a: F.struct(a["term"].alias("term"), a["polarity"].alias("polarity"))).alias("aspect_terms"), F.transform("c", lambda a: F.struct(a["category"].alias("category"), a["polarity"].alias("polarity"))).alias("aspect_categories"))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as logs of a run for each type; every tenth is an evaluation."""
    e = table(spark, sf, "events")
    even = F.col("event_id") % 10 == 0
    return e.select(F.col("event_type").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 100).cast("int").alias("step"), F.when(~even, F.col("value")).alias("train_loss"), F.when(even, F.col("value")).alias("eval_loss"))


LOGS_SQL = "SELECT event_type AS run_id, event_id AS seq, CAST(event_id % 100 AS INT) AS step, CASE WHEN event_id % 10 <> 0 THEN value END AS train_loss, CASE WHEN event_id % 10 = 0 THEN value END AS eval_loss FROM events"
TIER_SQL = "CASE WHEN overall IS NULL THEN 'unjudged' WHEN overall >= 3.5 THEN 'include' WHEN overall >= 2.5 THEN 'flag_for_review' ELSE 'exclude' END"
MERGED_SQL = f"j AS ({JUDGED_SQL}), m AS (SELECT d.doc_id, d.source, d.text, j.*, {TIER_SQL} AS quality_tier FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id)"
ANN_SQL = "a AS (SELECT doc_id, source, CAST(doc_id % 8 AS INT) AS num_aspects, doc_id % 9 <> 0 AS ok FROM documents)"
ASPECTS_SQL = "x AS (SELECT doc_id, i, CASE i % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS polarity, CASE WHEN i % 4 <> 0 THEN 'c' || (i % 3) ELSE 'unknown' END AS category FROM documents, range(1, 8) r(i) WHERE i <= doc_id % 8)"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
WORDS = r"len(regexp_extract_all({}, '\S+'))"


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.merge_scores(annotations(spark, sf), judgements(spark, sf))


def r4(c: str | Column, name: str | None = None) -> Column:
    return F.round(c, 4).alias(name or c)


@query(f"WITH {MERGED_SQL} SELECT source, count(*) AS n, count(overall) AS judged, round(avg(overall), 4) AS avg_overall, count(*) FILTER (quality_tier = 'include') AS included, count(*) FILTER (quality_tier = 'flag_for_review') AS flagged, count(*) FILTER (quality_tier = 'exclude') AS excluded FROM m GROUP BY source")
def domain_quality(spark: SparkSession, sf: str) -> DataFrame:
    """JN1, MA1, AG10."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "source")
    t = lambda k: F.count_if(F.col("quality_tier") == k)
    rows = assemble.merge_scores(docs, judgements(spark, sf))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("judge_overall").alias("judged"), r4(F.avg("judge_overall"), "avg_overall"), t("include").alias("included"), t("flag_for_review").alias("flagged"), t("exclude").alias("excluded"))


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE " + STRIP.format("text") + " <> '' AND length(text) >= 10) SELECT doc_id AS ordinal, source AS object_name, md5(text) AS text_md5 FROM f WHERE rn = 1")
def clean_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """FLT1."""
    return clean.clean(reviews(spark, sf)).select("ordinal", "object_name", F.md5("review_text").alias("text_md5"))


@query("SELECT count(*) AS n_rows, count(text) AS n_present, count(*) FILTER (" + STRIP.format("text") + " <> '') AS n_not_blank, count(*) FILTER (" + STRIP.format("text") + " <> '' AND length(text) >= 10) AS n_long, count(DISTINCT CASE WHEN " + STRIP.format("text") + " <> '' AND length(text) >= 10 THEN text END) AS n_unique FROM documents")
def clean_stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    """FLT1's counts after each step."""
    return clean.stage_counts(reviews(spark, sf))


@query("SELECT doc_id AS ordinal, length(text) AS n FROM documents WHERE " + STRIP.format("text") + " <> ''")
def explore_clean(spark: SparkSession, sf: str) -> DataFrame:
    """FLT2."""
    return clean.explore_clean(reviews(spark, sf)).select("ordinal", F.length("review_text").cast("long").alias("n"))


@query("SELECT min(doc_id) AS ordinal, md5(text) AS text_md5 FROM documents GROUP BY text")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    """DED1."""
    return clean.first_of_each(reviews(spark, sf), "review_text").select("ordinal", F.md5("review_text").alias("text_md5"))


@query("WITH f AS (SELECT min(doc_id) AS ordinal, text FROM documents GROUP BY text HAVING length(text) >= 10) SELECT ordinal, printf('rev_%05d', row_number() OVER (ORDER BY ordinal) - 1) AS review_id FROM f")
def review_ids(spark: SparkSession, sf: str) -> DataFrame:
    """FLT3, WIN2, JN2."""
    rows = reviews(spark, sf)
    categories = rows.select("object_name").distinct().withColumn("business_category", F.concat(F.lit("c"), F.substring("object_name", 4, 1)))
    return clean.prepare(rows, categories).select("ordinal", "review_id")


@query(f"SELECT count(*) AS n, round(avg({WORDS.format('text')}), 4) AS avg_words, min({WORDS.format('text')}) AS min_words, max({WORDS.format('text')}) AS max_words, round(avg(length(text)), 4) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars FROM documents")
def text_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AG1, ST7, ST8."""
    s = stats.text_stats(reviews(spark, sf))
    return s.select("n", *[r4(f"avg_{c}") if k == "avg" else F.col(f"{k}_{c}").cast("long").alias(f"{k}_{c}") for c in ("words", "chars") for k in ("avg", "min", "max")])


@query(f"SELECT CAST(floor(median({WORDS.format('text')})) AS INT) AS median_words, CAST(floor(median(length(text))) AS INT) AS median_chars FROM documents")
def text_stats_median(spark: SparkSession, sf: str) -> DataFrame:
    """AG2."""
    return stats.text_stats(reviews(spark, sf), median=True).select("median_words", "median_chars")


@query("SELECT lang, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 4) AS pct FROM documents GROUP BY lang")
def lang_share(spark: SparkSession, sf: str) -> DataFrame:
    """AG3, WIN3."""
    return stats.shares(table(spark, sf, "documents"), "lang").select("lang", "n", r4("pct"))


RANKS_SQL = "SELECT '{0}' AS pair, count(*) AS n, round(corr(rx, ry), 4) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM ({1}))"


@query(" UNION ALL ".join(RANKS_SQL.format(s, f"SELECT {SCORE_SQL[s]} AS x, {SCORE_SQL['overall']} AS y FROM labels") for s in SCORES[:-1]))
def score_rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Spearman's rho of each judge's score and the overall one."""
    flat = judgements(spark, sf).select("judge_scores.*")
    return readers.union_of([stats.spearman(flat, s, "overall").select(F.lit(s).alias("pair"), "n", r4("rho")) for s in SCORES[:-1]])


@query(RANKS_SQL.format("price and quantity", "SELECT l_extendedprice AS x, l_quantity AS y FROM lineitem"))
def price_rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Spearman's rho of columns with many values and with few."""
    return stats.spearman(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity").select(F.lit("price and quantity").alias("pair"), "n", r4("rho"))


CYRILLIC = ("абцдефгҳижклмнопқрстувўхйз", "abcdefghijklmnopqrstuvwxyz")
SCRIPT_SQL = f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN translate(lower(text), '{CYRILLIC[1]}', '{CYRILLIC[0]}') WHEN doc_id % 4 = 1 THEN translate(lower(text), 'aeiou', 'аеиоу') ELSE text END AS t FROM documents"


def scripted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, every fourth in Cyrillic letters and every fourth with Cyrillic vowels."""
    t, k = F.lower("text"), F.col("doc_id") % 4
    return table(spark, sf, "documents").select("doc_id", F.when(k == 0, F.translate(t, CYRILLIC[1], CYRILLIC[0])).when(k == 1, F.translate(t, "aeiou", "аеиоу")).otherwise(F.col("text")).alias("t"))


COUNTS_SQL = f"c AS (SELECT doc_id, t, length(regexp_replace(t, '[^Ѐ-ӿ]', '', 'g')) AS cy, length(regexp_replace(t, '[^A-Za-zʻʼ]', '', 'g')) AS la FROM ({SCRIPT_SQL}))"


@query(f"WITH {COUNTS_SQL}, k AS (SELECT doc_id, cy, la, CASE WHEN cy + la = 0 OR la > 0.7 * (cy + la) THEN '{text.LATIN}' WHEN cy > 0.7 * (cy + la) THEN CASE WHEN regexp_matches(t, '[{text.UZBEK_LETTERS}]') THEN '{text.UZBEK}' ELSE '{text.RUSSIAN}' END ELSE '{text.MIXED}' END AS script FROM c) SELECT script, count(*) AS n, CAST(sum(cy) AS BIGINT) AS cyrillic, CAST(sum(la) AS BIGINT) AS latin FROM k GROUP BY script")
def script_class(spark: SparkSession, sf: str) -> DataFrame:
    """ST10 to ST13."""
    t = F.col("t")
    rows = scripted(spark, sf).select("t", text.letter_counts(t).alias("n")).select(text.class_of(t, F.col("n")).alias("script"), F.col("n.cyrillic").alias("cy"), F.col("n.latin").alias("la"))
    return rows.groupBy("script").agg(F.count("*").alias("n"), F.sum("cy").alias("cyrillic"), F.sum("la").alias("latin"))


@query(f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(t), '[а-яёўқғҳА-ЯЁЎҚҒҲ]+') AS ws FROM ({SCRIPT_SQL})) SELECT doc_id, round(CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda x: list_contains({list(text.RUSSIAN_WORDS)}, x))) / len(ws) END, 4) AS share FROM w")
def lexicon_share(spark: SparkSession, sf: str) -> DataFrame:
    """ST12."""
    return scripted(spark, sf).select("doc_id", r4(text.lexicon_share(F.col("t"), text.RUSSIAN_WORDS), "share"))


#: Cyrillic letters that both languages have, and a word of one's lexicon after every third word of half the texts.
PLAIN_CYRILLIC = "абцдефггижклмнопкрстуввхйз"
LEXICON_SQL = rf"""
WITH c AS (SELECT doc_id, translate(lower(text), '{CYRILLIC[1]}', '{PLAIN_CYRILLIC}') AS c FROM documents),
t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(c, '(\S+\s+\S+\s+\S+)', '\1 жуда', 'g') ELSE c END AS t FROM c),
n AS (SELECT doc_id, t, length(regexp_replace(t, '[^Ѐ-ӿ]', '', 'g')) AS cy, length(regexp_replace(t, '[^A-Za-zʻʼ]', '', 'g')) AS la, regexp_extract_all(lower(t), '[а-яёўқғҳА-ЯЁЎҚҒҲ]+') AS ws FROM t)
SELECT doc_id, CASE WHEN cy + la = 0 OR la > 0.7 * (cy + la) THEN '{text.LATIN}' WHEN cy > 0.7 * (cy + la) THEN CASE WHEN regexp_matches(t, '[{text.UZBEK_LETTERS}]') OR len(list_filter(ws, lambda x: list_contains({list(text.UZBEK_WORDS)}, x))) > 0.05 * len(ws) THEN '{text.UZBEK}' ELSE '{text.RUSSIAN}' END ELSE '{text.MIXED}' END AS script FROM n
"""


@query(LEXICON_SQL)
def script_by_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """ST13: texts without a letter that tells the languages apart go by their words."""
    plain = F.translate(F.lower("text"), CYRILLIC[1], PLAIN_CYRILLIC)
    t = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(plain, r"(\S+\s+\S+\s+\S+)", "$1 жуда")).otherwise(plain)
    return table(spark, sf, "documents").select("doc_id", text.script_class(t).alias("script"))


def case_sql(name: str, rules, default: str) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower({name}), '{k}')" for k in ks) + f" THEN '{c}'" for c, ks in rules)
    return f"CASE {arms} ELSE '{default}' END"


@query(f"SELECT {case_sql('p_name', PART_RULES, 'Boshqa')} AS category, count(*) AS n FROM part GROUP BY 1")
def business_class(spark: SparkSession, sf: str) -> DataFrame:
    """ST14."""
    return table(spark, sf, "part").select(taxonomy.classify(F.col("p_name"), PART_RULES).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(SQL["business_class"])
def business_class_by_table(spark: SparkSession, sf: str) -> DataFrame:
    """JN9."""
    rows = taxonomy.classify_by_table(table(spark, sf, "part"), taxonomy.rules_table(spark, PART_RULES), "p_name")
    return rows.groupBy("category").agg(F.count("*").alias("n"))


@query(SQL["business_class"])
def business_class_by_automaton(spark: SparkSession, sf: str) -> DataFrame:
    """ST14, JN9: all keywords in one walk over each distinct name."""
    rows = taxonomy.classify_names(table(spark, sf, "part").select("p_name"), PART_RULES, "p_name")
    return rows.groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT p_name, {case_sql('p_type', RULES, 'Boshqa')} AS business_category FROM part) SELECT business_category, count(*) AS review_count, count(DISTINCT p_name) AS unique_businesses, round(count(*) * 100.0 / (SELECT count(*) FROM part), 4) AS pct FROM p GROUP BY 1")
def business_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AG4, AG20."""
    rows = table(spark, sf, "part").select(F.col("p_name").alias("object_name"), taxonomy.classify(F.col("p_type"), RULES).alias("business_category"))
    return stats.category_stats(rows).select("business_category", "review_count", "unique_businesses", r4("pct"))


@query("WITH c AS (SELECT lang, source, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first_seen) AS place FROM c) SELECT lang, source, n, CAST(place AS INT) AS place FROM r WHERE place <= 3")
def top_business_per_category(spark: SparkSession, sf: str) -> DataFrame:
    """LIM2, SRT1."""
    rows = table(spark, sf, "documents").withColumnRenamed("doc_id", "ordinal")
    return clean.top_per_group(rows, "lang", "source", 3).select("lang", "source", "n", "place")


@query(f"WITH {COUNTS_SQL}, k AS (SELECT doc_id, t, CASE WHEN cy + la = 0 OR la > 0.7 * (cy + la) THEN '{text.LATIN}' WHEN cy > 0.7 * (cy + la) THEN CASE WHEN regexp_matches(t, '[{text.UZBEK_LETTERS}]') THEN '{text.UZBEK}' ELSE '{text.RUSSIAN}' END ELSE '{text.MIXED}' END AS script FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY script ORDER BY doc_id) AS place FROM k) SELECT script, doc_id, replace(substr(t, 1, 120), chr(10), ' ') AS snippet FROM r WHERE place <= 2")
def lang_samples(spark: SparkSession, sf: str) -> DataFrame:
    """LIM3."""
    return clean.samples_per_class(scripted(spark, sf), "t", ordinal="doc_id").select("script", "doc_id", "snippet")


@query(f"WITH {ANN_SQL} SELECT source AS business_category, count(*) AS n, CAST(sum(num_aspects) AS BIGINT) AS total_aspects, round(avg(num_aspects), 4) AS avg_aspects FROM a GROUP BY 1")
def domain_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """AG5."""
    return stats.domain_distribution(annotations(spark, sf)).select("business_category", "n", "total_aspects", r4("avg_aspects"))


@query(f"WITH {ANN_SQL} SELECT count(*) AS total, count(*) FILTER (ok AND num_aspects > 0) AS good, count(*) FILTER (ok AND num_aspects = 0) AS no_aspects, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok AND num_aspects > 5) AS flagged, round(count(*) FILTER (ok AND num_aspects > 0) * 100.0 / count(*), 4) AS usable_rate FROM a")
def annotation_quality(spark: SparkSession, sf: str) -> DataFrame:
    """AG6."""
    return stats.annotation_quality(annotations(spark, sf)).withColumn("usable_rate", F.round("usable_rate", 4))


@query(f"WITH {ANN_SQL} SELECT source AS business_category, count(*) AS n FROM a WHERE ok AND num_aspects > 0 GROUP BY 1")
def scoreable(spark: SparkSession, sf: str) -> DataFrame:
    """FLT5."""
    return clean.scoreable(annotations(spark, sf)).groupBy("business_category").agg(F.count("*").alias("n"))


SENTENCE_SQL = f"l AS ({LINES_SQL}), s AS (SELECT l_orderkey AS k, l_linenumber AS i, 0 AS side, term, NULL AS category, CASE WHEN l_linenumber = 7 THEN 'conflict' ELSE polarity END AS polarity FROM l UNION ALL SELECT l_orderkey, l_linenumber, 1, NULL, category, CASE WHEN l_linenumber = 7 THEN 'conflict' ELSE polarity END FROM l WHERE l_linenumber <= 2)"


@query(f"WITH {SENTENCE_SQL} SELECT k AS sentence_id, coalesce(term, '-') AS term, coalesce(category, '-') AS category, polarity, count(*) AS n FROM s GROUP BY ALL")
def semeval_convert(spark: SparkSession, sf: str) -> DataFrame:
    """ARR1, ST9."""
    rows = sentences(spark, sf).select("sentence_id", F.explode(A.converted(F.col("aspect_terms"), F.col("aspect_categories"))).alias("a"))
    return rows.select("sentence_id", *[F.coalesce(f"a.{c}", F.lit("-")).alias(c) for c in ("term", "category", "polarity")]).groupBy("sentence_id", "term", "category", "polarity").agg(F.count("*").alias("n"))


@query(f"WITH l AS ({LINES_SQL}) SELECT l_orderkey AS sentence_id, count(*) AS n, count(DISTINCT category) AS categories FROM l GROUP BY 1")
def structured_convert(spark: SparkSession, sf: str) -> DataFrame:
    """ARR2: terms keep a category of their own."""
    rows = scored(spark, sf).select("l_orderkey", F.explode(A.converted(F.col("gold"), F.expr("array()").cast("array<struct<category:string,polarity:string>>"), keep_category=True)).alias("a"))
    return rows.groupBy(F.col("l_orderkey").alias("sentence_id")).agg(F.count("*").alias("n"), F.count_distinct("a.category").alias("categories"))


@query(f"WITH {SENTENCE_SQL} SELECT k AS sentence_id, count(*) AS n FROM s WHERE polarity <> 'conflict' GROUP BY 1")
def valid_aspects(spark: SparkSession, sf: str) -> DataFrame:
    """FLT7, FLT8."""
    return chatml.convert(sentences(spark, sf)).select("sentence_id", F.size("aspects").cast("long").alias("n"))


@query(f"WITH {SENTENCE_SQL}, v AS (SELECT k, polarity FROM s WHERE polarity <> 'conflict') SELECT count(DISTINCT k) AS n, count(*) AS n_aspects, round(count(*) / count(DISTINCT k), 4) AS avg_aspects, round(2.0, 4)::DOUBLE AS avg_words, count(DISTINCT k) AS n_with_aspects, count(*) FILTER (polarity = 'positive') AS positive, count(*) FILTER (polarity = 'negative') AS negative, count(*) FILTER (polarity = 'neutral') AS neutral FROM v")
def converted_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AG7."""
    return stats.converted_stats(chatml.convert(sentences(spark, sf))).withColumns({c: F.round(c, 4) for c in ("avg_aspects", "avg_words")})


def micro_sql(tp: str) -> str:
    return f"SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 4) AS f1 FROM ({tp})"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


@query(f"WITH {GOLD_SQL}, gt AS (SELECT DISTINCT k, term FROM g), pt AS (SELECT DISTINCT k, term FROM p) " + micro_sql("SELECT count(*) FILTER (gt.k IS NOT NULL AND pt.k IS NOT NULL) AS tp, count(*) FILTER (gt.k IS NULL) AS fp, count(*) FILTER (pt.k IS NULL) AS fn FROM gt FULL JOIN pt ON gt.k = pt.k AND gt.term = pt.term"))
def ate_exact(spark: SparkSession, sf: str) -> DataFrame:
    """AG13, ARR3, FLT6."""
    return rounded(evaluate.term_metrics(scored(spark, sf)))


@query(f"WITH {GOLD_SQL}, gt AS (SELECT DISTINCT k, term FROM g), pt AS (SELECT DISTINCT k, term FROM p), b AS (SELECT pt.k, pt.term, min(gt.term) AS best FROM pt JOIN gt ON pt.k = gt.k AND (contains(pt.term, gt.term) OR contains(gt.term, pt.term)) GROUP BY 1, 2), r AS (SELECT k, count(DISTINCT best) AS tp FROM b GROUP BY 1), n AS (SELECT k, count(*) AS n FROM pt GROUP BY 1), w AS (SELECT gt.k, count(*) AS m FROM gt GROUP BY 1) " + micro_sql("SELECT CAST(sum(coalesce(tp, 0)) AS BIGINT) AS tp, CAST(sum(greatest(coalesce(n, 0) - coalesce(tp, 0), 0)) AS BIGINT) AS fp, CAST(sum(m - coalesce(tp, 0)) AS BIGINT) AS fn FROM w LEFT JOIN r USING (k) LEFT JOIN n USING (k)"))
def ate_partial(spark: SparkSession, sf: str) -> DataFrame:
    """AG13, ARR5, JN7."""
    return rounded(evaluate.term_metrics(scored(spark, sf), partial=True))


@query(f"WITH {GOLD_SQL}, c AS (SELECT count(*) FILTER (g.k IS NOT NULL AND p.k IS NOT NULL) AS tp, count(*) FILTER (g.k IS NULL) AS fp, count(*) FILTER (p.k IS NULL) AS fn FROM g FULL JOIN p ON g.k = p.k AND g.term = p.term AND g.polarity = p.polarity) SELECT *, tp + fp AS total_predictions, tp + fn AS total_references FROM (" + micro_sql("SELECT * FROM c") + ")")
def pair_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """AG14, ARR4, SET3."""
    return rounded(evaluate.pair_metrics(scored(spark, sf)))


MATCHED_SQL = f"{GOLD_SQL}, m AS (SELECT a.k, a.term, a.y AS is_, b.y AS should FROM (SELECT k, term, min(polarity) AS y FROM p GROUP BY 1, 2) a JOIN (SELECT k, term, min(polarity) AS y FROM g GROUP BY 1, 2) b ON a.k = b.k AND a.term = b.term)"


@query(f"WITH {MATCHED_SQL} SELECT count(*) AS n, round(avg(CAST(is_ = should AS INT)), 4) AS accuracy FROM m")
def sentiment_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """AG15, JN6."""
    return evaluate.sentiment_accuracy(evaluate.matched_polarities(scored(spark, sf))).withColumn("accuracy", F.round("accuracy", 4))


@query(f"WITH {MATCHED_SQL}, u AS (SELECT is_ AS label FROM m UNION SELECT should FROM m), s AS (SELECT label, count(*) FILTER (is_ = label AND should = label) AS tp, count(*) FILTER ((is_ = label) <> (should = label)) AS wrong FROM u, m GROUP BY 1) SELECT count(*) AS labels, round(avg(2.0 * tp / (2 * tp + wrong)), 4) AS macro_f1 FROM s")
def sentiment_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    """AG16."""
    return evaluate.sentiment_macro_f1(evaluate.matched_polarities(scored(spark, sf))).withColumn("macro_f1", F.round("macro_f1", 4))


@query("SELECT count(*) AS n, round(avg(CAST(quality = toxic AS INT)), 4) AS agreement, round((avg(CAST(quality = toxic AS INT)) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / (1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))), 4) AS kappa FROM labels")
def rater_kappa(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: Cohen's kappa."""
    return evaluate.cohens_kappa(table(spark, sf, "labels"), "quality", "toxic").select("n", r4("agreement"), r4("kappa"))


@query(f"WITH {ANN_SQL} SELECT count(*) AS n, count(*) FILTER (ok) AS parsed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (num_aspects = 0) AS empty, round(count(*) FILTER (ok) * 100.0 / count(*), 4) AS rate FROM a")
def parse_rate(spark: SparkSession, sf: str) -> DataFrame:
    """AG17."""
    return stats.parse_rate(annotations(spark, sf)).withColumn("rate", F.round("rate", 4))


@query(f"WITH {MERGED_SQL} SELECT m.doc_id AS review_id, overall AS judge_overall, accuracy AS judge_accuracy, quality_tier, false AS human_verified FROM m")
def merge_scores(spark: SparkSession, sf: str) -> DataFrame:
    """JN1, T14."""
    return merged(spark, sf).select("review_id", "judge_overall", "judge_accuracy", "quality_tier", "human_verified")


@query(f"WITH {MERGED_SQL} SELECT quality_tier, count(*) AS n FROM m GROUP BY 1")
def quality_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """JN5, MA1."""
    parts = [d.agg(F.lit(t).alias("quality_tier"), F.count("*").alias("n")) for t, d in assemble.split_tiers(merged(spark, sf)).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH j AS ({JUDGED_SQL}) SELECT count(*) FILTER (overall >= 3.5) AS include, count(*) FILTER (overall >= 2.5 AND overall < 3.5) AS flag_for_review, count(*) FILTER (overall < 2.5) AS exclude FROM j")
def tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AG12."""
    return stats.tier_counts(judgements(spark, sf))


@query(f"WITH {MERGED_SQL} SELECT m.doc_id AS review_id, CASE quality_tier WHEN 'include' THEN 0 ELSE 1 END AS bucket FROM m WHERE quality_tier IN ('include', 'unjudged')")
def silver_union(spark: SparkSession, sf: str) -> DataFrame:
    """SET2."""
    return assemble.silver(merged(spark, sf)).select("review_id", "bucket")


@query(f"WITH {ANN_SQL} SELECT doc_id AS review_id, CASE WHEN num_aspects > 0 THEN 0 ELSE 1 END AS bucket FROM a WHERE ok")
def good_union(spark: SparkSession, sf: str) -> DataFrame:
    """SET1, T21."""
    return assemble.usable(annotations(spark, sf)).select("review_id", "bucket")


@query(f"WITH {MERGED_SQL}, {ASPECTS_SQL} SELECT count(*) AS total, count(overall) AS judged, count(*) FILTER (quality_tier IN ('include', 'unjudged')) AS silver, (SELECT count(*) FROM x) AS total_aspects, round((SELECT count(*) FROM x) / count(*), 4) AS avg_aspects, count(DISTINCT source) AS n_domains, round(avg(overall), 4) AS avg_overall, (SELECT count(*) FROM x WHERE polarity = 'positive') AS positive, (SELECT count(*) FROM x WHERE category = 'unknown') AS unknown_category FROM m")
def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AG8, MAP2."""
    s = assemble.dataset_stats(merged(spark, sf))
    return s.select("total", "judged", "silver", "total_aspects", r4("avg_aspects"), "n_domains", r4("avg_overall"), F.col("polarity_counts")["positive"].alias("positive"), F.col("top_categories")["unknown"].alias("unknown_category"))


@query(f"WITH {ASPECTS_SQL} SELECT category, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 20")
def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    """LIM2, ARR6."""
    rows = annotations(spark, sf).select("ordinal", F.explode("aspects").alias("a")).select("ordinal", F.coalesce("a.category", F.lit("unknown")).alias("category"))
    return clean.top(rows, "category", 20).select("category", "n")


@query(f"WITH j AS ({JUDGED_SQL}), d AS (SELECT source, j.* FROM j JOIN documents USING (doc_id)) SELECT source AS business_category, CAST(grouping(source) AS INT) AS over_all, count(*) AS n, " + ", ".join(f"round(avg({s}), 4) AS {s}" for s in SCORES) + " FROM d GROUP BY GROUPING SETS ((), (source))")
def judge_overall_domain(spark: SparkSession, sf: str) -> DataFrame:
    """AG9, AG10."""
    rows = judgements(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), F.col("source").alias("business_category")), "review_id")
    return stats.judge_means(rows).withColumns({s: F.round(s, 4) for s in SCORES})


@query(f"WITH j AS ({JUDGED_SQL}), u AS (" + " UNION ALL ".join(f"SELECT '{s}' AS dimension, {s} AS score FROM j" for s in SCORES) + ") SELECT dimension, " + ", ".join(f"count(*) FILTER (score = {k}) AS n{k}" for k in range(1, 6)) + " FROM u GROUP BY 1")
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """AG11, MA2."""
    return stats.score_histogram(judgements(spark, sf))


TARGET = {"src0": 10, "src3": 5, "none": 7}
ALLOCATION_SQL = "c AS (SELECT source AS domain, count(*) AS available FROM documents GROUP BY 1), f AS (SELECT *, CASE domain " + " ".join(f"WHEN '{k}' THEN least({v}, available)" for k, v in TARGET.items()) + " END AS fixed FROM c), s AS (SELECT coalesce(sum(fixed), 0) AS used, sum(CASE WHEN fixed IS NULL THEN available END) AS other FROM f), t AS (SELECT domain, available, CAST(CASE WHEN fixed IS NOT NULL THEN fixed ELSE greatest(3, least(CAST(floor((100 - used) * available / other) AS BIGINT), available)) END AS BIGINT) AS target FROM f, s)"


@query(f"WITH {ALLOCATION_SQL} SELECT * FROM t")
def sample_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """SMP1, AG19."""
    return sample.allocation(annotations(spark, sf), size=100, targets=TARGET)


@query(f"WITH {ALLOCATION_SQL}, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents) SELECT doc_id AS review_id, source AS domain FROM r JOIN t ON source = domain WHERE place <= target")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """SMP1."""
    return sample.stratified(annotations(spark, sf), "review_id", size=100, targets=TARGET).select("review_id", "domain")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN place <= ceil(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM r")
def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    """SMP2, T16."""
    return sample.split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN place <= ceil(n * 0.1) THEN 'validation' WHEN place <= 2 * ceil(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM r")
def three_way_split(spark: SparkSession, sf: str) -> DataFrame:
    """SMP3."""
    return sample.split(table(spark, sf, "documents").select("doc_id"), "doc_id", seed=7, test=0.1)


@query(f"WITH l AS ({LOGS_SQL}) SELECT run_id, count(train_loss) AS n_train, count(eval_loss) AS n_eval, round(arg_min(train_loss, seq), 4) AS first_loss, round(arg_max(train_loss, seq), 4) AS final_loss, round(min(train_loss), 4) AS min_loss, round(max(train_loss), 4) AS max_loss, round(min(eval_loss), 4) AS best_eval_loss, arg_min(step, CASE WHEN eval_loss IS NOT NULL THEN row(eval_loss, seq) END) AS best_eval_step, round(arg_min(train_loss, seq) - arg_max(train_loss, seq), 4) AS reduction FROM l GROUP BY 1")
def history_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AG18."""
    s = history.summary(logs(spark, sf))
    return s.select("run_id", "n_train", "n_eval", *[r4(c) for c in ("first_loss", "final_loss", "min_loss", "max_loss", "best_eval_loss")], "best_eval_step", r4("reduction"))


@query(f"WITH l AS ({LOGS_SQL}), v AS (SELECT run_id, train_loss AS v, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM l WHERE train_loss IS NOT NULL) SELECT run_id, CAST(max(n) AS INT) AS n, round(sum(v * CASE WHEN i = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - i) END), 4) AS ema FROM v GROUP BY 1")
def history_ema(spark: SparkSession, sf: str) -> DataFrame:
    """WIN1."""
    return history.ema_last(logs(spark, sf)).select("run_id", "n", r4("ema"))


@query(f"WITH l AS ({LOGS_SQL}) SELECT run_id, seq, round(eval_loss, 4) AS eval_loss, round(min(eval_loss) OVER (PARTITION BY run_id ORDER BY seq), 4) AS best FROM l WHERE eval_loss IS NOT NULL")
def running_best(spark: SparkSession, sf: str) -> DataFrame:
    """WIN4."""
    return history.running_best(logs(spark, sf)).select("run_id", "seq", r4("eval_loss"), r4("best"))


@query(f"WITH l AS ({LOGS_SQL}) SELECT step, round(arg_min(eval_loss, seq) FILTER (run_id = 'click'), 4) AS click, round(arg_min(eval_loss, seq) FILTER (run_id = 'view'), 4) AS view FROM l WHERE eval_loss IS NOT NULL GROUP BY 1")
def eval_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """JN10."""
    return history.by_step(logs(spark, sf), ["click", "view"]).select("step", r4("click"), r4("view"))


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ASK_SQL = sql_text(chatml.ASK[0]) + " || text || '\"'"


@query(f"SELECT doc_id, md5('<|im_start|>system' || chr(10) || {sql_text(chatml.SYSTEM)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {ASK_SQL} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt_md5 FROM documents")
def inference_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """ST4, ST1."""
    return table(spark, sf, "documents").select("doc_id", F.md5(chatml.inference_prompt(F.col("text"))).alias("prompt_md5"))


ONE_ASPECT_SQL = "'{' || chr(10) || '    \"aspects\": [' || chr(10) || '        {' || chr(10) || '            \"term\": \"' || source || '\",' || chr(10) || '            \"polarity\": \"positive\"' || chr(10) || '        }' || chr(10) || '    ]' || chr(10) || '}'"


def one_aspect() -> Column:
    return F.array(A.aspect(F.col("source"), F.lit(None), F.lit("positive")))


@query(f"SELECT doc_id, {ONE_ASPECT_SQL} AS json FROM documents")
def aspect_json(spark: SparkSession, sf: str) -> DataFrame:
    """JS1."""
    return table(spark, sf, "documents").select("doc_id", jsonx.aspects_json(one_aspect()).alias("json"))


@query(f"SELECT doc_id, md5('<|im_start|>system' || chr(10) || {sql_text(chatml.SYSTEM)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {ASK_SQL} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || {ONE_ASPECT_SQL} || '<|im_end|>') AS chat_md5, true AS is_chat FROM documents")
def chatml_build(spark: SparkSession, sf: str) -> DataFrame:
    """ST2, ST3, FLT9."""
    chat = chatml.training_text(F.col("text"), one_aspect())
    return table(spark, sf, "documents").select("doc_id", F.md5(chat).alias("chat_md5"), clean.is_chatml(chat).alias("is_chat"))


CHAT_TAIL_SQL = f"text || '\"<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || {ONE_ASPECT_SQL}"


@query("SELECT doc_id, " + STRIP.format("substr(s, 1, instr(substr(s, 2), '\"'))") + f" AS review_text, source AS term FROM (SELECT doc_id, source, {CHAT_TAIL_SQL} AS s FROM documents)")
def chatml_parse(spark: SparkSession, sf: str) -> DataFrame:
    """JS6, T4: strict JSON in an Arrow UDF, after the built-in patterns; a review ends at its first quote but one at its start."""
    chat = table(spark, sf, "documents").select("doc_id", chatml.training_text(F.col("text"), one_aspect()).alias("text"))
    return chatml.parse(chat).select("doc_id", "review_text", F.col("gold")[0]["term"].alias("term"))


@query(f"SELECT doc_id, md5({sql_text(chatml.JUDGE_OPENING)} || chr(10) || chr(10) || '== REVIEW ==' || chr(10) || 'Text: \"' || text || '\"' || chr(10) || 'Business: \"' || source || '\" (Category: ' || lang || ')' || chr(10) || 'User rating: ' || (doc_id % 5 + 1) || '/5' || chr(10) || chr(10) || '== MODEL PREDICTION ==' || chr(10) || '{{' || chr(10) || '  \"aspects\": []' || chr(10) || '}}' || chr(10) || chr(10) || {sql_text(chatml.JUDGE_RUBRIC)}) AS prompt_md5 FROM documents")
def judge_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """ST5."""
    prompt = chatml.judge_prompt(F.col("text"), F.col("source"), F.col("lang"), F.col("doc_id") % 5 + 1, A.empty())
    return table(spark, sf, "documents").select("doc_id", F.md5(prompt).alias("prompt_md5"))


@query(f"WITH j AS ({JUDGED_SQL}) SELECT doc_id, " + ", ".join(SCORES) + " FROM j")
def judge_parse(spark: SparkSession, sf: str) -> DataFrame:
    """JS7: whole JSON, fenced, inside prose, and broken, by turns."""
    rows = table(spark, sf, "labels").select("doc_id", *[score_of(s).alias(s) for s in SCORES])
    body = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{s}": '), F.col(s).cast("string")) for s in SCORES]))
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(body, F.lit("}"))).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("}\n```"))).when(k == 2, F.concat(F.lit("Scores: "), body, F.lit("} as asked"))).otherwise(F.concat(body, F.lit(",")))
    held = rows.select("doc_id", jsonx.parse_judgement(raw).alias("s"))
    return held.select("doc_id", *[F.col(f"s.{s}").alias(s) for s in SCORES])


@query("SELECT doc_id, doc_id % 3 <> 2 AS parse_success, CAST(CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INT) AS n, CASE doc_id % 3 WHEN 2 THEN NULL ELSE source END AS term FROM documents")
def output_parse(spark: SparkSession, sf: str) -> DataFrame:
    """JS4, JS5: JSON, text that only the patterns read (both find the aspect), and neither, by turns."""
    k = F.col("doc_id") % 3
    loose = F.concat(F.lit('"term": "'), F.col("source"), F.lit('", "category": "c", "polarity": "positive"'))
    raw = F.when(k == 0, F.concat(F.lit("So: "), jsonx.aspects_json(one_aspect()), F.lit("<|im_end|>"))).when(k == 1, loose).otherwise(F.lit("none"))
    held = table(spark, sf, "documents").select("doc_id", jsonx.parse_output(raw).alias("p"))
    return held.select("doc_id", F.col("p.parse_success").alias("parse_success"), F.size("p.aspects").alias("n"), F.get("p.aspects", F.lit(0))["term"].alias("term"))


@query("SELECT doc_id, true AS parse_success, source AS term FROM documents")
def output_parse_native(spark: SparkSession, sf: str) -> DataFrame:
    """JS4's lenient form in built-in functions."""
    held = table(spark, sf, "documents").select("doc_id", jsonx.lenient_output(jsonx.aspects_json(one_aspect())).alias("p"))
    return held.select("doc_id", "p.parse_success", F.get("p.aspects", F.lit(0))["term"].alias("term"))


@query("SELECT r.doc_id AS ordinal, a.i AS annotated_index, CAST(1.0 AS DOUBLE) AS match_score FROM documents r JOIN (SELECT " + STRIP.format("text") + " AS t, min(doc_id) AS i FROM documents GROUP BY 1) a ON " + STRIP.format("r.text") + " = a.t")
def exact_merge(spark: SparkSession, sf: str) -> DataFrame:
    """JN3, ST6."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return match.exact(docs.withColumnRenamed("doc_id", "ordinal"), docs, "text", "text", "doc_id").select("ordinal", "annotated_index", "match_score")


#: difflib takes frequent characters of long texts for junk: what doesn't begin alike is found only by another character.
FUZZY_SQL = f"""
WITH a AS (SELECT y, length(y) AS n, j, length(y) < 200 OR len(list_filter(list_distinct(string_split(substr(y, 2), '')), lambda c: length(y) - length(replace(y, c, '')) <= length(y) // 100 + 1)) > 0 AS seen
    FROM (SELECT lower(text) AS y, min(doc_id) AS j FROM documents GROUP BY 1)),
r AS (SELECT doc_id, lower(text) AS y, {STRIP.format("lower(CASE WHEN doc_id % 2 = 0 THEN text || '#' ELSE '#' || substr(text, 2) END)")} AS x FROM documents)
SELECT r.doc_id AS ordinal, j AS annotated_index, round(2.0 * (length(x) - 1) / (length(x) + n), 4) AS match_score FROM r JOIN a USING (y) WHERE (seen OR doc_id % 2 = 0) AND 2.0 * (length(x) - 1) / (length(x) + n) > 0.95
"""


@query(FUZZY_SQL)
def fuzzy_merge(spark: SparkSession, sf: str) -> DataFrame:
    """JN4, ST16: every text with a character more or with another first one, against all texts. Also tested against brute force."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    edited = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("#"))).otherwise(F.concat(F.lit("#"), F.substr("text", F.lit(2))))
    raw = docs.select(F.col("doc_id").alias("ordinal"), edited.alias("text"))
    return match.fuzzy(raw, docs, "ordinal", "text", "doc_id", "text").select("ordinal", "annotated_index", r4("match_score"))


TAXONOMY_SQL = "(VALUES " + ", ".join(f"({k}, {sql_text(d)}, {i}, {sql_text(s)})" for k, (d, (_, ss)) in enumerate(DOMAINS.items()) for i, s in enumerate(ss)) + ") t(k, domain, position, subcategory)"


@query(f"SELECT doc_id, domain, count(*) AS subcategories, max(CASE WHEN position = doc_id % 5 THEN subcategory END) AS subcategory FROM documents JOIN {TAXONOMY_SQL} ON doc_id % {len(DOMAINS)} = k GROUP BY 1, 2")
def taxonomy_rows(spark: SparkSession, sf: str) -> DataFrame:
    """MAP1: the aspect categories of each document's domain, and one of them."""
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (F.col("doc_id") % len(DOMAINS) + 1).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", domain.alias("domain"))
    met = docs.join(taxonomy.domains(spark), "domain")
    return met.groupBy("doc_id", "domain").agg(F.count("*").alias("subcategories"), F.max(F.when(F.col("position") == F.col("doc_id") % 5, F.col("subcategory"))).alias("subcategory"))


@query("SELECT doc_id AS ordinal, CASE WHEN source <> 'src1' THEN 'cat ' || source END AS business_category FROM documents")
def category_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """JN2, SRC5: the last of repeated names; a name without a category stays without."""
    rows = reviews(spark, sf)
    pairs = rows.where("object_name <> 'src1'").select("ordinal", "object_name", F.concat(F.lit("cat "), F.col("object_name")).alias("business_category"))
    return clean.with_category(rows, readers.last_of_each(pairs, "object_name", "business_category")).select("ordinal", "business_category")


@query("SELECT CASE WHEN c_custkey % 7 = 0 THEN 'none' ELSE c_mktsegment END AS business_category, c_nationkey FROM customer GROUP BY ALL")
def distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """DED2, SRT2."""
    c = table(spark, sf, "customer")
    return c.select(F.when(F.col("c_custkey") % 7 == 0, "none").otherwise(F.col("c_mktsegment")).alias("business_category"), "c_nationkey").distinct()


@query("SELECT p_partkey, round((p_size * 1e9 * CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 2.0 END / 1073741824.0) * 1.5 + (1 + p_partkey % 4) * 2048 * 4096.0 * 4 / 1073741824.0, 4) AS total_gb FROM part")
def memory_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """MA8."""
    k = F.col("p_partkey") % 2
    m = config.memory(F.col("p_size"), F.lit(2048), 1 + F.col("p_partkey") % 4, F.when(k == 0, 4).otherwise(16))
    return table(spark, sf, "part").select("p_partkey", r4(m["total_gb"], "total_gb"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 2 ELSE 1 END AS batch_size, CASE c_custkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 4 ELSE 2 END AS max_batch FROM customer")
def gpu_batch_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """MA6, T22."""
    k = F.col("c_custkey") % 3
    b = config.batch_of(F.when(k == 0, "NVIDIA RTX A6000 48GB").when(k == 1, "nvidia rtx 4090").otherwise("RTX A6000"))
    return table(spark, sf, "customer").select("c_custkey", b["batch_size"].alias("batch_size"), b["max_batch"].alias("max_batch"))


@query("SELECT c_nationkey AS host, count(*) AS num_gpus, CAST(CASE WHEN count(*) >= 2 THEN 4 ELSE 2 END AS INT) AS batch_size, CASE WHEN count(*) >= 2 THEN 'auto' ELSE 'cuda:0' END AS device_map FROM customer GROUP BY 1")
def training_config(spark: SparkSession, sf: str) -> DataFrame:
    """MA7."""
    d = table(spark, sf, "customer").select(F.col("c_nationkey").alias("host"), F.col("c_custkey").alias("device"), F.lit("NVIDIA RTX 4090").alias("name"), F.lit(24.0).alias("memory_gb"))
    return config.recommend(d).select("host", "num_gpus", "batch_size", "device_map")


@query("SELECT doc_id AS ordinal, source FROM documents ORDER BY doc_id LIMIT 25")
def first_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """LIM1: the limit is the operator."""
    return readers.first_rows(table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), "source"), 25)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_rest(spark: SparkSession, sf: str) -> DataFrame:
    """SRC14."""
    return readers.not_yet_done(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, max(length(text)) AS longest FROM conversations GROUP BY 1")
def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    """A10: chat turns by conversation."""
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: the windowed aggregate that also runs on a stream."""
    from tallyloom.streaming.incremental import windowed_counts

    rows = windowed_counts(table(spark, sf, "events").select("ts", "event_type", "value"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", r4("total"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


