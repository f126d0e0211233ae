"""Keyword rules and the domain taxonomy (ST14, MAP1, JN9). Rules are data that the caller gives or reads.

A rule file is JSON: a list of {"category": ..., "keywords": [...]} in order of priority.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.domains import DOMAINS
from tallyloom.schemas import NO_CATEGORY
from tallyloom.workers import ship

Rules = Sequence[tuple[str, Sequence[str]]]
#: Characters of a keyword by which it meets names.
GRAM = 3


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """Rules from a file, in its order; a rule list is configuration of some hundred entries."""
    rows = spark.read.option("multiLine", True).schema("category string, keywords array<string>").json(path).collect()
    return [(r.category, list(r.keywords or [])) for r in rows]


def classify(name: Column, rules: Rules, default: str = NO_CATEGORY) -> Column:
    """The category of the first rule one of whose keywords, in lower case, the lower-cased name holds."""
    low, chain = F.lower(name), None
    for category, keywords in rules:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | low.contains(k.lower())
        chain = F.when(hit, category) if chain is None else chain.when(hit, category)
    return F.coalesce(chain, F.lit(default)) if chain is not None else F.lit(default)


def classify_by_table(names: DataFrame, rules: DataFrame, name: str = "object_name", default: str = NO_CATEGORY) -> DataFrame:
    """names with a category column, by a table of rules (prio, category, keyword) that may be long.

    Each distinct name is matched once; a tie in prio goes to the lesser category. A name that holds a keyword holds its
    first GRAM characters, so both meet in an equality join on these and only then is the whole keyword looked for.
    """
    low = F.lower(F.col(name))
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.substr(low, i, F.lit(k)))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[cut(k) for k in range(1, GRAM + 1)]))
    distinct = names.select(name).distinct().withColumn("__gram", F.explode(grams))
    keyed = rules.withColumn("__gram", F.substring("keyword", 1, GRAM))
    hits = distinct.join(keyed, "__gram").where(low.contains(F.col("keyword"))).groupBy(name).agg(F.min_by("category", F.struct("prio", "category")).alias("category"))
    return names.join(hits, name, "left").withColumn("category", F.coalesce("category", F.lit(default)))


def matcher(rules: Rules, default: str) -> Callable[[str], str]:
    """The category of a lower-case name by an Aho-Corasick automaton: all keywords are looked for in one walk over it.

    Every keyword leads to the first rule that has it; of the rules met the first wins. An empty keyword is in every name.
    """
    first: dict[str, int] = {}
    for i, (_, keywords) in enumerate(rules):
        for k in keywords:
            first.setdefault(k.lower(), i)
    always = first.pop("", len(rules))
    names = [c for c, _ in rules] + [default]
    tree = ahocorasick.Automaton()
    for k, i in first.items():
        tree.add_word(k, i)
    if not first:
        return lambda name: names[always]
    tree.make_automaton()
    return lambda name: names[min(always, min((i for _, i in tree.iter(name)), default=always))]


def classify_names(names: DataFrame, rules: Rules, name: str = "object_name", default: str = NO_CATEGORY) -> DataFrame:
    """names with a category column, as classify() gives it, for rule lists of hundreds of keywords or more.

    The rules, which a driver has read, travel once; each distinct name is walked through once, whatever the number of
    keywords, and names meet their category again by equality. A null name has the default.
    """
    spark = names.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast([(c, list(ks)) for c, ks in rules])

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = matcher(held.value, default)
        for low in batches:
            yield low.map(find)

    distinct = names.select(name).where(F.col(name).isNotNull()).distinct()
    found = distinct.withColumn("category", run(F.lower(F.col(name))))
    return names.drop("category").join(found, name, "left").withColumn("category", F.coalesce("category", F.lit(default)))


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    return spark.createDataFrame([(i, c, k) for i, (c, ks) in enumerate(rules) for k in ks], "prio int, category string, keyword string")


def taxonomy_rows(taxonomy: DataFrame, column: str = "taxonomy") -> DataFrame:
    """(domain, position, subcategory) from a map of domain to struct(description, subcategories)."""
    one = taxonomy.select(F.explode(column).alias("domain", "about"))
    return one.select("domain", F.posexplode("about.subcategories").alias("position", "subcategory"))


def domains(spark: SparkSession) -> DataFrame:
    """The rows (domain, position, subcategory) of the taxonomy that ships with the engine."""
    held = spark.createDataFrame([({k: (about, list(subs)) for k, (about, subs) in DOMAINS.items()},)], "taxonomy map<string,struct<description:string,subcategories:array<string>>>")
    return taxonomy_rows(held)
