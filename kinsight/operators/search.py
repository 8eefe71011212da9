"""Document search: term postings, BM25, vector similarity, rank fusion, entity-linked lookup.

Queries are small and known when the plan is built; documents are not. A query
is therefore folded into the plan as literals, answered from a stored index, and
only the best k rows are ever sorted (top-k is distributed).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinsight.functions import text as tx

K1, B = 1.2, 0.75
RRF_CONSTANT = 60
SCORE = "decimal(18,8)"


def query_terms(query: str) -> list[str]:
    """Distinct lower-cased words, in order."""
    words = re.findall(r"[^\W\d_]+", query.lower())
    return list(dict.fromkeys(words))


def word_counts(documents: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, attributes..., doc_length, words): the distinct words of each document with their counts.

    Counted inside the row: the words are sorted once and the ends of equal runs give the counts, so nothing is
    shuffled and the text is read once.
    """
    # names bound by transform(array(x), name -> ...)[0] are computed once, whatever uses them
    bare = F.filter(tx.tokens(F.col("content")), lambda w: w != "")
    begins = "filter(sequence(1, size(w)), i -> i = 1 or w[i - 1] <> w[i - 2])"
    runs = (
        "transform(b, (x, i) -> named_struct('term', w[x - 1], 'tf', "
        "CAST(coalesce(get(b, i + 1), size(w) + 1) - x AS BIGINT)))"
    )
    counted = (
        f"transform(array(sort_array(_bare)), w -> named_struct('doc_length', size(w), 'words', "
        f"if(size(w) = 0, cast(array() as array<struct<term: string, tf: bigint>>), "
        f"transform(array({begins}), b -> {runs})[0])))[0]"
    )
    return documents.select("doc_id", *attributes, bare.alias("_bare")).select(
        "doc_id", *attributes, F.expr(counted).alias("_c")).select("doc_id", *attributes, "_c.doc_length", "_c.words")


def search_index(documents: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Postings (doc_id, term, tf, doc_length, attributes...): one row per document and distinct word."""
    return postings(word_counts(documents, attributes), attributes)


def postings(counted: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    return counted.select("doc_id", *attributes, "doc_length", F.explode("words").alias("x")).select(
        "doc_id", *attributes, "doc_length", "x.term", "x.tf")


PARTITIONS = 32


def _bucket(term: Column, partitions: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(partitions)).cast("int")


@dataclass(frozen=True)
class Index:
    """A stored index: postings by a hash of the term, the documents' attributes and lengths, one row of statistics."""

    postings: DataFrame
    documents: DataFrame
    statistics: DataFrame
    partitions: int = PARTITIONS


def write_index(
    documents: DataFrame, path: str, attributes: tuple[str, ...] = (), partitions: int = PARTITIONS
) -> Index:
    """Store an index of (doc_id, content, attributes...) below ``path``. The texts are read once; no query reads
    them again. Postings are partitioned by a hash of the term, so that a query opens only the folders of its terms.
    Each task adds its own file to every folder: postings, by far the most rows of an index, are never shuffled."""
    spark = documents.sparkSession
    word_counts(documents, attributes).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/words")
    counted = spark.read.parquet(f"{path}/words")
    # with a writer for each folder open at once, the postings of a task needn't be sorted by folder either
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting, "0")
    spark.conf.set(setting, str(partitions))
    try:
        postings(counted).withColumn("term_bucket", _bucket(F.col("term"), partitions)).write.mode("overwrite") \
            .option("compression", "zstd").partitionBy("term_bucket").parquet(f"{path}/postings")
    finally:
        spark.conf.set(setting, before)
    counted.drop("words").write.mode("overwrite").parquet(f"{path}/documents")
    corpus_stats(counted).write.mode("overwrite").parquet(f"{path}/statistics")
    if counted.isEmpty():  # then there is no folder of postings to read
        none = postings(counted).withColumn("term_bucket", F.lit(0))
        return Index(none, counted.drop("words"), corpus_stats(counted), partitions)
    return open_index(spark, path, partitions)


def open_index(spark: SparkSession, path: str, partitions: int = PARTITIONS) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "documents", "statistics")), partitions)


def corpus_stats(documents: DataFrame) -> DataFrame:
    """Document count and total length of the documents that have words."""
    return documents.filter("doc_length > 0").agg(F.count("*").alias("n_docs"), F.sum("doc_length").alias("total_length"))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def _contribution(tf: Column, df: Column, length: Column, n: Column, total: Column) -> Column:
    mean = total.cast("double") / n
    weight = _idf(n, df) * (tf * (K1 + 1.0)) / (tf + K1 * ((1.0 - B) + B * length / mean))
    return F.coalesce(F.round(weight, 8).cast(SCORE), F.lit(0).cast(SCORE))


def _matches(filters: dict[str, object]) -> Column:
    kept = F.lit(True)
    for name, value in filters.items():
        kept = kept & (F.col(name) == value)
    return kept


def scored(index: Index, query: str, filters: dict[str, object] | None = None) -> DataFrame:
    """(doc_id, score) of every document with a word of the query, from the index alone.

    ``filters`` are equalities of attributes; statistics then cover the documents that pass. The buckets of the
    query's terms are constants of the plan, so other folders are never opened.
    """
    terms = query_terms(query)
    buckets = [_bucket(F.lit(t), index.partitions) for t in terms]
    hits = index.postings.filter(F.col("term_bucket").isin(*buckets) & F.col("term").isin(terms)) if terms else index.postings.filter("false")
    statistics = index.statistics
    if filters:
        kept = index.documents.filter(_matches(filters))
        hits, statistics = hits.join(kept.select("doc_id"), "doc_id", "left_semi"), corpus_stats(kept)
    return search_postings(hits, statistics, query, None)


def search(index: Index, query: str, k: int = 5, filters: dict[str, object] | None = None) -> DataFrame:
    """The k best documents for a query with their attributes; ties go to the smaller doc_id."""
    top = scored(index, query, filters).orderBy(F.desc("score"), "doc_id").limit(k)
    return top.join(index.documents, "doc_id").orderBy(F.desc("score"), "doc_id")


def search_postings(postings: DataFrame, stats: DataFrame, query: str, k: int | None = 5) -> DataFrame:
    """BM25 over stored postings: the term filter reaches the scan, statistics come as scalar subqueries."""
    hits = postings.filter(F.col("term").isin(query_terms(query)))
    frequencies = hits.groupBy("term").agg(F.count("*").alias("df"))
    # at most one entry per query word
    by_term = frequencies.agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("m")).scalar()
    totals = stats.select(F.struct("n_docs", "total_length").alias("s")).scalar()
    weight = _contribution(F.col("tf"), F.element_at("_df", F.col("term")), F.col("doc_length"),
                           F.col("_s.n_docs"), F.col("_s.total_length"))
    ranked = hits.withColumn("_df", by_term).withColumn("_s", totals).groupBy("doc_id").agg(
        F.sum(weight).cast(SCORE).alias("score"))
    return ranked if k is None else ranked.orderBy(F.desc("score"), "doc_id").limit(k)


def similarity(embedding: Column, query: list[float]) -> Column:
    """Cosine similarity as plain unrolled arithmetic, which stays inside generated code."""
    dot, norm, own = F.lit(0.0), F.lit(0.0), 0.0
    for i, q in enumerate(query):
        e = F.element_at(embedding, i + 1).cast("double")
        dot, norm, own = dot + e * F.lit(float(q)), norm + e * e, own + float(q) * float(q)
    return F.try_divide(dot, F.sqrt(norm) * F.sqrt(F.lit(own)))


def scored_vectors(vectors: DataFrame, query: list[float], key: str = "vec_id") -> DataFrame:
    return vectors.select(
        F.col(key).alias("doc_id"), F.round(similarity(F.col("embedding"), query), 8).cast(SCORE).alias("score")
    ).filter("score is not null")


def search_vector(vectors: DataFrame, query: list[float], k: int = 5, key: str = "vec_id") -> DataFrame:
    return scored_vectors(vectors, query, key).orderBy(F.desc("score"), "doc_id").limit(k)


def _true_ranks(scored: DataFrame, candidates: DataFrame, name: str) -> DataFrame:
    """Rank among all scored documents of the few candidates that have a score.

    Every scored row meets the sorted candidates in one small array and says only behind how many of them it stands;
    one aggregate over those numbers gives all ranks, without sorting or shuffling the scores.
    """
    row = F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d"))
    wanted = scored.join(F.broadcast(candidates), "doc_id", "left_semi")
    order = wanted.agg(F.sort_array(F.collect_list(row)).alias("o")).scalar()
    # candidates that stand before this row; bound by transform, the row's score is computed once, not once a candidate
    before = F.transform(F.array(row), lambda own: F.size(F.filter("_order", lambda o: o < own)))[0]
    counted = scored.withColumn("_order", order).select(before.alias("behind")).groupBy("behind").count()
    steps = counted.agg(F.map_from_entries(F.collect_list(F.struct("behind", "count"))).alias("m"))
    placed = steps.withColumn("_order", order).select("m", F.posexplode("_order").alias("i", "o"))
    # all rows behind at most i candidates stand at or before candidate i
    total = F.aggregate(F.sequence(F.lit(0), F.col("i")), F.lit(0).cast("bigint"), lambda a, k: a + F.coalesce(F.element_at("m", k), F.lit(0)))
    return placed.select(F.col("o.d").alias("doc_id"), total.cast("int").alias(name))


def fusion_depth(k: int) -> int:
    """How deep either list must be read: a document beyond it in both can't be among the k best, since even
    2 / (constant + depth + 1) stays below 1 / (constant + k)."""
    return max(k, RRF_CONSTANT + 2 * k)


def search_hybrid(texts: DataFrame, vectors: DataFrame, vector: list[float], k: int = 5) -> DataFrame:
    """Reciprocal rank fusion of all text hits and all vector hits; the k best.

    ``texts`` holds (doc_id, score) of the documents that match. Candidates are those near the top of either list;
    each counts with its true rank on both sides, however far down that is.
    """
    depth = fusion_depth(k)
    by_vector = scored_vectors(vectors, vector)
    tops = [s.orderBy(F.desc("score"), "doc_id").limit(depth).select("doc_id") for s in (texts, by_vector)]
    candidates = tops[0].union(tops[1]).distinct()  # at most twice the depth
    ranked = _true_ranks(texts, candidates, "text_rank").join(_true_ranks(by_vector, candidates, "vector_rank"), "doc_id", "full_outer")

    def part(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(float(RRF_CONSTANT)) + F.col(rank)), F.lit(0.0))

    return ranked.select(
        "doc_id", "text_rank", "vector_rank",
        F.round(part("text_rank") + part("vector_rank"), 8).cast(SCORE).alias("score"),
    ).orderBy(F.desc("score"), "doc_id").limit(k)


def entity_linked_search(
    profile: DataFrame, index: Index, owners: DataFrame, query: str, k: int = 5, name: str | None = None,
) -> DataFrame:
    """Customers (by full name, or all) with their own k best documents next to their key metrics.

    Names resolve to customer_id first and documents are tied to customers by id
    (``owners``: doc_id, customer_id), never by name. Scores come from the index; the
    per-customer cut is a top-k window, which trims each input task to k rows per
    customer before the shuffle, and only what it keeps gets its attributes.
    """
    card = profile.select(
        "customer_id", F.concat_ws(" ", "first_name", "last_name").alias("customer_name"), "risk_tier",
        "nba_action_type", "system_status",
    )
    if name is not None:
        card = card.filter(F.lower("customer_name") == name.lower())
    owned = scored(index, query).join(owners, "doc_id")
    order = Window.partitionBy("customer_id").orderBy(F.desc("score"), "doc_id")
    top = owned.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return card.join(top, "customer_id").join(index.documents.drop("doc_length"), "doc_id")
