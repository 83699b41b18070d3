"""Neighbour clusters and expansion terms of many settings from one set of hits.

Settings are nested: the hits of ``first_ret`` 10 are the first of those of 20, three neighbours the
first of five, ten expansion terms the first of twenty-five. So hits are fetched once, for the deepest
setting, and every document has one ordered list of neighbours for each depth. From there on a query is
one row that holds the clusters of all settings, and a term one row with the hits it occurs in. Settings
are only told apart inside the task that holds the query: what is exchanged does not grow with them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scoring import (
    SCORE_DIGITS,
    bm25_idf,
    bm25_saturation,
    collection_weight,
    smoothed_idf,
)
from quern.operators.feedback import SIMILARITY_DIGITS
from quern.operators.retrieval import QUERY
from quern.params import Bm25, KnnParams
from quern.sources.term_index import TermIndex, posting_rows
from quern.storage import written


def setting_value(grid: Sequence[object], name: str) -> Column:
    """Value of a parameter for the row's ``config_id``; settings are numbered from 1."""
    pairs = [F.lit(v) for i, p in enumerate(grid, start=1) for v in (i, asdict(p)[name])]
    return F.create_map(*pairs)[F.col("config_id")]


def term_lists(hits: DataFrame, documents: DataFrame, key: Sequence[str] = QUERY) -> DataFrame:
    """(key, term, found): each term of a query's hits with (doc_id, rank, n_hits, tf, dl) of those that hold it."""
    per_query = Window.partitionBy(*key)
    counted = hits.select(*key, "doc_id", "rank", F.count(F.lit(1)).over(per_query).alias("n_hits"))
    rows = posting_rows(documents.join(counted, "doc_id"))
    entry = F.struct("doc_id", "rank", "n_hits", "tf", "dl")
    return rows.repartition(*key).groupBy(*key, "term").agg(F.collect_list(entry).alias("found"))


def neighbour_orders(lists: DataFrame, depths: Sequence[int], key: Sequence[str] = QUERY) -> DataFrame:
    """(key, doc_id, rank, dl, orders): for each depth all hits within it, nearest first, ties by id.

    Weights and similarities are taken for each depth, as if the query had only that many hits. A
    document is its own neighbour at similarity 1; hits without a common term follow in order of id. A
    document beyond a depth has no list there.
    """
    same_doc = Window.partitionBy(*key, "doc_id")
    before = Window.partitionBy(*key, "term").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    per_query = Window.partitionBy(*key)
    at = [F.get("weights", F.lit(i)) for i in range(len(depths))]

    def raw(depth: int) -> Column:
        df = F.size(F.filter("found", lambda f: f["rank"] <= depth))
        idf = smoothed_idf(F.least(F.col("f.n_hits"), F.lit(depth)), df)
        return F.when(F.col("f.rank") <= depth, F.col("f.tf") * idf)

    rows = (
        lists.repartition(*key)
        .select(*key, "term", "found", F.explode("found").alias("f"))
        .select(*key, "term", "f.doc_id", "f.rank", "f.dl", F.array(*map(raw, depths)).alias("weights"))
    )
    length = [F.sqrt(F.sum(w * w).over(same_doc)) for w in at]
    unit = rows.withColumn("weights", F.array(*[w / n for w, n in zip(at, length)]))
    sums = [F.sum(w * F.get("earlier.weights", F.lit(i))) for i, w in enumerate(at)]
    similar = (
        unit.withColumn("list", F.collect_list(F.struct("doc_id", "weights")).over(before))
        .select(*key, "doc_id", "weights", F.explode("list").alias("earlier"))
        .groupBy(*key, "doc_id", F.col("earlier.doc_id").alias("nbr_id"))
        .agg(F.array(*[F.round(s, SIMILARITY_DIGITS) for s in sums]).alias("similar"))
    )
    both = F.array(
        F.struct("doc_id", "nbr_id"), F.struct(F.col("nbr_id").alias("doc_id"), F.col("doc_id").alias("nbr_id"))
    )
    near = (
        similar.select(*key, F.explode(both).alias("pair"), "similar")
        .groupBy(*key, "pair.doc_id")
        .agg(F.collect_list(F.struct("pair.nbr_id", "similar")).alias("near"))
    )
    members = (
        lists.select(*key, F.explode("found").alias("f"))
        .select(*key, "f.doc_id", "f.rank", "f.dl")
        .distinct()
        .withColumn("hits", F.collect_list(F.struct("doc_id", "rank")).over(per_query))
    )

    def order(i: int, depth: int) -> Column:
        scored = F.transform("near", lambda n: F.struct((-F.get(n["similar"], F.lit(i))).alias("d"), n["nbr_id"].alias("id")))
        itself = F.array(F.struct(F.lit(-1.0).alias("d"), F.col("doc_id").alias("id")))
        ranked = F.array_sort(F.concat(itself, F.filter(scored, lambda s: s["d"] < 0))).getField("id")
        inside = F.transform(F.filter("hits", lambda h: h["rank"] <= depth), lambda h: h["doc_id"])
        return F.when(F.col("rank") <= depth, F.concat(ranked, F.array_except(F.array_sort(inside), ranked)))

    nothing = F.array().cast(dict(near.dtypes)["near"])
    return (
        members.join(near, [*key, "doc_id"], "left")
        .withColumn("near", F.coalesce("near", nothing))
        .select(*key, "doc_id", "rank", "dl", F.array(*[order(i, d) for i, d in enumerate(depths)]).alias("orders"))
    )


def setting_clusters(orders: DataFrame, grid: Sequence[KnnParams], depths: Sequence[int], key: Sequence[str] = QUERY) -> DataFrame:
    """(key, settings): one row a query with (config_id, avg_length, clusters of (cluster_id, docs, dl)) of each setting.

    A cluster is the first ``n_neighbours`` of a document that occurs in more than ``min_doc_c`` such lists.
    Settings without a cluster are left out.
    """
    graph = orders.groupBy(*key).agg(F.collect_list(F.struct("doc_id", "dl", "orders")).alias("graph"))

    def clusters(params: KnnParams) -> Column:
        depth = F.lit([*depths].index(params.first_ret))
        lists = F.filter(
            F.transform("graph", lambda g: F.struct(
                g["doc_id"].alias("cluster_id"), F.slice(F.get(g["orders"], depth), 1, params.n_neighbours).alias("docs"))),
            lambda c: c["docs"].isNotNull(),
        )
        every = F.flatten(lists.getField("docs"))
        dominant = F.filter(lists, lambda c: F.size(F.filter(every, lambda d: d == c["cluster_id"])) > params.min_doc_c)

        def length(docs: Column) -> Column:
            inside = F.filter("graph", lambda g: F.array_contains(docs, g["doc_id"]))
            return F.aggregate(inside, F.lit(0).cast("long"), lambda total, g: total + g["dl"])

        return F.transform(dominant, lambda c: F.struct(c["cluster_id"].alias("cluster_id"), c["docs"].alias("docs"), length(c["docs"]).alias("dl")))

    held = [f"clusters_{i}" for i in range(1, len(grid) + 1)]
    each = graph.select(*key, *[clusters(p).alias(name) for p, name in zip(grid, held)])

    def setting(i: int, name: str) -> Column:
        total = F.aggregate(F.col(name).getField("dl"), F.lit(0).cast("long"), lambda total, n: total + n)
        return F.struct(F.lit(i).alias("config_id"), (total / F.nullif(F.size(name), F.lit(0))).alias("avg_length"), F.col(name).alias("clusters"))

    settings = F.array(*[setting(i, name) for i, name in enumerate(held, start=1)])
    return each.select(*key, F.filter(settings, lambda s: F.size(s["clusters"]) > 0).alias("settings")).where(F.size("settings") > 0)


def _held_by(found: Column, docs: Column) -> Column:
    """Occurrences of a term in some documents."""
    inside = F.filter(found, lambda f: F.array_contains(docs, f["doc_id"]))
    return F.aggregate(inside, F.lit(0).cast("long"), lambda total, f: total + f["tf"])


def _cluster_df(found: Column, clusters: Column) -> Column:
    """Number of clusters that hold a term."""
    docs = found.getField("doc_id")
    return F.size(F.filter(clusters, lambda c: F.arrays_overlap(c["docs"], docs))).cast("long")


def best_of_settings(
    lists: DataFrame, settings: DataFrame, clauses: DataFrame, key: Sequence[str] = QUERY, bm25: Bm25 = Bm25()
) -> DataFrame:
    """(key, chosen): (config_id, best docs, clusters) of each setting, the best cluster being that of ``best_clusters``."""
    boosts = clauses.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("term", "boost"))).alias("boosts"))
    asked = settings.join(boosts, [*key])
    own = (
        lists.repartition(*key).join(asked, [*key])
        .withColumn("boost", F.try_element_at("boosts", F.col("term")))
        .where(F.col("boost").isNotNull())
        .select(*key, "term", "found", "boost", F.explode("settings").alias("s"))
        .withColumn("df", _cluster_df(F.col("found"), F.col("s.clusters")))
        .select(*key, "found", "boost", "df", "s.config_id", "s.avg_length", F.size("s.clusters").alias("n"), F.explode("s.clusters").alias("c"))
        .withColumn("tf", _held_by(F.col("found"), F.col("c.docs")))
        .where(F.col("tf") > 0)
    )
    part = F.col("boost") * bm25_idf(F.col("n"), F.col("df")) * bm25_saturation(F.col("tf"), F.col("c.dl"), F.col("avg_length"), bm25)
    first = F.min(F.struct((-F.col("score")).alias("minus"), F.col("cluster_id")))
    best = (
        own.groupBy(*key, "config_id", F.col("c.cluster_id").alias("cluster_id"))
        .agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))
        .groupBy(*key, "config_id").agg(first.alias("first"))
        .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("config_id", "first.cluster_id"))).alias("best"))
    )
    chosen = F.transform("settings", lambda s: F.struct(
        s["config_id"].alias("config_id"),
        F.get(F.filter(s["clusters"], lambda c: c["cluster_id"] == F.try_element_at("best", s["config_id"])), F.lit(0))["docs"].alias("docs"),
        s["clusters"].alias("clusters"),
    ))
    return settings.join(best, [*key]).select(*key, F.filter(chosen, lambda s: s["docs"].isNotNull()).alias("chosen"))


def setting_terms(
    lists: DataFrame, chosen: DataFrame, index: TermIndex, grid: Sequence[KnnParams], key: Sequence[str] = QUERY
) -> DataFrame:
    """(config_id, key, term, score, rank): the ``top_n`` terms of each setting's best cluster."""
    scopes = {p.df_scope for p in grid}
    if len(scopes) != 1:
        raise ValueError("one df_scope per grid")
    whole = scopes == {"collection"}
    if whole:
        lists = lists.join(index.statistics.select("term", "df"), "term")
    rows = (
        lists.repartition(*key).join(chosen, [*key])
        .select(*key, "term", "found", *(["df"] if whole else []), F.explode("chosen").alias("s"))
        .withColumn("tf", _held_by(F.col("found"), F.col("s.docs")))
        .where(F.col("tf") > 0)
    )
    if not whole:
        rows = rows.withColumn("df", _cluster_df(F.col("found"), F.col("s.clusters")))
    score = collection_weight(F.col("tf"), F.lit(index.n_docs), F.col("df"))
    order = Window.partitionBy(*key, "config_id").orderBy(F.desc("score"), "term")
    return (
        rows.select(F.col("s.config_id").alias("config_id"), *key, "term", score.alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= setting_value(grid, "top_n"))
    )


def grid_expansion(
    index: TermIndex, clauses: DataFrame, hits: DataFrame, grid: Sequence[KnnParams], key: Sequence[str] = QUERY
) -> DataFrame:
    """Expansion terms of all settings, written: (config_id, key, term, score, rank). ``hits`` are those of the deepest setting."""
    depths = sorted({p.first_ret for p in grid})
    lists = written(term_lists(hits, index.documents, key), "term-lists")
    settings = written(setting_clusters(neighbour_orders(lists, depths, key), grid, depths, key), "settings")
    chosen = written(best_of_settings(lists, settings, clauses, key), "chosen")
    return written(setting_terms(lists, chosen, index, grid, key), "expansion")
