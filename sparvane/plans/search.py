"""The full search of a table of queries: first pass, confidence, expansion, diffusion, part adjustment, adaptive rerank."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..operators import retrieval as V
from ..operators.vectors import cosine


@dataclass(frozen=True)
class Query:
    """What is known of one query: three tiers' vectors, its parts by name, and whether it comes from outside."""

    tier1: Sequence[float]
    tier2: Sequence[float]
    tier3: Sequence[float]
    parts: dict[str, Sequence[float]] | None = None
    external: bool = False


def _tiers(items: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, label, t1, t2, t3): items' scores as tier 2, cosines to the query as tiers 1 and 3."""
    own = corpus.select("id", "label", F.col("tier1").alias("_c1"), F.col("tier3").alias("_c3"))
    asked = queries.select("query", F.col("tier1").alias("_q1"), F.col("tier3").alias("_q3"))
    both = items.select("query", "id", F.col("score").alias("t2")).join(own, "id").join(asked, "query")
    return both.select("query", "id", "label", cosine(F.col("_c1"), F.col("_q1")).alias("t1"), "t2", cosine(F.col("_c3"), F.col("_q3")).alias("t3"))


def search_table(
    corpus: DataFrame, queries: DataFrame, k: int = 10, graph: DataFrame | None = None, part_weights: dict[str, float] | None = None,
    weights: tuple[float, float, float] = (0.15, 0.70, 0.15), least: float = 0.80, prototypes: DataFrame | None = None,
) -> DataFrame:
    """(query, id, label, fused, rank) of k rows for every query.

    corpus has (id, label, tier1, tier2, tier3, parts: map of part to vector), queries (query, tier1, tier2, tier3, parts, external). An
    unsure query from outside is ranked by tier 2 over a wider pool. Any other is expanded by its first hits, spread over the neighbour
    graph, moderated by parts, and reranked by all tiers, with weights that follow its confidence and its best prototype. Pools, confidence
    and margins are windows by query, so the work is that of the searches for all of them together. First hits and pools are written
    to the shared folder, k rows or 20 a query.
    """

    def nearest(asked: DataFrame, n: int) -> DataFrame:
        return V.nearest(asked, corpus, n, "query", "tier2", corpus_key="id", corpus_vec="tier2")

    queries = queries.withColumn("external", F.coalesce("external", F.lit(False)))
    first = shared.materialize(nearest(queries, max(k, 20)), "search-first")
    flags = V.confidence(first.withColumnRenamed("src", "query").join(queries.select("query", "external"), "query"), least, external=F.col("external"), by=["query", "external"])
    risky = flags.filter("risk").select("query")
    wide = nearest(queries.join(risky, "query", "left_semi"), max(20 * k, 120)).select(F.col("src").alias("query"), F.col("dst").alias("id"), "score")
    unsure = V.rerank(_tiers(wide, corpus, queries), (0.0, 1.0, 0.0), ["query"], adaptive=False)

    sure = queries.join(risky, "query", "left_anti")
    wider = V.expand_queries(sure, corpus, first, key="query", vec="tier2", corpus_key="id")
    items = nearest(wider, max(k, 20)).select(F.col("src").alias("query"), F.col("dst").alias("id"), "score")
    if graph is not None:
        items = V.diffuse(graph, items, by=["query"])
    if part_weights:
        total = sum(part_weights.values())
        named = corpus.select("id", F.explode("parts").alias("part", "vec"))
        own = sure.select("query", F.explode("parts").alias("part", "vec"))
        moderated = V.part_adjust(items, own, named, {p: w / total for p, w in part_weights.items()}, by=["query"])
        # a query without parts keeps its scores
        has = own.select("query").distinct()
        items = moderated.join(has, "query", "left_semi").unionByName(items.join(has, "query", "left_anti"))
    items = shared.materialize(items, "search-items")
    after = V.confidence(items, least, by=["query"]).select("query", "low")
    protos = prototypes if prototypes is not None else V.prototypes(corpus, "label", "tier2")
    best = V.prototype_scores(protos, sure, "label", "query", "tier2").filter("rank = 1").select(F.col("src").alias("query"), F.col("label").alias("_label"), F.col("score").alias("_score"), F.col("margin").alias("_margin"))
    known = _tiers(items, corpus, sure).join(after, "query", "left").join(best, "query", "left")
    ranked = V.rerank(known, V.rerank_weights(weights), ["query"], F.col("low"), F.col("_label"), F.col("_score"), F.col("_margin"))
    columns = ["query", "id", "label", "fused", "rank"]
    return ranked.select(columns).unionByName(unsure.select(columns)).filter(F.col("rank") <= k)


def adaptive_search(
    corpus: DataFrame, query: Query, k: int = 10, graph: DataFrame | None = None, part_weights: dict[str, float] | None = None,
    weights: tuple[float, float, float] = (0.15, 0.70, 0.15), least: float = 0.80, prototypes: DataFrame | None = None,
) -> DataFrame:
    """(id, label, fused, rank) of k rows for one query: search_table with a table of one row."""
    tiers = [[float(x) for x in t] for t in (query.tier1, query.tier2, query.tier3)]
    parts = {p: [float(x) for x in v] for p, v in (query.parts or {}).items()}
    schema = "query long, tier1 array<double>, tier2 array<double>, tier3 array<double>, parts map<string,array<double>>, external boolean"
    table = corpus.sparkSession.createDataFrame([(0, *tiers, parts, query.external)], schema)
    return search_table(corpus, table, k, graph, part_weights, weights, least, prototypes).drop("query")


def species_rank(hits: DataFrame, names: DataFrame, keyword: str) -> DataFrame:
    """(rank, name) of the first hit whose class name holds a keyword; no row where none does."""
    found = hits.join(names, "label").filter(F.contains(F.lower("name"), F.lit(keyword.lower())))
    return found.orderBy("rank").select("rank", "name").limit(1)
