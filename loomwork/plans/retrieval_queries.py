"""Retrieval, vector and graph queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import nearest, similar_pairs
from ..operators import graph as G
from ..operators import retrieval as R
from ..sources.shared import cut
from ..sources.tables import table


def bm25_scores(s: SparkSession, d: str) -> DataFrame:
    """The query set, benchmark items whose id is divisible by 100, against every document."""
    queries = R.query_terms(table(s, d, "benchmark").where("item_id % 100 = 0"))
    return R.bm25(table(s, d, "documents"), queries).withColumn("score", F.round("score", 6))


TOK = r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+'))"
BM25 = rf"""tok as (select doc_id, unnest(case when len(t) > 0 then t else ['__empty__'] end) as term from (
    select doc_id, {TOK.format(c='text')} as t from documents)),
  post as (select doc_id, term, count(*) as tf from tok group by 1, 2),
  len as (select doc_id, sum(tf) as dl from post group by 1),
  terms as (select term, ln((select count(*) from len) - count(*) + 0.5) - ln(count(*) + 0.5) as idf from post group by 1),
  q as (select query_id, term, count(*) as n from (
    select item_id as query_id, unnest({TOK.format(c='text')}) as term from benchmark where item_id % 100 = 0) group by 1, 2),
  w as (select query_id, term, n, case when idf < 0 then 0.25 * (select avg(idf) from terms) else idf end as idf from terms join q using (term)),
  hit as (select query_id, doc_id, round(sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (select avg(dl) from len)))), 6) as score
    from post join w using (term) join len using (doc_id) group by 1, 2),
  bm as (select query_id, doc_id, coalesce(score, 0) as score from documents
    cross join (select item_id as query_id from benchmark where item_id % 100 = 0) left join hit using (query_id, doc_id))"""


def top5(s, d):
    return R.best(bm25_scores(s, d), "score", "doc_id", 5, "query_id")


def fused(s, d):
    rows = bm25_scores(s, d).join(table(s, d, "documents").select("doc_id", F.col("n_chars").alias("size")), "doc_id")
    return R.fused(rows, "score", "size", by="query_id").select("query_id", "doc_id", "r1", "r2", F.round("rrf", 9).alias("rrf"))


def chosen(s, d):
    return R.candidates(bm25_scores(s, d), "score", "doc_id", 3, 8.0, by="query_id")


def normalised(s, d):
    return R.min_max(bm25_scores(s, d), "score", "scaled", "query_id").withColumn("scaled", F.round("scaled", 6))


def weighted(s, d):
    r = bm25_scores(s, d).withColumn("importance", (F.col("doc_id") % 5) / 4)
    return r.select("query_id", "doc_id", F.round(R.with_importance(F.round("score", 3), F.col("importance")) + 1e-7, 5).alias("score"))


def emb(s, d):
    return table(s, d, "embeddings")


DOT = "list_dot_product(cast({a} as double[]), cast({b} as double[]))"
PAIRS = f"""pr as (select a.vec_id as a, b.vec_id as b, {DOT.format(a='a.embedding', b='b.embedding')} as sim
  from embeddings a join embeddings b on a.vec_id < b.vec_id where {DOT.format(a='a.embedding', b='b.embedding')} >= 0.3),
  edges as (select source, target, sim as weight from (
    select *, row_number() over (partition by source order by sim desc, target) as rn from (
      select a as source, b as target, round(sim, 9) as sim from pr union all select b, a, round(sim, 9) from pr)) where rn <= 5)"""


def edges(s, d):
    return G.embedding_edges(emb(s, d), "vec_id", "embedding", 5, 0.30)


def query_vectors(s, d):
    """The query set: vectors whose id is divisible by 100."""
    return emb(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def vectors_of(s, d):
    return emb(s, d).select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("v"))


def page_decision(s, d):
    """Chunks (vectors) of pages (labels) against each query vector: best scores, the five best chunks and the decision."""
    out = R.page_decisions(query_vectors(s, d), vectors_of(s, d), 0.35, 0.25)
    ids = F.array_join(F.transform("top", lambda x: x["id"].cast("string")), ",")
    return out.select("query_id", F.col("group").cast("int").alias("label"), F.round("best", 6).alias("best"), F.col("above").alias("medium"), "decision", ids.alias("top5"))


def nearest_query(s, d):
    return nearest(query_vectors(s, d), vectors_of(s, d), 10).select("query_id", F.col("id").alias("vec_id"), "sim")


def seeds(s, d):
    return emb(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), (1.0 - F.col("vec_id") % 7 / 14).alias("score"))


def propagated(s, d):
    return G.propagate(cut(edges(s, d)), seeds(s, d), floor=0.001).withColumn("boost", F.round("boost", 6))


def final_scores(s, d):
    return G.boosted(seeds(s, d), cut(G.propagate(cut(edges(s, d)), seeds(s, d), floor=0.001)), 0.01).withColumn("final", F.round("final", 6))


PROP = f"""with {PAIRS},
  deg as (select source, count(*) as k from edges group by 1),
  step as (select e.source, target, weight * 0.45 / k as f from edges e join deg using (source)),
  h0 as (select vec_id as id, 1.0 - vec_id % 7 / 14 as score from embeddings where vec_id % 100 = 0),
  h1 as (select target as id, score * f as score from h0 join step on id = source where score * f >= 0.001),
  h2 as (select target as id, score * f as score from h1 join step on id = source where score * f >= 0.001),
  h3 as (select target as id, score * f as score from h2 join step on id = source where score * f >= 0.001),
  boost as (select id, sum(score) as boost from (select * from h1 union all select * from h2 union all select * from h3) group by id)"""


def item_words(s, d):
    return table(s, d, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("word"))


def duplicates(s, d):
    pairs = similar_pairs(emb(s, d), "vec_id", "embedding", 0.4)
    lengths = emb(s, d).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7).alias("length"))
    return G.greedy_duplicates(pairs, lengths)


QUERIES = {
    "bm25_top5": (top5, f"with {BM25} select query_id, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rn from bm) where rn <= 5"),
    "bm25_scores": (bm25_scores, f"with {BM25} select * from bm"),
    "rank_fusion": (
        fused,
        f"""with {BM25}, r as (select query_id, doc_id, rank() over (partition by query_id order by score desc) as r1, rank() over (partition by query_id order by n_chars desc) as r2 from bm join documents using (doc_id))
select query_id, doc_id, cast(r1 as int) as r1, cast(r2 as int) as r2, round(1.0 / (60 + r1) + 2.0 / (60 + r2), 9) as rrf from r""",
    ),
    "candidate_choice": (
        chosen,
        f"with {BM25} select query_id, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rn from bm) where rn <= 3 or score >= 8.0",
    ),
    "min_max_scores": (
        normalised,
        f"with {BM25} select query_id, doc_id, score, coalesce(round((score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0), 6), 0) as scaled from bm window w as (partition by query_id)",
    ),
    "importance_weights": (weighted, f"with {BM25} select query_id, doc_id, round(round(score, 3) * (0.5 + 0.5 * ((doc_id % 5) / 4)) + 1e-7, 5) as score from bm"),
    "embedding_edges": (
        lambda s, d: edges(s, d).withColumn("weight", F.round("weight", 6)),
        f"with {PAIRS} select source, target, round(weight, 6) as weight from edges",
    ),
    "similar_pairs": (
        lambda s, d: similar_pairs(emb(s, d), "vec_id", "embedding", 0.3).withColumn("sim", F.round("sim", 6)),
        f"with {PAIRS} select a, b, round(sim, 6) as sim from pr",
    ),
    "nearest_vectors": (
        nearest_query,
        f"""select query_id, vec_id, sim from (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rn from (
  select a.vec_id as query_id, b.vec_id, round(greatest(0.0, {DOT.format(a='a.embedding', b='b.embedding')}), 6) as sim
  from embeddings a join embeddings b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id)) where rn <= 10""",
    ),
    "page_decision": (
        page_decision,
        f"""select query_id, label, round(best, 6) as best, medium, case when best >= 0.35 then 'single_chunk_high' when medium >= 3 then 'multi_chunk_medium' end as decision, top5
from (select query_id, label, max(m) as best, count(*) filter (m >= 0.25) as medium, array_to_string(list(vec_id order by m desc, vec_id)[1:5], ',') as top5 from (
  select q.vec_id as query_id, e.label, e.vec_id, {DOT.format(a='e.embedding', b='q.embedding')} as m
  from embeddings e join embeddings q on q.vec_id % 100 = 0 and e.vec_id <> q.vec_id) group by 1, 2)""",
    ),
    "graph_propagation": (propagated, f"{PROP} select id, round(boost, 6) as boost from boost"),
    "boosted_scores": (
        final_scores,
        f"""{PROP} select h0.id, round(score + greatest(0.0, coalesce(boost, 0)), 6) as final from h0 left join boost using (id)
union all select id, round(boost, 6) from boost where boost >= 0.01 and id not in (select id from h0)""",
    ),
    "graph_degrees": (
        lambda s, d: G.degrees(cut(edges(s, d))),
        f"with {PAIRS} select id, count(*) as degree from (select source as id, source, target from edges union select target, source, target from edges) group by id",
    ),
    "jaccard_edges": (
        lambda s, d: G.jaccard_edges(item_words(s, d), "item_id", "word", 0.1).withColumn("weight", F.round("weight", 6)),
        rf"""with w as (select distinct item_id, unnest({TOK.format(c='text')}) as word from benchmark), n as (select item_id, count(*) as n from w group by 1)
select a.item_id as source, b.item_id as target, round(0.8 * count(*) / (na.n + nb.n - count(*)), 6) as weight
from w a join w b on a.word = b.word and a.item_id <> b.item_id join n na on na.item_id = a.item_id join n nb on nb.item_id = b.item_id
group by a.item_id, b.item_id, na.n, nb.n having count(*) / (na.n + nb.n - count(*)) >= 0.1""",
    ),
    "greedy_duplicates": (duplicates, None),
}
