"""The dealt operators as named queries over the input tables, and SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm import decontamination, html, language, mixing, neighbours, quality, ranked, sentencepiece, sharding, simhash, toxicity, warc, whitening
from snapledger.llm.common import fold, table
from snapledger.llm.training import labelled, language_model, quality_model
from snapledger.queries.registry import Query

LLM: dict[str, Query] = {}

PIECES = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def register(build):
        LLM[name] = Query(name, build, sql)
        return build

    return register


OP1_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages
), f as (select d, min(page_id) as first from p where n >= 100 group by d)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when f.first <> p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first <> p.page_id then f.first end as refers_to
from p left join f on p.d = f.d and p.n >= 100
"""


@query("op1_warc", OP1_SQL)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages as archives, read the archives back."""
    pages = table(spark, folder, "pages")
    where = warc.archive_folder(spark)
    found = warc.read_archives(spark, where, warc.write_archives(pages, where))
    return found.select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = sentencepiece.encoded(docs, public_tokenizers.path(PIECES), digests=True)
    return coded.select("doc_id", "tokens.*")


@query("op3_html")
def op3_html(spark: SparkSession, folder: str) -> DataFrame:
    found = html.extracted(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "main.text", "main.n_chars")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    model = toxicity.fit(labelled(spark, folder, 5, 0, "toxic"))
    found = toxicity.scored(table(spark, folder, "documents").select("doc_id", "text"), model, out="score")
    return found.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


OP5_SQL = """
with lowered as (
  select 'd' as side, doc_id as id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all select 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
), w as (
  select side, id, coalesce(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as ws from lowered
), win as (
  select distinct id as item, least(10, len(ws)) as m, array_to_string(ws[k : k + least(10, len(ws)) - 1], ' ') as g
  from w, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) as r(k) where side = 'b' and len(ws) > 0
), sizes as (select distinct m from win
), dw as (
  select id, m, k, array_to_string(ws[k : k + m - 1], ' ') as g
  from w, sizes, unnest(range(1, len(ws) - m + 2)) as r(k) where side = 'd' and len(ws) >= m
), hit as (select dw.id, dw.m, dw.k, win.item from dw join win on dw.m = win.m and dw.g = win.g
), words as (select distinct id, p from hit, unnest(range(k, k + m)) as r(p)
), nh as (select id, count(*) as n from words group by id
), it as (select id, list_sort(list(distinct cast(item as varchar))) as items from hit group by id)
select w.id as doc_id, cast(len(w.ws) as bigint) as n_words, cast(coalesce(nh.n, 0) as bigint) as n_hit,
  cast(coalesce(len(it.items), 0) as bigint) as n_items, sha256(coalesce(array_to_string(it.items, ','), '')) as items_sha256,
  coalesce(nh.n, 0) > 0 as contaminated
from w left join nh on w.id = nh.id left join it on w.id = it.id where w.side = 'd'
"""


@query("op5_decontamination", OP5_SQL)
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.contaminated(docs, table(spark, folder, "benchmark"))
    hit = decontamination.hit_words(F.col("hits.spans"))
    return found.select(
        "doc_id", "hits.n_words", hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hits.items")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query("op6_language")
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    found = language.identified(table(spark, folder, "documents").select("doc_id", "text"), language_model(spark, folder))
    return found.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score"
    )


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    found = quality.scored(docs, quality_model(spark, folder), out="score")
    return found.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op8_simhash")
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


OP9_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e,
    label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0 as good
  from embeddings
), link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and a.good and b.good
  where list_cosine_similarity(a.e, b.e) >= 0.93
), walk as (select vec_id as origin, vec_id as reached from v union select walk.origin, link.b from walk join link on walk.reached = link.a
), smallest as (select origin, min(reached) as c from walk group by origin
), n as (select a, count(*) as n from link group by a)
select v.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, smallest.c as component_id, v.vec_id = smallest.c as kept
from v left join n on v.vec_id = n.a join smallest on v.vec_id = smallest.origin
"""


@query("op9_neighbours", OP9_SQL)
def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = neighbours.near_vectors(table(spark, folder, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )


@query("op10_sharding")
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(table(spark, folder, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP11_SQL = """
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws
  from documents
), i as (
  select row_number() over () as q, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws
  from benchmark
), asked as (select q, item_id, w, count(*) as times from (select q, item_id, unnest(ws) as w from i) group by q, item_id, w
), held as (select r, doc_id, cast(len(ws) as bigint) as n from d where len(ws) > 0
), sums as (select count(*) as docs, cast(sum(n) as bigint) as terms from held
), tf as (select r, w, count(*) as tf from (select r, unnest(ws) as w from d) where w in (select w from asked) group by r, w
), weight as (select w, cast(floor(1000 * ln((2 * docs + 2) / cast(2 * count(*) + 1 as double))) as bigint) as weight from tf, sums group by w, docs
), m as (select r, doc_id, 25 + (75 * n * docs) // terms as m from held, sums
), scored as (
  select q, item_id, doc_id, tf.r, cast(sum(times * weight * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m))) as bigint) as score
  from asked join tf on asked.w = tf.w join weight on tf.w = weight.w join m on tf.r = m.r group by q, item_id, doc_id, tf.r
), placed as (select *, row_number() over (partition by q order by score desc, doc_id, r) as rank from scored where score > 0
)
select item_id, cast(rank as int) as rank, doc_id, score from placed where rank <= 10
"""


@query("op11_ranked_search", OP11_SQL)
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    found = ranked.best(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 10)
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whitened(table(spark, folder, "embeddings"), components=16, weights="one")
    return found.select(
        F.col("id").alias("vec_id"), "component", "n", "deviation", F.col("value").alias("whitened"), "explained", "identity_error")


OP13_SQL = """
with d as (
  select doc_id, source, cast(len(coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [])) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), '') || ' ' || coalesce(text, '')) as turn
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size,
    cast([5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as double) as weight,
    row_number() over (order by source nulls last) as place
  from d group by source
), o as (
  select *, 1.5 * cast((select sum(source_size) from s) as double) as whole,
    coalesce(cast(sum(2 * source_size) over (order by source_size / weight, place rows between unbounded preceding and 1 preceding) as double), 0) as stopped,
    sum(weight) over (order by source_size / weight, place rows between current row and unbounded following) as rest,
    row_number() over (order by source_size / weight, place) as turn
  from s
), f as (select min(turn) as turn from o where weight * (whole - stopped) <= 2 * source_size * rest
), t as (
  select o.source, o.source_size,
    cast(case when o.turn < f.turn then 2 * o.source_size else o.weight * (c.whole - c.stopped) / c.rest end as double) as target
  from o, f join o as c on c.turn = f.turn
), p as (
  select doc_id, size, source, turn,
    cast(sum(size) over (partition by source order by turn, doc_id rows unbounded preceding) as bigint) - size as start
  from d
)
select p.doc_id, p.size, t.source_size, t.target,
  cast(greatest(0, least(p.size, cast(floor(t.target) as bigint) - p.start))
    + greatest(0, least(p.size, cast(floor(t.target) as bigint) - t.source_size - p.start)) as bigint) as taken
from p join t on p.source is not distinct from t.source
"""


@query("op13_source_mixing", OP13_SQL)
def op13_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken of every document; the SQL finds them from the documents' positions, without blocks or slots."""
    docs = mixing.sized(table(spark, folder, "documents"))
    return mixing.taken(docs, mixing.targets(docs)).withColumnRenamed("id", "doc_id")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
