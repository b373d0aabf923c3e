"""The queries opN_... and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, embeddings, jaccard, language, lines, lmscore, pieces, secrets, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(_table(spark, sf_dir, "documents"), 20).drop("removed")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_links(_table(spark, sf_dir, "embeddings"), 0.98)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(_table(spark, sf_dir, "documents"), 3, 90, 100)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


OP1_SQL = r"""
with w as (
  select doc_id, case when text is null then [] else regexp_extract_all(text, '[^\x20\x09-\x0D]+') end as words from documents
), g as (
  select doc_id, i - 1 as start, array_to_string(words[i:i + 19], ' ') as gram
  from w, unnest(range(1, len(words) - 18)) as r(i) where len(words) >= 20
), late as (
  select doc_id, start from (select doc_id, start, row_number() over (partition by gram order by doc_id, start) as rn from g) where rn > 1
), gone as (
  select distinct doc_id, start + k as pos from late, unnest(range(0, 20)) as r(k)
), flat as (
  select doc_id, i - 1 as pos, words[i] as word from w, unnest(range(1, len(words) + 1)) as r(i)
), kept as (
  select f.doc_id, string_agg(f.word, ' ' order by f.pos) as text, count(*) as n
  from flat f left join gone using (doc_id, pos) where gone.pos is null group by f.doc_id
)
select w.doc_id, len(w.words) as n_words, len(w.words) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id)
"""

OP6_SQL = r"""
with w as (
  select doc_id, case when text is null then [] else regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') end as words from documents
), b as (
  select item_id, case when text is null then [] else regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') end as words from benchmark
), grams as (
  select distinct item_id, least(len(words), 10) as k, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') as gram
  from b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as r(i) where len(words) > 0
), lens as (select distinct k from grams), dg as (
  select doc_id, i - 1 as start, k, array_to_string(words[i:i + k - 1], ' ') as gram
  from w, lens, unnest(range(1, greatest(len(words) - k + 2, 1))) as r(i) where len(words) >= k
), hits as (
  select dg.doc_id, dg.start, dg.k, grams.item_id from dg join grams using (k, gram)
), words as (
  select doc_id, count(distinct start + j) as n_hit from hits, unnest(range(0, k)) as r(j) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select w.doc_id, len(w.words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join words using (doc_id) left join items using (doc_id)
"""

OP8_SQL = r"""
with recursive w as (
  select doc_id, case when text is null then [] else regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') end as words from documents
), s as (
  select distinct doc_id, array_to_string(words[i:i + 2], ' ') as gram from w, unnest(range(1, greatest(len(words) - 2, 1) + 1)) as r(i) where len(words) > 0
), n as (select doc_id, count(*) as n from s group by doc_id
), common as (
  select a.doc_id as x, b.doc_id as y, count(*) as n2 from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by all
), links as (
  select x, y from common join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * n2 >= 90 * (nx.n + ny.n - n2)
), edges as (select x, y from links union all select y, x from links
), reach as (
  select doc_id as id, doc_id as root from n union select edges.y, reach.root from reach join edges on edges.x = reach.id
), c as (select id, min(root) as root from reach group by id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.root, w.doc_id) as component_id
from w left join n using (doc_id) left join c on c.id = w.doc_id
"""

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op7_token_counts": op7_token_counts,
    "op6_decontaminate": op6_decontaminate,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_secret_scan": op9_secret_scan,
    "op10_lm_score": op10_lm_score,
    "pipeline": pipeline,
}
ORACLES = {"op1_substring_dedup": OP1_SQL, "op6_decontaminate": OP6_SQL, "op8_jaccard_join": OP8_SQL, "op9_secret_scan": secrets.sql()}
