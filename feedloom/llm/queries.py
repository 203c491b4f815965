"""Registered queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, copies, garbled, languages, leaks, lookalikes, mixing, neighbours, personal

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(_table(spark, sf_dir, "embedding_cache"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "raw_review")
    clean = _table(spark, sf_dir, "clean_review")
    # title and body are read in one pass; an item in one never depends on the other
    both = raw.select(F.lit("raw_review").alias("tbl"), F.col("seq").alias("row_id"), F.explode(F.array(F.struct(F.lit("title").alias("field_name"), F.col("title").alias("text")), F.struct(F.lit("body").alias("field_name"), F.col("body").alias("text")))).alias("f"))
    one = clean.select(F.lit("clean_review").alias("tbl"), F.col("seq").alias("row_id"), F.lit("text").alias("field_name"), "text")
    return both.select("tbl", "row_id", "f.field_name", "f.text").unionByName(one)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_data(_fields(spark, sf_dir))
    return found.select("tbl", "row_id", "field_name", F.explode("kinds").alias("pii_kind"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_data(_fields(spark, sf_dir)).select("tbl", "row_id", "field_name", "n_items", "redacted")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "raw_review").select(F.lit("raw_review").alias("tbl"), F.col("seq").alias("row_id"), F.col("body").alias("text"))
    clean = _table(spark, sf_dir, "clean_review").select(F.lit("clean_review").alias("tbl"), F.col("seq").alias("row_id"), "text")
    return raw.unionByName(clean)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_pairs(_texts(spark, sf_dir))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_classes(_texts(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.similarity_clusters(_table(spark, sf_dir, "embedding_cache"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_report(_table(spark, sf_dir, "embedding_cache"))


def p4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.mixture_clusters(_table(spark, sf_dir, "embedding_cache"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = copies.copy_sets(_table(spark, sf_dir, "clean_review"), "seq", ["text"])
    return sets.select(F.col("keep").alias("keep_seq"), F.col("copy").alias("copy_seq"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapsed(_table(spark, sf_dir, "clean_review"), "seq", ["text"]).select("seq", "review_id", "n_copies")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews fetched or posted again: records of three fields, so words only count within their field."""
    sets = copies.copy_sets(_table(spark, sf_dir, "raw_review"), "seq", ["title", "body", "product"])
    return sets.select(F.col("keep").alias("keep_seq"), F.col("copy").alias("copy_seq"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.wrong_labels(_table(spark, sf_dir, "raw_review"))


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_segments(_table(spark, sf_dir, "raw_review"), "seq", "body", "locale").withColumnRenamed("key", "seq")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_item")).select("item_id", "doc_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_item")
    return leaks.with_answers(leaks.leaked_items(docs, items), docs, items, "expected_theme")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = mixing.mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_target"))
    return used.select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_target"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_documents(_table(spark, sf_dir, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    every = (p1_found, p2_found, p2_redacted, p3_found, p3_classes, p4_found, p4_report, p4_mixture, p5_found, p5_counts, p5_records, p6_found, p6_segments, p7_found, p7_report, p8_mix, p8_shares, p9_found, p9_restored)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    bag = "list_sort(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))"
    sets = f"with b as (select seq, review_id, {bag} as bag from clean_review), g as (select seq, review_id, len(bag) as n, min(seq) over (partition by bag) as keep, count(*) over (partition by bag) as c from b)"
    item_words = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"

    def runs(key: str, table: str) -> str:
        return f"select distinct {key}, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))) as run from (select {key}, {item_words} as w from {table}) where len(w) >= 10"

    leaked = f"with a as ({runs('item_id', 'eval_item')}), b as ({runs('doc_id', 'documents')})"
    old, new, gone = lookalikes.tables()
    form = "text"
    for ligature, letters in lookalikes.LIGATURES.items():
        form = f"replace({form}, '{ligature}', '{letters}')"
    form = f"nfc_normalize(translate({form}, '{old + gone}', '{new.replace(chr(39), chr(39) * 2)}'))"
    # exact where the index has one leaf, as on the small tables
    unit = """
      v as (select model_version, cache_id, list_transform(vector, lambda x: x::double) as x from embedding_cache
        where vector is not null and len(vector) = dim and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
      u as (select model_version, cache_id, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) as x from v),
      c as (select a.cache_id as a, b.cache_id as b, round(list_dot_product(a.x, b.x), 9) as cos from u a join u b on a.model_version = b.model_version and a.cache_id <> b.cache_id)"""
    return {
        "p1_found": f"with {unit}, t as (select a, b from (select *, row_number() over (partition by a order by cos desc, b) as k from c) where k <= 5 and cos >= 0.75) select distinct least(a, b) as cache_a, greatest(a, b) as cache_b from t",
        "p3_found": f"""
          with t as (select 'raw_review' as tbl, seq, body as text from raw_review union all select 'clean_review', seq, text from clean_review),
          m as (select tbl, seq, text, {form} as form from t where text is not null)
          select distinct a.tbl, a.seq as row_a, b.seq as row_b from m a join m b on a.tbl = b.tbl and a.form = b.form and a.seq < b.seq and a.text <> b.text""",
        "p3_classes": f"""
          with t as (select 'raw_review' as tbl, seq, body as text from raw_review union all select 'clean_review', seq, text from clean_review),
          m as (select tbl, seq, text, {form} as form from t where text is not null),
          k as (select tbl, form, min(seq) as class_id, count(*) as class_rows, count(distinct text) as class_texts from m group by 1, 2 having count(distinct text) > 1)
          select tbl, seq as row_id, class_id, class_rows, class_texts from m join k using (tbl, form)""",
        "p4_found": f"""
          with recursive {unit}, e as (select a, b from c where cos >= 0.75), r as (select a, a as b from e union select r.a, e.b from r join e on r.b = e.a),
          k as (select a as cache_id, min(b) as cluster_key from r group by 1)
          select cluster_key, cache_id from k where cluster_key in (select cluster_key from k group by 1 having count(*) >= 5)""",
        "p7_found": f"{leaked} select distinct item_id, doc_id from a join b using (run)",
        "p7_report": f"""{leaked}, n as (select item_id, count(*) as item_runs from a group by 1),
          l as (select item_id, doc_id, count(*) as runs, max(item_runs) as item_runs from a join b using (run) join n using (item_id) group by 1, 2)
          select l.*, contains(' ' || array_to_string({item_words.replace('text', 'd.text')}, ' ') || ' ', ' ' || array_to_string({item_words.replace('text', 'e.expected_theme')}, ' ') || ' ') as answer_found
          from l join documents d using (doc_id) join eval_item e using (item_id)""",
        "p5_found": f"{sets} select keep as keep_seq, seq as copy_seq from g where n > 0 and seq <> keep",
        "p5_records": f"""
          with b as (select seq, {', '.join(f"{bag.replace('text', f'coalesce({c}, chr(32))')} as b_{c}" for c in ('title', 'body', 'product'))} from raw_review),
          g as (select seq, len(b_title) + len(b_body) + len(b_product) as n, min(seq) over (partition by b_title, b_body, b_product) as keep from b)
          select keep as keep_seq, seq as copy_seq from g where n > 0 and seq <> keep""",
        "p5_counts": f"{sets} select seq, review_id, case when n > 0 then c else 1 end as n_copies from g where seq = keep or n = 0",
    }
