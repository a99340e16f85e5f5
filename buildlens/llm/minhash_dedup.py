"""Near-duplicate documents by HyperMinHash banding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import table
from buildlens.llm.neardup import DOCUMENTS, link, sketch, texts_of

#: The rows of a component meet its least id in so many tasks.
SALTS = 16


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the key of a member (absent, member, row): rows of equal id and text are one.

    Rows without an id are told apart by two hashes of their texts.  No key is null.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.select("doc_id", "text", *_member(F.col("doc_id"), F.col("text")))


def _member(doc_id: Column, text: Column) -> list[Column]:
    doc_id = doc_id.cast("bigint")
    return [doc_id.isNull().alias("absent"), F.coalesce(doc_id, F.xxhash64(F.lit(1), text)).alias("member"), F.xxhash64(text).alias("row")]


def _linked(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_shingles and comp of every row of `docs`, which has the keys and text."""
    return link(sketch(docs, keys, "text", DOCUMENTS), sketch(docs, keys, "text", None), lambda wanted, _: texts_of(docs, wanted, keys, "text"))


def _with_least(rows: DataFrame, of: Column, name: str) -> DataFrame:
    """`rows` with several, whether their comp has several rows, and then the least `of` there.

    Rows of a large component are dealt over SALTS tasks; one of a row, or null, needs no partner.
    """
    least = rows.where("comp is not null").groupBy("comp").agg(F.min(of).alias(name), F.count("*").alias("__n")).where("__n > 1")
    least = least.select("comp", name, F.lit(True).alias("several"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int"))
    return dealt.join(least, ["comp", "__salt"], "left").withColumn("several", F.coalesce("several", F.lit(False)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs`.

    Sets are the distinct 5-word shingles of the lower-cased text (A-Z); with fewer
    words the whole sequence is the one shingle.  Documents are linked at a Jaccard
    similarity of 0.75 or more, confirmed on full sets; component_id is the least id
    reachable, kept marks the rows that bear it.

    Null and empty texts have no shingles: n_shingles 0, linked with nothing, kept.
    A null id takes part in linking; its row is kept only if no other id is in its
    component.  Rows that repeat id and text get equal results.  Rows that repeat an
    id with another text are separate members.  Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = _linked(docs, ["doc_id"])
    out = _with_least(rows, F.col("doc_id"), "least").withColumn("component_id", F.when(F.col("several"), F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` but one a component; a row that repeats id and text stays once.

    Rows that repeat an id with another text are separate members.  The one with the least id
    stays, of equal ids the one with the least hash of its text; rows without an id come last,
    so such a row stays only where no row of its component has an id.  Texts without words are
    in no component and stay.  Other columns may have any names; an empty table gives an empty one.
    """
    keys = ["absent", "member", "row"]
    rows = _linked(_keyed(docs, "doc_id", "text"), keys).where("comp is not null").select(F.struct(*keys).alias("key"), "comp")
    gone = _with_least(rows, F.col("key"), "best").where("several and key <> best").select("key.*").distinct()
    whole = docs.select(F.struct("*").alias("__doc"), *_member(F.col("doc_id"), F.col("text")))
    once = whole.repartition(*keys).dropDuplicates(keys)
    return once.join(gone, keys, "left_anti").select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op4_minhash_dedup": op4_minhash_dedup}


#: Exact: all pairs that share a shingle, and the ids reachable from each by links.
OP4_SQL = """with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
grams as (select distinct doc_id, unnest(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
  when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as gram from w),
sizes as (select doc_id, count(*) as n from grams group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
links as materialized (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as materialized (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reach r join both_ways l on l.a = r.other)
select r.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, min(other) as component_id, r.doc_id = min(other) as kept from reach r left join sizes s on s.doc_id = r.doc_id group by r.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_dedup": OP4_SQL}
