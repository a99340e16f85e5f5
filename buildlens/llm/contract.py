"""The columns of operators 5, 7 and 9 that SQL can express, as queries of their own with their SQL.

Each query is the operator's, less the columns that a trained model fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.line_crf import op5_line_crf
from buildlens.llm.lm_scoring import op9_lm_scoring
from buildlens.llm.pii import op7_pii


def base5_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_line_crf(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def base9_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


_WORD = r"[^\x20\x09-\x0D]+"

BASE5_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
l as (select r, unnest(string_split(t, chr(10))) as line from d),
lines as (select r, count(*) - count(distinct line) as dup from l where regexp_matches(line, '{_WORD}') group by 1),
g as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select r, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from g) where n > 1),
covered as (select r, count(distinct p) as n from (select r, i + unnest([0, 1, 2]) as p from twice) group by 1)
select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(dup, 0) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) as base_failed
from d left join lines using (r) left join covered using (r)"""

#: Matches and what stands between them give the places; whatever fails its check goes afterwards.
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LUHN = "list_sum(list_transform(range(1, len(digits) + 1), lambda i: case when i % 2 = 1 then digits[-i]::int when digits[-i]::int > 4 then digits[-i]::int * 2 - 9 else digits[-i]::int * 2 end)) % 10 = 0"

BASE7_SQL = (
    "with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),\nm as ("
    + "\nunion all ".join(f"select r, {k} as k, '{kind}' as kind, regexp_extract_all(t, '{p}') as found, regexp_split_to_array(t, '{p}') as between from d where regexp_matches(t, '{p}')" for k, (kind, p) in enumerate(_KINDS.items()))
    + rf"""),
p as (select r, k, kind, found[i] as s, list_sum(list_transform(between[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)::bigint as a
  from (select *, unnest(range(1, len(found) + 1)) as i from m)),
c as (select *, a + length(s) as z, regexp_replace(s, '[^0-9]', '', 'g') as digits from p),
ok as (select * from c where case kind when 'email' then true when 'ip' then len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(ltrim(x, '0') as bigint), 0) > 255)) = 0
  when 'card' then length(digits) between 14 and 19 and {_LUHN} else length(digits) between 10 and 15 end),
j as (select r, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in _KINDS)}, string_agg(kind || ':' || a || ':' || z, ',' order by a, k) as spans from ok group by 1)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in _KINDS)}, sha256(coalesce(spans, '')) as base_sha256 from d left join j using (r)"""
)

_CRC32 = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)"

BASE9_SQL = rf"""
with d as materialized (select row_number() over () as r, doc_id, {_CRC32} % 5 = 1 as held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), null) as w from documents),
t as materialized (select r, held_out, unnest(w) as x from d),
c as materialized (select x, count(*) as c from t where not held_out group by 1),
n as (select sum(c)::bigint as n, count(*) as v from c),
s as (select r, count(*) as n_tokens, count(c) as n_known, sum(log10((coalesce(c, 0) + 0.5::double) / (n + 0.5::double * (v + 1)))) as base from t left join c on c.x is not distinct from t.x cross join n group by 1)
select doc_id, held_out, n_tokens, n_known, n as train_tokens, round(base, 4) as base_score from d join s using (r) cross join n"""


def queries() -> dict:
    return {"base5_text_counts": base5_text_counts, "base7_spans": base7_spans, "base9_word_scores": base9_word_scores}


def oracle_sql() -> dict[str, str]:
    return {"base5_text_counts": BASE5_SQL, "base7_spans": BASE7_SQL, "base9_word_scores": BASE9_SQL}
