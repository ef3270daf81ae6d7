"""The operators as queries over the given tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.llm.collocations import collocations
from cellgauge.llm.contamination import contaminations
from cellgauge.llm.licences import license_scan
from cellgauge.llm.mixing import mix_plan
from cellgauge.llm.negatives import hard_negatives
from cellgauge.llm.packing import pack_documents
from cellgauge.llm.passages import shared_passages
from cellgauge.llm.quality import quality_rules
from cellgauge.llm.simhash import simhash_components
from cellgauge.llm.suffixes import substring_dedup
from cellgauge.llm.tokens import token_counts
from cellgauge.llm.urls import judge_urls
from cellgauge.llm.warc import archive_folder, read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _queries[name] = fn
        if sql is not None:
            _oracle[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Labels as outcomes of the page of the same number: bad if of low quality or toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


@query("op5_warc")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return read_archives(write_archives(pages, archive_folder(pages)), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def trusted_documents(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and toxic = 0").select("doc_id")


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), trusted_documents(table(spark, sf_dir, "labels")))


@query("op8_mix_sources", r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix-' || coalesce(doc_id::varchar, '')) as draw from documents),
s as (
  select source, sum(size)::bigint as source_size, count(*) as n, 3 * sum(size)::bigint as cap,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from d group by source),
l as (
  select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over before, 0)) / (sum(weight) over after) as level
  from s window before as (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding),
                after as (order by cap::double / weight, source nulls last rows between current row and unbounded following)),
f as (
  select *, min(case when level * weight <= cap then cap::double / weight end) over () as first_free from l),
t as (
  select source, source_size, coalesce(least(cap::double, weight * (
           select level from f g where g.level * g.weight <= g.cap order by g.cap::double / g.weight, g.source nulls last limit 1)), cap::double) as target,
         cap::double / weight < first_free as clamped, cap from f),
u as (
  select source, source_size, case when clamped then cap::double else target end as target from t),
p as (
  select d.*, u.source_size, u.target, case when u.source_size > 0 then floor(u.target / u.source_size) else 0 end as whole,
         coalesce(sum(d.size) over (partition by d.source order by d.draw, d.size rows between unbounded preceding and 1 preceding), 0) as prior
  from d join u on d.source is not distinct from u.source)
select doc_id, size, source_size, target,
       (size * (whole + case when prior + size / 2 <= target - whole * source_size and size > 0 then 1 else 0 end))::bigint as taken
from p
""")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_passages")
def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))


@query("op10_url_filter", r"""
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
o as (select doc_id, case when quality = 0 or toxic = 1 then 1 else 0 end as bad from labels),
h1 as (
  select host, string_split(regexp_replace(host, '(?s)^.*@|\.*(:[0-9]*)?\z', '', 'g'), '.') as ls, count(bad)::double as n, coalesce(sum(bad), 0)::double as k
  from p left join o on p.page_id = o.doc_id group by host),
h2 as (
  select *, case when len(ls) > 1 and regexp_full_match(ls[-1], '[a-z][a-z]')
                  and ls[-2] in ('ac', 'co', 'com', 'edu', 'gob', 'gouv', 'gov', 'go', 'ltd', 'mil', 'ne', 'net', 'nom', 'or', 'org', 'plc', 'sch') then 2 else 1 end as m,
         regexp_full_match(array_to_string(ls, '.'), '[0-9]+(\.[0-9]+){3}') as number from h1),
h as (
  select host, n, k, case when number then array_to_string(ls, '.') else array_to_string(ls[greatest(len(ls) - m, 1) :], '.') end as domain,
         case when number then '' else array_to_string(ls[greatest(len(ls) - m + 1, 1) :], '.') end as suffix from h2),
d as (select domain, suffix, sum(n) as n, sum(k) as k from h group by domain, suffix),
s as (select suffix, sum(n) as n, sum(k) as k from d group by suffix),
w as (select (sum(k) + 0.5) / (sum(n) + 1.0) as mean from s),
sm as (select suffix, n, k, (select mean from w) as mean from s),
sr as (select least(0.999, greatest(0.001, coalesce((sum(n * (k / n - mean) * (k / n - mean)) - sum(mean * (1 - mean))) / nullif(sum(mean * (1 - mean) * (n - 1)), 0), 0.001))) as rho from sm where n > 0),
sp as (select suffix, (k + (1 / rho - 1) * mean) / (n + (1 / rho - 1)) as mean from sm, sr),
dm as (select d.domain, d.n, d.k, sp.mean from d join sp using (suffix)),
dr as (select least(0.999, greatest(0.001, coalesce((sum(n * (k / n - mean) * (k / n - mean)) - sum(mean * (1 - mean))) / nullif(sum(mean * (1 - mean) * (n - 1)), 0), 0.001))) as rho from dm where n > 0),
dp as (select domain, (k + (1 / rho - 1) * mean) / (n + (1 / rho - 1)) as mean from dm, dr),
hm as (select h.host, h.n, h.k, dp.mean from h join dp using (domain)),
hr as (select least(0.999, greatest(0.001, coalesce((sum(n * (k / n - mean) * (k / n - mean)) - sum(mean * (1 - mean))) / nullif(sum(mean * (1 - mean) * (n - 1)), 0), 0.001))) as rho from hm where n > 0),
hp as (select host, (k + (1 / rho - 1) * mean) / (n + (1 / rho - 1)) as rate, n + (1 / rho - 1) as weight from hm, hr),
ab as (select host, rate * weight as a, (1 - rate) * weight as b from hp),
lo as (select *, ln(a / b) as peak, ln(a / b) - 14 * (sqrt(1 / a + 1 / b) + 1 / a) as low, ln(a / b) + 14 * (sqrt(1 / a + 1 / b) + 1 / b) as high from ab),
cu as (select *, least(greatest(0.0::double, low), high) as cut from lo),
gr as (select *, case when i in (0, 128) then 1.0::double when i % 2 = 1 then 4.0::double else 2.0::double end as simpson,
              low + (cut - low) * i / 128 as below, cut + (high - cut) * i / 128 as above from cu, (select unnest(range(129)) as i)),
ar as (
  select host, any_value(cut - low) * sum(simpson * exp(a * below - (a + b) * (greatest(below, 0) + ln(1 + exp(-abs(below)))) - a * peak + (a + b) * (greatest(peak, 0) + ln(1 + exp(-abs(peak)))))) as under,
         any_value(high - cut) * sum(simpson * exp(a * above - (a + b) * (greatest(above, 0) + ln(1 + exp(-abs(above)))) - a * peak + (a + b) * (greatest(peak, 0) + ln(1 + exp(-abs(peak)))))) as over
  from gr group by host),
j as (
  select p.page_id, p.host, p.path, over / (under + over) as bad_share,
         case when (p.host = 'example.com' or p.host like '%.example.com') and p.path like '/de/%' then 'example.com/de/'
              when (p.host = 'example.net' or p.host like '%.example.net') and p.path like '/en/%' then 'example.net/en/'
              when (p.host = 'org' or p.host like '%.org') and p.path like '/fr/%' then 'org/fr/'
              when (p.host = 'net' or p.host like '%.net') and p.path like '/%' then 'net/' end as rule
  from p join ar using (host))
select page_id, host, path, rule,
       case rule when 'net/' then 'block' when 'example.com/de/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow'
            else case when bad_share > 0.95 then 'block' else 'allow' end end as verdict
from j
""")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = page_outcomes(table(spark, sf_dir, "labels"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


@query("op11_hard_negatives", """
with i as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from i a join i b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (
  select p.anchor_id, positive_id, positive_score, other_id as negative_id, score as negative_score,
         row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id)::int as rank
  from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end"))
    return hard_negatives(vectors, vectors.filter("vec_id % 100 = 0").select("vec_id"))


@query("op12_collocations", r"""
with w as (
  select lang, ws, unnest(range(1, len(ws) + 1)) as i from (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (
      select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
      from documents))),
g as (
  select lang, ws[i : i + k - 1] as p, k from w, (select unnest([1, 2, 3, 4]) as k) where i + k - 1 <= len(ws)),
f as (select lang, p, k, count(*) as f from g group by all),
t as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, p, k, f as a from f where k > 1 and f >= 30),
s as (
  select c.lang, c.p, c.k, c.a, j, x.f as l, y.f as r, (2000000::hugeint * c.a // (x.f::hugeint + y.f))::bigint as score
  from (select *, unnest(range(1, k)) as j from c) c
  join f x on x.lang = c.lang and x.p = c.p[1 : j] join f y on y.lang = c.lang and y.p = c.p[j + 1 : c.k]
  qualify row_number() over (partition by c.lang, c.p order by (2000000::hugeint * c.a // (x.f::hugeint + y.f)), j) = 1),
b as (
  select lang, p[i : i + m - 1] as p, max(a) as longer
  from c, (select unnest([2, 3]) as m), (select unnest([1, 2, 3]) as i) where m < k and i + m - 1 <= k group by all)
select s.lang, row_number() over (partition by s.lang order by score desc, a desc, array_to_string(s.p, ' '))::int as rank, array_to_string(s.p, ' ') as phrase, a, l, r, n, score
from s join t on t.lang = s.lang left join b on b.lang = s.lang and b.p = s.p
where longer is null or 100::hugeint * longer < 80 * a
qualify rank <= 2000
""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query("op13_pack")
def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
