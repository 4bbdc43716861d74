"""The registered queries of the operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import ann, archives, byte_bpe, line_crf, line_dedup, mixing, ranker, repair_ids, simhash, substring_dedup, timestamps, url_rules, vector_codes
from textloom.llm.common import scratch, table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages go to legacy files of both versions by the parity of their id, and so to WARC."""
    pages, at = table(spark, sf_dir, "pages"), scratch(spark)
    odd = F.coalesce(F.col("page_id") % 2 != 0, F.lit(False))
    archives.write_arc(pages.where(~odd), f"{at}/arc/v1", 1)
    archives.write_arc(pages.where(odd), f"{at}/arc/v2", 2)
    archives.convert(spark, f"{at}/arc/*", f"{at}/warc")
    found = archives.read_warc(spark, f"{at}/warc").where(F.col("kind").isin("response", "revisit"))
    return found.select(F.col("order").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to_order").alias("refers_to"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op7_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = ranker.score(docs, ranker.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("id").cast("string")) % 4 == 2
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.quality(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), RULES)


def op10_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    repair_ids.write(table(spark, sf_dir, "documents"), at, tokenizer("word_bpe_49k.json"))
    return repair_ids.read(spark, at).withColumnRenamed("id", "doc_id")


def op11_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise(table(spark, sf_dir, "stamps"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    rows = vector_codes.with_label_error(found.codes)
    return rows.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_archives": op2_archives,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_ann": op5_ann,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_ranker": op7_ranker,
    "op8_line_crf": op8_line_crf,
    "op9_urls": op9_urls,
    "op10_repair_ids": op10_repair_ids,
    "op11_timestamps": op11_timestamps,
    "op12_vector_codes": op12_vector_codes,
    "op13_passages": op13_passages,
}

def vector_code_sql(rounds: int = 6) -> str:
    """The rounds one after the other, all parts assigned anew in each."""
    ctes = [
        "q as materialized (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(x::double * 4096) as bigint)) as v from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "p as materialized (select r, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] as x from q, range(8) as parts(part))",
        "s as (select r, row_number() over (order by vec_id) - 1 as entry from q qualify entry < 16)",
        "b0 as materialized (select part, entry, x as c from s join p using (r))",
    ]
    for k in range(rounds + 1):
        ctes.append(f"a{k} as materialized (select r, part, any_value(x) as x, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint * 16 + entry) as best from p join b{k} using (part) group by r, part)")
        ctes.append(f"m{k} as (select part, best % 16 as entry, i, sum(x[i]) as total, count(*) as n from a{k}, range(1, len(x) + 1) as places(i) group by all)")
        ctes.append(f"n{k} as (select part, entry, list((total - ((total % n + n) % n)) // n order by i)::bigint[] as c from m{k} group by part, entry)")
        ctes.append(f"b{k + 1} as materialized (select o.part, o.entry, coalesce(n.c, o.c) as c from b{k} o left join n{k} n on o.part = n.part and o.entry = n.entry)")
    ctes.append(f"books as (select part, entry, unnest(c) as x, unnest(range(len(c))) as i from b{rounds})")
    ctes.append("digest as (select sha256(string_agg(x::varchar, ',' order by part, entry, i)) as codebooks_sha256 from books)")
    ctes.append(f"e as (select r, string_agg(lower(printf('%02x', best % 16)), '' order by part) as code, sum(best // 16)::bigint as error from a{rounds} group by r)")
    return f"with {', '.join(ctes)} select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from e join q using (r), digest"


ORACLE_SQL: dict[str, str] = {
    "op3_mixing": r"""
with sizes as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(text, '')) as mark from documents),
per as (select source, cast(sum(size) as bigint) as source_size, 3.0::double * sum(size) as cap from sizes group by source),
weighed as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w from per),
levels as (select *, sum(source_size) over () as total, sum(w) over () as all_w,
    coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as caps,
    coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as ws from weighed),
held as (select *, (total - caps) / (all_w - ws) > cap / w as is_full from levels),
targets as (select source, source_size, case when is_full then cap else least(cap, w * (total - coalesce(sum(case when is_full then cap end) over (), 0)) / sum(case when not is_full then w end) over ()) end as target from held),
cells as (select s.source, length(bin(s.size)) as digits, sum(s.size)::double as s, any_value(t.target) as target from sizes s join targets t on s.source is not distinct from t.source group by 1, 2),
scaled as (select *, coalesce((target - 3 * coalesce(sum(s) over (partition by source order by digits rows between unbounded preceding and 1 preceding), 0)) / nullif(sum(s / digits) over (partition by source order by digits rows between current row and unbounded following), 0) * (1.0::double / digits) >= 3, false) as is_full from cells),
copies as (select *, case when is_full then 3.0 else least(3.0, coalesce(greatest(target - 3 * coalesce(sum(case when is_full then s end) over (partition by source), 0), 0.0) / nullif(sum(case when not is_full then s / digits end) over (partition by source), 0) * (1.0::double / digits), 0.0)) end as c from scaled),
parts as (select source, digits, floor(c) as whole, c - floor(c) as p, sum(floor(c) * s) over (partition by source) as certain, target from copies),
drawn as (select s.*, p.whole, p.p, p.target - p.certain as rest, (('0x' || substr(md5(coalesce(cast(s.doc_id as varchar), '') || ':' || s.mark || ':11'), 1, 13))::bigint + 0.5) / 4503599627370496 as u
    from sizes s join parts p on s.source is not distinct from p.source and length(bin(s.size)) = p.digits),
ranked as (select *, (u / (1 - u)) * ((1 - p) / p) as odds from drawn where p > 0 and size > 0),
sums as (select *, sum(size) over (partition by source order by odds, doc_id rows between unbounded preceding and current row)::double as upto from ranked),
stops as (select source, min(upto) filter (where upto >= rest) as over_it, coalesce(max(upto) filter (where upto < rest), 0) as under_it, any_value(rest) as rest from sums group by source),
taken as (select s.doc_id, s.source from sums s join stops t on s.source is not distinct from t.source
    where s.upto <= case when t.over_it is null then t.under_it when t.rest - t.under_it <= t.over_it - t.rest then t.under_it else t.over_it end)
select d.doc_id, d.size, t.source_size, t.target, cast((d.whole + case when k.doc_id is null then 0 else 1 end) * d.size as bigint) as taken
from drawn d join targets t on d.source is not distinct from t.source left join taken k on d.doc_id = k.doc_id
""",
    "op9_urls": r"""
with recursive p as (select page_id, url, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
q as (select page_id, url, html, rest, least(coalesce(nullif(strpos(rest, '/'), 0), 1 << 30), coalesce(nullif(strpos(rest, '?'), 0), 1 << 30), coalesce(nullif(strpos(rest, '#'), 0), 1 << 30)) as cut from p),
r as (select page_id, url, html, coalesce(lower(substr(rest, 1, cut - 1)), '') as host, coalesce(substr(rest, cut), '') as tail from q),
s as (select page_id, url, html, host, substr(tail, 1, least(coalesce(nullif(strpos(tail, '?'), 0), 1 << 30), coalesce(nullif(strpos(tail, '#'), 0), 1 << 30)) - 1) as path from r),
rules(v, h, pre) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit as (select s.page_id, s.url, max_by(h || pre, length(h || pre)) as rule, max_by(v, length(h || pre)) as v from s join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, pre) group by 1, 2),
named as (select *, split_part(url, '#', 1) as bare, regexp_extract(split_part(url, '#', 1), '(?s)^(.*?://[^/?#]*)', 1) as origin from s where contains(url, '://')),
shown as (select bare, origin, regexp_replace(html, '(?is)<!--(?:-?>|.*?(?:-->|\z))|<script[\s>].*?(?:</script|\z)|<style[\s>].*?(?:</style|\z)|<title[\s>].*?(?:</title|\z)|<textarea[\s>].*?(?:</textarea|\z)', '', 'g') as body from named where html is not null),
tags as (select bare, origin, unnest(regexp_extract_all(body, '(?is)<(?:link|meta|base)\s(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) as tag, body from shown),
said_of as (select bare, origin, tag, regexp_extract(tag, '(?is)\srel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', ['a', 'b', 'c']) as rel, regexp_extract(tag, '(?is)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', ['a', 'b', 'c']) as href,
    regexp_extract(tag, '(?is)\shttp-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', ['a', 'b', 'c']) as equiv, regexp_extract(tag, '(?is)\scontent\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', ['a', 'b', 'c']) as content,
    regexp_extract(regexp_extract(body, '(?is)<base\s[^>]*>'), '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1) as base from tags),
links as (select bare as a, origin, replace(base, '&amp;', '&') as base, trim(replace(case when regexp_matches(tag, '(?i)^<link') and list_contains(string_split_regex(lower(rel.a || rel.b || rel.c), '\s+'), 'canonical') then href.a || href.b || href.c
    when regexp_matches(tag, '(?i)^<meta') and lower(equiv.a || equiv.b || equiv.c) = 'refresh' then trim(regexp_extract(content.a || content.b || content.c, '(?is)^\s*[0-9.]*\s*[;,]?\s*(?:url\s*=\s*)?(.*)$', 1), '"''') else '' end, '&amp;', '&')) as t from said_of),
based as (select a, t, case when base = '' then a when contains(base, '://') then base when starts_with(base, '/') then origin || base else regexp_extract(a, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1) || base end as b from links where t <> ''),
joined as (select a, split_part(case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*:') then t when starts_with(t, '//') then regexp_extract(b, '^([^:]*:)', 1) || t when starts_with(t, '/') then regexp_extract(b, '(?s)^(.*?://[^/?#]*)', 1) || t
    when starts_with(t, '?') then regexp_extract(b, '(?s)^(.*?://[^?#]*)', 1) || t when starts_with(t, '#') then b
    else regexp_extract(b, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(b, '(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)', 1), ''), '/') || t end, '#', 1) as full_url from based),
cut_up as (select a, regexp_extract(full_url, '(?s)^([^:]*://[^/?#]+)([^?#]*)(.*)$', ['head', 'path', 'query']) as u from joined where regexp_matches(full_url, '(?s)^[^:]*://[^/?#]')),
full_links as (select a, u.head || case when regexp_matches(u.path, '/\.\.?(/|$)') then list_reduce(string_split(regexp_replace(substr(u.path, 2), '(^|/)(\.\.?)$', '\1\2/'), '/'), lambda acc, x: case when x = '..' then regexp_replace(acc, '/[^/]*$', '') when x = '.' then acc else acc || '/' || x end, '') else u.path end || u.query as b from cut_up),
heads as (select a, b, regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1) as ha, regexp_extract(b, '(?s)^(.*?://[^/?#]*)', 1) as hb from full_links),
edges as (select lower(ha) || substr(a, length(ha) + 1) as a, lower(hb) || substr(b, length(hb) + 1) as b from heads),
pair as (select a, b from edges where a <> b union select b, a from edges where a <> b),
reach(a, b) as (select a, a from pair union select r.a, e.b from reach r join pair e on r.b = e.a),
nodes as (select distinct a as node, strpos(a, '://') as head from pair),
parts as (select node, substr(node, head + 3) as rest from nodes),
places as (select node, regexp_extract(rest, '(?s)^([^/?#]*)', 1) as host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from parts),
said as (select node, max_by(v, length(h || pre)) as v from places join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, pre) group by 1),
passed as (select r.a as node, case when bool_or(v = 'allow') then 'allow' else 'block' end as v from reach r join said on said.node = r.b group by 1),
own as (select page_id, host, path, html, url, lower(origin) || substr(bare, length(origin) + 1) as node from named)
select s.page_id, s.host, s.path, f.rule, coalesce(f.v, d.v, 'allow') as verdict
from s left join (select distinct url, node from own) o on s.url = o.url left join (select distinct url, rule, v from fit) f on s.url = f.url left join passed d on o.node = d.node
""",
    "op11_timestamps": r"""
with s as (select stamp_id, source, zone, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as x from stamps),
g as (select *, regexp_extract(x, '^(?:(20[0-9][0-9])-([0-9]{2})-([0-9]{2})|(20[0-9][0-9])([0-9]{2})([0-9]{2})|([0-9]{2})\.([0-9]{2})\.(20[0-9][0-9])|([0-9]{2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20[0-9][0-9])|([0-9]{2})/([0-9]{2})/(20[0-9][0-9]))([T\x20]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?:\x20?([AP])M)?(?:\x20?(?:(Z)|([+-])([0-9]{2}):?([0-9]{2})))?)?$',
    ['y1', 'm1', 'd1', 'y2', 'm2', 'd2', 'd3', 'm3', 'y3', 'd4', 'b4', 'y4', 'p5', 'q5', 'y5', 'tail', 'h', 'mi', 'se', 'ap', 'z', 'sign', 'oh', 'om']) as f from s),
n as (select stamp_id, source, zone, x, f.p5 <> '' as slashed, f.y1 || f.y2 || f.y3 || f.y4 || f.y5 as y,
    f.m1 || f.m2 || f.m3 || f.p5 || case when f.b4 = '' then '' else lpad(cast((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', f.b4) + 2) // 3 as varchar), 2, '0') end as m, f.d1 || f.d2 || f.d3 || f.d4 || f.q5 as d,
    coalesce(try_cast(f.h as integer), 0) as h, coalesce(try_cast(f.mi as integer), 0) as mi, coalesce(try_cast(f.se as integer), 0) as se, f.ap as ap, f.z <> '' or f.sign <> '' as fixed,
    case f.sign when '-' then -1 else 1 end * (coalesce(try_cast(f.oh as integer), 0) * 60 + coalesce(try_cast(f.om as integer), 0)) as off_minutes, coalesce(try_cast(f.oh as integer), 0) <= 14 and coalesce(try_cast(f.om as integer), 0) <= 59 as off_ok from g),
c as (select *, case when off_ok and mi <= 59 and se <= 59 and (case when ap = '' then h <= 23 else h between 1 and 12 end) then try_cast(y || '-' || m || '-' || d as date) end as one,
    case when slashed and off_ok and mi <= 59 and se <= 59 and (case when ap = '' then h <= 23 else h between 1 and 12 end) then try_cast(y || '-' || d || '-' || m as date) end as two,
    ((case when ap = '' then h else h % 12 + case ap when 'P' then 12 else 0 end end * 60 + mi - off_minutes) * 60 + se) * 1000000::bigint as clock from n),
v as (select source, count(*) filter (where slashed and one is null and two is not null) as dayfirst, count(*) filter (where slashed and two is null and one is not null) as monthfirst from c group by 1),
k as (select stamp_id, zone, fixed or regexp_full_match(x, '[0-9]{10}|[0-9]{13}') as fixed,
    case when regexp_full_match(x, '[0-9]{10}|[0-9]{13}') then 'epoch' when coalesce(one, two) is null then 'bad' when one <> two then case when dayfirst > 3 * monthfirst or monthfirst > 3 * dayfirst then 'votes' else 'default' end else 'plain' end as rule,
    case when regexp_full_match(x, '[0-9]{10}') then x::bigint * 1000000 when regexp_full_match(x, '[0-9]{13}') then x::bigint * 1000
        else epoch_us(case when one <> two and dayfirst > 3 * monthfirst then two else coalesce(one, two) end::timestamp) + clock end as wall
    from c left join v on c.source is not distinct from v.source),
o as (select *, wall - (epoch_us(timezone(zone, make_timestamptz(wall - 129600000000))) - (wall - 129600000000)) as before, wall - (epoch_us(timezone(zone, make_timestamptz(wall + 129600000000))) - (wall + 129600000000)) as after from k),
w as (select *, epoch_us(timezone(zone, make_timestamptz(before))) = wall as fits_before, epoch_us(timezone(zone, make_timestamptz(after))) = wall as fits_after from o)
select stamp_id, case when rule = 'bad' then null when fixed then wall when before = after or fits_before or not fits_after then before else after end as utc_us, rule,
    rule <> 'bad' and (rule in ('votes', 'default') or (not fixed and before <> after and fits_before = fits_after)) as ambiguous
from w
""",
    "op12_vector_codes": vector_code_sql(),
    "op13_passages": r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as pos from t where len(ws) >= 50),
h as (select doc_id, pos, md5(array_to_string(ws[pos : pos + 49], ' ')) as h from w),
l as (select h, min(doc_id) as least from h group by 1),
c as (select distinct doc_id, pos + k as place from h join l using (h), range(50) as r(k) where least < doc_id),
p as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as place from t),
j as (select p.doc_id, string_agg(p.word, ' ' order by p.place) as kept, count(*) as n from p left join c on p.doc_id = c.doc_id and p.place = c.place where c.place is null group by 1)
select t.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(j.n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t left join j using (doc_id)
""",
}
