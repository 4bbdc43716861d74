"""SQL twins of the registered queries, for DuckDB. They are written on their own: tokeniser and
stemmer are SQL here. What has to be equal, words and suffixes, is taken from the tables that the
DataFrame code has; its steps are not."""

from __future__ import annotations

from textloom.functions import stem
from textloom.functions.text import STOP_WORDS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def m(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[aeiou]+[^aeiou]+'))"


def cut(n: int) -> str:
    return f"substr(w, 1, length(w) - {n})"


def rules(table: tuple[tuple[str, str], ...]) -> str:
    return "case " + " ".join(f"when suffix(w, '{a}') then case when {m(cut(len(a)))} > 0 then {cut(len(a))} || '{b}' else w end" for a, b in table) + " else w end"


def stems(words: str) -> str:
    """CTEs s0 to s8 over a relation of distinct words, ending in ``stem (word, term)``."""
    cvc = "regexp_matches({0}, '[^aeiou][aeiou][^aeiouwxy]$')"
    double = "(length(w) > 1 and right(w, 1) = substr(w, length(w) - 1, 1) and not regexp_matches(w, '[aeiou]$'))"
    four = " ".join(f"when suffix(w, '{a}') then case when {m(cut(len(a)))} > 1" + (f" and regexp_matches({cut(3)}, '[st]$')" if a == "ion" else "") + f" then {cut(len(a))} else w end" for a in stem.STEP_4)
    return f"""
s0 as (select word, case when suffix(word, 'sses') or suffix(word, 'ies') then substr(word, 1, length(word) - 2) when suffix(word, 'ss') then word when suffix(word, 's') then substr(word, 1, length(word) - 1) else word end as w from {words}),
s1 as (select word, w, case when suffix(w, 'eed') then 0 when suffix(w, 'ed') then case when regexp_matches({cut(2)}, '[aeiou]') then 2 else 0 end when suffix(w, 'ing') and regexp_matches({cut(3)}, '[aeiou]') then 3 else 0 end as k from s0),
s2 as (select word, k, case when suffix(w, 'eed') then case when {m(cut(3))} > 0 then {cut(1)} else w end else substr(w, 1, length(w) - k) end as w from s1),
s3 as (select word, case when k = 0 then w when regexp_matches(w, '(at|bl|iz)$') then w || 'e' when {double} and right(w, 1) not in ('l', 's', 'z') then {cut(1)} when {m("w")} = 1 and {cvc.format("w")} then w || 'e' else w end as w from s2),
s4 as (select word, case when suffix(w, 'y') and regexp_matches({cut(1)}, '[aeiou]') then {cut(1)} || 'i' else w end as w from s3),
s5 as (select word, {rules(stem.STEP_2)} as w from s4),
s6 as (select word, {rules(stem.STEP_3)} as w from s5),
s7 as (select word, case {four} else w end as w from s6),
s8 as (select word, case when suffix(w, 'e') and ({m(cut(1))} > 1 or ({m(cut(1))} = 1 and not {cvc.format(cut(1))})) then {cut(1)} else w end as w from s7),
stem as (select word, case when length(word) <= 2 then word when suffix(w, 'll') and {m("w")} > 1 then {cut(1)} else w end as term from s8)"""


def toks(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs ``toks (document_id, ws)`` and ``words (document_id, pos, word)``."""
    return rf"""
toks as (select {key} as document_id, list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) >= 2 and x not in ({STOPS})) as ws from {table} where {text} is not null and {text} <> ''),
words as (select document_id, unnest(ws) as word, unnest(range(len(ws))) as pos from toks)"""


INDEX = f"with {toks()}, distinct_words as (select distinct word from words), {stems('distinct_words')}, terms as (select document_id, pos, term from words join stem using (word))"


def bm25(terms: list[str]) -> str:
    """CTE ``scores (document_id, score)`` after INDEX."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
tf as (select term, document_id, count(*) as tf from terms where term in ({listed}) group by 1, 2),
corpus as (select count(*) as n, avg(len(ws)) as avgdl from toks),
idf as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, corpus group by term, n),
scores as (select document_id, sum(tf * 2.5 * idf / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))) as score from tf join idf using (term) join toks using (document_id), corpus group by 1)"""


def phrase(words: list[str], name: str) -> str:
    """CTE ``name (document_id, matches)``."""
    joins = " ".join(f"join terms t{i} on t{i}.document_id = t0.document_id and t{i}.pos = t0.pos + {i} and t{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return f"{name} as (select t0.document_id, count(*) as matches from terms t0 {joins} where t0.term = '{words[0]}' group by 1)"


def batch_sql(query: str, phrase_words: str) -> str:
    """The ten best documents for each query of the benchmark; query and phrase_words are SQL for the words of
    the query and of its one phrase, which may be too short to be one."""
    split = lambda x: f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 1 and w not in ({STOPS}))"
    return f"""with {toks()}, b0 as (select item_id as query_id, {split(query)} as ws, {split(phrase_words)} as ps from benchmark),
distinct_words as (select distinct word from words union select unnest(ws) from b0 union select unnest(ps) from b0), {stems('distinct_words')},
terms as (select document_id, pos, term from words join stem using (word)),
asked as (select distinct query_id, term from (select query_id, unnest(ws) as word from b0) join stem using (word)),
tf as (select term, document_id, count(*) as tf from terms group by 1, 2),
corpus as (select count(*) as n, avg(len(ws)) as avgdl from toks),
idf as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, corpus group by term, n),
scores as (select query_id, document_id, sum(tf * 2.5 * idf / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))) as score from asked join tf using (term) join idf using (term) join toks using (document_id), corpus group by 1, 2),
quoted as (select query_id, len(ps) as m, unnest(ps) as word, unnest(range(len(ps))) as j from b0 where len(ps) > 1),
starts as (select query_id, document_id, pos - j as start from quoted join stem using (word) join terms using (term) group by query_id, m, document_id, pos - j having count(*) = m),
pairs as (select distinct query_id from quoted),
found as (select query_id, document_id, count(*) as hits from starts group by 1, 2),
boosted as (select s.query_id, s.document_id, case when p.query_id is null then score when hits > 0 then score * (1 + 2.5 * hits) else score * 0.1 end as score from scores s left join pairs p using (query_id) left join found f on f.query_id = s.query_id and f.document_id = s.document_id),
best as (select *, row_number() over (partition by query_id order by round(score, 9) desc, document_id) as rank from boosted where score > 0)
select query_id, rank, document_id, round(score, 6) as score from best where rank <= 10"""


RANKED = "ranked as (select document_id, score, row_number() over (order by round(score, 9) desc, document_id) as rank from scores where score > 0)"
BODY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body[^>]*>', ''), '(?s)</body>.*$', ''), '(?s)<!--.*?-->', '', 'g'), '(?s)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>', '', 'g'), '(?s)<div class="ad">.*?</div>', '', 'g'), '<[^>]*>', '', 'g'), '$', '')"""


def entities(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


def snippet(text: str, words: list[str]) -> str:
    """About 200 characters around the first of the words that the text holds."""
    hit = "coalesce(" + ", ".join(f"nullif(strpos(lower({text}), '{w}'), 0) - 1" for w in words) + ")"
    start = f"greatest({hit} - 60, 0)"
    around = f"case when {hit} > 60 then '...' else '' end || substr({text}, cast({start} + 1 as bigint), 200) || case when {start} + 200 < length({text}) then '...' else '' end"
    return f"case when {text} is null or {text} = '' then '' when {hit} is null then substr({text}, 1, 200) || case when length({text}) > 200 then '...' else '' end else {around} end"


NORMAL = r"""case when strpos(u, '?') = 0 then regexp_replace(regexp_replace(u, '^(https?://[^/]*)$', '\1/'), '^(https?://[^/]*/.*)/$', '\1') else u end"""
URLS = rf"""u0 as (select page_id, url, html, regexp_replace(regexp_replace(split_part(url, '#', 1), '([?&])utm_source=[^&]*&?', '\1', 'g'), '[?&]$', '') as u from pages),
u1 as (select page_id, url, html, {NORMAL} as normal, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') as domain from u0)"""

LINKS = r"""l0 as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) as nth from pages),
l1 as (select page_id, nth, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href as link from l0),
links as (select page_id, nth, replace(replace(replace(regexp_extract(link, '^https?://[^/]*/') || url_encode(regexp_extract(link, '^https?://[^/]*/(.*)$', 1)), '%2C', ','), '%2A', '*'), '%24', '$') as link from l1)"""
TITLE = f"trim({entities("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")})"
FOLDED = rf"trim(regexp_replace({entities(BODY)}, '\s+', ' ', 'g'))"
PAGEDOCS = f"{URLS}, pagedocs as (select normal, any_value(domain) as domain, min_by({TITLE}, page_id) as title, min_by({FOLDED}, page_id) as content from u1 group by 1)"

SQL: dict[str, str] = {
    "corpus_count": "select count(*) as documents, count(*) filter (where text is not null and text <> '') as indexable from documents",
    "vocabulary": f"with {toks()} select word, count(*) as frequency from words group by word",
    "word_counts": f"with {toks()} select document_id, count(*) as words, count(distinct word) as kinds from words group by 1",
    "stem_vocab": f"with {toks()}, distinct_words as (select distinct word from words), {stems('distinct_words')} select word, term from stem",
    "doc_lengths": f"with {toks()} select document_id, cast(len(ws) as bigint) as doc_len from toks",
    "postings": f"{INDEX} select term, document_id, count(*) as tf, cast(min(pos) as bigint) as first_pos, cast(max(pos) as bigint) as last_pos from terms group by 1, 2",
    "term_df": f"{INDEX} select term, count(distinct document_id) as df from terms group by 1",
    "index_stats": f"{INDEX} select (select count(*) from toks) as total_documents, (select count(distinct term) from terms) as total_terms, (select floor(avg(len(ws)) * 100 + 0.5) / 100 from toks) as average_document_length, (select count(*) from documents) as documents_in_database",
    "candidates": f"{INDEX} select distinct document_id from terms where term in ('blend', 'inti', 'ist')",
    "idf": f"{INDEX}, {bm25(['blend', 'inti', 'ist'])} select term, round(idf, 9) as idf from idf",
    "bm25_topk": f"{INDEX}, {bm25(['blend', 'inti', 'ist'])}, {RANKED} select rank, document_id, round(score, 6) as score from ranked where rank <= 10",
    "bm25_page2": f"{INDEX}, {bm25(['blend', 'inti', 'ist'])}, {RANKED} select rank, document_id, cast(document_id as varchar) as title, round(score, 6) as score, {snippet('text', ['blend', 'inti', 'ist'])} as snippet from ranked join documents on doc_id = document_id where rank between 8 and 14",
    "phrase_counts": f"{INDEX}, {phrase(['nd', 'nd'], 'p')} select document_id, matches from p",
    "phrase_boost": f"{INDEX}, {bm25(['reat', 'er', 'ther', 'en'])}, {phrase(['reat', 'er'], 'p')}, {phrase(['ther', 'en'], 'q')}, boosted as (select s.document_id, case when p.matches > 0 and q.matches > 0 then score * (1 + 2.5 * (p.matches + q.matches)) else score * 0.1 end as score from scores s left join p using (document_id) left join q using (document_id)), best as (select document_id, score, row_number() over (order by round(score, 9) desc, document_id) as rank from boosted where score > 0) select rank, document_id, round(score, 6) as score from best where rank <= 20",
    "suggest_prefix": f"with {toks()} select word, count(*) as frequency from words where word like 'th%' group by 1 order by 2 desc, 1 limit 5",
    "completions": f"with {toks()}, v as (select word, count(*) as frequency from words group by 1), p as (select word, frequency, unnest(range(1, least(length(word), 24) + 1)) as n from v), r as (select substr(word, 1, n) as prefix, word, frequency, row_number() over (partition by substr(word, 1, n) order by frequency desc, word) as rank from p) select prefix, rank, word, frequency from r where rank <= 5",
    "bounded_topk": f"{INDEX}, {bm25(['thing', 'heon'])}, {RANKED} select rank, document_id, round(score, 6) as score from ranked where rank <= 10",
    "batch_search": batch_sql("text", "''"),
    "batch_phrases": batch_sql("array_to_string(string_split(text, ' ')[1:6], ' ')", "array_to_string(string_split(text, ' ')[3:4], ' ')"),
    "snippets": f"select doc_id as document_id, {snippet('text', ['thing', 'eau'])} as snippet from documents",
    "document_lookup": f"with {toks()} select d.doc_id as document_id, d.text as content, cast(coalesce(len(t.ws), 0) as bigint) as token_length from documents d left join toks t on d.doc_id = t.document_id where d.doc_id = 42",
    "existing_documents": "select doc_id as document_id from documents where doc_id in (3, 5, 100000000)",
    "page_titles": f"select page_id, trim({entities("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) as title from pages",
    "page_text": rf"select page_id, trim(regexp_replace({entities(BODY)}, '\s+', ' ', 'g')) as content from pages",
    "page_links": f"with {LINKS} select distinct page_id, link from links",
    "url_normalize": f"with {URLS} select page_id, normal from u1",
    "page_domains": f"with {URLS} select domain, count(*) as pages from u1 group by 1",
    "page_display_urls": r"""select page_id, case when contains(url, '://') then lower(regexp_extract(url, '://([^/?#:]*)', 1)) || case when regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '://[^/?#]*([^?#]*)', 1) end else url end as shown from pages""",
    "domain_facets": f"""with {PAGEDOCS}, {toks('pagedocs', 'normal', 'content')},
distinct_words as (select distinct word from words), {stems('distinct_words')}, hit as (select distinct p.domain, p.normal from words w join stem using (word) join pagedocs p on p.normal = w.document_id where term = 'thing')
select domain, count(*) as count from hit group by 1 union all select 'all', count(*) from hit""",
    "domain_search": f"""with {PAGEDOCS}, {toks('pagedocs', 'normal', 'content')}, distinct_words as (select distinct word from words), {stems('distinct_words')}, terms as (select document_id, pos, term from words join stem using (word)),
{bm25(['en', 'er', 'ou', 'tion'])}, chosen as (select s.document_id, s.score, p.title, p.content from scores s join pagedocs p on p.normal = s.document_id where p.domain = (select domain from u1 group by domain order by count(*) desc, domain limit 1) and score > 0),
ranked as (select *, row_number() over (order by round(score, 9) desc, document_id) as rank from chosen)
select rank, document_id, title, round(score, 6) as score, {snippet('content', ['en', 'er', 'ou', 'tion'])} as snippet from ranked where rank <= 10""",
    "crawl_outcomes": f"""with {PAGEDOCS}, {LINKS}, {toks('pagedocs', 'normal', 'content')}, first as (select page_id, normal from u1 order by page_id limit 1),
linked as (select u.normal, l.link, min(l.nth) as nth from links l join u1 u using (page_id) where page_id in (select min(page_id) from u1 group by normal) group by 1, 2),
places as (select *, row_number() over (partition by normal order by nth) - 1 as k, count(*) over (partition by normal) as n from linked),
todo as (select 1 as depth, 0 as ord, normal as url from first union all select 2, k + 1, link from places join first using (normal) where link <> normal),
found as (select t.*, p.title, p.normal is not null as here, len(w.ws) as tokens, (select count(*) from places l where l.normal = t.url) as child_links from todo t left join pagedocs p on p.normal = t.url left join toks w on w.document_id = t.url),
done as (select *, coalesce(sum(here::int) over (order by depth, ord rows between unbounded preceding and 1 preceding), 0) as before from found)
select depth, ord, url, case when here then 'indexed' else 'error' end as outcome, case when not here then 'not_found' end as reason, title, tokens as tokens_indexed, case when here then child_links end as child_links_found from done where before < 5""",
    "highlights": """select doc_id as document_id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;'), '(the|or)', '<mark class="highlight">\\1</mark>', 'gi') as html from documents""",
    "page_url_problems": """with p as (select page_id, url, lower(regexp_extract(url, '^\\s*([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, lower(regexp_extract(url, '(?i)^\\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\\s]+)', 1)) as host from pages)
select page_id, url, case when url is null or url = '' then 'empty' when scheme = '' then 'format' when scheme not in ('http', 'https') then 'protocol' when host = '' then 'format' when host = 'localhost' or suffix(host, '.local') or suffix(host, '.internal') or suffix(host, '.localhost') then 'host' when regexp_matches(host, '^[0-9]+(\\.[0-9]+){3}$') then 'address' end as problem from p""",
    "page_assets": r"select page_id, regexp_matches(lower(split_part(split_part(url, '#', 1), '?', 1)), '\.(png|jpg|jpeg|gif|svg|ico|pdf|zip|tar|gz|mp3|mp4|css|js|woff|woff2|json|xml)$') as asset from pages",
    "own_links": f"with {LINKS} select distinct l.page_id, l.link from links l join pages p using (page_id) where regexp_replace(lower(regexp_extract(l.link, '://([^/?#:]*)', 1)), '^www\\.', '') = regexp_replace(lower(regexp_extract(p.url, '://([^/?#:]*)', 1)), '^www\\.', '')",
    "typed_pages": f"select page_id, {TITLE} as title from pages where page_id % 4 in (0, 1)",
    "query_terms": f"with b0 as (select item_id as query_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 1 and w not in ({STOPS}))) as word from benchmark), distinct_words as (select distinct word from b0), {stems('distinct_words')} select distinct query_id, term from b0 join stem using (word)",
    "crawl_stored": f"with {URLS} select 1 as depth, 0 as ord, normal as url, 'skipped' as outcome, 'already_indexed' as reason, cast(null as varchar) as title, cast(null as integer) as tokens_indexed, cast(null as integer) as child_links_found from u1 order by page_id limit 1",
    "fetch_errors": "select page_id, case when page_id % 5 = 0 or contains(lower(html), 'timeout') then 504 when page_id % 5 in (1, 2) then 502 when contains(lower(html), 'unsupported content type') then 415 when regexp_matches(lower(html), 'blocked|disallowed|invalid protocol|invalid url') then 400 else 500 end as status from pages",
    "blocked_ips": "select k, (ip // 16777216 in (0, 10, 127) or ip // 16777216 between 224 and 239 or ip = 4294967295 or ip // 65536 in (43518, 49320) or ip // 1048576 = 2753 or ip // 4194304 = 401) as blocked from (select o_orderkey as k, (o_orderkey * 2654435761) % 4294967296 as ip from orders)",
    "percentiles": "select cast(quantile_disc(n_chars, 0.99) as bigint) as p99, avg(n_chars) as mean from documents",
}
