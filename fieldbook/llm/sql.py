"""DuckDB SQL of the text queries that SQL can say."""

from fieldbook.llm.common import WORD
from fieldbook.llm.secret_scan import BASE, MORE, Rule

OP1 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
 s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as sh from w),
 u as (select doc_id, len(sh) as n, unnest(sh) as g from s),
 links as (select a.doc_id as x, b.doc_id as y from u a join u b using (g) where a.doc_id < b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
 both_ as (select x, y from links union all select y, x from links),
 reach as (select x as node, x as root from both_ union select b.y, r.root from reach r join both_ b on b.x = r.node)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, least(s.doc_id, coalesce(min(root), s.doc_id)) as component_id from s left join reach on node = s.doc_id group by s.doc_id, sh
"""

OP2 = rf"""
with t as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
 l as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from t),
 i as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from t where len(w) >= 3),
 g as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from i),
 r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where n > 1) group by 1),
 f as (select l.doc_id, source, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
   cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(string_split(text, chr(10))) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words from l left join r on r.doc_id = l.doc_id),
 b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 100 * n_symbols > 10 * word_chars or 100 * n_dup_lines > 50 * n_lines as soft_failed from f),
 h as (select source, cast(count(*) as double) as n, cast(count(*) filter (base_failed or soft_failed) as double) as k from b group by 1),
 p as (select least(greatest(sum(k) / sum(n), 1e-6), 1 - 1e-6) as m, sum(n * (k / n) * (k / n)) / sum(n) as v, greatest(count(*) / sum(1 / n), 1) as inside from h),
 q as (select m, least(greatest(m * (1 - m) / greatest(v - m * m - m * (1 - m) / inside, 1e-6) - 1, 2), 1e6) as weight from p),
 o as (select source, (k + m * weight) / (n + weight) as rate, n + weight as total from h, q),
 d as (select source, case when rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > 0.6 then 'reject' when rate > 0.02 then 'strict' else 'trust' end as verdict from o)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and verdict <> 'reject' and (verdict = 'trust' or not soft_failed) as kept from b join d on d.source is not distinct from b.source
"""


def found(rule: Rule, rank: int) -> str:
    """A list of (start, rank, end, kind) of a rule's matches: pieces between matches and matches alternate."""
    pattern = rule.pattern.replace("'", "''")
    lengths = lambda e: f"list_transform({e}, lambda x: length(x))"
    m, p = lengths(f"regexp_extract_all(text, '{pattern}', 0)"), lengths(f"regexp_split_to_array(text, '{pattern}')")
    g = lengths(f"regexp_extract_all(text, '{pattern}', {rule.group})")
    at = f"list_sum(({p})[:i]) + coalesce(list_sum(({m})[:i - 1]), 0)"
    one = f"{{'s': cast({at} as bigint), 'r': {rank}, 'e': cast({at} + ({m})[i] as bigint), 'k': '{rule.kind}'}}"
    return f"list_transform(list_filter(range(1, len({m}) + 1), lambda i: ({g})[i] >= {rule.least}), lambda i: {one})"


def joined(spans: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_sort({spans}), lambda x: x.k || ':' || x.s || ':' || x.e), ','), '')"


OP6 = f"""
with t as (select doc_id, coalesce(text, '') as text from documents), f as (select doc_id, {", ".join(f"{found(r, i)} as {r.kind}" for i, r in enumerate(BASE + MORE))} from t)
select doc_id, {", ".join(f"cast(len({r.kind}) as bigint) as n_{r.kind}" for r in BASE)}, sha256({joined("list_concat(list_concat(assign, access), hex)")}) as base_sha256,
 {joined("flatten([" + ", ".join(r.kind for r in BASE + MORE) + "])")} as spans from f
"""

OP10 = """
with t as (select page_id, encode(coalesce(html, '')) as b from pages), d as (select page_id, cast(octet_length(b) as bigint) as payload_bytes, sha256(b) as payload_digest from t),
 f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest, payload_bytes >= 100) end as first from d)
select page_id, payload_bytes, payload_digest, case when first is not null and first <> page_id then 'revisit' else 'response' end as record_type, case when first <> page_id then first end as refers_to from f
"""

#: Pages of one template: a nav, an advert, an article of paragraphs and a footer. Repeats are counted by grams of 8 tokens.
REFERENCES = (("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&#x27;", "''"), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&"), (r"\s+", " "))
DECODED = "trim(" + "regexp_replace(" * len(REFERENCES) + "x" + "".join(f", '{a}', '{b}', 'g')" for a, b in REFERENCES) + ")"

OP11 = rf"""
with plain as (select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as host, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') as html from pages),
 cut as (select *, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as article, regexp_replace(html, '(?s)<head>.*</head>|<article>.*</article>', '<p>', 'g') as rest from plain),
 blocks as (select page_id, url, host, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(article, '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(?:p|h1)>', chr(1), 'g'), chr(1)), lambda x: {DECODED}), lambda x: x <> '') as own,
   list_filter(list_transform(string_split(regexp_replace(rest, '(?s)<[^>]*>', chr(1), 'g'), chr(1)), lambda x: {DECODED}), lambda x: x <> '') as others from cut),
 streams as (select page_id, host, flatten(list_transform(others, lambda b: list_append(string_split(b, ' '), chr(10)))) as w, array_to_string(others, chr(10)) as stream from blocks),
 once as (select host, stream, any_value(w)[:-2] as w from streams where len(w) > 0 group by host, stream),
 places as (select host, stream, w, unnest(range(1, len(w) - 6)) as i from once),
 grams as (select host, stream, i, w[i:i + 7] as g from places),
 several as (select host, g from grams group by host, g having count(distinct stream) > 1),
 covered as (select distinct host, stream, unnest(range(i, i + 8)) as i from grams semi join several using (host, g)),
 counts as (select c.host, c.stream, count(*) as n from covered c join once o on c.host = o.host and c.stream = o.stream where o.w[c.i] <> chr(10) group by c.host, c.stream)
select b.page_id, b.url, array_to_string(own, chr(10) || chr(10)) as text, cast(length(array_to_string(own, chr(10) || chr(10))) as bigint) as n_chars, coalesce(n, 0) as repeated_words
from blocks b join streams s using (page_id) left join counts on counts.host = s.host and counts.stream = s.stream
"""

#: CRC-32 of the decimal digits of conv_id, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ord(x) as ubigint))), lambda a, b:
   list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda x: cast(x as ubigint))), lambda p, q: case when p % 2 = 1 then xor(p // 2, 3988292384::ubigint) else p // 2 end)), 4294967295::ubigint)"""

OP12 = f"""
with t as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
 own as (select conv_id, list({{'r': r, 'x': x}} order by turn nulls first, md5(length(r) || ':' || r || x)) as turns from t group by conv_id),
 heads as (select *, cast({CRC} % 6 as bigint) as h from own),
 rebuilt as (select o.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h), list_slice(o.turns, h + 1, len(o.turns))) as turns from heads o left join own b on b.conv_id = o.conv_id - o.conv_id % 100),
 prefixes as (select conv_id, unnest(range(len(turns) + 1)) as d, turns from rebuilt),
 nodes as (select list_slice(turns, 1, d) as k, d, min(conv_id) as conv_id, count(*) as n from prefixes group by all),
 ends as (select turns, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as s from rebuilt group by turns),
 kids as (select list_slice(k, 1, d - 1) as k, d - 1 as d, count(*) as n from nodes where d > 0 group by all),
 filled as (select n.*, coalesce(c.n, 0) as n_children, case when n.d = 0 then 0 else (n.n - 1) * length(n.k[n.d].x) end as v from nodes n left join kids c on c.k = n.k and c.d = n.d),
 below as (select a.k, a.d, count(*) filter (b.n_children = 0) as n_leaves, sum(b.v) as saved from filled a join filled b on b.d >= a.d and list_slice(b.k, 1, a.d) = a.k group by all)
select f.conv_id, cast(f.d as int) as depth, p.conv_id as parent_conv_id, f.n as n_convs, f.n_children, b.n_leaves, cast(b.saved as bigint) as saved_tokens, coalesce(e.s, sha256('')) as ends_sha256
from filled f join below b on b.k = f.k and b.d = f.d left join nodes p on p.d = f.d - 1 and p.k = list_slice(f.k, 1, f.d - 1) left join ends e on e.turns = f.k
"""


def rounds(n: int) -> str:
    """Each round's assignments a<i> and the codebook that follows from them, b<i + 1>."""
    far = "cast(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) as bigint)"
    out = []
    for i in range(n + 1):
        out.append(f" a{i} as materialized (select x.id, x.p, any_value(x.v) as v, min({far} * 256 + b.e) % 256 as e, min({far}) as error from parts x join b{i} b on b.p = x.p group by x.id, x.p)")
        if i < n:
            out.append(f" m{i} as (select p, e, k, cast(floor(cast(sum(c) as double) / count(*)) as bigint) as c from (select p, e, unnest(v) as c, unnest(range(len(v))) as k from a{i}) group by p, e, k)")
            out.append(f" b{i + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from b{i} b left join (select p, e, list(c order by k) as v from m{i} group by p, e) m on m.p = b.p and m.e = b.e)")
    return ",\n".join(out)


OP13 = f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 numbered as (select *, row_number() over (order by vec_id nulls last, v) as id from kept),
 parts as materialized (select id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as v from numbered, (select unnest(range(4)) as p)),
 b0 as materialized (select p, id - 1 as e, v from parts where id <= 256),
{rounds(4)},
 books as (select sha256(string_agg(cast(c as varchar), ',' order by p, e, k)) as s from (select p, e, unnest(v) as c, unnest(range(len(v))) as k from b4)),
 codes as (select id, string_agg(printf('%02x', cast(e as int)), '' order by p) as code, cast(sum(error) as bigint) as error from a4 group by id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, s as codebooks_sha256 from codes join numbered using (id), books
"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1,
    "op2_quality_rules": OP2,
    "op6_secret_scan": OP6,
    "op10_warc": OP10,
    "op11_host_suffix_array": OP11,
    "op12_prefix_trie": OP12,
    "op13_vector_codes": OP13,
}
