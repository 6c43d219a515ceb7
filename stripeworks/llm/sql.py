"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import hosts, merkle, mixing, quality_rules

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def line_dedup(min_docs: int = 10) -> str:
    return f"""
with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select r, unnest(range(1, len(ls) + 1)) as pos, unnest(ls) as line from docs),
keyed as (select *, translate(trim(line, {SPACES}), {AZ}) as k from lines),
often as (select k from keyed where length(k) >= 1 group by k having count(distinct r) >= {min_docs}),
marked as (select r, pos, line, k in (select k from often) as gone from keyed)
select d.doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked join docs d using (r) group by d.r, d.doc_id
"""


def quality() -> str:
    window = quality_rules.WINDOW
    stops = ", ".join("'" + x + "'" for w in quality_rules.STOP_WORDS for x in dict.fromkeys((w, w.capitalize())))
    tests = []
    for r in quality_rules.RULES:
        ok = [f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None)
        ok = " and ".join(ok)
        if r.from_words:
            ok = f"{ok} or n_words < {r.from_words}"
        if r.to_words is not None:
            ok = f"{ok} or n_words > {r.to_words}"
        if r.langs:
            ok = f"{ok} or lang is null or lang not in ({', '.join(repr(x) for x in r.langs)})"
        tests.append(f"({ok})")
    ratio = lambda a, b: f"case when {b} = 0 then 0.0::double else {a}::double / {b}::double end"
    return rf"""
with docs as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as text from documents),
w as (select *, {WORDS} as ws,
             list_filter(string_split(text, chr(10)), lambda x: trim(x, {SPACES}) <> '') as ls from docs),
spots as (select r, unnest(range(1, len(ws) - {window - 2})) as p, ws from w where len(ws) >= {window + 1}),
grams as (select r, p, array_to_string(ws[p:p + {window - 1}], ' ') as g from spots),
twice as (select r, g from grams group by r, g having count(*) > 1),
covered as (select r, count(distinct q) as n from (
    select r, unnest(range(p, p + {window})) as q from grams semi join twice using (r, g)) group by r),
m as (select doc_id, lang, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
             len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_full,
             coalesce(covered.n, 0) as n_repeat_words,
             len(list_filter(ws, lambda x: x in ({stops}))) as n_stop,
             len(list_distinct(ws)) as n_distinct,
             len(list_filter(ws, lambda x: x = upper(x) and x <> lower(x) and length(x) > 1)) as n_shout,
             len(list_filter(ls, lambda x: ends_with(rtrim(x), '...') or ends_with(rtrim(x), '…'))) as n_ellipsis,
             len(list_filter(ls, lambda x: ltrim(x)[1:1] in ('-', '*', '•'))) as n_bullet
      from w left join covered using (r)),
k as (select *, {ratio('n_symbols', 'n_words')} as symbol_ratio, {ratio('word_chars', 'n_words')} as mean_word_length,
             {ratio('n_repeat_words', 'n_words')} as repeat_ratio, {ratio('n_stop', 'n_words')} as stop_word_ratio,
             {ratio('n_distinct', 'n_words')} as distinct_ratio, {ratio('n_shout', 'n_words')} as shout_ratio,
             {ratio('n_dup_lines', 'n_full')} as dup_line_ratio, {ratio('n_ellipsis', 'n_full')} as ellipsis_line_ratio,
             {ratio('n_bullet', 'n_full')} as bullet_line_ratio,
             n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and {' and '.join(tests)} as kept
from k
"""


def fingerprints() -> str:
    cut = f"regexp_replace(p, '{merkle.CUT}', '\\1' || chr(31), 'g')"
    hashes = "list_transform(a, lambda x: x.h)"
    leaves = "coalesce(list_sum(list_transform({}, lambda x: length(x) - length(translate(x, ',|', '')) + 1)), 0)"
    inside = "list_distinct(flatten(list_transform({}, lambda x: string_split(split_part(x, '{}', 2), '{}'))))"
    both, only = ("list_filter({0}, lambda e: " + f"{k} list_contains({{1}}, e))" for k in ("", "not"))

    def near(other: str, into: str) -> str:
        """Of the pair (a, other): sections, then paragraphs of what is left, then phrases."""
        return f"""{into}0 as (select a.doc_id, a.fp[1:32] = {other}.fp[1:32] as same, {both.format('a.secs', f'{other}.secs')} as c, {only.format('a.secs', f'{other}.secs')} as x, {only.format(f'{other}.secs', 'a.secs')} as y
from g a join g {other} on {'a.doc_id = b.doc_id and b.edited' if other == 'b' else 'c.doc_id = a.next_id and not c.edited'} where not a.edited),
{into}1 as (select doc_id, same, {leaves.format('c')} as n, {inside.format('x', ':', '|')} as x, {inside.format('y', ':', '|')} as y from {into}0),
{into}2 as (select doc_id, same, n + {leaves.format(both.format('x', 'y'))} as n, {inside.format(only.format('x', 'y'), '=', ',')} as x, {inside.format(only.format('y', 'x'), '=', ',')} as y from {into}1),
{into} as (select doc_id, round(case when same then 1.0 else 2 * (n + len(list_intersect(x, y))) / (2 * n + len(x) + len(y)) end, 6)::double as near from {into}2)"""

    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, length(text) // 2 as half, coalesce(lead(text) over w, first_value(text) over w) as next_text,
             coalesce(lead(doc_id) over w, first_value(doc_id) over w) as next_id from d window w as (order by doc_id desc)),
t as (select doc_id, false as edited, text, next_id from n
      union all select doc_id, true, substr(text, 1, length(text) - half) || substr(next_text, 1, half), next_id from n),
s0 as (select doc_id, edited, text, next_id, list_transform(string_split(text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p:
       {{'h': md5(p), 'b': array_to_string(list_transform(string_split({cut}, chr(31)), lambda y: md5(y)[1:6]), ',')}})) as pars from t),
s1 as (select * exclude (pars), list_transform(pars, lambda a: {{'h': md5(array_to_string({hashes}, '')),
       'b': array_to_string(list_transform(a, lambda x: x.h[1:12] || '=' || x.b), '|')}}) as a from s0),
f as (select doc_id, edited, text, next_id, sha256(array_to_string({hashes}, ''))[1:32] || ' ' || array_to_string(list_transform(a, lambda x: x.h[1:16] || ':' || x.b), ';') as fp from s1),
g as (select *, list_distinct(string_split(fp[34:], ';')) as secs from f),
{near('b', 'e')},
{near('c', 'm')}
select a.doc_id, length(a.text)::bigint as n_chars, sha256(b.text) as edited_sha256, a.fp as fingerprint, b.fp as edited_fingerprint, e.near as near_edited, m.near as near_next
from g a join g b on a.doc_id = b.doc_id and b.edited join e on e.doc_id = a.doc_id join m on m.doc_id = a.doc_id where not a.edited
"""


def reputation() -> str:
    def weight(source: str, n: str, s: str) -> str:
        """``source`` has n, s, the parent's rate m, its count pn and its children k."""
        heavy, light = f"{hosts.HEAVIEST}::double", f"{hosts.LIGHTEST}::double"
        return f"""(select case when db > 0.5 and dw > 0 then round(least(greatest(case when rho > 0 then 1 / rho - 1 else {heavy} end, {light}), {heavy}), 6) else {light} end
from (select *, (b / db - w / dw) / nullif(b / db + (t / db - 1) * w / dw, 0) as rho from (
select sum({n} * ({s}::double / {n} - m) ** 2) as b, sum({s} * (1 - {s}::double / {n})) as w, sum(1 - 1.0::double / k) as db, sum({n} - 1)::double as dw, sum({n} - {n} * {n}::double / pn) as t from {source})))"""

    def level(good: str, n: str, worth: str, above: str, unsure: str, into: str) -> str:
        return f"*, ({good} + {worth} * {above}) / ({n} + {worth}) as {into}, {into} * (1 - {into}) / ({n} + {worth} + 1) + ({worth} / ({n} + {worth})) ** 2 * {unsure} as {into}_v"

    which, said = "null", "null"
    for verdict, h, p in sorted(hosts.RULES, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = f"(p.host = '{h}' or ends_with(p.host, '.{h}')) and starts_with(p.path, '{p}')"
        which, said = f"case when {fits} then '{h + p}' else {which} end", f"case when {fits} then '{verdict}' else {said} end"
    two = ", ".join(f"'{x}'" for x in hosts.TWO_LABEL_SUFFIXES)
    ip = "regexp_full_match({}, '[0-9.]+')"
    domain = f"case when len(string_split(host, '.')) < 2 or {ip.format('host')} then host when array_to_string(string_split(host, '.')[-2:], '.') in ({two}) then array_to_string(string_split(host, '.')[-3:], '.') else array_to_string(string_split(host, '.')[-2:], '.') end"
    suffix = f"case when strpos(domain, '.') = 0 or {ip.format('domain')} then domain else substr(domain, strpos(domain, '.') + 1) end"
    return f"""
with r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
p as (select page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), {AZ}) as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from r),
shown as (select page_id, host, regexp_extract(path, '/([0-9]{{1,18}})(\\.html)?/?$', 1) as ref from p),
o as (select host, quality = 1 and toxic = 0 as good from shown join labels l on ref <> '' and l.doc_id = try_cast(ref as bigint) where quality is not null and toxic is not null),
every as (select *, {suffix} as suffix from (select *, {domain} as domain from (select distinct host from p))),
h as (select host, domain, suffix, count(*) as n, count(*) filter (good) as s from o join every using (host) where good is not null group by all),
d as (select domain, suffix, sum(n)::bigint as dn, sum(s)::bigint as ds, count(*) as dk from h group by all),
x as (select suffix, sum(dn)::bigint as sn, sum(ds)::bigint as ss, count(*) as sk from d group by all),
base as (select coalesce(sum(ss)::double / nullif(sum(sn), 0), {hosts.PRIOR_RATE}) as m, sum(sn)::bigint as pn, count(*) as k from x),
hm as (select n, s, ds::double / dn as m, dn as pn, dk as k from h join d using (domain)), dm as (select dn, ds, ss::double / sn as m, sn as pn, sk as k from d join x using (suffix)), xm as (select sn, ss, m, pn, k from x, base),
k as (select {weight('hm', 'n', 's')} as wh, {weight('dm', 'dn', 'ds')} as wd, {weight('xm', 'sn', 'ss')} as ws, m as base from base),
u as (select host, coalesce(n, 0) as n, coalesce(s, 0) as s, coalesce(dn, 0) as dn, coalesce(ds, 0) as ds, coalesce(sn, 0) as sn, coalesce(ss, 0) as ss, wh, wd, ws, base
      from every left join (select host, n, s from h) using (host) left join (select domain, dn, ds from d) using (domain) left join x using (suffix), k),
u1 as (select {level('(ss - ds)', '(sn - dn)', 'ws', 'base', '0', 'rs')} from u), u2 as (select {level('(ds - s)', '(dn - n)', 'wd', 'rs', 'rs_v', 'rd')} from u1), u3 as (select {level('s', 'n', 'wh', 'rd', 'rd_v', 'rh')} from u2),
v as (select host, rh, rh_v, least(greatest(rh, 1e-6::double), 1 - 1e-6::double) as r from u3),
w as (select host, round(rh, 6) as rate, round(1 / (1 + exp({hosts.Z} * sqrt(rh_v) / (r * (1 - r)) - ln(r / (1 - r)))), 6) as bound from v)
select p.page_id, p.host, p.path, {which} as rule, coalesce({said}, case when bound >= {hosts.MIN_GOOD} then 'allow' else 'block' end) as verdict, rate, bound
from p join w using (host)
"""


def mix() -> str:
    offsets = ", ".join(f"{u!r}::double" for u in mixing.offsets())
    weights = " ".join(f"when {i} then {w}" for i, w in enumerate(mixing.WEIGHTS))
    return rf"""
with d as (select doc_id, source, len({WORDS})::bigint as size from documents),
b as (select *, case when size < 16 then size else length(bin(size)) * 16 + (size * 16 >> length(bin(size))) end as bin, coalesce(('0x' || md5(doc_id::varchar)[1:8])::bigint % 1021, 1021) as cell from d),
r as (select *, row_number() over (partition by source order by bin, cell, size, doc_id) - 1 as rank from b),
s as (select source, sum(size)::bigint as source_size, case (row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} {weights} end as w from d group by source),
o as (select *, {mixing.MOST_COPIES} * source_size / w::double as ratio, {mixing.SHARE} * sum(source_size) over () as pool from s),
q as (select *, (pool - coalesce(sum({mixing.MOST_COPIES} * source_size) over (order by ratio, source rows between unbounded preceding and 1 preceding), 0))
             / sum(w) over (order by ratio, source rows between current row and unbounded following) as level from o),
l as (select min_by(level, ratio) as level from q where level <= ratio),
t as (select source, source_size, least({mixing.MOST_COPIES} * source_size::double, w * level) as target from s, l),
c as (select r.*, source_size, target, case when source_size = 0 then 0.0::double else target / source_size end as rate from r join t on r.source is not distinct from t.source),
u as (select unnest([{offsets}]) as u, unnest(range({mixing.OFFSETS})) as k),
e as (select source, u, k, abs(sum(size * least(floor((rank + 1) * rate + u) - floor(rank * rate + u), ceil(rate))) - any_value(target)) as off from c, u group by all),
best as (select source, min_by(u, off * 1e6 + k) as u from e group by source)
select doc_id, size, source_size, round(target, 6) as target, (size * least(floor((rank + 1) * rate + u) - floor(rank * rate + u), ceil(rate)))::bigint as taken
from c join best on c.source is not distinct from best.source
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_reputation": reputation(),
        "op2_merkle_fingerprints": fingerprints(),
        "op6_quality_rules": quality(),
        "op9_line_dedup": line_dedup(),
        "op10_mixing": mix(),
    }
