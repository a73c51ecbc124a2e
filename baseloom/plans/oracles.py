"""SQL for the driver's comparison, in DuckDB's dialect."""

from __future__ import annotations

from ..sources.fixtures import PATTERNS_CTE, READS_CTE, VAR_CTE
from ..sources.lists import default_adapters, default_contaminants

R, V, P = f"with {READS_CTE}", f"with {VAR_CTE}", f"with {PATTERNS_CTE}"

#: Bins of positions 1..100 (the fixture's length): single up to 9, then widths of 2.
LOW, HIGH = "case when pos <= 9 then pos else 10 + ((pos - 10) // 2) * 2 end", "case when low <= 9 then low else least(low + 1, longest) end"
BIG = lambda x, name: f"cast({x} as bigint) as {name}"
R6 = lambda x, name: f"round({x}, 6) as {name}"

QCUBE = ", qc as (select pos, cast(unicode(substr(qual, cast(pos as int), 1)) as bigint) as ascii, count(*) as n from reads, range(1, 101) t(pos) where pos <= length(qual) group by all)"
BCUBE = ", bc as (select pos, substr(seq, cast(pos as int), 1) as base, count(*) as n from reads, range(1, 101) t(pos) where pos <= length(seq) group by all)"

BASIC = R + QCUBE + f""", h as (select ascii, sum(n) as n from qc group by 1), l as (select min(ascii) as lo, max(ascii) as hi from h),
s as (select {', '.join(f"length(seq) - length(replace(seq, '{b}', '')) as {b}" for b in 'TCGAN')} from reads),
s2 as (select *, T + C + G + A + N as own from s)
select {BIG('count(*)', 'total_reads')}, {BIG('sum(own)', 'total_bases')}, {', '.join(BIG(f'sum({b})', f'{b.lower()}_count') for b in 'TCGAN')},
 {BIG('min(own)', 'min_length')}, {BIG('max(own)', 'max_length')}, {BIG('(select lo from l)', 'lowest_char')}, {BIG('(select hi from l)', 'highest_char')},
 {', '.join(BIG(f'(select sum(n) from h where ascii >= 33 + {q})', f'q{q}_bases') for q in (20, 30, 40, 50))},
 {R6('(sum(G) + sum(C)) * 1e0 / sum(own)', 'gc_percentage')}, 'Sanger / Illumina 1.9' as encoding, cast(33 as bigint) as "offset" from s2"""
BASIC = BASIC.replace("(select sum(n) from h where ascii >= 33 + ", "(select coalesce(sum(n), 0) from h where ascii >= 33 + ")

HIST = R + QCUBE + ", h as (select ascii, sum(n) as n from qc group by 1) select cast(g as bigint) as ascii, cast(coalesce(n, 0) as bigint) as n from range(0, 150) t(g) left join h on h.ascii = g"

PBQ = R + QCUBE + f""", a as (select pos, ascii, n, sum(n) over (partition by pos order by ascii) as cum, sum(n) over (partition by pos) as depth, (select max(pos) from qc) as longest from qc),
p as (select pos, longest, max(depth) as depth, sum(n * (ascii - 33)) * 1e0 / sum(n) as m, {', '.join(f"min(case when cum >= (depth * {k}) // 100 then ascii - 33 end) as p{k}" for k in (10, 25, 50, 75, 90))} from a group by all),
b as (select *, {LOW} as low from p), b2 as (select *, {HIGH} as high from b)
select low, high, {R6('avg(m)', 'mean')}, {', '.join(R6(f'coalesce(avg(case when depth > 100 then p{k} end), 0e0)', n) for k, n in ((10, 'lowest'), (25, 'lower_quartile'), (50, 'median'), (75, 'upper_quartile'), (90, 'highest')))} from b2 group by low, high"""

_BC = R + BCUBE + f""", w as (select pos, (select max(pos) from bc) as longest, {', '.join(f"sum(case when base = '{b}' then n else 0 end) as {b.lower()}" for b in 'ACGTN')}, sum(n) as depth from bc group by pos),
b as (select *, {LOW} as low from w), b2 as (select *, {HIGH} as high from b) """
POS = _BC + f"select pos, {', '.join(BIG(x, x) for x in 'acgtn')}, {BIG('depth - n', 'not_n')} from w"
PBC = _BC + f"select low, high, {', '.join(R6(f'1e2 * sum({x}) / (sum(t) + sum(c) + sum(a) + sum(g))', x) for x in 'tcag')} from b2 group by low, high"
PBN = _BC + f"select low, high, {R6('1e2 * sum(n) / sum(depth)', 'n_percent')} from b2 group by low, high"

_PSQ = R + """, m as (select list_sum(list_transform(string_split(qual, ''), lambda x: unicode(x))) // length(qual) as code from reads),
c as (select code, count(*) as n from m group by 1),
s as (select g - 33 as score, coalesce(n, 0) as n from range((select min(code)::bigint from c), (select max(code)::bigint from c) + 1) t(g) left join c on c.code = g) """
PSQ = _PSQ.replace(", c as", ", c as") + "select cast(score as bigint) as score, cast(n as bigint) as n from s"
MFS = _PSQ + "select cast(score as bigint) as most_frequent_score from s where score - (select min(score) from s) < (select count(*) from s where n > 0) order by n desc, score limit 1"


def _gc(table: str) -> str:
    return f""", x as (select length(seq) as len, length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')) as k, count(*) as n from {table} group by all),
lens as (select distinct len from x),
m as (select len, g as k, round(greatest(0, g - 0.5e0) * 100 / len) as lo, round(least(len, g + 0.5e0) * 100 / len) as hi from lens, range(0, 101) t(g) where g <= len),
e as (select m.len, m.k, p as pct from m, range(0, 101) t(p) where p between lo and hi),
f as (select *, 1e0 / count(*) over (partition by len, pct) as inc from e),
y as (select pct, sum(n * inc) as y from x join f using (len, k) group by pct),
o as (select p as pct, coalesce(y, 0) as y from range(0, 101) t(p) left join y on y.pct = p) """


GCO, GCV = R + _gc("reads") + f"select pct, {R6('y', 'y')} from o", V + _gc("reads_var") + f"select pct, {R6('y', 'y')} from o"
GCT = R + _gc("reads") + f""", top as (select min(pct) as m from o where round(y, 9) = (select max(round(y, 9)) from o)),
lim as (select m, (select y - y / 10 from o where pct = m) as l from top),
ends as (select m, (select min(pct) from o where pct > m and y <= l) as up, (select max(pct) from o where pct < m and y <= l) as down from lim),
c as (select coalesce((up + down) / 2e0, m) as c, (select sum(y) from o) as total from ends),
s as (select c, total, sqrt(sum((pct - c) * (pct - c) * y) / (total - 1)) as sd from o, c group by c, total),
z as (select pct, y, total, exp(-((pct - c) * (pct - c)) / (2 * sd * sd)) / (sqrt(2 * pi()) * sd) * total as t from o, s)
select pct, {R6('y', 'y')}, {R6('t', 'theoretical')}, {R6('sum(abs(t - y)) over () / total * 100', 'deviation_percent')} from z"""


def _lengths(table: str) -> str:
    return f""", c as (select length(seq) as len, count(*) as n from {table} group by 1), e as (select greatest(min(len) - 1, 0) as lo, max(len) + 1 as hi from c),
i as (select lo, hi, (select min(v) from (values (1), (2), (5), (10), (20), (50)) t(v) where (hi - lo) // v <= 50) as iv from e),
s as (select hi, iv, cast(round(lo * 1e0 / iv) as bigint) * iv as st from i),
b as (select g as low, hi, iv from s, range(0, 200) t(g) where g >= st and g <= hi and (g - st) % iv = 0)
select low, case when iv = 1 then low::varchar else low || '-' || least(low + iv - 1, hi) end as label, cast(coalesce((select sum(n) from c where len between low and low + iv - 1), 0) as double) as n from b"""


LEN, LENV = R + _lengths("reads"), V + _lengths("reads_var")


def _tracked(limit: int) -> str:
    return f""", keys as (select case when length(seq) > 75 then substr(seq, 1, 50) else seq end as key, count(*) as n, min(read_idx) as f from reads group by 1),
tr as (select * from keys order by f limit {limit}),
tot as (select count(*) as total, (select count(*) from tr) as u, case when (select count(*) from tr) = {limit} then (select max(f) from tr) else count(*) end as at_limit from reads) """


def _over(limit: int) -> str:
    return R + _tracked(limit) + f"select key as seq, n, {R6('n * 1e0 / total * 100', 'percentage')} from tr, tot where n * 1e0 / total * 100 > 0.1e0"


UNIQUE = R + _tracked(1000) + "select total, u as unique_seq_count, at_limit as count_at_unique_limit from tot"


def _dup(limit: int) -> str:
    labels = ", ".join(f"({i}, '{x}')" for i, x in enumerate("1 2 3 4 5 6 7 8 9 >10 >50 >100 >500 >1k >5k >10k".split()))
    return R + _tracked(limit) + f""", lv as (select n as d, count(*) as k from tr group by 1),
ps as (select d, k, total, at_limit, coalesce(list_product(list_transform(range(0, d), lambda j: greatest(total - at_limit - j, 0) * 1e0 / (total - j))), 1e0) as p from lv, tot),
co as (select d, case when at_limit = total or total - k < k then k * 1e0 else k / (1 - case when p < 1 - k / (k + 0.01e0) then 0e0 else p end) end as c from ps),
sl as (select case when d < 10 then d - 1 when d <= 50 then 9 when d <= 100 then 10 when d <= 500 then 11 when d <= 1000 then 12 when d <= 5000 then 13 when d <= 10000 then 14 else 15 end as slot, c, c * d as r from co),
a as (select sum(c) as cc, sum(r) as rr from sl), l(slot, label) as (values {labels})
select cast(l.slot as bigint) as slot, label, {R6('coalesce(sum(c), 0) / any_value(cc) * 100', 'dedup_percent')}, {R6('coalesce(sum(r), 0) / any_value(rr) * 100', 'total_percent')}, {R6('any_value(cc) / any_value(rr) * 100', 'percent_different')} from l cross join a left join sl using (slot) group by all"""


_ADAPTERS = ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', '{s}')" for n, s in default_adapters())
ADA = R + f""", ad(adapter, s) as (values {_ADAPTERS}), h as (select adapter, instr(seq, s) - 1 as p, count(*) as n from reads, ad where contains(seq, s) group by all),
d as (select adapter, pos, 89 as longest, coalesce((select sum(n) from h where h.adapter = ad.adapter and p <= pos - 1), 0) * 1e2 / (select count(*) from reads) as v from ad, range(1, 90) t(pos)),
b as (select *, {LOW} as low from d), b2 as (select *, {HIGH} as high from b)
select adapter, low, high, {R6('sum(v) / (high - low + 1)', 'percent')} from b2 group by all""".replace("group by all)", "group by all)")
ADA = ADA.replace("from b2 group by all", "from b2 group by adapter, low, high")

TILE = R + f""", s as (select cast(string_split(head, ':')[5] as bigint) as tile, qual from reads where read_idx <= 10000 or read_idx % 10 = 0),
p as (select tile, pos, 100 as longest, avg(unicode(substr(qual, cast(pos as int), 1)) - 33) as m from s, range(1, 101) t(pos) group by tile, pos),
b as (select *, {LOW} as low from p), b2 as (select *, {HIGH} as high from b), g as (select tile, low, high, avg(m) as mean from b2 group by all)
select tile, low, high, {R6('mean', 'mean')}, {R6('mean - avg(mean) over (partition by low)', 'deviation')} from g"""


def _vaf(distinct: str) -> str:
    return P + f""", h as (select {distinct} read_idx, snp_idx, allele from (select read_idx, substr(seq, cast(pos as int), 21) as kmer from reads, range(1, 81) t(pos)) join patterns using (kmer)),
c as (select snp_idx, count(*) filter (where allele = 0) as r, count(*) filter (where allele = 1) as a from h group by 1),
u(snp_idx, tracked) as (values (0, true), (1, true), (2, true), (3, true), (4, true), (5, true), (6, false)),
f as (select u.snp_idx, case when tracked then coalesce(r, 0) else nullif(r, 0) end as r, case when tracked then coalesce(a, 0) else nullif(a, 0) end as a from u left join c using (snp_idx))
select cast(snp_idx as bigint) as snp_idx, cast(r as bigint) as ref, cast(a as bigint) as alt, {R6('case when r + a > 0 then 1 - r * 1e0 / (r + a) end', 'vaf')} from f"""


_K = R + """, w as (select substr(seq, cast(pos as int), 7) as kmer, pos from reads, range(1, 95) t(pos) where read_idx % 50 = 0),
kc as (select kmer, pos, count(*) as n from w where not contains(kmer, 'N') group by all) """
KC = _K + "select kmer, pos, n from kc"
_KG = _K + f""", al as (select sum(n) as a from kc), kk as (select kmer, sum(n) as c from kc group by 1), b as (select *, 94 as longest, {LOW} as low from kc), b2 as (select *, {HIGH} as high from b),
gt as (select low, high, sum(n) as t from b2 group by all), hh as (select kmer, low, sum(n) as h from b2 group by all),
r as (select kmer, low, high, c, h, t, h / (c * 1e0 / a * t) as oe from hh join kk using (kmer) join gt using (low), al) """
KO = _KG + f"select kmer, low, high, {BIG('c', 'count')}, {BIG('h', 'hits')}, {BIG('t', 'group_total')}, {R6('oe', 'obs_exp')} from r"

PHRED = f"""with q as (select cast(g as bigint) as q, (g + 1) / 64e0 as p from range(0, 61) t(g))
select q, {R6('pow(10e0, -q / 10e0)', 'p')}, {R6('case when q = 0 then null else pow(10e0, -0.2e0) end', 'p_old')}, greatest(0, cast(trunc(-10 * log10(p)) as bigint)) as back, greatest(0, cast(trunc(-10 * log10(p / (1 - p))) as bigint)) as back_old from q"""
# ratios over 5 lie so far above the mean that 60 terms hold all of a tail that a double can show
KE = _KG + f""", sh as (select r.*, c * 1e0 / a as s from r, al),
p as (select kmer, list_sum(list_transform(range(cast(h as bigint) + 1, least(cast(t as bigint), cast(h as bigint) + 60) + 1), lambda j: exp(lgamma(t + 1) - lgamma(j + 1) - lgamma(t - j + 1) + j * ln(s) + (t - j) * ln(1 - s)))) * 16384 as p from sh where oe > 5 and h > s * t),
lo as (select kmer, min(coalesce(p, 0e0)) as p from p where coalesce(p, 0e0) < 0.01e0 group by kmer),
be as (select kmer, any_value(c) as c, max(oe) as oe from r group by kmer),
lw as (select kmer, min(r.low) as low from r join be using (kmer) where r.oe = be.oe group by kmer),
rk as (select kmer, be.c, lo.p, be.oe, lw.low, row_number() over (order by be.oe desc, kmer desc) as rank from lo join be using (kmer) join lw using (kmer))
select rank, kmer, {BIG('c', 'count')}, {R6('p', 'lowest_pvalue')}, {R6('oe', 'max_obs_exp')}, {BIG('low', 'max_low')} from rk where rank <= 20"""

_CONTAMINANTS = ", ".join(f"({i}, '{n.replace(chr(39), chr(39) * 2)}', '{s}')" for i, (n, s, _) in enumerate(default_contaminants()))
# the fixture's keys have 50 bases: no exact matches of 8 to 19. A row of g faces two bases on a diagonal; every second mismatch parts two runs.
CONT = R + _tracked(100_000) + f""", ov as (select key, n, n * 1e0 / total * 100 as pc from tr, tot where n * 1e0 / total * 100 > 0.1e0),
co(ord, name, s) as (values {_CONTAMINANTS}),
dg as (select key, ord, s, o from ov, co, range(-200, 200) t(o) where o >= 20 - length(s) and o < length(key) - 20),
g as (select key, ord, o, i, substr(s, cast(i + 1 as int), 1) = substr(key, cast(i + o + 1 as int), 1) as same from dg, range(0, 200) t(i) where i >= -o and i < length(s) and i < length(key) - o),
m as (select *, sum(case when same then 0 else 1 end) over (partition by key, ord, o order by i) as wrong from g),
rn as (select key, ord, o, 1 + coalesce(max(i) filter (where same), min(i)) - min(i) as len, count(*) filter (where not same) as miss from m where same or wrong % 2 = 1 group by key, ord, o, wrong // 2),
hs as (select key, ord, o, len, ((len - miss) * 100) // len as pid from rn where len > 20),
one as (select * from hs qualify row_number() over (partition by key, ord order by len desc, o, pid desc) = 1),
best as (select * from one qualify row_number() over (partition by key order by len desc, pid desc, ord) = 1)
select key as seq, n, {R6('pc', 'percentage')}, name as hit_name, case when name is not null then 'forward' end as direction, {BIG('len', 'hit_length')}, {BIG('pid', 'percent_id')},
 coalesce(name || ' (' || pid || '% over ' || len || 'bp)', 'No Hit') as hit_text from ov left join best using (key) left join co using (ord)"""

STRINGS = R + "select read_idx, case when not contains(seq, 'N') then reverse(translate(seq, 'ACGT', 'TGCA')) end as revcomp, cast(split_part(head, ':', 5) as bigint) as tile from reads"
PATHS = """with p(path) as (values ('a.fq'), ('dir/b.fastq'), ('c.fq.gz'), ('d.x.fastq.gz'), ('xfq'), ('e.txt'), ('oss://bucket/k/x.fq.gz'), ('s3://b2/y.fastq'), ('http://h/z.fq'))
select path, regexp_matches(path, '.*(.fq|.fastq)$') as fastq, regexp_matches(path, '.*(.fq.gz|.fastq.gz)$') as fastq_gz, regexp_matches(path, '(oss|s3)://') as remote,
 nullif(regexp_extract(path, '(oss|s3)://([^/]+)(/.*)$', 1), '') as scheme, nullif(regexp_extract(path, '(oss|s3)://([^/]+)(/.*)$', 2), '') as bucket, nullif(regexp_extract(path, '(oss|s3)://([^/]+)(/.*)$', 3), '') as key,
 regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1'), '(.)\\.[^.]*$', '\\1') as stem,
 cast(case when path like '%.gz' then floor(1968523e0 + 0.01164386e0 * 1000000) else 1000000 end as bigint) as guess from p"""

ORACLES = {
    "basic_stats": BASIC, "quality_histogram": HIST, "per_base_quality": PBQ, "per_base_content": PBC, "position_content": POS, "per_base_n": PBN,
    "per_seq_quality": PSQ, "most_frequent_score": MFS, "gc_observed": GCO, "gc_observed_var": GCV, "gc_theoretical": GCT, "length_distribution": LEN,
    "length_distribution_var": LENV, "overrepresented": _over(100_000), "overrepresented_limited": _over(1000), "unique_limit": UNIQUE,
    "duplication_levels": _dup(100_000), "duplication_levels_limited": _dup(1000), "adapter_content": ADA, "tile_quality": TILE,
    "vaf_matrix": _vaf("distinct"), "vaf_all_occurrences": _vaf(""), "kmer_counts": KC, "kmer_obs_exp": KO, "kmer_enriched": KE, "contaminant_hits": CONT, "phred_functions": PHRED,
    "sequence_functions": STRINGS, "path_functions": PATHS,
}
