"""SQL for the registered queries, over the same tables. Written apart from the operators: it goes over the long form, row by row."""

from __future__ import annotations

from . import cases
from .fixtures import LEXICON, MAPPING

_TERMS = [(i, f"{c}_{v}", c, t[0]) for i, (c, v, t) in enumerate((c, v, t) for c, vs in LEXICON.items() for v, t in vs.items())]
_DIM = "dim(idx, feature, category, term) as (values " + ", ".join(f"({i}, '{f}', '{c}', '{t}')" for i, f, c, t in _TERMS) + ")"
_DOCS = f"""{_DIM},
hits as (select doc_id, lang, source, idx, feature, category, contains(lower(text), term) as hit from documents cross join dim),
l as (select doc_id, lang as label, source, idx, feature, category,
        case when hit then 1 when bool_or(hit) over (partition by doc_id, category) then 0 else 2 end as v from hits)"""
_LINES = """o as (select o_orderpriority as priority, l_returnflag as r, l_linestatus as s, l_quantity as q, l_discount as d, l_tax as t, row_number() over () as id
  from lineitem join orders on l_orderkey = o_orderkey),
l as (
  select id, priority as label, idx, feature, case when hit then 1 when bool_or(hit) over (partition by id, category) then 0 else 2 end as v from (
    select id, priority, unnest([0,1,2,3,4,5,6,7,8,9,10]) as idx,
      unnest(['returnflag_R','returnflag_A','returnflag_N','linestatus_O','linestatus_F','qty_low','qty_mid','qty_high','disc_none','disc_low','disc_high']) as feature,
      unnest(['r','r','r','s','s','q','q','q','d','d','d']) as category,
      unnest([r='R', r='A', r='N', s='O', s='F', t<>0 and q<17, t<>0 and q>=17 and q<34, t<>0 and q>=34, d=0, d>0 and d<0.05, d>=0.05]) as hit from o))"""
_COVERAGE = """select feature, count(*) filter (where v=1) as n_present, count(*) filter (where v=0) as n_absent, count(*) filter (where v=2) as n_unknown,
  round_even(100.0*count(*) filter (where v=1)/count(*), 2) as pct_present, round_even(100.0*count(*) filter (where v=0)/count(*), 2) as pct_absent,
  round_even(100.0*count(*) filter (where v=2)/count(*), 2) as pct_unknown, round_even(100.0*count(*) filter (where v<>2)/count(*), 2) as informativeness
from l group by feature"""
_CELLS = """cells as (select feature, x.label, k as v, count(*) filter (where l.v = k) as nxy from l join (select distinct label from l) x using (label) cross join (values (0),(1)) t(k) group by all),
marg as (select *, sum(nxy) over (partition by feature, v)::double as nx, sum(nxy) over (partition by feature, label)::double as ny, sum(nxy) over (partition by feature)::double as n from cells)"""
_MI = """mi as (select feature, max(n)::bigint as n_informed,
  case when max(n) < 100 then 0.0 else round_even(greatest(sum(case when nxy > 0 then nxy/n*ln(n*nxy/(nx*ny)) else 0.0 end), 0.0), 5) end as mutual_information from marg group by feature)"""
_CHI = """sized as (select *, count(distinct v) filter (where nx > 0 and ny > 0) over (partition by feature) as r, count(distinct label) filter (where nx > 0 and ny > 0) over (partition by feature) as k from marg),
expected as (select *, nx*ny/n as e, abs(nxy - nx*ny/n) as off from sized where nx > 0 and ny > 0),
chi as (select feature, max(n)::bigint as n_informed, max(r) as r, max(k) as k,
  sum(pow(case when (r-1)*(k-1) = 1 then off - least(off, 0.5) else off end, 2)/e) as x from expected group by feature),
chis as (select d.feature, case when r > 1 and k > 1 and n_informed >= 100 then round_even(x, 4) else 0.0 end as chi2_statistic,
  case when r > 1 and k > 1 and n_informed >= 100 then (r-1)*(k-1) else 0 end::bigint as dof,
  case when r > 1 and k > 1 and n_informed >= 100 then round_even(least(1.0, sqrt(x/(n_informed*(least(r,k)-1)))), 5) else 0.0 end as cramers_v, coalesce(n_informed, 0)::bigint as n_informed
  from (select distinct feature from l) d left join chi using (feature))"""


def _odds(top: int) -> str:
    return f"""c as (select label, idx, feature, count(*) as n, count(*) filter (where v=1) as n1 from l group by all),
r as (select *, sum(n) over (partition by feature) - n as rn, sum(n1) over (partition by feature) - n1 as r1 from c),
p as (select label, idx, feature, n1/n as i, coalesce(r1/nullif(rn,0), 0.0)::double as o from r),
q as (select *, ((i+1e-6)/(1-i+1e-6))/((o+1e-6)/(1-o+1e-6)) as x from p),
odds as (select label, feature, round_even(100*i, 2) as in_class_pct, round_even(100*o, 2) as out_class_pct, round_even(x, 3) as odds_ratio, round_even(log2(greatest(x, 1e-9)), 4) as log2_odds_ratio,
  row_number() over (partition by label order by round_even(x, 3) desc, idx) as rank from q qualify rank <= {top})"""


_GAP_PAIRS = [(f, c) for f, c in MAPPING.items() if c in ("quality", "toxic")]
_GAP = f"""pairs(feature, comparison_column) as (values {", ".join(f"('{f}', '{c}')" for f, c in _GAP_PAIRS)}),
there as (select 100.0*count(*) filter (where quality = 1)/count(*) as quality, 100.0*count(*) filter (where toxic = 1)/count(*) as toxic from documents left join labels using (doc_id)),
here as (select feature, 100.0*count(*) filter (where v <> 2)/count(*) as h from l group by feature),
gaps as (select feature, comparison_column, round_even(h, 2) as primary_pct_informed, round_even(a, 2) as comparison_pct_available, round_even(h - a, 2) as gap
  from (select feature, comparison_column, h, case comparison_column when 'quality' then quality else toxic end as a from pairs join here using (feature) cross join there))"""
_PHI = "case when n < {least} then 0.0 else coalesce((n*n11 - n1x*nx1)::double/nullif(sqrt(n1x::double*(n-n1x)*nx1*(n-nx1)), 0), 0.0) end"


def _pairs(key: str, label: bool = True, name: str = "pc", where: str = "") -> str:
    return f"""{name} as (select {"a.label," if label else ""} a.idx as i, b.idx as j, a.feature as f1, b.feature as f2, count(*) filter (where a.v<>2 and b.v<>2) as n, count(*) filter (where a.v=1 and b.v=1) as n11,
  count(*) filter (where a.v=1 and b.v<>2) as n1x, count(*) filter (where a.v<>2 and b.v=1) as nx1 from l a join l b on a.{key} = b.{key} and a.idx < b.idx {where} group by all)"""


def _singles(name: str = "s", where: str = "") -> str:
    return f"""{name}c as (select label, idx, feature, count(*) as n, count(*) filter (where v=1) as n1, count(*) filter (where v<>2) as inf from l {where} group by all),
{name} as (select label, idx, feature, round_even(n1/n, 3) as support, n1 as n_present, inf as n_informed, round_even(coalesce(n1/nullif(inf,0), 0.0), 3) as pct_of_informed, n,
  row_number() over (partition by label order by round_even(n1/n, 3) desc, idx) as rank from {name}c where n >= 20 and n1/n >= greatest(0.05, least(0.15, 30.0/n)))"""


_SIG_PAIRS = f"""spq as (select pc.label, i, j, f1 as feature_1, f2 as feature_2, round_even(n11/a.n, 3) as joint_support, n11 as n_both, round_even({_PHI.format(least=10).replace("n <", "pc.n <").replace("(n*", "(pc.n*").replace("(n-", "(pc.n-")}, 4) as phi_coefficient,
  row_number() over (partition by pc.label order by round_even(n11/a.n, 3) desc, i, j) as rk
  from pc join s a on a.label = pc.label and a.idx = i and a.rank <= 15 join s b on b.label = pc.label and b.idx = j and b.rank <= 15
  where n11/a.n >= greatest(0.05, least(0.10, 20.0/a.n))),
sp as (select * exclude (rk), rk as rank from spq where rk <= 30)"""
_CONFUSED = "confused(true_label, confused_with) as (values ('en','de'), ('de','en'), ('fr','es'), ('es','fr'), ('en','xx'))"
_CS = """csq as (select true_label, confused_with, a.feature, a.support as support_in_a, coalesce(b.support, 0.0) as support_in_b, round_even(a.support - coalesce(b.support, 0.0), 3) as discriminating_lift,
  count(*) over w as n_discriminators, row_number() over (partition by true_label, confused_with order by round_even(a.support - coalesce(b.support, 0.0), 3) desc, a.idx) as rk
  from confused join s a on a.label = true_label left join s b on b.label = confused_with and b.feature = a.feature
  where confused_with in (select label from s) and round_even(a.support - coalesce(b.support, 0.0), 6) >= 0.1 window w as (partition by true_label, confused_with)),
cs as (select * exclude (rk), rk as rank from csq where rk <= 10)"""
_ODD = "where regexp_extract(source, '(\\d+)$', 1)::int % 2 = 1"
_COMPLETE = f"""theirs as (select label, feature, count(*) filter (where v<>2)/count(*) as pct_informed from l {_ODD} group by all),
tp as (select label, f1 as feature_1, f2 as feature_2, {_PHI.format(least=10)} as their_phi from pt),
c1 as (select s.label, count(*) as n_signature_features, count(*) filter (where coalesce(pct_informed, 0) >= 0.05) as n_covered from s left join theirs using (label, feature) group by s.label),
c2 as (select sp.label, count(*) as n_signature_pairs, count(*) filter (where phi_coefficient > 0 and coalesce(their_phi, 0) >= 0.5*phi_coefficient) as n_pairs_intact from sp left join tp using (label, feature_1, feature_2) group by sp.label),
complete as (select label, n_signature_features, n_covered, coalesce(n_signature_pairs, 0) as n_signature_pairs, coalesce(n_pairs_intact, 0) as n_pairs_intact,
  round_even(n_covered/n_signature_features, 3) as single_coverage, round_even(coalesce(n_pairs_intact/nullif(n_signature_pairs,0), 0.0), 3) as pair_integrity,
  round_even((n_covered/n_signature_features + coalesce(n_pairs_intact/nullif(n_signature_pairs,0), 0.0))/2, 3) as reproducibility from c1 left join c2 using (label))"""
_STRIP = "regexp_replace({}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"
_TEXT = _STRIP.format("text")
_WORDS = """w as (select p_brand as category, unnest(string_split(p_name, ' ')) as value, p_partkey as position from part),
raw as (select * from w union all select p_brand, split_part(p_name, ' ', 1) || 's', p_partkey from part where p_partkey % 3 = 0
  union all select upper(category), '  ' || upper(value) || '  Type ', position from w where position % 5 = 0),
vocab as (select category, value, min(position) as position from (select regexp_replace(lower(trim(category)), '[\\s_]+', '_', 'g') as category, trim(regexp_replace(lower(trim(value)), '[\\s_]+', '_', 'g'), '_') as value, position from raw)
  where value <> '' and category <> '' group by all)"""
_JOBS = "jobs as (select source, doc_id, octet_length(encode(text))::bigint as bytes, (floor(length(text)/3.0 + 0.9999) + 240)::bigint as tokens, row_number() over (partition by source order by doc_id) as k from documents)"


def _matrix(where: str = "") -> str:
    return "select doc_id, " + ", ".join(f"max(case when idx = {i} then v end)::tinyint as {f}" for i, f, _, _ in _TERMS) + f" from l {where} group by doc_id"


ORACLES: dict[str, str] = {
    "coverage": f"with {_DOCS} {_COVERAGE}",
    "coverage_wide_vs_long": f"with {_DOCS}, c as ({_COVERAGE}) select feature, n_present, n_absent, n_unknown, informativeness from c",
    "coverage_of_order_lines": f"with {_LINES} {_COVERAGE}",
    "informed_gap": f"with {_DOCS}, {_GAP} select * from gaps",
    "coverage_report": f"""with {_DOCS}, c as ({_COVERAGE}), m(feature, comparison_column) as (values {", ".join(f"('{f}', '{c}')" for f, c in MAPPING.items())})
select feature, any_value(category) as category, any_value(comparison_column) is not null as has_equivalent, coalesce(any_value(comparison_column), '') as comparison_column, any_value(informativeness) as informativeness, any_value(pct_present) as pct_present
from c join dim using (feature) left join m using (feature) group by feature""",
    "mutual_information": f"with {_DOCS}, {_CELLS}, {_MI} select feature, mutual_information, n_informed from mi",
    "chi_square_cramers_v": f"with {_DOCS}, {_CELLS}, {_CHI} select * from chis",
    "classwise_odds": f"with {_DOCS}, {_odds(8)} select * from odds",
    "odds_of_order_lines": f"with {_LINES}, {_odds(20)} select * from odds",
    "questionnaire": f"""with {_DOCS}, {_odds(20)}, clusters(cluster, label) as (values ('all','en'),('all','de'),('all','fr'),('all','es'),('en','en'),('en','de'),('en','xx'),('de','de'),('de','en'),('fr','fr'),('fr','es'),('es','es'),('es','fr')),
m as (select cluster, feature, round_even(sum(round(odds_ratio*1000)::hugeint)::decimal(38,0) / count(*), 0)::double / 1000 as discriminatory_score from odds join clusters using (label) group by all)
select cluster, row_number() over (partition by cluster order by discriminatory_score desc, feature) as rank, feature, discriminatory_score,
  case feature when 'lex_a_the' then 'Is the article there?' else 'Does the patient show signs of ' || replace(feature, '_', ' ') || '?' end as question from m qualify rank <= 5""",
    "importance_context": f"""with {_DOCS}, {_CELLS}, {_MI}, {_CHI}, {_GAP}
select mi.feature, mutual_information, mi.n_informed, chi2_statistic, cramers_v, primary_pct_informed, comparison_pct_available, gap, mi.feature in ({", ".join(f"'{f}'" for f in MAPPING)}) as is_compared
from mi join chis using (feature) left join gaps using (feature)""",
    "phi_matrix": f"""with {_DOCS}, {_pairs("doc_id")}, top as (select label, idx, feature, row_number() over (partition by label order by count(*) filter (where v=1)/count(*) desc, idx) as rank from l group by label, idx, feature qualify rank <= 6),
p as (select pc.label, f1, f2, round_even({_PHI.format(least=10)}, 4) as phi from pc join top a on a.label = pc.label and a.idx = i join top b on b.label = pc.label and b.idx = j)
select label, f1 as feature_1, f2 as feature_2, phi as phi_coefficient from p union all select label, f2, f1, phi from p union all select label, feature, feature, 1.0 from top""",
    "strongest_correlations": f"""with {_DOCS}, {_pairs("doc_id")}, p as (select label, f1, f2, abs(round_even({_PHI.format(least=10)}, 4)) as phi from pc),
b as (select label, f1 as feature, phi from p union all select label, f2, phi from p), m as (select label, feature, max(case when phi = 1 then 0.0 else phi end) as strongest from b group by all)
select label, feature, strongest, row_number() over (partition by label order by strongest desc, feature) as rank from m qualify rank <= 5""",
    "redundant_pairs": f"""with {_DOCS}, {_pairs("doc_id", False)} select f1 as feature_1, f2 as feature_2, round_even({_PHI.format(least=50)}, 4) as phi_coefficient, n as n_informed from pc where abs({_PHI.format(least=50)}) >= 0.2""",
    "redundant_order_lines": f"""with {_LINES}, {_pairs("id", False)} select f1 as feature_1, f2 as feature_2, round_even({_PHI.format(least=50)}, 4) as phi_coefficient, n as n_informed from pc where abs({_PHI.format(least=50)}) >= 0.3""",
    "signature_singles": f"with {_DOCS}, {_singles()} select label, feature, support, n_present, n_informed, pct_of_informed, rank from s",
    "signature_pairs": f"with {_DOCS}, {_singles()}, {_pairs('doc_id')}, {_SIG_PAIRS} select label, feature_1, feature_2, joint_support, n_both, phi_coefficient, rank from sp",
    "signature_triplets": f"""with {_DOCS}, {_singles()}, p as (select doc_id, l.label, l.idx, l.feature, n from l join s on s.label = l.label and s.idx = l.idx and s.rank <= 10 where v = 1),
t as (select a.label, a.n, a.idx as i, b.idx as j, c.idx as k, a.feature || ' + ' || b.feature || ' + ' || c.feature as features, count(*) as n_all from p a join p b on a.doc_id = b.doc_id and a.idx < b.idx join p c on b.doc_id = c.doc_id and b.idx < c.idx group by all)
select label, features, round_even(n_all/n, 3) as joint_support, n_all, row_number() over (partition by label order by round_even(n_all/n, 3) desc, i, j, k) as rank from t where n_all/n >= greatest(0.05, least(0.10, 20.0/n)) qualify rank <= 20""",
    "completeness": f"with {_DOCS}, {_singles()}, {_pairs('doc_id')}, {_pairs('doc_id', name='pt', where=_ODD.replace('source', 'a.source'))}, {_SIG_PAIRS}, {_COMPLETE} select * from complete",
    "signature_summary": f"""with {_DOCS}, {_singles()}, {_pairs('doc_id')}, {_pairs('doc_id', name='pt', where=_ODD.replace('source', 'a.source'))}, {_SIG_PAIRS}, {_COMPLETE}
select s.label, any_value(s.n) as n_cases, count(*) as n_signature_features, arg_min(s.feature, s.rank) as top_feature, max(support) as top_feature_support, (select count(*) from sp where sp.label = s.label) as n_pairs,
  any_value(reproducibility) as reproducibility, any_value(single_coverage) as single_coverage, any_value(pair_integrity) as pair_integrity from s join complete using (label) group by s.label""",
    "confusion_singles": f"with {_DOCS}, {_singles()}, {_CONFUSED}, {_CS} select * from cs",
    "confusion_pairs": f"""with {_DOCS}, {_singles()}, {_pairs('doc_id')}, {_SIG_PAIRS}, {_CONFUSED}
select true_label, confused_with, row_number() over (partition by true_label, confused_with order by a.rank) as place, a.feature_1, a.feature_2, a.joint_support, a.phi_coefficient from confused join sp a on a.label = true_label
where confused_with in (select label from sp) and not exists (select 1 from sp b where b.label = confused_with and b.feature_1 = a.feature_1 and b.feature_2 = a.feature_2) qualify place <= 10""",
    "weighted_gap": f"""with {_DOCS}, {_singles()}, {_CONFUSED}, {_CS}, {_CELLS}, {_MI}
select true_label, confused_with, feature, discriminating_lift, round_even(coalesce(mutual_information, 0.0), 5) as global_mi, round_even(discriminating_lift*(1+10*coalesce(mutual_information, 0.0)), 4) as weighted_lift,
  row_number() over (partition by true_label, confused_with order by round_even(discriminating_lift*(1+10*coalesce(mutual_information, 0.0)), 4) desc, cs.rank) as rank from cs left join mi using (feature)""",
    "jaccard_labels": f"""with {_DOCS}, {_singles()}, t as (select label, list(feature) as f from s where rank <= 6 group by label)
select a.label as label_a, b.label as label_b, round_even(len(list_intersect(a.f, b.f))/len(list_distinct(list_concat(a.f, b.f))), 4) as jaccard from t a join t b on a.label < b.label""",
    "cross_dataset_overlap": f"""with {_DOCS}, {_singles()}, {_singles("z", _ODD)}, a as (select label, list(feature) as f from s where rank <= 5 group by label), b as (select label, list(feature) as g from z where rank <= 5 group by label)
select label, len(f)::bigint as own_top, len(g)::bigint as their_top, len(list_intersect(f, g))::bigint as overlap, round_even(len(list_intersect(f, g))/len(list_distinct(list_concat(f, g))), 3) as jaccard,
  array_to_string(list_sort(list_filter(f, lambda x: not list_contains(g, x)))[1:5], ', ') as own_only, array_to_string(list_sort(list_filter(g, lambda x: not list_contains(f, x)))[1:5], ', ') as their_only from a join b using (label)""",
    "blend_scores": """with e as (select user_id, event_type as condition, value from events),
v as (select user_id as case_id, condition, round_even(avg(value), 4) as v from e where user_id % 3 <> 0 group by all),
s as (select user_id as case_id, condition, case when user_id % 3 = 2 then unnest([round_even(max(value), 4), round_even(avg(value), 4)]) else round_even(avg(value), 4) end as s from e group by all),
ss as (select user_id as case_id, condition, round_even(max(value), 4) as s from e where user_id % 3 = 2 group by all union all select user_id, condition, round_even(avg(value), 4) from e where user_id % 3 <> 2 group by all),
j as (select coalesce(v.case_id, ss.case_id) as case_id, coalesce(v.condition, ss.condition) as condition, 0.7*coalesce(v, 0.0) + (1-0.7)*coalesce(s, 0.0) as m from v full join ss on v.case_id = ss.case_id and v.condition = ss.condition)
select case_id, condition, round_even(m/nullif(sum(m) over (partition by case_id), 0), 3) as blended from j""",
    "dedup_captions": f"select min(doc_id) as doc_id, lang, arg_min(source, doc_id) as source from documents where {_TEXT} <> '' group by lang, {_TEXT}",
    "dedup_stats": f"""select count(*) as total_rows, count(distinct {_TEXT}) filter (where {_TEXT} <> '') as unique_texts, count(*) filter (where coalesce({_TEXT}, '') = '') as empty_texts,
  count(*) - count(distinct {_TEXT}) filter (where {_TEXT} <> '') - count(*) filter (where coalesce({_TEXT}, '') = '') as duplicates_saved from documents""",
    "replicate_vectors": f"with {_DOCS}, t as (select doc_id, {_TEXT} as k, lang from documents), known as (select distinct k from t where lang <> 'es' and k <> ''), m as ({_matrix()}) select doc_id, "
    + ", ".join(f"case when known.k is null then 2 else {f} end::tinyint as {f}" for _, f, _, _ in _TERMS)
    + " from m join t using (doc_id) left join known using (k)",
    "resume_remaining": "select md5(text) as text from documents group by text having bool_or(lang = 'de') or not bool_or(lang = 'en')",
    "failed_requeue": "select count(distinct text) as n_requeued from documents where lang = 'de'",
    "stratified_sample": """with n as (select lang, count(*) as total, count(distinct source) as parts from documents group by lang),
w as (select *, case when total > 500 then 100 when total > 100 then 60 when total > 20 then 20 else total end as wanted from n),
e as (select *, case when parts > 1 and wanted < total then greatest(1, wanted // parts) else wanted end as each from w),
r as (select doc_id, lang, source, md5('42:' || doc_id) as o, row_number() over (partition by lang, source order by md5('42:' || doc_id), doc_id) as k from documents)
select doc_id, lang, source from r join e using (lang) where k <= each qualify row_number() over (partition by lang order by o, doc_id) <= any_value(wanted) over (partition by lang)""",
    "sample_tiers": """with n as (select lang, count(*) as n from documents group by lang) select case when n > 500 then 'over_500' when n > 120 then 'over_120' when n > 20 then 'over_20' else 'all' end as tier, count(*) as n_labels, sum(n)::bigint as n_rows,
  sum(case when n > 5000 then 500 when n > 1000 then 300 when n > 200 then 200 else n end)::bigint as n_sampled from n group by tier""",
    "batch_assignment": "select doc_id, lang, ((row_number() over (partition by lang order by doc_id) - 1) // 15)::bigint as batch from documents",
    "request_prompts": """with u as (select role, conv_id*1000 + turn as id, text, (row_number() over (partition by role order by conv_id*1000 + turn) - 1) // 6 as b, (row_number() over (partition by role order by conv_id*1000 + turn) - 1) % 6 + 1 as k from conversations where role = 'user')
select role || '-' || b as custom_id, string_agg('[' || k || '] ' || text, chr(10) || chr(10) order by k) as prompt, 512::bigint as max_tokens from u group by role, b""",
    "chunk_plan": f"""with recursive {_JOBS}, f as (
  select source, doc_id, bytes, tokens, k, 0 as chunk, 1 as n, bytes as b, tokens as t from jobs where k = 1
  union all select j.source, j.doc_id, j.bytes, j.tokens, j.k, f.chunk + (f.n >= 20 or f.b + j.bytes > 10000000 or f.t + j.tokens > 20000)::int, case when f.n >= 20 or f.b + j.bytes > 10000000 or f.t + j.tokens > 20000 then 1 else f.n + 1 end,
    case when f.n >= 20 or f.b + j.bytes > 10000000 or f.t + j.tokens > 20000 then j.bytes else f.b + j.bytes end, case when f.n >= 20 or f.b + j.bytes > 10000000 or f.t + j.tokens > 20000 then j.tokens else f.t + j.tokens end
  from f join jobs j on j.source = f.source and j.k = f.k + 1)
select source, doc_id, bytes, tokens, chunk from f""",
    "cost_estimate": """with u as (select lang, sum(floor(length(text)/3.0 + 0.9999) + 40)::bigint as input_tokens, count(*)*90 as output_tokens from documents group by lang),
p as (select *, case lang when 'en' then 'small' when 'de' then 'large' else 'nano' end as model, floor(input_tokens*0.8)::bigint as hit from u),
q as (select *, (input_tokens - hit)*(case model when 'small' then 0.15 when 'large' then 2.0 else 0.1 end)::double/1e6 as a, hit*(case model when 'small' then 0.075 when 'large' then 0.5 else 0.025 end)::double/1e6 as b, output_tokens*(case model when 'small' then 0.6 when 'large' then 8.0 else 0.4 end)::double/1e6 as c from p)
select model, lang, input_tokens, output_tokens, hit as cached_input_tokens, input_tokens - hit as uncached_input_tokens, round_even(a, 4) as input_cost_usd, round_even(b, 4) as cached_cost_usd, round_even(c, 4) as output_cost_usd, round_even(a+b+c, 4) as total_cost_usd, round_even((a+b+c)*0.5, 4) as batch_cost_usd from q""",
    "output_budget": """with n as (select source, count(*) as n from documents group by source) select source, n as n_texts, greatest(512, least(8192, 220*n+200))::bigint as strict, greatest(512, least(8192, 90*n+200))::bigint as loose,
  greatest(100000, (n*40000 - greatest(250000, n*40000 // 4)) // 2)::bigint as chunk_tokens, greatest(1, floor(16384*0.8/(7*n+40)))::bigint as safe_batch from n""",
    "normalize_vocab": f"with {_WORDS} select * from vocab",
    "plural_collapse": f"""with {_WORDS}, c as (select *, case when value like '%ies' and len(value) > 3 then [value[:-4] || 'y'] when regexp_matches(value, '(ch|sh|x|z)es$') and len(value) > 4 then [value[:-3]]
  when value like '%es' and value not like '%ses' and len(value) > 2 then [value[:-3], value[:-2]] when value like '%s' and not regexp_matches(value, '(ss|us)$') and len(value) > 1 then [value[:-2]] else [] end as x from vocab)
select category, value, position from c where not exists (select 1 from vocab v where v.category = c.category and list_contains(c.x, v.value))""",
    "enum_filter": """with raw as (select 'type' as category, lower(p_type) as value, p_partkey as position from part union all select 'status', regexp_replace(lower(case when o_orderstatus = 'P' then 'None' else o_orderpriority end), '[\\s_]+', '_', 'g'), o_orderkey from orders)
select category, value, min(position) as position from raw where (category = 'type' and value in ('economy', 'promo')) or (category <> 'type' and value <> 'none') group by all""",
    "vocab_union": f"""with {_WORDS}, x(category, value) as (values ('brand#11', 'extra'), ('brand#99', 'new')) select category, value, false as added from vocab union all select category, value, true from x where (category, value) not in (select (category, value) from vocab)""",
    "safe_names": """select page_id, regexp_replace(url, '[^\\w\\-]', '_', 'g')[:60] as file_name, case when len(url) > 20 then url[:17] || '...' else url end as label from pages""",
    "keyword_lane": "select doc_id, " + ", ".join(f"case when contains(lower(text), '{t}') then 1 else 2 end::tinyint as {f}" for _, f, _, t in _TERMS) + " from documents",
    "all_unknown_audit": f"""with {_DOCS}, q as (select doc_id from l where category in ('lex_c', 'lex_e') group by doc_id having min(v) = 2)
select case when len({_TEXT}) >= 300 then 'silent_empty' else 'short_text' end as reason, count(*) as n_rows from documents join q using (doc_id) group by reason""",
    "label_distribution": "select lang as label, count(*) as n_rows, round_even(100.0*count(*)/sum(count(*)) over (), 2) as percentage from documents group by lang",
    "prevalence_pivot": f"with {_DOCS} select source as label, count(distinct doc_id) as n_rows, " + ", ".join(f"round_even(100.0*count(*) filter (where idx = {i} and v = 1)/count(distinct doc_id), 2) as {f}" for i, f, _, _ in _TERMS[:6]) + " from l group by source order by n_rows desc, label limit 10",
    "eda_stats": f"""with {_DOCS}, c as ({_COVERAGE}) select (select count(*) from documents) as total_records, (select count(distinct lang) from documents) as total_labels, count(*) as total_features, round_even(avg(informativeness), 2) as mean_informativeness,
  round_even(median(informativeness), 2) as median_informativeness, count(*) filter (where informativeness > 50) as n_over_50, count(*) filter (where informativeness < 10) as n_under_10 from c""",
    "category_mean": f"with {_DOCS}, c as ({_COVERAGE}) select case when feature like 'lex_e%' then 'lex' else category end as category, round_even(avg(informativeness), 2) as mean_informativeness, count(*) as n_features from c join dim using (feature) group by 1",
    "informativeness_histogram": f"""with {_DOCS}, c as ({_COVERAGE}), e as (select min(informativeness) as a, max(informativeness) as z from c)
select case when z = a then 4 else least(7, floor((informativeness - a)/((z - a)/8))) end::int as bin, count(*) as n_features from c cross join e group by bin""",
    "caption_lengths": f"""with n as (select length(text) as n from documents where {_TEXT} <> ''), b as (select case when n >= 1000 then 1000 when n >= 500 then 500 when n >= 400 then 400 when n >= 300 then 300 when n >= 250 then 250 when n >= 200 then 200 when n >= 150 then 150 when n >= 100 then 100 when n >= 50 then 50 else 0 end::int as bin from n)
select bin, count(*) as n_texts, round_even(100.0*count(*)/sum(count(*)) over (), 1) as percentage from b group by bin""",
    "merged_questionnaire": """select d.doc_id, case quality when 1 then 1 when 0 then 0 else 2 end::tinyint as quality, case toxic when 1 then 1 when 0 then 0 else 2 end::tinyint as toxic,
  case when quality = 1 or toxic = 1 then 1 when quality is null and toxic is null then 2 else 0 end::tinyint as either from documents d left join labels using (doc_id)""",
    "schema_document": """with v as (select distinct lower(p_brand) as category, lower(p_type) as value from part), g as (select category, list(value order by value) as features, coalesce(list(value order by value) filter (where category = 'brand#11' and value = 'economy'), []) as c from v group by category)
select category, len(features)::bigint as n_features, '{"category":"' || category || '","features":[' || array_to_string(list_transform(features, lambda x: '"' || x || '"'), ',') || '],"comparable_features":[' || array_to_string(list_transform(c, lambda x: '"' || x || '"'), ',') || ']}' as document from g""",
}
ORACLES["blend_scores"] = "with " + ORACLES["blend_scores"].split("\n", 1)[0].removeprefix("with ") + "\n" + "\n".join(x for x in ORACLES["blend_scores"].split("\n")[1:] if not x.startswith("s as"))

ORACLES |= {f"regex_{k}": f"with {cases.CAPTIONS_SQL} {v}" for k, v in cases.FACTS_SQL.items()} | {f"keyword_{k}": cases.keyword_sql(v) for k, v in cases.LEXICONS.items()}
_ALL = ", ".join(f"f_{k} as ({v})" for k, v in cases.FACTS_SQL.items())
ORACLES |= {
    "extracted_facts": "with c as (select doc_id as id, lower(regexp_replace(text, '[^\\x00-\\x7f]', '_', 'g')) as t from documents), " + _ALL + " select age_numeric, age_group, sex, fitzpatrick_skin_type, duration_bucket, onset_sudden, diagnosis_confidence, lesion_count, count(*) as n_documents from "
    + " join ".join(f"f_{k}" + (" using (id)" if i else "") for i, k in enumerate(cases.FACTS_SQL)) + " group by all",
    "gate_matrix": """with c as (select case o_orderstatus when 'O' then 'NORMAL' when 'F' then 'ABNORMAL' else 'BORDERLINE' end as image, case when o_totalprice > 300000 then 'CONCERNING' when o_totalprice > 100000 then 'MILD' else 'NORMAL' end as symptoms from orders)
select image, symptoms, case image when 'NORMAL' then case symptoms when 'NORMAL' then 'A' when 'MILD' then 'B' else 'C' end when 'BORDERLINE' then case symptoms when 'NORMAL' then 'D' when 'MILD' then 'E' else 'F' end else case symptoms when 'NORMAL' then 'G' when 'CONCERNING' then 'H' end end as gate_case,
  case when image = 'NORMAL' or (image = 'BORDERLINE' and symptoms = 'NORMAL') then false when image = 'ABNORMAL' and symptoms = 'MILD' then null else true end as proceeds,
  case gate_case when 'A' then 'reassure' when 'B' then 'gp_if_persistent' when 'C' then 'gp_referral' when 'D' then 'monitor' when 'E' then 'low_confidence_differential' when 'F' then 'moderate_differential' when 'G' then 'differential_asymptomatic' when 'H' then 'full_differential' end as action, count(*) as n_cases from c group by all""",
    "report_validate": f"with {cases.REPORTS_SQL}",
    "enforced_enums": f"with {cases.RAW_SQL}",
    "plural_candidates": f"""with w as (select distinct w || [{", ".join(repr(e) for e in cases.ENDINGS)}][1 + p_partkey % {len(cases.ENDINGS)}] as word from (select unnest(string_split(p_name, ' ')) as w, p_partkey from part))
select word, case when word like '%ies' and len(word) > 3 then word[:-4] || 'y' when regexp_matches(word, '(ch|sh|x|z)es$') and len(word) > 4 then word[:-3] when word like '%es' and word not like '%ses' and len(word) > 2 then word[:-3] || '|' || word[:-2]
  when word like '%s' and not regexp_matches(word, '(ss|us)$') and len(word) > 1 then word[:-2] else '' end as singulars from w""",
    "llm_parse_status": f"with {cases.ANSWERS_SQL} select id, status, n::bigint as n_items, k::bigint as n_nontrivial from p",
    "retry_action": f"""with {cases.ANSWERS_SQL} select id, case when status in ('ok', 'loop') then case when k = 0 and longest >= 15 then 'remind' else 'accept' end when status = 'shape' then 'give_up' when status = 'short' and shape <> 9 and k = 0 then 'redo_all'
  when status in ('short', 'salvaged') then 'redo_tail' else 'redo_all' end as action from p""",
    "answered_values": f"with {cases.ANSWERS_SQL}, {cases.VALUES_SQL} select id, place::int as place, category, value from p join v using (shape) where not missing and place < want",
    "batch_answers": f"with {cases.LINES_SQL} select * from b",
    "batch_output_usage": f"with {cases.LINES_SQL} select count(*) as n_answers, coalesce(sum(prompt_tokens), 0)::bigint as prompt_tokens, coalesce(sum(completion_tokens), 0)::bigint as completion_tokens, coalesce(sum(cached_tokens), 0)::bigint as cached_tokens from b",
    "unanswered_requests": "select 'r' || o_orderkey as custom_id from orders where o_custkey % 7 not in (0, 1, 6)",
    "error_histogram": "select case when o_custkey % 7 = 2 then 'rate_limit' else 'unknown' end as code, count(*) as n_errors from orders where o_custkey % 7 in (2, 5) group by code",
    "encoded_answers": f"""with said(i, category, value, meant) as (values {", ".join(f"({i}, {repr(c) if c else 'null'}, {repr(v) if v else 'null'}, {repr(m) if m else 'null'})" for i, ((c, v), m) in enumerate(zip(cases.SAID, cases.MEANT)))}),
k as (select c_custkey as id, unnest(case when c_custkey % 2 = 0 then [c_custkey, c_custkey * 3 + 1] else [c_custkey, c_custkey * 5 + 2, c_custkey + 7] end) as step from customer),
s as (select id, category, value, meant from k join said on step % {len(cases.SAID)} = i),
fx as (select id, count(*) filter (where value is not null and meant is null) as fixes from s group by id)
select id, fixes, """ + ", ".join(f"case when bool_or(meant = '{f}') then 1 when bool_or(meant like '{c}%') then 0 else 2 end::tinyint as {f}" for _, f, c, _ in _TERMS) + " from s join fx using (id) group by id, fixes",
}

ORACLES |= {
    "dry_run_calls": f"""with u as (select source, source in ('src0', 'src3') as done, count(distinct case when source not in ('src0', 'src3') and {_TEXT} <> '' then {_TEXT} end) as n from documents where source is not null group by all)
select count(*) as n_labels, count(*) filter (where done) as n_done, sum(n)::bigint as n_unique, sum(ceil(n / 10.0))::bigint as n_calls from u""",
    "full_mode_rows": "select lang, count(*) as n_rows, ceil(count(*) / 25.0)::bigint as n_batches from documents where lang is not null group by lang",
    "counted_prompts": """with t as (select *, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn, text) as i from conversations where text is not null)
select conv_id, md5('Texts: ' || any_value(n) || chr(10) || chr(10) || string_agg('[' || i || case when i = n then ', LAST] ' else '] ' end || text, chr(10) || chr(10) order by i) || chr(10) || chr(10) || 'Answer with exactly ' || any_value(n) || ' items, one for each text.') as digest from t group by conv_id""",
    "tagged_prompts": """with t as (select *, row_number() over (partition by conv_id order by turn, text) as i from conversations where text is not null)
select conv_id, md5(string_agg('[' || i || '] ' || text || chr(10) || 'tags: ' || case when turn % 2 = 0 then 't, ' || role else '(empty)' end, chr(10) || chr(10) order by i)) as digest from t group by conv_id""",
    "flattened_conversations": "select conv_id, md5(string_agg(coalesce(role, 'user') || ': ' || coalesce(text, ''), chr(10) order by turn)) as digest from conversations group by conv_id",
    "repaired_answers": f"with {cases.ANSWERS_SQL} select id, want::int as n_repaired, (want - least(n, want) + case when shape = 7 and not missing and want >= 2 then 1 else 0 end)::int as n_empty from p",
    "coerced_states": "select o_orderkey as id, case o_custkey % 5 when 1 then 1 when 2 then 0 when 3 then 1 else 2 end::int as f from orders",
    "feature_lanes": "select p_type as name, case when max(p_size) > 48 and min(p_size) < 3 then 'rule' else 'model' end as lane from part group by p_type",
    "truncated_captions": "select doc_id, md5(text[:500]) as digest, least(length(text), 500)::int as n_chars from documents",
    "features_without_counterpart": f"with {_DOCS}, c as ({_COVERAGE}) select * from c where feature not in ({', '.join(repr(f) for f in MAPPING)})",
    "coverage_extremes": f"""with {_DOCS}, c as ({_COVERAGE}), r as (select feature, informativeness, row_number() over (order by informativeness desc, feature) as a, row_number() over (order by informativeness, feature) as z from c)
select 'top' as side, feature, informativeness, a as rank from r where a <= 5 union all select 'bottom', feature, informativeness, z from r where z <= 5""",
    "first_features": f"with {_DOCS}, c as ({_COVERAGE}) select feature, n_present, n_absent, n_unknown from c join dim using (feature) where idx < 10",
    "merged_records": """with p as (select p_brand as category, split_part(p_name, ' ', 1) as value, p_type, p_name, 'size_' || p_size % 3 as label from part)
select category, value, list_sort(list(distinct p_type))[:10] as examples, list_sort(list(distinct p_name))[:5] as contexts, list_sort(list(distinct label)) as labels from p group by all""",
}
