"""SQL for the queries over ``documents`` that SQL can express."""

from __future__ import annotations

_BLANKS = r"[^\x20\x09-\x0D]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOW.format("coalesce(text,'')")}, '{_BLANKS}') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i+4], chr(1)) g from (select doc_id, w, unnest(range(1, greatest(len(w)-4,1)+1)) i from w where len(w)>0)),
n as (select w.doc_id, count(s.g) n from w left join s using (doc_id) group by 1),
sets as (select doc_id, md5(string_agg(g, chr(2) order by g)) h from s group by 1),
reps as (select min(doc_id) rep, h from sets group by h),
rs as (select s.doc_id, s.g from s semi join reps on reps.rep=s.doc_id),
both_ as (select a.doc_id a, b.doc_id b, count(*) k from rs a join rs b on a.g=b.g and a.doc_id<b.doc_id group by 1,2),
links as (select a, b from both_ join n x on x.doc_id=a join n y on y.doc_id=b where 100*k>=85*(x.n+y.n-k)),
sym as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from sym union select r.a, s.b from reach r join sym s on s.a=r.b),
top as (select a, least(a, min(b)) c from reach group by a),
named as (select sets.doc_id, coalesce(top.c, reps.rep) c from sets join reps using (h) left join top on top.a=reps.rep)
select n.doc_id, n.n n_shingles, coalesce(named.c, n.doc_id) component_id, coalesce(named.c, n.doc_id)=n.doc_id kept from n left join named using (doc_id)
"""

OP4 = rf"""
with u as (select doc_id, len(regexp_extract_all(coalesce(text,''), '{_BLANKS}')) size, source from documents),
s0 as (select source, cast(sum(size) as bigint) source_size from u group by 1),
s1 as (select *, row_number() over (order by source nulls last) place from s0),
s2 as (select *, (place-1)%3+1 weight, 3.0::double*source_size/((place-1)%3+1) lim from s1),
s3 as (select *, coalesce(sum(3*source_size) over (order by lim, place rows between unbounded preceding and 1 preceding),0) filled, sum(weight) over (order by lim, place rows between current row and unbounded following) open_, sum(source_size) over () every_ from s2),
s4 as (select *, (1.0::double*every_-filled)/open_ lev from s3),
s5 as (select *, (select lev from s4 where lev<=lim order by lim, place limit 1) fill from s4),
s6 as (select source, source_size, place, least(cast(3*source_size as double), coalesce(fill, lim)*weight) target from s5),
q0 as (select u.doc_id, u.size, s6.place, s6.source_size, s6.target, cast(least(3, greatest(1, ceil(case when s6.source_size=0 then 1 else s6.target/s6.source_size end))) as int) epochs from u join s6 on u.source is not distinct from s6.source),
q1 as (select *, unnest(range(0, epochs)) epoch from q0),
q2 as (select *, md5(concat('mix:', epoch, ':', doc_id)) key from q1),
q3 as (select *, sum(size) over (partition by place order by epoch, key, doc_id rows between unbounded preceding and current row) upto from q2),
q4 as (select *, case when target=0 then 0.0 else (upto-size/2.0::double)/target end finish from q3),
q5 as (select *, coalesce(sum(size) over (order by finish, place, epoch, key, doc_id rows between unbounded preceding and 1 preceding),0) before from q4)
select doc_id, cast(size as bigint) size, source_size, target, cast(sum(case when before+size/2.0::double<=(select sum(target) from s6) then size else 0 end) as bigint) taken from q5 group by doc_id, size, source_size, target
"""

OP7 = rf"""
with l as (select doc_id, coalesce(source, chr(0)) host, text, unnest(string_split(coalesce(text,''), chr(10))) line, unnest(range(len(string_split(coalesce(text,''), chr(10))))) pos from documents),
lw as (select *, regexp_extract_all(line, '{_BLANKS}') w from l),
ln as (select *, {_LOW.format("array_to_string(w, ' ')")} h from lw where len(w)>0),
ol as (select doc_id, host, md5(string_agg(h, chr(10) order by pos)) contents from ln group by all),
dup as (select doc_id, count(*)-count(distinct line) n_dup_lines from ln group by 1),
freq as (select ln.host, h from ln join ol using (doc_id, host) group by all having count(distinct contents)>10),
gone as (select doc_id, sum(len(w)) gone from ln semi join freq using (host, h) group by 1),
t as (select doc_id, regexp_extract_all(coalesce(text,''), '{_BLANKS}') w, len(regexp_replace(coalesce(text,''), '[^#*$%&|<>]', '', 'g')) n_symbols, len(regexp_replace(coalesce(text,''), '[\x20\x09-\x0D]', '', 'g')) word_chars from documents),
win as (select doc_id, i, array_to_string(w[i:i+7], chr(1)) g from (select doc_id, w, unnest(range(1, len(w)-6)) i from t where len(w)>=8)),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) c from win) where c>1),
rw as (select doc_id, count(distinct i+k) n from rep, (select unnest(range(0,8)) k) group by 1),
m as (select t.doc_id, cast(len(w) as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(coalesce(n_dup_lines,0) as bigint) n_dup_lines, cast(coalesce(rw.n,0) as bigint) n_repeat_words, coalesce(gone,0) gone from t left join dup using (doc_id) left join rw using (doc_id) left join gone using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words<20 or 100*n_repeat_words>30*n_words base_failed, not (n_words<20 or 100*n_repeat_words>30*n_words) and not (100*(n_words-gone)<30*n_words) kept from m
"""

ORACLE_SQL = {"op1_near_dedup": OP1, "op4_source_mix": OP4, "op7_quality_rules": OP7}
