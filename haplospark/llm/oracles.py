"""DuckDB SQL for the corpus queries that SQL can express."""

OP11 = """with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
 h as (select doc_id, t, length(t) as n, cast('0x' || s[1:8] as ubigint) as h1, cast('0x' || s[9:16] as ubigint) as h2,
   cast('0x' || s[17:24] as ubigint) % 100 as h3, cast('0x' || s[25:32] as ubigint) % 100 as h4 from d),
 c as (select doc_id, t, n, cast(least(h1 % (n + 1), h2 % (n + 1)) as bigint) as a, cast(greatest(h1 % (n + 1), h2 % (n + 1)) as bigint) as b,
   case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain' when h4 < 20 then 'spm' else 'psm' end as form from h),
 p as (select *, substr(t, 1, a) as x, substr(t, a + 1, b - a) as m, substr(t, b + 1, n - b) as z from c)
 select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
   sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || m else '<S>' || z || '<P>' || x || '<M>' || m end) as output_sha256,
   sha256(t) as restored_sha256 from p"""

OP12 = """with recursive crc as (select list(list_reduce(list_prepend(i, [cast(0 as bigint) for x in range(8)]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
 runs as (select coalesce(cast(doc_id as varchar), '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
 d as (select w, id || ':' || w as s, count(*) as n from runs where length(w) >= 5 group by 1, 2),
 b as (select w, n, flatten([case when c < 128 then [c] else [cast(195 as bigint), c - 64] end for c in [cast(unicode(substr(s, i, 1)) as bigint) for i in range(1, length(s) + 1)]]) as bytes from d),
 h as (select w, n, xor(list_reduce(list_prepend(cast(4294967295 as bigint), bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from b, crc),
 e as (select case when h % 97 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from h),
 v as (select word, cast(sum(n) as bigint) as n from e where length(word) >= 5 group by 1 having sum(n) >= 3),
 del as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as d from (select word, unnest(range(1, length(word) + 1)) as i from v)),
 near as (select a.word, b.word as other from del a join del b on a.i = b.i and a.d = b.d and a.word <> b.word
   union select del.word, v.word from del join v on del.d = v.word union select v.word, del.word from del join v on del.d = v.word),
 best as (select near.word, count(*) as n_near, min({'n': -v.n, 'w': other}) as b from near join v on v.word = other group by 1),
 f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when -b.n >= 2 * v.n then b.w end as form, case when -b.n >= 2 * v.n then -b.n end as form_n from v left join best on best.word = v.word),
 walk as (select word, form as at from f where form is not null union all select walk.word, f.form from walk join f on f.word = walk.at where f.form is not null),
 ends as (select walk.word, walk.at as root from walk join f on f.word = walk.at where f.form is null)
 select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n from f left join ends on ends.word = f.word"""

OP13 = """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 s as (select doc_id, case when len(w) = 0 then [] else list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, greatest(len(w) - 1, 2))]) end as s from w),
 n as (select doc_id, len(s) as n from s), e as (select doc_id, n, unnest(s) as x from s join n using (doc_id)),
 p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as k from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2, 3, 4),
 l as (select a, b from p where 100 * k >= 85 * (na + nb - k)), d as (select a, b from l union all select b, a from l),
 r as (select doc_id as node, doc_id as c from n union select d.b, r.c from r join d on d.a = r.node),
 m as (select node as doc_id, min(c) as component_id from r group by 1)
 select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from n join m using (doc_id)"""

ORACLES: dict[str, str] = {"op11_fill_in_middle": OP11, "op12_spelling_variants": OP12, "op13_minhash": OP13}
