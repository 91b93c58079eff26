"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

EXACT_DEDUP = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h
           from documents),
r as (select *, row_number() over (partition by h order by n desc, doc_id) as k, count(*) over (partition by h) as c from d)
select r.doc_id, f.doc_id as keep_id, r.c as group_size, r.k = 1 as kept, r.h as text_sha256
from r join r as f on f.h = r.h and f.k = 1"""

CHAT_COLLAPSE = """
with t as (select distinct conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text
           from conversations where conv_id is not null),
p as (select c, row_number() over w as pos, count(*) over (partition by c) as n,
        string_agg(md5(role) || md5(text), '') over w as k, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '') over w as shown
      from t window w as (partition by c order by turn nulls first, role, text rows unbounded preceding)),
whole as (select k, min(c) as c, count(*) as n_equal, any_value(n) as n, any_value(shown) as shown from p where pos = n group by k)
select c as conv_id, n as n_turns, n_equal, shown as rendered
from whole where k not in (select k from p where pos < n)"""

FILL_MIDDLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
             regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents),
n as (select doc_id, t, u, len(u) as n, cast('0x' || h[1:8] as bigint) % (len(u) + 1) as a, cast('0x' || h[9:16] as bigint) % (len(u) + 1) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || h[17:24] as bigint) % 100 >= 50
             then 'plain' when cast('0x' || h[25:32] as bigint) % 100 < 80 then 'spm' else 'psm' end as form from d),
p as (select doc_id, t, n, form, coalesce(array_to_string(u[1:least(a, b)], ''), '') as head,
        coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') as middle,
        coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') as tail from n)
select doc_id, n, form, case when form <> 'plain' then length(head) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'spm' then '<S>' || tail || '<P>' || head || '<M>' || middle
         else '<P>' || head || '<S>' || tail || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from p"""

PREFIX_TRIE = """
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as pos,
             md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) as k, length(coalesce(text, '')) as chars
           from conversations where conv_id is not null),
s as (select c, max(pos) as own, xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(c::varchar, ''), lambda x: ord(x)::bigint),
        lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 as h
      from t group by c),
r as (select s.c, t.pos, t.k, t.chars from s join t on t.c = s.c - s.c % 100 and t.pos <= s.h
      union all
      select s.c, t.pos - s.h + least(s.h, coalesce(b.own, 0)), t.k, t.chars from s join t on t.c = s.c and t.pos > s.h
      left join s as b on b.c = s.c - s.c % 100),
p as (select c, pos as d, md5(string_agg(k, '') over (partition by c order by pos rows unbounded preceding)) as node, chars from r
      union all select c, 0, '', 0 from s),
z as (select c, max(d) as n from p group by c),
nodes as (select d, node, min(c) as c, count(*) as n_convs, max(chars) as chars from p group by d, node),
up as (select nodes.*, p.node as parent, q.c as pc from nodes left join p on p.c = nodes.c and p.d = nodes.d - 1
       left join nodes as q on q.d = p.d and q.node = p.node),
kids as (select d - 1 as d, parent as node, count(*) as n_children from up where d > 0 group by all),
own as (select up.*, coalesce(n_children, 0) as n_children, (up.n_convs - 1) * up.chars as saved from up left join kids using (d, node)),
below as (select p.d, p.node, sum(case when own.n_children = 0 then 1 else 0 end) as n_leaves, sum(own.saved) as saved
          from own join p on p.c = own.c and p.d <= own.d group by all),
ends as (select p.d, p.node, sha256(string_agg(p.c::varchar, ',' order by p.c)) as h from p join z on z.c = p.c and z.n = p.d group by all)
select own.c as conv_id, cast(own.d as bigint) as depth, own.pc as parent_conv_id, own.n_convs, own.n_children, cast(n_leaves as bigint) as n_leaves,
  cast(below.saved as bigint) as saved_tokens, coalesce(ends.h, sha256('')) as ends_sha256
from own join below using (d, node) left join ends using (d, node)"""
