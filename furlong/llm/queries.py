"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from . import chat, decontamination, exact_dedup, jaccard_join, line_dedup, merkle, mixing, pii, quality, quality_rules, repair
from . import substring_dedup, token_store
from .common import read, shared_folder, written


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark, sf_dir):
    return decontamination.digest(decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op4_token_store(spark, sf_dir):
    path = shared_folder(spark) + "-tokens"
    token_store.write_tokens(read(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return token_store.read_tokens(spark, path)


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


#: Ids of byte_bpe_50k.json; reserved ids follow.
BYTE_BPE_IDS = 50257


def op7_chat_formatting(spark, sf_dir):
    own = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    path = tokenizer_file("byte_bpe_50k.json")
    chats = written(chat.format_chats(turns, path, BYTE_BPE_IDS), "chats")
    return chat.digest(chat.render(chats, path, BYTE_BPE_IDS))


def op8_substring_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return substring_dedup.digest(docs, substring_dedup.repeated_passages(docs))


def op2_pii_pseudonyms(spark, sf_dir):
    """With a key for tests; a real one belongs in the setting that the operator reads."""
    return pii.pseudonymise(read(spark, sf_dir, "documents"), spark.conf.get(pii.KEY_SETTING, "a key for tests"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.digest(line_dedup.line_dedup(read(spark, sf_dir, "documents")))


def op9_quality_classifier(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_mixing(spark, sf_dir):
    """All domains at their target weights; nothing is kept whole."""
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark, sf_dir):
    """Proofs of all documents, and what they say once the newlines of some are gone."""
    docs = read(spark, sf_dir, "documents")
    return merkle.digest(merkle.manifest(docs, {"tampered": merkle.tampered_leaf(docs)}).proofs())


def op12_conversation_repair(spark, sf_dir):
    """Conversations damaged by the contract's rule, and repaired."""
    turns = read(spark, sf_dir, "conversations")
    return repair.digest(turns, repair.repair(repair.damage(turns)))


def op13_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_OPERATORS = (
    op1_benchmark_decontamination, op2_pii_pseudonyms, op3_line_dedup, op4_token_store, op5_jaccard_join,
    op6_exact_dedup, op7_chat_formatting, op8_substring_dedup, op9_quality_classifier, op10_mixing, op11_merkle_manifest, op12_conversation_repair, op13_quality_rules,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

SQL = {}

SQL["op1_benchmark_decontamination"] = r"""
with b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
bw as (select distinct item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win, least(len(w), 10) as k
       from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as u(i) where len(w) > 0),
d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
dw as (select doc_id, i, k.k, array_to_string(w[i:i + k.k - 1], ' ') as win
       from d, (select distinct k from bw) k, unnest(range(1, len(w) - k.k + 2)) as u(i) where len(w) >= k.k),
m as (select dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw on dw.win = bw.win and dw.k = bw.k),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, i, k from m)) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as s from (select distinct doc_id, cast(item_id as varchar) as s from m) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items.s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join items on d.doc_id = items.doc_id
"""

SQL["op6_exact_dedup"] = r"""
with k as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents),
g as (select norm, count(*) as group_size, first(doc_id order by n desc, doc_id) as keep_id from k group by norm)
select k.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, k.doc_id = g.keep_id as kept, sha256(k.norm) as text_sha256
from k join g on k.norm = g.norm
"""

SQL["op7_chat_formatting"] = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (select *, replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ': ', '\: ') as er,
                replace(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ': ', '\: ') as et from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(er) + length(et) + 4 + 2 + 9) as bigint) as formatted_chars
from e group by conv_id
"""

SQL["op3_line_dedup"] = r"""
with l as (select doc_id, unnest(range(0, len(a))) as i, unnest(a) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents)),
p as (select *, trim(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') as plain from l),
m as (select *, string_split(regexp_replace(plain, '[^ ]*(?:[0-9@]|://)[^ ]*', '<*>', 'g'), ' ') as t from p where plain != ''),
k as (select *, 2 * len(list_filter(t, lambda x: x = '<*>')) > len(t) as self from m),
n as (select doc_id, i, t, self, case when self then chr(1) || plain else array_to_string(t, ' ') end as path,
             case when self then chr(1) || plain else len(t) || ' ' || array_to_string(t[1:2], ' ') end as node from k),
c as (select * from n where node in (select node from n group by node having count(*) >= 10)),
e as (select doc_id, i, node, path, unnest(range(1, len(t) + 1)) as pos, unnest(t) as token from c where not self and len(t) > 2),
often as (select node, pos, token from e where pos > 2 and token != '<*>' group by node, pos, token having count(*) >= 10),
g as (select distinct e.node, path, e.pos, case when e.pos <= 2 or o.token is not null then e.token else '<*>' end as token
      from e left join often o on e.node = o.node and e.pos = o.pos and e.token = o.token),
tp as (select path, string_agg(token, ' ' order by pos) as template from g group by path having 2 * count(*) filter (token != '<*>') >= count(*)),
o as (select c.doc_id, c.i, coalesce(tp.template, c.path) as t from c left join tp on c.path = tp.path and not c.self),
r as (select t from (select distinct doc_id, t from o) group by t having count(*) >= 10),
d as (select o.doc_id, o.i from o join r on o.t = r.t)
select l.doc_id, count(*) as n_lines, count(d.i) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by l.i) filter (d.i is null), '')) as kept_sha256
from l left join d on l.doc_id = d.doc_id and l.i = d.i group by l.doc_id
"""

SQL["op5_jaccard_join"] = r"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
c as (select g from s group by g having count(*) > 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join c using (g) join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * k >= 75 * (x.n + y.n - k)),
e2 as (select a, b from e union all select b, a from e),
r as (select doc_id as v, doc_id as m from w union select e2.b, r.m from r join e2 on r.v = e2.a where r.m < e2.b)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, (select min(m) from r where r.v = w.doc_id) as component_id
from w left join n on w.doc_id = n.doc_id
"""

SQL["op8_substring_dedup"] = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as k from d, unnest(range(1, len(w) - 18)) as u(i) where len(w) >= 20),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as r from win) where r > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from late),
words as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as x from d)
select d.doc_id, cast(len(d.w) as bigint) as n_words, count(gone.p) as n_removed,
       sha256(coalesce(string_agg(x, ' ' order by words.p) filter (gone.p is null), '')) as kept_sha256
from d left join words on d.doc_id = words.doc_id left join gone on words.doc_id = gone.doc_id and words.p = gone.p
group by d.doc_id, len(d.w)
"""

#: Unsigned CRC-32 of a string, bit by bit; 3988292384 is its reversed polynomial.
_CRC32 = """xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda ch: ord(ch)::bigint)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda e, k: xor(e >> 1, (e & 1) * 3988292384::bigint))))"""

_PART = "coalesce(octet_length(encode({0}::varchar)) || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(map(_PART.format, ("doc_id", "source", "lang", "n_chars"))) + " || " + _PART + ")"

SQL["op11_merkle_manifest"] = f"""
with recursive h as (select doc_id, coalesce('=' || source, '') as tree, source, {_LEAF.format("text")} as leaf,
  case when doc_id is not null and {_CRC32.format("doc_id::varchar")} % 2 = 0 then {_LEAF.format("replace(text, chr(10), '')")} end as other from documents),
d as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n from h),
t as (select tree, 0 as lv, i, n, leaf as x from d
      union all select tree, lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(x, '' order by i)) from t where n > 1 group by tree, lv, i // 3, n),
s as (select tree, x as subroot, row_number() over (order by tree) - 1 as i, count(*) over () as n from t where n = 1),
u as (select 0 as lv, i, n, subroot as x from s union all select lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(x, '' order by i)) from u where n > 1 group by lv, i // 3, n),
near as (select a.tree, a.lv, a.i, coalesce(string_agg(b.x, '' order by b.i) filter (b.i < a.i), '') as l, coalesce(string_agg(b.x, '' order by b.i) filter (b.i > a.i), '') as r
         from t a join t b on a.tree = b.tree and a.lv = b.lv and a.i // 3 = b.i // 3 where a.n > 1 group by 1, 2, 3),
over as (select a.lv, a.i, coalesce(string_agg(b.x, '' order by b.i) filter (b.i < a.i), '') as l, coalesce(string_agg(b.x, '' order by b.i) filter (b.i > a.i), '') as r
         from u a join u b on a.lv = b.lv and a.i // 3 = b.i // 3 where a.n > 1 group by 1, 2),
f as (select tree, i, 0 as lv, i as at, coalesce(other, leaf) as x, '' as p from d
      union all select f.tree, f.i, f.lv + 1, f.at // 3, sha256(near.l || f.x || near.r), p || near.l || near.r from f join near on f.tree = near.tree and f.lv = near.lv and f.at = near.i),
g as (select f.tree, f.i, 0 as lv, s.i as at, f.x, f.p, s.subroot from (select tree, i, arg_max(x, lv) as x, arg_max(p, lv) as p from f group by 1, 2) f join s on f.tree = s.tree
      union all select g.tree, g.i, g.lv + 1, g.at // 3, sha256(over.l || g.x || over.r), p || over.l || over.r, subroot from g join over on g.lv = over.lv and g.at = over.i),
e as (select tree, i, arg_max(x, lv) as x, arg_max(p, lv) as p, arg_max(subroot, lv) as subroot from g group by 1, 2),
z as (select x as root from u where n = 1)
select d.doc_id, d.source, d.leaf, e.subroot, z.root, sha256(e.p) as proof_sha256, e.x as folded_root, e.x = z.root as verified,
       cast(d.i + (select coalesce(sum(d.i // power(3, m)::bigint), 0) from range(1, 20) as r(m)) as bigint) as position
from d join e on d.tree = e.tree and d.i = e.i cross join z
"""

_BEST = "list_sort([{}])[1]"
_STEP = "case when s[{q}].c is not null then {{'c': s[{q}].c + {cost}, 'a': s[{q}].a || '{edit}'}} end"
_NONE = "null::struct(c bigint, a varchar)"


def _relaxed(states: dict) -> str:
    """A list of each state's least (cost, edits); nulls sort last."""
    return "[" + ", ".join(_BEST.format(", ".join(states[q]) or _NONE) for q in range(1, 5)) + "]"


def _repair_sql() -> str:
    at = lambda q, cost, edit: _STEP.format(q=q, cost=cost, edit=edit)
    # states: 1 start, 2 after s, 3 after a pair, 4 after a user; first an insert at most, then what happens to the row
    insert = _relaxed({1: ["s[1]"], 2: ["s[2]"], 3: ["s[3]", at(4, 3, "I")], 4: ["s[4]", at(1, 3, "I"), at(2, 3, "I"), at(3, 3, "I")]})
    live = lambda x, cond="true": f"case when not r.dead and {cond} then {x} end"
    drop = {q: [at(q, 4, "D")] for q in range(1, 5)}
    drop[2] += [live(at(1, "r.cut", "K"), "r.k = 's'")]
    drop[3] += [live(at(4, "r.cut", "K"), "r.k = 'a'"), live(at(4, "3 + r.cut", "R"))]
    drop[4] += [x for q in (1, 2, 3) for x in (live(at(q, "r.cut", "K"), "r.k = 'u'"), live(at(q, "3 + r.cut", "R")))]
    crc = _CRC32.format("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")
    return f"""
with recursive d0 as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as kind from conversations),
d1 as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
              case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy from d0 where kind <> 0),
d2 as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
              row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
              regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as ends from d1),
d3 as (select *, case when ends = '' then 'blank' when again then 'duplicate' when ends not in ('.', '!', '?') then 'truncated' end as fault,
              role[1:1] as k, lag(role[1:1]) over (partition by conv_id order by i) as prior from d2),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
             count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (prior || k not in ('su', 'ua', 'au')) as illegal,
             list({{'k': k, 'dead': coalesce(fault in ('blank', 'duplicate'), false), 'cut': case when fault = 'truncated' then 3 else 0 end}} order by i) as rows from d3 group by conv_id),
w as (select conv_id, 1 as i, [{{'c': 0::bigint, 'a': ''}}, {_NONE}, {_NONE}, {_NONE}] as s from c
      union all
      select conv_id, i + 1, {_relaxed(drop)} from (select w.conv_id, w.i, {insert} as s, c.rows[w.i] as r from w join c on w.conv_id is not distinct from c.conv_id where w.i <= len(c.rows))),
b as (select c.conv_id, {_BEST.format("s[1], s[3]")} as best
      from (select w.conv_id, {insert} as s from w join c on w.conv_id is not distinct from c.conv_id where w.i = len(c.rows) + 1) as c),
e as (select conv_id, best.a as audit, unnest(range(1, len(best.a) + 1)) as p from b),
o as (select *, audit[p:p] as edit, count(*) filter (audit[p:p] <> 'I') over (partition by conv_id order by p) as i from e),
q as (select o.conv_id, o.p, o.edit, case when edit = 'I' then '' else d.text end as text, d.role, edit = 'K' and d.role[1:1] = 's' as sys
      from o left join d3 d on o.conv_id is not distinct from d.conv_id and o.i = d.i and o.edit <> 'I' where edit <> 'D'),
z as (select *, count(*) filter (not sys) over (partition by conv_id order by p) % 2 as odd from q),
t as (select conv_id, string_agg(case when edit = 'K' then role when odd = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by p) as x from z group by conv_id),
n as (select distinct conv_id from conversations)
select n.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       cast(coalesce(best.c, 0) as bigint) as cost, coalesce(best.a, '') as audit, sha256(coalesce(x, '')) as repaired_sha256
from n left join c on n.conv_id is not distinct from c.conv_id left join b on n.conv_id is not distinct from b.conv_id left join t on n.conv_id is not distinct from t.conv_id
"""


SQL["op12_conversation_repair"] = _repair_sql()
