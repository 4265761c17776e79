"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LEDGER = rf"""
with t as (select row_number() over () rn, doc_id, coalesce(text, '') txt, {WORDS} ws from documents),
win as (select rn, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g
        from (select rn, ws, unnest(range(1, len(ws) - 1)) i from t)),
twice as (select rn, i from (select rn, i, count(*) over (partition by rn, g) n from win) where n > 1),
reps as (select rn, count(distinct p) n_repeat_words from (select rn, unnest([i, i + 1, i + 2]) p from twice) group by rn),
ln as (select rn, x from (select rn, unnest(string_split(txt, chr(10))) x from t) where regexp_matches(x, '[^\x20\x09-\x0D]')),
lns as (select rn, count(*) n_lines, count(*) - count(distinct x) n_dup_lines from ln group by rn),
m as (select doc_id, len(ws) n_words, length(regexp_replace(txt, '[\x20\x09-\x0D]', '', 'g')) word_chars,
        length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')) n_symbols,
        coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words,
        length(txt) - length(regexp_replace(txt, '\p{{Lu}}', '', 'g')) n_upper, coalesce(n_lines, 0) n_lines
      from t left join reps using (rn) left join lns using (rn)),
ledger as (select *, (case when n_words < 50 then 1 else 0 end)
        + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
        + (case when 10 * n_symbols > n_words then 4 else 0 end)
        + (case when 100 * n_upper > 30 * word_chars then 8 else 0 end)
        + (case when 100 * n_dup_lines > 30 * n_lines then 16 else 0 end)
        + (case when word_chars < 2 * n_words or word_chars > 25 * n_words then 32 else 0 end) fail_bits from m)
"""

OP3 = LEDGER + """
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
  cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, fail_bits & 3 <> 0 base_failed,
  fail_bits = 0 kept, cast(n_upper as bigint) n_upper, cast(n_lines as bigint) n_lines, cast(fail_bits as bigint) fail_bits
from ledger
"""

OP3B = LEDGER + """,
rule as (select * from (values ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('capitals', 8), ('repeated_lines', 16),
  ('word_length', 32)) v(rule, bit)),
asked as (select 'base-1' as policy, rule, bit, 3 as mask from rule where bit <= 2 union all select 'standard-1', rule, bit, 63 from rule)
select policy, rule, cast(sum(case when fail_bits & bit <> 0 then 1 else 0 end) as bigint) n_fail,
  cast(sum(case when fail_bits & mask = bit then 1 else 0 end) as bigint) n_fail_alone,
  cast(sum(case when fail_bits & mask = 0 then 1 else 0 end) as bigint) n_kept,
  cast(sum(case when fail_bits & mask in (0, bit) then 1 else 0 end) as bigint) n_kept_without
from ledger, asked group by policy, rule
"""

OP5 = r"""
with i as (select item_id, ws, least(5, len(ws)) k from (
  select item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') ws from benchmark) where len(ws) > 0),
g as (select item_id, k, len(ss) n, unnest(ss) s from (
  select item_id, k, list_distinct([array_to_string(ws[j:j + k - 1], ' ') for j in range(1, len(ws) - k + 2)]) ss from i)),
d as (select doc_id, k, unnest(list_distinct([array_to_string(ws[j:j + k - 1], ' ') for j in range(1, len(ws) - k + 2)])) s from (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') ws from documents), (select distinct k from i))
select doc_id, item_id, cast(n as bigint) n_item_shingles, count(*) n_shared, count(*) / n::double containment
from d join g using (k, s) group by doc_id, item_id, n having count(*) >= 0.75 * n
"""

ORACLE = {"op3_quality_ledger": OP3, "op3b_quality_ablations": OP3B, "op5_decontaminate": OP5}


def _license_sql() -> str:
    """Templates by the names that the operator reports; the rest is SQL of its own."""
    from pixelloom.llm.licenses import TEMPLATES

    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    cut = "regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+', '', 'g'), '[^\\x20\\x09-\\x0D]+')"
    grams = "list_distinct([array_to_string(ws[i:i + k - 1], ' ') for i in range(1, len(ws) - k + 2)])"
    return f"""
with t as (select license, ws, least(5, len(ws)) k from (select license, {cut} ws from (values {rows}) v(license, text))),
i as (select license, k, len(ss) n, unnest(ss) s from (select license, k, {grams} ss from t)),
d as (select doc_id, k, unnest({grams}) s from (select doc_id, {cut} ws from documents), (select distinct k from t))
select doc_id, license, cast(n as bigint) n_shingles, count(*) n_shared, count(*) / n::double containment
from d join i using (k, s) group by doc_id, license, n having count(*) >= 0.75 * n
"""


ORACLE["op4_license_scan"] = _license_sql()

ORACLE["op7_extendible_shards"] = """
with d as (select doc_id, cast(octet_length(encode(coalesce(text, ''))) as bigint) doc_bytes,
             ('0x' || substr(md5('shard' || chr(10) || coalesce(cast(doc_id as varchar), '\\N')), 1, 15))::bigint h from documents),
e as (select doc_id, doc_bytes, h, unnest(range(0, 61)) depth from d),
b as (select depth, h >> (60 - depth) p, cast(sum(doc_bytes) as bigint) shard_bytes, count(*) shard_docs from e group by all),
f as (select e.doc_id, e.doc_bytes, e.depth, b.p, b.shard_bytes, b.shard_docs,
        row_number() over (partition by e.doc_id order by e.depth) r
      from e join b on b.depth = e.depth and b.p = e.h >> (60 - e.depth) where b.shard_bytes <= 1048576 or e.depth = 60)
select doc_id, doc_bytes, depth, lpad(bin(p), cast(depth as integer), '0') shard, shard_bytes, shard_docs, shard_bytes > 1048576 oversized from f where r = 1
"""

ORACLE["op2_source_mix"] = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
             ('0x' || substr(md5('mix' || chr(10) || coalesce(cast(doc_id as varchar), '\N')), 1, 15))::bigint h from documents),
s as (select source, sum(size)::bigint source_size, [3, 1, 2][cast((row_number() over (order by source nulls last) - 1) % 3 as integer) + 1] w from d group by source),
o as (select *, sum(2 * source_size) over (order by 2 * source_size / w::double, source nulls last rows unbounded preceding) - 2 * source_size before,
        sum(w) over (order by 2 * source_size / w::double desc, source desc nulls first rows unbounded preceding) w_from from s),
l as (select max(level) level from (select (1.5 * (select sum(source_size) from s)::double - before) / w_from as level, 2 * source_size / w::double as ratio from o)
      where level <= ratio),
t as (select source, source_size, least(2.0 * source_size, level * w)::double target from s, l),
g as (select d.doc_id, d.size, t.source_size, t.target, coalesce(cast(floor(target / nullif(source_size, 0)) as bigint), 0) whole,
        sum(d.size) over (partition by d.source order by h rows unbounded preceding) upto from d join t on d.source is not distinct from t.source),
x as (select *, target - whole * source_size budget from g)
select doc_id, size, source_size, target, size * copies taken, copies from (
  select *, whole + case when whole < 2 and (upto <= budget or (upto - size <= budget and upto - budget < budget - (upto - size))) then 1 else 0 end copies from x)
"""

#: CRC-32 of a string expression, with the table ``crc(t)`` at hand.
_CRC_TABLE = """crc as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) t
  from range(256) r(i))"""


def _crc(text: str) -> str:
    byte = f"[('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2])::bigint for i in range(octet_length(encode({text})))]"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op11_importance_resample"] = rf"""
with {_CRC_TABLE},
d as (select row_number() over () rn, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
dw as (select rn, w, count(*) n from (select rn, unnest(ws) w from d) group by all),
bw as (select w, count(*) n from (select unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w from benchmark) group by all),
bk as (select w, {_crc('w')} % 10000 b from (select w from dw union select w from bw), crc),
ss as (select b, sum(n) s from dw join bk using (w) group by b),
tt as (select b, sum(n) t from bw join bk using (w) group by b),
al as (select (select coalesce(sum(s), 0) from ss) sall, (select coalesce(sum(t), 0) from tt) tall),
g as (select b, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * (sall + 10000)::double / ((coalesce(s, 0) + 1)::double * (tall + 10000)::double))) as bigint) gain
  from ss full join tt using (b), al),
w as (select rn, floor(sum(gain * n)::double / sum(n)::double) weight from dw join bk using (w) join g using (b) group by rn),
h as (select rn, doc_id, len(ws) n_features, coalesce(weight, 0) weight,
  ('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint h from d left join w using (rn)),
sc as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) score from h),
r as (select rn, row_number() over (order by score desc, doc_id nulls last) k, count(*) over () m from sc where n_features >= 20)
select doc_id, cast(n_features as bigint) n_features, cast(weight as bigint) weight, cast(score as bigint) score,
  cast(case when k <= 10 * m // 100 then k end as bigint) as rank from sc left join r using (rn)
"""

ORACLE["op13_spelling_variants"] = rf"""
with recursive {_CRC_TABLE},
ru as (select doc_id, w, count(*) n from (select doc_id, unnest(regexp_extract_all({_LOW}, '[a-z\x{{C0}}-\x{{FF}}]+')) w from documents) group by all),
hs as (select *, {_crc("coalesce(cast(doc_id as varchar), '') || ':' || w")} h from ru, crc),
ed as (select case when h % 199 = 0 then substr(w, 1, cast(h % length(w) as integer)) || substr(w, cast(h % length(w) as integer) + 2) else w end word, n from hs),
v as (select word, cast(sum(n) as bigint) n from ed where length(word) >= 6 group by word having sum(n) >= 5),
le as (select word, n, unnest(range(1, length(word) + 1)) i from v),
ma as (select word, n, substr(word, 1, i - 1) || chr(0) || substr(word, i + 1) m from le),
de as (select word, n, substr(word, 1, i - 1) || substr(word, i + 1) m from le),
pr as (select a.word, b.word near, b.n near_n from ma a join ma b on a.m = b.m and a.word <> b.word
  union select de.word, v.word, v.n from de join v on v.word = de.m
  union select v.word, de.word, de.n from de join v on v.word = de.m),
be as (select word, count(*) n_near, max(near_n) top from pr group by word),
fo as (select pr.word, min(near) form, any_value(top) form_n from pr join be on be.word = pr.word and near_n = top join v on v.word = pr.word where top >= 5 * v.n group by pr.word),
ch as (select word, form, form as root from fo union all select ch.word, ch.form, fo.form from ch join fo on fo.word = ch.root),
ro as (select word, root from ch where root not in (select word from fo))
select v.word, fo.form, coalesce(ro.root, v.word) root, v.n, cast(coalesce(n_near, 0) as bigint) n_near, cast(form_n as bigint) form_n
from v left join be using (word) left join fo using (word) left join ro using (word)
"""

ORACLE["op8_chat_examples"] = r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
f as (select *, 12 + length(replace(replace(regexp_replace(r, '<(\\*)\|', '<\1\\|', 'g'), '\', '\\'), chr(10), '\n')) + 1
    + length(regexp_replace(t, '<(\\*)\|', '<\1\\|', 'g')) + 11 n from c),
o as (select *, row_number() over w k, sum(n) over (w rows unbounded preceding) upto from f window w as (partition by conv_id order by turn nulls first, r, t))
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by k)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (r = 'assistant'), 0) as bigint) loss_chars, sha256(coalesce(string_agg(t, '' order by k) filter (r = 'assistant'), '')) loss_sha256,
  cast(sum(n) as bigint) formatted_chars, count(*) filter (r = 'assistant') n_examples,
  cast(coalesce(sum(upto) filter (r = 'assistant'), 0) as bigint) example_chars
from o group by conv_id
"""

ORACLE["op1_warc_bundles"] = """
with p as (select page_id, coalesce(html, '') x from pages),
q as (select *, octet_length(encode(x)) b, max(page_id) over (partition by x) last from p)
select page_id, cast(b as bigint) payload_bytes, sha1(x) payload_digest, case when b >= 1000 and page_id <> last then 'revisit' else 'response' end record_type,
  case when b >= 1000 and page_id <> last then last end refers_to from q
"""

ORACLE["op10_near_duplicates"] = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') ws from documents),
g as (select doc_id, case when len(ws) >= 5 then list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)])
  when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end ss from d),
s as (select doc_id, len(ss) n, unnest(ss) x from g),
pr as (select a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) n from s a join s b using (x) where a.doc_id < b.doc_id group by all),
ln as (select a, b from pr where 100 * n >= 75 * (na + nb - n)),
li as (select a, b from ln union all select b, a from ln),
re as (select a, b from li union select re.a, li.b from re join li on li.a = re.b),
co as (select a doc_id, least(a, min(b)) c from re group by a)
select doc_id, cast(len(ss) as bigint) n_shingles, coalesce(c, doc_id) component_id, coalesce(c, doc_id) = doc_id kept from g left join co using (doc_id)
"""
