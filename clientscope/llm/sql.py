"""DuckDB SQL for the registered queries."""

import re

from clientscope.llm.chat import Template
from clientscope.llm.licenses import TEMPLATES, VARIANTS
from clientscope.llm.line_quality import BOILERPLATE, END_MARKS, SEPARATORS
from clientscope.llm.secrets import RULES as SECRET_RULES
from clientscope.llm.urls import RULES as URL_RULES

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def text_of(patterns) -> str:
    return "|".join(re.escape(p).replace("'", "''") for p in patterns)


LINE_QUALITY = rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
win as (select doc_id, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c, i
        from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from win) where n > 1),
rep as (select doc_id, count(distinct p) as n_repeat_words
        from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
l as (select doc_id, line, pos, len(regexp_extract_all(line, '{WORD}')) as n,
             row_number() over (partition by doc_id, line order by pos) as nth
      from (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from d)),
judged as (select *, n > 0 and (
        (n < 10 and not regexp_matches(line, '({text_of(END_MARKS)}){BLANK}*$'))
        or 100 * len(regexp_extract_all(line, '[!?#*$%&<>]{{2,}}')) > 20 * n
        or len(regexp_extract_all(line, '{text_of(SEPARATORS)}')) >= 3
        or (n <= 30 and regexp_matches({fold("line")}, '{text_of(BOILERPLATE)}'))) as fails from l),
per as (select doc_id, cast(count(*) filter (n > 0 and nth > 1) as bigint) as n_dup_lines,
               cast(count(*) filter (fails) as bigint) as n_lines_removed,
               cast(coalesce(sum(length(regexp_replace(line, '{BLANK}', '', 'g'))) filter (fails), 0) as bigint) as lost_chars
        from judged group by doc_id),
base as (select doc_id, cast(len(ws) as bigint) as n_words,
                cast(length(regexp_replace(t, '{BLANK}', '', 'g')) as bigint) as word_chars,
                cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
                cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, n_dup_lines, n_lines_removed, lost_chars
         from d join per using (doc_id) left join rep using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_chars <= 30 * word_chars as kept
from base"""

LINE_DEDUP = rf"""
with l as (select doc_id, line, pos, {fold(f"regexp_replace(regexp_replace(line, '^{BLANK}+', ''), '{BLANK}+$', '')")} as k
           from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
r as (select k, max(doc_id) as last_doc from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
j as (select l.*, last_doc is not null and l.doc_id <> last_doc as gone from l left join r using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by doc_id"""

MIX = rf"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight,
             2.0::double * source_size as cap from s),
lv as (select *, (1.5::double * sum(source_size) over ()
                  - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
                 / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
       from w),
t as (select source, source_size, least(cap, weight * max(level) over ()) as target from lv),
r as (select *, case when source_size > 0 then least(target / source_size, 2.0) else 0.0 end as rate from t)
select doc_id, size, source_size, target,
       cast(size * (floor(rate) + case when cast('0x' || substr(md5('mix:' || doc_id), 1, 13) as bigint) / 4503599627370496.0::double
                                            < rate - floor(rate) then 1 else 0 end) as bigint) as taken
from d join r on d.source is not distinct from r.source"""

ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATE = rf"""
with d as (select doc_id, regexp_extract_all({fold("coalesce(text, '')")}, '{ITEM_WORD}') as ws from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all({fold("coalesce(text, '')")}, '{ITEM_WORD}') as ws from benchmark),
bw as (select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') as gram
       from (select item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as i from b where len(ws) > 0)),
dw as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as gram
       from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from bw))),
h as (select doc_id, item_id, i, n from dw join bw using (n, gram)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
       from (select distinct doc_id, item_id from h) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)"""

NEAR_DUPLICATES = rf"""
with recursive d as (select doc_id, regexp_extract_all({fold("coalesce(text, '')")}, '{WORD}') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 3], ' ') as g
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as inter from s x join s y on x.g = y.g and x.doc_id <> y.doc_id
                            group by 1, 2) p join n na on na.doc_id = a join n nb on nb.doc_id = b
          where 100 * inter >= 80 * (na.n + nb.n - inter)),
reach as (select doc_id as a, doc_id as b from d union select r.a, l.b from reach r join links l on l.a = r.b),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)"""


def escaped(text: str) -> str:
    for sign, rest in Template().tails().items():
        text = f"regexp_replace({text}, '({re.escape(sign)})(\\\\*)({rest})', '\\1\\\\\\2\\3', 'g')"
    return text


def chat() -> str:
    t = Template()
    around = " ".join(f"when '{role}' then {len(x.prefix) + len(x.suffix)}" for role, x in t.turns.items())
    other = sum(map(len, t.role_marks))
    allowed = ", ".join(f"'{state}>{r}'" for state, roles in t.moves.items() for r in roles)
    return rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m as (select *, lag(role, 1, '') over w || '>' || role in ({allowed}) as ok, row_number() over w = count(*) over (partition by conv_id) as last
      from c window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast({len(t.begin)} + sum(length({escaped("text")}) + case role {around} else {other} + length({escaped("role")}) end) as bigint) as formatted_chars,
       bool_and(ok) and bool_or(last and role = 'assistant') as valid
from m group by conv_id"""


CHAT = chat()


def secrets() -> str:
    parts = []
    for i, r in enumerate(SECRET_RULES):
        p = r.pattern.replace("'", "''")
        for word in ("password", "passwd", "secret", "token", "api_?key"):  # letters in either case, but no others
            p = p.replace(word, "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word))
        p = p.replace("(?i:", "(?:")
        parts.append(f"""select doc_id, {i} as ord, '{r.kind}' as kind, {str(r.base).lower()} as base,
    unnest(regexp_extract_all(t, '{p}')) as m, unnest(regexp_extract_all(t, '{p}', {r.group})) as g, {r.least} as least,
    unnest(list_resize(regexp_split_to_array(t, '{p}'), len(regexp_extract_all(t, '{p}')))) as gap,
    generate_subscripts(regexp_extract_all(t, '{p}'), 1) as n from d""")
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(parts)}),
p as (select *, sum(length(gap)) over w + sum(length(m)) over w as stop from m window w as (partition by doc_id, ord order by n)),
s as (select doc_id, ord, kind, base, stop - length(m) as start, kind || ':' || (stop - length(m)) || ':' || stop as span
      from p where length(g) >= least),
a as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
             count(*) filter (kind = 'hex') as n_hex, string_agg(span, ',' order by start, ord) filter (base) as base_spans,
             string_agg(span, ',' order by start, ord) as spans from s group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)"""


SECRETS = secrets()


def urls() -> str:
    cases = "case " + " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{v} {h}{p}'"
        for v, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    ) + " end"
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
    return rf"""
with p as (select page_id, {fold(f"coalesce(regexp_extract(url, '{parts}', 1), '')")} as host,
                  coalesce(regexp_extract(url, '{parts}', 2), '') as path, coalesce(regexp_extract(url, '{parts}', 3), '') as q from pages),
k as (select *, list_sort(list_filter(string_split(substr(q, 2), '&'),
                                      lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) as kept,
             {cases} as fit from p),
c as (select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
               || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as canonical from k)
select page_id, host, path, case when fit is not null then split_part(fit, ' ', 2) end as rule, canonical,
       case when fit is not null then split_part(fit, ' ', 1)
            when host <> '' and canonical in (select canonical from c where page_id % 50 = 0) then 'block' else 'allow' end as verdict
from c"""


URLS = urls()


def licenses() -> str:
    quote = lambda x: x.replace("'", "''")
    rows = ", ".join(f"('{quote(k)}', {i}, '{quote(t)}')" for k, v in sorted(TEMPLATES.items()) for i, t in enumerate(v))
    variants = ", ".join(f"'{v}'" for v in VARIANTS)
    words = rf"""list_filter(list_transform(list_transform(regexp_extract_all({fold("p")}, '[^\x00-\x2D\x2F\x3A-\x60\x7B-\x7F]+'),
                 lambda w: regexp_replace(regexp_replace(w, '^\.+', ''), '\.+$', '')),
                 lambda w: case when regexp_full_match(w, 'v?[0-9]+(\.[0-9]+)?') then regexp_replace(regexp_replace(w, '^v', ''), '\.0$', '') else w end), lambda w: w <> '')"""
    return rf"""
with tt as (select license, template, {words} as ws from (values {rows}) as v(license, template, p)),
tg as (select license, template, unnest(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as gram from tt),
t as (select license, template, len(ws) as width, list_sort(list_distinct(list_filter(ws, lambda w: w in ({variants})))) as variants from tt),
tn as (select license, template, count(*) as m from tg group by all),
d as (select doc_id, {words} as ws from (select doc_id, coalesce(text, '') as p from documents)),
g as (select doc_id, len(ws) as n, unnest(range(1, len(ws))) as pos, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as gram
      from d where len(ws) > 1),
hits as (select g.doc_id, g.n, g.pos, g.gram, license, template from g join tg using (gram)),
few as (select doc_id, license, template, m from hits join tn using (license, template) group by all having count(*) >= 0.8 * m / 1.2 - 1e-9),
starts as (select distinct h.doc_id, license, template, f.m, t.width, t.variants, least(h.pos, greatest(1, h.n - t.width + 1)) as first
           from hits h join few f using (doc_id, license, template) join t using (license, template)),
wins as (select s.*, list_slice(d.ws, first, first + width - 1) as win from starts s join d using (doc_id)),
own as (select *, list_distinct(list_transform(range(1, len(win)), lambda i: win[i] || ' ' || win[i + 1])) as grams from wins
        where list_sort(list_distinct(list_filter(win, lambda w: w in ({variants})))) = variants),
tl as (select license, template, list(gram) as grams from tg group by all),
x as (select doc_id, license, template, 2.0::double * len(list_intersect(own.grams, tl.grams)) / (len(own.grams) + m) as dice from own join tl using (license, template)),
b as (select doc_id, license, template, max(dice) as dice from x where dice >= 0.8 group by all)
select doc_id, count(license) as n_matches, coalesce(string_agg(distinct license, ',' order by license), '') as licenses,
       coalesce(max(dice), 0.0::double) as best_dice from d left join b using (doc_id) group by doc_id"""


LICENSES = licenses()


def crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit: 3988292384 is its reversed polynomial."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ord(s)::ubigint)"
    return f"xor(list_reduce(list_concat([4294967295::ubigint], {codes}), lambda c, b: {byte}), 4294967295::ubigint)"


def repair_state(state: int) -> str:
    """Least cost and script of a state after one row, as text that sorts like them; insertions follow in repair_closed."""
    legal = {0: {}, 1: {"s": 0}, 2: {"u": (0, 1, 3)}, 3: {"a": (2,)}}[state]
    ways = [f"edit(p{state}, 4, 'D')"]
    for initial, sources in legal.items():
        for p in sources if isinstance(sources, tuple) else (sources,):
            ways.append(f"case when fault <> 'gone' and initial = '{initial}' then edit(p{p}, extra, 'K') end")
            if initial != "s":
                ways.append(f"case when fault <> 'gone' and initial <> '{initial}' then edit(p{p}, extra + 3, 'R') end")
    return f"least({', '.join(ways)})"


def edit_macro(text: str) -> str:
    """edit(way, cost, letter) spelled out: a way is eight digits of cost and its letters."""
    return re.sub(r"edit\((\w+), ([^,]+), '(\w)'\)", r"(lpad((left(\1, 8)::int + \2)::varchar, 8, '0') || substr(\1, 9) || '\3')", text)


def repair_closed(start: str, columns: list[str]) -> str:
    """A row's states with insertions: each may come from an earlier one, three times over, so that every chain is there."""
    out = f"select {', '.join(columns)}, {', '.join(f'p{i}' for i in range(4))} from ({start})"
    for _ in range(3):
        new = edit_macro("p0, p1, least(p2, edit(p0, 3, 'I'), edit(p1, 3, 'I'), edit(p3, 3, 'I')) as p2, least(p3, edit(p2, 3, 'I')) as p3")
        out = f"select {', '.join(columns)}, {new} from ({out})"
    return out


REPAIR = rf"""
with recursive r0 as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as d
  from conversations),
r1 as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role,
         case when d = 1 then '' when d = 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case when d = 0 then 0 when d = 3 then 2 else 1 end)) as copy
  from r0),
r2 as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as pos from r1),
r3 as (
  select conv_id, turn, role, text, pos, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by pos) as earlier,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
              when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
              when not regexp_matches(text, '[.!?]{BLANK}*\z') then 'truncated' else 'kept' end as first_fault
  from r2),
r4 as (select *, case when first_fault in ('blank', 'duplicate') then 'gone' else 'row' end as fault,
              case when first_fault = 'truncated' then 3 else 0 end as extra from r3),
convs as (select distinct conv_id from conversations),
ways as (
  {repair_closed("select conv_id, 0::bigint as pos, '00000000' as p0, null::varchar as p1, null::varchar as p2, null::varchar as p3 from convs", ["conv_id", "pos"])}
  union all
  select * from ({repair_closed("select r4.conv_id, r4.pos, " + ", ".join(f"{edit_macro(repair_state(i))} as p{i}" for i in range(4))
                 + " from ways join r4 on ways.conv_id is not distinct from r4.conv_id and r4.pos = ways.pos + 1", ["conv_id", "pos"])})),
best as (
  select conv_id, least(arg_max(p0, pos), arg_max(coalesce(p3, '99999999'), pos)) as way from ways group by conv_id),
letters as (
  select conv_id, letter, nth, sum((letter <> 'I')::int) over w as row_pos, sum((letter <> 'D')::int) over w as place,
         sum((letter <> 'D')::int) over (partition by conv_id) % 2 as lead
  from (select conv_id, unnest(string_split(substr(way, 9), '')) as letter, generate_subscripts(string_split(substr(way, 9), ''), 1) as nth
        from best where length(way) > 8)
  window w as (partition by conv_id order by nth)),
lines as (
  select l.conv_id, string_agg(case when letter = 'K' then r.role when (place - lead) % 2 = 1 then 'user' else 'assistant' end
                               || ':' || case when letter = 'I' then '' else r.text end, chr(10) order by nth) as text
  from letters l left join r4 r on l.conv_id is not distinct from r.conv_id and l.row_pos = r.pos
  where letter <> 'D' group by l.conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (first_fault = 'blank') as blank,
         count(*) filter (first_fault = 'duplicate') as duplicate, count(*) filter (first_fault = 'truncated') as truncated,
         count(*) filter (earlier is not null and (earlier || initial) not in ('su', 'ua', 'au')) as illegal
  from r4 group by conv_id)
select c.conv_id, coalesce(n.gaps, 0)::bigint as gaps, coalesce(n.blank, 0) as blank, coalesce(n.duplicate, 0) as duplicate,
       coalesce(n.truncated, 0) as truncated, coalesce(n.illegal, 0) as illegal, left(b.way, 8)::bigint as cost, substr(b.way, 9) as audit,
       sha256(coalesce(l.text, '')) as repaired_sha256
from convs c join best b on c.conv_id is not distinct from b.conv_id left join counts n on c.conv_id is not distinct from n.conv_id
left join lines l on c.conv_id is not distinct from l.conv_id"""


def gram_level(level: int) -> str:
    """Seeds of the lags from 2^level on, up to the next power: neighbouring places of one gram of 5, 6, 12, 24, ... words."""
    low = 1 << level
    parts = {0: ("h4", "h1", 4), 1: ("h4", "h2", 4)}.get(level, (f"h{2 * low}", f"h{low}", 2 * low))
    return f"""
g{level} as (select doc_id, pos, hash({parts[0]}, lead({parts[1]}, {parts[2]}) over w) as gram
  from hashes where {parts[0]} is not null window w as (partition by doc_id order by pos)),
s{level} as (select doc_id, q from (
    select doc_id, lead(pos) over (partition by doc_id, gram order by pos) - pos as q from g{level} where gram is not null)
  where q >= {low} and q < {2 * low} group by all)"""


def period_levels(top: int) -> str:
    """hashes: h1, h2, h4, ... of the words from each place on, null where the text ends before."""
    out = "select doc_id, pos, hash(word) as h1 from words"
    for k in range(top):
        half = 1 << k
        out = f"select *, case when lead(pos, {half}) over w is not null then hash(h{half}, lead(h{half}, {half}) over w) end as h{2 * half} from ({out}) window w as (partition by doc_id order by pos)"
    return out


#: Periods up to 2^13 - 1 words, which holds for texts of up to 32,767 words; the longest text of the test tables has 20,000.
PERIOD_LEVELS = 13

PERIODIC = f"""
with d0 as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws, {crc32("doc_id::varchar")}::bigint as h from documents),
d1 as (select *, len(ws) as n, h // 10 as g from d0),
d2 as (select *, case when n > 0 then g % n end as a from d1),
d3 as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i:
         ws[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else ws end as ws from d2),
words as (select doc_id, unnest(ws) as word, unnest(range(n)) as pos from d3),
hashes as ({period_levels(PERIOD_LEVELS)}),
{", ".join(gram_level(k) for k in range(PERIOD_LEVELS))},
lags as ({" union all ".join(f"select * from s{k}" for k in range(PERIOD_LEVELS))}),
same as (
  select a.doc_id, l.q, a.pos, a.pos - row_number() over (partition by a.doc_id, l.q order by a.pos) as island
  from lags l join words a on a.doc_id = l.doc_id join words b on b.doc_id = a.doc_id and b.pos = a.pos + l.q and b.word = a.word),
stretches as (select doc_id, q as period, min(pos) as start, count(*) + q as length from same group by doc_id, q, island),
long as (select * from stretches where length >= 6 and length >= 4 * period),
runs as (
  select * from long r where not exists (select 1 from long s where s.doc_id = r.doc_id and s.period < r.period and r.period % s.period = 0
    and s.start <= r.start and s.start + s.length >= r.start + r.length)),
per_doc as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by doc_id),
best as (
  select doc_id, start, length, period from runs
  qualify row_number() over (partition by doc_id order by length::double / period desc, start, period) = 1),
dropped as (select distinct doc_id, unnest(range(start + period, start + length)) as pos from runs),
kept as (
  select w.doc_id, string_agg(w.word, ' ' order by w.pos) as text from words w anti join dropped x on w.doc_id = x.doc_id and w.pos = x.pos group by w.doc_id)
select d.doc_id, coalesce(p.n_runs, 0) as n_runs, b.start, b.length::bigint as length, b.period,
       (b.length::bigint * 1000) // b.period as exponent_milli, sha256(coalesce(p.lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from documents d left join per_doc p using (doc_id) left join best b using (doc_id) left join kept k using (doc_id)"""
