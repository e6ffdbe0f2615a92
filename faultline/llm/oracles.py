"""DuckDB SQL for the text queries that SQL can express; the others are tested against plain versions."""

from __future__ import annotations

from faultline.llm.licenses import COVERAGE, DRIFT, GAP, GRAM, TEMPLATES
from faultline.llm.quality_rules import DELTA, GRIDS, MAX_REPEAT_PERCENT, MIN_WORDS, RISK
from faultline.llm.spelling import FORM_FACTOR, LEAST_COUNT, LEAST_LENGTH, ONE_IN

_WORDS = r"'[^\x20\x09-\x0D]+'"

NEAR_DUPLICATES = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
e as (select doc_id, unnest(s) as g from s),
n as (select doc_id, len(s) as n from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways as (select x, y from link union all select y, x from link),
reach as (select doc_id as a, doc_id as b from n union select reach.a, both_ways.y from reach join both_ways on reach.b = both_ways.x)
select doc_id, cast(n as bigint) as n_shingles, min(b) as component_id, doc_id = min(b) as kept from n join reach on a = doc_id group by doc_id, n
"""

_GRID_ROWS = ", ".join(f"('{rule}', {len(grid) - i}, {cut}::double)" for rule, grid in GRIDS.items() for i, cut in enumerate(grid))
_RULES = len(GRIDS)
_VALUES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
    "short_words": "-(word_chars / greatest(n_words, 1))",
}
_LONG = " union all ".join(f"select doc_id, lang, base_failed, '{rule}' as rule, cast({value} as double) as value from c" for rule, value in _VALUES.items())

QUALITY_RULES = rf"""
with t as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t)),
often as (select doc_id, g from windows group by all having count(*) > 1),
covered as (select doc_id, count(distinct i + j) as n from windows semi join often using (doc_id, g), (values (0), (1), (2)) as x(j) group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORDS})) as l from t),
c0 as (
  select t.doc_id, lang, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(n, 0) as n_repeat_words, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) as n_capitals, len(l) as n_lines
  from t join lines using (doc_id) left join covered using (doc_id)),
c as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from c0),
long as ({_LONG}),
grid(rule, step, cut) as (values {_GRID_ROWS}),
good as (select doc_id, min(quality) as quality from labels where doc_id is not null and quality is not null group by doc_id),
learn as (select lang, rule, any_value(value) as value, min(quality) = 1 as good from long join good using (doc_id) join (select doc_id, md5(text) as text from t) using (doc_id) where not base_failed group by lang, rule, text),
size as (select lang, cast(count(*) filter (good) / {_RULES} as bigint) as n from learn group by lang),
steps as (select lang, rule, step, cut, count(*) filter (good and value > cut) as k, count(*) filter (not good and value > cut) as b from learn join grid using (rule) group by all),
tested as (
  select s.*, case when k >= {RISK / _RULES} * n then false else
    list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - case when n = j then 0 else lgamma(n - j + 1) end + j * ln({RISK / _RULES}) + (n - j) * ln(1 - {RISK / _RULES})))) <= {DELTA} / ({_RULES} * (select count(*) from size)) end as ok
  from steps s join size using (lang)),
certified as (select *, bool_and(ok) over (partition by lang, rule order by step desc) as all_ok from tested),
chosen as (select lang, rule, arg_max(cut, (b - k, step)) as cut from certified where all_ok and b > k group by lang, rule),
failed as (select doc_id, string_agg(rule, ',' order by rule) as rules from long join chosen using (lang, rule) where value > cut group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rules is null as kept, coalesce(rules, '') as failed_rules from c left join failed using (doc_id)
"""

# The licence texts are data; their words and k-grams are worked out by the SQL.
_LICENCES = ", ".join(f"({t}, '{x.label}', '{x.family}', {x.base}, '{x.text}', '{x.deciding}')" for t, x in enumerate(TEMPLATES))
_LICENCE_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

LICENSE_SCAN = rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_LICENCE_WORDS}) as w from documents),
l(template, label, family, base, text, deciding) as (values {_LICENCES}),
t as (select *, regexp_extract_all(text, {_LICENCE_WORDS}) as words, regexp_extract_all(deciding, {_LICENCE_WORDS}) as d, case when base then len(words) else least(len(words), {GRAM}) end as k from l),
t2 as (select *, list_filter(range(0, len(words) - len(d) + 1), lambda i: len(d) > 0 and words[i + 1:i + len(d)] = d)[1] as first_at from t),
g as (select template, label, family, base, k, len(words) as n, unnest(range(0, len(words) - k + 1)) as tpos, words, case when first_at is null then [] else range(first_at, first_at + len(d) - k + 1) end as must from t2),
places as (select doc_id, k, w, unnest(range(0, len(w) - k + 1)) as pos from w, (select distinct k from t)),
grams as (select doc_id, k, pos, array_to_string(w[pos + 1:pos + k], ' ') as gram from places),
hits as (select doc_id, template, label, family, base, n, must, p.pos, tpos, p.k from grams p join g on g.k = p.k and p.gram = array_to_string(words[tpos + 1:tpos + g.k], ' ')),
d as (select doc_id, template, label, family, base, n, must, k, pos - tpos as diagonal, list(distinct tpos) as tp, min(pos) as low, max(pos + k - 1) as high from hits group by all),
e as (select *, lag(diagonal) over (partition by doc_id, template order by diagonal) as d0 from d),
f as (select *, sum(case when base or d0 is null or diagonal - d0 > {DRIFT} then 1 else 0 end) over (partition by doc_id, template order by diagonal) as strand from e),
h as (select *, max(high) over (partition by doc_id, template, strand order by low, diagonal rows between unbounded preceding and 1 preceding) as h0 from f),
s as (select *, sum(case when h0 is null or low - h0 > {GAP} then 1 else 0 end) over (partition by doc_id, template, strand order by low, diagonal) as span from h),
m as (select doc_id, template, label, family, base, n, must, k, strand, span, list_distinct(flatten(list(tp))) as tp, min(low) as first, max(high) as last from s group by all),
c as (select *, len(list_distinct(flatten(list_transform(tp, lambda x: range(x, x + k))))) as covered from m),
v as (select *, cast(covered as double) / n as score from c where cast(covered as double) / n >= {COVERAGE}::double and list_has_all(tp, must)),
i0 as (select *, max(last) over (partition by doc_id, family order by first, last, template rows between unbounded preceding and 1 preceding) as before from v where not base),
i1 as (select *, sum(case when before is null or first > before then 1 else 0 end) over (partition by doc_id, family order by first, last, template rows unbounded preceding) as island from i0),
x as (select doc_id, label, base, first, score from v where base union all
  select doc_id, label, base, first, score from (select *, row_number() over (partition by doc_id, family, island order by covered desc, score desc, first, template) as best from i1) where best = 1)
select w.doc_id, cast(len(w.w) as bigint) as n_words, count(*) filter (base) as n_base, min(first) filter (base) as first_word, max(first) filter (base) as last_word,
  coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label), '') as labels, coalesce(max(score), 0.0::double) as score
from w left join x on x.doc_id = w.doc_id group by w.doc_id, w.w
"""

# Words of text whose A-Z are in lower case.
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_LICENCE_WORDS})"

RANKED_SEARCH = rf"""
with d as (select row_number() over () as r, doc_id, w, len(w) as n from (select doc_id, {_TERMS} as w from documents) where len(w) > 0),
s as (select count(*) as c, cast(sum(n) as bigint) as l from d),
p as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, n, unnest(w) as term from d) group by all),
f as (select term, count(*) as df from p group by term),
q as (select item, item_id, term, count(*) as repeats from (select item, item_id, unnest(w) as term from (select row_number() over () as item, item_id, {_TERMS} as w from benchmark)) group by all),
x as (select item, item_id, r, doc_id, cast(sum(repeats * cast(floor(1000 * ln((2 * c + 2)::double / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * c) // l)))) as bigint) as score
  from q join f using (term) join p using (term), s group by all),
y as (select item_id, row_number() over (partition by item order by score desc, doc_id) as rank, doc_id, score from x where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from y where rank <= 10
"""

_RUNS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z' || chr(192) || '-' || chr(255) || ']+')"

SPELLING_VARIANTS = rf"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
r as (select coalesce(cast(doc_id as varchar), '') || ':' || run as name, run, count(*) as n from (select doc_id, unnest({_RUNS}) as run from documents) group by all),
b as (select name, run, n, hex(encode(name)) as x from r where length(run) >= {LEAST_LENGTH}),
h as (select run, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: cast('0x' || x[2 * i + 1:2 * i + 2] as bigint)), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8), 4294967295)) as h from b, crc),
o as (select case when h % {ONE_IN} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h),
w as (select word, cast(sum(n) as bigint) as n from o where length(word) >= {LEAST_LENGTH} group by word having sum(n) >= {LEAST_COUNT}),
e as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as less from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
pairs as (select a.word, c.word as other, c.n from e a join e c on a.i = c.i and a.less = c.less and a.word <> c.word
  union select e.word, w.word, w.n from e join w on w.word = e.less union select w.word, e.word, e.n from e join w on w.word = e.less),
best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as form, max(n) as form_n from pairs group by word),
f as (select w.word, case when form_n >= {FORM_FACTOR} * w.n then form end as form, w.n, coalesce(n_near, 0) as n_near, case when form_n >= {FORM_FACTOR} * w.n then form_n end as form_n from w left join best using (word)),
way as (select word, coalesce(form, word) as root from f union select way.word, f.form from way join f on f.word = way.root where f.form is not null),
last as (select way.word, way.root from way join f on f.word = way.root where f.form is null)
select f.word, form, root, n, n_near, form_n from f join last using (word)
"""
