"""SQL (for DuckDB) of the queries that SQL can express."""

from __future__ import annotations

CHAT = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
counted as (select *, 12 + 1 + 11 + length(role) + length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|</?SYS>>|/?INST\])')) as chars from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
from counted group by conv_id
"""

LEDGER = r"""
with docs as (select doc_id, coalesce(text, '') as text, row_number() over () as row from documents),
words as (select row, unnest(w) as word, generate_subscripts(w, 1) as i from (select row, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from docs)),
grams as (select row, i, word || ' ' || lead(word) over (partition by row order by i) || ' ' || lead(word, 2) over (partition by row order by i) as gram from words),
again as (select row, i from (select row, i, count(*) over (partition by row, gram) as n from grams where gram is not null) where n > 1),
covered as (select row, count(*) as n_repeat_words from (select distinct row, i + k as i from again, (select unnest([0, 1, 2]) as k)) group by row),
per_word as (select row, count(*) as n_words, sum(length(word)) as word_chars, count(distinct word) as n_distinct from words group by row),
lines as (select row, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select row, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0D]') group by row),
measured as (
  select d.doc_id, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_distinct, 0) as n_distinct, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as n_letters, length(regexp_replace(text, '[^!]', '', 'g')) as n_bangs
  from docs d left join per_word using (row) left join lines using (row) left join covered using (row)),
ledger as (
  select *, cast(case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end + case when 10 * n_symbols > n_words and n_words > 0 then 4 else 0 end
    + case when n_lines >= 4 and 2 * n_dup_lines > n_lines then 8 else 0 end + case when n_letters > 0 and 2 * n_upper > n_letters then 16 else 0 end + case when 10 * n_bangs > 3 * n_words and n_words > 0 then 32 else 0 end
    + case when word_chars < 2 * n_words or word_chars > 14 * n_words then 64 else 0 end + case when n_words >= 50 and 2 * n_distinct * n_distinct < 5 * n_words then 128 else 0 end as bigint) as fail_bits from measured)
"""

QUALITY = f"{LEDGER} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 as base_failed, fail_bits = 0 as kept, fail_bits from ledger"
ABLATION = f"""{LEDGER}, rules as (select * from (values ('too_short', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('upper_case', 16), ('exclamation', 32), ('word_length', 64), ('few_distinct_words', 128)) t(rule, bit))
select rule, count(*) filter (where fail_bits & bit <> 0) as n_failed, count(*) filter (where fail_bits = bit) as n_only, count(*) filter (where fail_bits <> 0) as n_rejected from ledger, rules group by rule"""

PHRASES = r"""
with pieces as (
  select row_number() over () as piece, lang, p from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents)),
words as (select piece, lang, unnest(w) as w, generate_subscripts(w, 1) as i from (select piece, lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as w from pieces)),
near as (select lang, w as x, lead(w) over o as y, lead(w, 2) over o as z from words window o as (partition by piece order by i)),
found as (
  select lang, 1 as size, x as phrase, count(*) as n from near group by all
  union all select lang, 2, x || ' ' || y, count(*) from near where y is not null group by all
  union all select lang, 3, x || ' ' || y || ' ' || z, count(*) from near where z is not null group by all),
totals as (select lang, cast(sum(n) as bigint) as n from found where size = 1 group by lang),
named as (select *, string_split(phrase, ' ') as w from found where size > 1 and n >= 10),
cuts as (
  select lang, phrase, n as a, 1 as k, w[1] as first, array_to_string(w[2:], ' ') as rest from named
  union all select lang, phrase, n, 2, array_to_string(w[:2], ' '), w[3] from named where size = 3),
rated as (
  select c.lang, c.phrase, c.a, c.k, l.n as l, r.n as r, cast((1000000::hugeint * c.a * c.a) // (l.n::hugeint * r.n) as bigint) as score
  from cuts c join found l on l.lang = c.lang and l.phrase = c.first join found r on r.lang = c.lang and r.phrase = c.rest),
best as (select * from rated qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, n from named where size = 3),
longer as (select lang, phrase, max(n) as n from inside group by all),
ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, encode(b.phrase)) as rank from best b left join longer i on i.lang = b.lang and i.phrase = b.phrase where i.n is null or 100 * i.n < 50 * b.a)
select ranked.lang, rank, phrase, a, l, r, totals.n, score from ranked join totals using (lang) where rank <= 2000
"""

ORACLE_SQL = {"op3_chat_format": CHAT, "op8_quality": QUALITY, "op8_rule_ablation": ABLATION, "op11_collocations": PHRASES}
