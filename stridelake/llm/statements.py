"""SQL (DuckDB) that states the results of text queries on the same tables."""

from __future__ import annotations

from stridelake.llm import quality as Q

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

JACCARD = f"""with recursive w as (select doc_id, {SPACED.format(LOWER)} as ws from documents),
  s as (select distinct doc_id, array_to_string(list_slice(ws, t.i, t.i + 2), ' ') as g
        from w, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) where len(ws) > 0),
  n as (select w.doc_id, count(g) as n_shingles from w left join s using (doc_id) group by 1),
  pairs as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
  links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y
            where 100 * k >= 90 * (a.n_shingles + b.n_shingles - k)),
  reach(x, y) as (select doc_id, doc_id from n union select reach.x, links.y from reach join links on links.x = reach.y)
select n.doc_id, n_shingles, (select min(y) from reach where x = n.doc_id) as component_id from n"""

REPEATS = f"""with w as (select doc_id, {SPACED.format("coalesce(text, '')")} as ws from documents),
  win as (select doc_id, t.i as i, array_to_string(list_slice(ws, t.i, t.i + 12), ' ') as g
          from w, unnest(range(1, len(ws) - 11)) t(i)),
  earliest as (select g, min(doc_id) as least from win group by 1),
  gone as (select distinct doc_id, win.i + k.k as p from win join earliest using (g), range(13) k(k) where least < doc_id),
  words as (select doc_id, t.p as p, ws[t.p] as word from w, unnest(range(1, len(ws) + 1)) t(p)),
  kept as (select doc_id, string_agg(word, ' ' order by p) as kept from words anti join gone using (doc_id, p) group by 1),
  lost as (select doc_id, count(*) as n_removed from gone group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id) left join lost using (doc_id)"""

HITS = f"""with w as (select doc_id, {ALNUM.format(LOWER)} as ws from documents),
  b as (select item_id, ws, least(10, len(ws)) as size from (select item_id, {ALNUM.format(LOWER)} as ws from benchmark) where len(ws) > 0),
  item as (select distinct item_id::varchar as item, size, array_to_string(list_slice(ws, t.i, t.i + size - 1), ' ') as g
           from b, unnest(range(1, len(ws) - size + 2)) t(i)),
  win as (select doc_id, size, t.i as i, array_to_string(list_slice(ws, t.i, t.i + size - 1), ' ') as g
          from w, (select distinct size from item) z, unnest(range(1, len(ws) - size + 2)) t(i)),
  hit as (select doc_id, item, win.i as i, size from win join item using (size, g)),
  inside as (select doc_id, count(distinct hit.i + k.k) as n_hit from hit, range(10) k(k) where k.k < size group by 1),
  items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct doc_id, item from hit) group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join inside using (doc_id) left join items using (doc_id)"""

_SOLID = r"length(regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g'))"
_FAILS = rf"""(
    (len(string_split_regex(x, '\s[|>»·•/]\s')) > {Q.NAVIGATION_SEPARATORS}
     and length(x) / len(string_split_regex(x, '\s[|>»·•/]\s')) <= {Q.NAVIGATION_ITEM})
    or length(regexp_replace(x, '{Q.SYMBOLS}', '', 'g')) > {Q.SYMBOL_SHARE}::double * {_SOLID.format("x")}
    or (length(regexp_replace(x, '\P{{L}}+', '', 'g')) >= {Q.CAPITAL_LENGTH}
        and length(regexp_replace(x, '\P{{Lu}}+', '', 'g')) > {Q.CAPITAL_SHARE}::double * length(regexp_replace(x, '\P{{L}}+', '', 'g')))
    or (length(x) <= {Q.BOILERPLATE_LENGTH} and regexp_matches(x, '{Q.BOILERPLATE}')))"""

QUALITY = rf"""with t as (select doc_id, coalesce(text, '') as text from documents),
  w as (select *, {SPACED.format("text")} as ws,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
  good as (select *, list_filter(list_distinct(lines), lambda x: not {_FAILS}) as kept_lines from w),
  sized as (select *, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) as all_chars,
                   coalesce(list_sum(list_transform(kept_lines, lambda x: length(x))), 0)::bigint as kept_chars,
                   coalesce(list_sum(list_transform(list_filter(kept_lines, lambda x: regexp_matches(x, '[.!?…。！？:;"''»”)\]][\x20\x09-\x0D]*$')), lambda x: length(x))), 0) as ended from good),
  win as (select doc_id, t.i as i, array_to_string(list_slice(ws, t.i, t.i + 2), ' ') as g from w, unnest(range(1, len(ws) - 1)) t(i)),
  twice as (select doc_id, g from win group by 1, 2 having count(*) > 1),
  inside as (select doc_id, count(distinct win.i + k.k) as n from win join twice using (doc_id, g), range(3) k(k) group by 1),
  m as (select doc_id, len(ws)::bigint as n_words, {_SOLID.format("text")}::bigint as word_chars,
               length(regexp_replace(text, '{Q.SYMBOLS}', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
               coalesce(n, 0)::bigint as n_repeat_words, kept_chars,
               all_chars > 0 and kept_chars >= {1 - Q.LOST_SHARE}::double * all_chars and kept_chars - ended <= {Q.OPEN_SHARE}::double * kept_chars as passes
        from sized left join inside using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       passes and not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as kept, kept_chars from m"""

RANKED = f"""with d as (select row_number() over () as r, doc_id, {ALNUM.format(LOWER)} as ws from documents),
  size as (select r, doc_id, len(ws)::bigint as n from d where len(ws) > 0),
  total as (select count(*)::bigint as docs, sum(n)::bigint as terms from size),
  tf as (select r, t, count(*)::bigint as tf from (select r, unnest(ws) as t from d) group by 1, 2),
  held as (select t, count(*)::bigint as df from tf group by 1),
  item as (select i, item_id, t, count(*)::bigint as c
           from (select i, item_id, unnest({ALNUM.format(LOWER)}) as t from (select row_number() over () as i, item_id, text from (select distinct item_id, text from benchmark)))
           group by 1, 2, 3),
  score as (select i, item_id, r, doc_id, sum(c * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint
                   * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::bigint as score
            from item join held using (t) join tf using (t) join size using (r), total group by 1, 2, 3, 4),
  ranked as (select item_id, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls last)::integer as rank from score where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20"""
