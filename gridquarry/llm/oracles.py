"""What the registered queries return, in DuckDB's SQL, over whole tables: for those that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WHITE = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Windows of items in documents, and items whose four rarest words stand within 25 words of a document.
DECONTAMINATE = f"""with d as materialized (select row_number() over () rid, doc_id, {ALNUM} w from documents),
 i as materialized (select item_id, {ALNUM} w from benchmark where text is not null and item_id is not null),
 iw as materialized (select distinct item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') win from (select item_id, w, least(len(w), 13) n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) p from i where len(w) > 0)),
 dw as (select rid, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') win from (select rid, w, n, unnest(range(1, len(w) - n + 2)) p from d, (select distinct n from iw))),
 found as materialized (select dw.rid, dw.n, dw.p, iw.item_id from dw join iw using (n, win)),
 hit as (select rid, count(*) n_hit from (select distinct rid, unnest(range(p, p + n)) p from found) group by 1),
 items as (select rid, count(*) n_items, string_agg(item, ',' order by item) listed from (select distinct rid, cast(item_id as varchar) item from found) group by 1),
 place as materialized (select rid, unnest(w) t, generate_subscripts(w, 1) p from d),
 seen as (select t, count(distinct rid) n from place group by 1),
 term as (select irow, item_id, t, n, row_number() over (partition by irow order by n, t) k, total from (select distinct irow, item_id, total, unnest(w) t from (select row_number() over () irow, item_id, w, len(list_distinct(w)) total from i)) join seen using (t)),
 chosen as materialized (select irow, item_id, t, count(*) over (partition by irow) c, total from term where k <= 4 qualify c = least(4, total)),
 occ as materialized (select rid, irow, item_id, c, t, p from place join chosen using (t)),
 near as (select rid, count(distinct item_id) n_near from (select a.rid, a.item_id, a.c from occ a join occ b on a.rid = b.rid and a.irow = b.irow and b.p between a.p and a.p + 24 group by a.rid, a.irow, a.item_id, a.c, a.p having count(distinct b.t) = a.c) group by 1)
 select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(listed, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) contaminated, coalesce(n_near, 0) n_near
 from d left join hit using (rid) left join items using (rid) left join near using (rid)"""

#: All pairs of documents with a common shingle of five words, and what hangs together by similarities of 0.8 or more.
JACCARD = f"""with recursive d as materialized (select row_number() over () rid, doc_id, {WHITE.format(LOWER)} w from documents),
 sh as materialized (select distinct rid, array_to_string(list_slice(w, p, p + 4), ' ') s from (select rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) p from d where len(w) > 0)),
 size as materialized (select d.rid, d.doc_id, count(s) n from d left join sh using (rid) group by all),
 shared as materialized (select a.rid a, b.rid b, count(*) c from sh a join sh b on a.s = b.s and a.rid <> b.rid group by all),
 pairs as materialized (select a, b, c = x.n and c = y.n same from shared join size x on x.rid = a join size y on y.rid = b where c >= 0.8 * (x.n + y.n - c) - 1e-9 union all select x.rid, y.rid, true from size x join size y on x.n = 0 and y.n = 0 and x.rid <> y.rid),
 walk(rid, root) using key (rid) as (select rid, doc_id from size union select p.b, min(w.root) from walk w join pairs p on p.a = w.rid join recurring.walk o on o.rid = p.b where w.root < o.root group by all),
 told as (select a rid, count(*) n_links, count(*) filter (where same) same from pairs group by 1)
 select doc_id, root class_id, coalesce(n_links, 0) n_links, coalesce(same, 0) + 1 n_copies from size join walk using (rid) left join told using (rid)"""

#: Windows of 35 words that start twice, and the words outside them.
SUBSTRINGS = f"""with d as materialized (select row_number() over () rid, doc_id, {WHITE.format("coalesce(text, '')")} w from documents),
 win as materialized (select rid, p, sha256(array_to_string(list_slice(w, p, p + 34), ' ')) h from (select rid, w, unnest(range(1, len(w) - 33)) p from d where len(w) >= 35)),
 gone as (select distinct rid, unnest(range(p, p + 35)) p from win where h in (select h from win group by h having count(*) > 1)),
 word as (select rid, unnest(w) t, generate_subscripts(w, 1) p from d),
 kept as (select rid, count(*) n, string_agg(t, ' ' order by p) k from word anti join gone using (rid, p) group by 1)
 select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(k, '')) kept_sha256 from d left join kept using (rid)"""

#: Cosines of all pairs of a label.
EMBEDDINGS = """with recursive v as materialized (select row_number() over () rid, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
 ok as materialized (select *, sqrt(list_dot_product(e, e)) n from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
 pairs as materialized (select a.rid a, b.rid b from ok a join ok b on a.label = b.label and a.rid <> b.rid and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
 walk(rid, root) using key (rid) as (select rid, vec_id from v union select p.b, min(w.root) from walk w join pairs p on p.a = w.rid join recurring.walk o on o.rid = p.b where w.root < o.root group by all)
 select vec_id, coalesce(n, 0) n_links, root component_id, vec_id = root kept from v join walk using (rid) left join (select a rid, count(*) n from pairs group by 1) using (rid)"""

#: Unsigned crc32 of an ASCII text, bit by bit.
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda x: cast(ascii(x) as bigint))), lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda t, z: xor(t >> 1, (t & 1) * 3988292384))), 4294967295)"


def _hashed(text: str) -> str:
    part = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Trees of eight over the rows of each language and over the languages, level by level; then every leaf is led up again.
MERKLE = f"""with recursive leaf as materialized (select row_number() over () rid, doc_id, lang, {_hashed("text")} h, case when {CRC.format("cast(doc_id as varchar)")} % 3 = 0 then {_hashed(LOWER.replace("coalesce(text, '')", "text"))} end t from documents),
 own as materialized (select rid, doc_id, h, t, dense_rank() over (order by lang nulls first) - 1 g, row_number() over (partition by lang order by doc_id nulls first, h, rid) - 1 i, count(*) over (partition by lang) n from leaf),
 low as materialized (with recursive up(g, lv, i, n, h) as (select g, 0, i, n, h from own union all select g, lv + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' order by i)) from up where n > 1 group by g, lv, i // 8) select * from up),
 sub as materialized (select g, h, count(*) over () n from low where n = 1),
 high as materialized (with recursive up(lv, i, n, h) as (select 0, g, n, h from sub union all select lv + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' order by i)) from up where n > 1 group by lv, i // 8) select * from up),
 tall as (select g, max(lv) top from low group by g),
 step as materialized (select own.rid, lv, coalesce(string_agg(node.h, '' order by node.i) filter (where node.i < own.i // cast(8 ** lv as bigint)), '') l, coalesce(string_agg(node.h, '' order by node.i) filter (where node.i > own.i // cast(8 ** lv as bigint)), '') r
  from own join low node on node.g = own.g and node.n > 1 and node.i // 8 = own.i // cast(8 ** (lv + 1) as bigint) group by all
  union all select own.rid, top + 1 + high.lv, coalesce(string_agg(high.h, '' order by high.i) filter (where high.i < own.g // cast(8 ** high.lv as bigint)), ''), coalesce(string_agg(high.h, '' order by high.i) filter (where high.i > own.g // cast(8 ** high.lv as bigint)), '')
  from own join tall using (g) join high on high.n > 1 and high.i // 8 = own.g // cast(8 ** (high.lv + 1) as bigint) group by own.rid, top, high.lv, own.g),
 nth as materialized (select *, row_number() over (partition by rid order by lv) k from step),
 fold as (select rid, 0 k, coalesce(t, h) f from own union all select nth.rid, nth.k, sha256(l || f || r) from fold join nth on nth.rid = fold.rid and nth.k = fold.k + 1),
 ends as (select rid, arg_max(f, k) f from fold group by 1),
 proof as (select rid, sha256(string_agg(l || r, '' order by k)) p from nth group by 1),
 root as (select h root from high where n = 1)
 select doc_id, own.h leaf, sub.h subroot, root, coalesce(p, sha256('')) proof_sha256, f folded_root, f = root verified from own join sub using (g) cross join root join ends using (rid) left join proof using (rid)"""


def _dialogues() -> str:
    """Costs and letters of the cheapest edits so far for each place in the pattern (nothing yet, after s, u, a), row by row: nine digits, then the letters."""
    add = lambda s, w, x: f"lpad(cast(cast(left({s}, 9) as int) + {w} as varchar), 9, '0') || substr({s}, 10) || '{x}'"
    deleted = {c: add(f"w.{c}", 2, "D") for c in "esua"}
    keep = lambda c, i: f"case when not f.doomed and f.i = '{i}' then {add(f'w.{c}', 'f.extra', 'K')} end"
    other = lambda c: f"case when not f.doomed then {add(f'w.{c}', '1 + f.extra', 'R')} end"
    moved = {
        "e": deleted["e"],
        "s": f"least({deleted['s']}, {keep('e', 's')})",
        "u": "least(" + ", ".join([deleted["u"], *(keep(c, "u") for c in "esa"), *(other(c) for c in "esa")]) + ")",
        "a": "least(" + ", ".join([deleted["a"], keep("u", "a"), other("u")]) + ")",
    }
    first = "select cid, pos, " + ", ".join(f"{x} {c}" for c, x in moved.items()) + " from (select w.*, f.pos fpos, f.i, f.doomed, f.extra from walk w join f on f.cid = w.cid and f.pos = w.pos + 1) w"
    first = first.replace("select cid, pos,", "select cid, fpos pos,").replace("f.doomed", "w.doomed").replace("f.i ", "w.i ").replace("f.extra", "w.extra").replace("w.*, f.pos fpos, f.i, w.doomed, w.extra", "w.*, f.pos fpos, f.i, f.doomed, f.extra")
    once = f"select cid, pos, e, s, least(u, {add('e', 5, 'I')}, {add('s', 5, 'I')}, {add('a', 5, 'I')}) u, least(a, {add('u', 5, 'I')}) a from ({first})"
    twice = f"select cid, pos, e, s, least(u, {add('e', 5, 'I')}, {add('s', 5, 'I')}, {add('a', 5, 'I')}), least(a, {add('u', 5, 'I')}) from ({once})"
    text = lambda c: f"coalesce(cast({c} as varchar), ' ')"
    key = CRC.format(f"{text('conv_id')} || ':' || {text('turn')}")
    return rf"""with recursive c as materialized (select row_number() over () cid, conv_id from (select distinct conv_id from conversations)),
 k as materialized (select conv_id, turn, {text("role")} role, {text("text")} text, {key} % 20 k from conversations),
 dmg as (select conv_id, turn, case when k = 4 then 'user' else role end role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text, unnest(range(case when k = 3 then 2 else 1 end)) from k where k <> 0),
 r as materialized (select cid, row_number() over (partition by cid order by turn nulls first, role, text) pos, turn, role, text, left(role, 1) i from dmg join c on c.conv_id is not distinct from dmg.conv_id),
 f as materialized (select cid, pos, turn, role, text, i, fault, coalesce(fault in ('blank', 'duplicate'), false) doomed, case when fault = 'truncated' then 5 else 0 end extra, lag(i) over (partition by cid order by pos) before from (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by cid, role, text order by pos) > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' end fault from r)),
 walk(cid, pos, e, s, u, a) as (select cid, cast(0 as bigint), '000000000', cast(null as varchar), '000000005I', '000000010II' from c union all {twice}),
 best as materialized (select cid, arg_max(least(e, a), pos) b from walk group by 1),
 audit as materialized (select cid, cast(left(b, 9) as bigint) cost, substr(b, 10) audit from best),
 letter as (select cid, unnest(string_split(audit, '')) x, unnest(range(1, length(audit) + 1)) j from audit where audit <> ''),
 placed as (select *, count(*) filter (where x <> 'I') over (partition by cid order by j) pos, count(*) filter (where x <> 'D') over (partition by cid order by j) o from letter),
 written as materialized (select p.cid, j, x, o, case when x = 'K' then role end own, i, case when x = 'I' then '' else text end text from placed p left join f on f.cid = p.cid and f.pos = p.pos where x <> 'D'),
 led as (select cid, count(*) filter (where o = 1 and x = 'K' and i = 's') s from written group by 1),
 mended as (select cid, sha256(string_agg(coalesce(own, case when (o - s) % 2 = 1 then 'user' else 'assistant' end) || ':' || text, chr(10) order by j)) h from written join led using (cid) group by 1),
 stats as (select cid, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where fault = 'blank') blank, count(*) filter (where fault = 'duplicate') duplicate, count(*) filter (where fault = 'truncated') truncated, count(*) filter (where before || i not in ('su', 'ua', 'au')) illegal from f group by 1)
 select conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, cost, audit, coalesce(h, sha256('')) repaired_sha256 from c join audit using (cid) left join stats using (cid) left join mended using (cid)"""


#: All distances of the queries.
NEAREST = """with v as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
 ok as materialized (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
 d as (select q.rid, q.vec_id query_id, o.rid other, o.vec_id, sqrt(list_reduce(list_prepend(cast(0 as double), list_transform(range(1, len(q.e) + 1), lambda k: (o.e[k] - q.e[k]) * (o.e[k] - q.e[k]))), lambda x, y: x + y)) score from ok q join ok o on q.vec_id % 100 = 0 and q.rid <> o.rid and len(q.e) = len(o.e)),
 r as (select *, cast(row_number() over (partition by rid order by score, vec_id nulls last, other) as int) rank from d)
 select query_id, rank, vec_id, score from r where rank <= 10"""

ORACLES = {"op6_decontaminate": DECONTAMINATE, "op7_jaccard_join": JACCARD, "op8_substring_dedup": SUBSTRINGS, "op9_embedding_dedup": EMBEDDINGS, "op11_merkle_manifest": MERKLE, "op12_conversation_repair": _dialogues(), "op13_nearest": NEAREST}
