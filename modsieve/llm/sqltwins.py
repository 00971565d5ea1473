"""SQL that must give the rows of the queries, where SQL can express them."""

from __future__ import annotations

from modsieve.llm import chat, quality, sharding

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_rules() -> str:
    phrases = " or ".join("contains(lower(line), '{}')".format(p.replace("'", "''")) for p in quality.BOILERPLATE)
    blank, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
    navigation = quality.NAVIGATION.replace("'", "''")
    return f"""
    with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
    split as (select *, {WORDS} as words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{word}')) as lines from docs),
    judged as (
      select rid, l.line, len(regexp_replace(l.line, '{blank}+', '', 'g')) as chars,
        ({phrases}) or len(regexp_extract_all(line, '{navigation}')) * 100 >= len(regexp_extract_all(line, '{word}')) * {quality.NAVIGATION_PERCENT}
        or len(regexp_extract_all(line, '{quality.SYMBOL}')) * 100 > len(line) * {quality.SYMBOL_PERCENT}
        or not regexp_matches(line, '{quality.SENTENCE_END.replace("'", "''")}') as failed
      from split, unnest(lines) as l(line)),
    lost as (select rid, sum(case when failed then chars else 0 end) as n_lost_chars from judged group by rid),
    windows as (
      select rid, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] as gram from split, unnest(range(1, len(words) - 1)) as w(p)),
    found as (select rid, p from (select *, count(*) over (partition by rid, gram) as n from windows) where n > 1),
    covered as (select rid, count(distinct p + k) as n_repeat_words from found, unnest([0, 1, 2]) as s(k) group by rid),
    base as (
      select s.rid, doc_id, len(words) as n_words, len(array_to_string(words, '')) as word_chars,
        len(regexp_extract_all(text, '{quality.SYMBOL}')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lost_chars, 0) as n_lost_chars
      from split s left join lost using (rid) left join covered using (rid)),
    failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
    select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
      cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
      not base_failed and n_lost_chars * 100 <= word_chars * 50 as kept, cast(n_lost_chars as bigint) as n_lost_chars
    from failed"""


def shards() -> str:
    """The permutation as nested arithmetic; a recursive query walks the cycles.  CRC-32 is folded over the bytes."""
    prime, n_shards = sharding.PRIME, 16

    def mixed(value: str, multiplier: int, offset: int) -> str:
        squared = f"(({value} + {offset}) % {prime})"
        return f"((((({squared} * {squared} + {multiplier}) % {prime}) * {multiplier}) % {prime}) >> 5) & ((1 << bits) - 1)"

    rounds = ["select rid, rows, bits, x >> bits as l0, x & ((1 << bits) - 1) as r0 from walked where x >= rows or not started"]
    for k, (multiplier, offset) in enumerate(sharding.ROUNDS):
        rounds.append(f"select rid, rows, bits, r{k} as l{k + 1}, xor(l{k}, {mixed(f'r{k}', multiplier, offset)}) as r{k + 1} from ({rounds[-1]}) t{k}")
    last = len(sharding.ROUNDS)
    return f"""
    with recursive table_of as (
      select list(c order by b) as crcs from (
        select b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from (select cast(unnest(range(256)) as bigint) as b))),
    narrow as (
      select doc_id, strlen(coalesce(text, '')) + 1 as size,
        xor(list_reduce(list_prepend(cast(4294967295 as bigint),
          list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint))),
          lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1])), 4294967295) as text_crc32
      from documents, table_of),
    numbered as (
      select *, row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as rid, count(*) over () as rows from narrow),
    sized as (
      select *, greatest(1, (case when rows <= 1 then 0 else length(regexp_replace(bin(rows - 1), '^0+', '')) end + 1) // 2) as bits from numbered),
    walked as (
      select rid, rows, bits, rid as x, false as started from sized
      union all
      select rid, rows, bits, (l{last} << bits) | r{last} as x, true as started from ({rounds[-1]}) done)
    select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law, cast(x % {n_shards} as integer) as shard,
      cast(x // {n_shards} as bigint) as slot, cast(null as integer) as grown_shard
    from sized join (select rid, x from walked where started and x < rows) using (rid)"""


def exchanges() -> str:
    control = chat.CONTROL.replace("'", "''")
    frame = len(chat.OPEN) + len(chat.BETWEEN) + len(chat.CLOSE)
    return f"""
    with turns as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
      union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    conflicts as (
      select *, contains(text, '</s>') or regexp_matches(text, '[<\\[]\\\\+(/?s>|/?INST\\])') or contains(role, '{chat.BETWEEN}') or contains(role, '</s>')
        or regexp_matches(role, '[<\\[]\\\\+(/?s>|/?INST\\])') as escaped from turns),
    rendered as (
      select *, case when escaped then regexp_replace(role, '{control}', '\\1\\\\\\2\\3', 'g') else role end as role_out,
        case when escaped then regexp_replace(text, '{control}', '\\1\\\\\\2\\3', 'g') else text end as text_out from conflicts)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text_out)) as turns_sha256,
      cast(coalesce(sum(case when role = 'assistant' then len(text) end), 0) as bigint) as loss_chars,
      sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text_out), '')) as loss_sha256,
      cast(sum({frame} + len(role_out) + len(text_out)) as bigint) as formatted_chars, true as identical
    from rendered group by conv_id"""


EXACT_COPIES = r"""
    with digests as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
    groups as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from digests group by text_sha256)
    select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from digests join groups using (text_sha256)"""

MIXTURE = rf"""
    with sized as (select doc_id, source, cast(len({WORDS}) as bigint) as size from documents),
    sources as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
    weighted as (
      select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from sources),
    ordered as (
      select *, row_number() over (order by source_size / weight, source nulls last) as place,
        sum(source_size) over () * 1.5::double as all_words, cast(sum(weight) over () as bigint) as all_weights from weighted),
    measured as (
      select *, all_words - coalesce(sum(source_size) over (order by place rows between unbounded preceding and 1 preceding), 0) * 2.0::double as rest,
        all_weights - cast(coalesce(sum(weight) over (order by place rows between unbounded preceding and 1 preceding), 0) as bigint) as heavy
      from ordered),
    capped as (select *, rest * weight >= source_size * 2.0::double * heavy as is_full from measured),
    level as (select rest as level_rest, heavy as level_heavy from capped where not is_full order by place limit 1),
    targets as (
      select source, source_size, case when is_full then source_size * 2.0::double else level_rest * weight / level_heavy end as target
      from capped left join level on true),
    rates as (select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from targets),
    drawn as (
      select *, cast(('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13)) as bigint) / 4503599627370496::double as draw from sized)
    select doc_id, size, source_size, target, size * (cast(floor(rate) as bigint) + case when draw < rate - floor(rate) then 1 else 0 end) as taken
    from drawn d join rates r on d.source is not distinct from r.source"""

LINKS = r"""
    with rules(rule, host, path, verdict) as (values
      ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'),
      ('org/fr/', 'org', '/fr/', 'allow')),
    parts as (
      select row_number() over () as rid, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host
      from pages),
    fitting as (
      select rid, r.rule, r.verdict, row_number() over (partition by rid order by length(r.rule) desc, length(r.host) desc) as place
      from parts p, rules r where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
    select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
    from parts left join (select * from fitting where place = 1) using (rid)"""

RANKED = r"""
    with found as (
      select row_number() over () as rid, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
    asked as (
      select row_number() over () as qid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from benchmark),
    sizes as (select cast(count(*) as bigint) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from found where len(terms) > 0),
    normal as (select rid, id, 75 + (25 * cast(len(terms) as bigint) * n_docs) // n_terms as m from found, sizes where len(terms) > 0),
    postings as (select rid, term, cast(count(*) as bigint) as tf from (select rid, unnest(terms) as term from found) group by rid, term),
    wanted as (select qid, item_id, term, cast(count(*) as bigint) as times from (select qid, item_id, unnest(terms) as term from asked) group by qid, item_id, term),
    weights as (
      select term, cast(floor(1000.0::double * ln(cast(2 * n_docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w
      from (select term, count(*) as df from postings group by term), sizes),
    scored as (
      select qid, item_id, id, rid, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
      from wanted join weights using (term) join postings using (term) join normal using (rid) group by qid, item_id, id, rid),
    placed as (select *, row_number() over (partition by qid order by score desc, id nulls last) as place from scored where score > 0)
    select item_id, cast(place as integer) as rank, id as doc_id, score from placed where place <= 20"""

MINED = r"""
    with used as (
      select row_number() over (order by vec_id nulls last) as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
      from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    pairs as (
      select a.rid as arid, a.vec_id as anchor_id, b.rid as rid, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
      from used a, used b where a.vec_id % 50 = 0 and a.rid <> b.rid),
    positives as (
      select * from (select *, row_number() over (partition by arid order by score desc, rid) as place from pairs where same) where place <= 5),
    windowed as (
      select p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score,
        row_number() over (partition by p.arid, p.rid order by n.score desc, n.rid) as place
      from positives p join pairs n on p.arid = n.arid and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
    select anchor_id, positive_id, cast(place as integer) as rank, negative_id, positive_score, negative_score from windowed where place <= 3"""

SQL = {
    "op2_quality_rules": quality_rules(), "op3_sharding": shards(), "op4_chat_formatting": exchanges(), "op6_exact_dedup": EXACT_COPIES,
    "op9_mixing": MIXTURE, "op11_url_filters": LINKS, "op12_ranked_search": RANKED, "op13_hard_negatives": MINED,
}
