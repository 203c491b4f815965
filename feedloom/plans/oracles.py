"""DuckDB SQL of the registered core queries."""

from __future__ import annotations

from ..functions.text import ARABIC_INDIC, EMOJI, FUNCTION_WORDS, INVISIBLE

_LO, _HI = "timestamp '2026-03-01 00:00:00'", "timestamp '2026-04-26 23:59:59.999999'"
_WS = r"[\s\p{Z}\x1c-\x1f\x{85}]"


def _q(text: str) -> str:
    return text.replace("'", "''")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')"


def _norm(x: str) -> str:
    return _strip(f"regexp_replace(regexp_replace(nfc_normalize({x}), '{INVISIBLE}', '', 'g'), '[ \\t]+', ' ', 'g')")


def _lang(x: str) -> str:
    words = f"regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{M}}]+')"
    n = {k: f"len(list_filter({words}, lambda w: w in ({', '.join(repr(w) for w in v)})))" for k, v in FUNCTION_WORDS.items()}
    most = f"greatest({', '.join(n.values())})"
    pick = "case " + " ".join(f"when {c} = m then '{k}'" for k, c in reversed(n.items())) + " end"
    ties = " + ".join(f"({c} = m)::int" for c in n.values())
    return most, pick, ties


def _merged(title: str = "title", body: str = "body") -> str:
    return f"concat_ws(chr(10), nullif({_strip(title)}, ''), nullif({_strip(body)}, ''))"


def _with_lang(source: str, text: str) -> str:
    """``source`` with columns lang and non_english of the text expression."""
    most, pick, ties = _lang(text)
    return f"""
      select *, coalesce(len({_tokens(text)}) >= 7 and lang <> 'en', false) as non_english from (
        select *, case when len(regexp_extract_all({text}, '[\\x{{0900}}-\\x{{097F}}]')) >= 3 then 'hi'
          when len(regexp_extract_all({text}, '[\\x{{0400}}-\\x{{04FF}}]')) >= 5 then 'ru'
          when m >= 2 and ({ties}) = 1 then {pick} end as lang
        from (select *, {most} as m from {source}))"""


def _phone() -> str:
    """The pattern of telephone numbers without looking ahead: a number after a plus has seven digits or more and stretches over nine characters."""
    d, gap = r"\p{Nd}", r"[\s\x0b\p{Z}\x{85}\-().]"
    more = lambda n: f"(?:{gap}*{d}){{{n}}}"
    eight = [f"{d}{more(k)}{gap}+{d}{more(6 - k)}" for k in range(7)]
    seven = [f"{d}{more(k)}{gap}{{2,}}{d}{more(5 - k)}" for k in range(6)] + [f"{d}{more(i)}{gap}+{d}{more(j)}{gap}+{d}{more(4 - i - j)}" for i in range(5) for j in range(5 - i)]
    space = r"[\s\x0b\p{Z}\x{85}]"
    part = r"[\s\x0b\p{Z}\x{85}\-.]"
    return "|".join([rf"\+{d}(?:{gap}*{d}){{8,}}", *(rf"\+{x}" for x in eight + seven), rf"\(?{d}{{3,5}}\)?{part}{d}{{3,5}}(?:{part}{d}{{2,}})+", rf"(?:{d}{space}){{6,}}{d}"])


URL = r"(?i)https?://\S+"
EMAIL = r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
SPELLED = r"(?i)\b[A-Z0-9._%+\-]+\s*(?:\(\s*at\s*\)|\[\s*at\s*\]|at)\s*[A-Z0-9.\-]+\s*(?:\(\s*dot\s*\)|\[\s*dot\s*\]|dot)\s*[A-Z]{2,}\b"


def _scrubbed(source: str, text: str) -> str:
    """``source`` with t0 to t5, the text expression after each step of the chain; numbers beside a full stop are no accounts, which captured neighbours tell."""
    beside = r"[^.\p{L}\p{M}\p{N}_]"
    once = lambda x: f"regexp_replace({x}, '(^|{beside})\\p{{Nd}}{{10,16}}($|{beside})', '\\1[account]\\2', 'g')"
    chain = f"(select *, translate({text}, '{ARABIC_INDIC}', '0123456789') as t0 from {source})"
    for i, (kind, pattern) in enumerate((("url", URL), ("email", EMAIL), ("email", SPELLED), ("phone", _phone()))):
        chain = f"(select *, regexp_replace(t{i}, '{pattern}', '[{kind}]', 'g') as t{i + 1} from {chain})"
    return f"(select *, {once(once('t4'))} as t5 from {chain})"


_SPEC_MEMBERS = """
  listed as (select distinct run_id, cluster_id, unnest(member_review_ids) as review_id from review_cluster),
  known as (select review_id, arg_min(rating, seq) as rating from (select review_id, seq, rating from clean_review) group by 1),
  first_rating as (select c.review_id, c.rating from clean_review c join (select review_id, min(seq) as seq from clean_review group by 1) f using (review_id, seq)),
  members as (select l.*, k.rating from listed l join first_rating k using (review_id))"""


def oracle_sql() -> dict[str, str]:
    digits = f"translate(text, '{ARABIC_INDIC}', '0123456789')"
    url = URL
    email, spelled = EMAIL, SPELLED
    iso = "strftime(posted_at, '%Y-%m-%dT%H:%M:%S') || case when extract(microsecond from posted_at) % 1000000 <> 0 then '.' || strftime(posted_at, '%f') else '' end || '+00:00'"
    week = "strftime(posted_at, '%G-W%V')"
    quarter = "'Q' || least((right({0}, 2)::int - 1) // 13 + 1, 4) || ' ' || left({0}, 4)"
    monday = "(make_date(left({0}, 4)::int, 1, 4) - (isodow(make_date(left({0}, 4)::int, 1, 4)) - 1)::int + (right({0}, 2)::int - 1) * 7)"
    emoji = f"regexp_matches(concat_ws(' ', title, body), '{EMOJI}')"
    in_window = f"posted_at between {_LO} and {_HI}"
    dist = "1 - d / (case when na = 0 then 1 else na end * case when nb = 0 then 1 else nb end)"
    vec = f"""
      with e as (select vec_id, case when label = 9 then -1 else label end as label, embedding from embeddings),
      x as (select vec_id, label, unnest(embedding)::double as v, unnest(range(1, len(embedding) + 1)) as i from e where label <> -1),
      c as (select label, i, avg(v) as m from x group by 1, 2),
      p as (select x.label, vec_id, sum(v * m) as d, sqrt(sum(v * v)) as na, sqrt(sum(m * m)) as nb from x join c using (label, i) group by 1, 2),
      r as (select label, vec_id, round({dist}, 9) as distance from p)"""
    slug = "trim(regexp_replace(lower(product), '[^a-z0-9]+', '-', 'g'), '-')"
    anchor = f"'pulse-' || {slug} || '-' || iso_week"
    title_case = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
    sent = "gmail_message_id is not null and not coalesce(forced, false) and not coalesce(dry_run, false)"
    first_text = "(select c.review_id, c.text from clean_review c join (select review_id, min(seq) as seq from clean_review group by 1) f using (review_id, seq))"
    escaped = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    unescaped = "replace(replace(replace({0}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    themes = f"""
      with listed as (select run_id, cluster_id, unnest(member_review_ids) as review_id from review_cluster),
      first_rating as (select c.review_id, c.rating from clean_review c join (select review_id, min(seq) as seq from clean_review group by 1) f using (review_id, seq)),
      n as (select run_id, cluster_id, count(review_id) as review_count, avg(rating) as avg_rating from listed left join first_rating using (review_id) group by 1, 2),
      t as (select run_id, cluster_id, coalesce(review_count, 0) as review_count, avg_rating from (select run_id, cluster_id from review_cluster) left join n using (run_id, cluster_id))"""
    tokens = "regexp_split_to_array(lower({0}), '" + _WS + "+')"
    # the judged rows of cleaning: merged, scrubbed, too short, in another language, repeated
    judged = f"""
      with a as (select source, seq, review_id, t5 as text from {_scrubbed('raw_review', _merged())}),
      b as (select *, len(list_filter({_tokens('text')}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}_]'))) < 5 as short, sha256({_norm('text')}) as hash from ({_with_lang('a', 'text')})),
      c as (select *, case when short then 'short' when non_english then 'lang' end as why from b),
      k as (select *, coalesce(why, case when row_number() over (partition by hash, why is null order by case source when 'app_store' then 1 when 'play_store' then 2 else 0 end, seq) > 1 then 'dedup' end) as drop_reason from c)"""
    points = """
      s as (select vec_id, case when label = 9 then -1 else label end as label, list_transform(embedding, lambda x: x::double) as x from embeddings order by md5(vec_id::varchar), vec_id limit 200),
      g as (select a.vec_id, a.label as own, b.label as other, sum(list_distance(a.x, b.x)) as total, count(*) as n from s a join s b on true group by 1, 2, 3),
      m as (select vec_id, max(total / greatest(n - 1, 1)) filter (own = other) as a, max(n) filter (own = other) as n, min(total / n) filter (own <> other) as b from g group by 1)"""
    return {
        "merge_title_body": f"select seq, {_merged()} as text from raw_review",
        "text_normalize_hash": f"select seq, {_norm('text')} as normalized, sha256({_norm('text')}) as hash from clean_review",
        "text_hash_check": f"select case when text_hash is null then 'none' when text_hash = sha256({_norm('text')}) then 'same' else 'other' end as state, count(*) as n from clean_review group by 1",
        "emoji_flag": f"select seq, {emoji} as has_emoji from raw_review",
        "letters_filter": "select seq, len(regexp_extract_all(body, '\\p{L}')) as letters, len(regexp_extract_all(body, '\\p{L}')) < 4 as too_short from raw_review",
        "token_filter": f"select seq, n, n < 5 as too_short from (select seq, len(list_filter({_tokens('text')}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}_]'))) as n from clean_review)",
        "language_gate": f"select seq, lang, non_english from ({_with_lang('raw_review', 'body')})",
        "pii_counts": f"""
          select doc_id, len(regexp_extract_all(t0, '{url}')) as url, len(regexp_extract_all(t1, '{email}')) + len(regexp_extract_all(regexp_replace(t1, '{email}', '[email]', 'g'), '{spelled}')) as email
          from (select doc_id, t0, regexp_replace(t0, '{url}', '[url]', 'g') as t1 from (select doc_id, {digits} as t0 from documents))""",
        "pii_scrub": f"""
          select doc_id, t5 as text, len(regexp_extract_all(t0, '{url}')) as url, len(regexp_extract_all(t1, '{email}')) + len(regexp_extract_all(t2, '{spelled}')) as email, len(regexp_extract_all(t3, '{_phone()}')) as phone,
            len(string_split(t5, '[account]')) - len(string_split(t4, '[account]')) as account from {_scrubbed('documents', 'text')}""",
        "clean_reasons": f"{judged} select seq, source || ':' || review_id as review_id, drop_reason from k",
        "corpus_stats": f"""{judged} select source, count(*) as total_in, count(*) filter (drop_reason is null) as total_out, 0::bigint as dropped_pii, count(*) filter (drop_reason = 'short') as dropped_short,
          count(*) filter (drop_reason = 'lang') as dropped_lang, count(*) filter (drop_reason = 'dedup') as dedup_count from k group by 1""",
        "union_rows": "select source, seq, rating from raw_review where source in ('app_store', 'play_store', 'web_forum')",
        "silhouette_sampled": f"with {points.lstrip()} select count(*) as n, round(avg(case when n > 1 then (b - a) / greatest(a, b, 1e-12) else 0 end), 6) as silhouette from m",
        "theme_answers": f"""
          with l as (select run_id, cluster_id, unnest(centroid_review_ids) as review_id, unnest(range(len(centroid_review_ids))) as rank from review_cluster),
          f as (select run_id, cluster_id, arg_min({unescaped.format(escaped.format("coalesce(text, '')"))}, rank) as t from l join {first_text} using (review_id) group by 1, 2)
          select run_id, cluster_id, array_to_string(({_tokens('t')})[1:6], ' ') as title from f where t <> ''""",
        "audit_error_cut": """
          with n as (select doc_id, text, case when strlen(text) > 300 then list_max(list_filter(range(0, 301), lambda i: strlen(left(text, i)) <= 300)) end as n from documents)
          select doc_id, case when n is null then text else left(text, n) || case when strlen(left(text, n)) < 300 then chr(65533) else '' end || '…[truncated]' end as cut from n""",
        "synthetic_ids": f"select seq, 'synth_' || left(sha256(coalesce(author, '') || '|' || {iso} || '|' || left(coalesce(body, ''), 200)), 16) as synthetic_id, source || ':' || review_id as prefixed_id from raw_review",
        "iso_weeks": f"select {week} as iso_week, {quarter.format(week)} as quarter, count(*) as n from raw_review group by 1, 2",
        "week_windows": f"""
          select run_id, true as valid, ({monday.format('iso_week')} + 6 - 56)::timestamp as window_start, ({monday.format('iso_week')} + 7)::timestamp - interval 1 microsecond as window_end,
            {quarter.format('iso_week')} as quarter from pulse_run""",
        "last_completed_weeks": "select run_id, strftime(started_at + interval 330 minutes - interval 7 days, '%G-W%V') as week from pulse_run",
        "week_ranges": f"""
          with b as (select product, min(iso_week) as a, max(iso_week) as z from pulse_run group by 1)
          select product, strftime(unnest(generate_series({monday.format('a')}::timestamp, {monday.format('z')}::timestamp, interval 7 days)), '%G-W%V') as week from b""",
        "source_resolution": "select slug, concat_ws(',', case when coalesce(app_store_id, '') <> '' then 'app_store' end, case when coalesce(play_store_id, '') <> '' then 'play_store' end) as sources from product_registry",
        "window_filter": f"select seq, source, posted_at from raw_review where {in_window}",
        "window_dedup": f"select source, review_id, seq, rating, body from raw_review where {in_window} qualify row_number() over (partition by source, review_id order by seq) = 1",
        "ingest_funnel": f"""
          with r as (select * from ({_with_lang("(select *, " + _strip("coalesce(body, '')") + " as _b from raw_review)", "_b")})),
          f as (select *, {in_window} as inside, row_number() over (partition by source, review_id, {in_window} order by seq) as k from r),
          w as (select source, case when not inside then 'window' when k > 1 then 'dup' when {emoji} then 'emoji' when non_english then 'lang' when len(regexp_extract_all(coalesce(body, ''), '\\p{{L}}')) < 4 then 'short' end as why from f)
          select source, count(*) as total_in, count(*) filter (why = 'window') as window_dropped, count(*) filter (why = 'dup') as dedup_dropped, count(*) filter (why = 'emoji') as emoji_dropped,
            count(*) filter (why = 'lang') as lang_dropped, count(*) filter (why = 'short') as short_dropped, count(*) filter (why is null) as kept, count(why) as total_dropped from w group by 1""",
        "source_cap": "select source, seq from raw_review qualify row_number() over (partition by source order by seq) <= 500",
        "source_caps": "select source, least(count(*), 500) as n, count(*) >= 500 as capped from raw_review group by 1",
        "union_of_sources": "select s as source, count(seq) as n, case when count(seq) >= 1 then 'ok' else 'empty' end as status from (values ('app_store'), ('play_store'), ('web_forum')) v(s) left join raw_review on source = s group by 1",
        "missing_sources": f"""
          with w as (select slug as product, 'app_store' as source from product_registry where coalesce(app_store_id, '') <> '' union all select slug, 'play_store' from product_registry where coalesce(play_store_id, '') <> '')
          select product, source, {title_case.format("replace(source, '_', ' ')")} || ' unavailable this week.' as note from w where (product, source) not in (select product, source from clean_review where product is not null)""",
        "payload_fields": """select seq, case when json_valid(raw) then try_cast(json_extract_string(raw, '$."im:rating".label') as bigint) end as payload_rating,
            case when json_valid(raw) then try_cast(json_extract_string(raw, '$.thumbsUpCount') as bigint) end as helpful from raw_review""",
        "dedup_first_hash": "select text_hash, seq, review_id from clean_review where text_hash is not null qualify row_number() over (partition by text_hash order by seq) = 1",
        "embedding_cache_misses": "select distinct text_hash from clean_review where text_hash is not null and text_hash not in (select text_hash from embedding_cache)",
        "cache_upsert": """
          with b as (select model_version, text_hash, cache_id, created_at, 0 as n from embedding_cache union all
            select model_version, text_hash, cache_id + 1000000, created_at + interval 1 day, 1 from embedding_cache where cache_id % 3 = 0)
          select model_version, text_hash, cache_id from b qualify row_number() over (partition by model_version, text_hash order by created_at desc, n desc) = 1""",
        "centroid_topn": f"{vec} select label, k as rank, vec_id, round(distance, 4) as distance from (select *, row_number() over (partition by label order by distance, vec_id) as k from r) where k <= 5",
        "cosine_to_centroid": f"{vec} select label, count(*) as size, round(avg({dist}), 4) as mean_distance from p group by 1",
        "noise_share": "select count(*) as n, count(*) filter (label = 9) as n_noise, round(count(*) filter (label = 9) / greatest(count(*), 1), 6) as ratio, (count(*) filter (label = 9) / greatest(count(*), 1) > 0.8 or count(*) filter (label <> 9) = 0) as fallback from embeddings",
        "cluster_assemble": f"with {_SPEC_MEMBERS.lstrip()} select run_id, cluster_id, count(*) as size, round(avg(rating), 4) as avg_rating, min(review_id) as first_member from members group by 1, 2",
        "rating_histogram": f"with {_SPEC_MEMBERS.lstrip()} select run_id, cluster_id, rating, count(*) as n from members where rating is not null group by 1, 2, 3",
        "cluster_rank": """
          with s as (select run_id, cluster_id, size * (1 + 0.4::double * (5 - coalesce(avg_rating, 5.0::double))) as score from review_cluster)
          select run_id, cluster_id, row_number() over (partition by run_id order by score desc, cluster_id) as rank, round(score, 4) as score from s qualify rank <= 2""",
        "fallback_buckets": """
          with b as (select seq, posted_at, case when rating <= 2 then 0 when rating = 3 then 1 else 2 end as bucket from clean_review where rating is not null),
          z as (select bucket, count(*) as size from b group by 1 having count(*) >= 5)
          select bucket, k as rank, seq, size from (select *, row_number() over (partition by bucket order by posted_at desc, seq) as k from b) join z using (bucket) where k <= 5""",
        "prompt_lines": f"""
          with l as (select run_id, cluster_id, unnest(centroid_review_ids) as review_id, unnest(range(len(centroid_review_ids))) as rank from review_cluster)
          select run_id, cluster_id, rank, '<review id="' || review_id || '">' || {escaped.format("coalesce(text, '')")} || '</review>' as line from l join {first_text} using (review_id)""",
        "quote_validate": f"""
          with c as (select distinct run_id, cluster_id, unnest(centroid_review_ids) as review_id from review_cluster),
          m as (select distinct run_id, cluster_id, unnest(member_review_ids) as review_id from review_cluster),
          t as {first_text},
          q as (select run_id, cluster_id, review_id, unnest([{escaped.format('left(text, 40)')}, 'never said ' || left(text, 9)]) as quote from c join t using (review_id))
          select run_id, cluster_id, count(*) as n_valid from q join m using (run_id, cluster_id, review_id) join t using (review_id)
          where {_norm(unescaped.format('quote'))} <> '' and contains({_norm('text')}, {_norm(unescaped.format('quote'))}) group by 1, 2""",
        "title_dedup": f"""
          with l as (select run_id, cluster_id, centroid_review_ids[1] as review_id from review_cluster),
          g as (select run_id, list(array_to_string(({_tokens('text')})[1:5], ' ') order by cluster_id) as t from l join {first_text} using (review_id) group by 1)
          select run_id, len(t) as n, array_to_string(list_reduce(list_transform(t, lambda x: [x]), lambda acc, x: case when len(list_filter(acc, lambda k:
            len(list_intersect({_tokens('lower(k)')}, {_tokens('lower(x[1])')})) / len(list_distinct(list_concat({_tokens('lower(k)')}, {_tokens('lower(x[1])')}))) > 0.7)) > 0 then acc else list_concat(acc, x) end), ' / ') as kept from g""",
        "action_word_limit": f"select doc_id, len(list_filter(string_split(text, '. '), lambda a: len({_tokens('a')}) <= 12)) as n_short, left(text, 60) as title from documents",
        "token_budget_running": f"""
          with l as (select run_id, cluster_id, unnest(centroid_review_ids) as review_id from review_cluster),
          p as (select run_id, cluster_id, sum(length('<review id="' || review_id || '">' || {escaped.format("coalesce(text, '')")} || '</review>')) + count(*) - 1 as chars from l join {first_text} using (review_id) group by 1, 2),
          e as (select run_id, cluster_id, (chars // 4 + 500)::bigint as estimate from p)
          select *, running <= 2500 as admitted from (select *, sum(estimate) over (partition by run_id order by cluster_id rows unbounded preceding)::bigint as running from e)""",
        "latest_states": """
          select run_id, case when left(run_id, 1) in ('0', '3', '6', '9', 'c', 'f') then 'ok' else status end as status,
            case when left(run_id, 1) in ('0', '3', '6', '9', 'c', 'f') then started_at + interval 1 hour else started_at end as event_at from pulse_run""",
        "repeated_sends": f"select product, iso_week, count(*) as n from pulse_run where {sent} group by 1, 2 having count(*) > 1",
        "anchor_slug": f"""
          select run_id, {anchor} as anchor, {anchor} = doc_section_anchor as as_stored, sha256(product || '|' || iso_week || '|1') as key,
            'https://docs.google.com/document/d/' || run_id || '/edit#heading=' || {anchor} as link from pulse_run""",
        "anchor_membership": f"select {anchor} as anchor, run_id from pulse_run where {anchor} in (select doc_section_anchor from pulse_run where status = 'ok' and doc_section_anchor is not null)",
        "utf16_lengths": "select seq, length(body) + len(regexp_extract_all(body, '[\\x{10000}-\\x{10FFFF}]')) as units, length(body) as chars from raw_review",
        "recent_runs": "select run_id, product, started_at, status from pulse_run order by started_at desc, run_id limit 10",
        "prior_send": f"select product, iso_week, run_id, gmail_message_id from pulse_run where {sent} qualify row_number() over (partition by product, iso_week order by started_at desc, run_id) = 1",
        "partial_runs": "select product, iso_week, run_id from pulse_run where status = 'partial' qualify row_number() over (partition by product, iso_week order by started_at desc, run_id) = 1",
        "run_decision": f"""
          select product, iso_week, case when iso_week = '2026-W07' then 'FORCE_RESEND' when bool_or({sent}) then 'SKIP_ALREADY_SENT' when bool_or(status = 'partial') then 'RETRY_EMAIL_ONLY' else 'PROCEED' end as decision from pulse_run group by 1, 2""",
        "run_counts": "select product, count(*) as n_runs, count(gmail_draft_id) as n_drafts, count(*) filter (status in ('partial', 'failed')) as n_pending from pulse_run group by 1",
        "worst_exit": "select iso_week, max(case when status in ('ok', 'skipped') then 0 when status = 'partial' then 2 else 1 end)::bigint as exit_code from pulse_run group by 1",
        "latest_run": f"""
          with l as (select product, run_id, started_at, iso_week, status from pulse_run where status in ('ok', 'partial') qualify row_number() over (partition by product order by started_at desc, run_id desc) = 1)
          select slug as product, display_name, array_to_string(list_transform(list_filter(string_split(regexp_replace(split_part(email_recipients[1], '@', 1), '[._-]', ' ', 'g'), ' '), lambda w: w <> ''),
              lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') as team,
            run_id, started_at, iso_week, status, strftime(started_at, '%d/%m/%Y, %H:%M:%S') as started from product_registry left join l on slug = product""",
        "activity_feed": """
          select product, rank, run_id, case when gmail_draft_id <> '' then 'Drafted weekly pulse for ' || iso_week when doc_section_anchor <> '' then 'Updated Pulse Doc for ' || iso_week else 'Run ' || status || ' for ' || iso_week end as label,
            case when gmail_draft_id <> '' or doc_section_anchor <> '' then '#22c55e' else '#9ca3af' end as colour, strftime(started_at, '%Y-%m-%d') as day
          from (select *, row_number() over (partition by product order by started_at desc, run_id) as rank from pulse_run) where rank <= 3""",
        "theme_enrich_priority": f"""{themes}
          select run_id, cluster_id, review_count, round(avg_rating, 4) as avg_rating, k as position, case when k = 0 then 'Top Priority' when k <= 2 then 'High Priority' else 'Priority' end as priority,
            case when k = 0 then '#ef4444' when k <= 2 then '#f97316' else '#3b82f6' end as priority_colour
          from (select *, row_number() over (partition by run_id order by review_count desc, cluster_id) - 1 as k from t)""",
        "pulse_summary": f"""{themes}
          select run_id, case when avg(avg_rating) is null then '0.0' else case when (round(avg(avg_rating), 4) - 3.5) * 20 >= 0 then '+' else '' end || format('{{:.1f}}', (round(avg(avg_rating), 4) - 3.5) * 20) || '%' end as shown,
            case when avg(avg_rating) is null then 'neutral' when (round(avg(avg_rating), 4) - 3.5) * 20 >= 0 then 'up' else 'down' end as direction, count(*) as n_themes, round(avg(avg_rating), 4) as mean_rating, case when avg(avg_rating) < 3.5 then 'High' when avg(avg_rating) < 4.2 then 'Medium' else 'Low' end as level,
            round((avg(avg_rating) - 3.5) * 20, 4) as sentiment, case when avg(avg_rating) is null then 'neutral' when avg(avg_rating) - 3.5 >= 0 then 'bullish' else 'bearish' end as mood, count(*) filter (avg_rating < 4) as urgent from t group by 1""",
        "star_strip": "select run_id, cluster_id, floor(avg_rating)::bigint as \"full\", avg_rating - floor(avg_rating) >= 0.5 as half from review_cluster",
        "quote_cut": "select seq, case when length(text) > 120 then rtrim(left(text, 120), ' ') || '…' else text end as shown from clean_review",
        "doc_blocks": f"""
          with p as (select run_id, sum(size) as n from review_cluster group by 1),
          r as (select run_id, product, iso_week, window_start, window_end, llm_model, forced, n from pulse_run join p using (run_id)),
          b as (
            select run_id, 0 as a, 0 as b, 0 as c, 'heading_2' as type, 'Week of ' || strftime(window_end, '%Y-%m-%d') || ' (ISO ' || iso_week || ') — ' || n || ' reviews' as text, {anchor} as anchor, null as attribution from r
            union all select run_id, 1, cluster_id, 0, 'heading_3', 'Theme ' || cluster_id, null, null from review_cluster join p using (run_id)
            union all select run_id, 1, cluster_id, 1, 'paragraph', size || ' reviews', null, null from review_cluster
            union all select run_id, 1, cluster_id, 2, 'blockquote', 'said in ' || centroid_review_ids[1], null, centroid_review_ids[1] from review_cluster where len(centroid_review_ids) > 0
            union all select run_id, 1, cluster_id, 3, 'heading_3', 'Action ideas', null, null from review_cluster where avg_rating < 3
            union all select run_id, 1, cluster_id, 4, 'bullet', 'Fix it', null, null from review_cluster where avg_rating < 3
            union all select run_id, 2, 0, 0, 'paragraph', 'LLM: ' || coalesce(llm_model, '') || ' · Window: ' || strftime(window_start, '%Y-%m-%d') || ' → ' || strftime(window_end, '%Y-%m-%d') || ' · Sources: app_store=' || (n + 7) || ', play_store=' || (n + 7), null, null from r
            union all select run_id, 3, 0, 0, 'paragraph', 'Low-volume week — themes derived by rating bucket, not clustering.', null, null from r where forced
            union all select run_id, 4, 0, 0, 'paragraph', 'Play Store unavailable this week.', null, null from r where n < 40)
          select run_id, row_number() over (partition by run_id order by a, b, c) - 1 as block_no, type, text, anchor, attribution from b""",
        "header_lookup": "select event_id as message_id from events where json_extract_string(props, '$.k') = '69' order by 1 limit 20",
        "event_days": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
    }
