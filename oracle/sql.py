"""The registered queries as SQL over the same tables.

Each statement is written against the tables directly and shares nothing with
the Spark code but the fixed word lists. ``CTES`` holds named parts; a query
text gets the parts it names, in order of their dependencies.
"""

from __future__ import annotations

import re

from signalloom.functions import lexicons as L
from signalloom.sources import adapter as A

SP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NSP = SP.replace("[", "[^", 1)
W = r"\p{L}\p{N}"


def text_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def rnd(x: str, n: int) -> str:
    """Correctly rounded, ties to even: what printing with n decimals gives."""
    return f"cast(format('{{:.{n}f}}', cast({x} as double)) as double)"


def clean(x: str) -> str:
    tags = f"regexp_replace(coalesce({x}, ''), '<.*?>', '', 'g')"
    links = rf"regexp_replace({tags}, 'https?://{NSP}+|www\.{NSP}+', '', 'g')"
    return f"trim(regexp_replace({links}, '{SP}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def key(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '{SP}+', ' ', 'g'))"


def redact(x: str, known: tuple[str, ...] = ()) -> str:
    for word in sorted(known, key=len, reverse=True):
        for _ in range(2):  # neighbours share the character between them
            x = rf"regexp_replace({x}, '(^|[^A-Za-z0-9_.-])(?i:{word})($|[^A-Za-z0-9_.-])', '\1redacted\2', 'g')"
    x = rf"regexp_replace({x}, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', 'redacted', 'g')"
    x = rf"regexp_replace({x}, '(^|[^A-Za-z0-9_])@[A-Za-z0-9_.-]{{2,}}', '\1@redacted', 'g')"
    return rf"regexp_replace({x}, '(^|[^0-9])(\+?\d[\d .()-]{{7,}}\d)', '\1redacted', 'g')"


def label(x: str) -> str:
    return f"case when {rnd(x, 4)} > 60 then 'positive' when {rnd(x, 4)} < 40 then 'negative' when {x} is not null then 'neutral' end"


def growth(e: str, r: str) -> str:
    return f"case when {e} <> 0 then ({r} - {e}) / {e} * 100.0 when {r} <= 0 then 0.0 end"


def pace(e: str, r: str) -> str:
    g = growth(e, r)
    return f"case when ({g}) is null then 'emerging' when ({g}) > 20 then 'rising' when ({g}) < -20 then 'fading' else 'stable' end"


VIEWS = [a for a, c in L.METRIC_ALIASES.items() if c == "views"]
LIKES = [a for a, c in L.METRIC_ALIASES.items() if c == "likes"]
COMMENTS = [a for a, c in L.METRIC_ALIASES.items() if c == "comments"]
COUNTER = (
    f"case when lower({strip('name')}) in ({text_list(VIEWS)}) then 'views' when lower({strip('name')}) in ({text_list(LIKES)}) then 'likes' "
    f"when lower({strip('name')}) in ({text_list(COMMENTS)}) then 'comments' end"
)
SPAM = " or ".join(f"contains(lower(raw_text), '{p}')" for p in A.SPAM_PHRASES)
BOTS = rf"(?i)(^|[^{W}_])(?:{'|'.join(A.BOT_WORDS)})($|[^{W}_])|automated\s+feed|feed-puller|that\s+it"
MOMENT = "coalesce(published_at, collected_at)"


def scored_cte(source: str, text: str) -> str:
    """Lexicon sentiment: phrases one after the other, then single words."""
    sql = f"(select *, lower({text}) as t0 from {source})"
    phrases = [("p", p) for p in A.LEXICON.positive_phrases] + [("n", p) for p in A.LEXICON.negative_phrases]
    for i, (_, p) in enumerate(phrases):
        sql = f"(select *, (length(t{i}) - length(replace(t{i}, '{p}', ''))) // {len(p)} as c{i}, replace(t{i}, '{p}', ' ') as t{i + 1} from {sql})"
    good = " + ".join(f"c{i}" for i, (k, _) in enumerate(phrases) if k == "p")
    bad = " + ".join(f"c{i}" for i, (k, _) in enumerate(phrases) if k == "n")
    last = f"t{len(phrases)}"
    words = f"regexp_extract_all({last}, '[{W}]+(?:[''’][{W}]+)?')"
    sql = f"(select *, {words} as ws from {sql})"
    sql = (
        f"(select *, {good} + len(list_filter(ws, lambda w: w in ({text_list(A.LEXICON.positive_words)}))) as good, "
        f"{bad} + len(list_filter(ws, lambda w: w in ({text_list(A.LEXICON.negative_words)}))) as bad from {sql})"
    )
    raw = (
        f"case when {text} is null or not regexp_matches({text}, '{NSP}') then null when good + bad = 0 then 50.0 "
        "else greatest(0.0, least(99.99, 50.0 + ((good - bad)::double / (good + bad)::double) * 50.0)) end"
    )
    sql = f"(select *, {rnd(raw, 4)} as score from {sql})"
    drop = ", ".join(["ws", "good", "bad", "t0"] + [f"c{i}" for i in range(len(phrases))] + [f"t{i + 1}" for i in range(len(phrases))])
    return (
        f"select * exclude ({drop}), {label('score')} as label, "
        f"0.5 + abs(score - 50.0) / 100.0 as confidence from {sql}"
    )


def engagement_cte(source: str) -> str:
    return f"""select run_id, source, case when grouping(source) = 1 then 'run' else 'source' end as level, count(*) filter (present > 0) as signal_count,
          count(*) filter (present = 3) as complete_signal_count, count(*) filter (present in (1, 2)) as partial_signal_count,
          sum(views::decimal(38,6))::double as views, count(views) as views_signal_count, sum(likes::decimal(38,6))::double as likes, count(likes) as likes_signal_count,
          sum(comments::decimal(38,6))::double as comments, count(comments) as comments_signal_count,
          sum(interactions::decimal(38,6))::double as interactions, count(interactions) as interactions_signal_count,
          {rnd("sum(likes::decimal(38,6)) filter (views > 0 and likes is not null)::double / nullif(sum(views::decimal(38,6)) filter (views > 0 and likes is not null)::double, 0)", 6)} as like_rate,
          count(*) filter (views > 0 and likes is not null) as like_rate_signal_count,
          {rnd("sum(comments::decimal(38,6)) filter (views > 0 and comments is not null)::double / nullif(sum(views::decimal(38,6)) filter (views > 0 and comments is not null)::double, 0)", 6)} as comment_rate,
          count(*) filter (views > 0 and comments is not null) as comment_rate_signal_count,
          {rnd("sum(interactions::decimal(38,6)) filter (views > 0 and interactions is not null)::double / nullif(sum(views::decimal(38,6)) filter (views > 0 and interactions is not null)::double, 0)", 6)} as engagement_rate,
          count(*) filter (views > 0 and interactions is not null) as engagement_rate_signal_count,
          {rnd("sum(present)::double / nullif(count(*) filter (present > 0) * 3, 0)", 4)} as metric_completeness
        from {source} group by grouping sets ((run_id), (run_id, source))"""


def terms_cte(source: str, exclude: bool) -> str:
    """Words, pairs and triples of ``source`` (columns gid, cleaned_text and, if excluding, keys)."""
    x = "nfc_normalize(cleaned_text)"
    x = rf"regexp_replace({x}, '(?i)https?://{NSP}+', ' ', 'g')"
    x = rf"regexp_replace({x}, '@[{W}_]+', ' ', 'g')"
    x = f"replace({x}, '#', ' ')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^{W}_])\p{{Nd}}+($|[^{W}_])', '\1 \2', 'g')"
    x = (
        rf"regexp_replace({x}, '[\x{{1F600}}-\x{{1F64F}}\x{{1F300}}-\x{{1F5FF}}\x{{1F680}}-\x{{1F6FF}}\x{{1F1E0}}-\x{{1F1FF}}\x{{2702}}-\x{{27B0}}"
        rf"\x{{1F900}}-\x{{1F9FF}}\x{{1FA00}}-\x{{1FA6F}}\x{{1FA70}}-\x{{1FAFF}}\x{{2600}}-\x{{26FF}}]+', ' ', 'g')"
    )
    x = f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"
    keep = "keys, " if exclude else ""
    wanted = "and not list_contains(keys, strip_accents(lower(w)))" if exclude else ""
    allowed = "and not list_contains(keys, strip_accents(lower(term)))" if exclude else ""
    return f"""
      select gid, term, seg_no, kind, k, (row_number() over (partition by gid order by seg_no, kind, k)) - 1 as place from (
        select gid, {keep} seg_no, 1 as kind, k, w as term from kw_{source}
        union all select gid, {keep} seg_no, 2, k, w || ' ' || w2 from kw_{source} where i2 - i <= 2
        union all select gid, {keep} seg_no, 3, k, w || ' ' || w2 || ' ' || w3 from kw_{source} where i3 - i <= 4
      ) where lower(term) not in ({text_list(L.COMPOUND_STOP_WORDS)}) {allowed}""", f"""
      select gid, {keep} seg_no, w, i, row_number() over s as k, lead(w) over s as w2, lead(i) over s as i2,
        lead(w, 2) over s as w3, lead(i, 2) over s as i3
      from (
        select gid, {keep} seg_no, unnest(ws) as w, generate_subscripts(ws, 1) as i from (
          select gid, {keep} seg_no, regexp_extract_all(seg, '[{W}]+(?:''[{W}]+)?') as ws from (
            select gid, {keep} unnest(segs) as seg, generate_subscripts(segs, 1) as seg_no from (
              select gid, {keep} string_split_regex({x}, '[.!?;:\n]+') as segs from {source})))
      )
      where length(w) >= 2 and lower(w) not in ({text_list(sorted(L.STOP_WORDS))}) and not regexp_full_match(w, '\\p{{Nd}}+')
        and not contains(lower(w), 'redacted') {wanted}
      window s as (partition by gid, seg_no order by i)"""


CTES: dict[str, str] = {
    "docs": """select doc_id, source as run_id, case doc_id % 3 when 0 then 'youtube' when 1 then 'community' else 'hype' end as source,
        source || '-' || case doc_id % 3 when 0 then 'youtube' when 1 then 'community' else 'hype' end as module_run_id,
        case doc_id % 3 when 0 then 'video' when 1 then 'community' else 'serp_result' end as signal_type,
        text as raw_text, lang as language, case when doc_id % 29 = 0 then null else md5(text) end as external_item_id from documents""",
    "plain": f"""select *, (length(cleaned_text) < 10 or {SPAM}) as spam_flag from (
        select doc_id as signal_id, * exclude (doc_id),
        case doc_id // 20 % 5 when 0 then 'VN' when 1 then 'us' when 2 then ' JP' when 3 then null else 'KR' end as country_code,
        case doc_id % 7 when 0 then 'collector' when 1 then ' Region ' when 2 then case when length(run_id) = 4 then 'gps' end when 3 then '' end as location_mode,
        [language, ' ' || source, '', 't' || (doc_id // 20 % 5)::varchar] as tags,
        case when doc_id % 11 = 0 then null else timestamp '2024-01-01 00:00:00' + to_hours((doc_id * 37 % 720)::int) end as published_at,
        timestamp '2024-01-31 00:00:00' as collected_at, {clean('raw_text')} as cleaned_text from docs)""",
    "metrics": """select event_id % (select count(*) from documents) as signal_id,
        case event_type when 'view' then case when event_id % 2 = 0 then 'views' else ' View_Count' end when 'click' then 'likes'
          when 'signup' then 'comments' when 'purchase' then 'search_interest' else 'views' end as name,
        case event_type when 'view' then round(value * 100) when 'error' then -value else value end as value,
        date_trunc('day', ts)::timestamp as recorded_at, case when event_id % 5 = 0 then 'count' end as unit from events""",
    "observed": f"select *, {COUNTER} as counter from metrics",
    "signals": """select p.*, list_filter([case when f.eng then 'engagement' end, case when signal_type = 'serp_result' then 'search_intent' end,
          case when cleaned_text <> '' then 'text' end, case when signal_type = 'trend_observation' or f.trend then 'trend_observation' end],
          lambda m: m is not null) as modalities
        from plain p left join (select signal_id, bool_or(counter is not null) as eng, bool_or(lower(name) = 'search_interest') as trend
          from observed where value is not null group by 1) f using (signal_id)""",
    "ds": "select * from signals where not spam_flag",
    "runs": f"""select run_id, {A.RUN_KEYWORD} as keyword, timestamp '2024-01-01 00:00:00' as timeframe_start,
        timestamp '2024-01-31 00:00:00' as timeframe_end from (select distinct source as run_id from documents)""",
    "module_runs": """select distinct module_run_id, run_id, source as module_type,
        case when source = 'hype' and length(run_id) = 5 then 'failed' else 'completed' end as status from docs""",
    "sealed": f"select *, row_number() over (partition by run_id order by {MOMENT}, source, signal_id) as signal_no from ds",
    "run_keys": f"""select run_id, keyword, list_filter(list_distinct(list_transform(
        list_concat(string_split(trim(regexp_replace(keyword, '{SP}+', ' ', 'g')), ' '), [keyword]), lambda p: {key('p')})), lambda p: p <> '') as keys from runs""",
    # sentiment
    "gated": f"""select *, case when not list_contains(modalities, 'text') then 'no_text' when language not in ({text_list(A.LANGUAGES)}) then 'unsupported'
        when not regexp_matches(cleaned_text, '{NSP}') then 'invalid' else 'processed' end as text_status from ds""",
    "to_score": "select *, case when text_status = 'processed' then cleaned_text end as shown from gated",
    "classified": scored_cte("to_score", "shown"),
    "items": "select run_id, signal_id, source, signal_type, label, score, confidence from classified where text_status = 'processed'",
    "sent": f"""select run_id, signal_count, applicable_count, processed_count, invalid_text_count, unsupported_language_count,
          positive_count, neutral_count, negative_count, source_count, invalid_text_count + unsupported_language_count as skipped_count,
          case when processed_count > 0 then {rnd('sum_score / processed_count', 4)} end as average_score,
          case when processed_count > 0 then {rnd('sum_conf / processed_count', 4)} end as average_confidence,
          case when processed_count > 0 then {rnd('positive_count / processed_count * 100.0', 2)} end as positive_pct,
          case when processed_count > 0 then {rnd('neutral_count / processed_count * 100.0', 2)} end as neutral_pct,
          case when processed_count > 0 then {rnd('negative_count / processed_count * 100.0', 2)} end as negative_pct,
          case when processed_count > 0 then 'completed' else 'skipped' end as status,
          case when processed_count = 0 then 'no_data' when invalid_text_count + unsupported_language_count > 0 then 'degraded' else 'complete' end as coverage_status,
          case when applicable_count > 0 then processed_count / applicable_count else 0.0 end as coverage
        from (select run_id, count(*) as signal_count, count(*) filter (text_status <> 'no_text') as applicable_count,
          count(*) filter (text_status = 'processed') as processed_count, count(*) filter (text_status = 'invalid') as invalid_text_count,
          count(*) filter (text_status = 'unsupported') as unsupported_language_count, count(*) filter (label = 'positive') as positive_count,
          count(*) filter (label = 'neutral') as neutral_count, count(*) filter (label = 'negative') as negative_count,
          count(distinct source) filter (text_status <> 'no_text') as source_count,
          sum(score::decimal(38,6))::double as sum_score, sum(confidence::decimal(38,8))::double as sum_conf
        from classified group by 1)""",
    "eligible": "select * from signals where not spam_flag",
    "scored": scored_cte("eligible", "cleaned_text"),
    "aspects": "select run_id, signal_id, source, unnest(list_filter(["
    + ", ".join(
        f"case when {' or '.join(f'contains(lower(cleaned_text), {chr(39)}{t}{chr(39)})' for t in terms)} then '{name}' end" for name, terms in A.ASPECTS.items()
    )
    + "], lambda a: a is not null)) as aspect, label, score from scored",
    # keywords
    "kin": f"""select s.signal_no * 16777216 as gid, s.run_id, s.source, s.cleaned_text, k.keys, s.signal_id from sealed s join run_keys k using (run_id)
        where list_contains(modalities, 'text') and language in ({text_list(A.LANGUAGES)}) and regexp_matches(cleaned_text, '{NSP}')""",
    "kin_ids": "select signal_id as gid, run_id, source, cleaned_text, keys from kin",
    "kw_kin_ids": terms_cte("kin_ids", True)[1],
    "kterms": terms_cte("kin_ids", True)[0],
    "kmentions": """select s.run_id, s.source, t.term, s.signal_no * 16777216 + t.place as position, t.gid as signal_id from kterms t join sealed s on s.signal_id = t.gid""",
    "ktable": """select run_id, canonical_form, arg_min(term, pick) as keyword, sum(n)::bigint as frequency, min(first) as first
        from (select *, row_number() over (partition by run_id, canonical_form order by n desc, first) as pick from (
          select run_id, strip_accents(lower(term)) as canonical_form, term, count(*) as n, min(position) as first from kmentions group by all)) group by 1, 2""",
    "kranked": "select *, row_number() over (partition by run_id order by frequency desc, first, canonical_form) as rank from ktable",
    "ktotals": f"""select r.run_id, signal_count, applicable_count, invalid_text_count, unsupported_language_count, source_count,
          coalesce(total_unique_keywords, 0) as total_unique_keywords, coalesce(total_mentions, 0)::bigint as total_mentions,
          coalesce(processed_signal_count, 0) as processed_signal_count, applicable_count - coalesce(processed_signal_count, 0) as skipped_signal_count
        from (select run_id, count(*) as signal_count, count(*) filter (text_status <> 'no_text') as applicable_count,
            count(distinct source) filter (text_status <> 'no_text') as source_count,
            count(*) filter (text_status = 'invalid') as invalid_text_count, count(*) filter (text_status = 'unsupported') as unsupported_language_count
          from gated group by 1) r
        left join (select run_id, count(*) as total_unique_keywords, sum(frequency) as total_mentions from ktable group by 1) using (run_id)
        left join (select run_id, count(distinct signal_id) as processed_signal_count from kmentions group by 1) using (run_id)""",
    "lin": "select signal_id as gid, run_id, cleaned_text, keys from signals join run_keys using (run_id) where not spam_flag and cleaned_text <> ''",
    "kw_lin": terms_cte("lin", True)[1],
    "lterms": terms_cte("lin", True)[0],
    "spelled": "select s.run_id, t.term, count(*) as n from lterms t join signals s on s.signal_id = t.gid group by all",
    "merged": f"""select run_id, arg_min(term, pick) as keyword, sum(n)::bigint as count from (
        select *, row_number() over (partition by run_id, k order by n desc, length(term) desc, term desc) as pick from (select *, {key('term')} as k from spelled)) group by run_id, k""",
    "mranked": "select *, row_number() over (partition by run_id order by count desc, keyword) as rank from merged",
    "pin": "select signal_id as gid, run_id, cleaned_text from ds",
    "kw_pin": terms_cte("pin", False)[1],
    "pterms": terms_cte("pin", False)[0],
    # engagement
    "latest": """select signal_id, max(struct_pack(a := recorded_at, v := value)) filter (counter = 'views' and value >= 0) as v,
          max(struct_pack(a := recorded_at, v := value)) filter (counter = 'likes' and value >= 0) as l,
          max(struct_pack(a := recorded_at, v := value)) filter (counter = 'comments' and value >= 0) as c,
          max(recorded_at) filter (counter is not null and value >= 0) as latest_metric_at,
          count(*) filter (counter is null) as unsupported_count, count(*) filter (counter is not null and value < 0) as invalid_count,
          (count(*) filter (counter is not null and value >= 0) - count(distinct counter) filter (counter is not null and value >= 0)) as duplicate_count
        from observed group by 1""",
    "led": """select signal_id, value, recorded_at, max(struct_pack(a := recorded_at, v := value)) over (partition by signal_id, counter
          order by recorded_at, lower(trim(name)), coalesce(unit, ''), value, rid rows between unbounded preceding and 1 preceding) as w
        from (select *, row_number() over () as rid from observed) where counter is not null and value >= 0""",
    "conflicts": "select signal_id, count(*) filter (w.a = recorded_at and w.v <> value) as conflict_count from led group by 1",
    "recs": f"""select *, coalesce(likes, comments) is not null as has_i, case when coalesce(likes, comments) is not null then coalesce(likes, 0) + coalesce(comments, 0) end as interactions,
          (views is not null)::int + (likes is not null)::int + (comments is not null)::int as present
        from (select s.run_id, s.signal_id, s.source, {MOMENT} as ranking_at, l.v.v as views, l.l.v as likes, l.c.v as comments,
          coalesce(unsupported_count, 0) as unsupported_count, coalesce(invalid_count, 0) as invalid_count, coalesce(duplicate_count, 0) as duplicate_count
          from ds s left join latest l using (signal_id) where list_contains(modalities, 'engagement'))""",
    "rated": f"""select *, case when views > 0 then {rnd('likes / views', 6)} end as like_rate, case when views > 0 then {rnd('comments / views', 6)} end as comment_rate,
          case when views > 0 then {rnd('interactions / views', 6)} end as engagement_rate from recs""",
    "eng": engagement_cte("recs"),
    "quality": """select run_id, sum(unsupported_count)::bigint as unsupported_observation_count, sum(invalid_count)::bigint as invalid_observation_count,
          sum(duplicate_count)::bigint as duplicate_observation_count, sum(coalesce(conflict_count, 0))::bigint as conflicting_observation_count,
          count(*) filter (present = 0) as skipped_signal_count, count(*) as applicable_count, count(*) filter (present > 0) as done,
          count(*) filter (present in (1, 2)) as partial, count(*) filter (views = 0 and has_i) as zero, count(distinct source) filter (true) as source_count
        from recs left join conflicts using (signal_id) group by 1""",
    "engmod": """select run_id, case when coalesce(done, 0) > 0 then 'completed' else 'skipped' end as status,
          case when coalesce(done, 0) = 0 then 'no_data' when skipped_signal_count + invalid_observation_count + partial + zero > 0 then 'degraded' else 'complete' end as coverage_status,
          case when coalesce(applicable_count, 0) > 0 then done / applicable_count else 0.0 end as coverage, coalesce(applicable_count, 0) as applicable_count,
          coalesce(done, 0) as processed_count, coalesce(source_count, 0) as source_count,
          array_to_string(list_filter([case when coalesce(applicable_count, 0) = 0 then 'NO_APPLICABLE_SIGNALS:0' end,
            case when applicable_count > 0 and done = 0 then 'NO_VALID_ENGAGEMENT_METRICS:' || applicable_count end,
            case when skipped_signal_count > 0 then 'SIGNALS_WITHOUT_VALID_ENGAGEMENT_METRICS:' || skipped_signal_count end,
            case when invalid_observation_count > 0 then 'INVALID_ENGAGEMENT_METRICS_IGNORED:' || invalid_observation_count end,
            case when unsupported_observation_count > 0 then 'UNSUPPORTED_ENGAGEMENT_METRICS_IGNORED:' || unsupported_observation_count end,
            case when duplicate_observation_count > 0 then 'METRIC_SNAPSHOTS_RESOLVED:' || duplicate_observation_count end,
            case when conflicting_observation_count > 0 then 'SAME_TIMESTAMP_METRIC_CONFLICTS_RESOLVED:' || conflicting_observation_count end,
            case when partial > 0 then 'PARTIAL_ENGAGEMENT_METRICS:' || partial end, case when zero > 0 then 'ZERO_VIEWS_RATE_UNAVAILABLE:' || zero end],
            lambda w: w is not null), '|') as warnings from (select distinct run_id from ds) left join quality using (run_id)""",
    # trend
    "tsig": f"""select s.run_id, signal_id, source, {MOMENT} as moment, timeframe_start + (timeframe_end - timeframe_start) / 2 as midpoint
        from ds s join runs using (run_id) where list_has_any(modalities, ['engagement', 'trend_observation'])""",
    "tobs": "select t.run_id, o.*, case when recorded_at < midpoint then 'earlier' else 'recent' end as half from tsig t join observed o using (signal_id)",
    "halves": f"""select run_id, name, half, sum(case when lower({strip('name')}) in ({text_list(L.CUMULATIVE_METRICS)}) then last_value else total end) as value, sum(n) as observations from (
        select run_id, signal_id, name, half, max(struct_pack(a := recorded_at, u := coalesce(unit, ''), v := value)).v::decimal(38,6) as last_value,
          sum(value::decimal(38,6)) as total, count(*) as n from tobs group by all) group by all""",
    "tmetrics": f"""select run_id, metric_name, current_value, case when known then e end as previous_value, case when known then {growth('e', 'current_value')} end as growth_rate,
          case when known then {pace('e', 'current_value')} else 'stable' end as momentum from (
        select h.run_id, name as metric_name, coalesce(sum(value) filter (half = 'recent'), 0)::double as current_value, coalesce(sum(value) filter (half = 'earlier'), 0)::double as e,
          any_value(en) > 0 as known from halves h join (select run_id, coalesce(sum(observations) filter (half = 'earlier'), 0) as en from halves group by 1) using (run_id) group by 1, 2)""",
    "periods": """select run_id, count(*) as applicable_count, count(*) filter (coalesce(m, moment) < midpoint) as earlier_signal_count,
          count(*) filter (coalesce(m, moment) >= midpoint) as recent_signal_count, count(distinct source) as source_count
        from tsig left join (select signal_id, max(recorded_at) as m from metrics where value is not null group by 1) using (signal_id) group by 1""",
    "tsum": f"""select run_id, signal_count, applicable_count, earlier_observations, recent_observations, source_count, status,
          case when earlier_observations + recent_observations = 0 then 'no_data' when status = 'completed' and two then 'complete' when status = 'completed' then 'degraded' end as coverage_status,
          case when status = 'completed' and earlier_observations > 0 then e end as earlier_total, case when status = 'completed' and recent_observations > 0 then r end as recent_total,
          case when status = 'completed' and two then {growth('e', 'r')} end as overall_growth_rate,
          case when status = 'completed' and two then {pace('e', 'r')} when status = 'completed' then 'stable' end as overall_momentum,
          case when status <> 'completed' then null when not two then 50.0 when ({growth('e', 'r')}) is null then 75.0
            else {rnd(f"greatest(0.0, least(100.0, 50.0 + ({growth('e', 'r')}) / 2.0))", 2)} end as trend_score,
          case when status = 'completed' then earlier_observations + recent_observations end as total_metric_observations
        from (select *, earlier_observations > 0 and recent_observations > 0 as two, case when earlier_observations + recent_observations = 0 then 'skipped'
          when (case when earlier_observations > 0 then earlier_signal_count else 0 end) + (case when recent_observations > 0 then recent_signal_count else 0 end) <> applicable_count
            or (earlier_observations > 0 and e < 0) or (recent_observations > 0 and r < 0) then 'failed' else 'completed' end as status
        from (select a.run_id, signal_count, coalesce(applicable_count, 0) as applicable_count, coalesce(earlier_signal_count, 0) as earlier_signal_count,
          coalesce(recent_signal_count, 0) as recent_signal_count, coalesce(p.source_count, 0) as source_count, coalesce(eo, 0)::bigint as earlier_observations, coalesce(ro, 0)::bigint as recent_observations,
          coalesce(e, 0.0) as e, coalesce(r, 0.0) as r from (select run_id, count(*) as signal_count from ds group by 1) a left join periods p using (run_id)
          left join (select run_id, sum(observations) filter (half = 'earlier') as eo, sum(observations) filter (half = 'recent') as ro,
            sum(value) filter (half = 'earlier')::double as e, sum(value) filter (half = 'recent')::double as r from halves group by 1) h using (run_id)))""",
    # velocity
    "sums": """select signal_id, sum(value::decimal(38,6)) as all_values, sum(value::decimal(38,6)) filter (name in ('views', 'likes', 'comments')) as engagement
        from metrics where value is not null group by 1""",
    "calendar": "select run_id, source, d::date as day, (d::date - date '2024-01-01')::bigint as day_no from (select distinct run_id, source from ds), generate_series(timestamp '2024-01-02', timestamp '2024-01-31', interval 1 day) g(d)",
    "daily": """select c.run_id, c.source, c.day, day_no, coalesce(volume, 0) as volume, coalesce(engagement, 0.0) as engagement from calendar c left join (
        select run_id, source, published_at::date as day, count(*) as volume, sum(all_values)::double as engagement from ds left join sums using (signal_id)
        where published_at::date > date '2024-01-01' and published_at::date <= date '2024-01-31' group by all) f on c.run_id = f.run_id and c.source = f.source and c.day = f.day""",
    # regions and anomalies
    "sigeng": "select signal_id, sum(greatest(value, 0.0)::decimal(38,6)) as engagement from observed where counter is not null group by 1",
    "geo_in": f"""select s.run_id, case when length(upper({strip('country_code')})) >= 2 then upper({strip('country_code')}) end as country_code,
        nullif(lower({strip('location_mode')}), '') as mode, e.engagement, i.score, s.tags from ds s left join sigeng e using (signal_id) left join items i using (signal_id)""",
    "geo_run": f"""select run_id, count(*) filter (country_code is not null) as located, count(*) filter (country_code is null) as unlocated,
          count(distinct country_code) as region_count, count(mode) filter (country_code is not null) as modes,
          count(*) filter (country_code is not null and mode is not null and mode not in ({text_list(L.COLLECTOR_LOCATION_MODES)})) as other,
          case when count(score) > 0 then {rnd('sum(score::decimal(38,6))::double / count(score)', 4)} end as global_avg from geo_in group by 1""",
    "regions": f"""select run_id, row_number() over (partition by run_id order by signal_count desc, total_engagement desc, country_code) as rank, country_code, signal_count,
          {rnd('signal_count / located', 6)} as share_of_signals, sentiment_score_avg, {rnd('sentiment_score_avg - global_avg', 4)} as sentiment_vs_global, total_engagement,
          {rnd('total_engagement / signal_count', 4)} as engagement_per_signal from (
        select run_id, country_code, count(*) as signal_count, {rnd('coalesce(sum(engagement), 0)::double', 4)} as total_engagement,
          case when count(score) > 0 then {rnd('sum(score::decimal(38,6))::double / count(score)', 4)} end as sentiment_score_avg
        from geo_in where country_code is not null group by 1, 2) join geo_run using (run_id)""",
    "series": f"""select r.run_id, d::date as day, coalesce(n, 0)::double as signal_volume, {rnd('coalesce(e, 0)', 4)} as interaction_volume
        from runs r, generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 1 day) g(d) left join (
          select run_id, published_at::date as day, count(*) as n, sum(engagement)::double as e from ds left join sigeng using (signal_id)
          where published_at >= timestamp '2024-01-01' and published_at < timestamp '2024-01-31' group by all) f on f.run_id = r.run_id and f.day = d::date""",
    "long": "select run_id, day, 'signal_volume' as metric_name, signal_volume as value from series union all select run_id, day, 'interaction_volume', interaction_volume from series",
    "med": "select run_id, metric_name, median(value) as median, sum(value) as total, count(*) as periods from long group by 1, 2",
    "base": """select m.*, mad, mean_deviation from med m join (select run_id, metric_name, median(abs(value - median)) as mad, avg(abs(value - median)) as mean_deviation
        from long join med using (run_id, metric_name) group by 1, 2) using (run_id, metric_name)""",
    "scored_day": f"""select run_id, metric_name, day, value, median, case when mad > 0 then {rnd('0.6745 * abs(value - median) / mad', 4)}
          when mean_deviation > 0 then {rnd('0.7979 * abs(value - median) / mean_deviation', 4)} end as deviation
        from long join base using (run_id, metric_name) where periods >= 4 and total >= 3""",
    "alert": f"""select run_id, metric_name, case when value > median then 'spike' else 'drop' end as anomaly_type, {rnd('value', 4)} as observed_value, {rnd('median', 4)} as baseline_value,
          deviation as deviation_score, case when deviation >= 6 then 'high' when deviation >= 4.5 then 'medium' else 'low' end as severity, day
        from scored_day where deviation >= 3 and value <> median""",
    # scores
    "outs": """select r.run_id, r.keyword, s.average_score, s.overall_label, s.positive_count, s.neutral_count, s.negative_count, t.trend_score, t.overall_momentum,
          e.signal_count as engagement_signals, e.complete_signal_count as complete_signals, e.views, e.likes, e.comments, e.interactions, k.total_unique_keywords
        from runs r left join (select *, case when round(average_score, 4) > 60 then 'positive' when round(average_score, 4) < 40 then 'negative' else 'neutral' end as overall_label
            from sent where status = 'completed') s using (run_id)
        left join (select * from tsum where status = 'completed') t using (run_id)
        left join (select * from eng where level = 'run' and signal_count > 0) e using (run_id)
        left join (select * from ktotals where processed_signal_count > 0) k using (run_id)""",
    "vparts": f"""select *, (case when sp is not null then 0.5 else 0.0 end) + (case when tp is not null then 0.3 else 0.0 end) + (case when ep is not null then 0.2 else 0.0 end) as wsum from (
        select run_id, {rnd('greatest(0.0, least(100.0, average_score))', 2)} as sp0, average_score, {rnd('trend_score', 2)} as tp,
          case when average_score is not null then {rnd('greatest(0.0, least(100.0, average_score))', 2)} end as sp,
          {rnd('per', 4)} as engagement_raw, {rnd('case when per is not null then least(100.0, 25.0 * log10(1.0 + per)) end', 2)} as ep
        from (select *, case when engagement_signals > 0 and coalesce(views, likes, comments) is not null
          then (coalesce(views, 0.0) + coalesce(likes, 0.0) + coalesce(comments, 0.0)) / engagement_signals end as per from outs))""",
    "vibe": f"""select run_id, case when wsum > 0 then 'scored' else 'insufficient_data' end as status, score as vibe_score,
          case when score is null then null when score >= 80 then 'very_positive' when score >= 60 then 'positive' when score >= 40 then 'neutral' when score >= 20 then 'negative' else 'very_negative' end as label,
          sp as sentiment_part, tp as trend_part, ep as engagement_part, engagement_raw,
          case when sp is not null then {rnd('0.5::double / wsum', 6)} end as sentiment_weight, case when tp is not null then {rnd('0.3::double / wsum', 6)} end as trend_weight,
          case when ep is not null then {rnd('0.2::double / wsum', 6)} end as engagement_weight,
          ((sp is not null)::int + (tp is not null)::int + (ep is not null)::int)::bigint as available_component_count
        from (select *, case when wsum > 0 then {rnd('coalesce(sp * (0.5::double / wsum), 0.0) + coalesce(tp * (0.3::double / wsum), 0.0) + coalesce(ep * (0.2::double / wsum), 0.0)', 2)} end as score
          from (select * replace (wsum::double as wsum) from vparts))""",
    "hvals": f"""select run_id, case when average_score is not null then {rnd('least(100.0, greatest(0.0, average_score))', 2)} end as v1,
          case when positive_count + neutral_count + negative_count > 0 then {rnd('negative_count / (positive_count + neutral_count + negative_count)', 4)} end as v2,
          {rnd('trend_score', 2)} as v3, case when engagement_signals > 0 then {rnd('complete_signals / engagement_signals', 4)} end as v4 from outs""",
    "hasses": """select *, case when v1 >= 65 then 'strong' when v1 >= 45 then 'moderate' when v1 is not null then 'weak' end as a1,
          case when v2 <= 0.15 then 'strong' when v2 <= 0.35 then 'moderate' when v2 is not null then 'weak' end as a2,
          case when v3 >= 60 then 'strong' when v3 >= 45 then 'moderate' when v3 is not null then 'weak' end as a3,
          case when v4 >= 0.6 then 'strong' when v4 >= 0.3 then 'moderate' when v4 is not null then 'weak' end as a4 from hvals""",
    "hpoints": f"""select *, case when n > 0 then {rnd('pts / n', 4)} end as score_points from (select *, ((v1 is not null)::int + (v2 is not null)::int + (v3 is not null)::int + (v4 is not null)::int)::bigint as n,
          len(list_filter([a1, a2, a3, a4], lambda a: a = 'strong')) * 2 + len(list_filter([a1, a2, a3, a4], lambda a: a = 'moderate')) as pts from hasses)""",
    "health": """select run_id, v1 as sentiment_score_value, v2 as negative_ratio_value, v3 as trend_score_value, v4 as engagement_coverage_value,
          a1 as sentiment_score_assessment, a2 as negative_ratio_assessment, a3 as trend_score_assessment, a4 as engagement_coverage_assessment,
          n as available_indicator_count, score_points, case when n >= 3 then 'high' when n = 2 then 'moderate' when n = 1 then 'low' end as confidence,
          case when n > 0 then 'assessed' else 'insufficient_data' end as status, category,
          case when n = 0 then 'No analytical indicator was available; community health could not be assessed.' else array_to_string(list_filter([
            'Community classified as ''' || category || ''' from ' || n || ' available indicator(s) with ' || case when n >= 3 then 'high' when n = 2 then 'moderate' else 'low' end || ' confidence.',
            'sentiment_score=' || v1 || ' (' || a1 || ')', 'negative_ratio=' || v2 || ' (' || a2 || ')', 'trend_score=' || v3 || ' (' || a3 || ')', 'engagement_coverage=' || v4 || ' (' || a4 || ')',
            case when n < 4 then 'Excluded unavailable indicators: ' || array_to_string(list_filter([case when v1 is null then 'sentiment_score' end, case when v2 is null then 'negative_ratio' end,
              case when v3 is null then 'trend_score' end, case when v4 is null then 'engagement_coverage' end], lambda x: x is not null), ', ') || '.' end], lambda x: x is not null), ' ') end as rationale
        from (select *, case when score_points is null then null when score_points >= 1.75 then 'thriving' when score_points >= 1.25 then 'healthy' when score_points >= 0.75 then 'stable'
          when score_points >= 0.25 then 'at_risk' else 'critical' end as category from hpoints)""",
    "quoted": """select run_id, list(keyword order by rank) as ks, list(frequency order by rank) as fs,
          case when length('Discussion centres on ' || any_value(keyword) filter (rank = 1) || '.') > 96 then 0
            when length('Discussion centres on ' || any_value(keyword) filter (rank = 1) || ', ' || any_value(keyword) filter (rank = 2) || '.') > 96 or count(*) < 2 then 1
            when length('Discussion centres on ' || string_agg(keyword, ', ' order by rank) || '.') > 96 or count(*) < 3 then 2 else 3 end as nq
        from kranked where rank <= 3 group by 1""",
    "found": f"""select run_id, 1 as ordinal, 'sentiment' as category, 'Overall sentiment is ' || {label(rnd('average_score', 2))} || ' (average score ' || format('{{:.1f}}', {rnd('average_score', 2)}) || '/100).' as statement,
          'sentiment.average_score=' || {rnd('average_score', 2)} || '; sentiment.distribution positive/neutral/negative=' || positive_count || '/' || neutral_count || '/' || negative_count as evidence, 'sentiment' as source_module
        from outs where average_score is not null
        union all select run_id, 2, 'trend', 'Conversation momentum is ' || overall_momentum || ' (trend score ' || format('{{:.1f}}', {rnd('trend_score', 2)}) || '/100).',
          'trend.overall_momentum=' || overall_momentum || '; trend.trend_score=' || {rnd('trend_score', 2)}, 'trend' from outs where overall_momentum is not null
        union all select run_id, 3, 'engagement', 'Engagement covers ' || format('{{:,}}', engagement_signals) || case when interactions is null then ' signal(s); no interaction total was reported.'
            else ' signal(s) with ' || case when interactions >= 1000000 then format('{{:.2e}}', interactions) else format('{{:,}}', cast(format('{{:.0f}}', interactions) as bigint)) end || ' recorded interaction(s).' end,
          'engagement.summary.signal_count=' || engagement_signals || '; engagement.summary.interactions.value=' || coalesce(interactions::varchar, 'None'), 'engagement' from outs where engagement_signals > 0
        union all select run_id, 4, 'keywords', case when nq > 0 then 'Discussion centres on ' || array_to_string(ks[1:nq], ', ') || '.' else 'Keyword extraction surfaced ' || format('{{:,}}', total_unique_keywords) || ' distinct term(s).' end,
          case when nq > 0 then array_to_string(list_transform(ks[1:nq], lambda k, i: 'keywords.keywords[' || (i - 1) || '].keyword=' || k || ' (frequency=' || fs[i] || ')'), '; ')
            else 'keywords.total_unique_keywords=' || total_unique_keywords end, 'keywords' from outs join quoted using (run_id)
        union all select run_id, 5, 'vibe_score', 'Overall Vibe Score is ' || format('{{:.1f}}', vibe_score) || '/100 (' || label || ').', 'vibe_score.score=' || vibe_score || '; methodology_version=vibe-score-v1', 'vibe_check.scoring' from vibe where vibe_score is not null
        union all select run_id, 6, 'community_health', 'Community health is classified as ' || category || ' with ' || confidence || ' confidence.',
          'community_health.category=' || category || '; community_health.confidence=' || confidence || '; community_health.rationale=' || rationale, 'vibe_check.community_health' from health where category is not null""",
    "envelopes": """select run_id, 'sentiment' as module, status, coverage_status, applicable_count, processed_count, source_count, array_to_string(list_filter([
            case when applicable_count = 0 then 'NO_APPLICABLE_TEXT:0' end, case when applicable_count > 0 and processed_count = 0 then 'NO_VALID_TEXT:' || skipped_count end,
            case when invalid_text_count > 0 then 'INVALID_TEXT_SKIPPED:' || invalid_text_count end, case when unsupported_language_count > 0 then 'UNSUPPORTED_LANGUAGE_SKIPPED:' || unsupported_language_count end], lambda w: w is not null), '|') as warnings from sent
        union all select run_id, 'keywords', case when processed_signal_count > 0 then 'completed' else 'skipped' end, case when processed_signal_count = 0 then 'no_data' when skipped_signal_count > 0 then 'degraded' else 'complete' end,
          applicable_count, processed_signal_count, source_count, array_to_string(list_filter([case when applicable_count = 0 then 'NO_APPLICABLE_TEXT:0' end,
            case when applicable_count > 0 and processed_signal_count = 0 then 'NO_VALID_TEXT:' || skipped_signal_count end, case when invalid_text_count > 0 then 'INVALID_TEXT_SKIPPED:' || invalid_text_count end,
            case when unsupported_language_count > 0 then 'UNSUPPORTED_LANGUAGE_SKIPPED:' || unsupported_language_count end,
            case when skipped_signal_count - invalid_text_count - unsupported_language_count > 0 then 'NO_KEYWORDS_FOUND_SKIPPED:' || (skipped_signal_count - invalid_text_count - unsupported_language_count) end], lambda w: w is not null), '|') from ktotals
        union all select run_id, 'trend', status, coverage_status, applicable_count, case when status = 'completed' then applicable_count else 0 end, source_count, array_to_string(list_filter([
            case when applicable_count = 0 then 'NO_APPLICABLE_SIGNALS:0' end, case when applicable_count > 0 and status = 'skipped' then 'NO_METRICS:' || applicable_count end], lambda w: w is not null), '|') from tsum
        union all select run_id, 'engagement', status, coverage_status, applicable_count, processed_count, source_count, warnings from engmod""",
}

CTES |= {
    # records
    "hashed": "select doc_id as arrival, run_id, source as platform, language, raw_text, signal_type, external_item_id, sha256(concat_ws(':', source, module_run_id, external_item_id)) as content_hash from docs",
    "already": "select distinct content_hash from hashed join labels on doc_id = arrival where language <> 'en'",
    "judged": rf"""select arrival, run_id, platform, h.content_hash, length(cleaned) as n_clean, case
          when not regexp_matches(raw_text, '{NSP}') or external_item_id is null then 'empty_record'
          when pick > 1 then 'duplicate_batch' when a.content_hash is not null then 'duplicate_db'
          when signal_type <> 'serp_result' and regexp_matches(raw_text, '{BOTS}') then 'bot'
          when length(cleaned) < 10 or {SPAM} then 'spam' else 'retained' end as outcome
        from (select *, {clean('raw_text')} as cleaned, row_number() over (partition by content_hash, external_item_id is null order by arrival) as pick from hashed) h
        left join already a on a.content_hash = h.content_hash""",
    # evaluation
    "human": """select l.doc_id as example_id, d.run_id, d.language, d.raw_text as text, case when toxic = 1 then 'negative' when quality = 1 then 'positive' else 'neutral' end as human_label
        from labels l join docs d using (doc_id)""",
    "rated_human": scored_cte("human", "text"),
    "given": """select example_id, label as predicted_label, case when example_id % 3 = 0 then 'cache' when example_id % 3 = 1 then 'llm' else 'lexicon_fallback' end as route
        from rated_human where example_id % 7 <> 0""",
    "pairs": "select h.example_id, h.run_id, h.language, h.human_label, predicted_label, coalesce(route, 'missing') as route from human h left join given using (example_id)",
    "lmetrics": f"""select *, {rnd("case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end", 4)} as f1 from (
        select grp, label, {rnd("coalesce(hit / nullif(predicted, 0), 0.0)", 4)} as precision, {rnd("coalesce(hit / nullif(support, 0), 0.0)", 4)} as recall, support from (
          select grp, label, count(*) filter (human_label = label and predicted_label = label) as hit, count(*) filter (predicted_label = label) as predicted,
            count(*) filter (human_label = label) as support from gpairs, (values ('positive'), ('neutral'), ('negative')) v(label) group by 1, 2))""",
    # model sentiment
    "inputs": f"""select s.signal_id, s.run_id, s.signal_no, c.language, c.label, c.score, c.confidence, {strip('c.cleaned_text')} as llm_text,
          false as is_truncated, r.keyword from classified c join sealed s using (signal_id) join runs r on r.run_id = s.run_id where text_status = 'processed'""",
    "keyed": f"""select *, sha256('{{"input_hash":"' || sha256({strip('llm_text')}) || '","keyword_hash":"' || sha256(keyword) || '","language":"' || coalesce(language, '')
          || '","model":"model-a","prompt_hash":"abc","prompt_version":"v1","provider":"demo","response_schema_version":"1.0"}}') as cache_key from inputs""",
    "cached": "select distinct cache_key from keyed join labels on doc_id = signal_id",
    "pend": """select *, (row_number() over (partition by run_id order by signal_no) - 1) // 20 as batch_no from (
        select run_id, cache_key, min(signal_no) as signal_no, arg_min(llm_text, signal_no) as llm_text from keyed where cache_key not in (select cache_key from cached) group by 1, 2)""",
    "batch": "select run_id, batch_no, sum(length(llm_text))::bigint as size, count(*) as n, sum(length(llm_text)) % 11 = 0 as failed from pend group by 1, 2",
    "firstfail": "select run_id, min(batch_no) filter (failed) as bad from batch group by 1",
    "answer": "select p.run_id, p.cache_key, length(llm_text) % 3 as kind, (bad is null or batch_no < bad) as ok from pend p join firstfail using (run_id)",
    "hitems": """select k.run_id, k.signal_id, is_truncated, case when c.cache_key is not null then 'cache' when a.ok then 'llm' else 'lexicon_fallback' end as route,
          case when c.cache_key is not null then 'positive' when a.ok then case kind when 0 then 'negative' when 1 then 'neutral' else 'positive' end else label end as label,
          case when c.cache_key is not null then 75.0 when a.ok then case kind when 0 then 10.0 when 1 then 50.0 else 90.0 end else score end as score,
          case when c.cache_key is not null then 0.8 when a.ok then 0.9 else confidence end as confidence,
          case when c.cache_key is null and not a.ok then 'PROVIDER_RATE_LIMITED' end as fallback_code
        from keyed k left join cached c on c.cache_key = k.cache_key left join answer a on a.run_id = k.run_id and a.cache_key = k.cache_key""",
    # collaboration fit
    "fitted": f"""select *, greatest(0.0, least(100.0, 40.0 * overlap + 40.0 * alignment + 20.0 * (case when overall_momentum = 'rising' then 1.0 else 0.5 end) - 10.0 * len(risks))) as fit from (
        select *, greatest(0.0, least(1.0, 0.7 * (average_score / 100.0) + least(0.3, coalesce(hits, 0) * 0.1::double)::double)) as overlap,
          greatest(0.0, least(1.0, 0.5::double + (case when list_has_any(bw, [lower(p_type)]) or len(list_filter(bw, lambda w: contains(w, lower(p_type)))) > 0 then 0.15::double else 0.0 end)
            + least(0.3::double, len(list_intersect(cw, bw)) * 0.05::double) + (case overall_momentum when 'rising' then 0.1::double when 'fading' then -0.1::double else 0.0 end))) as alignment,
          list_filter([case when average_score < 45 then 'Candidate exhibits low general audience sentiment.' end, case when overall_momentum = 'fading' then 'Candidate interest trend momentum is declining.' end,
            case when list_has_any(cw, [{text_list(L.RISK_TERMS)}]) or coalesce(risky, false) then 'Potential risk keyword detected in candidate profiles or tags.' end], lambda x: x is not null) as risks
        from (select p.p_partkey, 'src' || (p_partkey % 20) as run_id, p_type, n.signal_count, s.average_score, t.overall_momentum, hits, risky, bw,
            list_distinct(list_filter(regexp_extract_all(lower(p_name || case when p_size % 4 = 0 then ' can crash ' else ' is steady ' end || p_type), '[{W}_]+'), lambda w: w not in ({text_list(L.FIT_STOP_WORDS)}))) as cw
          from part p join (select run_id, count(*) as signal_count from ds group by 1) n on n.run_id = 'src' || (p_partkey % 20)
          left join sent s on s.run_id = n.run_id left join tsum t on t.run_id = n.run_id
          left join (select run_id, count(*) filter (lower(keyword) in ('readers', 'onanan', 'hestha', 'erin', 'stories', 'all')) as hits,
            bool_or(lower(keyword) in ({text_list(L.RISK_TERMS)})) as risky from ktable group by 1) k on k.run_id = n.run_id,
          (select list_distinct(list_filter(regexp_extract_all(lower('Economy goods with a small ' || p_name), '[{W}_]+'), lambda w: w not in ({text_list(L.FIT_STOP_WORDS)}))) as bw from part order by p_partkey limit 1)))""",
    "evaluated": f"""select 'sel-' || p_partkey as selection_id, run_id, p_partkey as candidate_id, case when known then 'analyzed' else 'insufficient_data' end as status,
          case when known then {rnd('fit', 2)} end as collaboration_score, case when known then {rnd('overlap', 4)} end as audience_overlap, case when known then {rnd('alignment', 4)} end as value_alignment,
          case when known then array_to_string(risks, '|') else '' end as risk_signals,
          case when not known then null when fit >= 70 then 'Highly Recommended' when fit >= 45 then 'Proceed with Caution' else 'Not Recommended' end as recommendation,
          case when not known then '' else coalesce(nullif(array_to_string(list_filter([case when overlap >= 0.7 then 'High target audience demographic alignment.' end, case when alignment >= 0.7 then 'Strong brand identity and value positioning fit.' end,
            case when overall_momentum = 'rising' then 'Positive momentum and rising consumer interest.' end, case when average_score >= 60 then 'Healthy positive sentiment baseline.' end], lambda x: x is not null), '|'), ''), 'General thematic resonance.') end as strengths,
          case when not known then '' else coalesce(nullif(array_to_string(list_filter([case when overlap < 0.4 then 'Limited target audience overlap observed.' end, case when alignment < 0.4 then 'Weak brand positioning or category alignment.' end,
            case when overall_momentum = 'fading' then 'Fading brand relevance and audience interest.' end, case when len(risks) > 0 then 'Presence of active community risk signals.' end], lambda x: x is not null), '|'), ''), 'No critical concerns detected.') end as weaknesses
        from (select *, signal_count >= 5 and average_score is not null and overall_momentum is not null as known from fitted)""",
    # payloads
    "lines": "select doc_id, unnest(string_split(raw_text, chr(10))) as line, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 as i from docs",
    "videos": f"""select *, {redact(strip('line'), ('thon',))} as title, {redact(strip("'By thon: ' || line"), ('thon',))} as content from lines where regexp_matches(line, '{NSP}') and i % 7 <> 6""",
    "hits": f"""select page_id, unnest(ls) as link, generate_subscripts(ls, 1) - 1 as i from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as ls from pages)""",
    "found_hits": f"""select *, 'serpex:' || sha256('the eriner' || chr(0) || engine || chr(0) || canonical) as external_item_id from (
        select page_id, i, link, case when i % 2 = 0 then 'web' else 'unknown' end as engine, lower(regexp_extract({strip("'HTTPS://Example.org' || link || '#top'")}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' ||
          lower(regexp_extract('HTTPS://Example.org' || link, '://([^/?#]*)', 1)) || coalesce(nullif(regexp_extract('HTTPS://Example.org' || link, '://[^/?#]*([^?#]*)', 1), ''), '/') ||
          case when regexp_extract('HTTPS://Example.org' || link, '^[^?#]*\\?([^#]*)', 1) <> '' then '?' || regexp_extract('HTTPS://Example.org' || link, '^[^?#]*\\?([^#]*)', 1) else '' end as canonical
        from hits where i % 9 >= 1)""",
    "kept_hits": """select * from (select *, row_number() over (partition by page_id order by i) as pos from (
        select * from (select *, row_number() over (partition by page_id, external_item_id order by i) as copy from found_hits) where copy = 1)) where pos <= 10""",
    "issues": f"""select doc_id, title, content, case when title = '' then content when content = '' then title else title || chr(10) || chr(10) || content end as raw from (
        select doc_id, {clean(redact(strip('string_split(raw_text, chr(10))[1]'), ('thon', 'erin')))} as title, {clean(redact(strip('raw_text'), ('thon', 'erin')))} as content
        from docs where regexp_matches(string_split(raw_text, chr(10))[1], '{NSP}'))""",
    "delivered": f"""select *, {redact('raw')} as raw_text from (
        select 'run' || doc_id % 20 as run_id, 'youtube' as source, doc_id || '-' || i as external_item_id, title || chr(10) || chr(10) || content as raw,
          (i * 10 + 1)::double as views, case when i % 3 <> 0 then i end::double as likes, case when i % 2 = 0 then i end::double as comments, true as dated,
          'https://www.youtube.com/watch?v=' || doc_id || '-' || i as shown_url from videos
        union all select 'run' || doc_id % 20, 'github', doc_id::varchar, raw, null, null, case when doc_id % 3 <> 0 then doc_id % 5 end::double, true,
          'https://github.com/redacted/repo/issues/' || doc_id from issues
        union all select 'run' || page_id % 20 as run_id, 'serpex', external_item_id,
          arg_min('Hit ' || link || chr(10) || chr(10) || 'about it', 'serpex/' || page_id || '/' || i), null, null, null, false,
          arg_min('HTTPS://Example.org' || link || '#top', 'serpex/' || page_id || '/' || i) from kept_hits group by run_id, external_item_id)""",
    "bsignals": f"select *, (length(cleaned_text) < 10 or {SPAM}) as spam_flag from (select *, {clean('raw_text')} as cleaned_text from delivered)",
    "bscored": scored_cte("(select * from bsignals where not spam_flag)", "cleaned_text"),
    "baspects": "select run_id, source, unnest(list_filter(["
    + ", ".join(
        f"case when {' or '.join(f'contains(lower(cleaned_text), {chr(39)}{t}{chr(39)})' for t in terms)} then '{name}' end" for name, terms in A.ASPECTS.items()
    )
    + "], lambda a: a is not null)) as aspect from bsignals where not spam_flag",
    "brecs": """select *, coalesce(likes, comments) is not null as has_i, case when coalesce(likes, comments) is not null then coalesce(likes, 0) + coalesce(comments, 0) end as interactions,
          (views is not null)::int + (likes is not null)::int + (comments is not null)::int as present
        from bsignals where not spam_flag and coalesce(views, likes, comments) is not null""",
    "links": "select page_id, case page_id % 3 when 0 then upper(substr(url, 1, 9)) || substr(url, 10) when 1 then replace(url, 'http', 'ftp') else url end as u from pages",
    "requests": "select d.doc_id, run_id, language as stage, quality as revision, toxic, md5(raw_text) as input_fingerprint from labels l join docs d using (doc_id)",
    "cells": "select run_id, source, language, count(*) as n from docs group by all",
    "lcells": "select run_id, source, language, count(*) as n from docs join labels using (doc_id) group by all",
}

TS = "'%Y-%m-%d %H:%M:%S'"
DAY = "'%Y-%m-%d'"

QUERIES: dict[str, str] = {
    "src1_join1_run_signals": "select m.run_id, s.module_run_id, m.module_type, s.signal_id, s.signal_type, length(raw_text) as n_chars from signals s join module_runs m using (module_run_id)",
    "src2_eligible_metrics": f"select signal_id, name, value, strftime(recorded_at, {TS}) as recorded_at, unit from metrics where signal_id in (select signal_id from ds)",
    "src3_video_records": """select doc_id as request_id, doc_id || '-' || i as external_item_id, title, md5(content) as content_md5, md5(title || chr(10) || chr(10) || content) as raw_md5,
        '2024-01-02T03:04:05Z' as published_at, (i * 10 + 1)::bigint as views, case when i % 3 <> 0 then i end::bigint as likes, case when i % 2 = 0 then i end::bigint as comments,
        'https://www.youtube.com/watch?v=' || doc_id || '-' || i as url from videos""",
    "src4_unique_video_ids": "select doc_id as request_id, w as video_id, min(i) as first_no from (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from (select doc_id, regexp_extract_all(raw_text, '[a-z]+') as ws from docs)) group by 1, 2",
    "src5_issue_records": f"""select doc_id::varchar as external_item_id, title, md5(content) as content_md5, md5(case when title = '' then content when content = '' then title else title || chr(10) || chr(10) || content end) as raw_md5,
        case when doc_id % 3 <> 0 then doc_id % 5 end as comments, 'https://github.com/redacted/repo/issues/' || doc_id as url from (
        select doc_id, {clean(redact(strip('string_split(raw_text, chr(10))[1]'), ('thon', 'erin')))} as title, {clean(redact(strip('raw_text'), ('thon', 'erin')))} as content
        from docs where regexp_matches(string_split(raw_text, chr(10))[1], '{NSP}'))""",
    "src6_prj12_search_records": "select page_id as request_id, i as item_no, external_item_id, 'Hit ' || link as title, 'about it' as content, 'HTTPS://Example.org' || link || '#top' as url, '2024-01-31T00:00:00Z' as observed_at from kept_hits",
    "src7_set7_labelled_examples": f"""select 'invalid_example' as problem, count(*) as n from human where not (language in ({text_list(A.LANGUAGES)}) and regexp_matches(text, '{NSP}'))
        union all select 'duplicate_example_id', 0 union all select 'duplicate_content', coalesce(sum(n - 1), 0)::bigint from (
        select count(*) as n from human join runs using (run_id) where language in ({text_list(A.LANGUAGES)}) group by lower({strip('keyword')}), language, replace(lower(trim(regexp_replace(text, '{SP}+', ' ', 'g'))), 'ß', 'ss'))""",
    "src7_parsed_examples": f"""select 'doc-' || example_id as example_id, nullif({strip('keyword')}, '') as keyword, language, md5(nullif({strip('text')}, '')) as text_md5, human_label,
        language in ({text_list(A.LANGUAGES)}) and regexp_matches(text, '{NSP}') as is_valid from human join runs using (run_id)""",
    "udf4_predictor_reports": """select 'lexicon' as classifier_name, 'v1' as classifier_version, language, human_label as actual_label, count(*) filter (label = 'positive') as positive, count(*) filter (label = 'neutral') as neutral,
          count(*) filter (label = 'negative') as negative, count(*) filter (label is null) as missing from rated_human group by language, human_label
        union all select 'lead-words', 'v1', language, human_label, count(*) filter (p = 'positive'), count(*) filter (p = 'neutral'), count(*) filter (p = 'negative'), count(*) filter (p is null) from (
          select *, case when language = 'de' then null when contains(lower(left(text, 60)), 'de') then 'negative' when contains(lower(left(text, 60)), 'th') then 'positive' else 'neutral' end as p from human)
        group by language, human_label""",
    "src8_manifests": "select 'v' || quality as dataset_version, (quality + 1)::bigint as reviewer_count, quality >= 1 as is_valid, quality >= 1 and count(*) > 1 as verified from labels group by quality",
    "src9_lim1_signal_page": f"""select run_id, rn as row_number, total_count, signal_id, strftime(published_at, {TS}) as published_at, v.v as views, l.v as likes, c.v as comments from (
        select *, row_number() over (partition by run_id order by published_at desc nulls last, signal_id) as rn, count(*) over (partition by run_id) as total_count from signals)
        left join (select signal_id, max(struct_pack(a := recorded_at, v := value)) filter (name = 'views') as v, max(struct_pack(a := recorded_at, v := value)) filter (name = 'likes') as l,
          max(struct_pack(a := recorded_at, v := value)) filter (name = 'comments') as c from metrics group by 1) using (signal_id) where rn between 6 and 15""",
    "src9_lim1_deep_page": f"""select 'all' as run_id, rn as row_number, total_count, signal_id, strftime(published_at, {TS}) as published_at, v.v as views, l.v as likes, c.v as comments from (
        select *, row_number() over (order by published_at desc nulls last, signal_id) as rn, count(*) over () as total_count from signals)
        left join (select signal_id, max(struct_pack(a := recorded_at, v := value)) filter (name = 'views') as v, max(struct_pack(a := recorded_at, v := value)) filter (name = 'likes') as l,
          max(struct_pack(a := recorded_at, v := value)) filter (name = 'comments') as c from metrics group by 1) using (signal_id) where rn between 801 and 900""",
    "src9_stored_page": f"""select run_id, rn as row_number, total_count, signal_id, case when dated then '2024-01-02 03:04:05' end as published_at, views, likes, comments, shown_url as url, md5(raw_text) as raw_md5 from (
        select *, row_number() over (partition by run_id order by dated desc, signal_id) as rn, count(*) over (partition by run_id) as total_count from (
          select *, sha256(source || ':' || run_id || '-' || source || ':' || external_item_id) as signal_id from bsignals)) where rn between 41 and 65""",
    "prj1_clean_text": f"select doc_id, {clean('raw_text')} as cleaned_text from docs",
    "flt1_flt2_flt3_record_flags": f"""select doc_id, length(cleaned) < 10 or {SPAM} as is_spam, signal_type <> 'serp_result' and regexp_matches(raw_text, '{BOTS}') as is_bot,
        not regexp_matches(raw_text, '{NSP}') or external_item_id is null as is_empty from (select *, {clean('raw_text')} as cleaned from docs)""",
    "flt4_valid_records": f"""select doc_id, external_item_id, source, {clean('title')} as title, {clean('content')} as content, {clean('raw_text')} as raw_text from (
        select *, string_split(raw_text, chr(10))[1] as title, string_split(raw_text, chr(10))[2] as content from docs)
        where external_item_id is not null and (regexp_matches(coalesce(title, ''), '{NSP}') or regexp_matches(coalesce(content, ''), '{NSP}'))""",
    "flt5_win9_join7_exclusion_outcomes": "select arrival, run_id, content_hash, outcome, n_clean from judged",
    "flt5_filter_audits": """select run_id, arrival, case when outcome = 'empty_record' then sha256(platform || ':empty:' || arrival) else content_hash end as signal_hash, outcome = 'retained' as retained_flag,
        case when outcome <> 'retained' then outcome end as exclusion_reason from judged""",
    "agg22_filter_summary": """select run_id, count(*) as total_checked_count, count(*) filter (outcome = 'retained') as retained_count, count(*) filter (outcome = 'spam') as spam_count,
        count(*) filter (outcome = 'bot') as bot_count, count(*) filter (outcome like 'duplicate%') as duplicate_count, count(*) filter (outcome = 'empty_record') as low_quality_count,
        count(*) filter (outcome <> 'retained') / count(*) as exclusion_rate from judged group by 1""",
    "join2_retained_signals": "select arrival, run_id, content_hash from hashed where content_hash in (select content_hash from judged where outcome = 'retained')",
    "prj2_redacted_text": f"select doc_id, {redact('raw_text')} as redacted from docs",
    "flt6_supported_languages": f"select doc_id, doc_id % 4 in (2, 3) or language in ({text_list(A.LANGUAGES)}) as is_supported from docs",
    "prj3_prj4_sanitized_records": f"""select doc_id, first as title, md5({redact('raw_text', ('Thon', 'erin', 'eriner', 'ouiae'))}) as raw_md5, 'https://example.org/redacted/x' as url, null::varchar as channel_id,
        '{{"title":' || to_json(first) || ',"details":{{"inner":{{"note":' || to_json(first) || '}},"n":3}},"list":[' || to_json(first) || ',"redacted"]}}' as platform_metadata
        from (select *, {redact('string_split(raw_text, chr(10))[1]', ('Thon', 'erin', 'eriner', 'ouiae'))} as first from docs)""",
    "prj5_modalities": "select signal_id, array_to_string(modalities, '|') as modalities from signals",
    "flt7_set2_modality_views": "select signal_id, run_id from signals where list_has_any(modalities, ['engagement', 'search_intent'])",
    "prj6_normalized_tags": f"select signal_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(tags, lambda t: {strip('t')}), lambda t: t <> ''))), '|') as tags from signals",
    "flt8_in_timeframe": f"select run_id, signal_id, strftime(published_at, {TS}) as published_at from signals join runs using (run_id) where published_at >= timeframe_start and published_at < timeframe_end",
    "flt9_recent_window": f"select o_orderkey, strftime(o_orderdate::date + 1 - interval 30 day, {TS}) as window_start, strftime((o_orderdate::date + 1)::timestamp, {TS}) as window_end from orders",
    "prj7_timestamps": f"""select event_id, case when event_id % 5 = 4 then null else strftime(t, {TS}) end as kept_missing, strftime(t, {TS}) as always_set from (
        select event_id, case event_id % 5 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) - interval 7 hour when 2 then date_trunc('second', ts) else timestamp '2024-02-01 00:00:00' end as t from events)""",
    "prj8_canonical_metrics": f"select signal_id, name, coalesce(counter, 'unsupported') as counter, value, strftime(recorded_at, {TS}) as recorded_at from observed",
    "prj9_country_codes": f"select signal_id, case when length(upper({strip('country_code')})) >= 2 then upper({strip('country_code')}) end as country_code from signals",
    "prj10_content_hashes": "select arrival, content_hash from hashed",
    "prj11_canonical_urls": r"""select page_id, case when lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) in ('http', 'https') then lower(regexp_extract(u, '^([A-Za-z]+://[^/?#]*)', 1)) ||
        coalesce(nullif(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') || case when regexp_extract(u, '^[^?#]*\?([^#]*)', 1) <> '' then '?' || regexp_extract(u, '^[^?#]*\?([^#]*)', 1) else '' end end as canonical_url from links""",
    "prj13_prj14_model_inputs": "select signal_id, md5(llm_text) as text_md5, is_truncated, cache_key from keyed",
    "prj16_first_snippets": f"select run_id, n as snippet_no, signal_id from (select run_id, signal_id, row_number() over (partition by run_id order by signal_no) as n from sealed where regexp_matches(cleaned_text, '{NSP}')) where n <= 15",
    "flt10_flt11_run_lists": "select run_id, keyword, 'u4' as created_by from runs where length(run_id) = 4 and contains(lower(keyword), 'eriner')",
    "join3_signals_with_metrics": f"select s.signal_id, run_id, name, value, strftime(recorded_at, {TS}) as recorded_at from signals s left join metrics m on m.signal_id = s.signal_id",
    "join11_signals_of_runs": "select run_id, count(*) as n from signals where module_run_id in (select module_run_id from module_runs where status = 'completed') group by 1",
    "join14_identity_check": "select run_id, array_to_string(list_filter([case when length(run_id) <> 4 then 'snapshot_id' end, case when run_id = 'src1' then 'input_fingerprint' end], lambda x: x is not null), '|') as mismatched_fields from runs",
    "scl1_scl2_sentiment_items": "select * from items",
    "agg1_sentiment_summary": f"""select sent.* , {label('average_score')} as overall_label, warnings from sent join (select run_id, warnings from envelopes where module = 'sentiment') using (run_id)""",
    "scl3_aspect_mentions": "select * from aspects",
    "agg3_topk2_aspect_rollup": f"""select * from (select run_id, aspect, count(*) as mention_count, {rnd('sum(score::decimal(38,6))::double / count(*)', 2)} as avg_score,
        row_number() over (partition by run_id order by count(*) desc, aspect) as rank from aspects group by 1, 2) where rank <= 5""",
    "agg2_source_sentiment": """select e.run_id, e.source, e.n as signal_count, coalesce(ws, 50.0) as weighted_score, coalesce(wc, 0.5) as avg_confidence, coalesce(pp, 0.0) as positive_pct, coalesce(np, 0.0) as neutral_pct,
        coalesce(gp, 0.0) as negative_pct, top_aspects from (select run_id, source, count(*) filter (not spam_flag) as n from signals group by 1, 2) e
        left join (select run_id, source, sum(score::decimal(38,6))::double / count(*) as ws, sum(coalesce(confidence, 0)::decimal(38,8))::double / count(*) as wc, count(*) filter (label = 'positive') / count(*) * 100.0 as pp,
          count(*) filter (label = 'neutral') / count(*) * 100.0 as np, count(*) filter (label = 'negative') / count(*) * 100.0 as gp from scored group by 1, 2) s on s.run_id = e.run_id and s.source = e.source
        left join (select run_id, source, string_agg(aspect || ':' || n, '|' order by n desc, aspect) as top_aspects from (select run_id, source, aspect, count(*) as n from aspects group by 1, 2, 3) group by 1, 2) a on a.run_id = e.run_id and a.source = e.source""",
    "agg25_join4_daily_sentiment": f"select run_id, strftime(published_at, {DAY}) as day, count(*) as volume, {rnd('sum(coalesce(score, 50.0)::decimal(38,6))::double / count(*)', 1)} as sentiment from scored where published_at is not null group by 1, 2",
    "scl4_win11_terms": "select gid as signal_id, count(*) as n_terms, count(distinct term) as n_distinct, max(term) as last_term from pterms group by 1",
    "scl5_normalized_keys": f"select doc_id, md5({key('raw_text')}) as key_md5 from docs",
    "agg4_keywords": "select run_id, canonical_form, keyword, frequency, sources from ktable join (select run_id, strip_accents(lower(term)) as canonical_form, string_agg(distinct source, '|' order by source) as sources from kmentions group by 1, 2) using (run_id, canonical_form)",
    "win6_keyword_ranks": "select run_id, rank, keyword, frequency from kranked",
    "agg6_keyword_totals": """select t.*, t.skipped_signal_count - invalid_text_count - unsupported_language_count as no_keywords_count, e.status, e.coverage_status,
        case when t.applicable_count > 0 then processed_signal_count / t.applicable_count else 0.0 end as coverage, warnings from ktotals t join (select * from envelopes where module = 'keywords') e using (run_id)""",
    "agg5_topk3_merged_keywords": "select run_id, rank, keyword, count from mranked where rank <= 30",
    "prj15_keyword_exclusion": f"""select run_id, term, n from (select run_id, term, count(*) as n from pterms t join ds s on s.signal_id = t.gid group by 1, 2) join run_keys using (run_id)
        where not list_contains(keys, {key('term')})""",
    "scl17_keyword_match_scores": """select m.run_id, rank, keyword, upper(keyword[1]) || keyword[2:] || ' Topic Crossover' as name, least(99, greatest(40, 65 + least(25, count * 2)
        + case when coalesce(average_score, 50.0) > 60 then 10 when coalesce(average_score, 50.0) < 40 then -10 else 0 end - (rank - 1) * 5))::bigint as match_score
        from mranked m left join sent using (run_id) where rank <= 4""",
    "snk7_keyword_export": "select row_number() over (partition by run_id order by count desc, keyword) as \"Rank\", keyword as \"Keyword\", count as \"Count\", run_id from merged where count > 9",
    "win1_latest_counters": f"select signal_id, v.v as views, l.v as likes, c.v as comments, strftime(latest_metric_at, {TS}) as latest_metric_at, unsupported_count, invalid_count, duplicate_count from latest",
    "win1b_conflict_counts": "select * from conflicts",
    "scl7_scl8_engagement_records": f"""select run_id, signal_id, source, strftime(ranking_at, {TS}) as ranking_at, views, likes, comments, interactions, like_rate, comment_rate, engagement_rate,
        {rnd('present / 3', 4)} as metric_completeness, present < 3 as is_partial from rated""",
    "agg7_agg8_agg9_agg10_engagement_summary": "select * from eng",
    "agg11_observation_quality": "select run_id, unsupported_observation_count, invalid_observation_count, duplicate_observation_count, conflicting_observation_count, skipped_signal_count from quality",
    "win3_win4_srt2_ranked_records": """select run_id, signal_id, interactions, engagement_rate,
        case when interactions is not null then row_number() over (partition by run_id order by interactions desc nulls last, engagement_rate desc nulls last, ranking_at desc, signal_id) end as interaction_rank,
        case when engagement_rate is not null then row_number() over (partition by run_id order by engagement_rate desc nulls last, interactions desc nulls last, ranking_at desc, signal_id) end as engagement_rate_rank from rated where present > 0""",
    "agg35_engagement_warnings": "select run_id, status, coverage_status, coverage, warnings from engmod",
    "agg12_win2_set3_scl6_trend_metrics": "select * from tmetrics",
    "agg13_period_counts": "select * from periods",
    "agg14_trend_summary": "select * exclude (source_count) from tsum",
    "agg19_join12_daily_volume": f"select run_id, source, strftime(day, {DAY}) as day, volume, engagement from daily",
    "agg20_scl19_velocity": f"""select run_id, source, {rnd('greatest(0.0, least(10.0, 5.0 + (case when a > 0 then s / a else 0.0 end) * 10.0))', 4)} as velocity_score, {rnd('s', 4)} as velocity_slope,
        case when s > 0.05 then 'up' when s < -0.05 then 'down' else 'stable' end as velocity_direction, case when a = 0 or sp = 0 then 0.0 else {rnd('r', 4)} end as velocity_r2,
        case when a > 5 then 'high' when a > 1 then 'medium' else 'low' end as signal_strength, {rnd('a', 2)} as avg_daily_volume
        from (select run_id, source, regr_slope(volume, day_no) as s, regr_r2(volume, day_no) as r, avg(volume) as a, var_pop(volume) as sp from daily group by 1, 2)""",
    "agg21_hype_scores": """select *, least(10.0, volume_count * 0.5 + engagement_volume * 0.001)::double as hype_score from (select run_id, source, count(*) as volume_count, sum(engagement)::double as engagement_volume
        from ds left join sums using (signal_id) group by 1, 2) where engagement_volume is not null""",
    "topk1_trending_titles": "select run_id, source, title, rank from (select run_id, source, string_split(raw_text, chr(10))[1] as title, row_number() over (partition by run_id, source order by signal_no) as rank from sealed where string_split(raw_text, chr(10))[1] <> '') where rank <= 5",
    "agg15_win5_win7_join5_regions": "select * from regions",
    "agg16_geo_summary": """select run_id, case region_count when 0 then 'insufficient_geo_data' when 1 then 'single_region' else 'compared' end as status, region_count, located as located_signal_count,
        unlocated as unlocated_signal_count, case when region_count > 0 then global_avg end as global_sentiment_avg,
        case when region_count = 0 then 'none' when (modes > 0 and other = 0) or (modes = 0 and region_count = 1) then 'collector_region' else 'mixed' end as location_confidence from geo_run""",
    "set6_regional_terms": f"select distinct run_id, country_code, {strip('tag')} as term from (select run_id, country_code, unnest(tags) as tag from geo_in where country_code is not null) where {strip('tag')} <> ''",
    "agg17_win13_daily_series": f"select run_id, strftime(day, {DAY}) as day, signal_volume, interaction_volume from series",
    "agg18_baselines": "select run_id, metric_name, round(median, 3) as median, round(mad, 3) as mad, round(mean_deviation, 3) as mean_deviation, periods from base",
    "win12_scl9_scored_days": f"select run_id, metric_name, strftime(day, {DAY}) as day, value, deviation from scored_day",
    "scl9_scl10_srt3_scl20_alerts": f"""select run_id, metric_name, anomaly_type, observed_value, baseline_value, deviation_score, severity, strftime(day, {DAY}) as period_start, strftime(day + 1, {DAY}) as period_end,
        metric_name || ' observed ' || printf('%g', observed_value) || ' (' || printf('%g', deviation_score) || ' modified z-score ' || case anomaly_type when 'spike' then 'above' else 'below' end || ' the ' || printf('%g', baseline_value) || ' median baseline)' as probable_cause from alert""",
    "scl10_detection_summary": """select r.run_id, 'analyzed' as status, 30::bigint as periods_analyzed, false as timeframe_truncated, coalesce(m, '') as metrics_analyzed from runs r
        left join (select run_id, string_agg(metric_name, '|' order by metric_name desc) as m from base where periods >= 4 and total >= 3 group by 1) using (run_id)""",
    "scl9_alert_evidence": f"select a.run_id, strftime(a.day, {DAY}) as period_start, metric_name, signal_id from alert a join ds s on s.run_id = a.run_id and s.published_at::date = a.day",
    "agg23_agg26_filter_statistics": """select run_id, count(*) as collected_count, count(*) filter (not spam_flag) as eligible_count, count(*) filter (spam_flag) as excluded_count,
        count(*) filter (spam_flag) / count(*) as spam_exclusion_rate, case when count(*) filter (spam_flag) / count(*) > 0.3 then 1.0::double else 0.0::double end as severity_score from signals group by 1""",
    "agg24_source_coverage": "select m.run_id, module_type as collector, max(status) filter (true) as status, coalesce(sum(n), 0)::bigint as eligible_count from module_runs m left join (select module_run_id, count(*) as n from ds group by 1) using (module_run_id) group by 1, 2",
    "agg27_active_platforms": "select run_id, count(*) as source_count, string_agg(upper(module_type[1]) || module_type[2:], '|' order by module_type) as platforms from module_runs where status = 'completed' group by 1",
    "agg28_fingerprints": "select r.run_id, coalesce(s.n, 0) as signal_count, coalesce(m.n, 0)::bigint as observation_count, 'sha256:' || sha256(concat_ws('|', keyword, strftime(timeframe_start, '%Y-%m-%dT%H:%M:%S.%f'), strftime(timeframe_end, '%Y-%m-%dT%H:%M:%S.%f'), 'text-v1', 'analysis-v1', "
    + ", ".join(f"coalesce({t}.{c}, 0)::varchar" for t in "sm" for c in ("n", "s0", "s1", "s2", "s3"))
    + ")) as input_fingerprint from runs r left join (select run_id, count(*) as n, "
    + ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::bigint) as s{i}" for i in range(4))
    + f""" from (select run_id, sha256(concat_ws('|', 'sig', signal_id, coalesce(external_item_id, ''), source, signal_type, coalesce(language, ''), coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S.%f'), ''),
        strftime(collected_at, '%Y-%m-%dT%H:%M:%S.%f'), array_to_string(modalities, ','), trim(regexp_replace(cleaned_text, '{SP}+', ' ', 'g')))) as h from ds) group by 1) s using (run_id) left join (select run_id, count(*) as n, """
    + ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::bigint) as s{i}" for i in range(4))
    + """ from (select run_id, sha256(concat_ws('|', 'met', signal_id, name, (value + 0.0)::double::varchar, strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%f'))) as h
        from metrics join ds using (signal_id) where value is not null) group by 1) m using (run_id)""",
    "srt1_signal_order": "select signal_id, signal_no from sealed",
    "udf1_agg35_module_results": "select * from envelopes",
    "agg34_execution_manifest": """select run_id, count(*) filter (status = 'completed') as completed_count, count(*) filter (status = 'skipped') as skipped_count, count(*) filter (status = 'failed') as failed_count,
        case when count(*) filter (status = 'failed') > 0 then 'completed_with_failures' else 'completed' end as status from envelopes group by 1""",
    "join13_module_outputs": "select * from outs",
    "scl11_scl12_vibe_scores": "select * from vibe",
    "scl13_community_health": "select * from health",
    "scl14_topk4_insight_findings": "select * replace (ordinal::bigint as ordinal) from found",
    "scl14_insight_summaries": """select run_id, case when n > 0 then 'generated' else 'insufficient_data' end as status, summary, coalesce(cs, '') as contributing_modules,
        array_to_string(list_filter(['sentiment', 'trend', 'engagement', 'keywords', 'vibe_score', 'community_health'], lambda c: not coalesce(list_contains(cl, c), false)), '|') as unavailable_modules, length(summary) as character_count
        from runs left join (select run_id, count(*) as n, string_agg(statement, ' ' order by ordinal) as summary, string_agg(category, '|' order by ordinal) as cs, list(category) as cl from found group by 1) using (run_id)""",
    "scl15_set4_join8_collaboration_fit": "select * from evaluated",
    "join9_run_evaluations": """select run_id, row_number, selection_id, collaboration_score, total_count from (select *, row_number() over (partition by run_id order by collaboration_score desc nulls last, selection_id) as row_number,
        count(*) over (partition by run_id) as total_count from evaluated) where row_number <= 10""",
    "join10_matched_predictions": "select example_id, human_label, predicted_label, route from pairs",
    "set5_join10_prediction_problems": "select doc_id as example_id, 'unknown_example' as problem from documents where doc_id not in (select doc_id from labels) union all select example_id, 'duplicate_prediction' from given",
    "agg29_confusion_matrix": "select run_id, human_label as actual_label, count(*) filter (predicted_label = 'positive') as positive, count(*) filter (predicted_label = 'neutral') as neutral, count(*) filter (predicted_label = 'negative') as negative, count(*) filter (predicted_label is null) as missing from pairs group by 1, 2",
    "agg30_label_metrics": "select grp as run_id, label, precision, recall, f1, support from lmetrics",
    "agg30_macro_f1": f"select {rnd('sum(f1::decimal(20,4))::double / 3', 4)} as macro_f1 from lmetrics",
    "agg31_language_agreement": f"select language, count(*) as sample_count, count(*) filter (predicted_label = human_label) as correct_count, {rnd('count(*) filter (predicted_label = human_label) / count(*)', 4)} as agreement from pairs group by 1",
    "agg31_route_counts": "select route, count(*) as count from pairs group by 1",
    "agg31_agg32_evaluation_report": f"""select p.*, macro_f1, ok1 as meets_agreement_threshold, sample_count >= 100 as meets_minimum_sample_count, per_lang as meets_per_language_agreement, langs as has_required_languages,
          labs as has_required_labels, true as annotation_manifest_verified, correct_count * 4 >= sample_count * 3 and sample_count >= 500 and per_lang and labs and prediction_count = sample_count and full_llm as release_ready from (
        select run_id, count(*) as sample_count, count(predicted_label) as prediction_count, count(*) filter (predicted_label = human_label) as correct_count,
          {rnd('count(*) filter (predicted_label = human_label) / count(*)', 4)} as human_agreement, {rnd('count(predicted_label) / count(*)', 4)} as prediction_coverage,
          {rnd("count(*) filter (predicted_label is not null and route in ('llm', 'cache')) / count(*)", 4)} as llm_coverage from pairs group by 1) p
        join (select run_id, count(*) filter (predicted_label = human_label) * 4 >= count(*) as ok1, count(*) filter (predicted_label is not null and route in ('llm', 'cache')) = count(*) as full_llm,
          count(distinct human_label) = 3 as labs, {" and ".join(f"count(*) filter (language = '{x}') > 0" for x in A.LANGUAGES)} as langs,
          {" and ".join(f"(count(*) filter (language = '{x}') > 0 and count(*) filter (language = '{x}' and predicted_label = human_label) * 4 >= count(*) filter (language = '{x}') * 3)" for x in A.LANGUAGES)} as per_lang from pairs group by 1) q using (run_id)
        join (select grp as run_id, {rnd('sum(f1::decimal(20,4))::double / 3', 4)} as macro_f1 from lmetrics group by 1) using (run_id)""",
    "win14_udf2_udf5_join6_hybrid_items": "select run_id, signal_id, label, score::double as score, confidence::double as confidence, route, fallback_code from hitems",
    "agg33_inference_summary": """select r.*, coalesce(calls, 0) as provider_call_count, coalesce(it, 0) as input_tokens, coalesce(ot, 0) as output_tokens, coalesce(it, 0) + coalesce(ot, 0) as total_tokens,
        round((coalesce(it, 0) * 0.15::decimal(12,6) + coalesce(ot, 0) * 0.60::decimal(12,6))::decimal(30,6) * 0.000001::decimal(7,6), 6)::double as estimated_cost_usd from (
        select run_id, count(*) filter (route = 'llm') as llm_count, count(*) filter (route = 'cache') as cache_hit_count, count(*) filter (route = 'lexicon_fallback') as fallback_count, count(*) filter (is_truncated) as truncated_count,
          array_to_string(list_filter([case when bool_or(route = 'cache') then 'model-a-0' end, case when bool_or(route = 'llm') then 'model-a-1' end], lambda x: x is not null), '|') as actual_models from hitems group by 1) r
        left join (select run_id, count(*) as calls, sum(case when failed then 5 else size end)::bigint as it, sum(case when failed then 0 else n end)::bigint as ot from batch join firstfail using (run_id) where bad is null or batch_no <= bad group by 1) using (run_id)""",
    "snk1_appended_signals": "select arrival, run_id, language, content_hash from (select *, row_number() over (partition by content_hash order by (arrival in (select doc_id from labels)) desc, arrival) as pick from hashed) where pick = 1",
    "snk2_upserted_metrics": "select c.run_id, c.source, c.language, coalesce(l.n, c.n) as n, (case when l.n is null then 1 else 2 end)::bigint as version from cells c left join lcells l on l.run_id = c.run_id and l.source = c.source and l.language = c.language",
    "snk3_replaced_rows": """select run_id, source, language, n from cells where (run_id, source) not in (select run_id, source from docs join labels using (doc_id) where language <> 'en')
        union all select run_id, source, language, n from lcells where language <> 'en'""",
    "snk4_first_writers": "select doc_id, run_id, stage, revision::bigint as revision, toxic::bigint as toxic, input_fingerprint from (select *, row_number() over (partition by run_id, stage, revision order by toxic desc, doc_id) as pick from requests) where pick = 1",
    "snk4_conflicting_requests": "select doc_id, run_id, stage, revision::bigint as revision from (select *, first_value(input_fingerprint) over (partition by run_id, stage, revision order by doc_id) as f from requests) where f <> input_fingerprint",
    "snk5_priority_results": """select run_id, source, language, n, case pri when 0 then 'failed' when 1 then 'skipped' else 'completed' end as status from (select *, row_number() over (partition by run_id, source, language order by pri desc, new) as pick from (
        select *, n % 3 as pri, 0 as new from cells union all select *, n % 3, 1 from lcells)) where pick = 1""",
    "snk6_udf3_cache_entries": "select md5(raw_text) as cache_key, doc_id, length(raw_text) as n from (select *, row_number() over (partition by md5(raw_text) order by (doc_id in (select doc_id from labels)) desc, doc_id) as pick from docs) where pick = 1",
    "snk8_synchronized_sources": """select coalesce(o.id::varchar, sha256(p || ':' || s)) as source_id, p as platform, s as source_name, case when n then 'new' else 'old' end as category from (
        select coalesce(o.p, n.p) as p, coalesce(o.s, n.s) as s, n.p is not null as n, o.id from (select p_type as p, p_brand as s, min(p_partkey) as id from part group by 1, 2) o full join (
          select distinct p_type as p, p_name as s from part union select distinct p_type, p_brand from part where p_size = 1) n on n.p = o.p and n.s = o.s) o""",
    "win8_canonical_sources": "select l_orderkey, l_linenumber::bigint as l_linenumber, c as source_id from lineitem join (select p_partkey, min(p_partkey) over (partition by p_type, p_brand) as c from part) on p_partkey = l_partkey",
    "win10_latest_results": "select o_custkey as run_id, o_orderpriority as module, o_orderstatus as status, o_orderkey as execution_id from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) as pick from orders) where pick = 1",
    "set1_unified_records": """select 'youtube' as source, 'video' as signal_type, doc_id as request_id, i::bigint as item_no, doc_id || '-' || i as external_item_id, title, md5(content) as content_md5,
          md5(title || chr(10) || chr(10) || content) as raw_md5, '2024-01-02T03:04:05Z' as published_at, 'https://www.youtube.com/watch?v=' || doc_id || '-' || i as url, null::varchar as observed_at,
          (i * 10 + 1)::bigint as views, case when i % 3 <> 0 then i end::bigint as likes, case when i % 2 = 0 then i end::bigint as comments from videos
        union all select 'github', 'community', doc_id, 0, doc_id::varchar, title, md5(content), md5(raw), '2024-01-02T03:04:05Z', 'https://github.com/redacted/repo/issues/' || doc_id, null, null, null,
          case when doc_id % 3 <> 0 then doc_id % 5 end from issues
        union all select 'serpex', 'serp_result', page_id, i, external_item_id, 'Hit ' || link, md5('about it'), md5('Hit ' || link || chr(10) || chr(10) || 'about it'), null,
          'HTTPS://Example.org' || link || '#top', '2024-01-31T00:00:00Z', null, null, null from kept_hits""",
    "snk1_persisted_batches": f"""select * from (select run_id, source, count(*) as signals, count(*) filter (spam_flag) as spam, count(*) filter (dated) as dated from bsignals group by all)
        left join (select run_id, source, count(value) as metrics, sum(value) as metric_sum from (select run_id, source, unnest([views, likes, comments]) as value from bsignals) where value is not null group by all) using (run_id, source)
        left join (select run_id, source, count(*) as sentiments, count(*) filter (label = 'positive') as positive, count(*) filter (label = 'negative') as negative,
          sum(coalesce(score, 50.0)::decimal(38,4))::double as score_sum from bscored group by all) using (run_id, source)
        left join (select run_id, source, count(*) as aspects from baspects group by all) using (run_id, source)""",
    "snk1_agg7_stored_engagement": engagement_cte("brecs"),
    "snk3_emptied_keys": """select * from lcells where source = 'youtube'
        union all select c.* from cells c where not exists (select 1 from lcells g where g.run_id = c.run_id and g.source = c.source)""",
    "snk8_stored_sources": """with old as (select distinct p_type as platform, p_brand as source_name from part),
        new as (select distinct p_type as platform, p_name as source_name from part union select p_type, p_brand from part where p_size = 1)
        select sha256(platform || ':' || source_name) as source_id, platform, source_name, 'new' as category from new
        union all select sha256(platform || ':' || source_name), platform, source_name, 'old' from old where (platform, source_name) not in (select (platform, source_name) from new)""",
    "str1_str2_distinct_deliveries": f"""select distinct sha256(concat_ws(':', source, module_run_id, md5(raw_text))) as content_hash, run_id, signal_type <> 'serp_result' and regexp_matches(raw_text, '{BOTS}') as is_bot,
        length(cleaned) < 10 or {SPAM} as spam_flag from (select *, {clean('raw_text')} as cleaned from docs)""",
    "str3_str7_daily_buckets": f"select event_type as run_id, strftime(ts, {DAY}) as day, count(*) as signal_count, sum(round(value, 2)::decimal(38,6))::double as engagement from events group by 1, 2",
    "str5_sealed_days": f"""select case when event_id % 6 >= 4 and event_type not in (select event_type from events where event_type = 'view' and user_id % 3 = 0) then 'rejected' else 'stored' end as kind,
        event_type as run_id, strftime(ts, {DAY}) as day, count(*) as signal_count, sum(round(value, 2)::decimal(38,6))::double as engagement from events group by all""",
    "str4_preliminary_progress": f"""select run_id, source, count(*) filter (not (length(cleaned) < 10 or {SPAM})) as valid_count, count(*) + length(run_id) as target,
        count(*) filter (not (length(cleaned) < 10 or {SPAM})) >= ceil((count(*) + length(run_id)) * 0.5) as preliminary_ready from (select *, {clean('raw_text')} as cleaned from docs) group by run_id, source""",
    "str6_stream_latest_counters": f"""select user_id as signal_id, counter, max(struct_pack(a := ts, v := value)).v as value, strftime(max(ts), {TS}) as recorded_at from (
        select *, case event_type when 'view' then 'views' when 'click' then 'likes' when 'signup' then 'comments' end as counter from events) where counter is not null and value >= 0 group by 1, 2""",
    "udf6_composed_texts": "select doc_id, md5(nfc_normalize(raw_text)) as composed_md5 from docs",
}


def _parts_of(sql: str) -> list[str]:
    """Named parts that ``sql`` uses, dependencies first."""
    found: list[str] = []

    def visit(text: str, above: tuple[str, ...]) -> None:
        for name in CTES:
            if name not in above and re.search(rf"\b(from|join|,)\s+{name}\b", text):
                visit(CTES[name], (*above, name))
                if name not in found:
                    found.append(name)

    visit(sql, ())
    return found


GROUPED_PAIRS = {
    "agg30_label_metrics": "select run_id as grp, * from pairs",
    "agg30_macro_f1": "select 1 as grp, * from pairs",
    "agg31_agg32_evaluation_report": "select run_id as grp, * from pairs",
}


def _statement(name: str, sql: str) -> str:
    parts = _parts_of(sql)
    if name in GROUPED_PAIRS:
        parts = [p for p in _parts_of(GROUPED_PAIRS[name] + " join " + " join ".join(parts)) if p != "gpairs"]
        parts.insert(parts.index("pairs") + 1, "gpairs")
    text = {**CTES, "gpairs": GROUPED_PAIRS.get(name, "")}
    # A part that several others read is computed once.
    return ("with " + ",\n".join(f"{p} as materialized ({text[p]})" for p in parts) + "\n" if parts else "") + sql


ORACLE = {name: _statement(name, sql) for name, sql in QUERIES.items()}
