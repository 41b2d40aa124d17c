"""SQL for DuckDB that states the registered queries a second time.

Written independently of the DataFrame code, on the same tables. The brute-force
similarity join is meant for the small check tables only.
"""

from __future__ import annotations

from reviewlens.functions.lexicons import ASPECTS, SENTIMENT_WEIGHTS, STOP_WORDS

ORACLES: dict[str, str] = {}

SPACE = r"\t-\r\x{1c}-\x{1f}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _no_markup(x: str) -> str:
    urls = rf"regexp_replace(lower(coalesce({x}, '')), '(?:http|www)[^{SPACE}]+', '', 'g')"
    return f"regexp_replace({urls}, '<.*?>', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def clean_model(x: str) -> str:
    ascii_runs = rf"regexp_replace({_no_markup(x)}, '[^\x00-\x7F]+', ' ', 'g')"
    return _squeeze(f"regexp_replace({ascii_runs}, '[^{WORD}{SPACE}!?.,'']', ' ', 'g')")


def clean_keywords(x: str) -> str:
    return _squeeze(f"regexp_replace({_no_markup(x)}, '[^{WORD}{SPACE}]', ' ', 'g')")


def clean_features(x: str) -> str:
    ascii_only = rf"regexp_replace({_no_markup(x)}, '[^\x00-\x7F]', '', 'g')"
    return rf"regexp_replace({ascii_only}, '[!-/:-@\[-`{{-~]', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACE}]+'), lambda t: t <> '')"


def word_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{WORD}]{{2,}}')"


def no_stop(x: str) -> str:
    return f"list_filter({x}, lambda t: t not in ({STOP}))"


def keyword_tokens(x: str) -> str:
    return f"list_filter({no_stop(tokens(clean_keywords(x)))}, lambda t: length(t) > 2)"


def feature_tokens(x: str) -> str:
    split = (
        rf"regexp_replace(regexp_replace({clean_features(x)}, '\b(?:(can)(not)|(gim)(me)|(gon)(na))\b', '\1\3\5 \2\4\6', 'g'),"
        rf" '\b(?:(got)(ta)|(lem)(me)|(wan)(na))\b', '\1\3\5 \2\4\6', 'g')"
    )
    return no_stop(tokens(split))


def pct(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then round_even({part} / {whole} * 100, 1) else 0.0 end"


def has_aspect(phrases: list[str], x: str) -> str:
    return f"regexp_matches({x}, '(?i)(?:^|[^{WORD}])(?:{'|'.join(phrases)})(?:$|[^{WORD}])')"


def repetitive(x: str) -> str:
    return (
        f"coalesce(len({tokens(f'lower({x})')}) > 1 and"
        f" 1 - len(list_distinct({tokens(f'lower({x})')})) / len({tokens(f'lower({x})')}) > 0.5, false)"
    )


def short(x: str) -> str:
    return f"({x} is null or len({tokens(x)}) < 3)"


WEIGHTS = ", ".join(f"('{w}', cast({v} as double))" for w, v in SENTIMENT_WEIGHTS.items())

# Named subqueries; each may use those above it.
PARTS = {
    "reviews": """
        select doc_id seq, cast(doc_id as varchar) review_id, source app_name, text review_text,
               cast(1 + (doc_id * 7 + n_chars) % 5 as double) star_rating,
               date '2024-01-01' + cast(doc_id * 13 % 90 as int) review_date, n_chars % 40 thumbs_up
        from documents""",
    "worded": """
        select * replace (case seq % 8 when 0 then 'keeps crashing after the update'
                            when 1 then 'the price and subscription cost too much'
                            when 2 then 'great matches only' when 3 then 'fake profile and bot'
                            when 4 then 'user friendly design with dark mode'
                            when 5 then 'my date was a match' when 6 then 'nothing special' else '' end
                          || ' ' || review_text as review_text)
        from reviews""",
    "sentiments": """
        select cast(doc_id as varchar) review_id,
               case quality when 1 then 'Positive' when 0 then 'Negative' end sentiment_label,
               0.5e0 + (doc_id % 50) / 100e0 sentiment_score
        from labels""",
    "scored": """
        select r.*, s.sentiment_label, s.sentiment_score,
               coalesce((star_rating >= 4 and sentiment_label = 'Negative')
                        or (star_rating <= 2 and sentiment_label = 'Positive'), false) is_mismatch
        from reviews r join sentiments s using (review_id)""",
    "scorable": f"""
        select w.*, {clean_model('review_text')} clean_text from worded w
        where len({tokens(clean_model('review_text'))}) >= 4""",
    "lexicon": f"select * from (values {WEIGHTS}) t(word, weight)",
    "lexicon_hits": f"""
        select review_id, unnest({word_tokens(clean_model('review_text'))}) word from worded""",
    "lexicon_sums": """
        select review_id, sum(case when weight > 0 then weight end) pos, sum(case when weight < 0 then -weight end) neg
        from lexicon_hits join lexicon using (word) group by review_id""",
    "lexicon_scores": """
        select w.review_id, exp(coalesce(pos, 0) - greatest(coalesce(pos, 0), coalesce(neg, 0)))
               / (exp(coalesce(pos, 0) - greatest(coalesce(pos, 0), coalesce(neg, 0)))
                  + exp(coalesce(neg, 0) - greatest(coalesce(pos, 0), coalesce(neg, 0)))) p
        from worded w left join lexicon_sums using (review_id)""",
    "lexicon_labels": """
        select review_id, case when p > 0.5 then 'Positive' else 'Negative' end sentiment_label,
               round_even(greatest(p, 1 - p), 4) sentiment_score
        from lexicon_scores""",
    "aspect_lists": f"""
        select c.*, s.sentiment_label, s.sentiment_score,
               list_filter([{', '.join(f"case when {has_aspect(p, 'clean_text')} then '{a}' end" for a, p in ASPECTS.items())}],
                           lambda a: a is not null) found
        from scorable c join lexicon_labels s using (review_id)""",
    "aspects": """
        select review_id, app_name, review_text, clean_text, star_rating,
               unnest(case when len(found) = 0 then ['General'] else found end) aspect,
               sentiment_label sentiment, sentiment_score confidence
        from aspect_lists""",
    "per_review": "select distinct review_id, app_name, sentiment from aspects",
    "aspect_counts": """
        select aspect as name, cast(count_if(sentiment = 'Positive') as bigint) positive,
               cast(count_if(sentiment = 'Negative') as bigint) negative
        from aspects group by aspect""",
    "texts": """
        select 'd' || doc_id id, text from documents union all select 'p' || page_id, html from pages
        union all select 'c' || conv_id || '-' || turn, text from conversations""",
    "features": f"select id, {feature_tokens('text')} words from texts",
    "labelled": f"""
        select seq, review_id, {clean_model('review_text')} clean_text, sentiment_label sentiment
        from worded join lexicon_labels using (review_id)""",
    "kw_texts": """
        select arg_min(review_id, seq) review_id, clean_text, arg_min(sentiment, seq) sentiment
        from labelled group by clean_text""",
    "kw_classes": "select *, unnest([lower(sentiment), 'top']) class from kw_texts",
    "kw_counts": f"""
        select class, word, count(*) "count" from
          (select class, unnest({keyword_tokens('clean_text')}) word from kw_classes) group by class, word""",
    "kw_freq": """
        select class, cast(row_number() over (partition by class order by "count" desc, word) as int) rank, word, "count"
        from kw_counts""",
    "tf": f"""
        select class, review_id, term, count(*) tf from
          (select class, review_id, unnest({no_stop(word_tokens('clean_text'))}) term from kw_classes) group by all""",
    "sizes": "select class, count(*) n from kw_classes where trim(clean_text) <> '' group by class",
    "vocab": """
        select * from (select class, term, count(*) df,
                              row_number() over (partition by class order by sum(tf) desc, term) r from tf group by class, term)
        where r <= 5000""",
    "weights": """
        select class, review_id, term, tf * (ln((1 + n) / (1 + df)) + 1) w
        from tf join vocab using (class, term) join sizes using (class)""",
    "means": """
        select class, term word, sum(w / norm) / any_value(n) mean
        from weights join (select class, review_id, sqrt(sum(w * w)) norm from weights group by class, review_id)
             using (class, review_id) join sizes using (class)
        group by class, term""",
    "kw_tfidf": """
        select * from (select class, cast(row_number() over (partition by class order by round_even(mean, 12) desc, word) as int) rank,
                              word, round_even(mean, 6) tfidf from means) where rank <= 50""",
    "judged": """
        select s.sentiment_label as label, case when p > 0.5 then 'Positive' else 'Negative' end prediction, p
        from lexicon_scores join sentiments s using (review_id)""",
    "class_sums": """
        select c class, count_if(label = c) support, count_if(prediction = c) predicted,
               count_if(label = c and prediction = c) hits
        from judged, (select unnest(['Positive', 'Negative']) c)
        group by c""",
    "cleaned": f"""
        select r.*, array_to_string(words, ' ') clean_text
        from (select *, {feature_tokens('review_text')} words from reviews) r where len(words) >= 5""",
    "training": """
        select review_id, case when star_rating <= 2 then 'Negative' else 'Positive' end sentiment
        from cleaned where star_rating <> 3""",
    "upload": """
        select cast(row_number() over (order by conv_id, turn) - 1 as varchar) review_id, text review_text,
               case when turn % 3 = 0 then cast(conv_id % 5 + 1 as double) else 3.0 end star_rating,
               'Custom Dataset' app_name,
               case when turn % 3 < 2 then cast(date '2025-01-01' + cast(conv_id % 300 as int) as varchar) end review_date, role
        from conversations""",
    "upload_hits": f"select review_id, unnest({word_tokens(clean_model('review_text'))}) word from upload",
    "upload_sums": """
        select review_id, sum(case when weight > 0 then weight end) pos, sum(case when weight < 0 then -weight end) neg
        from upload_hits join lexicon using (word) group by review_id""",
    "upload_scores": """
        select u.*, 1 / (1 + exp(coalesce(neg, 0) - coalesce(pos, 0))) p
        from upload u left join upload_sums using (review_id)""",
    "upload_scored": """
        select *, case when p > 0.5 then 'Positive' else 'Negative' end sentiment_label,
               (star_rating >= 4 and p <= 0.5) or (star_rating <= 2 and p > 0.5) is_mismatch,
               length(review_text) < 4 and star_rating = 3 is_spam
        from upload_scores""",
    "dup_tf": f"""
        select review_id, term, count(*) tf from
          (select review_id, unnest({word_tokens('review_text')}) term from reviews) group by all""",
    "dup_vocab": """
        select term, count(*) df from dup_tf group by term order by sum(tf) desc, term limit 10000""",
    "dup_raw": """
        select review_id, term, tf * (ln((1 + (select count(*) from reviews)) / (1 + df)) + 1) w
        from dup_tf join dup_vocab using (term)""",
    "dup_unit": """
        select review_id, term, w / sqrt(sum(w * w) over (partition by review_id)) v from dup_raw""",
    "dup_pairs": """
        select a.review_id l, b.review_id r from dup_unit a join dup_unit b on a.term = b.term and a.review_id < b.review_id
        group by 1, 2 having sum(a.v * b.v) > 0.9""",
    "dups": "select l review_id from dup_pairs union select r from dup_pairs",
    "spam": f"""
        select r.*, {short('review_text')} is_short, {repetitive('review_text')} is_repetitive,
               r.review_id in (select review_id from dups) is_duplicate
        from reviews r""",
    "enriched": """
        select r.*, s.sentiment_label, s.sentiment_score, coalesce(s.is_mismatch, false) is_mismatch,
               case when length(r.review_text) < 30 and (r.star_rating >= 4 or r.star_rating <= 2) then false
                    else q.is_short or q.is_repetitive or q.is_duplicate end is_spam
        from reviews r left join scored s using (review_id) join spam q using (review_id)""",
    "items": """
        select seq, review_id, app_name, review_text, star_rating, cast(review_date as varchar) review_date,
               sentiment_label, sentiment_score, is_mismatch, is_spam, is_mismatch or is_spam is_anomaly
        from enriched""",
    "daily": """
        select cast(review_date as varchar) date, cast(count_if(sentiment_label = 'Positive') as bigint) positive,
               cast(count_if(sentiment_label = 'Negative') as bigint) negative
        from enriched where sentiment_label is not null group by review_date""",
}

# What each part reads.
USES = {
    "worded": "reviews",
    "scored": "reviews sentiments",
    "enriched": "reviews scored spam",
    "items": "enriched",
    "scorable": "worded",
    "aspect_lists": "scorable lexicon_labels",
    "aspects": "aspect_lists",
    "per_review": "aspects",
    "aspect_counts": "aspects",
    "features": "texts",
    "labelled": "worded lexicon_labels",
    "lexicon_labels": "lexicon_scores",
    "kw_texts": "labelled",
    "kw_classes": "kw_texts",
    "kw_counts": "kw_classes",
    "kw_freq": "kw_counts",
    "tf": "kw_classes",
    "sizes": "kw_classes",
    "vocab": "tf",
    "weights": "tf vocab sizes",
    "means": "weights sizes",
    "kw_tfidf": "means",
    "lexicon_hits": "worded",
    "lexicon_sums": "lexicon_hits lexicon",
    "lexicon_scores": "worded lexicon_sums",
    "judged": "lexicon_scores sentiments",
    "class_sums": "judged",
    "cleaned": "reviews",
    "training": "cleaned",
    "upload_hits": "upload",
    "upload_sums": "upload_hits lexicon",
    "upload_scores": "upload upload_sums",
    "upload_scored": "upload_scores",
    "dup_tf": "reviews",
    "dup_vocab": "dup_tf",
    "dup_raw": "dup_tf dup_vocab reviews",
    "dup_unit": "dup_raw",
    "dup_pairs": "dup_unit",
    "dups": "dup_pairs",
    "spam": "reviews dups",
    "daily": "enriched",
}


def _needed(names: list[str]) -> list[str]:
    found: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += USES.get(name, "").split()
    return [name for name in PARTS if name in found]


def oracle(name: str, uses: str, body: str) -> None:
    parts = _needed(uses.split())
    head = ",\n".join(f"{p} as materialized ({PARTS[p]})" for p in parts)
    ORACLES[name] = f"with {head}\n{body}" if parts else body


# --- dashboard ---------------------------------------------------------------------

oracle(
    "summary",
    "reviews per_review spam scored",
    f"""
    select (select count(*) from reviews) total_reviews, (select round_even(avg(star_rating), 2) from reviews) avg_rating,
           {pct('p', '(p + n)')} positive_pct, {pct('n', '(p + n)')} negative_pct,
           (select cast(count_if(is_short or is_repetitive or is_duplicate) as bigint) from spam) spam_count_raw,
           (select cast(count_if(is_mismatch) as bigint) from scored) mismatch_count,
           cast(round(p * 100 / (p + n)) as bigint) positive_share,
           (select count_if(is_short or is_repetitive or is_duplicate) from spam) > 0 or (select count_if(is_mismatch) from scored) > 0 has_anomalies
    from (select count_if(sentiment = 'Positive') p, count_if(sentiment = 'Negative') n from per_review)""",
)
oracle("trends_daily", "daily", "select * from daily order by date")
oracle("reviews_enriched", "enriched", "select * from enriched")
oracle("reviews_bucketed", "enriched", "select * from enriched")
oracle(
    "reviews_first_row",
    "reviews scored spam",
    """
    select r.*,
           case when r.seq % 2 = 1 then s.sentiment_label when s.sentiment_label = 'Positive' then 'Negative'
                when s.sentiment_label = 'Negative' then 'Positive' end sentiment_label,
           s.sentiment_score,
           coalesce(s.is_mismatch <> (r.seq % 2 = 0), false) is_mismatch,
           (f.is_short or f.is_repetitive or f.is_duplicate) <> (r.seq % 2 = 0) is_spam
    from reviews r left join scored s using (review_id) join spam f using (review_id)""",
)
oracle(
    "reviews_filtered",
    "items",
    "select * exclude (seq) from items where sentiment_label = 'Positive' and star_rating between 1 and 2 and is_mismatch and not is_spam",
)
oracle(
    "reviews_page",
    "items",
    """select * exclude (seq), (select count(*) from items where star_rating >= 2) total
       from items where star_rating >= 2 order by seq limit 20 offset 40""",
)
oracle(
    "reviews_pages_stored",
    "items",
    """(select * exclude (seq), 'all' "filter", (select count(*) from items) total from items order by seq limit 20 offset 140)
       union all
       (select * exclude (seq), 'mismatch' "filter", (select count(*) from items where is_mismatch) total
        from items where is_mismatch order by seq limit 5 offset 5)""",
)
oracle(
    "reviews_after",
    "items",
    "select * exclude (seq) from items where sentiment_label = 'Negative' and seq > 100 order by seq limit 25",
)
oracle("reviews_total", "enriched", "select count(*) total, cast(ceil(count(*) / 20) as bigint) pages from enriched")
oracle(
    "mismatch_list",
    "scored",
    "select review_id, review_text, star_rating, sentiment_label, sentiment_score from scored where is_mismatch",
)
oracle(
    "mismatch_breakdown",
    "reviews sentiments",
    f"""
    select *, {pct('mismatches', 'total')} mismatch_pct from
      (select count(*) total, cast(count_if(hi or lo) as bigint) mismatches, cast(count_if(hi) as bigint) high_rating_negative,
              cast(count_if(lo) as bigint) low_rating_positive
       from (select coalesce(star_rating >= 4 and sentiment_label = 'Negative', false) hi,
                    coalesce(star_rating <= 2 and sentiment_label = 'Positive', false) lo
             from reviews left join sentiments using (review_id)
             where len({tokens(clean_model('review_text'))}) >= 4))""",
)
oracle(
    "mismatch_table",
    "scorable lexicon_scores",
    """
    select review_id, app_name, review_text, star_rating, case when p > 0.5 then 'Positive' else 'Negative' end sentiment_label,
           round_even(greatest(p, 1 - p), 4) sentiment_score,
           (star_rating >= 4 and p <= 0.5) or (star_rating <= 2 and p > 0.5) is_mismatch
    from scorable join lexicon_scores using (review_id)""",
)
oracle(
    "compare_apps",
    "reviews per_review",
    f"""
    select app_name, total_reviews, avg_rating, {pct('p', '(p + n)')} positive_pct, {pct('n', '(p + n)')} negative_pct
    from (select app_name, count(*) total_reviews, round_even(avg(star_rating), 2) avg_rating from reviews group by app_name)
    left join (select app_name, count_if(sentiment = 'Positive') p, count_if(sentiment = 'Negative') n
               from per_review group by app_name) using (app_name)
    order by app_name""",
)
oracle("app_names", "reviews", "select distinct app_name from reviews where app_name is not null")

# --- aspects -----------------------------------------------------------------------

oracle("aspect_rows", "aspects", "select * from aspects")
oracle("aspect_tags", "aspects", "select review_id, aspect from aspects")
oracle(
    "aspect_summary",
    "aspect_counts",
    """select *, positive + negative total, cast(round(100 * positive / (positive + negative)) as bigint) positive_share,
              cast(round(100 * negative / (positive + negative)) as bigint) negative_share from aspect_counts""",
)
oracle(
    "aspect_crosstab",
    "aspect_counts",
    'select name aspect, negative "Negative", positive "Positive" from aspect_counts',
)

# --- text --------------------------------------------------------------------------

oracle("clean_model", "texts", f"select id, {clean_model('text')} clean_text from texts")
# Marks and names once more, longest first.
MARKS = {
    "\U0001f469\u200d\U0001f4bb": "woman_technologist",
    "1\ufe0f\u20e3": "keycap_1",
    "\u2764\ufe0f": "red_heart",
    "\U0001f44d\U0001f3fd": "thumbs_up_medium_skin_tone",
    "\u2764": "heart",
    "\U0001f44d": "thumbs_up",
    "\U0001f469": "woman",
    "\U0001f4bb": "laptop",
}
_PREFIXES = ["\u2764", "\u2764\ufe0f", "\U0001f469", "\U0001f4bb", "\U0001f469\u200d\U0001f4bb", "\U0001f44d", "\U0001f44d\U0001f3fd",
             "1\ufe0f\u20e3", "\U0001f4bb\u200d\u2764", "\U0001f44d\U0001f3fd\U0001f44d", "\u2603", ""]
_LISTED = ", ".join(f"'{m}'" for m in _PREFIXES)
_NAMED = _no_markup("marked")
for _mark, _name in MARKS.items():
    _NAMED = f"replace({_NAMED}, '{_mark}', ' {_name} ')"
_NAMED = f"regexp_replace({_NAMED}, '[^{WORD}{SPACE}!?.,'']', ' ', 'g')"
oracle(
    "clean_model_emoji",
    "texts",
    f"""select id, {_squeeze(_NAMED)} clean_text
        from (select id, [{_LISTED}][1 + length(text) % 12] || [{_LISTED}][1 + (length(text) + 5) % 12] || ' ' || text marked from texts)""",
)
oracle("clean_keywords", "texts", f"select id, {clean_keywords('text')} clean_text from texts")
oracle("clean_features", "texts", f"select id, {clean_features('text')} clean_text from texts")
oracle(
    "feature_text",
    "features",
    "select id, array_to_string(words, ' ') clean_text from features where len(words) >= 5",
)
oracle(
    "feature_text_lemmas",
    "features",
    """
    select id, string_agg(coalesce(lemma, token), ' ' order by pos) clean_text
    from (select id, unnest(words) token, unnest(range(len(words))) pos from features where len(words) >= 5)
    left join (
      select token, arg_min(lemma, k) lemma from
        (select token, unnest([regexp_replace(regexp_extract(token, '^(.+)ies$', 1), '(.)$', '\\1y'),
                               regexp_extract(token, '^(.+)es$', 1), regexp_extract(token, '^(.+[^s])s$', 1)]) lemma,
                unnest([0, 1, 2]) k
         from (select distinct unnest(words) token from features))
      where lemma in (select unnest(words) from features)
      group by token) using (token)
    group by id""",
)
oracle(
    "feature_rows_filtered",
    "features",
    """select count(*) "before", cast(count_if(len(words) >= 5) as bigint) "after",
              cast(count_if(len(words) < 5) as bigint) filtered_out from features""",
)
oracle(
    "text_measures",
    "texts",
    f"""
    select id, cast(len({tokens("coalesce(text, '')")}) as int) words, cast(length(text) as int) chars,
           cast(len({word_tokens('text')}) as int) word_tokens,
           cast(len(list_distinct({tokens('lower(text)')})) as int) distinct_tokens,
           array_to_string({keyword_tokens('text')}, ' ') keywords
    from texts""",
)

# --- anomalies ---------------------------------------------------------------------

oracle("short_flag", "texts", f"select id, {short('text')} is_short from texts")
oracle("repetition_flag", "texts", f"select id, {repetitive('text')} is_repetitive from texts")
oracle("near_duplicates", "dups", "select review_id from dups")
oracle(
    "spam_report",
    "spam",
    """
    select review_id, app_name, review_text, star_rating,
           concat_ws(', ', case when is_short then 'too_short' end, case when is_repetitive then 'repetitive' end,
                     case when is_duplicate then 'near_duplicate' end) flag_reason,
           is_short or is_repetitive or is_duplicate is_spam
    from spam""",
)
oracle(
    "spam_breakdown",
    "spam",
    f"""
    select *, {pct('spam', 'total')} spam_pct from
      (select count(*) total, cast(count_if(is_short or is_repetitive or is_duplicate) as bigint) spam,
              cast(count_if(is_short) as bigint) too_short, cast(count_if(is_repetitive) as bigint) repetitive,
              cast(count_if(is_duplicate) as bigint) near_duplicate from spam)""",
)

# --- keywords ----------------------------------------------------------------------

oracle("keywords_freq", "kw_freq", "select * from kw_freq where rank <= 50")
oracle("keywords_tfidf", "kw_tfidf", "select * from kw_tfidf")
oracle(
    "keywords_merged",
    "kw_tfidf kw_freq",
    """select t.*, coalesce(f."count", 0) "count" from kw_tfidf t
       left join (select class, word, "count" from kw_freq where rank <= 50) f using (class, word)""",
)
oracle(
    "keywords_true_counts",
    "kw_tfidf kw_counts",
    'select t.*, coalesce(f."count", 0) "count" from kw_tfidf t left join kw_counts f using (class, word)',
)
oracle(
    "keywords_nested",
    "kw_freq",
    'select class, rank, word, cast(0 as double) tfidf, "count" from kw_freq where rank <= 50',
)
oracle("keywords_frequent", "kw_freq", 'select * from kw_freq where rank <= 30 and "count" >= 5')
oracle("labelled_texts_fallback", "scored", f"select review_id, {clean_keywords('review_text')} clean_text, sentiment_label sentiment from scored")
oracle(
    "keywords_updated",
    "worded lexicon_labels",
    f"""
    select * from (
      select class, cast(row_number() over (partition by class order by count(*) desc, word) as int) rank, word, count(*) "count"
      from (select class, unnest({keyword_tokens('review_text')}) word
            from (select case when seq % 10 = 0 then 'renewed edition ' || review_text else review_text end review_text,
                         unnest([case when (seq % 10 = 0) = (sentiment_label = 'Positive') then 'negative' else 'positive' end, 'top']) class
                  from worded join lexicon_labels using (review_id)))
      group by class, word) where rank <= 50""",
)
oracle(
    "upload_keywords",
    "worded lexicon_labels",
    f"""
    select * from (
      select class, cast(row_number() over (partition by class order by count(*) desc, word) as int) rank, word, count(*) "count"
      from (select class, unnest({keyword_tokens('review_text')}) word
            from (select review_text, unnest([lower(sentiment_label), 'top']) class
                  from worded join lexicon_labels using (review_id)))
      group by class, word) where rank <= 50""",
)

# --- labels and models -------------------------------------------------------------

oracle(
    "weak_labels",
    "reviews",
    """select review_id, case when star_rating <= 2 then 'Negative' when star_rating >= 4 then 'Positive' end sentiment,
              cast(case when star_rating <= 2 then 0 when star_rating >= 4 then 1 end as double) as "label" from reviews""",
)
oracle(
    "clean_reviews_table",
    "cleaned",
    "select review_id, app_name, review_text, star_rating, review_date, thumbs_up, clean_text from cleaned",
)
oracle("class_distribution", "training", 'select sentiment, count(*) "count" from training group by sentiment')
# Test rows per label.
PARTS |= {
    "label_sizes": "select sentiment, count(*) n from training group by sentiment",
    "exact_shares": "select *, n * ceil(sum(n) over () * 0.2) / sum(n) over () e from label_sizes",
    "quotas": """select sentiment, n, floor(e) + case when row_number() over (order by e - floor(e) desc, sentiment)
                     <= round(sum(e) over () - sum(floor(e)) over ()) then 1 else 0 end t from exact_shares""",
}
USES |= {"label_sizes": "training", "exact_shares": "label_sizes", "quotas": "exact_shares"}
oracle(
    "stratified_split_counts",
    "quotas",
    """
    select sentiment, true is_test, cast(t as bigint) "count" from quotas
    union all select sentiment, false, cast(n - t as bigint) from quotas""",
)
oracle(
    "split_membership",
    "quotas",
    """
    select review_id, sentiment,
           row_number() over (partition by sentiment order by md5('42:' || review_id), review_id) <= t is_test
    from training join quotas using (sentiment)""",
)
oracle("sampled_reviews", "reviews", "select * from reviews order by md5('42:' || review_id), review_id limit 500")
oracle(
    "lexicon_scores",
    "lexicon_scores",
    """select review_id, case when p > 0.5 then 'Positive' else 'Negative' end sentiment_label,
              round_even(greatest(p, 1 - p), 4) sentiment_score, round_even(p, 4) positive_score from lexicon_scores""",
)
oracle(
    "confusion_counts", "judged", 'select "label", prediction, count(*) "count" from judged group by "label", prediction'
)
oracle(
    "class_scores",
    "class_sums",
    """
    select class, case when predicted > 0 then round_even(hits / predicted, 6) else 0.0 end "precision",
           case when support > 0 then round_even(hits / support, 6) else 0.0 end recall,
           round_even(2 * hits / (predicted + support), 6) f1, cast(support as bigint) support, cast(hits as bigint) hits
    from class_sums where support + predicted > 0""",
)
oracle(
    "accuracy_macro_f1",
    "class_sums",
    """select round_even(sum(hits) / sum(support), 6) accuracy, round_even(avg(2 * hits / (predicted + support)), 6) macro_f1
       from class_sums where support + predicted > 0""",
)
oracle(
    "metrics_table",
    "judged class_sums",
    """
    select 'lexicon' model, accuracy, macro_f1, round_even((sum(case when pos then r end) - p * (p + 1) / 2) / (p * n), 6) roc_auc
    from (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 r, count_if(pos) over () p, count_if(not pos) over () n
          from (select "label" = 'Positive' pos, p s from judged)),
         (select round_even(sum(hits) / sum(support), 6) accuracy, round_even(avg(2 * hits / (predicted + support)), 6) macro_f1
          from class_sums where support + predicted > 0)
    group by accuracy, macro_f1, p, n""",
)
# Naive Bayes: term counts, vocabulary, unit vectors, sums per class, joint scores of the test part.


def _bayes_parts(name: str, rows: str, most: int) -> None:
    steps = {
        "rows": rows,
        "tf": f"""select review_id, sentiment, word, count(*) tf from
                  (select review_id, sentiment, unnest({word_tokens('"text"')}) word from {name}_rows) group by all""",
        "idf": f"""select word, ln((1 + (select count(*) from {name}_rows)) / (1 + count(*))) + 1 idf
                   from {name}_tf group by word order by sum(tf) desc, word limit {most}""",
        "x": f"""select review_id, sentiment, word, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by review_id)) x
                 from {name}_tf join {name}_idf using (word)""",
        "class": f"select sentiment, ln(count(*) / (select count(*) from {name}_rows)) prior from {name}_rows group by sentiment",
        "mass": f"""select word, idf, sentiment, prior, 1 + coalesce(sum(x), 0) m
                    from {name}_idf cross join {name}_class left join {name}_x using (word, sentiment) group by all""",
        "model": f"select word, idf, sentiment, prior, ln(m / sum(m) over (partition by sentiment)) logp from {name}_mass",
    }
    before = []
    for step, body in steps.items():
        PARTS[f"{name}_{step}"] = body
        USES[f"{name}_{step}"] = " ".join(before) or "training quotas cleaned"
        before.append(f"{name}_{step}")


PARTS["bayes_split"] = """
    select review_id, sentiment, clean_text "text", row_number() over (partition by sentiment order by md5('42:' || review_id), review_id) <= t is_test
    from training join cleaned using (review_id) join quotas using (sentiment)"""
USES["bayes_split"] = "training quotas cleaned"
_bayes_parts("bayes_all", 'select review_id, sentiment, clean_text "text" from training join cleaned using (review_id)', 2000)
_bayes_parts("bayes", "select * from bayes_split where not is_test", 50_000)
USES["bayes_rows"] = "bayes_split"
PARTS |= {
    "bayes_test": f"""select review_id, word, count(*) tf from
                      (select review_id, unnest({word_tokens('"text"')}) word from bayes_split where is_test) group by all""",
    "bayes_units": """select review_id, word, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by review_id)) x
                      from bayes_test join bayes_idf using (word)""",
    "bayes_scores": """select review_id, s.sentiment label, c.sentiment class, any_value(prior) + coalesce(sum(x * logp), 0) score
                       from bayes_split s cross join bayes_class c left join bayes_units u using (review_id)
                            left join (select word, sentiment, logp from bayes_model) m on m.word = u.word and m.sentiment = c.sentiment
                       where is_test group by all""",
    "bayes_judged": """select review_id, label, case when n >= p then 'Negative' else 'Positive' end prediction, round_even(1 / (1 + exp(n - p)), 9) score
                       from (select review_id, label, max(case class when 'Negative' then score end) n,
                                    max(case class when 'Positive' then score end) p from bayes_scores group by all)""",
    "bayes_hits": """select class, count_if(label = class and prediction = class) hits, count_if(prediction = class) predicted, count_if(label = class) support
                     from bayes_judged, (values ('Negative'), ('Positive')) c(class) group by class""",
}
USES |= {
    "bayes_test": "bayes_split",
    "bayes_units": "bayes_test bayes_idf",
    "bayes_scores": "bayes_split bayes_class bayes_units bayes_model",
    "bayes_judged": "bayes_scores",
    "bayes_hits": "bayes_judged",
}
oracle(
    "naive_bayes_model",
    "bayes_all_model",
    """select word term, sentiment class, round_even(idf, 6) idf, round_even(logp, 6) log_probability, round_even(prior, 6) log_prior
       from bayes_all_model""",
)
oracle("naive_bayes_predictions", "bayes_judged", "select review_id, label, prediction, round_even(score, 6) score from bayes_judged")
oracle(
    "naive_bayes_metrics",
    "bayes_judged bayes_hits",
    """
    select 'Naive_Bayes' model, accuracy, macro_f1, round_even((sum(case when pos then r end) - p * (p + 1) / 2) / (p * n), 6) roc_auc
    from (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 r, count_if(pos) over () p, count_if(not pos) over () n
          from (select label = 'Positive' pos, score from bayes_judged)),
         (select round_even(sum(hits) / sum(support), 6) accuracy, round_even(avg(2 * hits / (predicted + support)), 6) macro_f1
          from bayes_hits where support + predicted > 0)
    group by accuracy, macro_f1, p, n""",
)
oracle(
    "roc_auc_exact",
    "scored",
    """
    select round_even((sum(case when pos then r end) - p * (p + 1) / 2) / (p * n), 6) roc_auc
    from (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 r,
                 count_if(pos) over () p, count_if(not pos) over () n
          from (select sentiment_label = 'Positive' pos, length(review_text) / 1000.0 s from scored))
    group by p, n""",
)

# --- ingest ------------------------------------------------------------------------

oracle("reviews_from_csv", "reviews", "select * exclude (seq) from reviews")
oracle(
    "store_export",
    "reviews",
    """select review_id, case when app_name < 'src2' then 'one' else 'two' end app_name, review_text, star_rating, review_date,
              cast(case when app_name >= 'src2' then 1 end as bigint) thumbs_up from reviews""",
)
oracle("upload_normalised", "upload", "select * from upload")
oracle(
    "upload_capped",
    "",
    """
    select cast(row_number() over (order by conv_id * 1000 + turn) - 1 as varchar) review_id, coalesce("text", '') review_text,
           cast(3 as double) star_rating, 'Custom Dataset' app_name, '2025-06-30' review_date
    from conversations order by conv_id * 1000 + turn limit 200""",
)
oracle(
    "upload_scored",
    "upload_scored",
    """select review_id, sentiment_label, round_even(greatest(p, 1 - p), 4) sentiment_score, is_mismatch, is_spam
       from upload_scored""",
)
oracle(
    "upload_stream",
    "upload_scored",
    "select sentiment_label, is_mismatch, is_spam, count(*) reviews from upload_scored group by all",
)
oracle(
    "upload_quarantine",
    "",
    """
    select cast(conv_id * 1000 + turn as varchar) line,
           case k when 0 then "text" when 3 then chr(65533) || ' ' || "text" when 4 then "text" || chr(13) || chr(10) end "text",
           case when k >= 3 then role end role,
           case k when 1 then 'too many fields' when 2 then 'not UTF-8' end reason
    from (select *, (conv_id + turn) % 5 k from conversations)""",
)
oracle(
    "dataset_swap",
    "upload_scored",
    f"""
    select total_reviews, avg_rating, {pct('p', 'total_reviews')} positive_pct, {pct('n', 'total_reviews')} negative_pct,
           spam_count_raw, mismatch_count, cast(round(p * 100 / total_reviews) as bigint) positive_share,
           spam_count_raw > 0 or mismatch_count > 0 has_anomalies
    from (select count(*) total_reviews, round_even(avg(star_rating), 2) avg_rating,
                 count_if(sentiment_label = 'Positive') p, count_if(sentiment_label = 'Negative') n,
                 cast(count_if(is_spam) as bigint) spam_count_raw, cast(count_if(is_mismatch) as bigint) mismatch_count
          from upload_scored)""",
)
oracle(
    "dataset_versions",
    "upload_scored",
    """
    select version, table_name, count(*) row_count
    from (select unnest([1, 2, 3]) version, unnest([true, false, true]) every), (select unnest(['raw_reviews', 'mismatches', 'aspect_results']) table_name),
         (select role from upload)
    where every or role = 'user' group by version, table_name""",
)
oracle(
    "stream_trends",
    "",
    """select strftime(ts, '%Y-%m-%d') date, cast(count_if(event_type = 'purchase') as bigint) positive,
              cast(count_if(event_type = 'error') as bigint) negative from events group by 1""",
)

# --- further figures ---------------------------------------------------------------

oracle("date_range", "reviews", "select min(review_date) first_date, max(review_date) last_date from reviews")
oracle("top_words", "kw_freq", "select * from kw_freq where rank <= 3")
oracle(
    "sentiment_index",
    "enriched",
    """select round_even(sum(case when sentiment_label = 'Positive' then sentiment_score else 0 end) / sum(sentiment_score) * 100, 1)
              sentiment_index from enriched where sentiment_label is not null""",
)
oracle(
    "monthly_trends",
    "enriched",
    """
    select *, reviews - lag(reviews) over (order by "month") change from
      (select cast(date_trunc('month', review_date) as date) "month", count(*) reviews,
              cast(count_if(sentiment_label = 'Positive') as bigint) positive,
              cast(count_if(sentiment_label = 'Negative') as bigint) negative
       from enriched group by 1)""",
)
oracle(
    "trends_with_releases",
    "daily",
    """
    select d.date, positive, negative, r.version as "release" from daily d asof left join
      (select released, max(version) as version from
         (select cast(arg_max(ts, value) as date) released, event_type as version from events group by event_type) group by released) r
      on cast(d.date as date) >= r.released""",
)
oracle(
    "recent_reviews",
    "reviews",
    "select * from reviews where review_date > (select max(review_date) from reviews) - 30",
)
oracle(
    "representative_reviews",
    "aspects",
    """select * from (select aspect, cast(row_number() over (partition by aspect order by confidence desc, review_id) as int) rank,
                             review_id, sentiment, confidence from aspects) where rank <= 3""",
)
oracle(
    "app_aspect_matrix",
    "aspects",
    f"""
    select *, {pct('positive', '(positive + negative)')} positive_pct from
      (select app_name, aspect, cast(count_if(sentiment = 'Positive') as bigint) positive,
              cast(count_if(sentiment = 'Negative') as bigint) negative
       from aspects group by cube (app_name, aspect))""",
)
oracle(
    "dominant_sentiment",
    "aspect_counts",
    f"""
    select name, positive, negative, positive + negative total,
           case when positive > negative then 'Positive' when negative > positive then 'Negative' else 'Mixed' end dominant,
           {pct('(positive + negative)', 'max(positive + negative) over ()')} fill_pct
    from aspect_counts""",
)
oracle(
    "anomaly_list",
    "enriched",
    """select review_id, app_name, review_date, 'high_rating_negative' mismatch_kind, is_mismatch, is_spam from enriched
       where review_date between date '2024-01-15' and date '2024-03-15' and star_rating >= 4 and sentiment_label = 'Negative'""",
)
oracle(
    "review_search",
    "worded",
    "select review_id, app_name from worded where contains(lower(review_text), 'dark mode')",
)
oracle(
    "aspect_maps",
    "aspects",
    """select review_id, string_agg(aspect || '=' || sentiment, ';' order by aspect) aspect_sentiments
       from aspects group by review_id""",
)
