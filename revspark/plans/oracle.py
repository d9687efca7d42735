"""DuckDB oracle SQL for the registered queries (same column names and types)."""

from __future__ import annotations

from revspark.plans import sqlparts as S

ORACLE: dict[str, str] = {}

ORACLE["tfidf_l2"] = f"""
WITH t AS (SELECT doc_id, {S.kept_tokens('text')} AS a FROM documents),
g AS (SELECT doc_id, unnest({S.ngrams('a', 1, 3)}) AS term FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term),
n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.doc_id, tf.term, tf.tf, tf.tf * (ln((1.0 + n.n) / (1.0 + v.df)) + 1.0) AS w
      FROM tf JOIN v ON tf.term = v.term CROSS JOIN n)
SELECT doc_id, term, CAST(tf AS BIGINT) AS tf,
       round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
FROM w
"""

ORACLE["term_counts"] = f"""
WITH t AS (SELECT doc_id, {S.kept_tokens('text')} AS a FROM documents),
g AS (SELECT doc_id, unnest(a) AS term FROM t)
SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM g GROUP BY doc_id, term
"""

ORACLE["bigram_counts"] = f"""
WITH t AS (SELECT doc_id, {S.kept_tokens('text')} AS a FROM documents),
g AS (SELECT doc_id, unnest({S.ngrams('a', 2, 2)}) AS term FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term)
SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf
FROM tf GROUP BY term HAVING count(*) >= 2
"""

ORACLE["top_terms"] = f"""
WITH t AS (SELECT doc_id, {S.kept_tokens('text')} AS a FROM documents),
g AS (SELECT unnest(a) AS term FROM t)
SELECT term, CAST(count(*) AS BIGINT) AS cf FROM g GROUP BY term
ORDER BY cf DESC, term ASC LIMIT 25
"""

ORACLE["vocab_ids"] = f"""
WITH t AS (SELECT doc_id, {S.kept_tokens('text')} AS a FROM documents),
v AS (SELECT DISTINCT unnest(a) AS term FROM t)
SELECT term, row_number() OVER (ORDER BY term) AS id FROM v
"""

LANG_CASE = "CASE " + " ".join(
    f"WHEN {{c}} = {S.sql_str(a)} THEN {S.sql_str(n)}" for a, n in __import__(
        "revspark.functions.decode", fromlist=["LANGUAGE_ALIASES"]).LANGUAGE_ALIASES.items()) + " END"

REVIEWS_CTE = f"""
reviews AS (
  SELECT d.source AS title, regexp_extract(d.source, '([0-9]+)$', 1) AS appid,
         d.doc_id AS recommendation_id, e.user_id AS steam_id, e.user_id AS num_games_owned,
         CAST(d.n_chars // 1000 AS BIGINT) AS num_reviews,
         CAST(floor(e.value * 60) AS BIGINT) AS playtime_forever,
         {LANG_CASE.format(c='d.lang')} AS language,
         d.text AS review, CAST(floor(epoch(e.ts)) AS BIGINT) AS timestamp_created,
         coalesce(l.quality = 1, false) AS voted_up,
         CAST(floor(e.value) AS BIGINT) AS votes_up,
         CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS votes_funny,
         CAST(d.n_chars // 1000 AS BIGINT) AS comment_count,
         e.event_type = 'purchase' AS steam_purchase,
         e.event_type = 'signup' AS received_for_free,
         coalesce(l.toxic = 1, false) AS written_during_early_access,
         coalesce(CASE WHEN e.event_type = 'error' THEN 'We are looking into it.' END, '')
           AS developer_response,
         CAST(floor(epoch(e.ts)) AS BIGINT) + CAST(floor(e.value * 3600) AS BIGINT)
           AS timestamp_updated,
         round(e.value / 500.0, 6) AS weighted_vote_score
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN events e ON e.event_id = d.doc_id)
"""

FLAT_SELECT = ("title, appid, recommendation_id, steam_id, num_games_owned, num_reviews, "
               "playtime_forever, language, review, timestamp_created, voted_up, votes_up, "
               "votes_funny, comment_count, steam_purchase, received_for_free, "
               "written_during_early_access, developer_response")

ORACLE["flatten_nested"] = f"WITH {REVIEWS_CTE} SELECT {FLAT_SELECT} FROM reviews"

ORACLE["json_decode"] = """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k,
       coalesce(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END = 1, false) AS is_purchase
FROM events
"""

ORACLE["review_type_filter"] = f"""WITH {REVIEWS_CTE}
SELECT recommendation_id, appid, voted_up FROM reviews WHERE voted_up"""

ORACLE["purchase_type_filter"] = f"""WITH {REVIEWS_CTE}
SELECT recommendation_id, steam_purchase FROM reviews WHERE NOT steam_purchase"""

ORACLE["language_filter"] = f"""WITH {REVIEWS_CTE}
SELECT recommendation_id, language FROM reviews WHERE language = 'french'"""

ORACLE["day_range"] = f"""WITH {REVIEWS_CTE}
SELECT recommendation_id, timestamp_created FROM reviews
WHERE timestamp_created >= (SELECT (min(timestamp_created) + max(timestamp_created)) // 2 FROM reviews)"""

ORACLE["recent_page"] = f"""WITH {REVIEWS_CTE}
SELECT recommendation_id, timestamp_created, language FROM reviews
ORDER BY timestamp_created DESC, recommendation_id DESC LIMIT 100"""

ORACLE["cursor_page"] = f"""WITH {REVIEWS_CTE},
r AS (SELECT recommendation_id, timestamp_updated,
             row_number() OVER (ORDER BY timestamp_updated DESC, recommendation_id DESC) AS rn
      FROM reviews WHERE language = 'english')
SELECT recommendation_id, timestamp_updated FROM r WHERE rn BETWEEN 51 AND 100"""

ORACLE["review_summary"] = f"""WITH {REVIEWS_CTE}
SELECT appid, CAST(count(*) FILTER (WHERE voted_up) AS BIGINT) AS total_positive,
       CAST(count(*) FILTER (WHERE NOT voted_up) AS BIGINT) AS total_negative,
       CAST(count(*) AS BIGINT) AS total_reviews
FROM reviews GROUP BY appid"""

_LANG_VALUES = ", ".join(
    f"({S.sql_str(a)}, {S.sql_str(b)}, {S.sql_str(c)})"
    for a, b, c in __import__("revspark.functions.constants", fromlist=["LANGUAGES"]).LANGUAGES)

ORACLE["language_dim_join"] = f"""WITH {REVIEWS_CTE},
dim(language, code, native_name) AS (VALUES {_LANG_VALUES}),
c AS (SELECT language, CAST(count(*) AS BIGINT) AS n_reviews FROM reviews GROUP BY language)
SELECT c.language, dim.code, dim.native_name, c.n_reviews
FROM c LEFT JOIN dim ON c.language = dim.language"""

_SCORES = __import__("revspark.functions.constants", fromlist=["SCORE_LABELS"]).SCORE_LABELS
_SCORE_LIST = S.sql_list(_SCORES)

ORACLE["score_ordinal"] = f"""WITH {REVIEWS_CTE},
s AS (SELECT appid, avg(CASE WHEN voted_up THEN 1.0 ELSE 0.0 END) AS share
      FROM reviews GROUP BY appid),
o AS (SELECT appid, CAST(least(floor(share * 9) + 1, 9) AS INTEGER) AS score FROM s)
SELECT appid, {_SCORE_LIST}[score] AS score_label, score, score >= 5 AS at_least_mixed FROM o"""

ORACLE["vote_label"] = f"""WITH {REVIEWS_CTE}
SELECT recommendation_id, votes_up > votes_funny AS up_funny FROM reviews"""

TITLE_RE = '(?s)<div[^>]*class="ad"[^>]*>(.*?)</div>'
_TITLE_TEXT = ("trim(replace(replace(replace(replace(replace(replace("
               "regexp_replace(regexp_extract(html, '{re}', 1), '<[^>]*>', '', 'g'),"
               " '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''),"
               " '&amp;', '&'))").format(re=TITLE_RE)
PAGE_TITLES_CTE = f"""
page_titles AS (
  SELECT CAST(page_id AS VARCHAR) AS appid,
         CASE WHEN regexp_matches(html, '{TITLE_RE}') THEN {_TITLE_TEXT} ELSE 'NA' END AS title
  FROM pages)
"""

ORACLE["title_extract"] = f"WITH {PAGE_TITLES_CTE} SELECT appid, title FROM page_titles"

ORACLE["title_enrich"] = f"""WITH {REVIEWS_CTE}, {PAGE_TITLES_CTE},
dim AS (SELECT appid, min(title) AS title FROM page_titles GROUP BY appid)
SELECT r.recommendation_id, r.appid, coalesce(dim.title, 'NA') AS title
FROM reviews r LEFT JOIN dim ON r.appid = dim.appid"""

_ALIASES = __import__("revspark.functions.constants", fromlist=["TITLE_ALIASES"]).TITLE_ALIASES

ORACLE["title_dictionary"] = f"""WITH {PAGE_TITLES_CTE}
SELECT DISTINCT title FROM (
  SELECT lower(trim(title)) AS title FROM page_titles
  WHERE title IS NOT NULL AND lower(trim(title)) <> 'na' AND lower(trim(title)) <> ''
  UNION ALL SELECT unnest({S.sql_list(_ALIASES)}) AS title)"""

ORACLE["dedupe_rows"] = "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"

ORACLE["drop_seen"] = """
WITH h AS (SELECT DISTINCT text, lang, source FROM documents
           WHERE doc_id IN (SELECT doc_id FROM labels)),
b AS (SELECT min(doc_id) AS doc_id, text, lang, source FROM documents GROUP BY text, lang, source)
SELECT doc_id FROM b WHERE NOT EXISTS (
  SELECT 1 FROM h WHERE h.text IS NOT DISTINCT FROM b.text
   AND h.lang IS NOT DISTINCT FROM b.lang AND h.source IS NOT DISTINCT FROM b.source)
"""

ORACLE["resume_info"] = f"""WITH {REVIEWS_CTE},
m AS (SELECT max(timestamp_created) AS as_of FROM reviews)
SELECT appid, min(timestamp_created) AS oldest_created, CAST(count(*) AS BIGINT) AS n_stored,
       CAST(((SELECT as_of FROM m) - min(timestamp_created)) // 86400 AS BIGINT) AS day_range
FROM reviews WHERE appid <> 'NA' GROUP BY appid"""

_MASK = "|".join(
    __import__("re").escape(s) + "{4,}" if s != "|" else r"\|{4,}"
    for s in __import__("revspark.functions.constants", fromlist=["MASK_SYMBOLS"]).MASK_SYMBOLS)
_NORM = ("regexp_replace(regexp_replace(regexp_replace(text, '" + _MASK + "', 'fuck', 'g'),"
         r" '(:\)|:D|=\)|=D|☺|☻)', 'smile', 'g'), '(:\(|=\(|:-\()', 'sad', 'g')")

ORACLE["normalize_emoticons"] = f"""
SELECT doc_id, md5({_NORM}) AS text_md5, CAST(length({_NORM}) AS INTEGER) AS n_chars
FROM documents"""

ORACLE["apply_rules"] = r"""
WITH r0 AS (SELECT doc_id, source, regexp_replace(text, 'and', 'AND', 'gi') AS t FROM documents),
r1 AS (SELECT doc_id, source, regexp_replace(t, 'les|des', 'LES', 'gi') AS t FROM r0),
r2 AS (SELECT doc_id, source, regexp_replace(t, '[#%&]{3}', ' SYM ', 'gi') AS t FROM r1),
r3 AS (SELECT doc_id, source, regexp_replace(t, '[ \t]*der', ' DER', 'gi') AS t FROM r2),
r4 AS (SELECT doc_id, source, regexp_replace(t, '(ou){2,}', 'ou', 'gi') AS t FROM r3),
r5 AS (SELECT doc_id, CASE WHEN regexp_matches(source, 'src1', 'i')
                      THEN regexp_replace(t, 'ch', 'CH', 'gi') ELSE t END AS t FROM r4)
SELECT doc_id, md5(t) AS text_md5 FROM r5"""

ORACLE["token_filter"] = f"""
WITH t AS (SELECT doc_id, {S.tokens('lower(text)')} AS a, {S.kept_tokens('text')} AS k FROM documents)
SELECT doc_id, CAST(len(a) AS INTEGER) AS n_tokens, CAST(len(k) AS INTEGER) AS n_kept,
       md5(array_to_string(k, ' ')) AS kept_md5 FROM t"""

ORACLE["lemmatize"] = f"""
WITH t AS (SELECT doc_id, {S.kept_tokens('text')} AS a FROM documents),
tok AS (SELECT doc_id, unnest(a) AS token, unnest(range(len(a))) AS pos FROM t),
v AS (SELECT DISTINCT token AS term FROM tok),
lem AS (SELECT term AS form, substr(term, 1, length(term) - 1) AS lemma FROM v
        WHERE regexp_matches(term, '^[a-z]{{3,}}s$')
          AND substr(term, 1, length(term) - 1) IN (SELECT term FROM v)),
j AS (SELECT tok.doc_id, tok.pos, lower(trim(coalesce(lem.lemma, tok.token))) AS token
      FROM tok LEFT JOIN lem ON lem.form = lower(tok.token))
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_tokens,
       md5(string_agg(token, ' ' ORDER BY pos)) AS lemma_md5
FROM j GROUP BY doc_id"""

_ORDER = "md5('42:' || CAST(doc_id AS VARCHAR))"

ORACLE["stratified_split"] = f"""
SELECT doc_id, quality,
       row_number() OVER (PARTITION BY quality ORDER BY {_ORDER})
         <= ceil(0.25 * count(*) OVER (PARTITION BY quality)) AS is_test
FROM labels"""

PAD_CTE = f"""
ld AS (SELECT d.doc_id, d.text, l.quality AS label FROM documents d
       JOIN labels l ON l.doc_id = d.doc_id),
sp AS (SELECT doc_id, text,
              row_number() OVER (PARTITION BY label ORDER BY {_ORDER})
                <= ceil(0.25 * count(*) OVER (PARTITION BY label)) AS is_test FROM ld),
t AS (SELECT doc_id, is_test, {S.kept_tokens('text')} AS a FROM sp),
v AS (SELECT term, row_number() OVER (ORDER BY term) AS id
      FROM (SELECT DISTINCT unnest(a) AS term FROM t WHERE NOT is_test)),
plen AS (SELECT max(len(a)) AS L FROM t WHERE NOT is_test),
tok AS (SELECT doc_id, unnest(a) AS token, unnest(range(len(a))) AS pos FROM t),
idl AS (SELECT tok.doc_id, list(coalesce(v.id, 0) ORDER BY tok.pos) AS ids
        FROM tok LEFT JOIN v ON v.term = tok.token GROUP BY tok.doc_id),
alld AS (SELECT t.doc_id, coalesce(idl.ids, CAST([] AS BIGINT[])) AS ids
         FROM t LEFT JOIN idl ON idl.doc_id = t.doc_id),
p AS (SELECT doc_id,
             list_concat(list_transform(range(greatest((SELECT L FROM plen) - len(ids), 0)),
                                        lambda x: CAST(0 AS BIGINT)),
                         ids[greatest(len(ids) - (SELECT L FROM plen), 0) + 1:]) AS ids
      FROM alld)
"""

ORACLE["padded_ids"] = f"""WITH {PAD_CTE}
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids,
       CAST(len(list_filter(ids, lambda x: x = 0)) AS INTEGER) AS n_zero,
       md5(array_to_string(ids, ',')) AS ids_md5 FROM p"""

ORACLE["embed_vocab"] = f"""WITH {PAD_CTE}
SELECT v.term, v.id AS id, e.embedding IS NOT NULL AS has_vector,
       round(coalesce(sqrt(list_sum(list_transform(e.embedding,
             lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 0.0), 4) AS norm
FROM v LEFT JOIN embeddings e ON e.vec_id = v.id"""

ORACLE["pool_embeddings"] = f"""WITH {PAD_CTE},
ve AS (SELECT v.id, e.embedding FROM v JOIN embeddings e ON e.vec_id = v.id),
d AS (SELECT DISTINCT doc_id, unnest(ids) AS id FROM p),
j AS (SELECT d.doc_id, coalesce(ve.embedding, list_transform(
        range((SELECT len(embedding) FROM embeddings LIMIT 1)), lambda x: CAST(0.0 AS FLOAT))) AS vec
      FROM d LEFT JOIN ve ON ve.id = d.id),
ex AS (SELECT doc_id, unnest(vec) AS x, unnest(range(len(vec))) AS k FROM j),
m AS (SELECT doc_id, k, max(x) AS mx FROM ex GROUP BY doc_id, k)
SELECT doc_id, round(sum(CAST(mx AS DOUBLE)), 4) AS pooled_sum,
       CAST(max(mx) AS DOUBLE) AS pooled_max FROM m GROUP BY doc_id"""

ORACLE["stream_dedupe"] = """
SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type, value"""

ORACLE["first_pages"] = f"""WITH {REVIEWS_CTE}
SELECT recommendation_id, timestamp_created FROM reviews
WHERE language = 'english' AND voted_up
ORDER BY timestamp_created DESC, recommendation_id DESC LIMIT 60"""

ORACLE["sentiment_table"] = f"""WITH {REVIEWS_CTE}
SELECT title, md5(review) AS review_md5, CAST(voted_up AS INTEGER) AS user_suggestion,
       votes_up, votes_funny, votes_up > votes_funny AS up_funny FROM reviews"""

ORACLE["stream_pages"] = f"""WITH {REVIEWS_CTE},
d AS (SELECT recommendation_id, steam_id, language, review, timestamp_created, voted_up,
             row_number() OVER (PARTITION BY {FLAT_SELECT.replace('title, appid, ', '')}
                                ORDER BY recommendation_id) AS rn
      FROM reviews)
SELECT recommendation_id, steam_id, language, md5(review) AS review_md5, timestamp_created, voted_up
FROM d WHERE rn = 1"""

ORACLE["csv_store"] = f"""WITH {REVIEWS_CTE}
SELECT recommendation_id, title, language,
       md5(CASE recommendation_id % 8
           WHEN 0 THEN '  ' || review || '  ' WHEN 1 THEN review || chr(9)
           WHEN 2 THEN replace(review, chr(10), chr(13) || chr(10)) || chr(13) || chr(10)
           WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '"' || review || '","' WHEN 6 THEN chr(92) || 'N'
           ELSE review END) AS review_md5,
       timestamp_created, voted_up, votes_funny, developer_response FROM reviews"""

ORACLE["watermark_dedupe"] = "SELECT DISTINCT event_id, event_type FROM events"

ORACLE["helpful_pages"] = f"""WITH {REVIEWS_CTE}
SELECT recommendation_id, weighted_vote_score FROM reviews
ORDER BY weighted_vote_score DESC NULLS LAST, recommendation_id DESC LIMIT 100"""

ORACLE["review_days"] = f"""WITH {REVIEWS_CTE},
r AS (SELECT recommendation_id, timestamp_created - (recommendation_id % 30) * 86400 AS timestamp_created FROM reviews)
SELECT * FROM r WHERE timestamp_created >= (SELECT max(timestamp_created) FROM r) - 7 * 86400"""

ORACLE["null_pages"] = """
SELECT d.doc_id AS recommendation_id, CASE WHEN l.quality IS NOT NULL THEN d.n_chars END AS timestamp_updated
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE l.quality IS NULL AND d.doc_id < (SELECT max(doc_id) FROM documents)
ORDER BY d.doc_id DESC LIMIT 100"""

ORACLE["null_order_dedupe"] = """
SELECT d.source, d.lang, min(CASE WHEN l.quality IS NOT NULL THEN d.n_chars END) AS n
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source, d.lang"""

ORACLE["embed_vocab_terms"] = f"""WITH {PAD_CTE},
bt AS (SELECT DISTINCT unnest({S.kept_tokens('text')}) AS term FROM benchmark),
bv AS (SELECT term, row_number() OVER (ORDER BY term) AS rnk FROM bt),
st AS (SELECT bv.term, e.embedding FROM bv JOIN embeddings e ON e.vec_id = bv.rnk)
SELECT v.term, v.id AS id, st.embedding IS NOT NULL AS has_vector,
       round(coalesce(sqrt(list_sum(list_transform(st.embedding,
             lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 0.0), 4) AS norm
FROM v LEFT JOIN st ON st.term = v.term"""

ORACLE["feature_vectors"] = f"""WITH {PAD_CTE},
dfs AS (SELECT token AS term, count(DISTINCT tok.doc_id) AS df FROM tok
        JOIN t ON t.doc_id = tok.doc_id WHERE NOT t.is_test GROUP BY token),
n AS (SELECT count(*) AS n FROM t WHERE NOT is_test),
w AS (SELECT tok.doc_id, v.id - 1 AS id,
             count(*) * (ln((1.0 + any_value(n.n)) / (1.0 + any_value(dfs.df))) + 1.0) AS w
      FROM tok JOIN v ON v.term = tok.token JOIN dfs ON dfs.term = tok.token CROSS JOIN n
      GROUP BY tok.doc_id, v.id),
g AS (SELECT doc_id, count(*) AS c, min(id) AS lo, max(id) AS hi, sum(w) / sqrt(sum(w * w)) AS s FROM w GROUP BY doc_id)
SELECT ld.doc_id, CAST(coalesce(g.c, 0) AS INTEGER) AS n_features, CAST(g.lo AS INTEGER) AS first_id,
       CAST(g.hi AS INTEGER) AS last_id, round(coalesce(g.s, 0.0), 6) AS weight_sum
FROM ld LEFT JOIN g ON g.doc_id = ld.doc_id"""

ORACLE["incremental_load"] = f"""WITH {REVIEWS_CTE}
SELECT recommendation_id, appid, steam_id, timestamp_created FROM reviews WHERE appid = '0'"""

ORACLE["folds"] = """
SELECT doc_id, quality AS label,
       CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('43:' || doc_id)) - 1) % 5 AS INTEGER) AS fold
FROM labels"""


def _plain_rules() -> str:
    """The rules as one step each, in order."""
    from revspark.operators.normalize import plain_rules
    from revspark.plans.catalog import PLANTED_WORDS
    text = "text"
    for word, other in PLANTED_WORDS:
        text = f"replace({text}, {S.sql_str(word)}, {S.sql_str(other)})"
    steps = [f"r0 AS (SELECT doc_id, {text} AS t FROM documents)"]
    for i, r in enumerate(plain_rules()):
        new = f"regexp_replace(t, {S.sql_str(r.pattern)}, {S.sql_str(r.replacement)}, 'gi')"
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT doc_id, {new} AS t FROM r{i})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, md5(t) AS text_md5 FROM r{len(steps) - 1}"


ORACLE["plain_rules"] = _plain_rules()

ORACLE["fixed_model"] = f"""WITH {PAD_CTE},
dfs AS (SELECT token AS term, count(DISTINCT tok.doc_id) AS df FROM tok
        JOIN t ON t.doc_id = tok.doc_id WHERE NOT t.is_test GROUP BY token),
n AS (SELECT count(*) AS n FROM t WHERE NOT is_test),
w AS (SELECT tok.doc_id, v.id - 1 AS id,
             count(*) * (ln((1.0 + any_value(n.n)) / (1.0 + any_value(dfs.df))) + 1.0) AS w
      FROM tok JOIN v ON v.term = tok.token JOIN dfs ON dfs.term = tok.token CROSS JOIN n
      GROUP BY tok.doc_id, v.id),
g AS (SELECT doc_id, sum(w * ((id % 7 - 3) / 10.0)) / sqrt(sum(w * w)) AS m FROM w GROUP BY doc_id)
SELECT ld.doc_id, round(coalesce(g.m, 0.0) + 0.01, 6) AS margin, CAST(coalesce(g.m, 0.0) + 0.01 > 0 AS INTEGER) AS prediction
FROM ld LEFT JOIN g ON g.doc_id = ld.doc_id"""

_ENDINGS = S.sql_list(["s", "es", "ed", "ing", "ly", "tion", "en", "er", "eur", "ar", "ou"])

ORACLE["lemma_rules"] = f"""WITH t AS (SELECT {S.kept_tokens('text')} AS a FROM documents),
v AS (SELECT DISTINCT term FROM (SELECT unnest(a) AS term FROM t) WHERE regexp_full_match(term, '[a-z]+')),
c AS (SELECT term AS form, unnest(list_filter({_ENDINGS}, lambda e: ends_with(term, e) AND length(term) - length(e) >= 3)) AS e FROM v),
k AS (SELECT form, e, left(form, length(form) - length(e)) AS lemma FROM c
      WHERE left(form, length(form) - length(e)) IN (SELECT term FROM v)),
p AS (SELECT form, arg_max(lemma, length(e)) AS lemma FROM k GROUP BY form),
q AS (SELECT *, substr(md5(form), 1, 1) IN ('0', '1', '2') AS held FROM p),
s AS (SELECT length(form) - length(lemma) AS cut,
             unnest(list_transform(range(length(form) - length(lemma), least(length(form) - 1, 5) + 1), lambda n: right(form, n))) AS suffix
      FROM q WHERE NOT held),
ct AS (SELECT suffix, cut, count(*) AS n FROM s GROUP BY suffix, cut HAVING count(*) >= 2),
ru AS (SELECT suffix, cut FROM (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut) AS rn FROM ct) WHERE rn = 1),
en AS (SELECT form, unnest(list_transform(range(0, least(length(form) - 1, 5) + 1), lambda n: right(form, n))) AS suffix FROM q WHERE held),
f AS (SELECT form, arg_max(cut, length(suffix)) AS cut FROM en JOIN ru USING (suffix) GROUP BY form),
o AS (SELECT q.form, q.lemma, coalesce(left(q.form, length(q.form) - f.cut), q.form) AS found
      FROM q LEFT JOIN f ON f.form = q.form WHERE held)
SELECT form, lemma, found, lemma = found AS is_right FROM o"""
