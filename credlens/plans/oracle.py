"""SQL fragments for the DuckDB oracle.

Every fragment is generated from the same constants the Spark code uses
(word lists, accent map, stand-in roles), so both engines read one truth.
The oracle is a test device only: it checks results at small scale.
"""

from __future__ import annotations

from ..config import DEFAULT
from ..functions import fixed
from ..sources import standins as S


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def in_list(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def values(rows, cols: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v) if isinstance(v, int) else f"CAST({v!r} AS DOUBLE)"
        return q(v)
    body = ",\n  ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES\n  {body}) AS t({cols})"


def with_(*ctes: tuple[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS (\n{b}\n)" for n, b in ctes) + "\n" + final


# ---------------------------------------------------------------------------
# scalar expressions
# ---------------------------------------------------------------------------
def strip_accents(x: str) -> str:
    t = f"translate({x}, {q(''.join(fixed.ONE_LETTER))}, {q(''.join(fixed.ONE_LETTER.values()))})"
    for letter, ascii_ in fixed.SEVERAL_LETTERS.items():
        t = f"replace({t}, {q(letter)}, {q(ascii_)})"
    # a list of one value, so that the text is written once
    return f"(list_transform([{t}], lambda s: CASE WHEN regexp_matches(s, {q(fixed.LETTER_SCRIPTS_PATTERN)}) THEN {spell_letters('s')} ELSE s END)[1])"


def spell_letters(x: str) -> str:
    vowels, finals = len(fixed.HANGUL_VOWELS), len(fixed.HANGUL_FINALS)
    n = f"(unicode(c) - {fixed.HANGUL_FIRST})"
    parts = (f"{str_list(fixed.HANGUL_INITIALS)}[{n} // {vowels * finals} + 1]",
             f"{str_list(fixed.HANGUL_VOWELS)}[{n} // {finals} % {vowels} + 1]",
             f"{str_list(fixed.HANGUL_FINALS)}[{n} % {finals} + 1]")
    letters = f"{str_list(fixed.BY_LETTER.values())}[list_position({str_list(fixed.BY_LETTER)}, c)]"
    return (f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) BETWEEN {fixed.HANGUL_FIRST} "
            f"AND {fixed.HANGUL_LAST} THEN {' || '.join(parts)} ELSE coalesce({letters}, c) END), '')")


def suffix_lemma(lang2: str, w: str) -> str:
    def by_rules(lang: str) -> str:
        whens = " ".join(
            f"WHEN ends_with({w}, {q(e)}) AND length({w}) >= {len(e) - len(i) + fixed.LEMMA_LETTERS} "
            f"THEN substr({w}, 1, length({w}) - {len(e)}) || {q(i)}" for e, i in fixed.lemma_suffixes(lang))
        return f"CASE {whens} ELSE {w} END"
    return f"(CASE WHEN {lang2} = 'fr' THEN {by_rules('fr')} ELSE {by_rules('en')} END)"


def clean(x: str) -> str:
    t = f"lower({x})"
    for pat in (fixed.URL_PATTERN, fixed.MENTION_PATTERN, fixed.HASHTAG_PATTERN,
                fixed.NON_WORD_PATTERN):
        t = f"regexp_replace({t}, {q(pat)}, '', 'g')"
    t = strip_accents(t)
    t = f"regexp_replace({t}, {q(fixed.SPACES_PATTERN)}, ' ', 'g')"
    return f"trim({t})"


def words(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, ' ') END)"


def weak_label(src: str, verified=S.TEST_VERIFIED) -> str:
    return f"(CASE WHEN {src} IN {in_list(verified)} THEN 'credible' ELSE 'unverified' END)"


def score_text(x: str) -> str:
    return f"printf('%.2f', round({x}, 2))"


def hash_bucket(x: str, n: int) -> str:
    return f"(CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT) % {n})"


# ---------------------------------------------------------------------------
# stand-in inputs
# ---------------------------------------------------------------------------
RAW_POSTS = f"""
SELECT doc_id,
       'doc/' || CAST(doc_id AS VARCHAR) AS uri,
       [lang] AS langs,
       lang,
       CASE WHEN lang = {q(S.QUOTED_LANG)} THEN '' ELSE text END AS rec_text,
       CASE WHEN lang = {q(S.QUOTED_LANG)} THEN text END AS quoted_text,
       TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS inserted_at,
       source AS source_label,
       coalesce(list_position({str_list(S.TEST_SOURCES)}, source) - 1, {len(S.TEST_SOURCES)}) AS source_rank
FROM documents"""

POSTS_TEXT = """
SELECT * EXCLUDE (rec_text, quoted_text) FROM (
  SELECT *, coalesce(nullif(rec_text, ''), quoted_text, '') AS text FROM raw_posts)
WHERE length(text) > 0"""

POSTS_CLEAN = f"""
SELECT *, sha256(clean_text) AS post_id FROM (
  SELECT *, {clean('text')} AS clean_text FROM posts_text)
WHERE clean_text <> ''"""

POSTS_DEDUP = f"""
SELECT * EXCLUDE (rn), {weak_label('source_label')} AS credibility_label FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY source_rank, inserted_at, uri) AS rn
  FROM posts_clean)
WHERE rn = 1"""

POSTS_CTES = [("raw_posts", RAW_POSTS), ("posts_text", POSTS_TEXT),
              ("posts_clean", POSTS_CLEAN), ("posts", POSTS_DEDUP)]

# ---------------------------------------------------------------------------
# language, tokens, sentiment, emotions
# ---------------------------------------------------------------------------
def _lang_rank_rows():
    rank = {l: i for i, l in enumerate(fixed.LANG_ORDER)}
    return [(l, w, rank[l]) for l, w in fixed.stopword_rows()]


LANG_CTES = [
    ("stop_lex", "SELECT * FROM " + values(_lang_rank_rows(), "lang, term, lang_rank")),
    ("need_words", f"""
SELECT post_id, unnest({words('clean_text')}) AS w FROM posts
WHERE len(langs) = 0 OR langs IS NULL"""),
    ("lang_hits", """
SELECT n.post_id, s.lang, s.lang_rank, count(*) AS n
FROM need_words n JOIN stop_lex s ON n.w = s.term
GROUP BY 1, 2, 3"""),
    ("lang_guess", """
SELECT post_id, arg_min(lang, (-n, lang_rank)) AS guess FROM lang_hits GROUP BY 1"""),
    ("posts_lang", """
SELECT p.*, coalesce(CASE WHEN len(p.langs) > 0 THEN p.langs[1] END, g.guess, 'en') AS lang_detected
FROM posts p LEFT JOIN lang_guess g USING (post_id)"""),
]


def _word_lex_rows():
    stops = {(l, w) for l, w in fixed.stopword_rows() if l in ("en", "fr")}
    lemmas = {(l, f): m for l, f, m in fixed.lemma_rows()}
    pol = {(l, t): p for l, t, p in fixed.sentiment_rows()}
    emo_terms = {t for t, _, _ in fixed.emotion_rows()}
    keys = set(stops) | set(lemmas) | set(pol) | {(l, t) for t in emo_terms for l in ("en", "fr")}
    return [(l, w, (l, w) in stops, lemmas.get((l, w)), pol.get((l, w))) for l, w in sorted(keys)]


ENRICH_CTES = [
    ("word_lex", "SELECT * FROM " + values(_word_lex_rows(), "lang2, w, is_stop, lemma, polarity")),
    ("emo_lex", "SELECT * FROM " + values(fixed.emotion_rows(), "w, emotion, rank")),
    ("mod_lex", "SELECT * FROM " + values(fixed.modifier_rows(), "lang2, prev, factor")),
    ("wl", f"""
SELECT post_id, lang2, ws, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM (
  SELECT post_id, CASE WHEN starts_with(lang_detected, 'fr') THEN 'fr' ELSE 'en' END AS lang2,
         {words('clean_text')} AS ws
  FROM posts_lang)"""),
    ("wl2", """
SELECT post_id, lang2, pos, w, CASE WHEN pos > 0 THEN ws[pos] END AS prev FROM wl"""),
    ("wj", f"""
SELECT x.*, l.is_stop, l.lemma, l.polarity, m.factor
FROM wl2 x LEFT JOIN word_lex l ON x.lang2 = l.lang2 AND x.w = l.w
           LEFT JOIN mod_lex m ON x.lang2 = m.lang2 AND x.prev = m.prev"""),
    ("tok_agg", f"""
SELECT post_id,
       list(coalesce(lemma, {suffix_lemma('lang2', 'w')}) ORDER BY pos) FILTER (WHERE NOT coalesce(is_stop, FALSE) AND regexp_matches(w, {q(fixed.ALPHA_PATTERN)})) AS tokens,
       coalesce(avg(CASE WHEN polarity IS NOT NULL THEN greatest(-1.0, least(1.0, polarity * coalesce(factor, 1.0))) END), 0.0) AS sentiment
FROM wj GROUP BY post_id"""),
    ("emo_hits", """
SELECT x.post_id, e.emotion, e.rank, count(*) AS n
FROM wl2 x JOIN emo_lex e ON x.w = e.w GROUP BY 1, 2, 3"""),
    ("emo_scores", """
SELECT post_id, emotion, rank, n * 1.0 / sum(n) OVER (PARTITION BY post_id) AS score FROM emo_hits"""),
    ("emo_dom", """
SELECT post_id, arg_min(emotion, (-score, rank)) AS dominant_emotion FROM emo_scores GROUP BY 1"""),
    ("enriched", """
SELECT p.*, coalesce(t.tokens, []::VARCHAR[]) AS tokens, coalesce(t.sentiment, 0.0) AS sentiment,
       coalesce(d.dominant_emotion, 'unknown') AS dominant_emotion, 'ok' AS emotion_status
FROM posts_lang p LEFT JOIN tok_agg t USING (post_id) LEFT JOIN emo_dom d USING (post_id)"""),
]

ENRICHED_CTES = POSTS_CTES + LANG_CTES + ENRICH_CTES
