"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from scriptmill.functions import abbreviations, mapping, tokens
from scriptmill.operators.correct import ALPHABET


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def cyr(column: str) -> str:
    return f"translate({column}, {text(mapping.LATIN)}, {text(mapping.CYRILLIC)})"


def values(rows: list[tuple[str, ...]]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(text(x) for x in r) + ")" for r in rows) + ")"


def listed(items: list[str]) -> str:
    return "(" + ", ".join(text(x) for x in items) + ")"


SEGMENTS = f"regexp_extract_all(text, {text(tokens.SEGMENT)})"
BLANK = r"regexp_extract_all(text, '[^ \t\r\n]+')"
LATIN = f"regexp_full_match(token, {text(f'[{mapping.KEY_CLASS}]+')})"
STEM = "regexp_replace(token, '[.,!?]*$', '')"
WORDS = f"words AS (SELECT doc_id, lang, unnest({SEGMENTS}) AS word, generate_subscripts({SEGMENTS}, 1) - 1 AS pos FROM documents)"
LEXICONS = f"""en AS (SELECT DISTINCT lower(word) AS word FROM words WHERE lang = 'en'),
bg AS (SELECT DISTINCT lower({cyr('word')}) AS word FROM words WHERE lang = 'es')"""
CLASSED = f"""known AS (SELECT w.word, en.word IS NOT NULL AS in_en, bg.word IS NOT NULL AS in_bg
  FROM (SELECT DISTINCT word FROM {{source}}) w LEFT JOIN en ON lower(w.word) = en.word LEFT JOIN bg ON lower({cyr('w.word')}) = bg.word),
classed AS (SELECT s.*, in_en, in_bg, CASE WHEN in_en AND in_bg THEN 'both' WHEN in_bg THEN 'bg' WHEN in_en THEN 'en' ELSE 'neither' END AS class
  FROM {{source}} s JOIN known USING (word))"""
CLASSED_WORDS = CLASSED.replace("{source}", "words")
ABBREV = f"en_abbr(k, v) AS {values(list(abbreviations.ENGLISH.items()))}, bg_abbr(k, v) AS {values(list(abbreviations.BULGARIAN.items()))}"
UPPER_FIRST = r"regexp_matches(word, '^\p{Lu}')"
COUNT = "CAST(count_if({}) AS BIGINT)".format
LETTERS = f"letters AS (SELECT unnest(string_split({text(' '.join(ALPHABET))}, ' ')) AS a, generate_subscripts(string_split({text(' '.join(ALPHABET))}, ' '), 1) AS r)"

SPOKEN = f"""turns AS (SELECT conv_id AS session, turn, role, unnest({SEGMENTS}) AS word, generate_subscripts({SEGMENTS}, 1) AS place FROM conversations),
spoken AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY turn, role, place) - 1 AS pos, word FROM turns)"""
EDITS = """places AS (SELECT w, unnest(range(0, length(w) + 1)) AS i FROM asked),
edits AS (
  SELECT w, 0 AS kind, i, r, w[1:i] || a || w[i+2:] AS c FROM places, letters WHERE i < length(w) AND a <> w[i+1]
  UNION ALL SELECT w, 1, i, 0, w[1:i] || w[i+2:] FROM places WHERE i < length(w)
  UNION ALL SELECT w, 2, i, r, w[1:i] || a || w[i+1:] FROM places, letters
  UNION ALL SELECT w, 3, i, 0, w[1:i] || w[i+2] || w[i+1] || w[i+3:] FROM places WHERE i < length(w) - 1)"""

# The full fold. A history is a string, one letter a label: E and B where it is confident, else e and b. Each step
# appends a letter, so that the string after a session holds the history before each of its words.
LAST = "upper(right(h, 1))"
RUN = "length(regexp_replace(regexp_extract(h, '([eE]+|[bB]+)$'), '[eb]', '', 'g'))"
LEAD = "(length(regexp_replace(h, '[^B]', '', 'g')) - length(regexp_replace(h, '[^E]', '', 'g')))"
#: What comes out, the label and the confidence, from the history h and the flags x: English and Bulgarian abbreviation, members, correction, short word.
def decision(assisted: bool = False) -> str:
    """With help x goes on: an English correction, and what the scores say of an ambiguous and of an unknown first word, a letter and six of confidence each."""
    near = "(x[1] = '1' OR x[7] = '1')" if assisted else "x[1] = '1'"
    fixed = "CASE WHEN x[1] = '1' THEN 'c' ELSE 'g' END" if assisted else "'c'"
    open_, unknown = "'wE0.5'", "'wE0.3'"
    if assisted:
        open_ = f"CASE x[8] WHEN 'B' THEN 'sB' || x[9:14] WHEN 'E' THEN 'wE' || x[9:14] ELSE {open_} END"
        unknown = f"CASE x[15] WHEN 'B' THEN CASE WHEN x[5] = '1' AND x[16] >= '1' THEN 'f' ELSE 's' END || x[15:21] WHEN 'E' THEN CASE WHEN {near} AND x[16] >= '1' THEN {fixed} ELSE 'w' END || x[15:21] ELSE {unknown} END"
    return f"""CASE
  WHEN x[1] = '1' AND {LAST} <> 'B' THEN 'xE1.0'
  WHEN x[2] = '1' AND {LAST} = 'B' THEN 'yB1.0'
  WHEN x[3:4] = '11' THEN CASE WHEN {LEAD} > 0 THEN 'sB0.9' WHEN {LEAD} < 0 THEN 'wE0.9' WHEN h = '' THEN {open_} WHEN {LAST} = 'B' THEN 'sB0.8' ELSE 'wE0.8' END
  WHEN x[3:4] = '10' THEN CASE WHEN {LAST} = 'B' AND {RUN} >= 3 AND x[6] = '1' THEN 'sB0.6' WHEN x[1] = '1' THEN 'cE1.0' ELSE 'wE1.0' END
  WHEN x[3:4] = '01' THEN CASE WHEN {LAST} = 'E' AND {RUN} >= 3 AND x[6] = '1' THEN 'wE0.6' ELSE 'sB1.0' END
  WHEN {LAST} = 'E' AND {RUN} >= 2 THEN CASE WHEN {near} THEN {fixed} || 'E0.8' ELSE 'wE0.5' END
  WHEN {LAST} = 'B' AND {RUN} >= 2 THEN 'sB0.5'
  WHEN NOT {near} AND x[5] = '1' THEN 'fB0.8'
  WHEN {near} AND x[5] = '0' THEN {fixed} || 'E0.8'
  WHEN {near} AND x[5] = '1' AND h <> '' THEN CASE {LAST} WHEN 'B' THEN 'fB0.7' ELSE {fixed} || 'E0.7' END
  WHEN h = '' THEN {unknown} WHEN {LAST} = 'B' THEN 'sB0.7' ELSE 'wE0.7' END"""


DECISION = decision()
#: The letter that a step appends. Confidences of one digit before the point compare as text.
LETTER = "list_transform([{}], lambda d: CASE WHEN d[3:] >= '0.9' THEN d[2] ELSE lower(d[2]) END)[1]".format
#: The same with the last six labels of acc as the history.
STEP = f"list_transform([right(acc, 6)], lambda h: {LETTER(DECISION)})[1]"
ASSISTED_STEP = f"list_transform([right(acc, 6)], lambda h: {LETTER(decision(True))})[1]"


def converted(other: str = "") -> str:
    """What comes out by the first letter of d; ``other``: further cases."""
    return f"""CASE d[1] WHEN 's' THEN cyrillic WHEN 'x' THEN en_v WHEN 'y' THEN bg_v WHEN 'c' THEN CASE WHEN {UPPER_FIRST} THEN upper(en_v[1]) || en_v[2:] ELSE en_v END
    WHEN 'f' THEN CASE WHEN regexp_matches(cyrillic, '^\\p{{Lu}}') THEN upper(fix[1]) || fix[2:] ELSE fix END{other} ELSE word END"""


CONVERTED = converted()


def coded(source: str) -> str:
    """CTEs from a table with a column word to ``coded``: its rows with the features of the words, and their flags as x."""
    flag = "CASE WHEN {} THEN '1' ELSE '0' END".format
    return f"""{CLASSED.replace('{source}', source)}, {LETTERS}, {ABBREV},
asked AS (SELECT DISTINCT lower({cyr('word')}) AS w FROM classed WHERE class = 'neither' AND length(word) >= 2),
{EDITS},
fixes AS (SELECT w, arg_min(c, kind * 1000000 + i * 100 + r) AS c FROM edits JOIN bg ON bg.word = c WHERE c <> w GROUP BY w),
flagged AS (SELECT s.*, {cyr('s.word')} AS cyrillic, e.v AS en_v, b.v AS bg_v, CASE WHEN class = 'neither' THEN f.c END AS fix, regexp_full_match(s.word, {text(f'[{mapping.KEY_CLASS}]+')}) AS latin
  FROM classed s LEFT JOIN en_abbr e ON e.k = lower(s.word) LEFT JOIN bg_abbr b ON b.k = lower(s.word) LEFT JOIN fixes f ON f.w = lower({cyr('s.word')})),
coded AS (SELECT *, {flag('en_v IS NOT NULL')} || {flag('bg_v IS NOT NULL')} || {flag('in_en')} || {flag('in_bg')} || {flag('fix IS NOT NULL')} || {flag('length(word) <= 3')} AS x FROM flagged)"""


def _spelt(asked: str, lexicon: str) -> str:
    """The speller's choice for each w of ``asked`` among the rows (c, n) of ``lexicon``, by all pairs, as w, c and d."""
    swaps = "len(list_filter(range(length(w) - 1), lambda i: c[1:i] || c[i + 2] || c[i + 1] || c[i + 3:] = w)) > 0"
    return f"""SELECT w, b.c AS c, b.d AS d FROM (SELECT w, arg_min({{'c': c, 'd': d}}, (-n * CASE d WHEN 0 THEN 40000 WHEN 1 THEN 200 ELSE 1 END, c)) AS b
  FROM (SELECT w, c, n, CASE WHEN e = 2 AND length(w) = length(c) AND {swaps} THEN 1 ELSE e END AS d
    FROM (SELECT w, c, n, levenshtein(w, c) AS e FROM {asked} JOIN {lexicon} ON abs(length(w) - length(c)) <= 2) WHERE e <= 2)
  WHERE d <= CASE WHEN length(w) >= 6 THEN 2 WHEN length(w) >= 3 THEN 1 ELSE 0 END GROUP BY w)"""


FREQUENT = "frequent AS (SELECT lower(word) AS c, count(*) AS n FROM words WHERE lang = 'en' GROUP BY lower(word) HAVING count(*) >= 5)"


def _model(name: str, form: str, source: str) -> str:
    """CTEs: the likelihood (name_l: w, lang, l) of each distinct form of the words of ``source`` by the n-grams of the documents' words in that form."""
    grams = "substr(' ' || w || ' ', CAST(i AS BIGINT), 3)"
    return f"""{name}_g AS (SELECT lang, {grams} AS g, sum(n) AS c FROM (SELECT lang, {form} AS w, n, unnest(range(1, length(word) + 1)) AS i FROM by_lang) GROUP BY ALL),
{name}_t AS (SELECT lang, CAST(sum(c) AS DOUBLE) + (SELECT count(DISTINCT g) FROM {name}_g) AS total FROM {name}_g GROUP BY lang),
{name}_l AS (SELECT w, lang, sum(CAST(round(1000 * ln((coalesce(c, 0) + CAST(1 AS DOUBLE)) / total)) AS BIGINT)) AS l
  FROM (SELECT w, {grams} AS g FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT DISTINCT {form} AS w FROM {source}))) JOIN {name}_t ON true LEFT JOIN {name}_g USING (g, lang) GROUP BY w, lang)"""


def _models(source: str) -> str:
    return f"""by_lang AS (SELECT lang, word, count(*) AS n FROM words WHERE lang IS NOT NULL GROUP BY ALL),
{_model('latin', 'lower(word)', source)},
{_model('cyr', f"lower({cyr('word')})", source)}"""


def _share(factors: dict[str, str], of: str) -> str:
    """The score from rows with lang, l and m (the greatest l of a group)."""
    factor = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in factors.items()) + " ELSE 0 END"
    part = f"exp((l - m) / CAST(1000 AS DOUBLE))"
    return f"floor(sum({factor} * {part}) / sum({part}) * 10000 + 0.5) / CAST(10000 AS DOUBLE) AS {of}"


EN_SCORE, BG_SCORE = ({"en": "1"}, "en_score"), ({"es": "1", "fr": "0.4"}, "bg_score")


def _word_scores(name: str, factors: dict[str, str], of: str) -> str:
    return f"SELECT w, {_share(factors, of)} FROM (SELECT *, max(l) OVER (PARTITION BY w) AS m FROM {name}_l) GROUP BY w"


def _phrase_scores(name: str, form: str, factors: dict[str, str], of: str) -> str:
    summed = f"SELECT session, pos, lang, sum(l) OVER (PARTITION BY session, lang ORDER BY pos ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS l FROM typed JOIN {name}_l ON w = {form}"
    return f"SELECT session, pos, {_share(factors, of)} FROM (SELECT *, max(l) OVER (PARTITION BY session, pos) AS m FROM ({summed})) GROUP BY session, pos"


LANGUAGE_SCORES = f"""{_models('spoken')},
typed AS (SELECT * FROM spoken WHERE regexp_full_match(word, {text(f'[{mapping.KEY_CLASS}]+')})),
e1 AS ({_word_scores('latin', *EN_SCORE)}), b1 AS ({_word_scores('cyr', *BG_SCORE)}),
e2 AS ({_phrase_scores('latin', 'lower(word)', {'en': '1'}, 'en_phrase')}), b2 AS ({_phrase_scores('cyr', f"lower({cyr('word')})", {'es': '1', 'fr': '0.4'}, 'bg_phrase')})
SELECT session, CAST(pos AS INTEGER) AS pos, word, en_score, en_phrase, bg_score, bg_phrase
FROM typed JOIN e1 ON e1.w = lower(word) JOIN b1 ON b1.w = lower({cyr('word')}) JOIN e2 USING (session, pos) JOIN b2 USING (session, pos)"""


def assist(source: str) -> str:
    """CTEs from ``coded`` to ``helped``: with the English correction and the scores, whose say follows the flags in x."""
    said = lambda b, e: f"CASE WHEN {b} THEN 'B' || printf('%.4f', bg_score) WHEN {e} THEN 'E' || printf('%.4f', en_score) ELSE '-------' END"
    return f"""{FREQUENT}, {_models(source)},
e1 AS ({_word_scores('latin', *EN_SCORE)}), b1 AS ({_word_scores('cyr', *BG_SCORE)}),
misspelt AS (SELECT DISTINCT lower(word) AS w FROM coded WHERE NOT in_en AND NOT in_bg),
meant AS ({_spelt('misspelt', 'frequent')}),
scored AS (SELECT c.*, CASE WHEN NOT in_en AND NOT in_bg THEN m.c END AS en_fix, coalesce(en_score, 0) AS en_score, coalesce(bg_score, 0) AS bg_score
  FROM coded c LEFT JOIN meant m ON m.w = lower(c.word) LEFT JOIN e1 ON e1.w = lower(c.word) LEFT JOIN b1 ON b1.w = lower({cyr('c.word')})),
helped AS (SELECT * REPLACE (x || CASE WHEN en_fix IS NOT NULL THEN '1' ELSE '0' END || {said('bg_score > en_score + 0.1::DOUBLE', 'en_score > bg_score + 0.1::DOUBLE')}
  || {said('bg_score > 0.5::DOUBLE AND bg_score > en_score + 0.15::DOUBLE', 'en_score > 0.5::DOUBLE AND en_score > bg_score + 0.15::DOUBLE')} AS x) FROM scored)"""


def full_fold(source: str, assisted: bool = False) -> str:
    """CTEs from a table (session, pos, word) to the result of the fold."""
    helped, rows = (f", {assist(source)}", "helped") if assisted else ("", "coded")
    step, choice = (ASSISTED_STEP, decision(True)) if assisted else (STEP, DECISION)
    said = converted(f" WHEN 'g' THEN CASE WHEN {UPPER_FIRST} THEN upper(en_fix[1]) || en_fix[2:] ELSE en_fix END") if assisted else CONVERTED
    return f"""{coded(source)}{helped},
counted AS (SELECT *, row_number() OVER (PARTITION BY session, latin ORDER BY pos) AS k FROM {rows}),
folded AS (SELECT session, list_reduce(list_prepend('', list(x ORDER BY k)), lambda acc, x: acc || {step}) AS labels FROM counted WHERE latin GROUP BY session),
decided AS (SELECT *, CASE WHEN latin THEN {choice} END AS d FROM (SELECT c.*, CASE WHEN latin THEN labels[greatest(1, k - 6):k - 1] END AS h FROM counted c LEFT JOIN folded USING (session)))
SELECT CAST(session AS VARCHAR) AS session, CAST(pos AS BIGINT) AS pos, word AS original, {said} AS converted,
  CASE d[2] WHEN 'E' THEN 'EN' WHEN 'B' THEN 'BG' ELSE '??' END AS language, CASE WHEN d IS NULL THEN 0.0::DOUBLE ELSE CAST(d[3:] AS DOUBLE) END AS confidence, in_en, in_bg FROM decided"""


# The key replay. A text is cut at each key that is no part of a word; a step is such a key, or the end, and the run of
# keys before it. A run begins with the first key that types a letter, unless a word is held: then each key counts. So a
# step has two variants (v = 1 if a word is held), and a walk over the steps carries the history and the held word p.
# Texts have no escape or delete key, no modifiers and no terminal here.
BUFFERED = f"[{mapping.KEY_CLASS}{tokens.JOINING}]"
BREAK = f"[^{mapping.KEY_CLASS}{tokens.JOINING}]"
#: What a step hands to the decision, from what its variant hands over by itself and the held word.
HANDED = """CASE WHEN pend THEN [] WHEN p0 IS NULL THEN {own} WHEN kind IN ('emoticon', 'none') THEN [{held}]
    WHEN kind = 'force' THEN list_prepend({held}, {own}) WHEN kind = 'hyphen' THEN list_append({own}, {own}[1]) ELSE {own} END""".format
REPLAY = f"""typed AS (SELECT concat_ws(':', conv_id, turn, role) AS sid, text AS body FROM conversations WHERE text <> ''),
cut AS (SELECT sid, list_append(regexp_extract_all(body, {text(BUFFERED + '*' + BREAK)}), regexp_extract(body, {text(BUFFERED + '*$')})) AS bits FROM typed),
bits AS (SELECT sid, unnest(bits) AS bit, generate_subscripts(bits, 1) AS k, len(bits) AS n FROM cut),
steps AS (SELECT sid, k, CASE WHEN k = n THEN bit ELSE left(bit, length(bit) - 1) END AS run, CASE WHEN k < n THEN right(bit, 1) END AS t,
  sum(length(bit)) OVER (PARTITION BY sid ORDER BY k) - CASE WHEN k < n THEN 1 ELSE 0 END AS seq FROM bits),
runs AS (SELECT sid, k, seq, t, 0 AS v, regexp_replace(run, {text(f'^[{tokens.JOINING}]+')}, '') AS run FROM steps UNION ALL SELECT sid, k, seq, t, 1, run FROM steps),
kinds AS (SELECT *, regexp_replace(run, '[.,!?]*$', '') AS stem, CASE WHEN t IN (chr(10), chr(13)) THEN 'raw' WHEN run = '' THEN 'none'
    WHEN t = ' ' THEN CASE WHEN stem = '' THEN 'tail' WHEN stem IN {listed(tokens.EMOTICONS)} THEN 'emoticon' WHEN regexp_matches(stem, {text(tokens.EMAIL_OR_URL)}) THEN 'address'
      WHEN contains(stem, '-') THEN 'hyphen' ELSE 'word' END
    WHEN run IN {listed(tokens.EMOTICON_PREFIXES)} AND t IN {listed(tokens.EMOTICON_BODIES)} THEN 'emoticon' ELSE 'force' END AS kind FROM runs),
split AS (SELECT *, CASE kind WHEN 'force' THEN [run] WHEN 'hyphen' THEN string_split(stem, '-') WHEN 'word' THEN [stem] ELSE [] END AS words,
  CASE WHEN kind IN ('hyphen', 'word') THEN run[length(stem) + 1:] ELSE '' END AS tail FROM kinds),
asking AS (SELECT DISTINCT unnest(words) AS word FROM split),
{coded('asking')},
placed AS (SELECT sid, k, v, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM split),
flags AS (SELECT sid, k, v, list(CASE WHEN latin THEN x ELSE '' END ORDER BY j) AS xs, bool_and(in_en AND in_bg) AS open FROM placed JOIN coded USING (word) GROUP BY sid, k, v),
acts AS MATERIALIZED (SELECT s.*, coalesce(xs, CAST([] AS VARCHAR[])) AS xs, coalesce(open, false) AND kind = 'word' AND tail = '' AS open FROM split s LEFT JOIN flags USING (sid, k, v)),
walk AS (
  SELECT sid, CAST(0 AS BIGINT) AS k, '' AS hist, CAST(NULL AS VARCHAR) AS p, CAST(NULL AS VARCHAR) AS px, '' AS h0, CAST(NULL AS VARCHAR) AS p0, CAST([] AS VARCHAR[]) AS given, false AS pend FROM typed
  UNION ALL
  SELECT sid, k, list_reduce(list_prepend(h0, list_filter(given, lambda g: g <> '')), lambda acc, x: acc || {STEP}), CASE WHEN pend THEN words[1] WHEN kind = 'tail' THEN p0 END,
    CASE WHEN pend THEN xs[1] WHEN kind = 'tail' THEN px0 END, h0, p0, given, pend
  FROM (SELECT *, {HANDED(own='xs', held='px0')} AS given
    FROM (SELECT a.*, right(w.hist, 6) AS h0, w.p AS p0, w.px AS px0, w.p IS NULL AND w.hist = '' AND a.open AS pend
      FROM walk w JOIN acts a ON a.sid = w.sid AND a.k = w.k + 1 AND a.v = CASE WHEN w.p IS NULL THEN 0 ELSE 1 END))),
walked AS (SELECT w.*, a.seq, a.kind, a.run, a.tail, {HANDED(own='a.words', held='p0')} AS handed FROM walk w JOIN acts a ON a.sid = w.sid AND a.k = w.k AND a.v = CASE WHEN w.p0 IS NULL THEN 0 ELSE 1 END),
asked_of AS (SELECT sid, k, hist, h0, given, len(handed) AS n, p0 IS NOT NULL AS held, kind, unnest(handed) AS word, generate_subscripts(handed, 1) AS j FROM walked),
decided AS (SELECT *, CASE WHEN latin THEN {DECISION} END AS d
  FROM (SELECT o.*, c.* EXCLUDE (word), right(left(hist, length(h0) + len(list_filter(given[1:j - 1], lambda g: g <> ''))), 6) AS h FROM asked_of o JOIN coded c USING (word))),
spelt AS (SELECT sid, k, j, {CONVERTED} AS said, d[2] AS label, held AND kind IN ('emoticon', 'none', 'force') AND j = 1 AS own, held AND kind = 'hyphen' AND j = n AS again FROM decided),
joined AS (SELECT sid, k, string_agg(said, '-' ORDER BY j) FILTER (NOT own AND NOT again) AS said, max(said) FILTER (own) AS alone, arg_max(coalesce(label = 'B', false), j) AS is_bg FROM spelt GROUP BY sid, k),
emitted AS (SELECT sid, seq, CASE WHEN pend THEN '' WHEN p0 IS NULL THEN CASE WHEN kind IN ('force', 'hyphen', 'word') THEN said || tail ELSE run END
    WHEN kind = 'raw' THEN p0 || ' ' || run WHEN kind = 'emoticon' THEN alone || ' ' || run WHEN kind = 'none' THEN alone WHEN kind = 'tail' THEN run WHEN kind = 'address' THEN p0 || run
    ELSE CASE WHEN is_bg THEN {cyr('p0')} ELSE p0 END || ' ' || said || tail END AS emitted FROM walked LEFT JOIN joined USING (sid, k))
SELECT sid AS session_id, CAST(seq AS BIGINT) AS seq, emitted FROM emitted WHERE emitted <> ''"""


TIME = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')".format
SESSIONS = """marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS cut FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
dealt AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked),
cuts AS (SELECT user_id, min(ts) AS s, max(ts) AS e, count(*) AS n_events FROM dealt GROUP BY user_id, k)"""
EVENT_SESSIONS = f"WITH {SESSIONS} SELECT user_id, {TIME('s')} AS session_start, {TIME('e')} AS session_end, n_events FROM cuts"


ORACLE_SQL: dict[str, str] = {
    "translit_tokens": f"""SELECT token, {LATIN} AS is_latin, CASE WHEN {LATIN} THEN {cyr('token')} END AS cyrillic, regexp_matches(token, '[Ѐ-ӿ]') AS has_cyrillic, count(*) AS n
FROM (SELECT unnest({BLANK}) AS token FROM documents) GROUP BY token""",
    "token_kind_counts": f"""SELECT lang, count(*) AS n,
{COUNT(f"regexp_matches({STEM}, {text(tokens.EMAIL_OR_URL)})")} AS n_address, {COUNT(f"token IN {listed(tokens.EMOTICONS)}")} AS n_emoticon,
{COUNT(f"token IN {listed(tokens.EMOTICON_PREFIXES)}")} AS n_prefix, {COUNT(f"token IN {listed(tokens.EMOTICON_BODIES)}")} AS n_body,
{COUNT("regexp_matches(token, '[.,!?]$')")} AS n_trailing, {COUNT(f"contains({STEM}, '-')")} AS n_hyphen,
{COUNT(f"contains({text(mapping.SPECIAL_KEYS)}, token[1])")} AS n_special_first,
{COUNT(f"NOT regexp_full_match(token[1], {text(f'[{mapping.KEY_CLASS}{tokens.JOINING}]')})")} AS n_other_first
FROM (SELECT lang, unnest({BLANK}) AS token FROM documents) GROUP BY lang""",
    "segment_tokens": f"WITH {WORDS} SELECT doc_id, pos, word FROM words",
    "abbrev_expand": f"""WITH {WORDS}, {ABBREV}, counted AS (SELECT word, count(*) AS n FROM words GROUP BY word)
SELECT word, e.v AS english, CASE WHEN {UPPER_FIRST} THEN upper(e.v[1]) || e.v[2:] ELSE e.v END AS english_cased, b.v AS bulgarian, n
FROM counted LEFT JOIN en_abbr e ON e.k = lower(word) LEFT JOIN bg_abbr b ON b.k = lower(word) WHERE e.v IS NOT NULL OR b.v IS NOT NULL""",
    "case_restore": f"""WITH {WORDS}, x AS (SELECT DISTINCT word, {cyr('lower(word)')} AS c FROM words)
SELECT word, CASE WHEN {UPPER_FIRST} THEN upper(c[1]) || c[2:] ELSE c END AS restored FROM x""",
    "lexicon_build": f"WITH {WORDS}, {LEXICONS} SELECT 'en' AS lexicon, word FROM en UNION ALL SELECT 'bg', word FROM bg",
    "lexicon_scan": f"WITH {WORDS}, {LEXICONS} SELECT 'en' AS lexicon, word FROM en UNION ALL SELECT 'bg', word FROM bg",
    "lexicon_class": f"""WITH {WORDS}, {LEXICONS}, {CLASSED_WORDS}
SELECT lang, class, count(*) AS n_tokens, count(DISTINCT word) AS n_words FROM classed GROUP BY lang, class""",
    "lexicon_conflicts": f"WITH {WORDS}, {LEXICONS} SELECT en.word, bg.word AS cyrillic FROM en JOIN bg ON lower({cyr('en.word')}) = bg.word",
    "near_conflicts": f"""WITH {WORDS}, {LEXICONS}, keyed AS (SELECT DISTINCT word, lower({cyr('word')}) AS c FROM en),
lg AS (SELECT DISTINCT w, substr(' ' || w || ' ', CAST(i AS BIGINT), 3) AS g FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT DISTINCT c AS w FROM keyed))),
rg AS (SELECT DISTINCT w, substr(' ' || w || ' ', CAST(i AS BIGINT), 3) AS g FROM (SELECT word AS w, unnest(range(1, length(word) + 1)) AS i FROM bg)),
ln AS (SELECT w, count(*) AS n FROM lg GROUP BY w), rn AS (SELECT w, count(*) AS n FROM rg GROUP BY w),
met AS (SELECT lg.w AS l, rg.w AS r, count(*) AS s FROM lg JOIN rg USING (g) GROUP BY lg.w, rg.w),
links AS (SELECT l, r, s, a.n + b.n - s AS t FROM met JOIN ln a ON a.w = l JOIN rn b ON b.w = r WHERE 10 * s >= 7 * (a.n + b.n - s)),
best AS (SELECT l, count(*) AS n_links, arg_min(r, (-s / CAST(t AS DOUBLE), r)) AS nearest FROM links GROUP BY l)
SELECT word, c AS cyrillic, coalesce(n_links, 0) AS n_links, nearest FROM keyed LEFT JOIN best ON l = c""",
    "lookahead_pairs": f"""WITH {WORDS}, {LEXICONS}, {CLASSED_WORDS},
pairs AS (SELECT *, lead(word) OVER w AS word2, lead(class) OVER w AS class2 FROM classed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
decided AS (SELECT doc_id, pos, word AS word1, word2, CASE class2 WHEN 'bg' THEN 'BG' WHEN 'en' THEN 'EN' ELSE '??' END AS lang FROM pairs WHERE class = 'both' AND word2 IS NOT NULL)
SELECT *, CASE WHEN lang = 'BG' THEN {cyr('word1')} ELSE word1 END AS output1, CASE WHEN lang = 'BG' THEN {cyr('word2')} ELSE word2 END AS output2 FROM decided""",
    "edit1_correct": f"""WITH {WORDS}, {LEXICONS}, {CLASSED_WORDS}, {LETTERS},
asked AS (SELECT DISTINCT lower({cyr('word')}) AS w FROM classed WHERE class = 'neither' AND length(word) >= 2),
{EDITS}
SELECT w AS word, arg_min(c, kind * 1000000 + i * 100 + r) AS correction,
  ['substitution', 'deletion', 'insertion', 'transposition'][min(kind) + 1] AS edit
FROM edits JOIN bg ON bg.word = c WHERE c <> w GROUP BY w""",
    "hyphen_map": f"""SELECT token, array_to_string(list_transform(string_split({STEM}, '-'), lambda p: {cyr('p')}), '-') || token[length({STEM}) + 1:] AS mapped,
{STEM} AS stem, token[length({STEM}) + 1:] AS tail FROM (SELECT DISTINCT unnest({BLANK}) AS token FROM documents)""",
    "sim_fold": f"""WITH RECURSIVE {WORDS}, {LEXICONS},
{SPOKEN},
{CLASSED.replace('{source}', 'spoken').replace('classed AS (', 'classed AS MATERIALIZED (')},
fold AS (
  SELECT session, CAST(-1 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS word, '??' AS lang, 0 AS streak, CAST([] AS VARCHAR[]) AS sure FROM (SELECT DISTINCT session FROM spoken)
  UNION ALL
  SELECT session, pos, word, l, CASE WHEN l = lang THEN streak + 1 ELSE 1 END,
    CASE WHEN (in_en <> in_bg) AND l = CASE WHEN in_en THEN 'EN' ELSE 'BG' END THEN list_append(sure, l)[-6:] ELSE sure END
  FROM (SELECT c.session, c.pos, c.word, c.in_en, c.in_bg, f.lang, f.streak, f.sure,
      CASE WHEN c.in_bg AND NOT c.in_en THEN CASE WHEN f.lang = 'EN' AND f.streak >= 3 AND length(c.word) <= 3 THEN 'EN' ELSE 'BG' END
        WHEN c.in_en AND NOT c.in_bg THEN CASE WHEN f.lang = 'BG' AND f.streak >= 3 AND length(c.word) <= 3 THEN 'BG' ELSE 'EN' END
        WHEN c.in_en AND len(list_filter(f.sure, lambda s: s = 'BG')) > len(list_filter(f.sure, lambda s: s = 'EN')) THEN 'BG'
        WHEN c.in_en AND len(list_filter(f.sure, lambda s: s = 'BG')) < len(list_filter(f.sure, lambda s: s = 'EN')) THEN 'EN'
        WHEN f.lang = 'BG' THEN 'BG' ELSE 'EN' END AS l
    FROM fold f JOIN classed c ON c.session = f.session AND c.pos = f.pos + 1))
SELECT session, CAST(pos AS INTEGER) AS pos, word, lang, CASE WHEN lang = 'BG' THEN {cyr('word')} ELSE word END AS output FROM fold WHERE pos >= 0""",
    "app_fold": f"WITH {WORDS}, {LEXICONS}, sessions AS (SELECT doc_id AS session, pos, word FROM words), {full_fold('sessions')}",
    "app_fold_assisted": f"WITH {WORDS}, {LEXICONS}, sessions AS (SELECT doc_id AS session, pos, word FROM words), {full_fold('sessions', True)}",
    "language_scores": f"WITH {WORDS}, {SPOKEN}, {LANGUAGE_SCORES}",
    "spell_english": f"""WITH {WORDS}, {LEXICONS}, {CLASSED_WORDS}, {FREQUENT}, misspelt AS (SELECT DISTINCT lower(word) AS w FROM classed WHERE class = 'neither')
SELECT w AS word, c AS correction, CAST(d AS INTEGER) AS edits FROM ({_spelt('misspelt', 'frequent')})""",
    "event_sessions": EVENT_SESSIONS,
    "stream_sessions": EVENT_SESSIONS,
    "session_preferences": f"""WITH {SESSIONS},
changes AS (SELECT user_id, ts AS since, max(CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN 'BG' ELSE 'EN' END) AS preference FROM events WHERE event_type = 'signup' AND value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id, ts)
SELECT c.user_id, {TIME('s')} AS session_start, coalesce(preference, 'EN') AS preference, n_events FROM cuts c ASOF LEFT JOIN changes p ON p.user_id = c.user_id AND c.s >= p.since""",
    "stream_fold": f"WITH {WORDS}, {LEXICONS}, {SPOKEN}, {full_fold('spoken')}",
    "keystroke_replay": f"WITH RECURSIVE {WORDS}, {LEXICONS}, {REPLAY}",
    "stream_replay": f"WITH RECURSIVE {WORDS}, {LEXICONS}, {REPLAY}",
}
