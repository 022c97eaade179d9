"""DuckDB SQL of the same results as :mod:`.queries`, written on its own from the same rules."""

from __future__ import annotations

#: The needle of the searches, and the literal rows of the rules on Cyrillic.
NEEDLE = "re"
SAMPLES = ("Привет МИР", "ЁЛКА Ї І Є ABC", "plain text", "смесь mixed ТЕКСТ", "", "Ӂ ӂ", "день—ночь")

SP = r"[\x09-\x0D ]"
ANY = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
MARKS = r"""[,.!?;:()*—–«»…“„"\-]"""
LETTER = r"""[^\x09-\x0D ,.!?;:()*—–«»…“„"\-]"""
UNIT = rf"({SP}*)({LETTER}+(?:[\-–—]{LETTER}+)*|\.\.\.|{MARKS})"
MARK_LIST = "(',','.','!','?',';',':','(',')','-','*','—','–','«','»','…','...','“','„','\"')"
BASES = "['O','ADVERBIAL','ADVERBIAL','SUBJECT','SUBJECT','PREDICATE','PREDICATE','DEFINITION','DEFINITION','ADDITION','ADDITION']"
NAMES = "['O','B-ADVERBIAL','I-ADVERBIAL','B-SUBJECT','I-SUBJECT','B-PREDICATE','I-PREDICATE','B-DEFINITION','I-DEFINITION','B-ADDITION','I-ADDITION']"
TYPES = "['другое','обстоятельство','обстоятельство','подлежащее','подлежащее','сказуемое','сказуемое','определение','определение','дополнение','дополнение']"
CATEGORIES = ("подлежащее", "сказуемое", "дополнение", "определение", "обстоятельство", "другое")
CATS = "['подлежащее','сказуемое','дополнение','определение','обстоятельство','другое']"
CLASSES = "['O','ADVERBIAL','SUBJECT','PREDICATE','DEFINITION','ADDITION']"


def san(c: str) -> str:
    for pattern, to in (
        (r"\[[^\]\n]*\]", ""),
        (r"\x{A0}", " "),
        (r"[^\p{L}\p{N}\x09-\x0D \p{P}]", ""),
        (SP + "+", " "),
        (r" +([.,!?;:])", r"\1"),
        (r"([.,!?;:])([^ ])", r"\1 \2"),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim({c})"


def pre(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '{ANY}+', ' ', 'g'), ' +([.,!?;:])', '\\1', 'g'))"


def low(c: str) -> str:
    return f"translate({c}, 'АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁІЄ', 'абвгдежзийклмнопрстуфхцчшщъыьэюяёіє')"


def esc(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


def words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^\\x09-\\x0D ]+'))"


def role(c: str) -> str:
    return f"CASE {c} WHEN 'другое' THEN 'др.' WHEN 'обстоятельство' THEN 'обст.' WHEN 'подлежащее' THEN 'подл.' WHEN 'сказуемое' THEN 'сказ.' WHEN 'определение' THEN 'опр.' WHEN 'дополнение' THEN 'доп.' ELSE {c} END"


def sent(table: str, keys: str) -> str:
    """CTEs up to sent(keys, sent_no, sentence)."""
    return rf"""
clean AS (SELECT {keys}, {san("coalesce(text, '')")} AS c FROM {table}),
tails AS (SELECT {keys}, regexp_extract_all(c, '([^.!?…]*(?:[.!?][.]*[»"]*|…)){SP}*', 1) AS h,
          regexp_replace(c, '(?s)^.*(?:[.!?][»"]*|…){SP}*', '') AS t FROM clean),
listed AS (SELECT {keys}, list_filter(list_transform(list_concat(h, CASE WHEN regexp_matches(t, '(?s)^.+»') THEN [regexp_extract(t, '(?s)^(.+»)(.*)$', 1), regexp_extract(t, '(?s)^(.+»)(.*)$', 2)] ELSE [t] END),
          lambda x: trim(x)), lambda x: x <> '') AS s FROM tails),
sent AS (SELECT {keys}, unnest(range(1, len(s) + 1)) AS sent_no, unnest(s) AS sentence FROM listed)"""


CONV = sent("conversations", "conv_id, turn")
UNITS = rf"""{CONV},
unit0 AS (SELECT *, regexp_extract_all(sentence, '{UNIT}', 1) AS g, regexp_extract_all(sentence, '{UNIT}', 2) AS u FROM sent),
unit1 AS (SELECT conv_id, turn, sent_no, sentence, unnest(range(len(u))) AS unit_no, unnest(g) AS gap, unnest(u) AS unit FROM unit0),
unit2 AS (SELECT *, CAST(sum(length(gap) + length(unit)) OVER w AS BIGINT) AS end_c, CAST(sum(strlen(gap) + strlen(unit)) OVER w AS BIGINT) AS end_b
          FROM unit1 WINDOW w AS (PARTITION BY conv_id, turn, sent_no ORDER BY unit_no)),
units AS (SELECT conv_id, turn, sent_no, sentence, unit_no, unit, end_c - length(unit) AS start_c, end_c, end_b - strlen(unit) AS start_b, end_b, unit IN {MARK_LIST} AS is_mark FROM unit2)"""


def label_cte(source: str, where: str, name: str = "word") -> str:
    return f"""
{name} AS (SELECT *, {NAMES}[1 + lid] AS label, {BASES}[1 + lid] AS base, {TYPES}[1 + lid] AS ru FROM (SELECT *, (7 * length(unit) + 3 * unit_no) % 11 AS lid FROM {source} WHERE {where}))"""


def ents(unit: str, chars: bool) -> str:
    return f"""
step AS (SELECT *, coalesce(starts_with(label, 'I-') AND base = lag(base) OVER w AND start_{unit} - lag(end_{unit}) OVER w BETWEEN 0 AND 2, false) AS goes_on
         FROM word WINDOW w AS (PARTITION BY conv_id, turn, sent_no ORDER BY unit_no)),
isle AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn, sent_no ORDER BY unit_no) AS no FROM step),
phrase AS (SELECT conv_id, turn, sent_no, no, any_value(sentence) AS sentence, string_agg(unit, ' ' ORDER BY unit_no) AS text, arg_min(label, unit_no) AS type, arg_min(base, unit_no) AS base,
           arg_min(ru, unit_no) AS type_ru, min(start_b) AS start_b, max(end_b) AS end_b, min(start_c) AS start_c, max(end_c) AS end_c
           FROM isle {"WHERE base <> 'O'" if chars else ""} GROUP BY ALL),
ents AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, sent_no ORDER BY no) AS ent_no FROM phrase)"""


WORDS = f"WITH {UNITS},{label_cte('units', 'NOT is_mark')}"
ENTS = f"{WORDS},{ents('b', False)}"
_NOT_MARKS = "unit NOT IN (',', '.', '!', '?', ';', ':', '-', '(', ')')"
ENTS_C = f"WITH {UNITS},{label_cte('units', _NOT_MARKS)},{ents('c', True)}"
ITEMS = f"""{ENTS},
items AS (SELECT type_ru, lower(text) AS text, count(*) AS amount, count(DISTINCT (conv_id, turn, sent_no)) AS n_sentences FROM ents GROUP BY ALL)"""
PAGE = f"{ITEMS}, page AS (SELECT *, row_number() OVER (ORDER BY type_ru, text) - 1 AS original_order FROM items)"
CATS_CTE = f"cats AS (SELECT unnest(range(6)) AS cat_no, unnest({CATS}) AS type_ru)"
TOTALS = f"{ENTS}, {CATS_CTE}, totals AS (SELECT cat_no, cats.type_ru, count(ents.type_ru) AS n FROM cats LEFT JOIN ents ON ents.type_ru = cats.type_ru GROUP BY ALL)"
SAMPLE_CTE = "samples AS (SELECT unnest(range({n})) AS i, unnest([{s}]) AS s)".format(n=len(SAMPLES), s=",".join(f"'{s}'" for s in SAMPLES))

VOCAB = f"""WITH RECURSIVE {UNITS},
uw AS (SELECT {low("unit")} AS w, count(*) AS n FROM units GROUP BY 1),
ch AS (SELECT DISTINCT unnest(string_split(w, '')) AS token FROM uw),
tk AS (SELECT w AS token FROM uw WHERE n >= 3 UNION SELECT token FROM ch WHERE token <> '' UNION SELECT '##' || token FROM ch WHERE token <> ''),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 102 AS id FROM tk WHERE token NOT IN ('[PAD]', '[UNK]', '[CLS]', '[SEP]')
          UNION ALL SELECT unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]']), unnest([0, 100, 101, 102]))"""
PIECES = f"""{VOCAB},
cand AS (SELECT w, p, max(n) AS n FROM (SELECT w, p, unnest(range(1, length(w) - p + 2)) AS n FROM (SELECT w, unnest(range(1, length(w) + 1)) AS p FROM uw WHERE strlen(w) <= 100))
         SEMI JOIN vocab ON vocab.token = CASE WHEN p > 1 THEN '##' ELSE '' END || substring(w, p, n) GROUP BY w, p),
walk AS (SELECT w, 1 AS p, n, 0 AS piece_no FROM cand WHERE p = 1
         UNION ALL SELECT walk.w, walk.p + walk.n, cand.n, walk.piece_no + 1 FROM walk JOIN cand ON cand.w = walk.w AND cand.p = walk.p + walk.n),
whole AS (SELECT w FROM walk GROUP BY w HAVING max(p + n) = length(w) + 1),
pieces AS (SELECT w, piece_no, CASE WHEN p > 1 THEN '##' ELSE '' END || substring(w, p, n) AS token, n, p FROM walk SEMI JOIN whole ON whole.w = walk.w
           UNION ALL SELECT w, 0, '[UNK]', 0, 1 FROM uw ANTI JOIN whole ON whole.w = uw.w)"""
SUBS = f"""{PIECES},
subs AS (SELECT conv_id, turn, sent_no, unit_no, piece_no, pieces.token, coalesce(id, 100) AS id,
         CASE WHEN pieces.token = '[UNK]' THEN NULL ELSE start_b + strlen(substring(pieces.w, 1, p - 1)) END AS start_b,
         CASE WHEN pieces.token = '[UNK]' THEN NULL ELSE start_b + strlen(substring(pieces.w, 1, p - 1 + n)) END AS end_b,
         CASE WHEN pieces.token = '[UNK]' THEN 1 ELSE 0 END AS err
         FROM units JOIN pieces ON pieces.w = {low("units.unit")} LEFT JOIN vocab ON vocab.token = pieces.token)"""
ENC = f"""{SUBS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, sent_no ORDER BY unit_no, piece_no) AS rn FROM subs),
kept AS (SELECT *, sum(CASE WHEN starts_with(token, '##') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn, sent_no ORDER BY rn) - 1 AS word_id FROM ranked WHERE rn <= 126),
enc AS (SELECT conv_id, turn, sent_no, list(id ORDER BY rn) AS ids, list(token ORDER BY rn) AS tokens, list(word_id ORDER BY rn) AS wids, max(err) AS err FROM kept GROUP BY ALL)"""
LSUBS = f"""{SUBS},
lab AS (SELECT *, {NAMES}[1 + (7 * length(token) + 3 * unit_no + piece_no) % 11] AS label FROM subs)"""
PAIRS = f"""WITH {UNITS},
lids AS (SELECT (7 * length(unit) + 3 * unit_no) % 11 AS t, (7 * length(unit) + 3 * unit_no + CASE WHEN unit_no % 3 = 0 THEN 2 ELSE 0 END) % 11 AS p FROM units WHERE NOT is_mark),
pairs AS (SELECT {BASES}[1 + t] AS true_class, {BASES}[1 + p] AS pred_class FROM lids WHERE {BASES}[1 + t] <> 'PREDICATE'),
cells AS (SELECT a.c AS true_class, b.c AS pred_class, (SELECT count(*) FROM pairs WHERE pairs.true_class = a.c AND pairs.pred_class = b.c) AS n
          FROM (SELECT unnest({CLASSES}) AS c) a, (SELECT unnest({CLASSES}) AS c) b)"""
PRF = f"""{PAIRS},
cls AS (SELECT t.c AS class, support, tp, predicted FROM
        (SELECT true_class AS c, sum(n) AS support, sum(CASE WHEN true_class = pred_class THEN n ELSE 0 END) AS tp FROM cells GROUP BY 1) t
        JOIN (SELECT pred_class AS c, sum(n) AS predicted FROM cells GROUP BY 1) p ON p.c = t.c WHERE support > 0),
pr AS (SELECT class, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support FROM cls),
prf AS (SELECT class, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, CAST(support AS BIGINT) AS support, list_position({CLASSES}, class) AS place FROM pr)"""


CONSOLE = """lines0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
lines AS (SELECT doc_id, line_no, CASE WHEN length(text) % 13 = 5 THEN ' Quit ' ELSE text END AS text FROM lines0)"""


def _ratio(a: str, b: str, ab: str, n: str) -> str:
    """Twice the log likelihood ratio of ab joint cases among n, a of the one and b of the other."""

    def side(k: str, rest: str, p: str) -> str:
        return f"CASE WHEN {p} > 0 AND {p} < 1 THEN {k} * ln({p}) + {rest} * ln(1 - {p}) ELSE 0 END"

    p, p1, p2 = f"({b} / {n})", f"({ab} / {a})", f"(CASE WHEN {n} > {a} THEN ({b} - {ab}) / ({n} - {a}) ELSE 0 END)"
    rest = f"({n} - {a} - {b} + {ab})"
    null = f"({side(ab, f'({a} - {ab})', p)}) + ({side(f'({b} - {ab})', rest, p)})"
    free = f"(CASE WHEN {a} = {ab} THEN 0 ELSE {side(ab, f'({a} - {ab})', p1)} END) + (CASE WHEN {b} = {ab} THEN 0 ELSE {side(f'({b} - {ab})', rest, p2)} END)"
    return f"-2 * (({null}) - ({free}))"


#: Words around each other, and what the counts say of them.
AROUND = rf"""WITH pieces AS (SELECT doc_id, unnest(l) AS piece, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(string_split({pre("coalesce(text, '')")}, ' '), lambda x: x <> '') AS l FROM documents)),
cores AS (SELECT *, regexp_replace(regexp_replace(piece, '^[(\["''«“„]+', ''), '[)\]"''»”,;:]+$', '') AS core FROM pieces),
stems AS (SELECT *, lower(regexp_replace(core, '[.!?…]+$', '')) AS stem FROM cores),
words AS (SELECT doc_id, i, piece, CASE WHEN regexp_matches(stem, '^[-+]?[0-9][0-9.,:/-]*$') THEN '##number##' ELSE stem END AS type,
          CASE WHEN regexp_matches(core, '[!?]$') THEN 'hard' WHEN regexp_matches(core, '(\.\.|…)$') THEN 'ellipsis' WHEN ends_with(core, '.') THEN 'stop' ELSE 'none' END AS ending,
          CASE WHEN regexp_matches(core, '^\p{{Lu}}') THEN 'upper' WHEN regexp_matches(core, '^\p{{Ll}}') THEN 'lower' ELSE 'none' END AS letter FROM stems),
near AS (SELECT *, lag(type) OVER w AS before, lag(ending) OVER w AS before_ending FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT type, ending, letter, before, before_ending, count(*) AS n FROM near GROUP BY ALL),
tally AS (SELECT type, CAST(sum(CASE WHEN ending = 'stop' THEN n ELSE 0 END) AS BIGINT) AS stops, CAST(sum(CASE WHEN ending <> 'stop' THEN n ELSE 0 END) AS BIGINT) AS plain FROM pairs GROUP BY type),
share AS (SELECT least(greatest(sum(stops) / sum(stops + plain), 1e-9), 1 - 1e-9) AS p, sum(stops + plain) AS whole FROM tally),
rated AS (SELECT type, stops, plain, CASE WHEN stops > 0 AND regexp_matches(type, '\p{{L}}') AND type <> '##number##' THEN
          -2 * (stops * (ln(p) - ln(0.99)) + plain * (ln(1 - p) - ln(1 - 0.99::DOUBLE))) * exp(-CAST(length(replace(type, '.', '')) AS DOUBLE))
          * (1 + length(type) - length(replace(type, '.', ''))) * pow(CAST(length(replace(type, '.', '')) AS DOUBLE), -plain) ELSE 0 END AS score FROM tally, share),
kinds AS (SELECT *, score >= 0.3 AS abbreviation FROM rated),
placed AS (SELECT pairs.*, CASE WHEN before IS NULL OR before_ending = 'hard' THEN 'first' WHEN before_ending = 'ellipsis' THEN 'unknown' WHEN before_ending = 'none' THEN 'inner'
           WHEN k.abbreviation THEN 'unknown' ELSE 'first' END AS place FROM pairs LEFT JOIN kinds k ON k.type = pairs.before),
first0 AS (SELECT type, CAST(sum(CASE WHEN place = 'first' AND before IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS at_first, CAST(sum(n) AS BIGINT) AS total FROM placed GROUP BY type),
first1 AS (SELECT *, CAST(sum(at_first) OVER () AS DOUBLE) AS a, CAST(total AS DOUBLE) AS b, CAST(at_first AS DOUBLE) AS ab, CAST(sum(total) OVER () AS DOUBLE) AS whole FROM first0),
first2 AS (SELECT *, {_ratio("a", "b", "ab", "whole")} AS score FROM first1 WHERE at_first > 0 AND regexp_matches(type, '^\p{{L}}')),
openers AS (SELECT type, at_first, total, score, whole / a > b / ab AND score >= 30 AS starter FROM first2),
near2 AS (SELECT before, type, sum(n) AS together FROM pairs WHERE before_ending = 'stop' AND regexp_matches(type, '[\p{{L}}#]') AND regexp_matches(before, '[\p{{L}}#]') GROUP BY ALL HAVING sum(n) > 1),
near3 AS (SELECT before, near2.type, CAST(together AS BIGINT) AS together, CAST(l.stops + l.plain AS DOUBLE) AS a, CAST(r.stops + r.plain AS DOUBLE) AS b, CAST(together AS DOUBLE) AS ab, CAST(whole AS DOUBLE) AS whole
          FROM near2 JOIN kinds l ON l.type = before JOIN kinds r ON r.type = near2.type, share WHERE l.abbreviation OR before = '##number##' OR regexp_matches(before, '^\p{{L}}$')),
near4 AS (SELECT *, {_ratio("a", "b", "ab", "whole")} AS score FROM near3),
together AS (SELECT before, type, together, score, whole / a > b / ab AND score >= 7.88 AS collocation FROM near4)"""
#: Words around a stop that ends no sentence.
STAYING = r"""cases AS (SELECT type, bool_or(letter = 'upper' AND place = 'inner') AS upper_inner, bool_or(letter = 'lower' AND place = 'first') AS lower_first,
          bool_or(letter = 'upper') AS any_upper, bool_or(letter = 'lower') AS any_lower FROM placed GROUP BY type),
asked AS (SELECT DISTINCT before, before_ending, type, letter FROM pairs WHERE before_ending IN ('stop', 'ellipsis')),
facts AS (SELECT asked.*, before_ending = 'ellipsis' AS dots, coalesce(k.abbreviation, false) OR before_ending = 'ellipsis' AS short, coalesce(c.collocation, false) AS drawn, coalesce(o.starter, false) AS opens,
          before_ending <> 'ellipsis' AND regexp_matches(asked.before, '^\p{L}$') AS initial, before_ending <> 'ellipsis' AND asked.before = '##number##' AS number, any_lower,
          CASE WHEN asked.letter = 'upper' AND any_lower AND NOT upper_inner THEN 1 WHEN asked.letter = 'lower' AND (any_upper OR NOT lower_first) THEN 0 END AS begins
          FROM asked LEFT JOIN kinds k ON k.type = asked.before LEFT JOIN together c ON c.before = asked.before AND c.type = asked.type LEFT JOIN openers o ON o.type = asked.type LEFT JOIN cases ON cases.type = asked.type),
verdict AS (SELECT *, CASE WHEN drawn AND NOT dots THEN false WHEN short AND NOT initial AND coalesce(begins, 0) = 1 THEN true WHEN short AND NOT initial AND letter = 'upper' AND opens THEN true
            WHEN (initial OR number) AND begins = 0 THEN false WHEN initial AND begins IS NULL AND letter = 'upper' AND NOT any_lower THEN false ELSE NOT short END AS ends FROM facts),
staying AS (SELECT before, before_ending, type, letter FROM verdict WHERE NOT ends)"""


def _viterbi(tokens: int = 5) -> str:
    """The best path token by token, in rows (vector, label), and back again."""
    ok = f"(NOT starts_with({NAMES}[1 + b.j], 'I-') OR (a.j > 0 AND {BASES}[1 + a.j] = {BASES}[1 + b.j]))"
    parts = [
        f"e AS (SELECT vec_id, k, j, CAST(embedding[k * 11 + j + 1] AS DOUBLE) AS s FROM embeddings, (SELECT unnest(range({tokens})) AS k), (SELECT unnest(range(11)) AS j))",
        f"v0 AS (SELECT vec_id, j, s + CASE WHEN starts_with({NAMES}[1 + j], 'I-') THEN -10000 ELSE 0 END AS s, 0 AS i FROM e WHERE k = 0)",
    ]
    for k in range(1, tokens):
        way = f"SELECT b.vec_id, b.j, b.s, a.j AS i, a.s + CASE WHEN {ok} THEN 0 ELSE -10000 END AS w FROM v{k - 1} a JOIN e b ON b.vec_id = a.vec_id AND b.k = {k}"
        parts.append(f"v{k} AS (SELECT vec_id, j, max(w) + any_value(s) AS s, min(i) FILTER (w = top) AS i FROM (SELECT *, max(w) OVER (PARTITION BY vec_id, j) AS top FROM ({way})) GROUP BY vec_id, j)")
    last = tokens - 1
    parts.append(f"p{last} AS (SELECT vec_id, min(j) AS j, CAST(min(j) AS VARCHAR) AS path FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS top FROM v{last}) WHERE s = top GROUP BY vec_id)")
    for k in range(last, 0, -1):
        parts.append(f"p{k - 1} AS (SELECT vec_id, v{k}.i AS j, v{k}.i || ' ' || path AS path FROM p{k} JOIN v{k} USING (vec_id, j))")
    parts.append("f AS (SELECT vec_id, string_agg(CAST(j AS VARCHAR), ' ' ORDER BY k) AS free FROM (SELECT vec_id, k, min(j) AS j FROM (SELECT *, max(s) OVER (PARTITION BY vec_id, k) AS top FROM e) WHERE s = top GROUP BY vec_id, k) GROUP BY vec_id)")
    return f"WITH {', '.join(parts)} SELECT vec_id, path, free FROM p0 JOIN f USING (vec_id)"


def _prefix(order: str, members: str = "true") -> str:
    exact = f"(lower(text) = '{NEEDLE}') DESC"
    by = {"aa": f"{exact}, text", "ad": f"{exact}, text DESC", "fd": f"amount DESC, {exact}, text", "fa": f"amount, {exact}, text"}[order]
    return f"{ITEMS} SELECT type_ru, text, amount, row_number() OVER (ORDER BY {by}, type_ru) AS rank FROM items WHERE starts_with(lower(text), '{NEEDLE}') AND {members}"


def _relevance(kind: str) -> str:
    place = "CASE m WHEN 'exact' THEN 0 WHEN 'partial' THEN 1 WHEN 'typeOnly' THEN 2 ELSE 3 END"
    return f"""{PAGE} SELECT type_ru, text, original_order, m AS match_type, m <> 'none' AS visible, row_number() OVER (ORDER BY m = 'none', {place}, original_order) AS rank
FROM (SELECT *, {kind} AS m FROM page)"""


MATCH = f"CASE WHEN text = '{NEEDLE}' THEN 'exact' WHEN contains(text, '{NEEDLE}') THEN 'partial' ELSE 'none' END"
PLACED = "CASE {m} WHEN 'exact' THEN 0 WHEN 'partial' THEN 1 WHEN 'typeOnly' THEN 2 ELSE 3 END"
KEY = "conv_id, turn, sent_no"
RULED = "(7 * length(token) + 3 * rn) % 11"
RESULTS = f"""{ENC},
good AS (SELECT {KEY} FROM enc WHERE err = 0),
pick AS (SELECT kept.*, {NAMES}[1 + {RULED}] AS label, CAST(sum(CASE WHEN starts_with(token, '##') THEN 0 ELSE 1 END) OVER (PARTITION BY {KEY} ORDER BY rn) AS BIGINT) AS word_no,
         CASE WHEN starts_with({NAMES}[1 + {RULED}], 'B-') THEN 0 WHEN starts_with({NAMES}[1 + {RULED}], 'I-') THEN 1 ELSE 2 END AS r FROM kept SEMI JOIN good USING ({KEY})),
main AS (SELECT {KEY}, word_no AS unit_no, string_agg(regexp_replace(token, '^##', ''), '' ORDER BY rn) AS w, min(start_b) AS start_b, max(end_b) AS end_b, arg_min(label, r * 1000000000 + rn) AS label FROM pick GROUP BY ALL),
word AS (SELECT main.*, sentence, decode(encode(sentence)[start_b + 1 : end_b]) AS unit, regexp_replace(label, '^[BI]-', '') AS base, {TYPES}[list_position({NAMES}, label)] AS ru, 0 AS start_c, 0 AS end_c
         FROM main JOIN sent USING ({KEY}) WHERE w NOT IN {MARK_LIST}),
{ents('b', False)}"""


def oracle_sql() -> dict[str, str]:
    none = "CAST(0 AS BIGINT)"
    return {
        "sentence_word_stats": f"WITH {sent('documents', 'doc_id, lang')} SELECT lang, count(*) AS sentences, CAST(sum({words('sentence')}) AS BIGINT) AS words FROM sent GROUP BY lang",
        "sanitize_text": f"""SELECT doc_id, md5(c) AS clean_md5, length(c) AS n, CASE WHEN c = '' THEN 'empty' WHEN length(text) > 0 AND length(c) < length(text) // 2 THEN 'shrunk' ELSE 'ok' END AS state
FROM (SELECT doc_id, text, {san('text')} AS c FROM documents)""",
        "preprocess_text": f"SELECT doc_id, md5(c) AS clean_md5, length(c) AS n FROM (SELECT doc_id, {pre('text')} AS c FROM documents)",
        "sentences_regex": f"WITH {sent('documents', 'doc_id')} SELECT doc_id, sent_no, sentence FROM sent",
        "sentences_scan": f"""SELECT conv_id, turn, unnest(range(1, len(s) + 1)) AS sent_no, unnest(s) AS sentence FROM (SELECT conv_id, turn,
list_filter(list_transform(regexp_extract_all({pre('text')}, '[^.!?]*[.!?]|[^.!?]+'), lambda x: regexp_replace(x, '^{ANY}+|{ANY}+$', '', 'g')), lambda x: x <> '') AS s FROM conversations)""",
        "sentences_dot_fallback": f"""SELECT conv_id, turn, unnest(range(1, len(s) + 1)) AS sent_no, unnest(s) || '.' AS sentence FROM (SELECT conv_id, turn,
list_filter(list_transform(string_split({pre('text')}, '.'), lambda x: regexp_replace(x, '^{ANY}+|{ANY}+$', '', 'g')), lambda x: x <> '') AS s FROM conversations)""",
        "punkt_neighbours": f"{AROUND} SELECT type, ending, letter, before, before_ending, n FROM pairs WHERE before_ending IN ('stop', 'ellipsis', 'hard')",
        "punkt_types": f"{AROUND} SELECT type, stops, plain, round(score, 4) + 0.0 AS score, abbreviation FROM kinds",
        "punkt_collocations": f"{AROUND} SELECT before, type, together, round(score, 3) + 0.0 AS score, collocation FROM together",
        "punkt_starters": f"{AROUND} SELECT type, at_first, total, round(score, 3) + 0.0 AS score, starter FROM openers",
        "sentences_punkt": f"""{AROUND}, {STAYING},
t AS (SELECT near.*, lead(type) OVER w AS next_type, lead(letter) OVER w AS next_letter FROM near WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT t.*, t.ending = 'hard' OR (t.ending IN ('stop', 'ellipsis') AND staying.type IS NULL) AS cut FROM t
      LEFT JOIN staying ON staying.before = t.type AND staying.before_ending = t.ending AND staying.type = t.next_type AND staying.letter = t.next_letter),
n AS (SELECT *, 1 + coalesce(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_no FROM e),
g AS (SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, string_agg(piece, ' ' ORDER BY i) AS s FROM n GROUP BY doc_id, sent_no)
SELECT doc_id, sent_no, md5(s) AS sentence_md5, length(s) AS n FROM g""",
        "unit_tokens": f"""SELECT unit, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all({san('text')}, '{UNIT}', 2)) AS unit FROM documents) GROUP BY unit""",
        "char_class_profile": f"""SELECT doc_id, len(u) AS units, len(list_filter(u, lambda x: x IN {MARK_LIST})) AS marks, len(regexp_extract_all(text, '{SP}')) AS spaces,
length(regexp_replace(text, '{MARKS}', '', 'g')) AS unmarked_chars, text = '' OR regexp_matches(text, '^{SP}') AS blank_first FROM (SELECT doc_id, text, regexp_extract_all(text, '{UNIT}', 2) AS u FROM documents)""",
        "cyrillic_lower": f"""WITH t AS (SELECT conv_id, turn, translate(text, 'abcdefghijklmnopqrstuvwxyzàéüß', 'АБЦДЕФГХИЙКЛМНОПЯРСТУВЩЫЧЗЁІЄЇ') AS s FROM conversations)
SELECT conv_id, turn, md5({low("s")}) AS lowered, md5(lower(s)) AS folded, len(regexp_extract_all(s, '[А-ЯЁІЄ]')) AS capitals FROM t""",
        "cyrillic_detect": f"""WITH {SAMPLE_CTE} SELECT 'sample' AS kind, i, regexp_matches(s, '[Ѐ-ӿ]') AS cyrillic FROM samples
UNION ALL SELECT 'document', doc_id, regexp_matches(text, '[Ѐ-ӿ]') FROM documents""",
        "string_primitives": f"""WITH {SAMPLE_CTE}, t AS (SELECT p_partkey AS i, concat_ws(' ', p_name, 'Ёжик', p_type) AS s FROM part UNION ALL SELECT i, s FROM samples),
o AS (SELECT i, s, list_transform(range(length(s)), lambda k: strlen(substring(s, 1, k))) AS offs FROM t)
SELECT i, s, length(s) AS chars, substring(s, 3, 1) AS third, substring(s, 2, 4) AS middle, instr(s, 'e') - 1 AS found,
CASE WHEN instr(substring(s, 6), 'e') > 0 THEN instr(substring(s, 6), 'e') + 4 ELSE -1 END AS found_later,
array_to_string(offs, ',') AS offsets, length(s) - len(list_filter(offs, lambda x: x >= 6)) AS at_byte, strlen(substring(s, 1, 1)) AS first_bytes FROM o""",
        "snippet_truncate": f"""WITH {CONV} SELECT conv_id, turn, sent_no, '• Предложение №' || sent_no || ': ' || CASE WHEN length(sentence) > 90 THEN left(sentence, 90) || '...' ELSE sentence END AS line FROM sent""",
        "highlight_mark": f"""SELECT conv_id, turn, md5(regexp_replace(text, '(?i)({NEEDLE})', '<mark>\\1</mark>', 'g')) AS marked_md5, len(regexp_extract_all(text, '(?i){NEEDLE}')) AS hits,
'<mark>c++</mark> <mark>C++</mark> (c)' AS literal FROM conversations""",
        "html_escape": "SELECT page_id, md5(e) AS escaped_md5, length(e) AS n FROM (SELECT page_id, replace(html, '\"', '&quot;') AS e FROM pages)",
        "file_sizes": "SELECT page_id, strlen(html) AS bytes, printf('%.2f', strlen(html) / 1048576) AS mb, strlen(html) <= 307200 AS accepted FROM pages",
        "label_decode": f"""WITH {UNITS},{label_cte('units', 'true')} SELECT lid AS label_id, label, base, base AS metric_class, ru AS type_ru, {role('ru')} AS role, count(*) AS n FROM word GROUP BY ALL""",
        "unit_offsets": f"WITH {UNITS} SELECT {KEY}, unit_no, unit, start_c, end_c, start_b, end_b, is_mark FROM units",
        "entities_bytes": f"{ENTS} SELECT {KEY}, ent_no, text, type, type_ru, start_b, end_b FROM ents",
        "entities_chars": f"{ENTS_C} SELECT {KEY}, ent_no, text, type, start_c, end_c FROM ents",
        "sentence_structure": f"""{ENTS_C} SELECT {KEY}, c AS cat_no, row_number() OVER (PARTITION BY {KEY} ORDER BY c, start_c) AS pos, text, type_ru
FROM (SELECT *, CAST(list_position(['SUBJECT','PREDICATE','ADVERBIAL','ADDITION','DEFINITION'], base) AS BIGINT) AS c FROM ents)""",
        "markup_stream": f"""{ENTS}, bounds AS (SELECT {KEY}, sentence, start_c, end_c, type_ru, lag(end_c, 1, 0) OVER (PARTITION BY {KEY} ORDER BY ent_no) AS was FROM ents),
ends AS (SELECT {KEY}, any_value(sentence) AS sentence, max(end_c) AS was, length(any_value(sentence)) AS start_c FROM ents GROUP BY {KEY}),
gaps AS (SELECT {KEY}, was + 1 AS pt, string_split(substring(sentence, was + 1, start_c - was), '') AS ch FROM bounds WHERE start_c > was UNION ALL SELECT {KEY}, was + 1, string_split(substring(sentence, was + 1), '') FROM ends WHERE start_c > was),
bits AS (SELECT {KEY}, start_c + 1 AS pt, substring(sentence, start_c + 1, end_c - start_c) AS piece, 'entity' AS kind, {role('type_ru')} AS role FROM bounds
         UNION ALL SELECT {KEY}, pt + k, c, 'gap', '' FROM (SELECT {KEY}, pt, unnest(range(len(ch))) AS k, unnest(ch) AS c FROM gaps) WHERE NOT regexp_matches(c, '^{ANY}$'))
SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY pt) - 1 AS piece_no, piece, kind, role, role = 'подл.' AS lit FROM bits""",
        "console_by_type": f"{ENTS} SELECT {KEY}, type_ru, string_agg(text, ', ' ORDER BY ent_no) AS texts FROM ents GROUP BY {KEY}, type_ru",
        "global_stats": f"""{ENTS} SELECT (SELECT count(*) FROM sent) AS sentences_total, (SELECT CAST(coalesce(sum({words('sentence')}), 0) AS BIGINT) FROM sent) AS words_total, count(*) AS members_total,
{', '.join(f"count(*) FILTER (type_ru = '{c}') AS total_{i}" for i, c in enumerate(CATEGORIES))} FROM ents""",
        "category_totals": f"{TOTALS} SELECT cat_no, type_ru, n FROM totals",
        "sentence_parts": f"""{ENTS}, {CATS_CTE}, kinds AS (SELECT CASE WHEN base = 'ADDITION' THEN 'другое' ELSE type_ru END AS k FROM ents) SELECT cat_no, type_ru, count(k) AS n FROM cats LEFT JOIN kinds ON k = type_ru GROUP BY ALL""",
        "category_share": f"{TOTALS} SELECT cat_no, type_ru, n, round(coalesce(n / nullif(sum(n) OVER (), 0), 0), 6) AS share, round(coalesce(n / nullif(sum(n) OVER (), 0), 0) * 100, 1) AS percent FROM totals",
        "top_member_per_category": f"""{ITEMS}, {CATS_CTE}, best AS (SELECT type_ru, text, amount, row_number() OVER (PARTITION BY type_ru ORDER BY amount DESC, text) AS r FROM items)
SELECT cat_no, cats.type_ru, CASE WHEN amount > 1 THEN text ELSE '-' END AS top_word, CASE WHEN amount > 1 THEN amount ELSE 0 END AS top_count FROM cats LEFT JOIN best ON best.type_ru = cats.type_ru AND r = 1""",
        "search_items": f"{ITEMS} SELECT type_ru, text, amount, n_sentences FROM items",
        "search_contexts": f"{ENTS} SELECT DISTINCT type_ru, lower(text) AS text, conv_id, turn, sent_no, sentence FROM ents",
        "file_totals": f"""{ENTS} SELECT s.conv_id, total_sentences, coalesce(total_entities, 0) AS total_entities FROM (SELECT conv_id, count(*) AS total_sentences FROM sent GROUP BY 1) s
LEFT JOIN (SELECT conv_id, count(*) AS total_entities FROM ents GROUP BY 1) e ON e.conv_id = s.conv_id""",
        "search_prefix_alpha_asc": _prefix("aa"),
        "search_prefix_alpha_desc": _prefix("ad"),
        "search_prefix_freq_desc": _prefix("fd", "type_ru IN ('подлежащее', 'сказуемое')"),
        "search_prefix_freq_asc": _prefix("fa", "type_ru = 'другое'"),
        "search_prefix_no_member": _prefix("aa", "false"),
        "search_relevance": _relevance(MATCH),
        "search_relevance_typed": _relevance("CASE WHEN type_ru = 'подлежащее' THEN 'typeOnly' ELSE 'none' END"),
        "search_prefix_stored": _prefix("fd"),
        "search_postings": f"""{PAGE}, m AS (SELECT *, CASE WHEN text = 'tion' THEN 'exact' ELSE 'partial' END AS match_type FROM page WHERE contains(text, 'tion'))
SELECT type_ru, text, original_order, match_type, row_number() OVER (ORDER BY match_type, original_order) AS rank FROM m""",
        "search_hit_stats": f"""{ITEMS}, s AS (SELECT count(*) FILTER (m = 'exact') AS exact, count(*) FILTER (m = 'partial') AS partial, {none} AS type_only FROM (SELECT {MATCH} AS m FROM items))
SELECT *, CASE WHEN exact + partial = 0 THEN '❌ Ничего не найдено' ELSE '✅ Найдено: ' || concat_ws(', ', CASE WHEN exact > 0 THEN exact || ' точных совпадений' END, CASE WHEN partial > 0 THEN partial || ' частичных совпадений' END) END AS message FROM s""",
        "search_relevance_again": f"""{PAGE}, first AS (SELECT *, row_number() OVER (ORDER BY {PLACED.format(m=MATCH)}, original_order) AS current FROM page),
second AS (SELECT *, CASE WHEN text = 'an' THEN 'exact' WHEN contains(text, 'an') THEN 'partial' ELSE 'none' END AS m FROM first)
SELECT type_ru, text, original_order, m AS match_type, m <> 'none' AS visible, row_number() OVER (ORDER BY {PLACED.format(m='m')}, current) AS rank FROM second""",
        "search_reset": f"{PAGE} SELECT type_ru, text, true AS visible, original_order + 1 AS rank FROM page",
        "vocabulary": f"{VOCAB} SELECT token, CAST(id AS BIGINT) AS id FROM vocab",
        "wordpiece_tokens": f"{PIECES} SELECT w AS word, string_agg(token, ' ' ORDER BY piece_no) AS pieces FROM pieces GROUP BY w",
        "subtoken_offsets": f"{SUBS} SELECT {KEY}, unit_no, CAST(piece_no AS BIGINT) AS piece_no, token, CAST(id AS BIGINT) AS id, start_b, end_b, CAST(err AS BIGINT) AS err FROM subs",
        "encode_padded": f"""{ENC} SELECT {KEY}, array_to_string(list_concat([101], ids, [102], list_transform(range(126 - len(ids)), lambda x: 0)), ' ') AS ids,
array_to_string(list_concat([-1], wids, [-1], list_transform(range(126 - len(ids)), lambda x: -1)), ' ') AS word_ids, CAST(err AS BIGINT) AS err FROM enc""",
        "attention_mask": f"{ENC} SELECT {KEY}, repeat('1', len(ids) + 2) || repeat('0', 126 - len(ids)) AS mask, len(ids) + 2 AS n FROM enc",
        "decode_roundtrip": f"{ENC} SELECT {KEY}, replace(array_to_string(tokens, ' '), ' ##', '') AS decoded FROM enc",
        "encode_unpadded": f"{ENC} SELECT {KEY}, len(ids) + 2 AS n, array_to_string(list_concat([101], ids, [102]), ' ') AS ids FROM enc",
        "encode_char_offsets": f"""{SUBS.replace("AS err", "AS err, CASE WHEN pieces.token = '[UNK]' THEN 0 ELSE start_c + p - 1 END AS from_c, CASE WHEN pieces.token = '[UNK]' THEN 0 ELSE start_c + p - 1 + n END AS to_c")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY unit_no, piece_no) AS rn FROM subs),
placed AS (SELECT {KEY}, list(from_c || '-' || to_c ORDER BY rn) AS x FROM ranked WHERE rn <= 126 GROUP BY ALL)
SELECT {KEY}, array_to_string(list_concat(['0-0'], x, ['0-0'], list_transform(range(126 - len(x)), lambda i: '0-0')), ' ') AS places FROM placed""",
        "sentence_results": f"""{RESULTS}, listing AS (SELECT {KEY}, count(*) AS n, md5(string_agg(concat_ws('|', text, type, type_ru, start_b, end_b), ';' ORDER BY ent_no)) AS x FROM ents GROUP BY {KEY}),
labs AS (SELECT {KEY}, string_agg(CAST({RULED} AS VARCHAR), ' ' ORDER BY rn) AS l, count(*) AS k FROM kept SEMI JOIN good USING ({KEY}) GROUP BY {KEY})
SELECT conv_id, turn, sent_no, sentence AS text, CAST(coalesce(err, 2) AS BIGINT) AS err, coalesce(n, 0) AS n, coalesce(x, md5('')) AS entities_md5,
coalesce('2 ' || l || ' ' || CAST((35 + 3 * (k + 1)) % 11 AS VARCHAR), '') AS labels FROM sent LEFT JOIN enc USING ({KEY}) LEFT JOIN listing USING ({KEY}) LEFT JOIN labs USING ({KEY})""",
        "analysis_totals": f"{RESULTS}, {CATS_CTE} SELECT cat_no, cats.type_ru, count(ents.type_ru) AS n FROM cats LEFT JOIN ents ON ents.type_ru = cats.type_ru GROUP BY ALL",
        "special_tokens_dropped": f"{ENC} SELECT token, count(*) AS n FROM kept GROUP BY token",
        "unknown_labels": f"WITH {UNITS} SELECT coalesce({NAMES}[1 + (7 * length(unit) + 3 * unit_no) % 13], 'O') AS label, count(*) AS n FROM units GROUP BY 1",
        "offset_repair": f"""WITH {UNITS}, hurt AS (SELECT {KEY}, unit_no, unit, CASE WHEN unit_no % 7 = 3 THEN 0 ELSE start_b END AS a, CASE WHEN unit_no % 7 = 3 THEN 0 ELSE end_b END AS b FROM units),
prev AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY {KEY} ORDER BY unit_no), 0) AS was FROM hurt)
SELECT {KEY}, unit_no, unit, a AS start_b, b AS end_b FROM prev WHERE NOT (a = 0 AND b = 0 AND was <> 0)""",
        "viterbi_labels": _viterbi(),
        "analysis_progress": "SELECT count(*) AS documents, count(*) AS processed, 100.0::DOUBLE AS percent FROM documents",
        "argmax_labels": f"SELECT vec_id, l AS label_id, {NAMES}[1 + l] AS label FROM (SELECT vec_id, CAST(list_position(embedding[1:11], list_max(embedding[1:11])) - 1 AS BIGINT) AS l FROM embeddings)",
        "subword_merge": f"""{LSUBS}, grp AS (SELECT *, CAST(sum(CASE WHEN starts_with(token, '##') THEN 0 ELSE 1 END) OVER (PARTITION BY {KEY} ORDER BY unit_no, piece_no) AS BIGINT) AS word_no,
CASE WHEN starts_with(label, 'B-') THEN 0 WHEN starts_with(label, 'I-') THEN 1 ELSE 2 END AS r FROM lab)
SELECT {KEY}, word_no, string_agg(regexp_replace(token, '^##', ''), '' ORDER BY unit_no, piece_no) AS word, min(start_b) AS start_b, max(end_b) AS end_b,
arg_min(label, r * 1000000000 + unit_no * 1000 + piece_no) AS main_label, bool_or(starts_with(label, 'B-')) AS has_b FROM grp GROUP BY {KEY}, word_no""",
        "bio_encode": f"""{WORDS} SELECT {KEY}, unit_no, base AS tag, CASE WHEN base = 'O' THEN 'O' WHEN base = lag(base) OVER (PARTITION BY {KEY} ORDER BY unit_no) THEN 'I-' || base ELSE 'B-' || base END AS bio FROM word""",
        "bio_violations": f"""{WORDS} SELECT {KEY}, unit_no, label FROM (SELECT *, lag(label) OVER (PARTITION BY {KEY} ORDER BY unit_no) AS b FROM word) WHERE starts_with(label, 'I-') AND (b IS NULL OR NOT ends_with(b, substring(label, 3)))""",
        "invalid_labels": f"{WORDS} SELECT DISTINCT CASE WHEN lid = 4 THEN 'X-' || base ELSE label END AS label FROM word WHERE lid = 4",
        "align_subtoken_labels": f"""{SUBS},{label_cte('units', 'NOT is_mark')},
lab AS (SELECT subs.*, coalesce(label, 'O') AS label, subs.token IN (',','.','!','?',';',':','-','(',')','''','"','``','''''') AS ign FROM subs LEFT JOIN word USING (conv_id, turn, sent_no, unit_no)),
prev AS (SELECT *, lag(ign) OVER (PARTITION BY {KEY}, unit_no ORDER BY piece_no) AS was FROM lab)
SELECT {KEY}, unit_no, CAST(piece_no AS BIGINT) AS piece_no, token, CAST(CASE WHEN ign THEN -100 WHEN piece_no = 0 OR was THEN list_position({NAMES}, label) - 1
WHEN starts_with(label, 'B-') THEN list_position({NAMES}, 'I-' || substring(label, 3)) - 1 ELSE 0 END AS BIGINT) AS aligned FROM prev""",
        "label_counts": f"{WORDS} SELECT base, count(*) FILTER (starts_with(label, 'B-')) AS b, count(*) FILTER (starts_with(label, 'I-')) AS i, count(*) AS total FROM word GROUP BY base",
        "base_class_counts": f"{WORDS} SELECT base AS class, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, base) AS rank FROM word GROUP BY base",
        "train_val_split": """SELECT doc_id, CASE WHEN r <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train' ELSE 'val' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS r, count(*) OVER () AS n FROM labels)""",
        "gold_span_align": f"""WITH {UNITS}, w0 AS (SELECT {KEY}, unnest(range(len(x))) AS pos, unnest(x) AS w FROM (SELECT *, string_split(sentence, ' ') AS x FROM sent)),
gold AS (SELECT *, {NAMES}[1 + (7 * length(w) + 3 * pos) % 11] AS label, sum(length(w) + 1) OVER (PARTITION BY {KEY} ORDER BY pos) - 1 AS e FROM w0)
SELECT u.conv_id, u.turn, u.sent_no, unit_no, unit, coalesce(label, 'O') AS true_label FROM units u LEFT JOIN gold g ON g.conv_id = u.conv_id AND g.turn = u.turn AND g.sent_no = u.sent_no AND u.start_c >= e - length(w) AND u.start_c < e""",
        "gold_evaluation": f"""WITH {UNITS}, w0 AS (SELECT {KEY}, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS odd, string_split(sentence, ' ') AS x FROM sent),
w1 AS (SELECT {KEY}, odd, unnest(range(len(x))) AS pos, unnest(x) AS w, len(x) AS k FROM w0),
gold AS (SELECT *, {NAMES}[1 + (7 * length(w) + 3 * pos) % 11] AS label, sum(length(w) + 1) OVER (PARTITION BY {KEY} ORDER BY pos) - 1 AS e FROM w1)
SELECT u.conv_id, u.turn, u.sent_no, unit_no AS pos, coalesce({NAMES}[1 + unit_no % 12], 'O') AS pred_label, coalesce(CASE WHEN u.conv_id % 3 = 0 THEN h.label ELSE g.label END, 'O') AS true_label
FROM units u LEFT JOIN gold g ON g.odd = 0 AND g.conv_id = u.conv_id AND g.turn = u.turn AND g.sent_no = u.sent_no AND u.start_c >= g.e - length(g.w) AND u.start_c < g.e
LEFT JOIN gold h ON h.odd = 1 AND h.conv_id = u.conv_id AND h.turn = u.turn AND h.sent_no = u.sent_no AND h.pos = u.unit_no AND h.pos < h.k - 1""",
        "masked_evaluation": f"""{ENC}, every AS (SELECT token, rn FROM kept UNION ALL SELECT '[CLS]', 0 FROM enc UNION ALL SELECT '[SEP]', len(ids) + 1 FROM enc)
SELECT {RULED} AS pred_id, (5 * length(token) + rn) % 11 AS true_id, count(*) AS n FROM every GROUP BY ALL""",
        "source_text_files": """SELECT page_id, strlen(html) + 1 AS size, CASE WHEN strlen(html) + 1 > 307200 THEN 'size' WHEN contains(html, chr(65533)) THEN 'utf8' ELSE 'ok' END AS state,
CASE WHEN strlen(html) + 1 <= 307200 AND NOT contains(html, chr(65533)) THEN md5(html || chr(10)) END AS text_md5 FROM pages""",
        "source_accepted_files": "SELECT page_id, md5(html || chr(10)) AS text_md5 FROM pages WHERE strlen(html) + 1 <= 307200 AND NOT contains(html, chr(65533))",
        "source_whole_texts": "SELECT md5(html || chr(10)) AS text_md5 FROM pages",
        "source_lines": "SELECT text, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS text FROM conversations) WHERE text <> '' GROUP BY text",
        "source_blank_labels": """SELECT replace(trim(l), ' ', '|') AS tokens, len(string_split(trim(l), ' ')) AS tags, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM conversations) WHERE l <> '' GROUP BY ALL""",
        "source_typed": f"""WITH {CONSOLE}, c AS (SELECT *, {san("text")} AS clean FROM lines WHERE NOT regexp_full_match(text, '{SP}*'))
SELECT doc_id, line_no, md5(clean) AS clean_md5, CASE WHEN clean = '' THEN 'empty' WHEN length(clean) < length(text) // 2 THEN 'shrunk' ELSE 'ok' END AS state FROM c""",
        "source_console_blank": f"""WITH {CONSOLE}, s AS (SELECT *, min(line_no) FILTER (text = '') OVER (PARTITION BY doc_id) AS stop FROM lines)
SELECT doc_id, count(*) AS n, max(line_no) AS last FROM s WHERE stop IS NULL OR line_no < stop GROUP BY doc_id""",
        "source_console_quit": f"""WITH {CONSOLE}, b AS (SELECT doc_id, line_no, regexp_replace(text, '^{SP}+|{SP}+$', '', 'g') AS t FROM lines),
s AS (SELECT *, min(line_no) FILTER (lower(t) IN ('exit', 'quit', 'q')) OVER (PARTITION BY doc_id) AS stop FROM b)
SELECT doc_id, count(*) AS n, max(line_no) AS last, CAST(sum(length(t)) AS BIGINT) AS chars FROM s WHERE (stop IS NULL OR line_no < stop) AND t <> '' GROUP BY doc_id""",
        "source_labelled": f"""WITH {UNITS},{label_cte('units', 'true')}, s AS (SELECT turn, string_agg(unit, ' ' ORDER BY unit_no) AS text, string_agg(label, ' ' ORDER BY unit_no) AS tags, count(*) AS k FROM word GROUP BY conv_id, turn, sent_no)
SELECT text, tags, count(*) AS n FROM s WHERE turn % 4 <> 0 GROUP BY text, tags""",
        "source_vocabulary": f"{VOCAB} SELECT token, row_number() OVER (ORDER BY id) - 1 AS id FROM vocab",
        "source_label_config": f"{WORDS} SELECT DISTINCT CAST(lid AS BIGINT) AS label_id, label, ru AS type_ru FROM word",
        "sink_results": f"""{ENTS}, e AS (SELECT {KEY}, count(*) AS n, string_agg(text || ':' || type_ru, '|' ORDER BY ent_no) AS x FROM ents GROUP BY {KEY})
SELECT conv_id, turn, conv_id || '/' || turn AS input_file, count(*) OVER w AS total_sentences, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS total_entities, sent_no, sentence, coalesce(x, '') AS entities
FROM sent LEFT JOIN e USING ({KEY}) WINDOW w AS (PARTITION BY conv_id, turn)""",
        "sink_item_cards": f"""{PAGE}, ctx AS (SELECT DISTINCT type_ru, lower(text) AS text, conv_id, turn, sent_no, sentence FROM ents),
c AS (SELECT type_ru, text, string_agg('<li>' || {esc('sentence')} || '</li>', '' ORDER BY conv_id, turn, sent_no) AS lis FROM ctx GROUP BY ALL)
SELECT original_order, md5('<details class="item" data-original-order="' || original_order || '" data-type="' || type_ru || '" data-text="' || {esc('text')} || '"><summary>' || {esc('text')} || ' (' || type_ru || ') × ' || amount || '</summary><ol>' || lis || '</ol></details>') AS html_md5
FROM page JOIN c USING (type_ru, text)""",
        "sink_listing": f"""{ENTS}, k AS (SELECT {KEY}, type_ru, string_agg(text, ', ' ORDER BY ent_no) AS texts FROM ents WHERE sent_no % 2 = 0 GROUP BY {KEY}, type_ru),
l AS (SELECT {KEY}, string_agg(type_ru || ': ' || texts, '; ' ORDER BY type_ru) AS line FROM k GROUP BY {KEY}) SELECT {KEY}, coalesce(line, 'No members found') AS line FROM sent LEFT JOIN l USING ({KEY})""",
        "sink_statistics": f"""{ITEMS}, {CATS_CTE}, best AS (SELECT type_ru, text, amount, row_number() OVER (PARTITION BY type_ru ORDER BY amount DESC, text) AS r FROM items),
totals AS (SELECT cat_no, cats.type_ru, count(ents.type_ru) AS n FROM cats LEFT JOIN ents ON ents.type_ru = cats.type_ru GROUP BY ALL)
SELECT (SELECT count(*) FROM sent) || ' ' || (SELECT CAST(coalesce(sum({words('sentence')}), 0) AS BIGINT) FROM sent) || ' ' || (SELECT count(*) FROM ents) AS totals, t.type_ru, n,
round(coalesce(n / nullif(sum(n) OVER (), 0), 0) * 100, 1) AS percent, CASE WHEN amount > 1 THEN {esc('text')} ELSE '-' END AS top_word, CASE WHEN amount > 1 THEN amount ELSE 0 END AS top_count
FROM totals t LEFT JOIN best ON best.type_ru = t.type_ru AND r = 1""",
        "sink_search_site": f"""{PAGE}, ctx AS (SELECT DISTINCT type_ru, lower(text) AS text, conv_id, turn, sent_no, sentence FROM ents),
lines AS (SELECT 'i' AS kind, original_order, 'i(' || original_order || ',' || to_json(text) || ',' || to_json(type_ru) || ',' || amount || ');' AS line FROM page
UNION ALL SELECT 'c', original_order, 'c(' || original_order || ',' || to_json(sentence) || ');' FROM page JOIN ctx USING (type_ru, text))
SELECT kind, original_order, count(*) AS n, md5(min(line)) AS first_md5, md5(max(line)) AS last_md5 FROM lines GROUP BY ALL""",
        "sink_report": f"{PRF} SELECT class, printf('%.4f', precision) AS precision, printf('%.4f', recall) AS recall, printf('%.4f', f1) AS f1, support FROM prf",
        "lead_bytes": """WITH b AS (SELECT p_partkey, hex(encode(concat_ws(' ', p_name, 'Ёжик—😀'))) AS h FROM part),
x AS (SELECT p_partkey, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substring(h, 2 * i + 1, 2) AS INT)) AS v FROM b)
SELECT p_partkey, array_to_string(list_transform(v, lambda c: CASE WHEN c < 128 THEN 1 WHEN c BETWEEN 192 AND 223 THEN 2 WHEN c BETWEEN 224 AND 239 THEN 3 WHEN c BETWEEN 240 AND 247 THEN 4 ELSE 0 END), '') AS widths FROM x""",
        "stream_phrase_counts": f"{ITEMS} SELECT type_ru, text AS word, amount AS n FROM items",
        "stream_top_members": f"""{ITEMS}, {CATS_CTE}, best AS (SELECT type_ru, text, amount, row_number() OVER (PARTITION BY type_ru ORDER BY amount DESC, text) AS r FROM items)
SELECT cat_no, cats.type_ru, CASE WHEN amount > 1 THEN text ELSE '-' END AS top_word, CASE WHEN amount > 1 THEN amount ELSE 0 END AS top_count FROM cats LEFT JOIN best ON best.type_ru = cats.type_ru AND r = 1""",
        "sink_evaluation": f"""{PRF} SELECT true AS dated, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support, round(avg(f1), 6) AS macro_f1,
(SELECT class FROM prf ORDER BY round(f1, 6) DESC, place LIMIT 1) AS best, (SELECT class FROM prf ORDER BY round(f1, 6), place LIMIT 1) AS worst, round(avg(f1) FILTER (class <> 'O'), 6) AS members_f1,
(SELECT count(*) FROM pairs) AS cells_total, count(*) + 2 AS report_lines FROM prf""",
        "confusion_matrix": f"{PAIRS} SELECT * FROM cells",
        "confusion_normalized": f"{PAIRS} SELECT *, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY true_class), 0), 0), 6) AS share FROM cells",
        "per_class_prf": f"{PRF} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, row_number() OVER (ORDER BY round(f1, 6) DESC, place) AS rank FROM prf",
        "weighted_prf": f"{PRF} SELECT round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM prf",
        "macro_best_worst": f"""{PRF} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
(SELECT class FROM prf ORDER BY round(f1, 6) DESC, place LIMIT 1) AS best, (SELECT class FROM prf ORDER BY round(f1, 6), place LIMIT 1) AS worst, round(max(f1) - min(f1), 6) AS gap FROM prf""",
    }
