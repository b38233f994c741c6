"""DuckDB SQL with the rows and column names of the catalogue's queries."""

from __future__ import annotations

from divit.functions.normalize import EASTERN, ROMAN, VOWELS, WORD
from divit.functions.ottoman import _CONSONANTS, APOSTROPHES, LATIN_SOUND, MACRON, NUMBER_TAIL, NUMBERS, PLAIN, SUFFIX_TAILS
from divit.operators.lexicon import FLAT_EXCLUDED

#: Keys that the queries add to the tables' words: circumflexes, macrons, apostrophes, doubles and number words.
GIVEN = ["âhiret", "kâr", "îman", "ûlâ", "mes'ul", "kur'an", "Ali'nin", "kādir", "‘ilim", "şiddet", "hürriyyet", "onbir", "yirmiüçüncü", "dördyüz", "birbiri", "kırkikinci"]

#: Numerals that roman_numbers adds.
NUMERALS = ["IX", "XIV", "IX", "xx", "IIII", "XX"]

_LOWER = "lower(translate({0}, 'İI', 'iı'))"
_FLAT = "translate({0}, 'âîûÂÎÛ', 'aiuAIU')"
_BARE = "replace(replace({0}, '''', ''), '’', '')"
#: DuckDB's edit distance counts bytes: letters beyond ASCII get a stand-in of one byte that no key holds.
_LETTERWISE = "translate({0}, 'äöüßéèêàçñóíáúœîïôûùæÿëâ’ğışìòãõ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456')"
_SKELETON = f"translate({{0}}, '{VOWELS}''’', '')"


def _tokens(name: str, source: str, keep: str = "") -> str:
    """Common table expressions: {name}_p (paragraphs) and {name} (tokens: keep, par, pos, w, k)."""
    keep = f"{keep}, " if keep else ""
    lines = f"SELECT {keep}unnest(range(len(a))) AS par, unnest(a) AS ptext FROM (SELECT {keep}string_split(text, chr(10)) AS a FROM {source})"
    word = WORD.replace("'", "''")
    return f"""{name}_p AS (SELECT * FROM ({lines}) WHERE trim(translate(ptext, chr(9) || chr(13), '  ')) <> ''),
{name} AS (SELECT {keep}par, pos, w, {_LOWER.format('w')} AS k FROM (
  SELECT {keep}par, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT {keep}par, regexp_extract_all(ptext, '{word}') AS ws FROM {name}_p)))"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_D = _tokens("d", "documents")
_DS = _tokens("d", "documents", "doc_id, source")
_B = _tokens("b", "benchmark")
_BW = "bw AS (SELECT DISTINCT k FROM b)"
_GIVEN_LIST = ", ".join("'" + g.replace("'", "''") + "'" for g in GIVEN)
_GIVEN = f"dg AS (SELECT k FROM dw UNION ALL SELECT unnest([{_GIVEN_LIST}]))"
_DW = "dw AS (SELECT DISTINCT k FROM d)"
_PAIRS = "pairs AS (SELECT k, w, count(*) AS n FROM d GROUP BY k, w)"


def _majority(name: str, pairs: str, share: float = 0.7, support: int = 3) -> str:
    return f"{name} AS (SELECT * FROM (SELECT k, max_by(w, row(n, w)) AS spelling, max(n) AS n, CAST(sum(n) AS BIGINT) AS total FROM {pairs} GROUP BY k) WHERE n >= {support} AND n >= total * CAST({share} AS DOUBLE))"


_AMBIGUOUS = """ranked AS (SELECT k, w, n, row_number() OVER (PARTITION BY k ORDER BY n DESC, w) AS r, sum(n) OVER (PARTITION BY k) AS total FROM pairs),
amb AS (SELECT * FROM (SELECT k, max(CASE WHEN r = 1 THEN w END) AS "first", max(CASE WHEN r = 1 THEN n END) AS n1, max(CASE WHEN r = 2 THEN w END) AS "second", max(CASE WHEN r = 2 THEN n END) AS n2, CAST(max(total) AS BIGINT) AS total FROM ranked WHERE r <= 2 GROUP BY k) WHERE total >= 6 AND n2 >= 3 AND n2 >= total * CAST(0.05 AS DOUBLE))"""
_LEX = ",\n".join([
    _tokens("c", "conversations"), "bp AS (SELECT k, w, count(*) AS n FROM b GROUP BY k, w)", "cp AS (SELECT k, w, count(*) AS n FROM c GROUP BY k, w)", _majority("bm", "bp", 0, 1), _majority("cm", "cp", 0, 1),
    "lex AS (SELECT k, spelling, 1 AS priority FROM bm UNION ALL SELECT k, spelling, 0 FROM cm WHERE k NOT IN (SELECT k FROM bm))"])
_NEAR = "near AS (SELECT *, coalesce(lag(k) OVER q, '#') AS l1, coalesce(lead(k) OVER q, '#') AS r1, coalesce(lag(k, 2) OVER q, '#') AS l2, coalesce(lead(k, 2) OVER q, '#') AS r2 FROM d WINDOW q AS (PARTITION BY doc_id, par ORDER BY pos))"
_UNKNOWN = "unknown AS (SELECT k FROM dw WHERE k NOT IN (SELECT k FROM bw))"
_BLOCKS = f"""blocks AS (SELECT u.k, bw.k AS entry FROM unknown u JOIN bw ON {_SKELETON.format('u.k')} = {_SKELETON.format('bw.k')} AND left(u.k, 1) = left(bw.k, 1)
WHERE length({_SKELETON.format('u.k')}) >= 2 AND u.k <> bw.k)"""
_ENDS = "ends AS (SELECT k, left(k, length(k) - size) AS root, right(k, size) AS suffix FROM dw, (SELECT unnest([2, 3, 4, 5, 6, 7, 8]) AS size) WHERE length(k) >= size + 2),\ncand AS (SELECT suffix, count(*) AS words FROM ends GROUP BY suffix HAVING count(*) >= 20)"

_CONTEXT = "l1, r1, l2, r2"
_FEATURES = "unnest(['L1:' || l1, 'R1:' || r1, 'L2:' || l2, 'R2:' || r2]) AS feature"


def _bayes(spots: str, work: bool, least: int, shown: str) -> str:
    """Common table expressions from seen (k, w, source, context, n): choice (the context of `spots`, usual, chosen, margin, evidence)."""
    by, on = (", source", " AND y.source = x.source") if work else ("", "")
    own, f_own = ("coalesce(y.n, 0)", "coalesce(y.n, 0)") if work else ("0", "0")
    join = f"LEFT JOIN sp y ON y.k = x.k AND y.c = t.c{on}" if work else ""
    f_join = f"LEFT JOIN feats y ON y.k = x.k AND y.c = x.c AND y.feature = x.feature{on}" if work else ""
    return f"""feats AS (SELECT k, w AS c{by}, feature, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, {_FEATURES} FROM seen) GROUP BY ALL),
f_all AS (SELECT k, c, feature, CAST(sum(n) AS BIGINT) AS n FROM feats GROUP BY ALL HAVING sum(n) >= {least}),
sp AS (SELECT k, w AS c{by}, CAST(sum(n) AS BIGINT) AS n FROM seen GROUP BY ALL),
ctx AS (SELECT DISTINCT k{by}, {_CONTEXT} FROM {spots}),
cands AS (SELECT x.*, t.c, t.n - {own} AS c_n FROM (SELECT DISTINCT k{by} FROM ctx) x JOIN (SELECT k, c, CAST(sum(n) AS BIGINT) AS n FROM sp GROUP BY ALL) t ON t.k = x.k {join}),
priors AS (SELECT *, ln(CAST(c_n AS DOUBLE) / CAST(sum(c_n) OVER (PARTITION BY k{by}) AS DOUBLE)) AS prior FROM cands WHERE c_n > 0),
met AS (SELECT x.*, coalesce(z.n, 0) - {f_own} AS f_n FROM (SELECT e.*, p.c, p.c_n, p.prior FROM (SELECT *, {_FEATURES} FROM ctx) e JOIN priors p USING (k{by})) x
  LEFT JOIN f_all z ON z.k = x.k AND z.c = x.c AND z.feature = x.feature {f_join}),
scored AS (SELECT m.k{by}, {_CONTEXT}, c, first(a."first") AS f, round(first(prior) + sum(ln((f_n + CAST(0.1 AS DOUBLE)) / (c_n + CAST(5 AS DOUBLE)))), 9) AS score, max({shown}) AS evidence
  FROM met m JOIN amb a ON m.k = a.k GROUP BY m.k{by}, {_CONTEXT}, c),
choice AS (SELECT k{by}, {_CONTEXT}, f, b.c AS chosen, round(b.score - base, 6) AS margin, b.evidence AS evidence FROM (
  SELECT k{by}, {_CONTEXT}, f, min_by({{'c': c, 'score': score, 'evidence': evidence}}, row(-score, c <> f, c)) AS b, max(score) FILTER (WHERE c = f) AS base FROM scored GROUP BY k{by}, {_CONTEXT}, f) WHERE base IS NOT NULL)"""


_SEEN = f"seen AS (SELECT k, w, source, {_CONTEXT}, count(*) AS n FROM near WHERE source IS NOT NULL AND k IN (SELECT k FROM amb) GROUP BY ALL)"
_TAKEN = "CASE WHEN margin >= {0} AND evidence >= 2 THEN chosen ELSE f END"
_OUTCOMES = _with(_DS, _NEAR, _PAIRS, _AMBIGUOUS, _SEEN, _bayes("seen", True, 1, "f_n"), f"""tried AS (SELECT *, {_TAKEN.format('threshold')} AS taken FROM
  (SELECT s.k, s.w, s.n, c.f, c.chosen, c.margin, c.evidence, CAST(unnest([1, 2, 3, 4, 5]) AS DOUBLE) AS threshold FROM seen s JOIN choice c USING (k, source, {_CONTEXT}))),
kinds AS (SELECT threshold, k, n, CASE WHEN taken = f AND w = f THEN 'kept_right' WHEN taken = f THEN 'kept_wrong' WHEN taken = w THEN 'fixed' WHEN w = f THEN 'broken' ELSE 'wrong_to_wrong' END AS outcome FROM tried)""")


def _index(derived: str, more: str = "") -> str:
    return _with(_D, _DW, _GIVEN) + f"SELECT derived, min(k) AS k FROM (SELECT {derived.format('k')} AS derived, k FROM dg) WHERE derived <> k AND derived NOT IN (SELECT k FROM dg){more} GROUP BY derived"


def _bigrams(name: str) -> str:
    return f"SELECT l1 || ' ' || k AS k FROM (SELECT k, lag(k) OVER (PARTITION BY {name}_id, par ORDER BY pos) AS l1 FROM {name}) WHERE l1 IS NOT NULL"


_EASTERN = f"translate(translate(translate(regexp_replace(regexp_replace(text, '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), ',;?', '،؛؟'), chr(1), ','), '{EASTERN[0]}', '{EASTERN[1]}')"
_NUMERALS = ", ".join(f"('{k}', {v})" for k, v in ROMAN.items())

_TYPES = _with(_DS, _PAIRS, _majority("m", "pairs", 0, 1), "ty AS (SELECT coalesce(d.source, '') AS source, d.k, d.w, count(*) AS n, any_value(m.spelling) = d.w AS hit FROM d JOIN m ON d.k = m.k GROUP BY ALL)").replace("GROUP BY ALL)", "GROUP BY 1, d.k, d.w)")


def _accuracy(by: str, name: str) -> str:
    return f"""SELECT "{name}", is_total, types, right_types, weight, right_weight, round(CAST(right_types AS DOUBLE) / types, 6) AS type_accuracy, round(CAST(right_weight AS DOUBLE) / weight, 6) AS accuracy FROM (
SELECT g AS "{name}", CAST(grouping(g) AS INTEGER) AS is_total, count(*) AS types, CAST(sum(CAST(hit AS BIGINT)) AS BIGINT) AS right_types, CAST(sum(n) AS BIGINT) AS weight, CAST(coalesce(sum(n) FILTER (WHERE hit), 0) AS BIGINT) AS right_weight FROM (SELECT *, {by} AS g FROM ty) GROUP BY ROLLUP (g))"""


def _once(text: str, letters: str) -> str:
    for c in letters:
        text = f"regexp_replace({text}, '{c}+', '{c}', 'g')"
    return text


_NAMES = "|".join(NUMBERS)

ORACLE: dict[str, str] = {
    "token_freq": _with(_D) + "SELECT k, count(*) AS n FROM d GROUP BY k",
    "token_freq_by_source": _with(_DS) + "SELECT k, source, count(*) AS n FROM d GROUP BY k, source",
    "top2_sources_per_word": _with(_DS) + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY n DESC, source) AS INTEGER) AS rank FROM (SELECT k, coalesce(source, '') AS source, count(*) AS n FROM d GROUP BY 1, 2)) WHERE rank <= 2",
    "vocab_minus_benchmark": _with(_D, _DW, _B, _BW) + "SELECT k FROM dw WHERE length(k) > 1 EXCEPT SELECT k FROM bw",
    "vocab_intersect_benchmark": _with(_D, _DW, _B, _BW) + "SELECT k FROM dw INTERSECT SELECT k FROM bw",
    "vocab_symdiff": _with(_D, _DW, _B, _BW) + "SELECT coalesce(dw.k, bw.k) AS k, CASE WHEN bw.k IS NULL THEN 'left' ELSE 'right' END AS side FROM dw FULL JOIN bw ON dw.k = bw.k WHERE dw.k IS NULL OR bw.k IS NULL",
    "pair_counts": _with(_D) + "SELECT k, w, count(*) AS n FROM d GROUP BY k, w",
    "majority_spelling": _with(_D, _PAIRS, _majority("m", "pairs")) + "SELECT k, spelling, n, total FROM m",
    "majority_expand_keys": _with(_D, _PAIRS, f"more AS (SELECT k, w, n FROM pairs UNION ALL SELECT g, g, 5 FROM (SELECT unnest([{_GIVEN_LIST}]) AS g))", _majority("m", "more")) + f"""SELECT derived, b.k AS k, b.spelling AS spelling, b.rank AS rank FROM (SELECT derived, min({{'rank': CAST(derived <> k AS INTEGER), 'k': k, 'spelling': spelling}}) AS b FROM (
  SELECT DISTINCT unnest([k, {_FLAT.format('k')}, {_BARE.format('k')}, {_FLAT.format(_BARE.format('k'))}]) AS derived, k, spelling FROM m) GROUP BY derived)""",
    "changed_spellings": _with(_D, _PAIRS, _majority("m", "pairs"), _B, "bp AS (SELECT k, w, count(*) AS n FROM b GROUP BY k, w)", _majority("bm", "bp", 0, 1)) + "SELECT m.k, bm.spelling AS before, m.spelling AS after, m.n FROM m JOIN bm ON m.k = bm.k WHERE m.spelling <> bm.spelling",
    "phrase_majority": _with(_DS, _NEAR, "pairs AS (SELECT l1 || ' ' || k AS k, w, count(*) AS n FROM near WHERE l1 <> '#' GROUP BY 1, 2)", _majority("m", "pairs")) + "SELECT k, spelling, n, total FROM m",
    "prioritized_lexicon": _with(_B, _LEX) + "SELECT k, spelling, priority FROM lex",
    "flat_index": _index(_FLAT, " AND length(derived) >= 4 AND derived NOT IN (" + ", ".join(f"'{x}'" for x in FLAT_EXCLUDED) + ")"),
    "apostrophe_index": _index(_BARE),
    "exact_or_flat_lookup": _with(_D, _DW, _B, _BW, f"soft AS (SELECT {_FLAT.format('k')} AS f, min(k) AS soft FROM bw GROUP BY 1)") + f"SELECT dw.k, coalesce(bw.k, soft) AS found, CASE WHEN bw.k IS NOT NULL THEN 'exact' WHEN soft IS NOT NULL THEN 'flat' ELSE 'none' END AS how FROM dw LEFT JOIN bw ON dw.k = bw.k LEFT JOIN soft ON {_FLAT.format('dw.k')} = f",
    "longest_prefix_root": _with(_D, _DW, _B, _BW) + "SELECT k, root, substring(k, length(root) + 1) AS suffix FROM (SELECT dw.k, max_by(bw.k, length(bw.k)) AS root FROM dw JOIN (SELECT unnest(range(1, 26)) AS cut) ON length(dw.k) - cut >= 3 JOIN bw ON bw.k = left(dw.k, length(dw.k) - CAST(cut AS INTEGER)) GROUP BY dw.k)",
    "phrase_ngram_join": _with(_tokens("d", "(SELECT doc_id AS d_id, text FROM documents)", "d_id"), _tokens("b", "(SELECT item_id AS b_id, text FROM benchmark)", "b_id")) + f"SELECT k, count(*) AS n FROM ({_bigrams('d')}) WHERE k IN ({_bigrams('b')}) GROUP BY k",
    "skeleton_blocks": _with(_D, _DW, _B, _BW, _UNKNOWN, _BLOCKS) + "SELECT k, entry FROM blocks",
    "fuzzy_top3_levenshtein": _with(_D, _DW, _B, _BW, _UNKNOWN, _BLOCKS) + f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY distance, entry) AS INTEGER) AS rank FROM (SELECT k, entry, CAST(levenshtein({_LETTERWISE.format('k')}, {_LETTERWISE.format('entry')}) AS INTEGER) AS distance FROM blocks)) WHERE rank <= 3",
    "ambiguous_keys": _with(_D, _PAIRS, _AMBIGUOUS) + 'SELECT k, "first", n1, "second", n2, total FROM amb',
    "work_separation": _with(_DS, _PAIRS, _AMBIGUOUS) + "SELECT k, count(*) AS works, round(CAST(sum(m) AS DOUBLE) / CAST(sum(t) AS DOUBLE), 6) AS share FROM (SELECT k, source, max(n) AS m, sum(n) AS t FROM (SELECT k, source, w, count(*) AS n FROM d WHERE k IN (SELECT k FROM amb) GROUP BY k, source, w) GROUP BY k, source) GROUP BY k",
    "context_features": _with(_DS, _NEAR, _PAIRS, _AMBIGUOUS) + "SELECT k, w, feature, count(*) AS n FROM (SELECT k, w, unnest(['L1:' || l1, 'R1:' || r1]) AS feature FROM near WHERE k IN (SELECT k FROM amb)) GROUP BY k, w, feature HAVING count(*) >= 2",
    "holdout_totals": _with(_DS, "c AS (SELECT k, w, source, count(*) AS n FROM d WHERE source IS NOT NULL GROUP BY k, w, source)") + "SELECT k, w, source, n, CAST(sum(n) OVER (PARTITION BY k, w) - n AS BIGINT) AS others FROM c",
    "loo_outcomes": _with(_DS, _NEAR, _PAIRS, _AMBIGUOUS, """seen AS (SELECT n.k, n.source, n.l1, n.r1, n.w, a."first" AS f, a."second" AS s FROM near n JOIN amb a ON n.k = a.k WHERE n.source IS NOT NULL AND (n.w = a."first" OR n.w = a."second")),
spots AS (SELECT k, source, l1, r1, w, f, s, count(*) AS n FROM seen GROUP BY ALL),
o AS (SELECT x.k, x.source, y.w, count(*) FILTER (WHERE y.source <> x.source) AS c FROM (SELECT DISTINCT k, source FROM spots) x JOIN seen y ON x.k = y.k GROUP BY ALL),
lo AS (SELECT x.k, x.source, x.l1, y.w, count(*) FILTER (WHERE y.source <> x.source) AS c FROM (SELECT DISTINCT k, source, l1 FROM spots) x JOIN seen y ON x.k = y.k AND x.l1 = y.l1 GROUP BY ALL),
ro AS (SELECT x.k, x.source, x.r1, y.w, count(*) FILTER (WHERE y.source <> x.source) AS c FROM (SELECT DISTINCT k, source, r1 FROM spots) x JOIN seen y ON x.k = y.k AND x.r1 = y.r1 GROUP BY ALL),
cands AS (SELECT *, f AS c, 1 AS side FROM spots UNION ALL SELECT *, s AS c, 2 AS side FROM spots),
scored AS (SELECT z.k, z.source, z.l1, z.r1, z.w, z.f, z.s, z.n, z.side, coalesce(o.c, 0) AS o, round(ln(coalesce(o.c, 0) + 1) + ln((coalesce(lo.c, 0) + 1) / CAST(coalesce(o.c, 0) + 2 AS DOUBLE)) + ln((coalesce(ro.c, 0) + 1) / CAST(coalesce(o.c, 0) + 2 AS DOUBLE)), 9) AS score
  FROM cands z LEFT JOIN o ON z.k = o.k AND z.source = o.source AND z.c = o.w LEFT JOIN lo ON z.k = lo.k AND z.source = lo.source AND z.l1 = lo.l1 AND z.c = lo.w LEFT JOIN ro ON z.k = ro.k AND z.source = ro.source AND z.r1 = ro.r1 AND z.c = ro.w),
chosen AS (SELECT w, n, CASE WHEN max(score) FILTER (WHERE side = 2) > max(score) FILTER (WHERE side = 1) THEN s ELSE f END AS chosen, CASE WHEN max(o) FILTER (WHERE side = 2) > max(o) FILTER (WHERE side = 1) THEN s ELSE f END AS major FROM scored GROUP BY k, source, l1, r1, w, f, s, n)""")
    + "SELECT CASE WHEN chosen = w AND major = w THEN 'both_right' WHEN chosen = w THEN 'fixed' WHEN major = w THEN 'broken' ELSE 'both_wrong' END AS outcome, CAST(sum(n) AS BIGINT) AS n FROM chosen GROUP BY 1",
    "nb_choice": _with(_DS, _NEAR, _PAIRS, _AMBIGUOUS, _SEEN, _tokens("c", "conversations", "conv_id, turn"), _NEAR.replace("near AS", "talk_near AS").replace("FROM d ", "FROM c ").replace("doc_id", "conv_id, turn"),
                       "talk AS (SELECT * FROM talk_near WHERE k IN (SELECT k FROM amb))", _bayes("talk", False, 2, "CASE WHEN feature[4:] <> '#' THEN f_n ELSE 0 END"))
    + f"SELECT k, {_CONTEXT}, chosen, margin, evidence, {_TAKEN.format('1')} AS taken FROM choice",
    "nb_outcomes": _OUTCOMES + "SELECT threshold, outcome, CAST(sum(n) AS BIGINT) AS n FROM kinds GROUP BY ALL",
    "threshold_pick": _OUTCOMES + """, sums AS (SELECT threshold, k, coalesce(sum(n) FILTER (WHERE outcome = 'fixed'), 0) AS good, coalesce(sum(n) FILTER (WHERE outcome IN ('broken', 'wrong_to_wrong')), 0) AS bad FROM kinds GROUP BY ALL),
kept AS (SELECT threshold, count(*) AS words, CAST(sum(good) AS BIGINT) AS fixed FROM sums WHERE bad = 0 AND good >= 3 GROUP BY threshold),
every AS (SELECT e.threshold, coalesce(words, 0) AS words, coalesce(fixed, 0) AS fixed FROM (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS DOUBLE) AS threshold) e LEFT JOIN kept ON e.threshold = kept.threshold)
SELECT threshold, words, fixed, row_number() OVER (ORDER BY fixed DESC, threshold) = 1 AS picked FROM every""",
    "foreign_islands": _with(_DS, _B, _BW) + "SELECT doc_id, par, min(pos) AS first_pos, count(*) AS length FROM (SELECT doc_id, par, pos, pos - row_number() OVER (PARTITION BY doc_id, par ORDER BY pos) AS run FROM d WHERE k NOT IN (SELECT k FROM bw)) GROUP BY doc_id, par, run HAVING count(*) >= 2",
    "concordance_5": _with(_DS, _B, _BW, "near5 AS (SELECT *, " + ", ".join(f"coalesce({f}(k, {i}) OVER q, '#') AS {t}{i}" for f, t in (("lag", "l"), ("lead", "r")) for i in range(1, 6)) + " FROM d WINDOW q AS (PARTITION BY doc_id, par ORDER BY pos))")
    + "SELECT doc_id, par, pos, k, concat_ws(' ', l5, l4, l3, l2, l1, w, r1, r2, r3, r4, r5) AS line FROM near5 WHERE k IN (SELECT k FROM bw)",
    "suffix_candidates": _with(_D, _DW, _ENDS) + "SELECT suffix, words FROM cand",
    "root_vote": _with(_D, _DW, _ENDS) + "SELECT root, count(*) AS evidence FROM ends WHERE suffix IN (SELECT suffix FROM cand) AND root IN (SELECT k FROM dw) GROUP BY root HAVING count(*) >= 2",
    "kfold_accuracy": _with(_D, _PAIRS, "top AS (SELECT k, CAST(max_by(w, row(n, w)) <> k AS BIGINT) AS cap, right(k, 3) AS e, CAST('0x' || left(md5(k), 6) AS BIGINT) % 5 AS fold FROM pairs WHERE length(k) > 3 GROUP BY k)", "g AS (SELECT x.e, x.fold, CAST(coalesce(sum(y.cap), 0) * 2 > count(y.k) AS BIGINT) AS guess FROM (SELECT DISTINCT e, fold FROM top) x LEFT JOIN top y ON x.e = y.e AND x.fold <> y.fold GROUP BY x.e, x.fold)") + 'SELECT t.fold, count(*) AS words, CAST(sum(CAST(g.guess = t.cap AS BIGINT)) AS BIGINT) AS "right" FROM top t JOIN g ON t.e = g.e AND t.fold = g.fold GROUP BY t.fold',
    "train_minus_test_paragraphs": _with(_DS, "p AS (SELECT doc_id, par, trim(regexp_replace(ptext, '[ \\t\\r\\n]+', ' ', 'g')) AS norm, right(source, 1) IN ('0', '2', '4', '6', '8') AS test FROM d_p WHERE source IS NOT NULL)") + "SELECT doc_id, par FROM p WHERE NOT test AND norm NOT IN (SELECT norm FROM p WHERE test)",
    "coverage_rollup": _with(_tokens("d", "documents", "lang"), _B, _LEX) + "SELECT lang, is_total, tokens, covered, round(CAST(covered AS DOUBLE) / tokens, 6) AS ratio FROM (SELECT x.lang, CAST(grouping(x.lang) AS INTEGER) AS is_total, count(*) AS tokens, count(lex.k) AS covered FROM (SELECT coalesce(lang, '') AS lang, k FROM d) x LEFT JOIN lex ON x.k = lex.k GROUP BY ROLLUP (x.lang))",
    "stratified_estimate": _with(_D, _B, _BW, "r AS (SELECT k, CAST(count(*) AS DOUBLE) AS n, k NOT IN (SELECT k FROM bw) AS wrong FROM d GROUP BY k)", "s AS (SELECT coalesce(sum(n) FILTER (WHERE n >= 200 AND wrong), 0) AS e, avg(CAST(wrong AS DOUBLE)) FILTER (WHERE n < 200) AS t, coalesce(sum(n) FILTER (WHERE n < 200), 0) AS m, sum(n) AS a FROM r)") + "SELECT round((e + t * m) / a, 6) AS error_rate, round(t, 6) AS tail_rate FROM s",
    "line_diff_keys": _with(_DS) + "SELECT md5(ptext) AS line, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM d_p GROUP BY ptext HAVING count(DISTINCT doc_id) > 1",
    "eastern_digit_texts": f"SELECT doc_id, {_EASTERN} AS text FROM documents",
    "roman_numbers": _with(_D) + f"SELECT CAST(value AS BIGINT) AS value, count(*) AS n FROM (SELECT w FROM d UNION ALL SELECT unnest({NUMERALS})) AS x JOIN (VALUES {_NUMERALS}) AS r(numeral, value) ON x.w = r.numeral GROUP BY 1",
    "chapter_chunks": _with(_DS) + "SELECT doc_id, chapter, count(*) AS n_lines, md5(string_agg(ptext, chr(10) ORDER BY i)) AS body_md5 FROM (SELECT *, CAST((i - 1) // 200 + 1 AS BIGINT) AS chapter FROM (SELECT doc_id, ptext, row_number() OVER (PARTITION BY doc_id ORDER BY par) AS i FROM d_p)) GROUP BY doc_id, chapter",
    "registry_latest": "SELECT conv_id, role, max_by(text, row(turn, text)) AS text, max(turn) AS turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, role",
    "unknown_rank": _with(_D, _B, _LEX) + "SELECT k, count(*) AS n, max(CAST(w = k AS INTEGER)) AS lower FROM d WHERE k NOT IN (SELECT k FROM lex) GROUP BY k ORDER BY n DESC, k LIMIT 100000",
    "verse_lookup": "SELECT a.conv_id, a.turn AS from_turn, b.turn, b.text FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1",
    "word_forms": _with(_D, f"ws AS (SELECT DISTINCT w FROM d UNION ALL SELECT unnest([{_GIVEN_LIST}]))", f"ks AS (SELECT w, translate({_LOWER.format('w')}, '’`ʼ', '''''''') AS key FROM ws)")
    + f"""SELECT w, key, translate(key, '{PLAIN[0]}', '{PLAIN[1]}') AS plain,
CASE WHEN len(string_split(key, '''')) = 2 AND string_split(key, '''')[1] <> '' AND string_split(key, '''')[2] <> '' AND string_split(key, '''')[2] NOT IN ({', '.join(f"'{x}'" for x in SUFFIX_TAILS)}) THEN replace(key, '''', '') END AS hamza_less,
translate(w, '{MACRON[0]}', '{MACRON[1]}') AS circumflex, trim(regexp_replace(translate({_LOWER.format('w')}, '{APOSTROPHES}‐', '{"''" * len(APOSTROPHES)}-'), '\\s+', ' ', 'g')) AS phrase,
translate(regexp_replace({_once('key', LATIN_SOUND[0])}, '[^{LATIN_SOUND[0]}]', '', 'g'), '{LATIN_SOUND[0]}', '{LATIN_SOUND[1]}') AS sound,
{_once(f"regexp_replace({_FLAT.format(_LOWER.format('w'))}, '[^{_CONSONANTS}]', '', 'g')", _CONSONANTS.replace('y', ''))} AS consonants,
translate({_once(f"regexp_replace({_FLAT.format('lower(w)')}, '[^a-zçğışöü]', '', 'g')", 'abcdefghijklmnopqrstuvwxyzçğş')}, 'aeıioöuü', '') AS skeleton FROM ks""",
    "soft_stem_lookup": _with(_D, _DW, "lx AS (SELECT k FROM dw WHERE right(k, 1) IN ('k', 'p', 'ç'))") + "SELECT k, stem FROM (SELECT k, left(k, length(k) - 1) || translate(right(k, 1), 'ğbc', 'kpç') AS stem FROM dw WHERE right(k, 1) IN ('ğ', 'b', 'c')) WHERE stem IN (SELECT k FROM lx) AND k NOT IN (SELECT k FROM lx)",
    "number_words": _with(_D, _DW, _GIVEN, f"h AS (SELECT k, regexp_extract(k, '^(?:{_NAMES})+') AS head FROM dg)", f"p AS (SELECT k, regexp_extract_all(head, '{_NAMES}') AS parts, substring(k, length(head) + 1) AS rest FROM h)")
    + f"SELECT k, array_to_string(parts, ' ') || rest AS parts FROM p WHERE len(parts) >= 2 AND regexp_full_match(rest, '(?:{NUMBER_TAIL})?') AND NOT list_contains(parts[:-2], 'dörd') AND NOT (parts[1] = 'bir' AND parts[2] = 'bir')",
    "weighted_accuracy": _TYPES + _accuracy("least(length(k), 12)", "size"),
    "work_total_rollup": _TYPES + _accuracy("source", "source"),
}
