"""DuckDB SQL with the rows and column names of the text engine's queries."""

from __future__ import annotations

from divit.functions.normalize import CIRCUMFLEX, LETTERS, ROMAN
from divit.functions.ottoman import APOSTROPHES
from divit.functions.verb_endings import NEGATED, NO_VERB, endings
from divit.functions.suffixes import ALL_VOWELS, BACK, CONSONANTS, HARD, POSSESSIVE_CASE, forms, suffix_rows, transitions
from divit.operators.lexicon import FLAT_EXCLUDED
from divit.operators.phrases import SUFFIXED
from divit.operators.suffix_chains import LONGEST, PEELED_ONLY
from divit.operators.variants import HARDENED, PLACES, ROUNDED
from divit.plans.oracle import _AMBIGUOUS, _DS, _NEAR
from divit.plans.oracle import _PAIRS as _PAIRS_ALL
from divit.plans.oracle import _B, _BW, _D, _DW, _LOWER, _tokens

#: Accented letters of the tables' languages and their plain forms; words that own, words that come between, and words that turn an owner to themselves.
ACCENTS = ("äöüéèêàçñóíáúîïôûùëâ", "aoueeeacnoiauiiouuea")
ARTICLES, BLOCKERS, TURNERS = ("the", "la", "der", "die", "le", "el"), ("it", "that", "this", "en", "er", "un"), ("of", "de", "von")


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_ROWS = suffix_rows()
_STEPS = "steps(slot, suffix, nxt) AS (VALUES " + ", ".join(f"({a}, '{s}', {b})" for a, s, b in transitions()) + ")"
_TRIED = """tried AS (SELECT * FROM (SELECT k, left(k, n) AS root, substring(k, n + 1) AS tail FROM (SELECT k, unnest(range(3, length(k))) AS n FROM dw WHERE length(k) > 3))
WHERE root IN (SELECT k FROM bw) AND k NOT IN (SELECT k FROM bw)),
tails AS (SELECT DISTINCT tail FROM tried)"""


def _walk(most: int, width: int, nouns: bool) -> str:
    also = " AND left(s.suffix, 1) NOT IN ('c', 'ç')" if nouns else ""
    return f"""walk(tail, a, slot, parts, sizes) AS (SELECT tail, 0, 0, CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]) FROM tails UNION ALL
SELECT w.tail, w.a + length(s.suffix), s.nxt, list_append(w.parts, s.suffix), list_append(w.sizes, length(s.suffix)) FROM walk w JOIN steps s ON s.slot = w.slot AND substring(w.tail, w.a + 1, length(s.suffix)) = s.suffix
WHERE len(w.parts) < {most} AND length(s.suffix) <= {width}{also}),
chains AS (SELECT tail, max_by(parts, sizes) AS parts FROM walk WHERE a = length(tail) GROUP BY tail)"""


_HARD_T, _FINAL, _SETTLED, _COPULA = ([r[0] for r in _ROWS if r[4]], [r[0] for r in _ROWS if r[5]], [r[0] for r in _ROWS if r[6]], [r[0] for r in _ROWS if r[1] == 40])
_ROOTED = f"""fit AS (SELECT k, t.root, c.parts FROM tried t JOIN chains c ON c.tail = t.tail
WHERE (c.parts[1] NOT IN ({_quoted(_HARD_T)}) OR right(t.root, 1) IN ({_quoted(HARD)})) AND NOT (right(t.root, 1) IN ({_quoted(ALL_VOWELS)}) AND left(c.parts[1], 1) IN ('t', 'ç'))
AND NOT (right(t.root, 3) IN ('lar', 'ler') AND left(c.parts[1], 1) IN ('ı', 'i')) AND (len(c.parts) < 3 OR length(t.root) >= 4)),
rooted AS (SELECT k, max_by(root, length(root)) AS root, max_by(parts, length(root)) AS parts FROM fit GROUP BY k)"""

_KNOWN = "known(suffix) AS (VALUES " + ", ".join(f"('{r[0]}')" for r in _ROWS) + ")"
_SPLIT = f"""pieces AS (SELECT tail, a, b, substring(tail, a + 1, b - a) AS suffix FROM (SELECT tail, a, unnest(range(a + 1, least(length(tail), a + {LONGEST}) + 1)) AS b FROM (SELECT tail, unnest(range(0, length(tail))) AS a FROM tails)) WHERE substring(tail, a + 1, b - a) IN (SELECT suffix FROM known)),
one AS (SELECT tail, a, [suffix] AS parts FROM pieces WHERE b = length(tail)),
two AS (SELECT p.tail, p.a, max_by([p.suffix, o.parts[1]], p.b) AS parts FROM pieces p JOIN one o ON o.tail = p.tail AND o.a = p.b JOIN steps s1 ON s1.slot = 0 AND s1.suffix = p.suffix JOIN steps s2 ON s2.slot = s1.nxt AND s2.suffix = o.parts[1]
  WHERE NOT EXISTS (SELECT 1 FROM one x WHERE x.tail = p.tail AND x.a = p.a) GROUP BY p.tail, p.a),
rest AS (SELECT * FROM one UNION ALL SELECT * FROM two),
three AS (SELECT p.tail, max_by(list_prepend(p.suffix, o.parts), p.b) AS parts FROM pieces p JOIN rest o ON o.tail = p.tail AND o.a = p.b JOIN steps s1 ON s1.slot = 0 AND s1.suffix = p.suffix JOIN steps s2 ON s2.slot = s1.nxt AND s2.suffix = o.parts[1]
  LEFT JOIN steps s3 ON s3.slot = s2.nxt AND s3.suffix = o.parts[2] WHERE p.a = 0 AND (len(o.parts) = 1 OR s3.nxt IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM one x WHERE x.tail = p.tail AND x.a = 0) GROUP BY p.tail),
split3 AS (SELECT tail, parts FROM one WHERE a = 0 UNION ALL SELECT tail, parts FROM three)"""


def _peel(rounds: int = 3) -> str:
    """Common table expressions p0 .. p{rounds}: words whose rest isn't known yet, with their rest and the parts peeled off."""
    names = [r[0] for r in _ROWS if r[7]] + list(PEELED_ONLY)
    out = ["peel(suffix, hard) AS (VALUES " + ", ".join(f"('{n}', {str(n in _HARD_T).lower()})" for n in names) + ")", "p0 AS (SELECT k, k AS rest, CAST([] AS VARCHAR[]) AS parts FROM dw)"]
    for i in range(rounds):
        out.append(f"""p{i + 1} AS (SELECT k, max(c).rest AS rest, max(c).parts AS parts FROM (SELECT k, row(hit, CASE WHEN hit THEN -n ELSE n END, cut, ps)::STRUCT(hit BOOLEAN, "by" BIGINT, rest VARCHAR, parts VARCHAR[]) AS c FROM (
SELECT p.k, length(s.suffix) AS n, left(p.rest, length(p.rest) - length(s.suffix)) AS cut, list_prepend(s.suffix, p.parts) AS ps, left(p.rest, length(p.rest) - length(s.suffix)) IN (SELECT k FROM bw) AS hit
FROM (SELECT * FROM p{i} WHERE rest NOT IN (SELECT k FROM bw)) p JOIN peel s ON right(p.rest, length(s.suffix)) = s.suffix AND length(p.rest) - length(s.suffix) >= 2
WHERE NOT s.hard OR substring(p.rest, length(p.rest) - length(s.suffix), 1) IN ({_quoted(HARD)}))) GROUP BY k)""")
    found = " UNION ALL ".join(f"SELECT k, rest AS root, parts FROM p{i} WHERE rest IN (SELECT k FROM bw)" for i in range(rounds + 1))
    return ",\n".join(out) + f",\npeeled AS ({found})"


_VERBS = f"""endings(ending, spelling, condition) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in endings())}),
verbs AS (SELECT k, max_by(row(stem, ending, spelling)::STRUCT(stem VARCHAR, ending VARCHAR, spelling VARCHAR), row(length(ending), condition)) AS b FROM (SELECT dw.k, left(dw.k, length(dw.k) - length(e.ending)) AS stem, substring(dw.k, length(dw.k) - length(e.ending), 1) AS last, e.* FROM dw JOIN endings e ON right(dw.k, length(e.ending)) = e.ending AND length(dw.k) - length(e.ending) >= 2)
WHERE regexp_matches(stem, '[aeıioöuü]') AND CASE condition WHEN 'vowel' THEN last IN ({_quoted('aeıioöuü')}) WHEN 'consonant' THEN last NOT IN ({_quoted('aeıioöuü')}) WHEN 'hard' THEN last IN ({_quoted(HARD)}) WHEN 'soft' THEN last NOT IN ({_quoted(HARD)}) WHEN 'r' THEN last = 'r' ELSE true END
AND (ending NOT IN ({_quoted(NEGATED)}) OR right(stem, 2) IN ('me', 'ma')) AND NOT (ending IN ({_quoted(NO_VERB)}) AND right(stem, 2) = 'ek' AND length(stem) >= 5) GROUP BY k)"""


def _by_letter(s: str, back: str) -> str:
    inner = f"translate(left({s}, length({s}) - 1), 'oöuüûiıîaâe', 'وووووییی' || 'اا')"
    last = f"translate(right({s}, 1), 'oöuüûiıîaeâ', 'وووووییی' || 'ههاا')"
    both = f"replace(translate({inner} || {last}, '{CONSONANTS[0]}', '{CONSONANTS[1]}'), 'x', 'كس')"
    return f"CASE WHEN {back} THEN translate({both}, 'kgğ', 'قغغ') ELSE translate({both}, 'kgğ', 'كگگ') END"


def _spelled(root: str, parts: str, sound: str) -> str:
    """The spelling of the chain `parts` (never empty) after `root`."""
    fixed = "MAP {" + ", ".join(f"'{r[0]}': '{r[3]}'" for r in _ROWS) + "}"
    joint = "MAP {" + ", ".join(f"'{f}': '{sp}'" for p, sp in POSSESSIVE_CASE for f in forms(p, "ıiuü")) + "}"
    back = f"regexp_extract({root}, '([{ALL_VOWELS}])[^{ALL_VOWELS}]*$', 1) IN ('', {_quoted(BACK)})"
    before = f"right(CASE WHEN i = 1 THEN {root} ELSE {parts}[i - 1] END, 1)"
    fits = f"(s NOT IN ({_quoted(_HARD_T)}) OR {before} IN ({_quoted(HARD)})) AND (s NOT IN ({_quoted(_FINAL)}) OR i = len({parts}) OR {parts}[i + 1] IN ({_quoted(_COPULA)})) AND ({sound} OR s IN ({_quoted(_SETTLED)}))"
    one = f"CASE WHEN s IN ('ler', 'lar') THEN 'لر' WHEN {fits} THEN {fixed}[s] ELSE {_by_letter('s', back)} END"
    lone = f"len({parts}) = 1 AND {parts}[1] IN ('u', 'ü') AND right({root}, 1) NOT IN ({_quoted('aeıioöuü')})"
    return f"coalesce({joint}[array_to_string({parts}, '')], CASE WHEN {lone} THEN 'ی' END, array_to_string(list_transform({parts}, lambda s, i: {one}), ''))"


_SLOTTED = """slots AS (SELECT r.k, r.root, r.parts, length(r.root) >= 4 OR (length(r.root) = 3 AND list_min(list_transform(r.parts, lambda s: length(s))) >= 2) AS sound FROM rooted r)"""

_PHRASE_KEY = f"trim(regexp_replace(translate({_LOWER.format('ptext')}, '{APOSTROPHES}‐', '{chr(39) * 2 * len(APOSTROPHES)}-'), '\\s+', ' ', 'g'))"


def _runs(name: str, source: str, keep: str) -> str:
    """Common table expressions {name}_w: keep, par, words and gaps of each paragraph in normal form."""
    key = f"regexp_replace({_PHRASE_KEY}, '^[^{LETTERS}]+', '')"
    return f"{name}_w AS (SELECT {keep}, par, regexp_extract_all(key, '[{LETTERS}]+') AS words, regexp_extract_all(key, '[{LETTERS}]+([^{LETTERS}]*)', 1) AS gaps FROM (SELECT {keep}, par, {key} AS key FROM {source}_p))"


_SPANS = ",\n".join([
    _tokens("d", "documents", "doc_id"), _tokens("b", "benchmark", "item_id"), _runs("d", "d", "doc_id"), _runs("b", "b", "item_id"),
    """bn AS (SELECT CASE WHEN n = 2 AND gaps[i] = ' ' THEN words[i] || ' ' || words[i + 1] WHEN n = 3 AND gaps[i] = ' ' AND gaps[i + 1] = ' ' THEN words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS phrase
  FROM (SELECT words, gaps, unnest(range(1, len(words) + 1)) AS i FROM b_w), (SELECT unnest([2, 3]) AS n) WHERE i + n - 1 <= len(words))""",
    "ph AS (SELECT phrase FROM bn WHERE phrase IS NOT NULL GROUP BY phrase HAVING count(*) >= 2)",
    """cand AS (SELECT doc_id, par, i - 1 AS start, n, CASE n WHEN 2 THEN words[i] || gaps[i] || words[i + 1] ELSE words[i] || gaps[i] || words[i + 1] || gaps[i + 1] || words[i + 2] END AS phrase, CASE WHEN gaps[i + n - 1] = '''' THEN words[i + n] END AS tail
  FROM (SELECT doc_id, par, words, gaps, unnest(range(1, len(words) + 1)) AS i FROM d_w), (SELECT unnest([2, 3]) AS n) WHERE i + n - 1 <= len(words))""",
    "hits AS (SELECT doc_id, par, start, max(row(start + n + CAST(tail IS NOT NULL AS INTEGER), phrase, tail)::STRUCT(stop BIGINT, phrase VARCHAR, tail VARCHAR)) AS h FROM cand WHERE phrase IN (SELECT phrase FROM ph) GROUP BY ALL)",
    "flat_hits AS (SELECT doc_id, par, start, h.stop AS stop, h.phrase AS phrase, h.tail AS tail FROM hits)",
    "nexts AS (SELECT x.*, y.start AS after FROM flat_hits x ASOF LEFT JOIN flat_hits y ON x.doc_id = y.doc_id AND x.par = y.par AND x.stop <= y.start)",
    "took AS (SELECT * FROM nexts QUALIFY start = min(start) OVER (PARTITION BY doc_id, par) UNION ALL SELECT n.* FROM took t JOIN nexts n ON n.doc_id = t.doc_id AND n.par = t.par AND n.start = t.after)",
    f"spans AS (SELECT doc_id, par, start, stop, phrase FROM took WHERE tail IS NULL OR regexp_matches(tail, '{SUFFIXED}'))",
])

_RAW = f"raw AS (SELECT doc_id, par, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT doc_id, par, regexp_extract_all(ptext, '[{LETTERS}]+') AS ws FROM d_p))"

_FLAT = f"translate({{0}}, '{CIRCUMFLEX[0]}', '{CIRCUMFLEX[1]}')"
_PAIRS = f"""acc AS (SELECT translate(k, '{ACCENTS[0]}', '{ACCENTS[1]}') AS k, k AS w, count(*) AS n FROM d GROUP BY 1, 2),
words AS (SELECT k, k AS made, spelling AS "right", CAST('0' AS BIGINT) AS z FROM (SELECT k, max_by(w, row(n, w)) AS spelling, max(n) AS n, sum(n) AS total FROM acc GROUP BY k) WHERE n >= 2 AND n >= total * CAST(0.7 AS DOUBLE) AND length(k) >= 4)"""
_RULES = """ends AS (SELECT k, right(k, L) AS s, right(made, m) AS t1, made, "right" FROM words, (SELECT unnest(range(2, 9)) AS L), (SELECT unnest(range(1, 7)) AS m) WHERE L <= length(k) - 2 AND m <= length(made)),
per_end AS (SELECT s, t1, count(*) AS applied, CAST(sum(CAST(made = "right" AS BIGINT)) AS BIGINT) AS same FROM ends GROUP BY ALL),
goods AS (SELECT s, t1, t2, count(*) AS good FROM (SELECT s, t1, substring("right", length(made) - length(t1) + 1) AS t2 FROM ends WHERE starts_with("right", left(made, length(made) - length(t1)))) GROUP BY ALL),
firsts AS (SELECT *, list_min(list_filter(range(1, length(made) + 2), lambda i: i > length(made) OR made[i] <> "right"[i])) - 1 AS p FROM words WHERE made <> "right"),
cands AS (SELECT DISTINCT right(k, L) AS s, substring(made, q + 1) AS t1, substring("right", q + 1) AS t2 FROM (SELECT *, unnest([p, p - 1, p - 2]) AS q FROM firsts), (SELECT unnest(range(2, 9)) AS L)
  WHERE q >= 0 AND length(made) - q <= 6 AND length("right") - q <= 7 AND length(made) > q AND L <= length(k) - 2),
rules AS (SELECT c.s, c.t1, c.t2, g.good, e.same AS broken, e.applied FROM cands c JOIN goods g ON g.s = c.s AND g.t1 = c.t1 AND g.t2 = c.t2 JOIN per_end e ON e.s = c.s AND e.t1 = c.t1
  WHERE g.good >= 3 AND e.same <= CAST(0.05 AS DOUBLE) * g.good AND CAST(g.good AS DOUBLE) / e.applied >= CAST(0.6 AS DOUBLE))"""

_CLAUSE = f"""cl AS (SELECT doc_id, par, clause, list_transform(regexp_extract_all(c, '[{LETTERS}]+(?:[’''‘][{LETTERS}]+)*'), lambda w: {_LOWER.format('w')}) AS keys FROM (
  SELECT doc_id, par, unnest(range(len(cs))) AS clause, unnest(cs) AS c FROM (SELECT doc_id, par, regexp_split_to_array(ptext, '[.!?;:,]') AS cs FROM d_p))),
ct AS (SELECT doc_id, par, clause, unnest(range(len(keys))) AS pos, unnest(keys) AS k FROM cl),
near AS (SELECT *, last_value(CASE WHEN k IN ({_quoted(ARTICLES + BLOCKERS)}) THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id, par, clause ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS owner_pos FROM ct)"""

_VARIANTS = f"""un AS (SELECT k, string_split(k, '') AS cs FROM dw WHERE k NOT IN (SELECT k FROM bw)),
pl AS (SELECT k, cs, list_filter(range(2, len(cs) + 1), lambda i: cs[i] = 'p' OR (cs[i] IN ('t', 'ç') AND (i = len(cs) OR cs[i + 1] NOT IN ({_quoted(ALL_VOWELS)})))) AS places FROM un),
sv AS (SELECT k, mask, array_to_string(list_transform(cs, lambda c, i: CASE WHEN list_contains(places, i) AND (mask >> CAST(len(places) - list_position(places, i) AS BIGINT)) % 2 = 1 THEN translate(c, '{HARDENED[0]}', '{HARDENED[1]}') ELSE c END), '') AS variant
  FROM (SELECT *, unnest(range(1, CAST(2 ** len(places) AS BIGINT))) AS mask FROM pl WHERE len(places) BETWEEN 1 AND {PLACES})),
rv AS (SELECT k, i, left(k, i - 1) || translate(cs[i], '{ROUNDED[0]}', '{ROUNDED[1]}') || substring(k, i + 1) AS variant FROM (SELECT *, unnest(range(2, len(cs) + 1)) AS i FROM un) WHERE cs[i] IN ({_quoted(ROUNDED[0])})),
vs AS (SELECT k, variant, 'soft' AS kind, row(0, bit_count(mask), -mask) AS turn FROM sv UNION ALL SELECT k, variant, 'rounded', row(1, 0, i) FROM rv)"""

ORACLE: dict[str, str] = {
    "legal_chain_split": _with(_D, _DW, _B, _BW, _TRIED, _STEPS, _walk(5, LONGEST, False)) + "SELECT tail, array_to_string(parts, '+') AS parts FROM chains",
    "tail_split": _with(_D, _DW, _B, _BW, _TRIED, _STEPS, _KNOWN, _SPLIT) + "SELECT tail, array_to_string(parts, '+') AS parts FROM split3",
    "suffix_peel": _with(_D, _DW, _B, _BW, _peel()) + "SELECT k, root, array_to_string(parts, '+') AS parts FROM peeled",
    "deep_roots": _with(_D, _DW, _B, _BW, _TRIED, _STEPS, _walk(5, 5, True), _ROOTED) + "SELECT k, root, array_to_string(parts, '+') AS parts FROM rooted",
    "chain_spelling": _with(_D, _DW, _B, _BW, _TRIED, _STEPS, _walk(5, 5, True), _ROOTED, _SLOTTED) + f"SELECT k, root, array_to_string(parts, '+') AS chain, sound, {_spelled('root', 'parts', 'sound')} AS spelling FROM slots",
    "verb_split": _with(_D, _DW, _VERBS) + "SELECT k, b.stem AS stem, b.ending AS ending, b.spelling AS spelling, left(b.ending, 1) = 'y' AND right(b.stem, 1) <> 'e' AND right(b.stem, 2) <> 'ma' AS glide FROM verbs",
    "variant_hits": _with(_D, _DW, _B, _BW, _VARIANTS) + "SELECT k, min_by(variant, turn) AS variant, min_by(kind, turn) AS kind FROM vs WHERE variant IN (SELECT k FROM bw) GROUP BY k",
    "phrase_covered_tokens": _with(_SPANS) + "SELECT doc_id, count(*) AS phrases, CAST(sum(stop - start) AS BIGINT) AS covered, CAST(max(length(phrase)) AS INTEGER) AS longest FROM spans GROUP BY doc_id",
    "claim_layers": _with(_SPANS, _RAW, "on_phrase AS (SELECT doc_id, par, unnest(range(start, stop)) AS pos FROM spans)",
                          f"inner_ AS (SELECT r.doc_id, CASE WHEN r.w IN ({_quoted(n for n in ROMAN if len(n) > 1)}) THEN 'numeral' ELSE 'short' END AS layer FROM raw r ANTI JOIN on_phrase o ON o.doc_id = r.doc_id AND o.par = r.par AND o.pos = r.pos WHERE length(r.w) = 2 OR r.w IN ({_quoted(n for n in ROMAN if len(n) > 1)}))")
    + "SELECT doc_id, layer, count(*) AS claims, CAST(sum(n) AS BIGINT) AS words FROM (SELECT doc_id, 'phrase' AS layer, stop - start AS n FROM spans UNION ALL SELECT doc_id, layer, 1 FROM inner_) GROUP BY doc_id, layer",
    "word_layers": _with(_D, _DW, _B, _BW, _TRIED, _STEPS, _walk(5, 5, True), _ROOTED, _peel(), _VERBS,
                         f"fl AS (SELECT DISTINCT {_FLAT.format('k')} AS f FROM bw WHERE {_FLAT.format('k')} NOT IN ({_quoted(FLAT_EXCLUDED)}))",
                         f"ap AS (SELECT k FROM dw WHERE regexp_matches(k, '[''’]') AND regexp_extract(k, '^(.*?)[''’](.*)$', 1) IN (SELECT k FROM bw) AND regexp_matches(regexp_extract(k, '^(.*?)[''’](.*)$', 2), '{SUFFIXED}'))",
                         f"""how AS (SELECT k, CASE WHEN k IN (SELECT k FROM bw) THEN 'exact' WHEN {_FLAT.format('k')} IN (SELECT f FROM fl) THEN 'circumflex' WHEN k IN (SELECT k FROM ap) THEN 'apostrophe' WHEN k IN (SELECT k FROM peeled) THEN 'peeled' WHEN k IN (SELECT k FROM rooted) AND k NOT IN (SELECT k FROM verbs) THEN 'rooted' WHEN k IN (SELECT k FROM verbs) THEN 'verb' ELSE 'letters' END AS layer FROM dw)""")
    + 'SELECT layer, count(*) AS words, CAST(sum(length(k)) AS BIGINT) AS letters, min(k) AS "first", max(k) AS "last" FROM how GROUP BY layer',
    "learned_suffix_rules": _with(_D, _PAIRS, _RULES) + "SELECT s, t1, t2, good, broken, applied FROM rules",
    "feature_counts": _with(_DS, _NEAR, _PAIRS_ALL, _AMBIGUOUS) + "SELECT k, w, source, feature, count(*) AS n FROM (SELECT k, w, source, unnest(['L1:' || l1, 'R1:' || r1]) AS feature FROM near WHERE source IS NOT NULL AND k IN (SELECT k FROM amb)) GROUP BY ALL",
    "nearest_owner_6": _with(_tokens("d", "documents", "doc_id"), _CLAUSE)
    + f"""SELECT x.doc_id, x.par, CAST(x.clause AS INTEGER) AS clause, CAST(x.pos AS INTEGER) AS pos, x.k, CAST(x.owner_pos AS INTEGER) AS owner_pos FROM near x JOIN ct o ON o.doc_id = x.doc_id AND o.par = x.par AND o.clause = x.clause AND o.pos = x.owner_pos
LEFT JOIN ct t ON t.doc_id = x.doc_id AND t.par = x.par AND t.clause = x.clause AND t.pos = x.owner_pos + 1 WHERE length(x.k) >= 5 AND o.k IN ({_quoted(ARTICLES)}) AND NOT (x.owner_pos + 1 < x.pos AND coalesce(t.k, '') IN ({_quoted(TURNERS)}))""",
}
