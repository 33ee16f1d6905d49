"""The registered queries once more, in the SQL of another engine, written from the definitions and not from the
plans: dense instead of sparse dispersion, one global numbering instead of running sums, lag/lead instead of offset joins."""

from __future__ import annotations

# --- fixed values, written once more so that a mistake in the engine's own shows -----------------------------
ENGLISH_HINTS = "the and of to is in that it with for".split()
GERMAN_HINTS = "der die und das ist nicht ein eine mit sich den zu".split()
ALL_FUNCTION_WORDS = sorted(
    {
        *"a an the this that these those i you he she it we they me him her us them my your his its our their of in on at by to for from with and or but not no as if is are was were be been has have had do does did will would can could which who".split(),
        *"der die das den dem des ein eine einen einem einer eines ich du er sie es wir ihr und oder aber nicht kein in im an am auf aus bei mit nach von vom zu zum zur für ist sind war sein hat haben wird werden als wie dass sich".split(),
        *"le la les un une des du de d l et ou mais ne pas je tu il elle nous vous ils elles ce cette ces dans en sur pour par avec qui que à au aux est sont a se son sa ses".split(),
        *"el la los las un una unos unas de del al y o pero no yo tú él ella nosotros ellos ellas en con por para que se su sus es son ha lo le les como".split(),
    }
)
#: Old spelling, new spelling.
SPELLINGS = """
daß dass
muß muss
mußte musste
mußten mussten
müßte müsste
müßten müssten
gemußt gemusst
läßt lässt
laßt lasst
gewußt gewusst
wußte wusste
wußten wussten
bißchen bisschen
Kuß Kuss
Faß Fass
Fluß Fluss
Nuß Nuss
Schluß Schluss
Anschluß Anschluss
Abschluß Abschluss
Prozeß Prozess
Streß Stress
Paß Pass
Reisepaß Reisepass
Haß Hass
Schuß Schuss
Genuß Genuss
Einfluß Einfluss
Kongreß Kongress
Kompromiß Kompromiss
Mißverständnis Missverständnis
mißverstehen missverstehen
Erlaß Erlass
naß nass
Riß Riss
Biß Biss
Schiffahrt Schifffahrt
Brennessel Brennnessel
rauh rau
Rauheit Rauheit
Känguruh Känguru
Zierrat Zierrat
numerieren nummerieren
plazieren platzieren
Stengel Stängel
Stukkateur Stuckateur
Tip Tipp
Stop Stopp
Photo Foto
Photographie Fotografie
Delphin Delfin
Alptraum Albtraum
Quentchen Quäntchen
selbständig selbstständig
Rolladen Rollladen
"""
MARKS = {
    "CORPUS_TOO_SMALL": "small corpus",
    "DISPERSION_SKEWED": "skewed",
    "DP_TOO_FEW_PARTS": "few parts",
    "LOW_FREQUENCY": "rare",
    "GROUP_IMBALANCE": "imbalance",
    "LOW_COOCCURRENCE": "few, looks strong",
    "LOW_COOCCURRENCE_MINOR": "few",
    "BOTH_HIGH_FREQUENCY": "both frequent",
    "NOT_DISTINGUISHABLE": "undecided",
    "T_HIGH_MI_LOW": "common neighbour",
    "ZERO_CORRECTED": "absent in one",
    "EFFECT_SIZE_TOO_SMALL": "small effect",
}


def reform_pairs() -> dict[str, str]:
    found = {}
    for line in SPELLINGS.strip().split("\n"):
        old, new = line.split()
        if old != new:
            found[old] = new
            if old[0].islower():
                found[old.capitalize()] = new.capitalize()
    return found


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_PATTERN = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"


def _tokens(source: str) -> str:
    return rf"""
 (SELECT doc_id, lang, source, i - 1 AS position, surface,
    coalesce(sum(CASE WHEN surface IN ('.', '!', '?', '。', '！', '？') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence_id,
    CASE WHEN lang = 'de' THEN surface ELSE lower(surface) END AS lemma,
    CASE WHEN NOT regexp_matches(surface, '^[\p{{L}}\p{{M}}\p{{N}}]') THEN 'PUNCT' WHEN regexp_matches(surface, '^[0-9]+$') THEN 'NUM' WHEN lower(surface) IN ({_list(ALL_FUNCTION_WORDS)}) THEN 'FUNC' ELSE 'WORD' END AS pos
  FROM (SELECT doc_id, lang, source, unnest(l) AS surface, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, coalesce(lang, '') AS lang, source, regexp_extract_all(coalesce(text, ''), '{_PATTERN}') AS l FROM {source})))"""


_T = f"tk AS {_tokens('documents')},\nt AS MATERIALIZED (SELECT *, pos IN ('PUNCT', 'FUNC') AS is_function, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS rn FROM tk)"


def _with(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([_T, *more]) + "\n" + body


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def _frequency(unit: str = "lemma", where: str = "NOT is_function", part: str = "doc_id", source: str = "t") -> list[str]:
    """CTEs up to ``freq``, over source (a CTE like t)."""
    return [
        f"sizes AS (SELECT {part} AS part, count(*)::DOUBLE AS size FROM {source} WHERE {part} IS NOT NULL GROUP BY 1)",
        "tot AS (SELECT sum(size) AS n FROM sizes)",
        f"n_all AS (SELECT count(*) AS n FROM {source})",
        f"wp AS (SELECT {unit} AS word, {part} AS part, count(*)::DOUBLE AS f FROM {source} WHERE {where} AND {part} IS NOT NULL GROUP BY 1, 2)",
        "wf AS (SELECT word, sum(f) AS freq, count(*) AS n_parts FROM wp GROUP BY 1)",
        # absent parts add their share of the corpus: 1 minus the shares of those present
        "dps AS (SELECT wp.word, 0.5 * (sum(abs(f / freq - size / tot.n)) + 1 - sum(size / tot.n)) AS dp FROM wp JOIN wf USING (word) JOIN sizes USING (part), tot GROUP BY 1)",
        f"wpos AS (SELECT word, pos FROM (SELECT {unit} AS word, pos, row_number() OVER (PARTITION BY {unit} ORDER BY count(*) DESC, pos) AS k FROM {source} WHERE {where} GROUP BY {unit}, pos) WHERE k = 1)",
        "freq AS (SELECT row_number() OVER (ORDER BY freq DESC, word) AS rank, word, word AS label, pos, freq::BIGINT AS freq, freq / n_all.n * 1e6 AS pmw, dp, n_parts FROM wf JOIN dps USING (word) JOIN wpos USING (word), n_all)",
    ]


_FREQ_OUT = f"SELECT rank, word, label, pos, freq, {_r('pmw', 'pmw')}, {_r('dp', 'dp')}, n_parts FROM freq"
_FLAGS_FREQ = ["CASE WHEN dp > 0.5 AND freq >= 10 THEN 'DISPERSION_SKEWED' END", "CASE WHEN freq < 5 THEN 'LOW_FREQUENCY' END"]
_FLAG_FREQ = ", ".join(_FLAGS_FREQ)


def _sttr(unit: str, where: str, window: int, group: str | None = None) -> str:
    by, sel = (f"PARTITION BY {group} ", f"{group}, ") if group else ("", "")
    tail = f" GROUP BY {group}" if group else ""
    return f"SELECT {sel}avg(ty::DOUBLE / {window}) AS sttr FROM (SELECT {sel}k // {window} AS chunk, count(DISTINCT {unit}) AS ty FROM (SELECT {sel}{unit}, row_number() OVER ({by}ORDER BY doc_id, position) - 1 AS k FROM t WHERE {where}) GROUP BY {sel}chunk HAVING count(*) = {window}){tail}"


def _kwic(window: int, match: str, source: str = "t", extra: str = "TRUE", name: str = "k") -> list[str]:
    """CTE ``name``: lag/lead over all of source, then the hits."""
    ks = [f"coalesce(lag(surface, {k}) OVER w, '') AS L{k}" for k in range(window, 0, -1)] + [f"coalesce(lead(surface, {k}) OVER w, '') AS R{k}" for k in range(1, window + 1)]
    return [f"ctx AS (SELECT doc_id, position, sentence_id, lemma AS key, surface AS KWIC, {', '.join(ks)} FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY position))", f"{name} AS (SELECT * FROM ctx WHERE {match} AND {extra})"]


def _kwic_out(window: int) -> str:
    left, right = [f"L{k}" for k in range(window, 0, -1)], [f"R{k}" for k in range(1, window + 1)]

    def side(cols: list[str]) -> str:
        return f"array_to_string(list_filter([{', '.join(cols)}], lambda x: x <> ''), ' ')"

    return f"doc_id, position, sentence_id, key, {', '.join(left)}, KWIC, {', '.join(right)}, {side(left)} AS \"left\", {side(right)} AS \"right\""


def _collocation(occ: str, w: str, node: str = "thing") -> list[str]:
    return [
        f"h AS (SELECT * FROM t WHERE lemma = '{node}')",
        f"occ AS ({occ})",
        f"w AS ({w})",
        f"c0 AS (SELECT word, count(*) AS o FROM occ WHERE word <> '{node}' GROUP BY 1)",
        "voc AS (SELECT lemma AS word, count(*) AS fc, bool_or(is_function) AS is_function FROM t GROUP BY 1)",
        "vpos AS (SELECT word, pos FROM (SELECT lemma AS word, pos, row_number() OVER (PARTITION BY lemma ORDER BY count(*) DESC, pos) AS k FROM t GROUP BY lemma, pos) WHERE k = 1)",
        "sc AS (SELECT (SELECT count(*) FROM t)::DOUBLE AS n, (SELECT count(*) FROM h)::DOUBLE AS fn, (SELECT w FROM w)::DOUBLE AS w)",
        "c1 AS (SELECT word, is_function, pos, o::DOUBLE AS o, fc::DOUBLE AS fc, fn, n, w, fn * fc * w / n AS e, greatest(fc - o, 0) AS b, greatest(fn * w - o, 0) AS c FROM c0 JOIN voc USING (word) JOIN vpos USING (word), sc)",
        "c2 AS (SELECT *, greatest(n - o - b - c, 0) AS d FROM c1)",
        "c3 AS (SELECT *, o + b + c + d AS s FROM c2)",
        "col AS (SELECT word AS collocate, word AS label, pos, is_function, '' AS relation, o::BIGINT AS cooccur, fn::BIGINT AS freq_node, fc::BIGINT AS freq_collocate, e AS expected, log2(o / e) AS mi, (o - e) / sqrt(o) AS t, 14 + log2(2 * o / (fn + fc)) AS log_dice,"
        " 2 * (o * ln(o / ((o + b) * (o + c) / s)) + CASE WHEN b > 0 THEN b * ln(b / ((o + b) * (b + d) / s)) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c / ((c + d) * (o + c) / s)) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d / ((c + d) * (b + d) / s)) ELSE 0 END) AS g2 FROM c3)",
    ]


_SENTENCE = _collocation(
    "SELECT x.lemma AS word FROM h JOIN t x ON x.doc_id = h.doc_id AND x.sentence_id = h.sentence_id AND x.position <> h.position",
    "SELECT avg(size - 1) AS w FROM h JOIN (SELECT doc_id, sentence_id, count(*) AS size FROM t GROUP BY 1, 2) USING (doc_id, sentence_id)",
)
_FIXED = _collocation("SELECT x.lemma AS word FROM h JOIN t x ON x.doc_id = h.doc_id AND x.rn BETWEEN h.rn - 5 AND h.rn + 5 AND x.rn <> h.rn", "SELECT 10 AS w")
_COL_OUT = "SELECT collocate, label, pos, is_function, relation, cooccur, freq_node, freq_collocate, " + ", ".join(_r(c, c) for c in ("expected", "mi", "t", "log_dice", "g2")) + " FROM col"
_CUTOFF = "SELECT coalesce(max(freq), 2147483648)::BIGINT AS cutoff FROM (SELECT count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC) AS k, count(*) OVER () AS types FROM t GROUP BY lemma) WHERE k = greatest(1, ceil(types * 0.01))"
_STRONG = "(log_dice >= 7 OR mi >= 3 OR g2 >= 6.63)"
_FLAG_COL = f"[CASE WHEN cooccur < 20 AND {_STRONG} THEN 'LOW_COOCCURRENCE' END, CASE WHEN cooccur < 20 AND NOT {_STRONG} THEN 'LOW_COOCCURRENCE_MINOR' END, CASE WHEN g2 < 6.63 THEN 'NOT_DISTINGUISHABLE' END, CASE WHEN freq_node >= cutoff AND freq_collocate >= cutoff THEN 'BOTH_HIGH_FREQUENCY' END, CASE WHEN t > 2 AND mi < 3 THEN 'T_HIGH_MI_LOW' END]"
_FLAGGED = [*_SENTENCE, f"cut AS ({_CUTOFF})", f"fl AS (SELECT col.*, {_FLAG_COL} AS flags FROM col, cut WHERE cooccur >= 2)"]

_NODES = "nodes AS (SELECT lemma AS word, count(*) AS freq FROM t WHERE NOT is_function GROUP BY 1 ORDER BY freq DESC, word LIMIT 60)"
_SETS = "sw AS (SELECT DISTINCT doc_id, sentence_id, lemma AS word FROM t WHERE lemma IN (SELECT word FROM nodes))"
_PAIRS = "pr AS (SELECT x.word AS a, y.word AS b, count(*) AS cooccur FROM sw x JOIN sw y ON x.doc_id = y.doc_id AND x.sentence_id = y.sentence_id AND x.word < y.word GROUP BY 1, 2)"
_UF = "uf AS (SELECT word, count(*) AS u FROM sw GROUP BY 1)"
_EDGES = "ed AS (SELECT a, b, cooccur, 14 + log2(2.0 * cooccur / (x.u + y.u)) AS log_dice FROM pr JOIN uf x ON x.word = a JOIN uf y ON y.word = b WHERE 14 + log2(2.0 * cooccur / (x.u + y.u)) >= 4 AND cooccur >= 2)"


def _keyness(a: str, b: str | None) -> list[str]:
    side = f"CASE WHEN lang = '{a}' THEN 'A' " + (f"WHEN lang = '{b}' THEN 'B' END" if b else "ELSE 'B' END")
    return [
        f"s AS (SELECT *, {side} AS side FROM t)",
        "ab AS (SELECT * FROM s WHERE side IS NOT NULL)",
        "nn AS (SELECT count(*) FILTER (side = 'A')::DOUBLE AS na, count(*) FILTER (side = 'B')::DOUBLE AS nb FROM ab)",
        "kf AS (SELECT lemma AS word, count(*) FILTER (side = 'A')::DOUBLE AS fa, count(*) FILTER (side = 'B')::DOUBLE AS fb FROM ab WHERE NOT is_function GROUP BY 1)",
        "kpos AS (SELECT word, pos FROM (SELECT lemma AS word, pos, row_number() OVER (PARTITION BY lemma ORDER BY count(*) DESC, pos) AS k FROM ab WHERE NOT is_function GROUP BY lemma, pos) WHERE k = 1)",
        "k1 AS (SELECT *, CASE WHEN fa = 0 OR fb = 0 THEN 0.5 ELSE 0 END AS z, na * (fa + fb) / (na + nb) AS ea, nb * (fa + fb) / (na + nb) AS eb FROM kf JOIN kpos USING (word), nn WHERE na > 0 AND nb > 0)",
        "k2 AS (SELECT word, word AS label, pos, fa::BIGINT AS freq_a, fb::BIGINT AS freq_b, fa / na * 1e6 AS pmw_a, fb / nb * 1e6 AS pmw_b, 2 * (CASE WHEN fa > 0 THEN fa * ln(fa / ea) ELSE 0 END + CASE WHEN fb > 0 THEN fb * ln(fb / eb) ELSE 0 END) AS g2,"
        " log2(((fa + z) / na) / ((fb + z) / nb)) AS log_ratio, CASE WHEN fa > 0 AND fb > 0 AND na > fa AND nb > fb THEN (fa / (na - fa)) / (fb / (nb - fb)) END AS odds_ratio, z > 0 AS zero_corrected FROM k1)",
        "key AS (SELECT *, CASE WHEN log_ratio > 0 THEN 'A' WHEN log_ratio < 0 THEN 'B' ELSE '=' END AS direction FROM k2)",
    ]


_KEY_OUT = "SELECT word, label, pos, freq_a, freq_b, " + ", ".join(_r(c, c) for c in ("pmw_a", "pmw_b", "g2", "log_ratio", "odds_ratio")) + ", zero_corrected, direction FROM key"
_MARKS = " ".join(f"WHEN '{code}' THEN '{mark}'" for code, mark in MARKS.items())
#: erfc(z): its power series up to 3, its asymptotic series beyond.
_ERFC = "CASE WHEN z < 3 THEN 1 - 2 / sqrt(pi()) * list_sum([pow(-1, n) * pow(z, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)) FOR n IN range(0, 70)]) ELSE exp(-z * z) / (z * sqrt(pi())) * (1 - 1 / (2 * z * z) + 3 / pow(2 * z * z, 2) - 15 / pow(2 * z * z, 3) + 105 / pow(2 * z * z, 4) - 945 / pow(2 * z * z, 5)) END"
#: Distances and numbers of shortest paths between all nodes of the edge list, then the share of paths through each.
_PATHS = [
    "dg AS (SELECT word, count(*) AS degree FROM (SELECT a AS word FROM ed UNION ALL SELECT b FROM ed) GROUP BY 1)",
    "adj AS MATERIALIZED (SELECT a AS u, b AS v FROM ed UNION ALL SELECT b, a FROM ed)",
    "reach(s, v, d) AS (SELECT DISTINCT u, u, 0 FROM adj UNION SELECT reach.s, adj.v, reach.d + 1 FROM reach JOIN adj ON adj.u = reach.v WHERE reach.d < 8)",
    "dist AS MATERIALIZED (SELECT s, v, min(d) AS d FROM reach GROUP BY 1, 2)",
    "sig(s, v, d, p) AS (SELECT DISTINCT u, u, 0, 1::DOUBLE FROM adj UNION ALL SELECT sig.s, adj.v, sig.d + 1, sum(sig.p) FROM sig JOIN adj ON adj.u = sig.v JOIN dist ON dist.s = sig.s AND dist.v = adj.v AND dist.d = sig.d + 1 GROUP BY 1, 2, 3)",
    "paths AS MATERIALIZED (SELECT * FROM sig)",
    "bt AS (SELECT x.v AS word, sum(x.p * y.p / z.p) AS b FROM paths x JOIN paths y ON y.s = x.v JOIN paths z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.d > 0 AND y.d > 0 GROUP BY 1)",
    "sz AS (SELECT count(*)::DOUBLE AS n FROM dg)",
]

_ENDINGS, _BASES, _LINKS = ("e", "em", "en", "er", "es", "n", "s", "st", "t", "te", "ten"), ("", "e", "en"), ("", "s", "es", "n", "en", "er")
_PREFIXES = ("ab", "an", "auf", "aus", "bei", "ein", "fort", "her", "hin", "los", "mit", "nach", "nieder", "vor", "weg", "weiter", "zu", "zurück", "zusammen")
#: alts (surface, alt): by the most frequent edit under a word's longest known ending.
_OTHER_LEMMA = [
    "gw AS MATERIALIZED (SELECT surface AS word, count(*) AS n FROM t WHERE pos = 'WORD' GROUP BY 1)",
    f"asked AS (SELECT word, n, substr(word, 1, length(word) - length(e)) || b AS base FROM gw, (SELECT unnest([{_list(list(_ENDINGS))}]) AS e), (SELECT unnest([{_list(list(_BASES))}]) AS b) WHERE ends_with(word, e) AND length(word) - length(e) >= 3)",
    "bases AS (SELECT * FROM (SELECT asked.word, asked.base, row_number() OVER (PARTITION BY asked.word ORDER BY x.n DESC, asked.base) AS k FROM asked JOIN gw x ON x.word = asked.base WHERE asked.base <> asked.word AND x.n > asked.n) WHERE k = 1)",
    "pairs AS (SELECT gw.word AS surface, coalesce(base, gw.word) AS lemma FROM gw LEFT JOIN bases ON bases.word = gw.word)",
    "eds AS (SELECT surface, lemma, list_min(list_filter(range(0, 6), lambda k: k <= length(surface) AND starts_with(lemma, substr(surface, 1, length(surface) - k)))) AS cut FROM pairs)",
    "ends AS (SELECT surface, cut, substr(lemma, length(surface) - cut + 1) AS put, unnest(range(cut, least(5, length(surface)) + 1)) AS k FROM eds WHERE cut IS NOT NULL)",
    'eruls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ending ORDER BY support DESC, cut, put) AS r FROM (SELECT "right"(surface, k) AS ending, cut, put, count(*) AS support FROM ends GROUP BY 1, 2, 3) WHERE support >= 2) WHERE r = 1)',
    'alts AS MATERIALIZED (SELECT surface, substr(surface, 1, length(surface) - cut) || put AS alt FROM (SELECT p.surface, cut, put, row_number() OVER (PARTITION BY p.surface ORDER BY p.k DESC) AS r FROM (SELECT word AS surface, unnest(range(0, least(5, length(word)) + 1)) AS k FROM gw) p JOIN eruls ON ending = "right"(p.surface, p.k)) WHERE r = 1)',
]
#: sep: the tokens with verbs and closing prefixes put together.
_SEPARATED = [
    "cl AS MATERIALIZED (SELECT *, count(*) FILTER (pos = 'PUNCT') OVER (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS clause FROM t)",
    "la AS (SELECT doc_id, clause, max(position) AS last, arg_max(lower(surface), position) AS p FROM cl WHERE pos <> 'PUNCT' GROUP BY 1, 2)",
    f"pf AS (SELECT DISTINCT substr(w, length(p) + 1) AS rest, p FROM (SELECT DISTINCT lower(surface) AS w FROM t WHERE pos = 'WORD'), (SELECT unnest([{_list(list(_PREFIXES))}]) AS p) WHERE starts_with(w, p) AND length(w) - length(p) >= 3)",
    "vb AS MATERIALIZED (SELECT cl.doc_id, la.last, la.p, min(cl.position) AS verb FROM cl JOIN la ON la.doc_id = cl.doc_id AND la.clause = cl.clause AND cl.position < la.last JOIN pf ON pf.p = la.p AND pf.rest = lower(cl.surface) WHERE cl.pos = 'WORD' GROUP BY 1, 2, 3)",
    "sep AS MATERIALIZED (SELECT t.doc_id, t.position, surface, coalesce(v.p, '') || surface AS lemma, CASE WHEN l.verb IS NOT NULL THEN 'PART' ELSE pos END AS pos, is_function OR l.verb IS NOT NULL AS is_function, CASE WHEN l.verb IS NOT NULL THEN 'svp' ELSE '' END AS dep, coalesce(l.verb, -1) AS head"
    " FROM t LEFT JOIN vb v ON v.doc_id = t.doc_id AND v.verb = t.position LEFT JOIN vb l ON l.doc_id = t.doc_id AND l.last = t.position)",
]
#: cp (surface, parts): the best cut of capitalised words, from shares of three and four characters.
_COMPOUNDS = [
    r"lw AS MATERIALIZED (SELECT DISTINCT surface, lower(surface) AS word FROM t WHERE pos = 'WORD' AND NOT regexp_matches(surface, '[^\p{L}]'))",
    "gm AS MATERIALIZED (SELECT word, k, i AS start, substr(word, i, k) AS gram FROM (SELECT word, k, unnest(range(1, length(word) - k + 2)) AS i FROM (SELECT DISTINCT word FROM lw WHERE length(word) >= 3), (VALUES (3), (4)) v(k)))",
    "sh AS MATERIALIZED (SELECT gram, count(*) FILTER (start = 1)::DOUBLE / count(*) AS b, count(*) FILTER (start + k = length(word) + 1)::DOUBLE / count(*) AS e, count(*) FILTER (start <> 1 AND start + k <> length(word) + 1)::DOUBLE / count(*) AS i FROM gm GROUP BY 1)",
    r"nn AS MATERIALIZED (SELECT * FROM lw WHERE regexp_matches(surface, '^\p{Lu}') AND length(word) >= 6)",
    "gs AS MATERIALIZED (SELECT word, k, start, b, e, i FROM gm JOIN sh USING (gram) WHERE word IN (SELECT word FROM nn))",
    "g1 AS (SELECT word, start + k - 1 AS at, max(e) AS e FROM gs GROUP BY 1, 2)",
    "g2 AS (SELECT word, start - 1 AS at, max(b) AS b FROM gs GROUP BY 1, 2)",
    "g3 AS (SELECT word, start - 1 + k // 2 AS at, min(i) AS i FROM gs GROUP BY 1, 2)",
    f"ct AS (SELECT word, c, l FROM (SELECT word, unnest(range(3, length(word) - 2)) AS c FROM (SELECT DISTINCT word FROM nn)), (SELECT unnest([{_list(list(_LINKS))}]) AS l) WHERE c - length(l) >= 3 AND substr(word, c - length(l) + 1, length(l)) = l)",
    "bc AS (SELECT * FROM (SELECT ct.*, e + b - i AS s, row_number() OVER (PARTITION BY ct.word ORDER BY e + b - i DESC, length(l), c) AS r FROM ct JOIN g1 ON g1.word = ct.word AND g1.at = c - length(l) JOIN g2 ON g2.word = ct.word AND g2.at = c JOIN g3 ON g3.word = ct.word AND g3.at = c) WHERE r = 1 AND s >= 0.5)",
    "cp AS MATERIALIZED (SELECT surface, upper(substr(word, 1, 1)) || substr(word, 2, c - length(l) - 1) || '+' || upper(substr(word, c + 1, 1)) || substr(word, c + 2) AS parts FROM nn JOIN bc USING (word))",
]

_SPELLED = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text || ' daß muß rauh dass muss rau Tip', '[A-Za-zÄÖÜäöüß]+') AS ws FROM documents),
c AS (SELECT doc_id, len(list_filter(ws, lambda x: x IN ({_list(sorted(reform_pairs()))})))::BIGINT AS old, len(list_filter(ws, lambda x: x IN ({_list(sorted(set(reform_pairs().values())))})))::BIGINT AS "new" FROM w)
"""

SQL: dict[str, str] = {
    "tokens": _with("SELECT doc_id, sentence_id, position, surface, lemma, pos, is_function FROM t"),
    "tokens_per_document": _with("SELECT doc_id, lang, source, n_tokens FROM (SELECT doc_id, count(*) AS n_tokens FROM t GROUP BY 1) JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)"),
    "corpus_summary": _with("SELECT (SELECT count(*) FROM documents) AS n_documents, count(*) AS n_tokens, count(DISTINCT lemma) AS n_types, count(*) FILTER (NOT is_function) AS n_tokens_content, count(DISTINCT lemma) FILTER (NOT is_function) AS n_types_content, 'mixed' AS language FROM t"),
    "basic_stats": _with(f"SELECT count(*) AS n_tokens_all, count(*) FILTER (NOT is_function) AS n_tokens, count(DISTINCT lemma) FILTER (NOT is_function) AS n_types, {_r('count(DISTINCT lemma) FILTER (NOT is_function)::DOUBLE / count(*) FILTER (NOT is_function)', 'ttr')}, {_r('(SELECT sttr FROM st)', 'sttr')}, 1000::BIGINT AS sttr_window, count(DISTINCT doc_id) AS n_documents FROM t", f"st AS ({_sttr('lemma', 'NOT is_function', 1000)})"),
    "sttr": _with(f"SELECT {_r('sttr', 'sttr')} FROM ({_sttr('surface', 'TRUE', 500)})"),
    "per_document_stats": _with(f"SELECT doc_id, n_tokens, n_types, {_r('n_types::DOUBLE / n_tokens', 'ttr')}, {_r('sttr', 'sttr')} FROM (SELECT doc_id, count(*) AS n_tokens, count(DISTINCT lemma) AS n_types FROM t WHERE NOT is_function GROUP BY 1) LEFT JOIN st USING (doc_id)", f"st AS ({_sttr('lemma', 'NOT is_function', 100, 'doc_id')})"),
    "per_group_stats": _with(f"SELECT lang AS \"group\", n_documents, n_tokens, n_types, {_r('n_types::DOUBLE / n_tokens', 'ttr')}, {_r('sttr', 'sttr')} FROM (SELECT lang, count(DISTINCT doc_id) AS n_documents, count(*) AS n_tokens, count(DISTINCT lemma) AS n_types FROM t WHERE NOT is_function GROUP BY 1) LEFT JOIN st USING (lang)", f"st AS ({_sttr('lemma', 'NOT is_function', 1000, 'lang')})"),
    "pos_composition": _with(f"SELECT pos, count(*) AS count, {_r('count(*)::DOUBLE / sum(count(*)) OVER ()', 'ratio')} FROM t GROUP BY pos"),
    "group_sizes": _with("SELECT source AS \"group\", count(*) AS n_documents, coalesce(sum(n), 0)::BIGINT AS n_tokens FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM t GROUP BY 1) USING (doc_id) WHERE source IS NOT NULL GROUP BY 1"),
    "flag_group_imbalance": f"SELECT max(n) AS largest, min(n) AS smallest, {_r('max(n)::DOUBLE / min(n)', 'ratio')}, count(*) >= 2 AND max(n)::DOUBLE / min(n) > 3 AS flagged FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1)",
    "n_parts": "SELECT count(DISTINCT source) AS n_parts FROM documents",
    "frequency_table": _with(_FREQ_OUT, *_frequency()),
    "frequency_surface": _with(_FREQ_OUT, *_frequency("surface", "TRUE")),
    "frequency_by_group": _with(_FREQ_OUT, *_frequency(part="source")),
    "frequency_filtered": _with(_FREQ_OUT + " WHERE freq >= 10 AND pos = 'WORD' AND contains(word, 'th')", *_frequency()),
    "flag_frequency": _with(f"SELECT word, freq, concat_ws(',', {_FLAG_FREQ}) AS flags FROM freq", *_frequency()),
    "skewed_words": _with(f"SELECT rank, word, freq, {_r('dp', 'dp')} FROM freq WHERE dp > 0.5 AND freq >= 10 ORDER BY rank LIMIT 10", *_frequency()),
    "flag_labels": _with(f"SELECT word, concat_ws('; ', {', '.join(f'CASE ({flag}) {_MARKS} END' for flag in _FLAGS_FREQ)}) AS marks FROM freq", *_frequency()),
    "word_distribution": _with(f"SELECT doc_id AS part, count(*) AS part_tokens, count(*) FILTER (lemma = 'thing') AS freq, {_r('''count(*) FILTER (lemma = 'thing')::DOUBLE / count(*) * 1e6''', 'pmw_in_part')}, {_r('''coalesce(count(*) FILTER (lemma = 'thing')::DOUBLE / nullif(sum(count(*) FILTER (lemma = 'thing')) OVER (), 0), 0)''', 'share')} FROM t GROUP BY doc_id"),
    "zipf": _with("SELECT rank, freq, word FROM freq", *_frequency()),
    "duplicate_labels": _with("SELECT coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT lower(word) AS l, count(*) AS n FROM wf GROUP BY 1 HAVING count(*) > 1)", *_frequency()),
    "high_frequency_cutoff": _with(_CUTOFF),
    "compare_frequency_list": _with(
        f"SELECT word, e.freq AS freq_external, f.freq AS freq_own, {_r('f.freq::DOUBLE / e.freq', 'ratio')}, coalesce(f.freq::DOUBLE / e.freq BETWEEN 0.8 AND 1.25, FALSE) AS in_band FROM e LEFT JOIN (SELECT lemma AS word, count(*) AS freq FROM t GROUP BY 1) f USING (word)",
        f"e AS (SELECT lower(w) AS word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{_PATTERN}')) AS w FROM benchmark) GROUP BY 1 ORDER BY freq DESC, word LIMIT 30)",
    ),
    "find_hits_exact": _with("SELECT doc_id, position FROM t WHERE surface = 'Thing'"),
    "find_hits_nocase": _with("SELECT doc_id, position FROM t WHERE lower(surface) = 'thing'"),
    "find_hits_regex": _with("SELECT doc_id, position, lemma FROM t WHERE regexp_full_match(lemma, 'th[a-z]*ing')"),
    "kwic": _with(f"SELECT {_kwic_out(5)}, source AS name FROM k JOIN (SELECT doc_id, source FROM documents) USING (doc_id)", *_kwic(5, "key = 'thing'")),
    "kwic_sorted": _with(f"SELECT {_kwic_out(2)} FROM k", *_kwic(2, "key = 'thing'")),
    "kwic_page": _with(f"SELECT {_kwic_out(3)} FROM k ORDER BY R1, doc_id, position LIMIT 500 OFFSET 500", *_kwic(3, "key = 'the'")),
    "kwic_group": _with(f"SELECT {_kwic_out(3)} FROM k", "tg AS (SELECT * FROM t WHERE source = 'src3')", *_kwic(3, "key = 'thing'", "tg")),
    "kwic_content_context": _with(f"SELECT {_kwic_out(3)} FROM k", "tg AS (SELECT * FROM t WHERE NOT is_function OR lemma = 'thing')", *_kwic(3, "key = 'thing'", "tg")),
    "kwic_matched_keys": _with("SELECT surface AS key, count(*) AS count FROM t WHERE lower(surface) = 'thing' GROUP BY 1"),
    "kwic_collocate_sentence": _with(f"SELECT {_kwic_out(2)} FROM k", *_kwic(2, "key = 'thing'", name="k0"), "the AS (SELECT DISTINCT doc_id, sentence_id FROM t WHERE lemma = 'the')", "k AS (SELECT k0.* FROM k0 JOIN the USING (doc_id, sentence_id))"),
    "kwic_collocate_window": _with(f"SELECT {_kwic_out(3)} FROM k", *_kwic(3, "key = 'thing'", extra="'the' IN (" + ", ".join(f"lower({c}{k})" for c in "LR" for k in (1, 2, 3)) + ")")),
    "collocation_fixed": _with(_COL_OUT, *_FIXED),
    "collocation_sentence": _with(_COL_OUT, *_SENTENCE),
    "collocation_view": _with(_COL_OUT.replace(" FROM col", " FROM (SELECT * FROM col WHERE cooccur >= 2 AND NOT is_function ORDER BY log_dice DESC, cooccur DESC, collocate LIMIT 300)"), *_SENTENCE),
    "flag_collocation": _with("SELECT collocate, cooccur, array_to_string(list_filter(flags, lambda x: x IS NOT NULL), ',') AS flags FROM fl", *_FLAGGED),
    "needs_check": _with(f"SELECT collocate, cooccur, {_r('log_dice', 'log_dice')} FROM (SELECT * FROM fl WHERE list_contains(flags, 'LOW_COOCCURRENCE') ORDER BY log_dice DESC, cooccur DESC, collocate LIMIT 10)", *_FLAGGED),
    "noise_pairs": _with(f"SELECT collocate, cooccur, {_r('log_dice', 'log_dice')} FROM fl WHERE list_contains(flags, 'BOTH_HIGH_FREQUENCY')", *_FLAGGED),
    "network_nodes_top": _with("SELECT word, word AS label, freq FROM nodes", _NODES),
    "network_pairs_sentence": _with("SELECT a, b, cooccur FROM pr", _NODES, _SETS, _PAIRS),
    "network_pairs_fixed": _with("SELECT least(x.lemma, y.lemma) AS a, greatest(x.lemma, y.lemma) AS b, count(*) AS cooccur FROM nt x JOIN nt y ON x.doc_id = y.doc_id AND y.position > x.position AND y.position <= x.position + 5 AND x.lemma <> y.lemma GROUP BY 1, 2", _NODES, "nt AS (SELECT doc_id, position, lemma FROM t WHERE lemma IN (SELECT word FROM nodes))"),
    "network_edges": _with(f"SELECT a, b, cooccur, {_r('log_dice', 'log_dice')} FROM ed", _NODES, _SETS, _PAIRS, _UF, _EDGES),
    "network_degree": _with(f"SELECT word, word AS label, freq, degree, {_r('degree::DOUBLE / nullif((SELECT count(*) FROM dg) - 1, 0)', 'degree_centrality')} FROM dg JOIN nodes USING (word)", _NODES, _SETS, _PAIRS, _UF, _EDGES, "dg AS (SELECT word, count(*) AS degree FROM (SELECT a AS word FROM ed UNION ALL SELECT b FROM ed) GROUP BY 1)"),
    "network_betweenness": _with(
        f"SELECT word, word AS label, freq, degree, {_r('coalesce(degree / nullif(n - 1, 0), 0)', 'degree_centrality')}, {_r('coalesce(b / nullif((n - 1) * (n - 2), 0), 0)', 'betweenness')} FROM dg JOIN nodes USING (word) LEFT JOIN bt USING (word), sz",
        _NODES, _SETS, _PAIRS, _UF, _EDGES, *_PATHS,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "keyness_p_values": _with(f"SELECT word, {_r('g2', 'g2')}, {_r(_ERFC, 'p')} FROM (SELECT word, g2, sqrt(greatest(g2, 0) / 2) AS z FROM key)", *_keyness("en", None)),
    "keyness_table": _with(_KEY_OUT, *_keyness("fr", "es")),
    "keyness_vs_rest": _with(_KEY_OUT, *_keyness("en", None)),
    "keyness_view": _with(_KEY_OUT + " WHERE freq_a + freq_b >= 5 AND key.g2 >= 6.63 AND key.log_ratio > 0", *_keyness("en", None)),
    "keyness_hidden_count": _with("SELECT count(*) AS n_hidden FROM key WHERE freq_a + freq_b >= 5 AND g2 < 6.63", *_keyness("en", None)),
    "flag_keyness": _with("SELECT word, array_to_string(list_filter([CASE WHEN g2 < 6.63 THEN 'NOT_DISTINGUISHABLE' END, CASE WHEN abs(log_ratio) < 1 THEN 'EFFECT_SIZE_TOO_SMALL' END, CASE WHEN zero_corrected THEN 'ZERO_CORRECTED' END], lambda x: x IS NOT NULL), ',') AS flags FROM key", *_keyness("en", None)),
    "trend": _with(
        f"SELECT word, freq::BIGINT AS freq, s::BIGINT AS s, {_r('z', 'z')}, {_r('CASE WHEN TRUE THEN ' + _ERFC + ' END', 'p')}, {_r('slope', 'slope')} FROM (SELECT *, abs(zz) / sqrt(2) AS z, zz FROM tz) q".replace("round(z, 6) + 0.0 AS z", "round(zz, 6) + 0.0 AS z"),
        "ps AS (SELECT source AS g, count(*)::DOUBLE AS size, row_number() OVER (ORDER BY source) - 1 AS i FROM t WHERE source IS NOT NULL GROUP BY 1)",
        "pw AS (SELECT lemma AS word, source AS g, count(*) AS n FROM t WHERE source IS NOT NULL AND NOT is_function GROUP BY 1, 2)",
        "pk AS MATERIALIZED (SELECT word, sum(n) AS freq FROM pw GROUP BY 1 HAVING sum(n) >= 10)",
        "px AS MATERIALIZED (SELECT pk.word, i, coalesce(n, 0) / size * 1e6 AS x FROM pk CROSS JOIN ps LEFT JOIN pw ON pw.word = pk.word AND pw.g = ps.g)",
        "pp AS (SELECT a.word, sum(sign(b.x - a.x)) AS s, median((b.x - a.x) / (b.i - a.i)) AS slope FROM px a JOIN px b ON a.word = b.word AND a.i < b.i GROUP BY 1)",
        "pt AS (SELECT word, sum((m - 1) * (2 * m + 5) * m) AS ties FROM (SELECT word, x, count(*) AS m FROM px GROUP BY 1, 2) GROUP BY 1)",
        "tz AS (SELECT pk.word, freq, s, slope, CASE WHEN k * (k - 1) * (2 * k + 5) - ties > 0 THEN (s - sign(s)) / sqrt((k * (k - 1) * (2 * k + 5) - ties) / 18.0) ELSE 0 END AS zz FROM pk JOIN pp USING (word) JOIN pt USING (word), (SELECT count(*) AS k FROM ps))",
    ),
    "detect_language": f"""
WITH d AS (SELECT doc_id, substr(coalesce(text, ''), 1, 20000) AS h FROM documents),
w AS (SELECT doc_id, h, regexp_extract_all(lower(h), '[a-zäöüß]+') AS ws FROM d)
SELECT doc_id, CASE WHEN trim(h, ' ' || chr(9) || chr(10) || chr(13)) = '' OR len(regexp_extract_all(h, '[぀-ヿ一-鿿]')) > 0.05 * greatest(length(h), 1) OR len(ws) = 0 THEN 'ja'
  WHEN len(list_filter(ws, lambda x: x IN ({_list(GERMAN_HINTS)}))) > len(list_filter(ws, lambda x: x IN ({_list(ENGLISH_HINTS)}))) THEN 'de' ELSE 'en' END AS language FROM w""",
    "orthography_mix": _SPELLED + """SELECT *, old >= 3 AND "new" >= 3 AS mixed FROM c""",
    "mixed_spelling": _SPELLED + """SELECT sum(old)::BIGINT AS old, sum("new")::BIGINT AS "new", sum(old) >= 3 AND sum("new") >= 3 AS mixed FROM c""",
    "normalize_1996": f"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text || ' Daß, rauh! Photo', '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'),
  lambda w: CASE w {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in sorted(reform_pairs().items()))} ELSE w END), '') AS text FROM documents""",
    "normalize_ss": "SELECT doc_id, replace(replace(text, 'ß', 'ss'), 'ẞ', 'SS') AS text FROM documents",
    "normalize_umlaut": "SELECT doc_id, replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue') AS text FROM documents",
    "guess_text_column": "SELECT c AS \"column\" FROM (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS c, unnest([avg(length(doc_id::VARCHAR)), avg(length(text)), avg(length(lang)), avg(length(source)), avg(length(n_chars::VARCHAR))]) AS m FROM documents) ORDER BY m DESC LIMIT 1",
    "guess_group_columns": "SELECT c AS \"column\", n AS n_unique FROM (SELECT unnest(['doc_id', 'lang', 'source', 'n_chars']) AS c, unnest([count(DISTINCT doc_id), count(DISTINCT lang), count(DISTINCT source), count(DISTINCT n_chars)]) AS n, count(*) AS r FROM documents) WHERE n > 1 AND n <= 50 AND n < r",
    "documents_from_table": "SELECT doc_id, 'row ' || (doc_id + 1) AS name, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')",
    "looks_like_aozora": "SELECT doc_id, " + ", ".join(f"contains(substr({x}, 1, 5000), '《') AND contains(substr({x}, 1, 5000), '》') OR contains(substr({x}, 1, 5000), '［＃') OR contains(\"right\"({x}, 3000), '底本：') AS {name}" for name, x in (("plain", "t"), ("ruby", "(t || '吾輩《わがはい》')"), ("note", "('［＃改ページ］' || t)"), ("colophon", "(t || chr(10) || '底本：「猫」')"))) + " FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "kwic_index": _with(f"SELECT {_kwic_out(5)}, source FROM k JOIN (SELECT doc_id, source FROM documents) USING (doc_id)", *_kwic(5, "key = 'thing'")),
    "kwic_index_regex": _with(f"SELECT {_kwic_out(2)} FROM k", *_kwic(2, "regexp_full_match(key, 'th[a-z]*ing')")),
    "index_vocabulary": _with("SELECT lemma AS word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY 1"),
    "g2_2x2": f"""
WITH c AS (SELECT source, count(*) FILTER (e AND g) AS a, count(*) FILTER (e AND NOT g) AS b, count(*) FILTER (NOT e AND g) AS c, count(*) FILTER (NOT e AND NOT g) AS d FROM (SELECT source, coalesce(lang = 'en', FALSE) AS e, coalesce(n_chars >= 1000, FALSE) AS g FROM documents) GROUP BY 1),
l AS (SELECT *, unnest([a, b, c, d])::DOUBLE AS o, unnest([(a + b) * (a + c), (a + b) * (b + d), (c + d) * (a + c), (c + d) * (b + d)])::DOUBLE / nullif(a + b + c + d, 0) AS e FROM c)
SELECT source, a, b, c, d, {_r("CASE WHEN a + b + c + d > 0 THEN 2 * sum(CASE WHEN o > 0 AND e > 0 THEN o * ln(o / e) ELSE 0 END) END", "g2")} FROM l GROUP BY source, a, b, c, d""",
    "corpus_report": _with(
        "SELECT 'size' AS part, unnest(['n_documents', 'n_tokens', 'n_types', 'n_tokens_content', 'n_types_content']) AS item, unnest([(SELECT count(*) FROM documents), count(*), count(DISTINCT lemma), count(*) FILTER (NOT is_function), count(DISTINCT lemma) FILTER (NOT is_function)]) AS value FROM t"
        " UNION ALL SELECT 'frequency', word, freq FROM freq WHERE rank <= 100"
        " UNION ALL SELECT 'collocation', collocate, cooccur FROM (SELECT * FROM col WHERE cooccur >= 2 AND NOT is_function ORDER BY log_dice DESC, cooccur DESC, collocate LIMIT 50)"
        " UNION ALL SELECT 'concordance', 'thing', count(*) FROM h",
        *_frequency(), *_SENTENCE,
    ).replace("t AS MATERIALIZED (SELECT *,", "t AS MATERIALIZED (SELECT * REPLACE (lower(surface) AS lemma),", 1),
    "lemma_comparison": _with("SELECT surface, surface AS lemma, alt AS lemma_alt, n AS count FROM alts JOIN gw ON gw.word = alts.surface WHERE alt <> '' AND alt <> surface", *_OTHER_LEMMA),
    "frequency_other_lemma": _with(_FREQ_OUT, *_OTHER_LEMMA, "o AS (SELECT t.* REPLACE (coalesce(alt, t.surface) AS lemma) FROM t LEFT JOIN alts ON alts.surface = t.surface AND t.pos = 'WORD')", *_frequency(source="o")),
    "frequency_lowercase": _with(_FREQ_OUT, *_OTHER_LEMMA, "o AS (SELECT t.* REPLACE (lower(coalesce(alt, t.surface)) AS lemma) FROM t LEFT JOIN alts ON alts.surface = t.surface AND t.pos = 'WORD')", *_frequency(source="o")),
    "separable_verbs": _with("SELECT * FROM sep WHERE dep = 'svp' OR lemma <> surface", *_SEPARATED),
    "collocation_dependency": _with(
        f"SELECT collocate, relation, k::BIGINT AS cooccur, fn::BIGINT AS freq_node, fc::BIGINT AS freq_collocate, {_r('fn * fc * w / n', 'expected')}, {_r('log2(k / (fn * fc * w / n))', 'mi')}, {_r('14 + log2(2 * k / (fn + fc))', 'log_dice')} FROM dc JOIN df USING (collocate), dn WHERE collocate <> 'an'",
        *_SEPARATED,
        "dh AS (SELECT * FROM sep WHERE lemma = 'an')",
        "dr AS (SELECT x.lemma AS collocate, x.dep AS relation FROM dh JOIN sep x ON x.doc_id = dh.doc_id AND x.head = dh.position UNION ALL SELECT x.lemma, '→' || dh.dep FROM dh JOIN sep x ON x.doc_id = dh.doc_id AND x.position = dh.head)",
        "dn AS (SELECT (SELECT count(*) FROM sep)::DOUBLE AS n, (SELECT count(*) FROM dh)::DOUBLE AS fn, (SELECT count(*) FROM dr)::DOUBLE / (SELECT count(*) FROM dh) AS w)",
        "dc AS (SELECT collocate, relation, count(*)::DOUBLE AS k FROM dr GROUP BY 1, 2)",
        "df AS (SELECT lemma AS collocate, count(*)::DOUBLE AS fc FROM sep GROUP BY 1)",
    ),
    "compound_list": _with("SELECT surface, parts AS compound_parts, count(*) AS count FROM t JOIN cp USING (surface) GROUP BY 1, 2", *_COMPOUNDS),
    "frequency_compounds": _with("SELECT rank, word, freq, n_parts FROM freq", *_COMPOUNDS, "o AS (SELECT doc_id, pos, is_function, unnest(CASE WHEN parts IS NULL THEN [surface] ELSE string_split(parts, '+') END) AS lemma FROM t LEFT JOIN cp USING (surface))", *_frequency(source="o")),
}
